"""Named queries of the subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.bpe import op3_bpe
from ledgerloom.llm.language import op7_language
from ledgerloom.llm.lines import OP10_SQL, op10_lines
from ledgerloom.llm.maxent import op2_maxent
from ledgerloom.llm.middles import OP11_SQL, op11_middles
from ledgerloom.llm.minhash import op1_minhash
from ledgerloom.llm.nearest_vectors import op6_nearest
from ledgerloom.llm.packing import op9_packing
from ledgerloom.llm.periods import op13_periods
from ledgerloom.llm.pii import op5_pii
from ledgerloom.llm.quality import op8_quality
from ledgerloom.llm.suffixes import OP4_SQL, op4_repeats
from ledgerloom.llm.toxicity import op12_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_maxent": op2_maxent,
    "op3_bpe": op3_bpe,
    "op4_repeats": op4_repeats,
    "op5_pii": op5_pii,
    "op6_nearest": op6_nearest,
    "op7_language": op7_language,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_lines": op10_lines,
    "op11_middles": op11_middles,
    "op12_toxicity": op12_toxicity,
    "op13_periods": op13_periods,
}

ORACLE_SQL: dict[str, str] = {"op4_repeats": OP4_SQL, "op10_lines": OP10_SQL, "op11_middles": OP11_SQL}
