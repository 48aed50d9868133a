"""Corpus preparation: quality rules, line dedup, near dedup, pseudonyms, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as Parquet under the
shared folder before the next one reads it. All but the last return the columns of ``documents``; where a stage changes
texts, ``n_chars`` follows. Nulls, empty tables and repeated rows are treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import staged, table
from ledgerloom.llm.lines import drop_repeated_lines
from ledgerloom.llm.minhash import drop_near_duplicates
from ledgerloom.llm.packing import pack_documents
from ledgerloom.llm.pii import pseudonymise
from ledgerloom.llm.quality import keep_good


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars``, where the table has it, as the length of the text now."""
    if "n_chars" not in docs.columns:
        return docs
    kind = dict(docs.dtypes)["n_chars"]
    return docs.withColumn("n_chars", F.char_length("text").cast(kind))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(drop_repeated_lines(docs, counts=False))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(pseudonymise(docs, counts=False, any_area=True))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("pii", pseudonyms),
    ("packing", packing),
]

#: Learned rules and packing have no SQL form; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
