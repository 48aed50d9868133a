"""Attribution of native-reference bank rows to settlements by reference similarity alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import config as C
from ledgerloom.functions.narration import similar_pairs
from ledgerloom.operators.blocking import hay_keys, needle_keys, several_parts, shared_lead
from ledgerloom.operators.skew import lookup
from ledgerloom.session import stage


# A high floor needs few block keys, so it settles most texts cheaply (100: the reference stands in the text as it is);
# whatever has no partner there is searched again at the next floor. Every search is complete for its floor.
FLOORS = (100, 91, C.FUZZY_MIN_SIMILARITY)


def attribute_bank_rows(bank: DataFrame, pg: DataFrame) -> DataFrame:
    """Each bank row with the settlement whose UTR its narration resembles most, at or above the floor.

    No amount or date gate. References and narrations are reduced to distinct texts and paired only
    where they share a block key; every pair that can reach the floor shares one. Ties go to the
    settlement that comes first.
    """
    refs = pg.filter(F.coalesce("utr", F.lit("")) != "").groupBy(F.col("utr").alias("ref")).agg(
        F.min(F.struct("src_pos", "txn_id")).alias("first")
    )
    # numbered once, so that keys and pairs carry numbers instead of texts
    refs = stage(refs.withColumn("ref_id", F.monotonically_increasing_id()), "attribution-refs")
    texts = bank.filter(F.coalesce("narration", F.lit("")) != "").select(F.col("narration").alias("text")).distinct()
    texts = stage(texts.withColumn("text_id", F.monotonically_increasing_id()), "attribution-texts")
    found = []
    for floor in FLOORS:
        best = stage(_best_reference(refs, texts, floor), f"attribution-{floor}")
        found.append(best)
        texts = texts.join(best.select("text_id").hint("merge"), "text_id", "left_anti")
        if floor != FLOORS[-1] and texts.isEmpty():
            break
    answers = reduce(DataFrame.unionByName, found).select(F.col("text").alias("narration"), "best")
    return lookup(bank, answers.hint("merge"), ["narration"], "bank_ref").select(
        "bank_ref", "narration", F.col("best.txn_id").alias("txn_id"), F.col("best.similarity").alias("similarity")
    )


def _best_reference(refs: DataFrame, texts: DataFrame, floor: int) -> DataFrame:
    """The most similar reference of each text at or above ``floor``: (text_id, text, best)."""
    pairs = _sharing_keys(refs, texts, "ref", "text", floor, True)
    # references no shorter than the text are searched the other way round
    longest = refs.agg(F.max(F.length("ref")).alias("m")).first().m
    short = texts.filter(F.length("text") <= longest)
    if not short.isEmpty():
        pairs = pairs.unionByName(_sharing_keys(short, refs, "text", "ref", floor, True))
    # references and texts grow with the feeds; their files are so small that they would be planned as broadcasts
    once = pairs.distinct().join(refs.hint("merge"), "ref_id").join(texts.hint("merge"), "text_id")
    scored = similar_pairs(once, "ref", "text", floor)
    return scored.groupBy("text_id", "text").agg(
        F.max_by(
            F.struct(F.col("first.txn_id").alias("txn_id"), "similarity"),
            F.struct("similarity", (-F.col("first.src_pos")).alias("earlier")),
        ).alias("best")
    )


def _sharing_keys(needles: DataFrame, hays: DataFrame, needle: str, hay: str, floor: int, numbered: bool = False) -> DataFrame:
    """The pairs with a common block key, once for each key: (ref, text), or where ``numbered`` (ref_id, text_id)."""
    # distinct needle lengths: a handful, however many needles there are
    sizes = needles.select(F.collect_set(F.length(needle)).alias("sizes")).first().sizes
    lead = shared_lead(needles, needle) if any(several_parts(n, floor) for n in sizes) else 0
    # a short text has hundreds of keys, so the tasks that list them are dealt by rows, not by the bytes of the texts
    parts = int(needles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    suffix = "_id" if numbered else ""

    def keyed(rows: DataFrame, column: str, keys: Column) -> DataFrame:
        return rows.repartition(parts, column).select(column + suffix, F.explode(keys).alias("key"))

    left = keyed(needles, needle, needle_keys(needle, floor, lead))
    listed = "array(" + ", ".join(str(n) for n in sorted(sizes)) + ")"
    right = keyed(hays, hay, hay_keys(hay, listed, floor, lead))
    # the planner takes a list of keys for no larger than its texts and would broadcast it; sorted runs need no memory
    return left.hint("merge").join(right, "key").select("ref" + suffix, "text" + suffix)
