"""The candidates behind the kept one, as rows in rank order.

A group of bank rows is listed once for each different question asked of it, never once for each anchor: where all rows of
a group have one day and one amount their order is the same for every anchor, so the group is listed once. Else the order
depends on the anchor's day and net, and anchors that agree on both share a list. Ranks come from one range-partitioned
order of all lists, so a hot group is sorted by many tasks. What is listed is in proportion to (group rows) x (different
questions), which is 1 for uniform groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import config as C
from ledgerloom.operators.candidates import fuzzy_points, open_keys_of, scored_pairs
from ledgerloom.operators.ranking import global_rank
from ledgerloom.session import stage

_QUESTION = ["tier", "key", "ask_day", "ask_net"]


def _members(bank: DataFrame, column: str) -> DataFrame:
    return bank.filter(F.coalesce(F.col(column), F.lit("")) != "").select(
        F.col(column).alias("key"), "src_pos", "bank_ref", "amount", "day", F.coalesce("utr", F.lit("")).alias("tie")
    )


def _exact(anchors: DataFrame, bank: DataFrame, tier: str, key: str, column: str) -> DataFrame:
    """Rows of the groups that anchors of an exact tier ask, with each different question."""
    rows = _members(bank, column)
    shape = rows.groupBy("key").agg(
        ((F.min("day") == F.max("day")) & (F.min("amount") == F.max("amount"))).alias("uniform")
    )
    asked = anchors.filter(F.col("bank_match_type") == tier).select(F.col(key).alias("key"), "day", "expected_net")
    known = asked.join(shape, "key").select(
        "key",
        F.when(~F.col("uniform"), F.col("day")).alias("ask_day"),
        F.when(~F.col("uniform"), F.col("expected_net")).alias("ask_net"),
    )
    questions = known.groupBy("key", "ask_day", "ask_net").agg(F.count(F.lit(1)).alias("anchors"))
    return questions.join(rows, "key").withColumn("tier", F.lit(tier))


def _fuzzy(anchors: DataFrame, bank: DataFrame) -> DataFrame:
    """Rows behind the narrations that reach the floor, with each question (reference, net, day)."""
    mine = anchors.filter(F.col("bank_match_type") == "fuzzy")
    asked = stage(open_keys_of(mine), "rejected-asked")
    hits = scored_pairs(asked, stage(fuzzy_points(asked, bank, ()), "rejected-points"), (), C.FUZZY_MIN_SIMILARITY)
    count = mine.groupBy(F.coalesce("utr", F.lit("")).alias("ref"), "expected_net", "day").agg(
        F.count(F.lit(1)).alias("anchors")
    )
    rows = bank.select(
        F.coalesce("narration", F.lit("")).alias("text"),
        "amount",
        F.col("day").alias("bank_day"),
        "src_pos",
        "bank_ref",
        F.coalesce("utr", F.lit("")).alias("tie"),
    )
    named = hits.select("ref", "expected_net", "day", "text", "amount", "bank_day").join(count, ["ref", "expected_net", "day"])
    return named.join(rows, ["text", "amount", "bank_day"]).select(
        F.col("ref").alias("key"),
        F.col("day").alias("ask_day"),
        F.col("expected_net").alias("ask_net"),
        "anchors",
        "src_pos",
        "bank_ref",
        "amount",
        F.col("bank_day").alias("day"),
        "tie",
        F.lit("fuzzy").alias("tier"),
    )


def rejected_rows(decided: DataFrame, bank: DataFrame) -> DataFrame:
    """(tier, key, ask_day, ask_net, anchors, rank, bank_ref, src_pos): rank 1 is the first row after the kept one.

    ``decided`` has src_pos, txn_id, utr, day, expected_net, bank_match_type, bank_candidate_count. ``ask_day`` and
    ``ask_net`` are null where the order is the same for every anchor; ``anchors`` share the list.
    """
    several = decided.filter(F.col("bank_candidate_count") > 1)
    rows = (
        _exact(several, bank, "exact_utr", "utr", "utr")
        .unionByName(_exact(several, bank, "exact_txn", "txn_id", "txn_id"))
        .unionByName(_fuzzy(several, bank))
        .withColumn("days", F.coalesce(F.abs(F.datediff("day", "ask_day")), F.lit(0)))
        .withColumn("apart", F.coalesce(F.abs(F.col("amount") - F.col("ask_net")), F.lit(0)))
    )
    ranked = stage(global_rank(rows, [*_QUESTION, "days", "apart", "tie", "src_pos"], "place"), "rejected-ranked")
    kept = ranked.groupBy(*[F.col(c).alias(f"of_{c}") for c in _QUESTION]).agg(F.min("place").alias("kept"))
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in _QUESTION]
    return (
        ranked.join(kept, same)
        .filter(F.col("place") > F.col("kept"))
        .select(*_QUESTION, "anchors", (F.col("place") - F.col("kept")).alias("rank"), "bank_ref", "src_pos")
    )
