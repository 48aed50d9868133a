"""Verdicts on the bank rows near an anchor's amount, as counts.

A row within the amount tolerance is SKIPPED if it carries the anchor's transaction id, EVIDENCE if its date is in the window
too, else REJECTED. Rows are summed up by amount, by (amount, day) and by (id, amount, day) before anything is joined; a
question meets the few amounts of three paise cells, and the four counts come from inclusion and exclusion. Neither
rows nor pairs are listed, however many rows share an amount or an id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import within_amount, within_days
from ledgerloom.operators.candidates import gate_totals, with_keys
from ledgerloom.operators.gates import paise
from ledgerloom.operators.skew import lookup


def _cells(questions: DataFrame) -> DataFrame:
    k = paise(F.col("expected_net"))
    return questions.withColumn("_paise", F.explode(F.sequence(k - 1, k + 1)))


def amount_totals(pg: DataFrame, bank: DataFrame) -> DataFrame:
    """(expected_net, near): bank rows within the amount tolerance of each distinct net, at any date."""
    points = bank.groupBy("amount").agg(F.count(F.lit(1)).alias("n")).withColumn("_paise", paise(F.col("amount")))
    met = _cells(pg.select("expected_net").distinct()).join(points, "_paise")
    near = met.filter(within_amount(F.col("expected_net"), F.col("amount")))
    return near.groupBy("expected_net").agg(F.sum("n").alias("near"))


def own_totals(pg: DataFrame, bank: DataFrame) -> DataFrame:
    """(txn_key, expected_net, day, own, own_dated): those of them that carry the anchor's id, at any date and in the window."""
    named = bank.withColumn("txn_key", F.nullif("txn_id", F.lit(""))).filter("txn_key is not null")
    points = (
        named.groupBy("txn_key", "amount", F.col("day").alias("bank_day"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("_paise", paise(F.col("amount")))
    )
    asked = pg.filter("txn_key is not null").select("txn_key", "expected_net", "day").distinct()
    met = _cells(asked).join(points, ["txn_key", "_paise"])
    near = met.filter(within_amount(F.col("expected_net"), F.col("amount")))
    dated = within_days(F.col("day"), F.col("bank_day"))
    return near.groupBy("txn_key", "expected_net", "day").agg(
        F.sum("n").alias("own"), F.sum(F.when(dated, F.col("n")).otherwise(0)).alias("own_dated")
    )


def near_verdicts(pg: DataFrame, bank: DataFrame) -> DataFrame:
    """(src_pos, txn_id, near_rows, skipped_rows, evidence_rows, rejected_rows) of every anchor."""
    anchors = with_keys(pg)
    rows = lookup(anchors, amount_totals(anchors, bank), ["expected_net"], "src_pos")
    rows = lookup(rows, gate_totals(pg, bank), ["expected_net", "day"], "src_pos")
    rows = lookup(rows, own_totals(anchors, bank), ["txn_key", "expected_net", "day"], "src_pos")
    near, dated, own, own_dated = (F.coalesce(c, F.lit(0)) for c in ("near", "in_gate", "own", "own_dated"))
    return rows.select(
        "src_pos",
        "txn_id",
        near.alias("near_rows"),
        own.alias("skipped_rows"),
        (dated - own_dated).alias("evidence_rows"),
        (near - dated - (own - own_dated)).alias("rejected_rows"),
    )
