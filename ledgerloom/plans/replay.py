"""Labelled cases replayed in isolation: one distributed run with the case in every key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.narration import ref_txn_id
from ledgerloom.operators.attribution import attribute_bank_rows
from ledgerloom.operators.ranking import global_rank
from ledgerloom.operators.skew import lookup
from ledgerloom.plans.gold import FROZEN_FIELDS, compare_records, decision_record
from ledgerloom.plans.pipeline import batch_from_raw
from ledgerloom.plans.quality import native_rows
from ledgerloom.session import stage
from ledgerloom.sources.ingest import from_table

# Categories whose rows are rejected by design.
CORRUPTED = ("corrupted",)
# What a decision rests on, as a frozen record holds it.
EVIDENCE = ("bank_match_type", "bank_candidate_count", "invoice_candidate_count", "bank_ambiguity_count", "tax_verified")


def cases(labels: DataFrame) -> DataFrame:
    """Labels numbered in transaction order, ``E2E_001`` onwards."""
    ranked = global_rank(labels, ["txn_id"], "case_no")
    digits = F.col("case_no").cast("string")
    padded = F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits)
    return stage(ranked.withColumn("case_id", F.concat(F.lit("E2E_"), padded)), "cases")


def _listed(rows: DataFrame) -> DataFrame:
    """Rows as many as the cases, joined as sorted runs: their files are sorted and compress more than a hundredfold, so
    the planner would take them for short and send them through the driver to every task."""
    return rows.hint("merge")


def case_rows(case_list: DataFrame, pg: DataFrame, bank: DataFrame, invoice: DataFrame) -> DataFrame:
    """Every feed row with the case it belongs to: (case_id, source, src_pos, txn_id).

    A case stays a set of rows under one key; it is never folded into one nested value.
    """
    key = _listed(case_list.select("txn_id", "case_id"))

    def tagged(rows: DataFrame, source: str) -> DataFrame:
        return lookup(rows.select("txn_id", "src_pos"), key, ["txn_id"], "src_pos", "inner").select(
            "case_id", F.lit(source).alias("source"), "src_pos", "txn_id"
        )

    return reduce(DataFrame.unionByName, [tagged(pg, "pg"), tagged(bank, "bank"), tagged(invoice, "invoice")])


def case_table(case_list: DataFrame, rows: DataFrame) -> DataFrame:
    """One line per case: expected decision and how many rows of each feed it holds."""
    counts = rows.groupBy("case_id").agg(
        *[F.count_if(F.col("source") == s).alias(f"{s}_rows") for s in ("pg", "bank", "invoice")]
    )
    return case_list.join(_listed(counts), "case_id", "left").fillna(0, ["pg_rows", "bank_rows", "invoice_rows"])


def replay_cases(
    feeds: dict[str, DataFrame], case_list: DataFrame, owned_bank: DataFrame
) -> DataFrame:
    """The pipeline over every case at once, each seeing only its own rows.

    ``feeds``: tables of strings with src_pos. A rejected corrupted case closes as UNMATCHED /
    CORRUPTED_RECORD with no confidence; any other rejection is an error outcome.
    """
    key = _listed(case_list.select("txn_id", "case_id"))
    raw = {}
    for source, rows in (("pg", feeds["pg"]), ("bank", owned_bank), ("invoice", feeds["invoice"])):
        mine = lookup(rows, key, ["txn_id"], "src_pos", "inner")
        raw[source] = from_table(mine, source, scope=("case_id",))
    batch = batch_from_raw(raw, scope=("case_id",))
    decided = batch.decided().select(
        "case_id",
        F.col("txn_id").alias("decided_txn"),
        "status",
        "exception_code",
        "reason_codes",
        "confidence_score",
        F.col("sources_present").alias("matched_sources"),
        F.struct(*EVIDENCE).alias("evidence"),
    )
    refused = batch.rejects.groupBy("case_id").agg(F.count(F.lit(1)).alias("rejected"))
    joined = (
        case_list.select("case_id", "txn_id", "category", "expected_status", "expected_exception_code")
        .join(_listed(refused), "case_id", "left")
        .join(_listed(decided), "case_id", "left")
    )
    closed = F.col("rejected") > 0
    corrupted = closed & F.col("category").isin(*CORRUPTED)
    none = F.lit(None)

    def pick(when_corrupted: Column, otherwise: str) -> Column:
        return F.when(corrupted, when_corrupted).when(closed, none).otherwise(F.col(otherwise))

    return joined.select(
        "case_id",
        "txn_id",
        "category",
        "expected_status",
        "expected_exception_code",
        F.coalesce("rejected", F.lit(0)).cast("bigint").alias("ingestion_errors"),
        pick(F.lit("UNMATCHED"), "status").alias("status"),
        pick(F.lit("CORRUPTED_RECORD"), "exception_code").alias("exception_code"),
        pick(F.array(F.lit("CORRUPTED_RECORD")), "reason_codes").alias("reason_codes"),
        pick(F.lit(0), "confidence_score").alias("confidence_score"),
        F.when(closed & ~corrupted, "ERROR").otherwise("EXECUTED").alias("outcome"),
        F.when(~closed | F.col("rejected").isNull(), F.col("matched_sources")).alias("matched_sources"),
        F.when(~closed | F.col("rejected").isNull(), F.col("evidence")).alias("evidence"),
    )


def _label_record() -> Column:
    """The label of a case as a frozen record: transaction, status and code."""
    return decision_record(
        F.col("txn_id"), F.col("expected_status").alias("status"), F.col("expected_exception_code").alias("exception_code")
    )


def frozen_labels(case_list: DataFrame) -> DataFrame:
    return case_list.select("case_id", "category", _label_record().alias("document"))


def frozen_decisions(case_list: DataFrame, decided: DataFrame) -> DataFrame:
    """The decision that a whole batch gave each case, all six fields; a case without one freezes its label's."""
    rows = decided.select(
        "txn_id",
        decision_record(
            F.col("txn_id"),
            F.col("status"),
            F.col("exception_code"),
            F.col("sources_present").alias("matched_sources"),
            F.col("reason_codes"),
            F.struct(*EVIDENCE).alias("evidence"),
        ).alias("decision"),
    )
    labelled = case_list.select("case_id", "txn_id", "category", _label_record().alias("label"))
    return labelled.join(_listed(rows), "txn_id", "left").select(
        "case_id", "category", F.coalesce("decision", "label").alias("document")
    )


def replayed_records(replayed: DataFrame) -> DataFrame:
    """The replayed decision of each case as a record; a case that ended in an error has none."""
    fields = [F.col(f) for f in FROZEN_FIELDS]
    return replayed.filter(F.col("status").isNotNull()).select("case_id", decision_record(*fields).alias("document"))


def gold_comparison(replayed: DataFrame) -> DataFrame:
    """Replayed decisions against their labels."""
    compared = compare_records(frozen_labels(replayed), replayed_records(replayed))
    return compared.join(_listed(replayed.select("case_id", "txn_id")), "case_id").select(
        "case_id", "txn_id", "category", "comparison", F.transform("differences", lambda d: d.field).alias("differences")
    )
