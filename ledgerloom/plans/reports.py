"""Batch reports over decided rows. Each is one pass and a small result, or a filtered projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import config as C
from ledgerloom.functions.money import MONEY, money, money_text
from ledgerloom.operators.ranking import global_rank
from ledgerloom.operators.skew import lookup



def percent(part: Column, whole: Column, digits: int) -> Column:
    """Share in percent; zero for an empty whole."""
    exact = part.cast("decimal(30,6)") * 100 / whole.cast("decimal(30,6)")
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(exact, digits).cast("double"))


def match_rate(decided: DataFrame) -> DataFrame:
    counts = decided.agg(F.count("*").alias("total_records"), F.count_if(F.col("status") == "MATCHED").alias("matched"))
    return counts.select(
        "total_records",
        "matched",
        percent(F.col("matched"), F.col("total_records"), 2).alias("match_rate_pct"),
        (F.col("total_records") - F.col("matched")).alias("unresolved"),
    )


def by_status(decided: DataFrame) -> DataFrame:
    return decided.groupBy("status").agg(F.count("*").alias("n"))


def by_tier(decided: DataFrame) -> DataFrame:
    return decided.groupBy("confidence").agg(F.count("*").alias("n"))


def tier_mix(decided: DataFrame) -> DataFrame:
    return decided.groupBy("bank_match_type").agg(F.count("*").alias("n"))


def status_table(decided: DataFrame) -> DataFrame:
    """Every status in its fixed order, zero where absent: one pass of conditional counts."""
    counts = decided.agg(*[F.count_if(F.col("status") == s).alias(s) for s in C.STATUSES])
    lines = F.array(
        *[F.struct(F.lit(i).alias("position"), F.lit(s).alias("status"), F.col(s).alias("n")) for i, s in enumerate(C.STATUSES)]
    )
    return counts.select(F.explode(lines).alias("x")).select("x.*")


def cash_bucket(status: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, bucket in C.CASH_BUCKET_BY_STATUS.items():
        out = F.when(status == name, bucket).otherwise(out)
    return out


def cash_position(decided: DataFrame, rejects: DataFrame) -> DataFrame:
    """Expected net and records per bucket, batch totals, and rejected rows as a count only.

    A rejected row has no known value, so its line carries no amount.
    """
    bucket = cash_bucket(F.col("status"))
    zero = F.lit(0).cast(MONEY)
    per_bucket = []
    for name in C.CASH_BUCKETS:
        amount = F.coalesce(F.sum(F.when(bucket == name, F.col("expected_net"))), zero)
        per_bucket += [amount.alias(f"{name}_amount"), F.count_if(bucket == name).alias(f"{name}_n")]
    totals = decided.agg(
        *per_bucket,
        F.coalesce(F.sum("expected_net"), zero).alias("expected"),
        F.coalesce(F.sum("bank.amount"), zero).alias("credited"),
        F.count("*").alias("n"),
        F.count("bank").alias("with_bank"),
    )

    def line(name: str, amount: Column, n: Column) -> Column:
        return F.struct(
            F.lit(name).alias("line"),
            money(amount).cast("decimal(28,2)").alias("amount"),
            n.cast("bigint").alias("records"),
        )

    lines = F.array(
        *[line(b, F.col(f"{b}_amount"), F.col(f"{b}_n")) for b in C.CASH_BUCKETS],
        line("total_expected_settlement", F.col("expected"), F.col("n")),
        line("total_bank_credited", F.col("credited"), F.col("with_bank")),
        line("variance_vs_bank_credited", F.col("expected") - F.col("credited"), F.col("n")),
    )
    refused = rejects.agg(
        F.lit("records_rejected_at_ingestion").alias("line"),
        F.lit(None).cast("decimal(28,2)").alias("amount"),
        F.count("*").alias("records"),
    )
    return totals.select(F.explode(lines).alias("x")).select("x.*").unionByName(refused)


def blocked_share(decided: DataFrame) -> DataFrame:
    blocked = cash_bucket(F.col("status")) == "blocked_in_exceptions"
    return decided.agg(
        F.sum(F.when(blocked, F.col("expected_net"))).alias("blocked"), F.sum("expected_net").alias("expected")
    ).select(percent(F.coalesce("blocked", F.lit(0)), F.coalesce("expected", F.lit(0)), 1).alias("blocked_pct"))


# --- exceptions ------------------------------------------------------------------------------


def dossier_columns() -> list[Column]:
    """Money, dates and identifiers of a case. Absent is null, never zero."""
    variance = F.col("expected_net") - F.col("bank.amount")
    return [
        money_text(F.col("expected_net")).alias("expected_net"),
        money_text(F.col("bank.amount")).alias("observed_amount"),
        money_text(variance).alias("variance"),
        F.col("day").alias("pg_date"),
        F.col("bank.day").alias("bank_date"),
        F.col("utr"),
        F.col("bank.bank_ref").alias("bank_ref"),
        F.col("invoice.invoice_id").alias("invoice_id"),
        F.lit("pg").alias("expected_net_from"),
        F.when(F.col("bank").isNotNull(), "bank").alias("observed_amount_from"),
        F.when(F.col("bank").isNotNull(), "derived: expected_net - observed_amount").alias("variance_from"),
    ]


def case_dossier(decided: DataFrame) -> DataFrame:
    return decided.select("txn_id", *dossier_columns())


def exceptions(decided: DataFrame, status: str | None = None) -> DataFrame:
    """Every decision that is not MATCHED, complete. An unknown status is an error, not an empty answer."""
    if status is not None and status not in C.STATUSES:
        raise ValueError(f"Unknown status {status!r}. Valid: {sorted(C.STATUSES)}")
    rows = decided.filter(F.col("status") != "MATCHED")
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    return rows.select(
        "txn_id",
        "status",
        "exception_code",
        "reason_codes",
        "confidence_score",
        F.col("confidence").alias("confidence_tier"),
        F.col("sources_present").alias("matched_sources"),
        "tax_verified",
        "policy_priority",
        "matched_rule",
        F.format_string(
            "policy priority %d (%s), confidence %d",
            F.col("policy_priority"),
            F.col("matched_rule"),
            F.col("confidence_score"),
        ).alias("triage_basis"),
        *dossier_columns(),
    )


def triage_rank(open_cases: DataFrame) -> DataFrame:
    """Dense 1..N: most severe policy priority first, then weakest evidence, then txn_id."""
    return global_rank(open_cases, ["policy_priority", "confidence_score", "txn_id"], "triage_rank")


def evidence_of(evidence: DataFrame, txn_id: str) -> DataFrame:
    """The audit trail of one decision. An id outside the batch is a distinct error."""
    found = evidence.filter(F.col("txn_id") == txn_id)
    if found.isEmpty():
        raise LookupError(f"No transaction {txn_id!r} in the current batch.")
    return found


def multi_violation(decided: DataFrame) -> DataFrame:
    return decided.filter(F.size("reason_codes") > 1).select("txn_id", "status", "exception_code", "reason_codes")


def batch_summary(decided: DataFrame) -> DataFrame:
    """The machine-readable summary as lines: totals, per status, and every open decision."""
    totals = decided.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "MATCHED").alias("m")).select(
        F.lit("totals").alias("section"),
        F.lit("batch").alias("key"),
        F.to_json(F.struct(F.col("n").alias("total"), F.col("m").alias("matched"))).alias("document"),
    )
    statuses = by_status(decided).select(
        F.lit("by_status").alias("section"), F.col("status").alias("key"), F.to_json(F.struct("n")).alias("document")
    )
    open_rows = decided.filter(F.col("status") != "MATCHED").select(
        F.lit("exception").alias("section"),
        F.col("txn_id").alias("key"),
        F.to_json(
            F.struct("status", "exception_code", "reason_codes", "confidence_score", "matched_rule")
        ).alias("document"),
    )
    return reduce(DataFrame.unionByName, [totals, statuses, open_rows])


# --- bank completeness -----------------------------------------------------------------------


def bank_completeness(bank: DataFrame, decided: DataFrame) -> DataFrame:
    """What became of each bank row: selected, second leg of a claimed transaction, or claimed by nothing."""
    chosen = decided.filter(F.col("bank").isNotNull())
    refs = chosen.select(F.col("bank.bank_ref").alias("bank_ref")).distinct().withColumn("picked", F.lit(True))
    txns = (
        chosen.select(F.col("bank.txn_id").alias("txn_id"))
        .filter(F.col("txn_id").isNotNull())
        .distinct()
        .withColumn("claimed", F.lit(True))
    )
    rows = bank.select("src_pos", "bank_ref", "txn_id", "amount", "utr", "narration")
    rows = lookup(rows, refs, ["bank_ref"], "src_pos")
    rows = lookup(rows, txns, ["txn_id"], "src_pos")
    return rows.select(
        "bank_ref",
        F.when(F.col("picked"), "SELECTED").when(F.col("claimed"), "DUPLICATE_CREDIT").otherwise("ORPHANED").alias("disposition"),
        F.col("txn_id").alias("resolved_txn_id"),
        money(F.col("amount")).alias("amount"),
        "utr",
        "narration",
    )


def completeness_totals(accounts: DataFrame) -> DataFrame:
    kind = F.col("disposition")
    per_ref = accounts.groupBy("bank_ref").agg(
        F.count("*").alias("rows"),
        F.count_if(kind == "SELECTED").alias("selected"),
        F.count_if(kind == "DUPLICATE_CREDIT").alias("duplicate_credits"),
        F.count_if(kind == "ORPHANED").alias("orphaned"),
        F.sum(F.when(kind == "ORPHANED", F.col("amount"))).alias("value"),
    )
    return per_ref.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_bank_rows"),
        F.coalesce(F.sum("selected"), F.lit(0)).alias("selected"),
        F.coalesce(F.sum("duplicate_credits"), F.lit(0)).alias("duplicate_credits"),
        F.coalesce(F.sum("orphaned"), F.lit(0)).alias("orphaned"),
        F.coalesce(F.sum("value"), F.lit(0)).cast("decimal(28,2)").alias("orphaned_value"),
        (F.count("*") == F.coalesce(F.sum("rows"), F.lit(0))).alias("is_complete"),
    )


def orphans(accounts: DataFrame) -> DataFrame:
    return accounts.filter(F.col("disposition") == "ORPHANED").select("bank_ref", "resolved_txn_id", "amount")
