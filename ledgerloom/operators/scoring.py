"""Score, signals and confidence of a selected pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import config as C
from ledgerloom.functions.money import date_points


def _points(matched: Column, points: int) -> Column:
    return F.when(matched, points).otherwise(0)


def _yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def with_score(matches: DataFrame) -> DataFrame:
    """Adds ``score``: total, normalised score, eight comparisons and their evidence."""
    has_bank, has_invoice = F.col("bank").isNotNull(), F.col("invoice").isNotNull()
    tolerance = F.lit(C.AMOUNT_TOLERANCE)
    bank_delta = F.abs(F.col("expected_net") - F.col("bank.amount"))
    bill_delta = F.abs(F.col("expected_invoice") - F.col("invoice.amount"))
    fee_delta = F.abs(F.coalesce("fee", F.lit(0)) - F.col("invoice.fee"))
    bank_days = F.abs(F.datediff("bank.day", "day"))
    bill_days = F.abs(F.datediff("invoice.day", "day"))

    parts = matches.select(
        "*",
        F.struct(
            _yes(F.col("bank.txn_id") == F.col("txn_id")).alias("txn_id_matched_bank"),
            _yes(F.col("invoice.txn_id") == F.col("txn_id")).alias("txn_id_matched_invoice"),
            _yes(bank_delta <= tolerance).alias("amount_matched_bank"),
            _yes(bill_delta <= tolerance).alias("amount_matched_invoice"),
            _yes(bank_days <= C.DATE_TOLERANCE_DAYS).alias("date_matched_bank"),
            _yes(bill_days <= C.DATE_TOLERANCE_DAYS).alias("date_matched_invoice"),
            _yes((F.col("utr") != "") & (F.col("utr") == F.col("bank.utr"))).alias("utr_matched"),
            _yes(fee_delta <= tolerance).alias("fee_consistent"),
            has_bank.alias("bank_present"),
            has_invoice.alias("invoice_present"),
            bank_delta.alias("bank_amount_delta"),
            bill_delta.alias("invoice_amount_delta"),
            fee_delta.alias("fee_delta"),
            bank_days.alias("bank_delta_days"),
            bill_days.alias("invoice_delta_days"),
            F.greatest(
                F.coalesce(date_points(bank_days), F.lit(0)), F.coalesce(date_points(bill_days), F.lit(0))
            ).alias("date_points"),
        ).alias("s"),
    )
    total = (
        _points(F.col("s.txn_id_matched_bank"), C.SCORE_TXN_ID_BANK)
        + _points(F.col("s.txn_id_matched_invoice"), C.SCORE_TXN_ID_INVOICE)
        + _points(F.col("s.amount_matched_bank"), C.SCORE_AMOUNT_BANK)
        + _points(F.col("s.amount_matched_invoice"), C.SCORE_AMOUNT_INVOICE)
        + F.col("s.date_points")
        + _points(F.col("s.utr_matched"), C.SCORE_UTR_EXACT)
        + _points(F.col("s.fee_consistent"), C.SCORE_FEE_EXACT)
    )
    ceiling = (
        _points(has_bank, C.SCORE_TXN_ID_BANK + C.SCORE_AMOUNT_BANK + C.SCORE_UTR_EXACT)
        + _points(has_invoice, C.SCORE_TXN_ID_INVOICE + C.SCORE_AMOUNT_INVOICE + C.SCORE_FEE_EXACT)
        + _points(has_bank | has_invoice, C.SCORE_DATE_PROXIMITY)
    )
    scored = parts.withColumn("_total", total.cast("int")).withColumn("_ceiling", ceiling.cast("int"))
    normalised = F.when(F.col("_ceiling") == 0, 0).otherwise(
        F.round(F.col("_total") * 100 / F.col("_ceiling"), 0).cast("int")
    )
    return scored.select(
        *matches.columns,
        F.struct(
            F.col("_total").alias("total_score"),
            F.col("_ceiling").alias("max_achievable"),
            normalised.alias("normalized_score"),
            F.col("s.*"),
        ).alias("score"),
    )


def signals(matches: DataFrame) -> DataFrame:
    """Per comparison: both values, delta, verdict and points. Absent sources give null structs."""
    s = F.col("score")
    has_bank, has_invoice = s["bank_present"], s["invoice_present"]

    def text(name: str) -> Column:
        return F.col(name).cast("string")

    def verdict(flag: str, points: int) -> list[Column]:
        return [s[flag].alias("matched"), _points(s[flag], points).alias("points_awarded")]

    return matches.select(
        "*",
        F.struct(
            (~has_bank).alias("missing_bank"),
            (~has_invoice).alias("missing_invoice"),
            F.when(
                has_bank,
                F.struct(
                    F.col("txn_id").alias("pg"),
                    F.col("bank.txn_id").alias("bank"),
                    *verdict("txn_id_matched_bank", C.SCORE_TXN_ID_BANK),
                ),
            ).alias("txn_id_bank"),
            F.when(
                has_invoice,
                F.struct(
                    F.col("txn_id").alias("pg"),
                    F.col("invoice.txn_id").alias("invoice"),
                    *verdict("txn_id_matched_invoice", C.SCORE_TXN_ID_INVOICE),
                ),
            ).alias("txn_id_invoice"),
            F.when(
                has_bank,
                F.struct(
                    text("expected_net").alias("pg_expected_net"),
                    text("bank.amount").alias("bank_amount"),
                    s["bank_amount_delta"].cast("string").alias("delta"),
                    *verdict("amount_matched_bank", C.SCORE_AMOUNT_BANK),
                ),
            ).alias("amount_bank"),
            F.when(
                has_invoice,
                F.struct(
                    text("expected_invoice").alias("pg_expected_fee_plus_gst"),
                    text("invoice.amount").alias("invoice_amount"),
                    s["invoice_amount_delta"].cast("string").alias("delta"),
                    *verdict("amount_matched_invoice", C.SCORE_AMOUNT_INVOICE),
                ),
            ).alias("amount_invoice"),
            F.when(
                has_bank,
                F.struct(
                    s["bank_delta_days"].alias("delta_days"),
                    s["date_matched_bank"].alias("matched"),
                    date_points(s["bank_delta_days"]).alias("points_if_used"),
                ),
            ).alias("date_bank"),
            F.when(
                has_invoice,
                F.struct(
                    s["invoice_delta_days"].alias("delta_days"),
                    s["date_matched_invoice"].alias("matched"),
                    date_points(s["invoice_delta_days"]).alias("points_if_used"),
                ),
            ).alias("date_invoice"),
            s["date_points"].alias("date_points_awarded"),
            F.when(
                has_bank,
                F.struct(
                    F.col("utr").alias("pg"), F.col("bank.utr").alias("bank"), *verdict("utr_matched", C.SCORE_UTR_EXACT)
                ),
            ).alias("utr"),
            F.when(
                has_invoice,
                F.struct(
                    text("fee").alias("pg_fee"),
                    text("invoice.fee").alias("invoice_fee"),
                    s["fee_delta"].cast("string").alias("delta"),
                    *verdict("fee_consistent", C.SCORE_FEE_EXACT),
                ),
            ).alias("fee_consistency"),
        ).alias("signals"),
    )


def confidence_tier(normalised: Column, any_txn: Column) -> Column:
    return (
        F.when(normalised >= C.CONFIDENCE_HIGH, "HIGH")
        .when(normalised >= C.CONFIDENCE_MEDIUM, F.when(any_txn, "MEDIUM").otherwise("LOW"))
        .when(normalised >= C.CONFIDENCE_LOW, "LOW")
        .otherwise("NO_MATCH")
    )


def auto_matchable(tier: Column) -> Column:
    return tier.isin("HIGH", "MEDIUM")


def score_out_of_range(matches: DataFrame) -> DataFrame:
    """Rows whose score leaves 0..100. Must be empty."""
    return matches.filter(~F.col("score.total_score").between(0, 100))
