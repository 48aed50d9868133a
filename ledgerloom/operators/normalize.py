"""One shape for the three validated feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import money as M
from ledgerloom.functions import narration as N

_COMMON = ("source", "src_pos", "txn_id", "utr", "amount", "fee", "gst", "tds", "day")


def _extra(df: DataFrame, scope: tuple[str, ...]) -> list[Column]:
    return [F.col(c) for c in scope]


def normalize_pg(valid: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    gross, fee, gst, tds = (F.col(c) for c in ("gross_amount", "pg_fee", "gst_on_fee", "tds_withheld"))
    return valid.select(
        *_extra(valid, scope),
        F.lit("pg").alias("source"),
        "src_pos",
        "txn_id",
        "utr",
        gross.alias("amount"),
        fee.alias("fee"),
        gst.alias("gst"),
        tds.alias("tds"),
        F.to_date("timestamp").alias("day"),
        F.col("timestamp").alias("date_utc"),
        "merchant_id",
        "payment_method",
        F.col("merchant_ytd_gross_opening").alias("opening"),
        M.expected_net(gross, fee, gst, tds).alias("expected_net"),
        M.expected_invoice(fee, gst).alias("expected_invoice"),
    )


def normalize_bank(valid: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    none = F.lit(None).cast(M.AMOUNT)
    ref, text = F.col("bank_ref"), F.col("narration")
    return valid.select(
        *_extra(valid, scope),
        F.lit("bank").alias("source"),
        "src_pos",
        N.resolved_txn_id(ref, text).alias("txn_id"),
        "utr",
        F.col("credited_amount").alias("amount"),
        none.alias("fee"),
        none.alias("gst"),
        none.alias("tds"),
        F.col("value_date").alias("day"),
        F.col("value_date").cast("timestamp").alias("date_utc"),
        "bank_ref",
        "narration",
        N.link_method(ref, text).alias("link_method"),
    )


def normalize_invoice(valid: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    first = F.to_date(F.concat("period", F.lit("-01")))
    return valid.select(
        *_extra(valid, scope),
        F.lit("invoice").alias("source"),
        "src_pos",
        "txn_id",
        F.lit(None).cast("string").alias("utr"),
        F.col("invoice_amount").alias("amount"),
        (F.col("invoice_amount") - F.col("claimed_gst")).cast(M.AMOUNT).alias("fee"),
        F.col("claimed_gst").alias("gst"),
        F.col("claimed_tds").alias("tds"),
        first.alias("day"),
        first.cast("timestamp").alias("date_utc"),
        "invoice_id",
        "period",
    )


def normalized(pg: DataFrame, bank: DataFrame, invoice: DataFrame) -> DataFrame:
    """All rows of the three feeds in the universal shape (bag semantics)."""
    shape = (*_COMMON, "date_utc")
    return pg.select(*shape).unionByName(bank.select(*shape)).unionByName(invoice.select(*shape))


def linkage_report(pg: DataFrame, bank: DataFrame, invoice: DataFrame) -> DataFrame:
    """Rows per source and, for bank rows, per way of finding the transaction id."""
    tagged = (
        pg.select("source", F.lit("own_id").alias("link_method"))
        .unionByName(bank.select("source", "link_method"))
        .unionByName(invoice.select("source", F.lit("own_id").alias("link_method")))
    )
    return tagged.groupBy("source", "link_method").agg(F.count(F.lit(1)).alias("n"))


def drop_exact_copies(records: DataFrame) -> DataFrame:
    """Rows identical in every column collapse to one; partial aggregation removes copies map-side."""
    return records.dropDuplicates()
