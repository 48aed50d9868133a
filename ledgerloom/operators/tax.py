"""GST and TDS verification. Two independent controls over exact decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import config as C
from ledgerloom.functions.money import MONEY, gst_on, tds_on, zero_if_absent


def seller_gross_after(opening: Column, gross: Column) -> Column:
    """Cumulative gross including this settlement, from its own opening balance; null if that is absent.

    Deliberately per row: no running total over batch order.
    """
    return opening + gross


def gst_check(fee: Column, claimed: Column, present: Column) -> Column:
    """Expected GST on the fee against the invoice's claim; no invoice leaves it unverified."""
    expected = gst_on(zero_if_absent(fee))
    stated = F.when(present, zero_if_absent(claimed))
    delta = F.abs(expected - stated)
    return F.struct(
        expected.alias("expected"),
        stated.alias("claimed"),
        delta.alias("delta"),
        F.coalesce(delta <= F.lit(C.TAX_TOLERANCE), F.lit(False)).alias("verified"),
    )


def tds_check(gross: Column, cumulative: Column, claimed: Column, present: Column) -> Column:
    """Expected TDS above the annual threshold; an unknown cumulative gross is never assumed."""
    known = cumulative.isNotNull()
    expected = F.coalesce(tds_on(gross, cumulative), F.lit(0).cast(MONEY))
    stated = F.when(known & present, zero_if_absent(claimed))
    delta = F.abs(expected - stated)
    return F.struct(
        (cumulative > F.lit(C.TDS_ANNUAL_THRESHOLD)).alias("applicable"),
        expected.alias("expected"),
        stated.alias("claimed"),
        delta.alias("delta"),
        F.coalesce(delta <= F.lit(C.TAX_TOLERANCE), F.lit(False)).alias("verified"),
    )


def with_tax(matches: DataFrame) -> DataFrame:
    """Adds ``seller_gross`` and ``tax`` (gst, tds, fully_verified) to match rows."""
    present = F.col("invoice").isNotNull()
    staged = matches.withColumn("seller_gross", seller_gross_after(F.col("opening"), F.col("amount")))
    checked = staged.withColumn(
        "tax",
        F.struct(
            gst_check(F.col("fee"), F.col("invoice.gst"), present).alias("gst"),
            tds_check(F.col("amount"), F.col("seller_gross"), F.col("invoice.tds"), present).alias("tds"),
        ),
    )
    return checked.withColumn(
        "tax",
        F.col("tax").withField("fully_verified", F.col("tax.gst.verified") & F.col("tax.tds.verified")),
    )

