"""Exact decimal expressions. Money never becomes a double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom import config as C

AMOUNT = "decimal(18,4)"
MONEY = "decimal(18,2)"


def money(value: Column) -> Column:
    """Two decimal places, half up."""
    return F.round(value, 2).cast(MONEY)


def zero_if_absent(value: Column) -> Column:
    return F.coalesce(value, F.lit(0).cast(AMOUNT))


def expected_net(gross: Column, fee: Column, gst: Column, tds: Column) -> Column:
    """What the bank should credit: gross less fee, GST on the fee and TDS. Unrounded."""
    parts = zero_if_absent(fee) + zero_if_absent(gst) + zero_if_absent(tds)
    return (gross - parts).cast(AMOUNT)


def expected_invoice(fee: Column, gst: Column) -> Column:
    """What the gateway should invoice: its fee plus GST on the fee."""
    return (zero_if_absent(fee) + zero_if_absent(gst)).cast(AMOUNT)


def within_amount(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.lit(C.AMOUNT_TOLERANCE)


def within_days(a: Column, b: Column, days: int = C.DATE_TOLERANCE_DAYS) -> Column:
    return F.abs(F.datediff(a, b)) <= days


def money_text(value: Column) -> Column:
    """Quantised string; null stays null."""
    return money(value).cast("string")


def mdr_fee(gross: Column, method: Column) -> Column:
    """Gateway fee by payment method; an unknown method has no rate."""
    rate = F.lit(None).cast("decimal(6,4)")
    for name, value in C.MDR_BY_METHOD.items():
        rate = F.when(method == name, F.lit(value).cast("decimal(6,4)")).otherwise(rate)
    return money(gross * rate)


def gst_on(fee: Column) -> Column:
    return money(fee * F.lit(C.GST_RATE_ON_FEE))


def tds_on(gross: Column, cumulative: Column) -> Column:
    """TDS on gross once the seller's cumulative gross is strictly above the annual threshold."""
    due = money(gross * F.lit(C.TDS_RATE))
    return F.when(cumulative > F.lit(C.TDS_ANNUAL_THRESHOLD), due).otherwise(F.lit(0).cast(MONEY))


def date_points(delta_days: Column) -> Column:
    return F.when(delta_days > C.DATE_TOLERANCE_DAYS, 0).otherwise(C.SCORE_DATE_PROXIMITY - delta_days)
