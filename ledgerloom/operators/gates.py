"""The amount-and-date gate as an equi-join.

``|net - amount| <= 0.01`` and ``|day - day| <= 3`` become an equality on (paise, week): the query
side looks at three paise values and the one or two weeks its window touches, every point sits in
exactly one cell, so no pair repeats. The exact predicates then decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import config as C
from ledgerloom.functions.money import within_amount, within_days

WEEK = 7


def paise(amount: Column) -> Column:
    return F.floor(amount * 100).cast("bigint")


def week(day: Column) -> Column:
    return F.floor(F.unix_date(day) / WEEK).cast("int")


def query_cells(queries: DataFrame, net: str = "expected_net", day: str = "day") -> DataFrame:
    """Each query once per cell its window touches."""
    k = paise(F.col(net))
    first = week(F.date_sub(day, C.DATE_TOLERANCE_DAYS))
    last = week(F.date_add(day, C.DATE_TOLERANCE_DAYS))
    return queries.withColumn("_paise", F.explode(F.sequence(k - 1, k + 1))).withColumn(
        "_week", F.explode(F.array_distinct(F.array(first, last)))
    )


def point_cells(points: DataFrame, amount: str = "amount", day: str = "bank_day") -> DataFrame:
    return points.withColumn("_paise", paise(F.col(amount))).withColumn("_week", week(F.col(day)))


def in_gate(net: Column, day: Column, amount: Column, other: Column) -> Column:
    return within_amount(net, amount) & within_days(day, other)


def gate_join(queries: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct queries (keys, expected_net, day) with the distinct points (keys, amount, bank_day) they admit.

    Both sides are grouped beforehand, so a cell holds at most its distinct days and sub-paise amounts.
    """
    cells = query_cells(queries).join(point_cells(points), [*keys, "_paise", "_week"])
    return cells.filter(
        in_gate(F.col("expected_net"), F.col("day"), F.col("amount"), F.col("bank_day"))
    ).drop("_paise", "_week")
