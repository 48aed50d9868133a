"""Nearest candidate per query inside a key group, without pairing queries and candidates.

The order is (days apart, amount apart, tie, position). A group may be arbitrarily large, so the
search walks sorted distinct values instead of pairs: first the nearest dates (a group has at most
as many as the calendar), then the nearest amounts below and above inside those dates. Amounts are
cut into blocks so that no window partition grows with the group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1000  # currency units per amount block


def nearest(queries: DataFrame, candidates: DataFrame, keys: list[str], tie: str, payload: str) -> DataFrame:
    """``queries``: keys, day, target. ``candidates``: keys, day, amount, src_pos, tie, payload.

    One row per distinct query whose key has a candidate: keys, day, target, row.
    """
    points = candidates.groupBy(*keys, F.col("day").alias("cday"), "amount").agg(
        F.min(F.struct(F.col(tie), F.col("src_pos"), F.col(payload))).alias("best")
    )
    asked = queries.select(*keys, "day", "target").distinct()

    # nearest dates
    marks = points.select(*keys, F.col("cday").alias("at"), F.col("cday"), F.lit(False).alias("asks")).distinct()
    marks = marks.unionByName(
        asked.select(*keys, F.col("day").alias("at"), F.lit(None).cast("date").alias("cday"), F.lit(True).alias("asks")).distinct()
    )
    by_date = Window.partitionBy(*keys).orderBy("at")
    up_to = by_date.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    onwards = by_date.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    found = marks.select(
        *keys,
        F.col("at").alias("day"),
        "asks",
        F.last("cday", ignorenulls=True).over(up_to).alias("before"),
        F.first("cday", ignorenulls=True).over(onwards).alias("after"),
    ).filter("asks")
    gap = F.least(F.datediff("day", "before"), F.datediff("after", "day"))
    dates = found.select(
        *keys,
        "day",
        F.explode(
            F.filter(
                F.array_distinct(F.array_compact(F.array("before", "after"))),
                lambda d: F.abs(F.datediff(d, F.col("day"))) == gap,
            )
        ).alias("cday"),
    )

    # nearest amounts below and above, within a block first, then across blocks
    wanted = asked.join(dates, [*keys, "day"])
    block = F.floor(F.col("at") / BLOCK)
    ticks = points.select(*keys, "cday", F.col("amount").alias("at"), "amount", F.lit(False).alias("asks"))
    ticks = ticks.unionByName(
        wanted.select(
            *keys,
            "cday",
            F.col("target").alias("at"),
            F.lit(None).cast(points.schema["amount"].dataType).alias("amount"),
            F.lit(True).alias("asks"),
        ).distinct()
    ).withColumn("block", block)
    inside = Window.partitionBy(*keys, "cday", "block").orderBy("at")
    local = ticks.select(
        *keys,
        "cday",
        "block",
        F.col("at").alias("target"),
        "asks",
        F.last("amount", ignorenulls=True)
        .over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        .alias("below"),
        F.first("amount", ignorenulls=True)
        .over(inside.rangeBetween(Window.currentRow, Window.unboundedFollowing))
        .alias("above"),
    ).filter("asks")
    across = Window.partitionBy(*keys, "cday").orderBy("block")
    blocks = (
        ticks.groupBy(*keys, "cday", "block")
        .agg(F.min("amount").alias("low"), F.max("amount").alias("high"))
        .select(
            *keys,
            "cday",
            "block",
            F.last("high", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("lower"),
            F.first("low", ignorenulls=True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("upper"),
        )
    )
    amounts = local.join(blocks, [*keys, "cday", "block"]).select(
        *keys,
        "cday",
        "target",
        F.explode(
            F.array_distinct(
                F.array_compact(F.array(F.coalesce("below", "lower"), F.coalesce("above", "upper")))
            )
        ).alias("amount"),
    )

    options = wanted.join(amounts, [*keys, "cday", "target"]).join(points, [*keys, "cday", "amount"])
    return (
        options.groupBy(*keys, "day", "target")
        .agg(
            F.min(
                F.struct(
                    F.abs(F.datediff("cday", "day")).alias("days"),
                    F.abs(F.col("amount") - F.col("target")).alias("apart"),
                    F.col("best"),
                )
            ).alias("win")
        )
        .select(*keys, "day", "target", F.col(f"win.best.{payload}").alias("row"))
    )
