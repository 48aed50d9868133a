"""Global positions without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import stage


def global_rank(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Dense 1..N by ``order``, which should identify a row.

    Rows are range-partitioned on the full order, so partitions follow it and stay even whatever one
    leading value holds; a rank is the rows before its partition plus the position inside it. The
    partition of a row is written down once, so a re-run task cannot move rows between partitions.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    fixed = stage(ranged, name)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        fixed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    # ``before`` has one row per shuffle partition
    return (
        fixed.withColumn("_inside", inside)
        .join(F.broadcast(before), "_part")
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_part", "_inside", "_before")
    )
