"""A join to a one-row-per-key side that stays balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import stage

NULL_WAYS = 4096  # partitions that rows without a key are spread over; fixed, and the same plan at every size
SHORT_LIST = 100_000  # keys that are sent to every task instead of shuffling rows to them
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def prepare(spark) -> None:
    """Adaptive execution splits the partition of a hot key on the many-rows side; jobs rely on it."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)


def way_of(keys: list[str]) -> Column:
    """The way of every row that has its keys, -1, written so that the optimizer can't fold it away.

    A side grouped by its keys and this ``_way`` is already partitioned as ``lookup`` joins it and isn't shuffled again.
    """
    nothing = F.least(F.length(F.concat(*[F.col(k).cast("string") for k in keys])), F.lit(0))
    return (nothing - 1).cast("int")


def lookup(left: DataFrame, right: DataFrame, keys: list[str], spread: str, how: str = "left") -> DataFrame:
    """Join ``left`` to a ``right`` with at most one row per key."""
    return lookups(left, [right], keys, spread, how)


def lookups(left: DataFrame, rights: list[DataFrame], keys: list[str], spread: str, how: str = "left") -> DataFrame:
    """Join ``left`` to several ``rights`` by the same keys, each with at most one row per key; ``left`` is shuffled once.

    One shuffle of each side and one plan for every size. A row of ``left`` without a key finds nothing; such rows are
    dealt by ``spread`` (a column that varies within a key) instead of meeting in one task. The partition of a hot key
    is split by adaptive execution, which may do so because ``right`` has one row for it.
    """
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    dealt = left.withColumn(
        "_way", F.when(missing, F.pmod(F.xxhash64(spread), F.lit(NULL_WAYS))).otherwise(F.lit(-1)).cast("int")
    )
    # from the key, so that the optimizer doesn't fold it away; a side grouped by ``way_of`` its keys brings it along
    for right in rights:
        found = right if "_way" in right.columns else right.withColumn("_way", F.when(~missing, F.lit(-1)).cast("int"))
        dealt = dealt.join(found, [*keys, "_way"], how)
    return dealt.drop("_way")


def only(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` whose key is among ``wanted``. The list is written down first: a short one goes to every task and no row
    is shuffled for it, a longer one is joined as sorted runs and never broadcast."""
    listed = stage(wanted.select(*keys).distinct(), "wanted")
    few = listed.count() <= SHORT_LIST
    return rows.join(F.broadcast(listed) if few else listed.hint("merge"), keys, "left_semi")
