"""Exact order statistics without sorting the rows.

Each asked rank keeps an open interval of values that holds it. A pass proposes two values of that interval close to the
rank (an approximate quantile, error ``1 / ACCURACY``) and counts the rows below, at and between them exactly; the
counts say which part holds the rank, so the approximation decides only how fast the interval shrinks, by a factor of
some thousands a pass. An interval of at most ``SMALL`` rows is grouped by value and read off. Only counts travel; what
reaches the driver has a fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of a proposal, and the rows of an interval that are grouped by value in one go.
ACCURACY, SMALL = 10_000, 50_000


@dataclass
class _Search:
    """Rank ``left`` (from 1) among the ``rows`` values strictly between ``low`` and ``high`` (None: no bound)."""

    left: int
    rows: int
    low: object = None
    high: object = None
    value: object = None

    def inside(self, c: Column) -> Column:
        out = F.lit(True)
        if self.low is not None:
            out = out & (c > F.lit(self.low))
        if self.high is not None:
            out = out & (c < F.lit(self.high))
        return out


def order_statistics(rows: DataFrame, column: str, ranks: list[int], small: int = SMALL, accuracy: int = ACCURACY) -> list:
    """Values of ``column`` at ``ranks`` (from 1, equal values counted as often as they occur) in ascending order.

    Nulls take no part; a rank outside 1..n has no value (None). ``rows`` is read once a pass: stage it.
    """
    c = F.col(column)
    held = rows.filter(c.isNotNull())
    n = held.count()
    searches = [_Search(r, n) for r in ranks]
    open_ = [s for s in searches if 1 <= s.left <= n]
    while wide := [s for s in open_ if s.value is None and s.rows > small]:
        asked = []
        for s in wide:
            near = [min(1.0, max(0.0, s.left / s.rows + d * 2 / accuracy)) for d in (-1, 1)]
            asked.append(F.percentile_approx(F.when(s.inside(c), c), near, accuracy))
        found = held.agg(*[a.alias(f"p{i}") for i, a in enumerate(asked)]).first()
        counts = []
        for i, s in enumerate(wide):
            lo, hi = found[i]
            inside = s.inside(c)
            counts += [
                F.count_if(inside & (c < F.lit(lo))),
                F.count_if(inside & (c == F.lit(lo))),
                F.count_if(inside & (c > F.lit(lo)) & (c < F.lit(hi))),
                F.count_if(inside & (c == F.lit(hi))),
            ]
        totals = held.agg(*[x.alias(f"c{i}") for i, x in enumerate(counts)]).first()
        for i, s in enumerate(wide):
            (lo, hi), (below, at_lo, between, at_hi) = found[i], totals[4 * i : 4 * i + 4]
            at_hi = 0 if lo == hi else at_hi
            if s.left <= below:
                s.rows, s.high = below, lo
            elif s.left <= below + at_lo:
                s.value = lo
            elif s.left <= below + at_lo + between:
                s.left, s.rows, s.low, s.high = s.left - below - at_lo, between, lo, hi
            elif s.left <= below + at_lo + between + at_hi:
                s.value = hi
            else:
                passed = below + at_lo + between + at_hi
                s.left, s.rows, s.low = s.left - passed, s.rows - passed, hi
    last = [s for s in open_ if s.value is None]
    for s in last:
        by_value = held.filter(s.inside(c)).groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("rows"))
        upto = F.sum("rows").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        s.value = by_value.withColumn("upto", upto).filter(F.col("upto") >= s.left).agg(F.min("value")).first()[0]
    return [s.value for s in searches]
