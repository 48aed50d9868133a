"""Which (reference, narration) pairs are worth comparing.

A pair scores at least ``floor`` only if the shorter text and some window of the longer one have a common subsequence of
a known length, so the edits between them (characters deleted on either side) are bounded. The shorter text is cut into
parts; by the pigeonhole principle one part and the stretch of the window aligned with it have at most their share of the
edits. That part with its share of deletions spent is a subsequence of the stretch: the block key. Both sides list their keys:
the shorter text deletes from its parts, the longer one from its substrings, which begin and end with a kept character.

Up to 19 characters (floor 85) there is one part, the text itself, so a key holds nearly all of it however much all
references share; up to 26 there are two, then parts of eight or more. Keys of parts grow with the length of a text times a
constant. No pair is lost, and no group's pairs are listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.gates import in_gate, point_cells, query_cells

# A gate cell with more pairs than this for each of its rows is paired through block keys. Either way finds the same pairs; at
# 180 pairs for each row the keys took half as long again as the pairs themselves (93 and 60 task seconds).
PAIRS_PER_ROW = 256
WHOLE_DELETIONS = 4  # a text that needs no more deletions than this is one part
TWO_PART_EDITS = 7  # up to so many edits two parts do, beyond there are as many as leave two edits to one of them


def _let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once and bind it to ``name`` inside ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _common(n: str, w: str, floor: int) -> str:
    """Shortest common subsequence of a needle and a window that still reaches the floor."""
    return f"cast(ceil({floor} * ({n} + {w}) / 200) as int)"


def _least(n: str, floor: int) -> str:
    return f"greatest(1, cast(ceil({n} * {floor} / {200 - floor}) as int))"


def _drop(values: str) -> str:
    """Every text of ``values`` with any one character deleted."""
    return (
        f"array_distinct(flatten(transform({values}, t -> transform(sequence(1, length(t)), "
        "i -> concat(substr(t, 1, i - 1), substr(t, i + 1))))))"
    )


def _dropped(value: str, k: str) -> str:
    """Every text left after deleting exactly ``k`` (at most ``WHOLE_DELETIONS``) characters."""
    made, cases = f"array({value})", []
    for count in range(WHOLE_DELETIONS + 1):
        cases.append(f"when {count} then {made}")
        made = _drop(made)
    return f"case {k} {' '.join(cases)} end"


def _shape(n: str, floor: int) -> str:
    """How a needle of ``n`` characters is cut: most edits ``e``, deletions in the needle ``k`` and in a window ``d``,
    and the number of parts ``p``, over all windows that can reach the floor."""
    need = _common(n, "w", floor)
    sizes = f"filter(sequence({_least(n, floor)}, {n}), w -> {need} <= w)"
    most = (
        f"named_struct('e', array_max(transform(ws, w -> {n} + w - 2 * {need})), "
        f"'k', array_max(transform(ws, w -> {n} - {need})), 'd', array_max(transform(ws, w -> w - {need})))"
    )
    parts = (
        f"named_struct('e', x.e, 'k', x.k, 'd', x.d, 'p', cast(case when x.k <= {WHOLE_DELETIONS} then 1 "
        f"when x.e <= {TWO_PART_EDITS} then 2 else floor(x.e / 3) + 1 end as int))"
    )
    return _let("ws", sizes, _let("x", most, parts))


def _parts(n: str, lead: int) -> str:
    """(b, a): first place and length of each part; what most needles begin with does not count as length."""
    skip = f"if(z.p > 1 and {n} - {lead} >= 6 * z.p, {lead}, 0)"
    first = f"if(i = 0, 0, {skip} + cast(floor(i * ({n} - {skip}) / z.p) as int))"
    end = f"if(i = z.p - 1, {n}, {skip} + cast(floor((i + 1) * ({n} - {skip}) / z.p) as int))"
    return f"transform(sequence(0, z.p - 1), i -> named_struct('b', {first}, 'a', {end} - {first}))"


#: Deletions left for the part where the window spends ``d`` of a part's share.
_SHARE = "cast(floor(z.e / z.p) as int)"
_SPENT = f"least({_SHARE} - d, z.k)"


def needle_keys(text: str, floor: int, lead: int = 0) -> Column:
    """Block keys of the shorter text. ``lead``: characters that most needles begin with, a hint."""
    dropped = _dropped(f"substr({text}, s.b + 1, s.a)", _SPENT)
    per_part = f"flatten(transform(sequence(0, least({_SHARE}, z.d)), d -> {dropped}))"
    keys = f"flatten(transform({_parts('n', lead)}, s -> {per_part}))"
    hashed = f"array_distinct(transform({keys}, q -> xxhash64(n, q)))"
    body = _let("n", f"length({text})", _let("z", _shape("n", floor), hashed))
    return F.expr(f"case when length({text}) = 0 then array() else {body} end")


def hay_keys(text: str, sizes: str, floor: int, lead: int = 0) -> Column:
    """Block keys of the longer text, for every shorter-text length in the array ``sizes``; ``lead`` as for the needles."""
    m = f"length({text})"
    inner = _dropped(f"substr({text}, s + 1, c + d - 2)", "d")
    ends = f"transform({inner}, y -> concat(substr({text}, s, 1), y, substr({text}, s + c + d - 1, 1)))"
    at_start = f"if(d = 0, array(substr({text}, s, c)), {ends})"
    starts = f"if(c + d > {m} or (d > 0 and c < 2), array(), flatten(transform(sequence(1, {m} - c - d + 1), s -> {at_start})))"
    per_share = f"flatten(transform(sequence(0, least({_SHARE}, z.d)), d -> {_let('c', f'a - {_SPENT}', starts)}))"
    lengths = f"array_distinct(transform({_parts('n', lead)}, y -> y.a))"
    keys = f"flatten(transform({lengths}, a -> {per_share}))"
    per_size = _let("z", _shape("n", floor), f"transform({keys}, q -> xxhash64(n, q))")
    return F.expr(f"array_distinct(flatten(transform(filter({sizes}, n -> n > 0 and n <= {m}), n -> {per_size})))")


def several_parts(n: int, floor: int) -> bool:
    """Whether a needle of ``n`` characters is cut at all, as in ``_shape``; only then does a shared lead matter."""
    least = max(1, -(-n * floor // (200 - floor)))
    most = max((n - -(-floor * (n + w) // 200) for w in range(least, n + 1)), default=0)
    return most > WHOLE_DELETIONS


def shared_lead(texts: DataFrame, column: str) -> int:
    """How many characters a quarter of the texts begin with alike: even numbers up to 16, counted once each."""
    begun = texts.select(F.explode(F.expr(f"transform(sequence(2, 16, 2), j -> named_struct('j', j, 'x', substr({column}, 1, j)))")).alias("h"))
    counts = begun.groupBy("h.j", "h.x").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.groupBy("j").agg(F.max("n").alias("top"), F.sum("n").alias("total")).collect()
    return max((r.j for r in rows if 4 * r.top >= r.total), default=0)


def _sizes(rows: DataFrame, cells: list[str], text: str) -> DataFrame:
    """Distinct text lengths per cell: bounded by the longest text, whatever the row count."""
    return rows.groupBy(*cells).agg(F.collect_set(F.length(text)).alias("sizes"))


def gated_pairs(
    open_keys: DataFrame,
    points: DataFrame,
    scope: tuple[str, ...],
    floor: int,
    pairs_per_row: int = PAIRS_PER_ROW,
) -> DataFrame:
    """Distinct references (ref, expected_net, day) with the distinct narrations (text, amount, bank_day)
    in their gate. A cell pairs directly while that lists few pairs for each of its rows, so that the pairs stay in
    proportion to the rows; beyond, through block keys. Both find every pair that can reach the floor."""
    cells = [*scope, "_paise", "_week"]
    asks = query_cells(open_keys)
    rows = point_cells(points)
    gate = in_gate(F.col("expected_net"), F.col("day"), F.col("amount"), F.col("bank_day"))
    asks_n = asks.groupBy(*cells).agg(F.count(F.lit(1)).alias("asks"))
    rows_n = rows.groupBy(*cells).agg(F.count(F.lit(1)).alias("rows"))
    hot = (
        asks_n.join(rows_n, cells)
        .filter(F.col("asks") * F.col("rows") > pairs_per_row * (F.col("asks") + F.col("rows")))
        .select(*cells)
    )
    identity = [*scope, "ref", "expected_net", "day", "text", "amount", "bank_day"]
    payload = [c for c in points.columns if c not in identity]
    keep = [*identity, *payload]
    if hot.isEmpty():
        return asks.join(rows, cells).filter(gate).select(*keep)
    direct = asks.join(hot, cells, "left_anti").join(rows, cells).filter(gate)

    hot_asks = asks.join(hot, cells, "left_semi").filter(F.length("ref") > 0)
    hot_rows = rows.join(hot, cells, "left_semi").filter(F.length("text") > 0)
    by_ref = (
        hot_asks.withColumn("_key", F.explode(needle_keys("ref", floor)))
        .join(
            hot_rows.join(_sizes(hot_asks, cells, "ref"), cells)
            .withColumn("_key", F.explode(hay_keys("text", "sizes", floor)))
            .drop("sizes"),
            [*cells, "_key"],
        )
        .filter(F.length("ref") <= F.length("text"))
    )
    by_text = (
        hot_rows.withColumn("_key", F.explode(needle_keys("text", floor)))
        .join(
            hot_asks.join(_sizes(hot_rows, cells, "text"), cells)
            .withColumn("_key", F.explode(hay_keys("ref", "sizes", floor)))
            .drop("sizes"),
            [*cells, "_key"],
        )
        .filter(F.length("text") <= F.length("ref"))
    )
    # two empty texts are identical: within a cell there is one empty narration per amount and day
    empty = (
        asks.join(hot, cells, "left_semi")
        .filter(F.length("ref") == 0)
        .join(rows.join(hot, cells, "left_semi").filter(F.length("text") == 0), cells)
    )
    named = direct.columns
    blocked = by_ref.filter(gate).select(*named).unionByName(by_text.filter(gate).select(*named))
    if payload:
        once = blocked.groupBy(*identity).agg(*[F.first(c).alias(c) for c in payload])
    else:
        once = blocked.select(*identity).distinct()
    return (
        direct.select(*keep).unionByName(once.select(*keep)).unionByName(empty.filter(gate).select(*keep))
    )
