"""Reference extraction and text similarity for bank rows, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.reach import may_reach

BANK_REF_PREFIX = "BANKREF_"

# Narration id shapes, tried in this order.
NARRATION_PATTERNS = (
    r"(?i)(TXN_[0-9]{5,8})",
    r"(?i)(TXN-[0-9]{4}-[0-9]{4,8})",
    r"(?i)(PYT_[0-9]{7,8})",
)


def ref_txn_id(bank_ref: Column) -> Column:
    """Id carried by a structured bank reference, up to the first duplicate marker."""
    rest = F.substring(bank_ref, len(BANK_REF_PREFIX) + 1, 2147483647)
    found = F.split_part(rest, F.lit("_DUP"), F.lit(1))
    return F.when(bank_ref.startswith(BANK_REF_PREFIX), F.nullif(found, F.lit("")))


def narration_txn_id(narration: Column) -> Column:
    """First id-shaped token of a narration, by pattern order, upper-cased."""
    hits = [
        F.nullif(F.upper(F.regexp_extract(narration, pattern, 1)), F.lit(""))
        for pattern in NARRATION_PATTERNS
    ]
    return F.coalesce(*hits)


def resolved_txn_id(bank_ref: Column, narration: Column) -> Column:
    return F.coalesce(ref_txn_id(bank_ref), narration_txn_id(narration))


def link_method(bank_ref: Column, narration: Column) -> Column:
    return (
        F.when(ref_txn_id(bank_ref).isNotNull(), "bank_ref")
        .when(narration_txn_id(narration).isNotNull(), "narration")
        .otherwise("unresolved")
    )


# --- partial ratio -------------------------------------------------------------------------
#
# Written as SQL expression text: the lambdas nest deeply, and one parsed expression costs the
# driver a single call instead of thousands.

_WORD = 61  # needle positions that fit a BIGINT state without overflow


def _let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once and bind it to ``name`` inside ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _windows(n: str, m: str, floor: int) -> str:
    """Prefixes, full windows and suffixes of the longer text as (start, size).

    A window shorter than ``least`` cannot reach ``floor`` even if the needle contains all of it.
    """
    least = f"greatest(1, cast(ceil({n} * {floor} / {200 - floor}) as int))"
    window = f"named_struct('start', greatest(s, 1), 'size', least(s + {n} - 1, {m}) - greatest(s, 1) + 1)"
    return _let("least_size", least, f"transform(sequence(1 - {n} + least_size, {m} - least_size + 1), s -> {window})")


def _needle_masks(needle: str, hay: str) -> str:
    """For each character of ``hay``, the needle positions holding that character as bits."""
    positions = (
        "aggregate(letters, named_struct('bit', 1L, 'mask', 0L), (acc, x) -> named_struct("
        "'bit', shiftleft(acc.bit, 1), 'mask', if(x = c, acc.mask | acc.bit, acc.mask)), acc -> acc.mask)"
    )
    looked_up = (
        f"transform(split({hay}, ''), h -> "
        "coalesce(get(table, cast(array_position(alphabet, h) - 1 as int)), 0L))"
    )
    with_table = _let("table", f"transform(alphabet, c -> {positions})", looked_up)
    with_alphabet = _let("alphabet", "array_distinct(letters)", with_table)
    return _let("letters", f"split({needle}, '')", with_alphabet)


def _bits_best(needle: str, hay: str, floor: int) -> str:
    """Bit-parallel LCS per window: with U = V & M, V becomes (V + U) | (V & ~M); the zeros count it."""
    state = (
        "aggregate(slice(masks, w.start, w.size), ones, "
        "(v, k) -> ((v + (v & k)) | (v & ~k)) & ones)"
    )
    score = f"(n - bit_count({state})) * 200.0D / (n + w.size)"
    best = f"array_max(transform({_windows('n', 'size(masks)', floor)}, w -> {score}))"
    with_masks = _let("masks", _needle_masks(needle, hay), best)
    with_ones = _let("ones", "shiftleft(1L, n) - 1L", with_masks)
    return _let("n", f"length({needle})", with_ones)


def _words_best(needle: str, hay: str, floor: int) -> str:
    """The same over several words of needle positions: the sum of a word passes its carry on to the next one."""
    full = (1 << _WORD) - 1
    positions = (
        f"aggregate(slice(letters, {_WORD} * b + 1, {_WORD}), named_struct('bit', 1L, 'mask', 0L), (acc, x) -> named_struct("
        "'bit', shiftleft(acc.bit, 1), 'mask', if(x = c, acc.mask | acc.bit, acc.mask)), acc -> acc.mask)"
    )
    places = "transform(places, b -> {})".format(positions)
    none = "transform(places, b -> 0L)"
    masks = f"transform(split({hay}, ''), h -> coalesce(get(table, cast(array_position(alphabet, h) - 1 as int)), {none}))"
    word = (
        "named_struct('carry', shiftright(s, {w}), 'done', concat(acc.done, "
        "array(((s & {full}L) | (get(v, i) & ~get(k, i))) & get(ones, i))))"
    ).format(w=_WORD, full=full)
    added = "get(v, i) + (get(v, i) & get(k, i)) + acc.carry"
    step = (
        "aggregate(places, named_struct('carry', 0L, 'done', cast(array() as array<bigint>)), "
        f"(acc, i) -> {_let('s', added, word)}, acc -> acc.done)"
    )
    state = f"aggregate(slice(masks, w.start, w.size), ones, (v, k) -> {step})"
    left = f"aggregate({state}, 0, (acc, x) -> acc + cast(bit_count(x) as int))"
    score = f"(n - {left}) * 200.0D / (n + w.size)"
    best = f"array_max(transform({_windows('n', 'size(masks)', floor)}, w -> {score}))"
    with_masks = _let("masks", masks, best)
    with_table = _let("table", f"transform(alphabet, c -> {places})", with_masks)
    with_alphabet = _let("alphabet", "array_distinct(letters)", with_table)
    sizes = f"transform(places, b -> shiftleft(1L, cast(least({_WORD}, n - {_WORD} * b) as int)) - 1L)"
    with_ones = _let("ones", sizes, with_alphabet)
    with_places = _let("places", f"sequence(0, cast(ceil(n / {_WORD}) as int) - 1)", with_ones)
    return _let("letters", f"split({needle}, '')", _let("n", f"length({needle})", with_places))


def _best_window(needle: str, hay: str, floor: int) -> str:
    return (
        f"case when contains({hay}, {needle}) then 100.0D "
        f"when length({needle}) <= {_WORD} then {_bits_best(needle, hay, floor)} "
        f"else {_words_best(needle, hay, floor)} end"
    )


def partial_ratio(left: str, right: str, floor: int = 0) -> Column:
    """Similarity 0-100 of the shorter text with its best aligned stretch of the longer one.

    ``left`` and ``right`` are SQL expressions. Best of ``200 * lcs / (len + len)`` over every
    prefix, full window and suffix of the longer text. Null counts as empty. Two empty texts are
    identical (100), one empty text matches nothing. Equal lengths are aligned both ways. Scores at
    or above ``floor`` are exact; a lower one may come out lower still, since windows that cannot
    reach the floor are skipped.
    """
    a, b = f"coalesce({left}, '')", f"coalesce({right}, '')"
    shorter = f"length({a}) <= length({b})"
    pair = f"named_struct('x', if({shorter}, {a}, {b}), 'y', if({shorter}, {b}, {a}))"
    once = _best_window("p.x", "p.y", floor)
    body = (
        "case when p.x = '' then if(p.y = '', 100.0D, 0.0D) "
        f"when length(p.x) = length(p.y) then greatest({once}, {_best_window('p.y', 'p.x', floor)}) "
        f"else {once} end"
    )
    return F.expr(_let("p", pair, body))


def similar_pairs(pairs: DataFrame, left: str, right: str, floor: int) -> DataFrame:
    """Pairs at or above ``floor`` with their ``similarity``.

    Pairs below the floor are sorted out in batches where they arise and never shuffled. Scoring the others is the
    costly step, so they are dealt evenly over tasks by their texts. The score comes out of a generator, which keeps
    the optimizer from computing it once to filter and again to show.
    """
    if floor > 0:
        pairs = pairs.filter(may_reach(left, right, floor))
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = F.filter(F.array(partial_ratio(left, right, floor)), lambda s: s >= floor)
    return pairs.repartition(parts, left, right).select("*", F.explode(kept).alias("similarity"))
