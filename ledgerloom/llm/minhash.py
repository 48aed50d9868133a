"""Near-duplicates by bottom-k sketches from one hash function.

A document's set is its distinct five-word shingles. Its sketch is the ``SKETCH`` smallest hashes. Documents with equal sets are
one class. Inverted lists hold, for each of the ``KEYS`` smallest retained values, the classes that retain it there: two sets of
similarity 0.75 share no list with a chance of 0.25 ** 12 (6e-8), and sets of up to ``KEYS`` shingles always share one.

Rounds. In every list with members of several components one member is the centre: the one that meets most members over all its
lists and was no centre before, so that the original of a family of independent copies comes first. A member meets the centres
of its lists; of those in foreign components, union sketches estimate the similarity, clear misses go, the most similar centre
stays, and full sets confirm the link. A round costs at most one pair for each list entry. Rounds go on while they close lists.

Proof of apartness. Of a set that links to another component, three quarters of the shingles at least occur there, and so do more
than ``RETAINED`` of its retained values among theirs. Counting, for each value, the smallest and largest component
that has it proves most listed sets apart: documents that share a passage go before the first round.

The rest. What is still in lists with several components after the rounds is compared exactly, without a limit. The same count, over retained
values and then over whole sets, proves copies with too many edits apart. Those left are compared list by list with full sets, lists with the same members once, in blocks of bounded size.

Scale: lists, families and hot shingles are counted with partial sums, never gathered; the partition of a hot key is split by
adaptive execution. A set of a third of all rows is one class. Sets of listed documents are written once. Steps are
written under the shared folder and removed when nothing reads them any more. Only in families whose members share most of their shingles and
yet are not linked does the last comparison grow with the square of their number, in blocks.

Cases: no words or null text: no shingles, linked with nothing, kept; a null doc_id: linked with nothing, component
null, kept; rows of equal doc_id are one node, linked by the set of any of them, and kept if that id is the smallest
of the group; fewer than five words: the sequence is one shingle; an empty table gives no rows; other columns pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import Scratch, batch, map_batches, table
from ledgerloom.llm.components import components
from ledgerloom.llm.shingles import Powers, shingle_sets
from ledgerloom.operators.skew import prepare

#: Retained hashes, those that name lists, and the link: 100 * common >= PERCENT * union.
SKETCH, KEYS, PERCENT = 64, 12, 75
#: Estimates below this are clear misses: more than four standard errors under 0.75 at 64 values.
ESTIMATE = 0.5
#: A set of which a smaller share of the retained values occurs elsewhere links with nothing: at 0.75 that is more than six standard errors.
RETAINED = 0.375
#: Rounds end when they find fewer links than this share of the listed sets.
PROGRESS = 0.02
#: Members and bytes of a block of the last comparison.
BLOCK_SETS, BLOCK_BYTES = 256, 8 << 20
_LONG = pa.int64()


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n, s1, s2, sketch): set size, 128-bit hash of the set, and its smallest hashes as little-endian bytes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        powers = Powers()
        for rows in batches:
            n, s1, s2, sketch = [], [], [], []
            for s in shingle_sets(rows.column(1).to_pylist(), powers):
                h = xxhash.xxh3_128_digest(s.tobytes())
                n.append(len(s))
                s1.append(int.from_bytes(h[:8], "big", signed=True))
                s2.append(int.from_bytes(h[8:], "big", signed=True))
                sketch.append(s[:SKETCH].tobytes())
            yield batch(
                doc_id=rows.column(0), n=(n, _LONG), s1=(s1, _LONG), s2=(s2, _LONG), sketch=(sketch, pa.binary())
            )

    return map_batches(docs.select("doc_id", "text"), task, "doc_id long, n long, s1 long, s2 long, sketch binary")


def list_entries(reps: DataFrame) -> DataFrame:
    """(key, rep, n): the lists of each class, named by its smallest retained values."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            values = [np.frombuffer(x, np.int64)[:KEYS] for x in rows.column(2).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(values)), [len(v) for v in values]))
            yield batch(
                key=(np.concatenate([np.zeros(0, np.int64), *values]), _LONG),
                rep=rows.column(0).take(at),
                n=rows.column(1).take(at),
            )

    return map_batches(reps.select("rep", "n", "sketch"), task, "key long, rep long, n long")


def full_sets(docs: DataFrame) -> DataFrame:
    """(id, members): whole shingle sets as bytes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for rows in batches:
            members = [s.tobytes() for s in shingle_sets(rows.column(1).to_pylist(), powers)]
            yield batch(id=rows.column(0), members=(members, pa.binary()))

    return map_batches(docs, task, "id long, members binary")


def _open(entries: DataFrame) -> DataFrame:
    """(key, rep, n, comp, used, members) of the lists that have members of several components, from (key, rep, n, comp, used)."""
    lists = entries.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("members"))
    return entries.select("key", "rep", "n", "comp", "used").join(lists.where("lo < hi").select("key", "members"), "key")


def _centres(lists: DataFrame) -> DataFrame:
    """(key, centre, n_centre, comp_centre): of each list the member, not used before, that meets most."""
    weights = lists.groupBy("rep").agg(F.sum("members").alias("weight"))
    weighed = lists.where("not used").join(weights, "rep")
    best = F.max_by(F.struct("rep", "n", "comp"), F.struct("weight", (-F.col("rep")).alias("first")))
    return weighed.groupBy("key").agg(best.alias("c")).select(
        "key", F.col("c.rep").alias("centre"), F.col("c.n").alias("n_centre"), F.col("c.comp").alias("comp_centre")
    )


def _meetings(lists: DataFrame, centres: DataFrame) -> DataFrame:
    """(rep, centre) of foreign components whose sizes allow a link."""
    sized = 100 * F.least("n", "n_centre") >= PERCENT * F.greatest("n", "n_centre")
    met = lists.join(centres, "key").where((F.col("comp") != F.col("comp_centre")) & sized)
    return met.select("rep", "centre").distinct()


def _closest(meetings: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): each member with the centre of the highest estimate from union sketches, clear misses left out."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            left, right = (rows.column(k).to_pylist() for k in (2, 3))
            share = []
            for x, y in zip(left, right):
                union, n = np.unique(np.frombuffer(x + y, np.uint64), return_counts=True)
                size = min(SKETCH, len(union))
                share.append(float((n[:size] == 2).sum() / size) if size else 0.0)
            yield batch(rep=rows.column(0), centre=rows.column(1), share=(share, pa.float64()))

    own = reps.select("rep", F.col("sketch").alias("left"))
    other = reps.select(F.col("rep").alias("centre"), F.col("sketch").alias("right"))
    joined = meetings.join(own, "rep").join(other, "centre").select("rep", "centre", "left", "right")
    shares = map_batches(joined, task, "rep long, centre long, share double").where(F.col("share") >= ESTIMATE)
    return shares.groupBy(F.col("rep").alias("a")).agg(
        F.max_by("centre", F.struct("share", (-F.col("centre")).alias("first"))).alias("b")
    )


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= PERCENT * (len(x) + len(y) - common)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v): pairs (a, b) whose full sets have 100 * common >= PERCENT * union."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            columns = (rows.column(k).to_pylist() for k in range(4))
            links = [
                (a, b)
                for a, b, x, y in zip(*columns)
                if _similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
            ]
            yield batch(u=([a for a, _ in links], _LONG), v=([b for _, b in links], _LONG))

    left = sets.select(F.col("rep").alias("a"), F.col("members").alias("left"))
    right = sets.select(F.col("rep").alias("b"), F.col("members").alias("right"))
    centres = right.join(pairs.select("b").distinct(), "b", "left_semi")
    joined = pairs.join(left, "a").join(centres, "b").select("a", "b", "left", "right")
    return map_batches(joined, task, "u long, v long")


def _joined_up(scratch: Scratch, state: DataFrame, links: DataFrame) -> DataFrame:
    """``state`` (rep, comp, used) with the components of the links (u, v) between reps taken together."""
    ends = state.select("rep", "comp")
    between = links.join(ends.toDF("u", "cu"), "u").join(ends.toDF("v", "cv"), "v").where("cu <> cv")
    merged = components(between.select(F.col("cu").alias("u"), F.col("cv").alias("v")), scratch)
    moved = state.join(merged.toDF("comp", "root"), "comp", "left")
    return scratch.staged(moved.select("rep", F.coalesce("root", "comp").alias("comp"), "used"), "state")


def _foreign(held: DataFrame, share: float) -> DataFrame:
    """The reps (rep, comp, values: bytes) of which that share of the values occurs in another component too."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            values = [np.frombuffer(x, np.int64) for x in rows.column(2).to_pylist()]
            counts = [len(v) for v in values]
            at = pa.array(np.repeat(np.arange(len(values)), counts))
            yield batch(
                v=(np.concatenate([np.zeros(0, np.int64), *values]), _LONG),
                rep=rows.column(0).take(at),
                comp=rows.column(1).take(at),
                n=pa.array(counts, pa.int32()).take(at),
            )

    values = map_batches(held.select("rep", "comp", "values"), task, "v long, rep long, comp long, n int")
    shared = values.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("v")
    counts = values.join(shared, "v", "left_semi").groupBy("rep", "comp").agg(
        F.count("*").alias("foreign"), F.max("n").alias("n")
    )
    return counts.where(F.col("foreign") >= share * F.col("n")).select("rep", "comp")


def _linkable(rest: DataFrame, reps: DataFrame) -> DataFrame:
    """The reps (rep, comp) of ``rest`` that other components share enough retained values with."""
    return _foreign(rest.join(reps.select("rep", F.col("sketch").alias("values")), "rep"), RETAINED)


def _block_links(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) between components among the members of each list (key, rep, comp), by full sets."""
    sized = lists.join(sets.select("rep", "n", "members"), "rep")
    shape = lists.join(sets.select("rep", "n"), "rep").groupBy("key").agg(
        F.count("*").alias("many"),
        F.sum("n").alias("values"),
        F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who"),
        F.min("comp").alias("lo"),
        F.max("comp").alias("hi"),
    )
    # lists with the same members are one
    once = shape.where("lo < hi").groupBy("many", "who").agg(F.min("key").alias("key"), F.first("values").alias("values"))
    blocks = F.greatest(F.ceil(F.col("many") / BLOCK_SETS), F.ceil(F.col("values") * 8 / BLOCK_BYTES)).cast("int")
    dealt = (
        sized.join(once.select("key", blocks.alias("blocks")), "key")
        .withColumn("own", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select(
            "key",
            F.least("own", "other").alias("i"),
            F.greatest("own", "other").alias("j"),
            "own",
            "rep",
            "comp",
            "members",
        )
    )

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rep, comp, own = (rows[c].to_numpy() for c in ("rep", "comp", "own"))
        values = [np.frombuffer(x, np.uint64) for x in rows["members"]]
        n = np.array([len(v) for v in values])
        left = np.flatnonzero(own == rows["i"].iloc[0])
        right = np.flatnonzero(own == rows["j"].iloc[0])
        every, where = np.unique(np.concatenate(values), return_inverse=True)
        of = np.repeat(np.arange(len(values)), n)
        common = np.zeros((len(left), len(right)), np.float32)
        place_l, place_r = np.full(len(values), -1), np.full(len(values), -1)
        place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
        width = max(1, (32 << 20) // (4 * len(values)))
        order = np.argsort(where, kind="stable")
        where, of = where[order], of[order]
        for begin in range(0, len(every), width):  # a stripe of shingles at a time
            a, b = np.searchsorted(where, [begin, begin + width])
            m = np.zeros((len(values), min(width, len(every) - begin)), np.float32)
            m[of[a:b], where[a:b] - begin] = 1
            common += m[left] @ m[right].T
        union = n[left][:, None] + n[right][None] - common
        hit = (100 * common >= PERCENT * union) & (comp[left][:, None] != comp[right][None])
        x, y = np.nonzero(hit)
        return pd.DataFrame({"u": rep[left[x]], "v": rep[right[y]], "cu": comp[left[x]], "cv": comp[right[y]]})

    found = dealt.groupBy("key", "i", "j").applyInPandas(compare, "u long, v long, cu long, cv long")
    # one link for each two components
    return found.groupBy(F.least("cu", "cv").alias("c1"), F.greatest("cu", "cv").alias("c2")).agg(
        F.min(F.struct("u", "v")).alias("l")
    ).select("l.u", "l.v")


def _listed_sets(docs: DataFrame, reps: DataFrame, repeated: DataFrame) -> DataFrame:
    """(rep, n, members): whole sets of the documents of ``reps``; a set that several rows of one id have once."""
    ids = reps.select(F.col("rep").alias("id"))
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(ids, "id", "left_semi")
    if repeated.isEmpty():
        sets = full_sets(texts)
    else:
        once = full_sets(texts.join(repeated, "id", "left_semi")).dropDuplicates(["id", "members"])
        sets = full_sets(texts.join(repeated, "id", "left_anti")).unionByName(once)
    n = (F.octet_length("members") / 8).cast("long")
    return sets.select(F.col("id").alias("rep"), n.alias("n"), "members").where("n > 0")


def _grouped(scratch: Scratch, docs: DataFrame, reps: DataFrame, same_id: DataFrame, repeated: DataFrame) -> DataFrame:
    """(rep, comp) of the reps (rep, n, sketch) that share a list with others or are ends of ``same_id`` (u, v)."""
    every = list_entries(reps)
    shared = every.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    entries = scratch.staged(every.join(shared, "key", "left_semi"), "entries")
    listed = entries.select("rep", F.col("rep").alias("comp")).distinct()
    few = scratch.staged(_linkable(listed, reps), "linkable").select("rep")
    entries = scratch.staged(entries.join(few, "rep", "left_semi"), "entries")
    nodes = few.unionByName(same_id.select(F.col("u").alias("rep"))).unionByName(same_id.select(F.col("v").alias("rep")))
    state = scratch.staged(
        nodes.distinct().select("rep", F.col("rep").alias("comp"), F.lit(False).alias("used")), "state"
    )
    sets = scratch.staged(_listed_sets(docs, state, repeated), "sets")
    if not same_id.isEmpty():
        state = _joined_up(scratch, state, same_id)
    own = [reps, same_id, repeated, *scratch.named("sketches")]
    while True:
        lists = scratch.staged(_open(entries.select("key", "rep", "n").join(state, "rep")), "lists")
        size = lists.count()
        if not size:
            break
        centres = scratch.staged(_centres(lists), "centres")
        pairs = scratch.staged(_closest(_meetings(lists, centres), reps), "pairs")
        links = scratch.staged(_confirmed(pairs, sets), "links")
        used = centres.select(F.col("centre").alias("rep"), F.lit(True).alias("now")).distinct()
        marked = state.join(used, "rep", "left").select(
            "rep", "comp", (F.col("used") | F.coalesce("now", F.lit(False))).alias("used")
        )
        state = _joined_up(scratch, scratch.staged(marked, "marked"), links)
        # a closed list stays closed
        entries = lists
        if links.count() < PROGRESS * size / KEYS:
            state = _rest_joined(scratch, lists, state, reps, sets)
            break
        scratch.drop_all_but(entries, sets, state, *own)
    scratch.drop_all_but(state, reps, *scratch.named("sketches"))
    return state.select("rep", "comp")


def _rest_joined(scratch: Scratch, lists: DataFrame, state: DataFrame, reps: DataFrame, sets: DataFrame) -> DataFrame:
    """``state`` with what is still apart in open ``lists`` compared exactly."""
    lists = scratch.staged(_open(lists.select("key", "rep", "n").join(state, "rep")), "lists")
    rest = _linkable(lists.select("rep", "comp").distinct(), reps)
    held = rest.join(sets.select("rep", F.col("members").alias("values")), "rep")
    rest = scratch.staged(_foreign(held, PERCENT / 100), "rest")
    if rest.isEmpty():
        return state
    links = _block_links(lists.select("key", "rep").join(rest, "rep"), sets.join(rest.select("rep"), "rep", "left_semi"))
    return _joined_up(scratch, state, scratch.staged(links, "links"))


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row (doc_id, text)."""
    prepare(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    marks = scratch.staged(sketches(docs), "sketches")
    linkable = marks.where("n > 0 and doc_id is not null")
    # one row of each class, with the smallest id that has the set
    first = F.min_by(F.struct("doc_id", "sketch", "n"), "doc_id").alias("first")
    reps = scratch.staged(
        linkable.groupBy("s1", "s2").agg(first).select("s1", "s2", F.col("first.doc_id").alias("rep"), "first.sketch", "first.n"),
        "representatives",
    )
    of_class = reps.select("s1", "s2", "rep")
    repeated = scratch.staged(
        linkable.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("doc_id").alias("id")),
        "repeated",
    )
    # rows of one id may be in several classes
    again = linkable.join(repeated.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
    own = again.select("doc_id", "s1", "s2").join(of_class, ["s1", "s2"]).select("doc_id", "rep").distinct()
    several = own.groupBy("doc_id").agg(F.min("rep").alias("u"))
    same_id = own.join(several, "doc_id").where("rep > u").select("u", F.col("rep").alias("v"))
    if repeated.isEmpty():
        same_id = same_id.limit(0)
    same_id = scratch.staged(same_id, "same-id")
    roots = _grouped(scratch, docs, reps, same_id, repeated)
    return (
        marks.join(of_class, ["s1", "s2"], "left")
        .join(roots, "rep", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("comp", "rep"))
            .otherwise(F.col("doc_id"))
            .alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and any others) with one document of each group: the smallest id."""
    dropped = near_groups(docs).where("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
