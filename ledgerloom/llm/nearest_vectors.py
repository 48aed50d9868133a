"""Largest inner products through shifted Hilbert orderings.

The vectors of one length are cut into at most ``BANDS`` bands by norm, each a factor of sqrt(2) wide (the last takes all
smaller norms), so that a few long vectors don't press the rest into a corner. In a band, maximum inner product becomes
nearest neighbour by one more coordinate: sqrt(M^2 - |x|^2) for an indexed vector and 0 for a query of norm M, M being the
band's largest norm. Several random projections to a few dimensions, each shifted at random, are laid along a Hilbert
curve. Each ordering is cut into ``BLOCKS`` ranges of equal numbers of rows; a query is scored, in double precision,
against every vector of its own and the neighbouring ranges, in every band, and the results of all orderings are merged.
A band no larger than one window is scored whole, once, without curves.

A window is a share of the rows, the same at every size. On nearly isotropic vectors no index finds nine in ten of the
neighbours from a small share; the share here is chosen for that. Ranges and queries are cut into pieces of bounded
rows, so a task's size doesn't grow. Equal vectors are one entry that knows its 21 smallest ids. A score is one plain
sum over the components, so equal products are equal numbers whichever block they come from.

Cases: null, zero, or vectors holding null or non-finite components take no part, nor do rows without an id; vectors
meet only vectors of their own length; repeated rows of one id and vector count once; ties go to the smaller id;
with fewer candidates than asked for, all are returned; no vectors give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import batch, bounded_sample, map_batches, staged, table

#: Orderings, dimensions and bits of a curve (63 bits of key), ranges of an ordering, ranges on either side of a query's.
CURVES, DIMS, BITS, BLOCKS, SIDE = 12, 7, 9, 64, 4
#: Rows and queries scored at once; vectors sampled to scale the projections (the documented bound of the fit).
BLOCK_ROWS, BLOCK_QUERIES, FIT_ROWS = 20_000, 5_000, 2_000
WINDOW = 2 * SIDE + 1
#: A range holds at least so many rows, so small tables have fewer ranges.
LEAST_ROWS = 128
#: Bands of norms of one vector length.
BANDS = 16
TOP = 20
SEED = 7


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows) with ``bits`` bits in each dimension."""
    one = np.uint64(1)
    x = cells.T.astype(np.uint64)
    top = one << np.uint64(bits - 1)
    level = top
    while level > one:  # undo the rotation of each level
        low = level - one
        for i in range(len(x)):
            high = (x[i] & level) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        level >>= one
    for i in range(1, len(x)):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    level = top
    while level > one:
        turn ^= np.where((x[-1] & level) != 0, level - one, np.uint64(0))
        level >>= one
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = (key << one) | ((row >> np.uint64(b)) & one)
    return key.view(np.int64)


class Curves:
    """Projections with their scaling for one band of vectors of one length."""

    def __init__(self, sample: np.ndarray, radius2: float):
        rng = np.random.default_rng(SEED)
        self.radius2 = radius2
        points = self.lifted(sample)
        dims = min(DIMS, points.shape[1])
        self.parts = []
        for _ in range(CURVES):
            basis = np.linalg.qr(rng.normal(size=(points.shape[1], dims)))[0]
            seen = points @ basis
            low, spread = seen.mean(0) - 3 * seen.std(0), 6 * seen.std(0)
            self.parts.append((basis, low, np.where(spread > 0, spread, 1.0), rng.random(dims)))

    def lifted(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        norm2 = (vectors**2).sum(1)
        if query:
            scaled = vectors * np.sqrt(self.radius2 / np.maximum(norm2, np.finfo(float).tiny))[:, None]
            return np.hstack([scaled, np.zeros((len(vectors), 1))])
        return np.hstack([vectors, np.sqrt(np.maximum(0.0, self.radius2 - norm2))[:, None]])

    def keys(self, vectors: np.ndarray, query: bool = False) -> list[np.ndarray]:
        points = self.lifted(vectors, query)
        out = []
        for basis, low, spread, shift in self.parts:
            unit = np.clip(np.nan_to_num(((points @ basis - low) / spread + shift) / 2), 0, 1 - 1e-12)
            out.append(hilbert_keys((unit * (1 << BITS)).astype(np.int64), BITS))
        return out


def _entries(vectors: DataFrame, kind: str) -> DataFrame:
    """(vec_id, c1, c2, norm2, dim, vec) of the vectors that take part; c1 and c2 hash the components."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for rows in batches:
            out: list[tuple] = []
            for i, v in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                if i is None or not v or None in v:
                    continue
                x = np.array(v, kind)
                norm2 = float((x.astype(float) ** 2).sum())
                if not np.isfinite(x).all() or not x.any():
                    continue
                raw = (x + 0).tobytes()  # -0.0 becomes 0.0
                h = xxhash.xxh3_128_digest(raw)
                c1, c2 = (int.from_bytes(h[k : k + 8], "big", signed=True) for k in (0, 8))
                out.append((i, c1, c2, norm2, len(x), raw))
            ids, c1, c2, norm2, dim, raw = zip(*out) if out else [()] * 6
            yield batch(
                vec_id=(ids, pa.int64()),
                c1=(c1, pa.int64()),
                c2=(c2, pa.int64()),
                norm2=(norm2, pa.float64()),
                dim=(dim, pa.int32()),
                vec=(raw, pa.binary()),
            )

    return map_batches(
        vectors.select("vec_id", "embedding"), task, "vec_id long, c1 long, c2 long, norm2 double, dim int, vec binary"
    )


def _keyed(index: DataFrame, curves: dict[tuple[int, int], Curves | None], kind: str) -> DataFrame:
    """(curve, key, query, cls, dim, band, vec): each entry on every curve of its band, and again, where it is a query, on
    those of every band of its length. A band without curves has one key."""

    def keys(group: tuple[int, int], vectors: np.ndarray, query: bool) -> list[np.ndarray]:
        made = curves[group]
        return made.keys(vectors, query) if made else [np.zeros(len(vectors), np.int64)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            frame = rows.to_pandas()
            for dim, part in frame.groupby("dim"):
                v = np.frombuffer(b"".join(part["vec"]), kind).reshape(len(part), dim).astype(float)
                asks = part["is_query"].to_numpy(bool)
                own = part["band"].to_numpy()
                for band in [b for d, b in curves if d == dim]:
                    for query, chosen in ((False, own == band), (True, asks)):
                        sub = part[chosen]
                        if sub.empty:
                            continue
                        for c, key in enumerate(keys((dim, band), v[chosen], query)):
                            yield batch(
                                curve=([c] * len(sub), pa.int32()),
                                key=(key, pa.int64()),
                                query=([query] * len(sub), pa.bool_()),
                                cls=(sub["cls"].to_numpy(), pa.int64()),
                                dim=([dim] * len(sub), pa.int32()),
                                band=([band] * len(sub), pa.int32()),
                                vec=(sub["vec"].tolist(), pa.binary()),
                            )

    return map_batches(
        index.select("cls", "dim", "band", "vec", "is_query"),
        task,
        "curve int, key long, query boolean, cls long, dim int, band int, vec binary",
    )


def _score(rows: pd.DataFrame, asks: pd.DataFrame, kind: str, top: int) -> pd.DataFrame:
    """(q, cls, score): the best of ``rows`` for every query of ``asks``; ties to the smaller class."""
    empty = pd.DataFrame({"q": [], "cls": [], "score": []}).astype({"q": "int64", "cls": "int64", "score": "float64"})
    if rows.empty or asks.empty:
        return empty
    dim = int(rows["dim"].iloc[0])
    rows = rows.sort_values("cls", kind="stable")
    cls = rows["cls"].to_numpy()
    x = np.frombuffer(b"".join(rows["vec"]), kind).reshape(len(rows), dim).astype(float)
    longest = np.sqrt((x**2).sum(1).max())
    out = []
    for at in range(0, len(asks), 500):
        part = asks.iloc[at : at + 500]
        q = np.frombuffer(b"".join(part["vec"]), kind).reshape(len(part), dim).astype(float)
        scores = q @ x.T
        k = min(top, len(cls))
        # the block's products may differ from the plain sum by their rounding
        slack = 4 * dim * np.finfo(float).eps * longest * np.sqrt((q**2).sum(1))
        floor = np.partition(scores, -k, axis=1)[:, -k] - slack
        for i, name in enumerate(part["cls"].to_numpy()):
            good = np.flatnonzero(~(scores[i] < floor[i]))
            plain = (x[good] * q[i]).sum(1)
            best = np.argsort(-plain, kind="stable")[:k]
            out.append(pd.DataFrame({"q": name, "cls": cls[good[best]], "score": plain[best]}))
    return pd.concat(out, ignore_index=True)


def nearest(vectors: DataFrame, is_query, top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows (vec_id, embedding) where the column ``is_query`` holds."""
    kind = "<f4" if "float" in dict(vectors.dtypes)["embedding"] else "<f8"
    entries = staged(_entries(vectors, kind), "vectors")
    members = entries.select("vec_id", "c1", "c2").distinct()
    order = Window.partitionBy("c1", "c2").orderBy("vec_id")
    lists = (
        members.withColumn("nth", F.row_number().over(order))
        .where(F.col("nth") <= top + 1)
        .groupBy("c1", "c2")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.min("vec_id").alias("cls"))
    )
    asked = members.where(is_query).select("c1", "c2", F.col("vec_id").alias("query_id"))
    index = staged(
        lists.join(asked.select("c1", "c2", F.lit(True).alias("is_query")).distinct(), ["c1", "c2"], "left")
        .join(entries.select("c1", "c2", F.col("vec_id").alias("cls"), "norm2", "dim", "vec"), ["c1", "c2", "cls"])
        .dropDuplicates(["c1", "c2"])
        .select("c1", "c2", "cls", "ids", "norm2", "dim", "vec", F.coalesce("is_query", F.lit(False)).alias("is_query")),
        "vector-index",
    )
    radii = index.groupBy("dim").agg(F.max("norm2").alias("longest2")).collect()  # one row for each vector length
    if not radii:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = vectors.sparkSession.createDataFrame(radii, "dim int, longest2 double")
    halvings = F.floor(F.log2("longest2") - F.log2("norm2"))
    banded = index.join(F.broadcast(lengths), "dim").withColumn(
        "band", F.coalesce(F.greatest(F.least(halvings, F.lit(BANDS - 1)), F.lit(0)), F.lit(BANDS - 1)).cast("int")
    )
    groups = banded.groupBy("dim", "band").agg(F.count("*").alias("n"), F.max("norm2").alias("radius2")).collect()
    asks_of = {r.dim: r.n for r in index.where("is_query").groupBy("dim").agg(F.count("*").alias("n")).collect()}
    curves: dict[tuple[int, int], Curves | None] = {}
    for g in groups:
        curves[g.dim, g.band] = None
        if g.n > LEAST_ROWS * WINDOW:
            rows = bounded_sample(banded.where((F.col("dim") == g.dim) & (F.col("band") == g.band)), ["vec"], "cls", FIT_ROWS)
            sample = np.stack([np.frombuffer(r.vec, kind) for r in rows]).astype(float)
            curves[g.dim, g.band] = Curves(sample, g.radius2)
    keyed = staged(_keyed(banded, curves, kind), "vector-keys")
    with_curves = [f"(dim = {d} and band = {b})" for (d, b), c in curves.items() if c]
    cuts = {
        (r.dim, r.band, r.curve): r.cuts
        for r in keyed.where("not query and (" + (" or ".join(with_curves) or "false") + ")")
        .groupBy("dim", "band", "curve")
        .agg(F.percentile_approx("key", [i / BLOCKS for i in range(1, BLOCKS)], 10_000).alias("cuts"))
        .collect()
    }
    layout = []
    for g in groups:
        made = curves[g.dim, g.band]
        ranges = min(BLOCKS, g.n // LEAST_ROWS) if made else 1
        pieces = -(-g.n // (ranges * BLOCK_ROWS))
        parts = max(1, -(-(asks_of.get(g.dim, 0) * min(WINDOW, ranges)) // (ranges * BLOCK_QUERIES)))
        for c in range(CURVES if made else 1):
            layout.append((g.dim, g.band, c, list(cuts.get((g.dim, g.band, c), [])), ranges, pieces, parts))
    bounds = vectors.sparkSession.createDataFrame(
        layout, "dim int, band int, curve int, cuts array<long>, ranges int, pieces int, parts int"
    )
    placed = keyed.join(F.broadcast(bounds), ["dim", "band", "curve"]).withColumn(
        "block", F.expr(f"cast(size(filter(cuts, x -> x <= key)) * ranges div {BLOCKS} as int)")
    )
    first = F.greatest(F.least(F.col("block") - SIDE, F.col("ranges") - WINDOW), F.lit(0))
    last = F.least(first + 2 * SIDE, F.col("ranges") - 1)
    split = lambda name, n, salt: F.pmod(F.xxhash64(name, F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["dim", "band", "curve", "block", "piece", "part"]
    data = (
        placed.where("not query")
        .withColumn("piece", split("cls", "pieces", 1))
        .withColumn("part", every("parts"))
        .select(*keys, "cls", "vec")
    )
    asks = (
        placed.where("query")
        .withColumn("part", split("cls", "parts", 2))
        .withColumn("block", F.explode(F.sequence(first, last)))
        .withColumn("piece", every("pieces"))
        .select(*keys, "cls", "vec")
    )
    both = data.withColumn("query", F.lit(False)).unionByName(asks.withColumn("query", F.lit(True)))
    found = both.groupBy(*keys).applyInPandas(
        lambda g: _score(g[~g["query"]], g[g["query"]], kind, top + 1), "q long, cls long, score double"
    )
    own = index.where("is_query").select(F.col("cls").alias("q"), "cls", F.col("norm2").alias("score"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "cls")
    merged = (
        found.unionByName(own)
        .groupBy("q", "cls")
        .agg(F.max("score").alias("score"))
        .withColumn("nth", F.row_number().over(best))
        .where(F.col("nth") <= top + 1)
    )
    expanded = merged.join(index.select("cls", "ids"), "cls").select("q", "score", F.explode("ids").alias("vec_id"))
    own_class = index.where("is_query").select("c1", "c2", F.col("cls").alias("q"))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    shortened = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    nearest_ids = expanded.withColumn("nth", F.row_number().over(shortened)).where(F.col("nth") <= top + 1).drop("nth")
    return (
        nearest_ids.join(asked.join(own_class, ["c1", "c2"]), "q")
        .where("query_id <> vec_id")
        .withColumn("rank", F.row_number().over(ranked).cast("int"))
        .where(F.col("rank") <= top)
        .select("query_id", "rank", "vec_id", "score")
    )


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
