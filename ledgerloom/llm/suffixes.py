"""Removal of long byte strings that repeat across documents, by a sparse suffix sort.

Every 50-byte string is seen through one of its 24-byte grams, the one with the smallest hash (the leftmost of equals): equal
strings choose the same gram. Only grams that occur in several documents matter. Around each such gram the 26 bytes on
either side decide which of the 27 strings through it repeat. Contexts of equal grams are sorted as suffixes, once to
the right and once to the left: a mergesort whose comparisons find the common extension of two suffixes by binary
search over prefix polynomial hashes, checked against the bytes. Common extensions of neighbours in the two orders
give, for every string, the smallest document that holds it.

Scale: texts travel in compressed packs of a few MB. A pack sends each gram hash once and gets one bit back, then each
distinct context once and gets one mask back, so copies collapse before any shuffle and a gram of a third of all
documents is one small entry of each pack. Work is spread by gram hash.

Cases: null and empty texts have no bytes and lose none; rows of equal doc_id don't count as smaller than one another;
rows without a doc_id count as largest; repeated rows give repeated results; an empty table gives no rows; other columns
are ignored. Matches never cross documents, and texts may be of any length.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import batch, map_batches, staged, table
from ledgerloom.llm.shingles import Powers, mix

MATCH, GRAM = 50, 24
REACH = MATCH - GRAM
CONTEXT = MATCH + REACH
#: Bytes of text in a pack (a longer document is a pack of its own) and in one pass of the window scan.
PACK_BYTES, SEGMENT = 4 << 20, 1 << 20
LAST_ID = (1 << 63) - 1
#: Bytes of a gram hash that are compared first; a false agreement costs one look at the contexts.
HASH_BYTES = 5
_U = np.uint64


# Packs


def packs(docs: DataFrame) -> DataFrame:
    """(pack, head, body): several documents as one compressed blob; head holds their ids, null flags and lengths."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        base, count = TaskContext.get().partitionId() << 32, 0
        ids: list = []
        raws: list[bytes] = []
        size = 0

        def packed() -> pa.RecordBatch:
            lengths = np.array([len(r) for r in raws], np.int64).tobytes()
            nulls = np.array([i is None for i in ids], np.uint8).tobytes()
            known = np.array([LAST_ID if i is None else i for i in ids], np.int64).tobytes()
            return batch(
                pack=([base + count], pa.int64()),
                head=([known + nulls + lengths], pa.binary()),
                body=([squeeze(b"".join(raws))], pa.binary()),
            )

        for rows in batches:
            for i, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                raw = text.encode() if text else b""
                ids.append(i)
                raws.append(raw)
                size += len(raw)
                if size >= PACK_BYTES:
                    yield packed()
                    ids, raws, size, count = [], [], 0, count + 1
        if ids:
            yield packed()

    return map_batches(docs.select("doc_id", "text"), task, "pack long, head binary, body binary")


@dataclass
class Pack:
    """Documents laid end to end: their ids, bounds and bytes, and the chosen grams."""

    ids: np.ndarray
    nulls: np.ndarray
    bounds: np.ndarray
    data: np.ndarray
    at: np.ndarray  # where a chosen gram begins
    doc: np.ndarray  # its document
    grams: np.ndarray  # distinct gram hashes, ascending
    gram: np.ndarray  # index of each chosen gram in them


def open_pack(head: bytes, body: bytes, powers: Powers) -> Pack:
    import zstandard

    n = len(head) // 17
    ids, lengths = np.frombuffer(head[: 8 * n], np.int64), np.frombuffer(head[9 * n :], np.int64)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    raw = zstandard.ZstdDecompressor().decompress(body, max_output_size=int(bounds[-1]) + 1)
    data = np.frombuffer(raw, np.uint8)
    at, hashes = chosen_grams(data, bounds, powers)
    grams, gram = np.unique(hashes, return_inverse=True)
    doc = np.searchsorted(bounds, at, "right") - 1
    return Pack(ids, np.frombuffer(head[8 * n : 9 * n], np.uint8), bounds, data, at, doc, grams, gram)


def chosen_grams(data: np.ndarray, bounds: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that the 50-byte strings within documents choose."""
    places, hashes = [], []
    ends = bounds[1:]
    for s in range(0, max(0, len(data) - MATCH + 1), SEGMENT):
        e = min(len(data) - MATCH + 1, s + SEGMENT)  # strings that begin in [s, e)
        part = data[s : e + MATCH - 1]
        up, down = powers.upto(len(part) + 1)
        prefix = np.zeros(len(part) + 1, _U)
        np.cumsum((part.astype(_U) + _U(1)) * up[:-1], out=prefix[1:])
        h = mix((prefix[GRAM:] - prefix[:-GRAM]) * down[: len(part) + 1 - GRAM])
        low = _U((1 << 21) - 1)
        least = (h & ~low) | np.arange(len(h), dtype=_U)
        width = 1
        while width * 2 <= REACH + 1:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = REACH + 1 - width
        least = np.minimum(least[: len(least) - rest], least[rest:])[: e - s]
        starts = np.arange(s, e)
        inside = starts + MATCH <= ends[np.searchsorted(ends, starts, "right")]
        marked = np.zeros(len(h), bool)
        marked[(least[inside] & low).astype(np.int64)] = True
        found = np.flatnonzero(marked)
        places.append(found + s)
        hashes.append(mix(h[found] ^ _U(0x2545F4914F6CDD1D)))  # evenly spread again: the chosen ones are small
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    at, first = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(hashes)[first]


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Ascending with the hash."""
    return (((hashes >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.int64)


# First exchange: which grams occur in several packs


def gram_rows(packed: DataFrame, buckets: int) -> DataFrame:
    """(bucket, pack, grams): the low bytes of each pack's distinct gram hashes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for rows in batches:
            for pack, head, body in zip(*(rows.column(k).to_pylist() for k in range(3))):
                grams = open_pack(head, body, powers).grams
                cut = np.searchsorted(bucket_of(grams, buckets), np.arange(buckets + 1))
                raw = grams.view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]
                some = np.flatnonzero(cut[1:] > cut[:-1])
                yield batch(
                    bucket=(some, pa.int32()),
                    pack=([pack] * len(some), pa.int64()),
                    grams=([raw[cut[b] : cut[b + 1]].tobytes() for b in some], pa.binary()),
                )

    return map_batches(packed.select("pack", "head", "body"), task, "bucket int, pack long, grams binary")


def shared_bits(rows: pd.DataFrame) -> pd.DataFrame:
    """(pack, bucket, bits) of one bucket: which of each pack's grams another pack has too."""
    counts = [len(x) // HASH_BYTES for x in rows["grams"]]
    keys = np.zeros((sum(counts), 8), np.uint8)
    keys[:, :HASH_BYTES] = np.frombuffer(b"".join(rows["grams"]), np.uint8).reshape(-1, HASH_BYTES)
    keys = keys.view(_U).ravel()
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    shared = np.zeros(len(keys), bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    bits = [np.packbits(x).tobytes() for x in np.split(shared, np.cumsum(counts)[:-1])]
    return pd.DataFrame({"pack": rows["pack"], "bucket": rows["bucket"], "bits": bits})


# Second exchange: contexts


@dataclass
class Contexts:
    """Chosen grams that repeat, and the distinct contexts among them in order of (gram, context)."""

    at: np.ndarray
    doc: np.ndarray
    left: np.ndarray
    right: np.ndarray
    entry: np.ndarray  # index of each into the distinct contexts
    first: np.ndarray  # index of a representative of each distinct context
    least: np.ndarray  # smallest doc_id with it in this pack
    bucket: np.ndarray
    padded: np.ndarray

    def windows(self, which: np.ndarray) -> np.ndarray:
        """Bytes of the contexts (rows), zero outside the document."""
        view = np.lib.stride_tricks.sliding_window_view(self.padded, CONTEXT)
        out = view[self.at[which]].copy()
        left, right = self.left[which], self.right[which]
        edge = np.flatnonzero((left < REACH) | (right < REACH))
        column = np.arange(CONTEXT)
        outside = (column < REACH - left[edge, None]) | (column >= REACH + GRAM + right[edge, None])
        out[edge] = np.where(outside, 0, out[edge])
        return out


def row_hashes(rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(rows), 80), np.uint8)
    wide[:, :CONTEXT] = rows
    wide[:, CONTEXT], wide[:, CONTEXT + 1] = left, right
    h = np.zeros(len(rows), _U)
    for column in wide.view(_U).T:
        h = mix(h * _U(3) + column)
    return h


def contexts_of(pack: Pack, bits: list, buckets: int) -> Contexts:
    """``bits``: (bucket, bits) rows of the pack."""
    bucket = bucket_of(pack.grams, buckets)
    cut = np.searchsorted(bucket, np.arange(buckets + 1))
    repeats = np.zeros(len(pack.grams), bool)
    for b, raw in bits:
        n = cut[b + 1] - cut[b]
        repeats[cut[b] : cut[b + 1]] = np.unpackbits(np.frombuffer(raw, np.uint8), count=int(n)).astype(bool)
    order = np.lexsort((pack.doc, pack.gram))
    g, d = pack.gram[order], pack.doc[order]
    repeats[g[1:][(g[1:] == g[:-1]) & (d[1:] != d[:-1])]] = True  # in several documents of this pack
    some = np.flatnonzero(repeats[pack.gram])
    at, doc = pack.at[some], pack.doc[some]
    left = np.minimum(REACH, at - pack.bounds[doc])
    right = np.minimum(REACH, pack.bounds[doc + 1] - at - GRAM)
    padded = np.concatenate([np.zeros(REACH, np.uint8), pack.data, np.zeros(CONTEXT, np.uint8)])
    out = Contexts(at, doc, left, right, None, None, None, None, padded)  # type: ignore[arg-type]
    h = np.zeros(len(some), _U)
    for s in range(0, len(some), 50_000):
        which = np.arange(s, min(len(some), s + 50_000))
        h[which] = row_hashes(out.windows(which), left[which], right[which])
    ids = pack.ids[doc]
    order = np.lexsort((ids, h, pack.gram[some]))
    new = np.ones(len(order), bool)
    g = pack.gram[some][order]
    new[1:] = (g[1:] != g[:-1]) | (h[order][1:] != h[order][:-1])
    out.entry = np.zeros(len(order), np.int64)
    out.entry[order] = np.cumsum(new) - 1
    out.first = order[new]
    out.least = ids[out.first]
    out.bucket = bucket[pack.gram[some][out.first]]
    return out


def context_rows(packed: DataFrame, buckets: int) -> DataFrame:
    """(bucket, pack, contexts): each pack's distinct contexts of repeated grams, compressed."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        powers = Powers()
        for rows in batches:
            for pack, head, body, bits in zip(*(rows.column(k).to_pylist() for k in range(4))):
                c = contexts_of(open_pack(head, body, powers), _pairs(bits, "bits"), buckets)
                cut = np.searchsorted(c.bucket, np.arange(buckets + 1))
                some = np.flatnonzero(cut[1:] > cut[:-1])
                blobs = []
                for b in some:
                    f = c.first[cut[b] : cut[b + 1]]
                    raw = (
                        c.least[cut[b] : cut[b + 1]].tobytes()
                        + c.left[f].astype(np.uint8).tobytes()
                        + c.right[f].astype(np.uint8).tobytes()
                        + c.windows(f).tobytes()
                    )
                    blobs.append(struct.pack("<q", len(f)) + squeeze(raw))
                yield batch(
                    bucket=(some, pa.int32()),
                    pack=([pack] * len(some), pa.int64()),
                    contexts=(blobs, pa.binary()),
                )

    return map_batches(
        packed.select("pack", "head", "body", "bits"), task, "bucket int, pack long, contexts binary"
    )


def _pairs(cell, name: str) -> list:
    return [(x["bucket"], x[name]) for x in cell] if cell else []


# Suffix sort of the contexts


class Extensions:
    """Suffixes (rows of bytes, all in groups) compared by prefix polynomial hashes."""

    def __init__(self, rows: np.ndarray, lengths: np.ndarray):
        self.rows, self.lengths = rows, lengths
        self.prefix = np.zeros((len(rows), rows.shape[1] + 1), _U)
        for k in range(rows.shape[1]):
            self.prefix[:, k + 1] = mix(self.prefix[:, k] * _U(0xD1342543DE82EF95) + rows[:, k] + _U(1))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common extension of the suffixes ``a`` and ``b`` by binary search, verified on the bytes."""
        low = np.zeros(len(a), np.int64)
        high = np.minimum(self.lengths[a], self.lengths[b])
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            same = self.prefix[a, mid] == self.prefix[b, mid]
            low = np.where(open_ & same, mid, low)
            high = np.where(open_ & ~same, mid - 1, high)
        width = self.rows.shape[1]
        wrong = ((self.rows[a] != self.rows[b]) & (np.arange(width) < low[:, None])).any(1)
        if wrong.any():  # a hash collision: count the bytes
            for i in np.flatnonzero(wrong):
                n = low[i]
                low[i] = np.argmax(np.append(self.rows[a[i]][:n] != self.rows[b[i]][:n], True))
        return low

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffix ``a`` sorts before ``b``; a suffix that ends first goes first, equal ones by number."""
        n = self.common(a, b)
        ended_a, ended_b = n >= self.lengths[a], n >= self.lengths[b]
        last = self.rows.shape[1] - 1
        x, y = self.rows[a, np.minimum(n, last)], self.rows[b, np.minimum(n, last)]
        differ = ~ended_a & ~ended_b
        return np.where(differ, x < y, np.where(ended_a & ended_b, a < b, ended_a))

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Order of the rows within their (ascending, contiguous) groups: all groups are merged in step."""
        n = len(group)
        order = np.arange(n)
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, int)
        sizes = np.diff(np.append(starts, n))
        begin, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
        run = 1
        while n and run < sizes.max():
            active = np.flatnonzero(size > run)
            place = active - begin[active]
            own = place // run
            other = begin[active] + (own ^ 1) * run
            stop = np.minimum(other + run, begin[active] + size[active])
            here = other < begin[active] + size[active]
            low, high = other.copy(), np.where(here, stop, other)
            me = order[active]
            while (open_ := low < high).any():  # how many of the sibling run go before me
                mid = (low + high) // 2
                i = np.flatnonzero(open_)
                less = self.before(order[mid[i]], me[i])
                low[i] = np.where(less, mid[i] + 1, low[i])
                high[i] = np.where(less, high[i], mid[i])
            pair = begin[active] + (own & ~1) * run
            target = pair + (place - own * run) + (low - other)
            merged = order.copy()
            merged[target] = me
            order = merged
            run *= 2
        return order

    def classes(self, group: np.ndarray) -> np.ndarray:
        """Column d: rows of a group with equal numbers agree on their first d bytes (where both are that long)."""
        order = self.sort(group)
        width = self.rows.shape[1]
        shared = np.full(len(order), -1)
        if len(order) > 1:
            same = group[order[1:]] == group[order[:-1]]
            shared[1:] = np.where(same, self.common(order[1:], order[:-1]), -1)
        out = np.zeros((len(order), width + 1), np.int64)
        for d in range(width + 1):
            out[order, d] = np.cumsum(shared < d)
        return out


def repeated_masks(rows: pd.DataFrame) -> pd.DataFrame:
    """(pack, bucket, masks) of one bucket: for each context of a pack, bit l is set if the string that begins l bytes
    before the gram also stands in a document smaller than the smallest one that has the context in the pack."""
    import zstandard

    least, left, right, windows, counts = [], [], [], [], []
    for blob in rows["contexts"]:
        n = struct.unpack("<q", blob[:8])[0]
        raw = zstandard.ZstdDecompressor().decompress(blob[8:], max_output_size=n * (CONTEXT + 10) + 1)
        least.append(np.frombuffer(raw[: 8 * n], np.int64))
        left.append(np.frombuffer(raw[8 * n : 9 * n], np.uint8))
        right.append(np.frombuffer(raw[9 * n : 10 * n], np.uint8))
        windows.append(np.frombuffer(raw[10 * n :], np.uint8).reshape(n, CONTEXT))
        counts.append(n)
    mins, lefts, rights = np.concatenate(least), np.concatenate(left), np.concatenate(right)
    body = np.concatenate(windows)
    # Distinct contexts over all packs, ordered by gram, then by context.
    h = row_hashes(body, lefts, rights)
    gram = np.ascontiguousarray(body[:, REACH : REACH + GRAM]).view(_U)
    order = np.lexsort((h, gram[:, 2], gram[:, 1], gram[:, 0]))
    new_gram = np.ones(len(order), bool)
    new_gram[1:] = (gram[order[1:]] != gram[order[:-1]]).any(1)
    new = new_gram.copy()
    new[1:] |= h[order[1:]] != h[order[:-1]]
    of_context = np.zeros(len(order), np.int64)
    of_context[order] = np.cumsum(new) - 1
    first = order[new]
    smallest = np.minimum.reduceat(mins[order], np.flatnonzero(new))
    group = (np.cumsum(new_gram) - 1)[new]
    masks = np.zeros(len(first), np.uint32)  # filled per packed context below
    holder = np.repeat(smallest[:, None], REACH + 1, 1)  # smallest document with each string of a context
    several = np.flatnonzero(np.bincount(group)[group] > 1)
    if len(several):
        part = body[first[several]]
        sub = group[several]
        ahead = Extensions(part[:, REACH + GRAM :], rights[first[several]].astype(np.int64)).classes(sub)
        back = Extensions(part[:, REACH - 1 :: -1], lefts[first[several]].astype(np.int64)).classes(sub)
        for l in range(REACH + 1):
            fits = (lefts[first[several]] >= l) & (rights[first[several]] >= REACH - l)
            i = np.flatnonzero(fits)
            if not len(i):
                continue
            key = ahead[i, REACH - l] * (len(several) + 1) + back[i, l]
            by = np.argsort(key, kind="stable")
            k = key[by]
            begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            low = np.minimum.reduceat(smallest[several[i[by]]], begin)
            holder[several[i[by]], l] = np.repeat(low, np.diff(np.append(begin, len(k))))
    masks = np.zeros(len(body), np.uint32)
    for l in range(REACH + 1):
        fits = (lefts >= l) & (rights >= REACH - l)
        masks |= ((holder[of_context, l] < mins) & fits).astype(np.uint32) << np.uint32(l)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    out = [squeeze(x.tobytes()) for x in np.split(masks, np.cumsum(counts)[:-1])]
    return pd.DataFrame({"pack": rows["pack"], "bucket": rows["bucket"], "masks": out})


# Removal


def covered_bytes(pack: Pack, bits: list, masks: list, buckets: int) -> np.ndarray:
    """Flags of the pack's bytes that go."""
    import zstandard

    c = contexts_of(pack, bits, buckets)
    cut = np.searchsorted(c.bucket, np.arange(buckets + 1))
    of_entry = np.zeros(len(c.first), np.uint32)
    for b, raw in masks:
        n = int(cut[b + 1] - cut[b])
        plain = zstandard.ZstdDecompressor().decompress(raw, max_output_size=4 * n + 1)
        of_entry[cut[b] : cut[b + 1]] = np.frombuffer(plain, np.uint32)
    mask = of_entry[c.entry]
    later = pack.ids[c.doc] > c.least[c.entry]  # a smaller document of this pack has the whole context
    begins = np.zeros(len(pack.data) + 1, np.int64)
    for l in range(REACH + 1):
        fits = later & (c.left >= l) & (c.right >= REACH - l)
        hit = ((mask >> np.uint32(l)) & np.uint32(1)).astype(bool) | fits
        begins[c.at[hit] - l] = 1
    total = np.concatenate([[0], np.cumsum(begins)])
    place = np.arange(len(pack.data))
    return total[place + 1] > total[np.maximum(place + 1 - MATCH, 0)]


def removed_rows(packed: DataFrame, buckets: int) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for rows in batches:
            for head, body, bits, masks in zip(*(rows.column(k).to_pylist() for k in range(4))):
                pack = open_pack(head, body, powers)
                gone = covered_bytes(pack, _pairs(bits, "bits"), _pairs(masks, "masks"), buckets)
                spans, kept = [], []
                for a, b in zip(pack.bounds, pack.bounds[1:]):
                    own = gone[a:b]
                    if own.any():
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                        spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2])])
                        kept.append(pack.data[a:b][~own].tobytes())
                    else:
                        spans.append([])
                        kept.append(pack.data[a:b].tobytes())
                yield batch(
                    doc_id=([None if z else int(i) for i, z in zip(pack.ids, pack.nulls)], pa.int64()),
                    n_bytes=(np.diff(pack.bounds), pa.int64()),
                    spans=(spans, span),
                    kept=(kept, pa.binary()),
                )

    return map_batches(
        packed.select("head", "body", "bits", "masks"),
        task,
        "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary",
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row (doc_id, text): the byte runs that go, and the bytes that stay."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = staged(packs(docs), "packs")
    bits = (
        gram_rows(packed, buckets).groupBy("bucket").applyInPandas(shared_bits, "pack long, bucket int, bits binary")
    )
    gathered = staged(bits.groupBy("pack").agg(F.collect_list(F.struct("bucket", "bits")).alias("bits")), "gram-bits")
    flagged = packed.join(gathered, "pack", "left")
    masks = (
        context_rows(flagged, buckets)
        .groupBy("bucket")
        .applyInPandas(repeated_masks, "pack long, bucket int, masks binary")
    )
    answers = staged(masks.groupBy("pack").agg(F.collect_list(F.struct("bucket", "masks")).alias("masks")), "masks")
    return removed_rows(flagged.join(answers, "pack", "left"), buckets)


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        "n_bytes",
        F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


#: The same in SQL over the hexadecimal text, two letters a byte.
OP4_SQL = """
WITH raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (
  SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 100)) AS body
  FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS i FROM raw)
), least AS (SELECT body, min(doc_id) AS m FROM starts GROUP BY body HAVING count(*) > 1
), hits AS (
  SELECT s.doc_id, s.i FROM starts s JOIN least l ON l.body = s.body WHERE l.m < s.doc_id
), edges AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM hits
), runs AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (
    SELECT doc_id, i, sum(CASE WHEN prev IS NULL OR i > prev + 50 THEN 1 ELSE 0 END)
      OVER (PARTITION BY doc_id ORDER BY i) AS run FROM edges) GROUP BY doc_id, run
), gaps AS (
  SELECT r.doc_id, r.b AS a, lead(r.a, 1) OVER (PARTITION BY r.doc_id ORDER BY r.a) AS b FROM runs r
), kept AS (
  SELECT g.doc_id, string_agg(substr(w.h, 2 * g.a + 1, 2 * (coalesce(g.b, length(w.h) // 2) - g.a)), '' ORDER BY g.a) AS h
  FROM (SELECT doc_id, a, b FROM gaps UNION ALL SELECT doc_id, 0, min(a) FROM runs GROUP BY doc_id) g
  JOIN raw w ON w.doc_id = g.doc_id GROUP BY g.doc_id
), totals AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT w.doc_id, (length(w.h) // 2)::BIGINT AS n_bytes, coalesce(t.n_removed, 0)::BIGINT AS n_removed,
  coalesce(t.n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k.h, w.h))) AS kept_sha256
FROM raw w LEFT JOIN totals t ON t.doc_id = w.doc_id LEFT JOIN kept k ON k.doc_id = w.doc_id
"""
