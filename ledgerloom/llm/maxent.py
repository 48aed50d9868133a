"""Hashed maximum-entropy language model, trained and scored over all whole texts.

P(word | history) = P(group | history) P(class | group, history) P(word | class). The first two are softmaxes over hashed
features: the previous word, the word before it (a skip), and both together. A class is one frequent word, the end of a
text, or all other words with the same hashed ending; inside it a word has its share of the training count, with one
place for unseen words. Every event thus has a probability and they add up to one.

Training: the texts are passed over once, in ``ROUNDS`` rounds. In each round every task starts from the common
weights, makes gradient updates (Adagrad, mini-batches) over its part of the round's texts, and the tasks' changes are
averaged in a tree, weighted by tokens. Weights have a fixed size (``TABLES``), so what is broadcast doesn't grow.
Counts do: every pack of texts sends each distinct word once with its count, and gets its count in all training texts
back.

Cases: null and empty texts are one end token; a null doc_id counts as the empty id (crc32 of no bytes is 0, so it is
trained on); repeated rows count as often as they occur; without training texts every count is 0 and all scores are of
unseen words; an empty table gives no rows; other columns are ignored. Words are compared by a 64-bit hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import batch, map_batches, staged, table
from ledgerloom.llm.shingles import Powers, mix, word_hashes
from ledgerloom.llm.suffixes import bucket_of, packs

#: Groups, classes of each, and classes of one frequent word (class 0 is the end of a text).
GROUPS, PER_GROUP, FREQUENT = 8, 16, 63
CLASSES = GROUPS * PER_GROUP
#: Values of the hashed ending of a word.
TAILS = 256
#: Rows of the weight table: one bias, then hashed previous word, word before it, and both.
TABLES = (4096, 2048, 4096)
ROWS = 1 + sum(TABLES)
WIDTH = GROUPS + CLASSES
ROUNDS, RATE, BATCH = 3, 0.15, 32_768
#: Rows in which a round's changes travel, and the fan-in of their sums.
BLOCKS, FAN_IN = 16, 32
HELD_OUT_MOD, HELD_OUT = 7, 2
_U = np.uint64
END, BEGIN = mix(np.array([0x45, 0x42], _U))


@dataclass
class Tokens:
    """Tokens of a pack: word hashes with an end after each document, the hashed ending, and document bounds."""

    ids: np.ndarray
    nulls: np.ndarray
    held_out: np.ndarray
    word: np.ndarray
    tail: np.ndarray
    bounds: np.ndarray  # of documents in the tokens

    def training(self) -> np.ndarray:
        return np.repeat(~self.held_out, np.diff(self.bounds))


def tokens_of(head: bytes, body: bytes, powers: Powers) -> Tokens:
    import zstandard

    n = len(head) // 17
    ids, nulls = np.frombuffer(head[: 8 * n], np.int64), np.frombuffer(head[8 * n : 9 * n], np.uint8)
    lengths = np.frombuffer(head[9 * n :], np.int64)
    raw = zstandard.ZstdDecompressor().decompress(body, max_output_size=int(lengths.sum()) + 1).lower()
    ends = np.cumsum(lengths)
    words, tails, counts = [], [], []
    at = 0
    while at < n:  # about a megabyte of texts at a time
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + (1 << 20))))
        begin = int(ends[at] - lengths[at])
        texts = [raw[int(e - k) : int(e)] for e, k in zip(ends[at:stop], lengths[at:stop])]
        w, t, bound = word_hashes(texts, powers)
        assert begin >= 0
        words.append(w)
        tails.append(t)
        counts.append(np.diff(bound))
        at = stop
    count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    bounds = np.concatenate([[0], np.cumsum(count + 1)])
    word = np.full(int(bounds[-1]), END, _U)
    tail = np.zeros(int(bounds[-1]), np.uint8)
    inside = np.ones(len(word), bool)
    inside[bounds[1:] - 1] = False
    word[inside] = np.concatenate(words) if words else []
    tail[inside] = np.concatenate(tails) if tails else []
    crc = [zlib.crc32(b"" if z else str(int(i)).encode()) % HELD_OUT_MOD for i, z in zip(ids, nulls)]
    return Tokens(ids, nulls, np.array(crc, np.int64) == HELD_OUT, word, tail, bounds)


# Counts


def count_rows(packed: DataFrame, buckets: int) -> DataFrame:
    """(bucket, pack, hashes, tails, counts): distinct words of each pack with their training counts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for rows in batches:
            for pack, head, body in zip(*(rows.column(k).to_pylist() for k in range(3))):
                t = tokens_of(head, body, powers)
                hashes, first, index = np.unique(t.word, return_index=True, return_inverse=True)
                counts = np.bincount(index, t.training(), len(hashes)).astype(np.uint32)
                cut = np.searchsorted(bucket_of(hashes, buckets), np.arange(buckets + 1))
                some = np.flatnonzero(cut[1:] > cut[:-1])
                split = lambda x: [x[cut[b] : cut[b + 1]].tobytes() for b in some]
                yield batch(
                    bucket=(some, pa.int32()),
                    pack=([pack] * len(some), pa.int64()),
                    hashes=(split(hashes), pa.binary()),
                    tails=(split(t.tail[first]), pa.binary()),
                    counts=(split(counts), pa.binary()),
                )

    return map_batches(
        packed.select("pack", "head", "body"), task, "bucket int, pack long, hashes binary, tails binary, counts binary"
    )


def summed_counts(rows: pd.DataFrame) -> pd.DataFrame:
    """One bucket: (pack, bucket, counts) for each pack, in its order, and one row of sums (pack null): tokens and
    distinct words of each ending, and the most frequent words."""
    hashes = np.frombuffer(b"".join(rows["hashes"]), _U)
    tails = np.frombuffer(b"".join(rows["tails"]), np.uint8)
    counts = np.frombuffer(b"".join(rows["counts"]), np.uint32)
    known, first, index = np.unique(hashes, return_index=True, return_inverse=True)
    total = np.bincount(index, counts, len(known)).astype(np.int64)
    tail = tails[first]
    is_end = known == END
    column = np.where(is_end, TAILS, tail)  # the end of texts has the last column
    sums = np.stack([np.bincount(column, total, TAILS + 1), np.bincount(column, total > 0, TAILS + 1)]).astype(np.int64)
    order = np.lexsort((known, -total, is_end))
    top = [i for i in order[:FREQUENT] if total[i] > 0 and not is_end[i]]
    frequent = np.array([[known[i].view(np.int64), total[i], tail[i]] for i in top], np.int64).reshape(-1, 3)
    sizes = [len(x) // 8 for x in rows["hashes"]]
    answers = [x.astype(np.uint32 if x.max(initial=0) < 1 << 32 else np.uint64) for x in np.split(total[index], np.cumsum(sizes)[:-1])]
    width = [x.dtype.itemsize for x in answers]
    return pd.DataFrame(
        {
            "pack": pd.array([*rows["pack"], None], "Int64"),
            "bucket": int(rows["bucket"].iloc[0]),
            "width": [*width, 0],
            "counts": [*[x.tobytes() for x in answers], None],
            "sums": [None] * len(rows) + [sums.tobytes()],
            "frequent": [None] * len(rows) + [frequent.tobytes()],
        }
    )


@dataclass
class Vocabulary:
    """Training tokens, distinct words, frequent words in ascending hash order with their class, and class totals."""

    tokens: int
    distinct: int
    frequent: np.ndarray
    frequent_class: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray

    def classes(self, word: np.ndarray, tail: np.ndarray) -> np.ndarray:
        out = 1 + FREQUENT + tail.astype(np.int64) % (CLASSES - 1 - FREQUENT)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, word), len(self.frequent) - 1)
            out = np.where(self.frequent[at] == word, self.frequent_class[at], out)
        out[word == END] = 0
        return out


def vocabulary(answers: DataFrame) -> Vocabulary:
    """From the bucket sums: a fixed number of figures of each bucket comes to the driver, in groups of buckets."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        sums = sum(np.frombuffer(x, np.int64).reshape(2, TAILS + 1) for x in rows["sums"])
        top = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 3) for x in rows["frequent"]])
        top = top[np.lexsort((top[:, 0], -top[:, 1]))][:FREQUENT]
        return pd.DataFrame({"bucket": [0], "sums": [sums.tobytes()], "frequent": [top.tobytes()]})

    partial = (
        answers.where("sums is not null")
        .select((F.col("bucket") % FAN_IN).alias("bucket"), "sums", "frequent")
        .groupBy("bucket")
        .applyInPandas(merge, "bucket int, sums binary, frequent binary")
        .collect()
    )
    out = merge(pd.DataFrame([r.asDict() for r in partial])) if partial else None
    shape = (2, TAILS + 1)
    sums = np.frombuffer(out["sums"][0], np.int64).reshape(shape) if partial else np.zeros(shape, np.int64)
    top = np.frombuffer(out["frequent"][0], np.int64).reshape(-1, 3) if partial else np.zeros((0, 3), np.int64)
    tails = CLASSES - 1 - FREQUENT
    tokens, words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    np.add.at(tokens, 1 + FREQUENT + np.arange(TAILS) % tails, sums[0, :TAILS])
    np.add.at(words, 1 + FREQUENT + np.arange(TAILS) % tails, sums[1, :TAILS])
    tokens[0], words[0] = sums[:, TAILS]
    for k, (_, n, tail) in enumerate(top):
        tokens[1 + k], words[1 + k] = n, 1
        tokens[1 + FREQUENT + tail % tails] -= n
        words[1 + FREQUENT + tail % tails] -= 1
    by = np.argsort(np.ascontiguousarray(top[:, 0]).view(_U))
    return Vocabulary(
        int(sums[0].sum()),
        int(sums[1].sum()),
        np.ascontiguousarray(top[by, 0]).view(_U),
        1 + by,
        tokens,
        words,
    )


# Model


def features(t: Tokens) -> np.ndarray:
    """Rows of the weight table (besides the bias) that each token's history switches on."""
    n = len(t.word)
    one, two = np.full(n, BEGIN, _U), np.full(n, BEGIN, _U)
    one[1:], two[2:] = t.word[:-1], t.word[:-2]
    starts = t.bounds[:-1]
    one[starts] = BEGIN
    two[starts] = BEGIN
    two[np.minimum(starts + 1, n - 1)] = BEGIN
    both = mix(one * _U(3) + mix(two))
    out = np.empty((n, 3), np.int32)
    base = 1
    for k, (h, size) in enumerate(zip((one, mix(two), both), TABLES)):
        out[:, k] = base + (h >> _U(40)).astype(np.int64) % size
        base += size
    return out


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


class Model:
    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.group = weights[:, :GROUPS]
        self.inner = weights[:, GROUPS:].reshape(ROWS, GROUPS, PER_GROUP)

    def logits(self, f: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        outer = self.group[0] + self.group[f[:, 0]] + self.group[f[:, 1]] + self.group[f[:, 2]]
        inner = self.inner[0][group]
        for k in range(3):
            inner = inner + self.inner[f[:, k], group]
        return outer, inner

    def log_class(self, f: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Natural log probability of each token's class."""
        group, place = cls // PER_GROUP, cls % PER_GROUP
        outer, inner = self.logits(f, group)
        i = np.arange(len(cls))
        return _log_softmax(outer)[i, group].astype(float) + _log_softmax(inner)[i, place]


def first_weights(v: Vocabulary) -> np.ndarray:
    """Biases that give the training shares of groups and classes; all else 0."""
    w = np.zeros((ROWS, WIDTH), np.float32)
    share = v.class_tokens + 1.0
    w[0, :GROUPS] = np.log(share.reshape(GROUPS, PER_GROUP).sum(1))
    w[0, GROUPS:] = np.log(share)
    return w


def _updates(weights: np.ndarray, seen: np.ndarray, f: np.ndarray, cls: np.ndarray, rate: float) -> None:
    """One mini-batch of Adagrad in place; ``seen`` sums squared gradients."""
    model = Model(weights)
    group, place = cls // PER_GROUP, cls % PER_GROUP
    outer, inner = model.logits(f, group)
    i = np.arange(len(cls))
    g_outer, g_inner = np.exp(_log_softmax(outer)), np.exp(_log_softmax(inner))
    g_outer[i, group] -= 1
    g_inner[i, place] -= 1
    grad = np.zeros(ROWS * WIDTH)
    outer_at, inner_at = np.arange(GROUPS), GROUPS + group[:, None] * PER_GROUP + np.arange(PER_GROUP)
    for k in range(3):
        row = f[:, k, None].astype(np.int64) * WIDTH
        grad += np.bincount((row + outer_at).ravel(), g_outer.ravel(), len(grad))
        grad += np.bincount((row + inner_at).ravel(), g_inner.ravel(), len(grad))
    grad[:GROUPS] += g_outer.sum(0)
    grad[:WIDTH] += np.bincount(inner_at.ravel(), g_inner.ravel(), WIDTH)
    on = np.flatnonzero(grad)
    g = grad[on].astype(np.float32)
    seen.ravel()[on] += g * g
    weights.ravel()[on] -= rate * g / np.sqrt(seen.ravel()[on] + 1.0)


def train_round(packed: DataFrame, v: Vocabulary, weights: np.ndarray, turn: int) -> np.ndarray:
    """Weights after one round over the texts of ``packed``."""
    spark = packed.sparkSession
    shared = spark.sparkContext.broadcast(weights)  # fixed size: ROWS x WIDTH
    rate = RATE / (1 + turn)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        own, seen, tokens, powers = shared.value.copy(), np.zeros((ROWS, WIDTH), np.float32), 0, Powers()
        for rows in batches:
            for head, body in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                t = tokens_of(head, body, powers)
                chosen = np.flatnonzero(t.training())
                f, cls = features(t)[chosen], v.classes(t.word, t.tail)[chosen]
                for at in range(0, len(cls), BATCH):
                    _updates(own, seen, f[at : at + BATCH], cls[at : at + BATCH], rate)
                tokens += len(cls)
        if tokens:
            change = np.array_split((own - shared.value).ravel().astype(np.float16), BLOCKS)
            salt = TaskContext.get().partitionId() % FAN_IN
            squeeze = zstandard.ZstdCompressor(level=1).compress
            yield batch(
                block=(list(range(BLOCKS)), pa.int32()),
                salt=([salt] * BLOCKS, pa.int32()),
                tokens=([float(tokens)] * BLOCKS, pa.float64()),
                change=([squeeze(c.tobytes()) for c in change], pa.binary()),
            )

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        total, out = rows["tokens"].sum(), 0.0
        for n, raw in zip(rows["tokens"], rows["change"]):
            plain = zstandard.ZstdDecompressor().decompress(raw, max_output_size=4 * ROWS * WIDTH)
            out = out + np.frombuffer(plain, np.float16).astype(np.float32) * (n / total)
        made = zstandard.ZstdCompressor(level=1).compress(out.astype(np.float16).tobytes())
        return pd.DataFrame(
            {"block": rows["block"].iloc[:1], "salt": [0], "tokens": [total], "change": [made]}
        )

    kind = "block int, salt int, tokens double, change binary"
    changes = map_batches(packed.select("head", "body"), task, kind)
    merged = (
        changes.groupBy("block", "salt").applyInPandas(mean, kind).groupBy("block").applyInPandas(mean, kind).collect()
    )
    shared.unpersist()
    if not merged:
        return weights
    import zstandard

    plain = [
        zstandard.ZstdDecompressor().decompress(r.change, max_output_size=4 * ROWS * WIDTH)
        for r in sorted(merged, key=lambda r: r.block)
    ]
    change = np.concatenate([np.frombuffer(x, np.float16) for x in plain]).astype(np.float32)
    return weights + change.reshape(ROWS, WIDTH)


def score_rows(packed: DataFrame, v: Vocabulary, weights: np.ndarray, buckets: int) -> DataFrame:
    shared = packed.sparkSession.sparkContext.broadcast(weights)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, model = Powers(), Model(shared.value)
        for rows in batches:
            for head, body, answers in zip(*(rows.column(k).to_pylist() for k in range(3))):
                t = tokens_of(head, body, powers)
                index = np.unique(t.word, return_inverse=True)[1]
                got = [
                    np.frombuffer(a["counts"], np.uint32 if a["width"] == 4 else np.uint64).astype(np.int64)
                    for a in sorted(answers, key=lambda a: a["bucket"])
                ]
                c = np.concatenate(got)[index]
                f, cls = features(t), v.classes(t.word, t.tail)
                base = np.log10((c + 1) / (v.tokens + v.distinct + 1))
                score = np.log10((c + 1) / (v.class_tokens + v.class_words + 1)[cls])
                for at in range(0, len(cls), BATCH):
                    part = slice(at, at + BATCH)
                    score[part] += model.log_class(f[part], cls[part]) / np.log(10)
                first, n = t.bounds[:-1], len(t.ids)
                yield batch(
                    doc_id=([None if z else int(i) for i, z in zip(t.ids, t.nulls)], pa.int64()),
                    held_out=(t.held_out, pa.bool_()),
                    n_tokens=(np.diff(t.bounds), pa.int64()),
                    n_known=(np.add.reduceat((c > 0).astype(np.int64), first), pa.int64()),
                    train_tokens=(np.full(n, v.tokens), pa.int64()),
                    base_score=(np.add.reduceat(base, first), pa.float64()),
                    score=(np.add.reduceat(score, first), pa.float64()),
                )

    return map_batches(
        packed.select("head", "body", "answers"),
        task,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


def train_and_score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row (doc_id, text)."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = staged(packs(docs), "packs")
    answers = staged(
        count_rows(packed, buckets)
        .groupBy("bucket")
        .applyInPandas(
            summed_counts, "pack long, bucket int, width int, counts binary, sums binary, frequent binary"
        ),
        "word-counts",
    )
    v = vocabulary(answers)
    weights = first_weights(v)
    for turn in range(ROUNDS):
        weights = train_round(packed.where(F.pmod(F.xxhash64("pack"), F.lit(ROUNDS)) == turn), v, weights, turn)
    gathered = (
        answers.where("pack is not null")
        .groupBy("pack")
        .agg(F.collect_list(F.struct("bucket", "width", "counts")).alias("answers"))
    )
    return score_rows(packed.join(gathered, "pack"), v, weights, buckets)


def op2_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_and_score(table(spark, sf_dir, "documents").select("doc_id", "text"))
