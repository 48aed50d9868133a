"""Periodic runs of words by online dyadic square catching.

A square of period q (q words, then the same again) has a whole dyadic block of L words in its first half, where L is the power
of two with 2L - 1 <= q <= 4L - 2. A block becomes a catcher when its last word has been appended. Every later word ends a window
of L words; where the window equals the block (two polynomial hashes modulo primes), the two lie q apart, and suffix
comparisons by binary search over prefix hashes say how far left the words q apart agree. To the right each appended word
advances the comparison until it fails. As soon as q words agree the square is reported; the squares of one stretch are one run.
The same stretch at a multiple of its period is the same run. Every run is compared word by word before it is returned;
where a hash collision shows, the text is searched again by plain comparison.

Texts of a batch form one stream with a separator of its own after each, which no other word equals, so numpy works on
many short texts at once. A block and its window are never more than four blocks apart, and only the first of neighbouring
matches of a stretch is followed, so work is words x log(words) for any text.

No shuffle: each row is searched by itself. Cases: null, empty and blank texts have no words and no run; repeated rows give
repeated results; an empty table gives no rows; of the input only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import batch, map_batches, table, words_of

#: Least number of words of a run.
LEAST = 12
#: Words after which a stream of texts is searched.
STREAM = 200_000
_PRIMES = (np.uint64(2147483647), np.uint64(2147483629))
_BASES = (np.uint64(1103515245), np.uint64(362436069))
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class _Prefixes:
    """Prefix hashes of a growing sequence of word numbers, modulo two primes."""

    def __init__(self) -> None:
        self.size = 0
        self.sums = [np.zeros(1, np.uint64) for _ in _PRIMES]
        self.powers = [np.ones(1, np.uint64) for _ in _PRIMES]

    def append(self, words: np.ndarray) -> None:
        end = self.size + len(words)
        for k, (prime, base) in enumerate(zip(_PRIMES, _BASES)):
            while len(self.powers[k]) <= end:
                known = self.powers[k]
                step = known[-1] * base % prime
                self.powers[k] = np.concatenate([known, known * step % prime])
            terms = (words.astype(np.uint64) + np.uint64(1)) % prime * self.powers[k][self.size : end] % prime
            # below 2^31 each, so the sum of 2^32 of them fits
            more = (self.sums[k][self.size] + np.cumsum(terms)) % prime
            room = len(self.sums[k])
            if end >= room:
                grown = np.zeros(max(2 * room, end + 1), np.uint64)
                grown[: self.size + 1] = self.sums[k][: self.size + 1]
                self.sums[k] = grown
            self.sums[k][self.size + 1 : end + 1] = more
        self.size = end

    def equal(self, left: np.ndarray, apart: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the words from ``left`` equal those ``apart`` further on, over ``length`` words."""
        same = np.ones(len(left), bool)
        for prime, sums, powers in zip(_PRIMES, self.sums, self.powers):
            a = sums[left + length] + prime - sums[left]
            b = sums[left + apart + length] + prime - sums[left + apart]
            same &= a % prime * powers[apart] % prime == b % prime
        return same


class Catchers:
    """Squares and runs of a sequence to which words are appended, one or many at a time. ``longest``: words of the
    longest text, where separators part several; no square is longer."""

    def __init__(self, longest: int | None = None) -> None:
        self.longest = longest
        self.words = self._buffer = np.zeros(0, np.int64)
        self.prefixes = _Prefixes()
        #: Windows already compared, by block length.
        self.done: dict[int, int] = {}
        #: Stretches that may go on, as rows (period, start, end): words ``period`` apart agree from start to end.
        self.open = np.zeros((0, 3), np.int64)
        self.closed: list[np.ndarray] = []

    def append(self, words: np.ndarray) -> np.ndarray:
        """New squares as rows (start, period): the first of each stretch whose squares begin with these words."""
        n = len(self.words) + len(words)
        if n > len(self._buffer):
            self._buffer = np.concatenate([self.words, np.zeros(max(n, 64), np.int64)])
        self._buffer[len(self.words) : n] = words
        self.words = self._buffer[:n]
        self.prefixes.append(words)
        before = self.open.copy()
        after = self._advanced(self.open)
        grown = after[(after[:, 2] - after[:, 1] >= after[:, 0]) & (before[:, 2] - before[:, 1] < before[:, 0])]
        known = {(q, s) for q, s, _ in after.tolist()}
        found = [self._caught(L, n) for L in self._blocks(n)]
        fresh = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        if len(fresh):
            fresh = np.unique(fresh, axis=0)
            fresh = fresh[[(q, s) not in known for q, s, _ in fresh.tolist()]]
        squares = fresh[fresh[:, 2] - fresh[:, 1] >= fresh[:, 0]]
        every = np.concatenate([after, fresh])
        still = every[:, 2] + every[:, 0] == n
        over = every[~still]
        self.closed.append(over[over[:, 2] - over[:, 1] >= over[:, 0]])
        self.open = every[still]
        return np.concatenate([grown, squares])[:, [1, 0]]

    def runs(self, least: int = LEAST) -> np.ndarray:
        """Runs so far of ``least`` words or more as rows (start, length, period) by start, then period."""
        rows = np.concatenate([*self.closed, self.open[self.open[:, 2] - self.open[:, 1] >= self.open[:, 0]]])
        rows = np.unique(rows[rows[:, 2] - rows[:, 1] + rows[:, 0] >= least], axis=0)
        if not len(rows):
            return np.zeros((0, 3), np.int64)
        period, start, end = rows.T
        end = end + period
        # the smallest period of each stretch
        order = np.lexsort((period, end, start))
        period, start, end = period[order], start[order], end[order]
        own = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])])
        out = np.stack([start[own], (end - start)[own], period[own]], axis=1)
        if not all(self._true(*row) for row in out.tolist()):
            exact = plain_runs(self.words)
            return exact[exact[:, 1] >= least]
        return out[np.lexsort((out[:, 2], out[:, 0]))]

    def _blocks(self, n: int) -> list[int]:
        out, L = [], 1
        n = n if self.longest is None else min(n, self.longest)
        while 2 * (2 * L - 1) <= n:
            out.append(L)
            L *= 2
        return out

    def _caught(self, L: int, n: int) -> np.ndarray:
        """Stretches that the catchers of blocks of ``L`` words see in the windows not compared yet."""
        low = max(self.done.get(L, 0), 2 * L - 1)
        windows = np.arange(low, n - L + 1)
        self.done[L] = max(low, n - L + 1)
        blocks, apart = [], []
        for back in range(1, 4):
            # the block of a window is one that lies 2L - 1 to 4L - 2 words before it
            b = (windows // L - back) * L
            q = windows - b
            fit = (b >= 0) & (q >= 2 * L - 1) & (q <= 4 * L - 2)
            b, q = b[fit], q[fit]
            if L == 1:
                same = self.words[b] == self.words[b + q]
            else:
                # cheap first: the first and last word
                same = (self.words[b] == self.words[b + q]) & (self.words[b + L - 1] == self.words[b + q + L - 1])
                b, q = b[same], q[same]
                same = self.prefixes.equal(b, q, np.full(len(b), L))
            blocks.append(b[same])
            apart.append(q[same])
        b, q = np.concatenate(blocks), np.concatenate(apart)
        if not len(b):
            return np.zeros((0, 3), np.int64)
        order = np.lexsort((b, q))
        b, q = b[order], q[order]
        new = np.concatenate([[True], (q[1:] != q[:-1]) | (b[1:] != b[:-1] + L)])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(b)]]) - 1
        period = q[first]
        start = b[first] - self._left(b[first], period)
        rows = np.stack([period, start, b[last] + L], axis=1)
        return self._advanced(rows)

    def _left(self, at: np.ndarray, period: np.ndarray) -> np.ndarray:
        """How many words before ``at`` agree with those ``period`` further on."""
        low, high = np.zeros(len(at), np.int64), at.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.prefixes.equal(at - mid, period, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def _advanced(self, rows: np.ndarray) -> np.ndarray:
        """Stretches (period, start, end) with their ends moved right over all words that agree."""
        if not len(rows):
            return rows
        period, start, end = rows.T
        low, high = np.zeros(len(end), np.int64), len(self.words) - period - end
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.prefixes.equal(end, period, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return np.stack([period, start, end + low], axis=1)

    def _true(self, start: int, length: int, period: int) -> bool:
        w, end = self.words, start + length
        return (
            np.array_equal(w[start : end - period], w[start + period : end])
            and (start == 0 or w[start - 1] != w[start - 1 + period])
            and (end == len(w) or w[end] != w[end - period])
        )


def plain_runs(words: np.ndarray) -> np.ndarray:
    """The same runs by comparing all words at every distance: the exact way after a hash collision."""
    found: dict[tuple[int, int], int] = {}
    n = len(words)
    for q in range(1, n // 2 + 1):
        same = np.concatenate([[False], words[:-q] == words[q:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in edges.reshape(-1, 2).tolist():
            if b - a >= q:
                found.setdefault((a, b + q), q)
    rows = sorted((a, b - a, q) for (a, b), q in found.items())
    rows.sort(key=lambda r: (r[0], r[2]))
    return np.array(rows, np.int64).reshape(-1, 3)


def stream_runs(texts: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each list of words, searched as one stream."""
    numbers: dict[bytes, int] = {}
    ids, begin = [], []
    for k, words in enumerate(texts):
        begin.append(len(ids))
        ids.extend(numbers.setdefault(w, len(numbers)) for w in words)
        ids.append(-1 - k)
    stream = np.array(ids, np.int64)
    # separators get the numbers after the words, so that all are small and distinct
    stream = np.where(stream < 0, len(numbers) - 1 - stream, stream)
    catchers = Catchers(max(map(len, texts), default=0))
    catchers.append(stream)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    starts = np.array(begin, np.int64)
    for start, length, period in catchers.runs(least).tolist():
        k = int(np.searchsorted(starts, start, side="right")) - 1
        out[k].append((start - begin[k], length, period))
    return out


def _streams(words: list[list[bytes]]) -> Iterator[list[int]]:
    """Places of the texts by length, in groups of about ``STREAM`` words."""
    held, size = [], 0
    for k in sorted(range(len(words)), key=lambda k: len(words[k])):
        held.append(k)
        size += len(words[k])
        if size >= STREAM:
            yield held
            held, size = [], 0
    if held:
        yield held


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without the repetitions: a run keeps its first period, unless another run drops it."""
    if not runs:
        return b" ".join(words)
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    gone = np.cumsum(drop)[:-1] > 0
    return b" ".join(w for w, g in zip(words, gone.tolist()) if not g)


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row (doc_id, text): all runs of ``least`` words or more by start,
    then period, as structs of start, length and period, and the text without repetitions, one space between words."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            words = [words_of(t) for t in rows.column(1).to_pylist()]
            # texts of like length share a stream: the longest one decides how many block lengths there are
            found: list = [None] * len(words)
            for stream in _streams(words):
                for k, runs in zip(stream, stream_runs([words[k] for k in stream], least)):
                    found[k] = runs
            yield batch(
                doc_id=rows.column(0),
                n_words=([len(w) for w in words], pa.int64()),
                runs=([[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in found], _RUNS),
                collapsed=([collapsed(w, runs).decode() for w, runs in zip(words, found)], pa.string()),
            )

    return map_batches(
        docs.select("doc_id", "text"),
        task,
        "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string",
    )


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0b\\f\\r]+"), lambda w: w != "")


def with_repetitions(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where one id in ten has the end of its text replaced by repetitions of a stretch of it.

    With h the crc32 of the id and g = h div 10, h % 10 = 0: of n words, those from a = g % n on repeat with period
    1 + (n - a) div (3 + g % 8).
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    parts = (
        docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, word_list(F.col("text"))).alias("w"))
        .withColumn("g", F.expr("h div 10"))
        .withColumn("n", F.size("w").cast("long"))
        .withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
        .withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    )
    planted = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, get(w, cast(a + (i - a) % p as int)))), ' ')")
    return parts.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_repetitions(table(spark, sf_dir, "documents")))
    # the longest, then the first, then the smallest period
    best = F.expr("array_min(transform(runs, r -> struct(-r.length as shorter, r.start, r.period, r.length)))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.select("doc_id", "runs", "collapsed", F.when(F.size("runs") > 0, best).alias("best")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000L div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
