"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Words are folded (lower case, look-alike digits and signs as letters, stretched letters shortened) and cut into pieces of five characters with the
word's borders marked. The model is fitted on a bounded sample of the labelled texts (``FIT_ROWS``). Spark counts in how many of them of either
class each folded word and piece occurs; the significant ones, with their log odds, are the lexicon. A text becomes ``FEATURES``: lexicon densities and weights,
how near the hits are to second-person words, capitals, punctuation and obfuscation rates. Trees of few levels are
boosted on them. Labelled texts are dealt into ``FOLDS`` by id: a fold's features come from the lexicon of the
others, and the isotonic calibration learns from margins of trees that didn't see the text.

Scale: the sample is one row of each bucket of hashed ids, joined to the texts by broadcast (its size is bounded); terms are counted
with partial sums; the lexicon (``TERMS``) and the trees are of fixed size; scoring is one pass over all whole texts without a shuffle.

Cases: null, empty and blank texts have all features 0 and the score that the trees give that; a document with several labels counts
as toxic if any says so; labels without a document and null labels are ignored; of several texts of one id the smallest is learned from; without labels of both classes the score is the
share of toxic ones (0 without any) for every text; null ids count as the empty id and have no label; repeated rows give repeated
results; an empty table gives no rows; of the input only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import Recent, batch, bounded_sample, id_remainder, map_batches, staged, table, words_of

#: Folds of the labelled texts; bound of the labelled rows that lexicon, trees and calibration are fitted on.
FOLDS, FIT_ROWS = 3, 10_000
#: Bound of the lexicon; least standard errors between the classes, and least toxic texts, for a term to be in it.
TERMS, LEAST_SIGNIFICANCE, LEAST_TEXTS = 4096, 5.0, 3
PIECE = 5
#: Trees, their depth, the step, leaf regularisation, least rows of a leaf, and bins of a feature.
TREES, DEPTH, STEP, RIDGE, LEAF, BINS = 60, 3, 0.15, 1.0, 5, 64
#: A score from here on is a prediction of 1.
THRESHOLD = 0.7
#: Words to either side of a hit in which a second-person word counts as near.
NEAR = 5
#: Terms that a task counts before it passes partial sums on.
HELD_TERMS = 200_000

# Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos ti tú usted ustedes".split()
)
# Characters that stand for letters in disguised words.
_LOOKALIKE = str.maketrans("013457@$!€", "oieastasie")
_STRETCHED = re.compile(r"(.)\1{2,}", re.S)
_MARKS = frozenset("!?.,;:")

FEATURES = (
    "word_hits",
    "piece_hits",
    "weight",
    "largest",
    "count",
    "near",
    "second_person",
    "capitals",
    "shouted",
    "exclaimed",
    "marks",
    "disguised",
    "stretched",
    "spelled",
    "words",
)


def folded(word: str) -> str:
    """Lower case without outer marks; look-alikes inside a word that has letters, and stretched letters, undone."""
    core = word.lower().strip("!?.,;:\"'()[]{}|<>-_*#%&~")
    if not core.isalpha():
        if any(map(str.isalpha, core)):
            core = core.translate(_LOOKALIKE)
        core = "".join(filter(str.isalnum, core))
    return _STRETCHED.sub(r"\1\1", core) if _STRETCHED.search(core) else core


def terms_of(word: str) -> list[str]:
    """Lexicon terms of a folded word: itself, between borders, and its pieces."""
    marked = f"^{word}$"
    pieces = [marked[i : i + PIECE] for i in range(len(marked) - PIECE + 1)]
    # a whole word has both borders, so it never equals a piece unless it is one
    return [marked, *pieces] if len(marked) > PIECE else [marked]


def term_counts(texts: DataFrame) -> DataFrame:
    """(term, fold, toxic, texts): in how many texts of (text, fold, toxic) each term occurs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_word = Recent(lambda w: terms_of(f) if (f := folded(w.decode())) else [], 100_000)
        held: dict[tuple[int, int], Counter] = defaultdict(Counter)

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (fold, toxic), counts in held.items():
                n = len(counts)
                yield batch(
                    term=(list(counts), pa.string()),
                    fold=(np.full(n, fold), pa.int32()),
                    toxic=(np.full(n, toxic), pa.int32()),
                    texts=(list(counts.values()), pa.int64()),
                )
            held.clear()

        for rows in batches:
            for text, fold, toxic in zip(*(rows.column(k).to_pylist() for k in range(3))):
                distinct: set[str] = set()
                distinct.update(*[of_word[w] for w in set(words_of(text))])
                held[fold, toxic].update(distinct)
                if sum(map(len, held.values())) > HELD_TERMS:
                    yield from passed_on()
        yield from passed_on()

    counted = map_batches(texts.select("text", "fold", "toxic"), task, "term string, fold int, toxic int, texts long")
    return counted.groupBy("term", "fold", "toxic").agg(F.sum("texts").alias("texts"))


@dataclass(frozen=True)
class Lexicon:
    """Log odds of whole words (between borders) and of pieces."""

    weights: dict[str, float]

    def of(self, word: str) -> tuple[float, float]:
        """(weight as a word, largest weight of a piece) of a folded word; 0 where it is not in the lexicon."""
        marked, found = f"^{word}$", self.weights
        pieces = [found[p] for i in range(len(marked) - PIECE + 1) if (p := marked[i : i + PIECE]) in found]
        return found.get(marked, 0.0), max(pieces) if pieces else 0.0


def lexicons(counts: DataFrame, totals: dict[tuple[int, int], int]) -> list[Lexicon]:
    """The lexicon of all folds, then for each fold that of the others. ``totals``: texts by (fold, toxic)."""
    wide = counts.groupBy("term").agg(
        *[
            F.coalesce(F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == x), F.col("texts"))), F.lit(0)).alias(f"t{f}{x}")
            for f in range(FOLDS)
            for x in (0, 1)
        ]
    )
    wide = staged(wide.where(" + ".join(f"t{f}1" for f in range(FOLDS)) + f" >= {LEAST_TEXTS}"), "lexicon-counts")
    out = []
    for left_out in (None, *range(FOLDS)):
        folds = [f for f in range(FOLDS) if f != left_out]
        n1, n0 = (sum(totals.get((f, x), 0) for f in folds) for x in (1, 0))
        if not n1 or not n0:
            out.append(Lexicon({}))
            continue
        k1, k0 = (F.expr(" + ".join(f"t{f}{x}" for f in folds)) for x in (1, 0))
        p1, p0 = (k1 + 0.5) / (n1 + 1), (k0 + 0.5) / (n0 + 1)
        shared = (k1 + k0 + 1) / (n1 + n0 + 2)
        z = (p1 - p0) / F.sqrt(shared * (1 - shared) * (1 / n1 + 1 / n0))
        odds = F.log(p1 * (1 - p0) / (p0 * (1 - p1)))
        chosen = (
            wide.select("term", k1.alias("k1"), z.alias("z"), odds.alias("odds"))
            .where((F.col("k1") >= LEAST_TEXTS) & (F.col("z") >= LEAST_SIGNIFICANCE))
            .orderBy(F.desc("z"), "term")
            .limit(TERMS)
        )
        out.append(Lexicon({r.term: r.odds for r in chosen.collect()}))
    return out


class Describer:
    """Features of texts by one lexicon. What belongs to a word alone is a profile, worked out once for each distinct
    word; a text is looked up as the profiles of its words."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.profile_of = Recent(self._profile, 200_000)
        self.numbers: dict[tuple[float, ...], int] = {}
        self.profiles = np.zeros((1024, 11))

    def _profile(self, raw: bytes) -> int:
        word = raw.decode()
        if raw.islower() and raw.isalpha() and not _STRETCHED.search(word):  # most words: nothing to fold or count
            profile = (*self.lexicon.of(word), word in SECOND_PERSON, len(word), 0, False, False, 0, False, False, len(word) == 1)
        else:
            profile = self._word(word)
        number = self.numbers.setdefault(profile, len(self.numbers))
        if number == len(self.profiles):
            self.profiles = np.concatenate([self.profiles, np.zeros_like(self.profiles)])
        self.profiles[number] = profile
        return number

    def _word(self, word: str) -> tuple[float, ...]:
        inner = word.strip("!?.,;:\"'()[]{}|<>-_")
        if inner.isalpha():
            letters, signs = len(inner), 0
            upper = 0 if inner.islower() else sum(map(str.isupper, inner))
        else:
            letters, upper = sum(map(str.isalpha, word)), sum(map(str.isupper, word))
            signs = len(inner) - sum(map(str.isalpha, inner))
        core = folded(word)
        whole, piece = self.lexicon.of(core) if core else (0.0, 0.0)
        outer = len(inner) != len(word)
        return (
            whole,
            piece,
            core in SECOND_PERSON,
            letters,
            upper,
            letters >= 3 and upper == letters,
            outer and ("!" in word or "?" in word),
            sum(c in _MARKS for c in word) if outer or signs else 0,
            0 < signs < len(inner),
            _STRETCHED.search(word) is not None,
            letters == 1 and len(inner) == 1,
        )

    def describe(self, text: str | None) -> list[float]:
        words = words_of(text)
        n = len(words)
        if not n:
            return [0.0] * len(FEATURES)
        numbers = np.fromiter(map(self.profile_of.__getitem__, words), np.int64, n)
        rows = self.profiles[numbers]
        sums = rows.sum(axis=0)
        weight = np.maximum(rows[:, 0], rows[:, 1])
        hits = np.flatnonzero(weight)
        near = spelled = 0
        if len(hits) and sums[2]:
            seen = np.concatenate([[0], np.cumsum(rows[:, 2])])
            near = (seen[np.minimum(hits + NEAR + 1, n)] > seen[np.maximum(hits - NEAR, 0)]).sum()
        if sums[10] > 1:
            spelled = (rows[1:, 10] * rows[:-1, 10]).sum()
        return [
            np.count_nonzero(rows[:, 0]) / n,
            np.count_nonzero(rows[:, 1]) / n,
            weight.sum() / np.sqrt(n),
            weight.max(),
            np.log1p(len(hits)),
            near / n,
            sums[2] / n,
            sums[4] / max(sums[3], 1.0),
            sums[5] / n,
            sums[6] / n,
            sums[7] / n,
            sums[8] / n,
            sums[9] / n,
            spelled / n,
            np.log1p(n),
        ]


@dataclass(frozen=True)
class Trees:
    """Boosted trees of equal depth as arrays: feature and threshold of each inner node, value of each leaf; a value at
    or above the threshold goes right."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] >= threshold[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic boosting by second-order gains over binned features."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    # a feature that is mostly one value has its quantiles there, so the quantiles of the rest go in as well
    for j in range(x.shape[1]):
        rest = x[x[:, j] > x[:, j].min(), j]
        if len(rest):
            cuts[j] = np.unique(np.concatenate([cuts[j], np.quantile(rest, np.linspace(0, 1, BINS + 1)[:-1])]))
    bins = np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)], axis=1)
    width = max(len(c) for c in cuts) + 1
    inner = 2**DEPTH - 1
    margin = np.full(len(y), start)
    features, thresholds, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for k in range(inner):
            mine = np.flatnonzero(node == k)
            best = (1e-9, 0, np.inf)
            for j, c in enumerate(cuts):
                if len(mine) < 2 * LEAF or not len(c):
                    continue
                b = bins[mine, j]
                gs, hs, ns = (np.bincount(b, w, width) for w in (g[mine], h[mine], None))
                gl, hl, nl = np.cumsum(gs)[:-1], np.cumsum(hs)[:-1], np.cumsum(ns)[:-1]
                gt, ht = gs.sum(), hs.sum()
                gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(nl < LEAF) | (len(mine) - nl < LEAF)] = -1
                top = int(np.argmax(gain))
                if gain[top] > best[0] and top < len(c):
                    best = (gain[top], j, c[top])
            feature[k], threshold[k] = best[1], best[2]
            node[mine] = 2 * k + 1 + (x[mine, best[1]] >= best[2])
        node -= inner
        gs, hs = np.bincount(node, g, inner + 1), np.bincount(node, h, inner + 1)
        leaf = -STEP * gs / (hs + RIDGE)
        margin += leaf[node]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(start, np.array(features), np.array(thresholds), np.array(leaves))


@dataclass(frozen=True)
class Isotonic:
    """A non-decreasing map of margins to probabilities: straight between the centres of pooled blocks."""

    at: np.ndarray
    value: np.ndarray

    @classmethod
    def fit(cls, margin: np.ndarray, y: np.ndarray) -> "Isotonic":
        """Pool adjacent violators."""
        points, where = np.unique(margin, return_inverse=True)
        weight = np.bincount(where).astype(float)
        total = np.bincount(where, y)
        blocks: list[list[float]] = []
        for x, w, s in zip(points, weight, total):
            blocks.append([x * w, w, s])
            while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
        at, value = (np.array(v) for v in zip(*[(x / w, s / w) for x, w, s in blocks]))
        return cls(at, value)

    def probabilities(self, margin: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(margin, self.at, self.value), 0.0, 1.0)


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    trees: Trees | None
    calibration: Isotonic | None
    share: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(x):
            return np.full(len(x), self.share)
        return self.calibration.probabilities(self.trees.margins(x))


def _described(texts: DataFrame, found: list[Lexicon]) -> DataFrame:
    """(doc_id, fold, toxic, x) of rows (doc_id, text, fold, toxic), each by the lexicon of the other folds."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        describers = [Describer(lexicon) for lexicon in found[1:]]
        for rows in batches:
            x = [describers[f].describe(t) for t, f in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist())]
            yield batch(
                doc_id=rows.column(0), fold=rows.column(2), toxic=rows.column(3), x=(x, pa.list_(pa.float64()))
            )

    return map_batches(
        texts.select("doc_id", "text", "fold", "toxic"), task, "doc_id long, fold int, toxic int, x array<double>"
    )


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """The model of the texts (doc_id, text) that have labels (doc_id, toxic)."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("doc_id")
        .agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    )
    known = known.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int"))
    picked = bounded_sample(docs.select("doc_id").join(known, "doc_id"), ["doc_id", "fold", "toxic"], "doc_id", FIT_ROWS)
    totals = Counter((r.fold, r.toxic) for r in picked)
    both = [sum(n for (_, x), n in totals.items() if x == c) for c in (0, 1)]
    share = both[1] / max(sum(both), 1)
    if not all(both):
        return ToxicityModel(Lexicon({}), None, None, share)
    # at most FIT_ROWS ids, each with one text
    few = docs.sparkSession.createDataFrame(picked, "doc_id long, fold int, toxic int")
    texts = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    texts = staged(texts.groupBy("doc_id", "fold", "toxic").agg(F.min("text").alias("text")), "labelled-texts")
    found = lexicons(term_counts(texts), totals)
    rows = sorted(_described(texts, found).collect(), key=lambda r: r.doc_id)
    x = np.array([r.x for r in rows], float).reshape(len(rows), len(FEATURES))
    y, fold = (np.array([r[c] for r in rows], float) for c in ("toxic", "fold"))
    margin = np.zeros(len(y))
    for f in range(FOLDS):
        out = fold == f
        if out.any():
            margin[out] = (boost(x[~out], y[~out]) if (~out).any() else boost(x, y)).margins(x[out])
    return ToxicityModel(found[0], boost(x, y), Isotonic.fit(margin, y), share)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) and the other columns given, of every row (doc_id, text, held_out)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        describer = Describer(model.lexicon)
        for rows in batches:
            x = np.array([describer.describe(t) for t in rows.column(1).to_pylist()], float).reshape(-1, len(FEATURES))
            yield batch(doc_id=rows.column(0), held_out=rows.column(2), score=(model.scores(x), pa.float64()))

    return map_batches(docs.select("doc_id", "text", "held_out"), task, "doc_id long, held_out boolean, score double")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", id_remainder(F.col("doc_id"), 3) == 1)
    model = fit(docs.where(~F.col("held_out")), table(spark, sf_dir, "labels"))
    return score(docs, model).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
