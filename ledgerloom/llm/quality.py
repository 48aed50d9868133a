"""Quality rules as a learned decision list.

Statistics of every whole text come from one pass. Sequential covering (grow a conjunction of thresholds by information
gain, prune it on held-back rows, remove what it covers, repeat) learns from labelled statistics which documents to
reject. The list is emitted as one ordered Spark conditional expression.

Cases: null text counts as empty (no words, base_failed); no labels gives an empty list that keeps every document; a
document with several labels takes the smallest; labels without a document and null labels are ignored; repeated rows
give repeated results; other columns are ignored, and ``keep_good`` returns the input's columns whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import batch, bounded_sample, fresh, map_batches, staged, table

#: Bound of the labelled rows that the list is fitted on.
FIT_ROWS = 20_000
#: Candidate thresholds of a feature from each class, conditions of a rule, rules of the list, least precision on held-back rows.
THRESHOLDS, MAX_CONDITIONS, MAX_RULES, MIN_PRECISION = 32, 4, 24, 0.9
#: A rule must cover so many rejected rows among the grown ones.
MIN_COVER = 5
_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_MARKS = b"!?.,;:"

COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper",
    "n_digits",
    "n_marks",
    "n_distinct",
)
#: Scale-free features of the rules: (name, numerator, denominator).
RATIOS = (
    ("word_length", "word_chars", "n_words"),
    ("symbols", "n_symbols", "n_words"),
    ("dup_lines", "n_dup_lines", "n_lines"),
    ("repeats", "n_repeat_words", "n_words"),
    ("upper", "n_upper", "word_chars"),
    ("digits", "n_digits", "word_chars"),
    ("marks", "n_marks", "n_words"),
    ("distinct", "n_distinct", "n_words"),
    ("line_words", "n_words", "n_lines"),
)


def repeated_words(words: list) -> int:
    """Words inside three-word windows that occur at least twice in the list, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen, twice = set(), set()
    for w in windows:
        (twice if w in seen else seen).add(w)
    covered = end = 0
    for i, w in enumerate(windows):
        if w in twice:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def text_counts(text: str | None) -> tuple[int, ...]:
    raw = (text or "").encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACES)]
    without = lambda drop: len(raw) - len(raw.translate(None, drop))
    return (
        len(words),
        len(text or "") - without(_SPACES),
        without(_SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        without(_UPPER),
        without(_DIGITS),
        without(_MARKS),
        len(set(words)),
    )


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The id column ``doc_id`` and ``COUNTS`` of every row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            counts = [text_counts(x) for x in rows.column("text").to_pylist()]
            columns = zip(*counts) if counts else [[] for _ in COUNTS]
            yield batch(
                doc_id=rows.column("doc_id"), **{n: (list(c), pa.int64()) for n, c in zip(COUNTS, columns)}
            )

    return map_batches(
        docs.select("doc_id", F.col(text).alias("text")), task, "doc_id long, " + ", ".join(f"{n} long" for n in COUNTS)
    )


def ratio(name: str, at: dict[str, str] | None = None) -> Column:
    """A feature from the columns of ``COUNTS``, or from those that ``at`` names instead."""
    top, below = next((a, b) for n, a, b in RATIOS if n == name)
    at = at or {}
    return F.coalesce(F.try_divide(F.col(at.get(top, top)), F.col(at.get(below, below))), F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value >= threshold, else value < threshold
    threshold: float

    def column(self, at: dict[str, str] | None = None) -> Column:
        value = ratio(self.feature, at)
        return value >= self.threshold if self.above else value < self.threshold

    def holds(self, x: np.ndarray) -> np.ndarray:
        value = x[:, [n for n, _, _ in RATIOS].index(self.feature)]
        return value >= self.threshold if self.above else value < self.threshold


@dataclass(frozen=True)
class DecisionList:
    """Conjunctions that reject, tried in order; what none of them covers is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def kept(self, at: dict[str, str] | None = None) -> Column:
        """One ordered conditional expression over the columns ``COUNTS`` (or those that ``at`` names instead)."""
        out = None
        for rule in self.rules:
            test = F.lit(True)
            for c in rule:
                test = test & c.column(at)
            out = F.when(test, False) if out is None else out.when(test, False)
        return F.lit(True) if out is None else out.otherwise(True)


def _covers(rule: list[Condition], x: np.ndarray) -> np.ndarray:
    mask = np.ones(len(x), bool)
    for c in rule:
        mask &= c.holds(x)
    return mask


def _cuts(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Quantiles of either class; a feature that is mostly one value would lose the rare class in common quantiles."""
    q = np.linspace(0, 1, THRESHOLDS + 1)
    return np.unique(np.concatenate([np.quantile(bad, q), np.quantile(good, q), [np.nextafter(good.max(), np.inf)]]))


def _grow(x: np.ndarray, bad: np.ndarray, cuts: list[np.ndarray]) -> list[Condition]:
    rule: list[Condition] = []
    mask = np.ones(len(x), bool)
    while len(rule) < MAX_CONDITIONS and (~bad & mask).any():
        p0, n0 = (bad & mask).sum(), (~bad & mask).sum()
        base, best = np.log2(p0 / (p0 + n0)), (0.0, None, None)
        for j, (name, _, _) in enumerate(RATIOS):
            for cut in cuts[j]:
                for above in (True, False):
                    c = Condition(name, above, float(cut))
                    m = mask & c.holds(x)
                    p, n = (bad & m).sum(), (~bad & m).sum()
                    if p >= MIN_COVER and (gain := p * (np.log2(p / (p + n)) - base)) > best[0]:
                        best = (gain, c, m)
        if best[1] is None:
            break
        rule.append(best[1])
        mask = best[2]
    return rule


def learn(x: np.ndarray, bad: np.ndarray) -> DecisionList:
    """Sequential covering over rows of ``RATIOS``; every third row is held back for pruning. ``bad``: to reject."""
    back = np.arange(len(x)) % 3 == 2
    gx, gb, px, pb = x[~back], bad[~back], x[back], bad[back]
    rules = []
    while len(rules) < MAX_RULES and gb.sum() >= MIN_COVER and (~gb).any():
        cuts = [_cuts(gx[gb, j], gx[~gb, j]) for j in range(gx.shape[1])]
        rule = _grow(gx, gb, cuts)
        if not rule:
            break

        def worth(r: list[Condition]) -> float:
            m = _covers(r, px)
            return ((pb & m).sum() + 1) / (m.sum() + 2)

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        m, own = _covers(rule, px), _covers(rule, gx)
        right = (pb & m).sum() + (gb & own).sum()
        if right < MIN_PRECISION * (m.sum() + own.sum()) or (m.any() and (pb & m).sum() < MIN_PRECISION * m.sum()):
            break
        rules.append(tuple(rule))
        gx, gb, px, pb = gx[~own], gb[~own], px[~m], pb[~m]
    return DecisionList(tuple(rules))


def fit(stats: DataFrame, labels: DataFrame) -> DecisionList:
    """The list learned from at most ``FIT_ROWS`` labelled rows, one of each bucket of hashed ids."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("label__"))
    )
    names = [n for n, _, _ in RATIOS]
    seen = stats.join(known, "doc_id").select(
        "doc_id", (F.col("label__") == 0).alias("bad"), *[ratio(n).alias(n) for n in names]
    )
    rows = bounded_sample(seen, ["bad", *names], "doc_id", FIT_ROWS)
    x = np.array([[r[n] for n in names] for r in rows], float).reshape(len(rows), len(RATIOS))
    return learn(x, np.array([r.bad for r in rows], bool))


def base_failed(at: dict[str, str] | None = None) -> Column:
    words, repeats = ((at or {}).get(n, n) for n in ("n_words", "n_repeat_words"))
    return (F.col(words) < 50) | (100 * F.col(repeats) > 50 * F.col(words))


def _with_counts(docs: DataFrame, names: list[str]) -> DataFrame:
    """``docs`` with the counts of its text as columns ``names``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            counts = [text_counts(x) for x in rows.column(rows.schema.get_field_index("text")).to_pylist()]
            columns = list(zip(*counts)) if counts else [[] for _ in COUNTS]
            arrays = [*rows.columns, *[pa.array(list(c), pa.int64()) for c in columns]]
            yield pa.RecordBatch.from_arrays(arrays, names=[*rows.schema.names, *names])

    fields = [f"`{n}` {t}" for n, t in docs.dtypes] + [f"`{n}` long" for n in names]
    return map_batches(docs, task, ", ".join(fields))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and any others) without the rows that fail the base rule or a rule learned from labels."""
    labelled = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    rules = fit(staged(statistics(labelled), "labelled-stats"), labels)
    at = {}
    for n in COUNTS:
        at[n] = fresh(docs, n)
    counted = _with_counts(docs, list(at.values()))
    return counted.where(~base_failed(at) & rules.kept(at)).select(*docs.columns)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = staged(statistics(table(spark, sf_dir, "documents")), "quality-stats")
    rules = fit(stats, table(spark, sf_dir, "labels"))
    return stats.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & rules.kept()).alias("kept"),
    )
