"""Fill-in-middle, periodic runs and toxicity against plain definitions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import middles, periods, toxicity

CLASHING = "doc_id long, text string, n long, form string, output string, runs string, score double, fold int, toxic int"


def rows_of(pairs):
    return [(i, t, 1, "x", "y", "z", 0.5, 9, 7) for i, t in pairs]


def odd_texts():
    rng = random.Random(3)
    lines = "".join("".join(rng.choice("ab é日😀\r\x0b ") for _ in range(rng.randrange(40))) + "\n" for _ in range(3000))
    return [
        (1, None),
        (2, ""),
        (3, "\n"),
        (4, "one line"),
        (5, "a\n\n\nb"),
        (6, "é日\n😀x\n"),
        (7, "holds <S> itself\nand more\n"),
        (8, lines),
        (9, "<\n<S\n<P\n<M\n"),
        (9, "<\n<S\n<P\n<M\n"),
        (None, "x\ny\nz"),
        (10, "w" * 200_000),
        (11, "short\n" * 500 + "l" * 90_000 + "\n" + "short\n" * 500),
    ] + [(100 + k, "\n".join("ab" * rng.randrange(9) for _ in range(rng.randrange(12)))) for k in range(60)]


def plain_middle(doc_id, text, rate, suffix_first):
    text = text or ""
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < suffix_first:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate,suffix_first", [(100, 50), (60, 100)])
def test_fill_in_middle(spark, rate, suffix_first):
    pairs = odd_texts()
    docs = spark.createDataFrame(rows_of(pairs), CLASHING).repartition(3)
    made = middles.fill_in_middle(docs, rate=rate, suffix_first=suffix_first)
    back = middles.restored(F.col("form"), F.col("output"))
    got = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", back.alias("back")).collect()
    key = lambda r: (r[0] or 0, r[5])
    want = [(*plain_middle(i, t, rate, suffix_first), t or "") for i, t in pairs]
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert middles.fill_in_middle(docs.limit(0)).collect() == []


def test_rank_index_is_exact_and_bounded():
    rng = random.Random(4)
    shapes = [
        [0],
        [0, 5],
        np.cumsum([rng.randrange(1, 200) for _ in range(5000)]).tolist(),
        np.cumsum([7] * 10_000).tolist(),
        np.cumsum([1] * 300 + [100_000] + [1] * 300 + [3_000_000_000]).tolist(),
    ]
    for offsets in shapes:
        offsets = np.array(offsets, np.int64)
        for error in (1, 16, 100, 127):
            index = middles.RankIndex.fit(offsets, error)
            ranks = np.arange(len(offsets))
            assert (index.offsets(ranks) == offsets).all()
            assert abs(index.predict(ranks) - offsets).max() <= error
    assert len(middles.RankIndex.fit(np.arange(0, 70_000, 7)).first) == 1
    with pytest.raises(ValueError):
        middles.RankIndex.fit(np.arange(3), 200)


def brute_runs(words, least):
    """Every stretch that a period fits and no neighbour extends, with its smallest period, by the definition."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def random_words(rng):
    n, k = rng.randrange(80), rng.choice([1, 2, 2, 3, 6])
    words = [rng.randrange(k) for _ in range(n)]
    if n > 10 and rng.random() < 0.5:
        p, a = rng.randrange(1, 12), rng.randrange(n)
        for i in range(a, n):
            words[i] = words[a + (i - a) % p]
    return words


def test_runs_however_the_words_arrive():
    rng = random.Random(5)
    for _ in range(600):
        words, least = random_words(rng), rng.choice([1, 2, 5, 12])
        want = brute_runs(words, least)
        for sizes in ([len(words)], [1], [1, 2, 7, 30]):
            catchers, i = periods.Catchers(), 0
            while i < len(words):
                step = rng.choice(sizes)
                catchers.append(np.array(words[i : i + step], np.int64))
                i += step
            assert [tuple(r) for r in catchers.runs(least).tolist()] == want
        plain = periods.plain_runs(np.array(words, np.int64)).tolist()
        assert [tuple(r) for r in plain if r[1] >= least] == want


def test_squares_are_reported_as_soon_as_they_are_whole():
    """Word by word: at each length, a run has been reported exactly if the words so far hold a square of its period."""
    rng = random.Random(6)
    for _ in range(80):
        words, catchers, told = random_words(rng), periods.Catchers(), set()
        for i, w in enumerate(words):
            told |= {tuple(r) for r in catchers.append(np.array([w], np.int64)).tolist()}
            for s, _, q in brute_runs(words[: i + 1], 2):
                assert (s, q) in told


def test_a_hash_collision_is_noticed(monkeypatch):
    monkeypatch.setattr(periods._Prefixes, "equal", lambda self, left, apart, length: np.ones(len(left), bool))
    words = [1, 2, 3, 1, 2, 3, 4, 1, 2, 3, 4, 1, 1, 1]
    catchers = periods.Catchers()
    catchers.append(np.array(words, np.int64))
    assert [tuple(r) for r in catchers.runs(2).tolist()] == brute_runs(words, 2)


def period_texts():
    rng = random.Random(7)
    texts = [None, "", " \t\n", "a", "a a a", "x " * 40, "  é é " * 30, "  lead " + "ab cd\tef\n" * 9 + "tail"]
    texts += [" ".join(f"w{w}" for w in random_words(rng)) for _ in range(80)]
    texts.append(" ".join(str(rng.randrange(50)) for _ in range(30_000)) + " tail tail" * 8000)
    return [(k, t) for k, t in enumerate(texts)] + [(3, "again " * 20), (None, "y z " * 9)]


def test_periodic_runs(spark):
    pairs = period_texts()
    docs = spark.createDataFrame(rows_of(pairs), CLASHING).repartition(3)
    got = periods.periodic_runs(docs).collect()
    assert len(got) == len(pairs)
    seen = {(r.doc_id, r.collapsed): r for r in got}
    for doc_id, text in pairs:
        words = (text or "").encode().split()
        if len(words) > 1000:
            runs = periods.plain_runs(np.unique(words, return_inverse=True)[1])
            runs = [tuple(r) for r in runs.tolist() if r[1] >= 12]
        else:
            runs = brute_runs(words, 12)
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
        row = seen[doc_id, b" ".join(kept).decode()]
        assert row.n_words == len(words) and [tuple(r) for r in row.runs] == runs
    assert periods.periodic_runs(docs.limit(0)).collect() == []


def test_periods_query(spark, tmp_path):
    pairs = [p for p in period_texts() if p[0] is not None and (p[1] is None or len(p[1]) < 10_000)]
    pairs += [(1000 + k, " ".join(f"v{(k * i) % 17}" for i in range(k))) for k in range(200)]
    spark.createDataFrame(rows_of(pairs), CLASHING).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc_id, text in pairs:
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words, 12)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        digests = (hashlib.sha256(x).hexdigest() for x in (lines.encode(), b" ".join(kept)))
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((doc_id, len(runs), *four, *digests))
    got = [tuple(r) for r in periods.op13_periods(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[1] for r in want) > 20


# --- toxicity -------------------------------------------------------------------------------


def labelled_texts(n=900):
    """Prose of which a fifth holds insults, some in disguise, and a twentieth of the labels is wrong."""
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    bad = ["dolt", "nitwit", "blockhead", "numbskull", "dunderhead"]
    rows = []
    for k in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randrange(30, 200))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randrange(3, 9)):
                w = rng.choice(bad)
                w = rng.choice([w, w.upper(), w.replace("i", "1").replace("o", "0"), w + "!!", w[0] + w[1:] * 1])
                words[rng.randrange(len(words))] = "you " + w
        rows.append((k, " ".join(words), int(toxic), int(toxic != (rng.random() < 0.02))))
    return rows


def test_toxicity_held_out(spark, tmp_path):
    rows = labelled_texts()
    odd = [(5000, None), (5001, ""), (5002, " \n "), (None, "you dolt"), (5003, "fine\n" * 60_000), (5003, "fine")]
    docs = rows_of([(i, t) for i, t, _, _ in rows] + odd)
    spark.createDataFrame(docs, CLASHING).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, y) for i, _, _, y in rows] + [(None, 1, 1), (9999, 1, 1), (5000, 0, None), (0, 1, rows[0][3])]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op12_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(docs)
    truth = {i: t for i, _, t, _ in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    blank = {r.score for r in got if r.doc_id in (5000, 5001, 5002)}
    assert len(blank) == 1 and blank.pop() < 0.5


def test_toxicity_ignores_labels_of_the_held_out_texts(spark):
    """The same scores whatever the labels of texts that are not learned from; and however the rows are dealt."""
    rows = labelled_texts(300)
    schema = "doc_id long, text string"
    learned = spark.createDataFrame([(i, t) for i, t, _, _ in rows if i % 3], schema)
    every = spark.createDataFrame([(i, t) for i, t, _, _ in rows], schema).withColumn("held_out", F.lit(False))
    scores = []
    for flip, parts in ((False, 1), (True, 5)):
        labels = [(i, y if i % 3 else (1 - y if flip else y)) for i, _, _, y in rows]
        labels = spark.createDataFrame(labels, "doc_id long, toxic int").repartition(parts)
        model = toxicity.fit(learned.repartition(parts), labels)
        scores.append({r.doc_id: round(r.score, 9) for r in toxicity.score(every.repartition(parts), model).collect()})
    assert scores[0] == scores[1]


@pytest.mark.parametrize("labels,share", [([], 0.0), ([(1, 1), (2, 1)], 1.0), ([(1, 0), (1, None)], 0.0)])
def test_toxicity_without_both_classes(spark, labels, share):
    docs = spark.createDataFrame([(1, "you dolt"), (2, None)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.score(docs.withColumn("held_out", F.lit(False)), model).collect()
    assert [r.score for r in got] == [share, share]
    assert toxicity.score(docs.withColumn("held_out", F.lit(False)).limit(0), model).collect() == []


def test_term_counts_are_those_of_all_texts(spark):
    rows = [(t, k % 3, x) for k, (_, t, x, _) in enumerate(labelled_texts(60))] + [(None, 0, 1), ("", 1, 0)]
    want = {}
    for t, fold, x in rows:
        terms = set()
        for w in (t or "").split():
            f = toxicity.folded(w)
            if f:
                terms |= {f"^{f}$"} | {f"^{f}$"[i : i + 5] for i in range(max(0, len(f) - 2))}
        for term in terms:
            want[term, fold, x] = want.get((term, fold, x), 0) + 1
    texts = spark.createDataFrame(rows, "text string, fold int, toxic int").repartition(5)
    got = {(r.term, r.fold, r.toxic): r.texts for r in toxicity.term_counts(texts).collect()}
    assert got == want


def test_folding():
    f = toxicity.folded
    assert f("Id10t!!") == "idiot" and f("STUUUUPID,") == "stuupid" and f("(clown)") == "clown"
    assert f("2024") == "2024" and f("***") == "" and f("É") == "é"


def test_features_by_hand():
    lexicon = toxicity.Lexicon({"^dolt$": 2.0, "^nitw": 3.0})
    x = dict(zip(toxicity.FEATURES, toxicity.Describer(lexicon).describe("You DOLT! a nitwit far b c d e f g h D0LT.")))
    assert x["word_hits"] == 2 / 13 and x["piece_hits"] == 1 / 13
    assert x["largest"] == 3.0 and x["count"] == pytest.approx(np.log(4))
    assert x["near"] == 2 / 13 and x["second_person"] == 1 / 13
    assert x["shouted"] == 2 / 13 and x["exclaimed"] == 1 / 13 and x["marks"] == 2 / 13
    assert x["disguised"] == 1 / 13 and x["spelled"] == 6 / 13
    assert toxicity.Describer(lexicon).describe(None) == [0.0] * len(toxicity.FEATURES)


def test_isotonic_is_the_least_squares_fit():
    rng = np.random.default_rng(9)
    margin = rng.normal(size=200).round(1)
    y = (rng.random(200) < 1 / (1 + np.exp(-2 * margin))).astype(float)
    fit = toxicity.Isotonic.fit(margin, y)
    assert (np.diff(fit.value) > 0).all()
    # plain definition: the largest of the least averages over intervals that hold the point
    points = np.unique(margin)
    for p in points:
        low = [min(y[(margin >= a) & (margin <= b)].mean() for b in points if b >= p) for a in points if a <= p]
        block = np.searchsorted(fit.at, p)
        near = fit.value[max(0, block - 1) : block + 1]
        assert np.isclose(near, max(low)).any()


def test_trees_learn_a_conjunction():
    rng = np.random.default_rng(10)
    x = rng.random((2000, 4))
    y = ((x[:, 1] > 0.6) & (x[:, 3] < 0.5)).astype(float)
    trees = toxicity.boost(x[:1500], y[:1500])
    assert ((trees.margins(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.97
