"""The pipeline stage by stage against plain Python, and queries that learn, on small tables."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from ledgerloom.llm import language, lines, packing, pii, quality
from ledgerloom.llm.common import tokenizer_file
from tests.llm.test_operators import _edited, brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep long, n_words int, places__ string"


def documents():
    rng = random.Random(21)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(500)]

    def prose(n, width=9):
        words = [rng.choice(vocab) for _ in range(n)]
        return "\n".join(" ".join(words[i : i + width]) for i in range(0, n, width))

    passage = prose(36)
    # one line: line dedup would take the lines that copies share, and leave texts that are unlike
    star = prose(180).replace("\n", " ").split(" ")
    texts = [prose(rng.randrange(60, 200)) for _ in range(25)]
    texts += [prose(60) + "\n" + passage + "\n" + prose(60) for _ in range(4)]
    texts += [" ".join(star)] + [" ".join(_edited(rng, star, 3, f"x{k}")) for k in range(30)]
    texts += [texts[0]] * 3 + [texts[3] + " Again."]
    texts += [None, "", " \n ", "too short", "word " * 90, "mail me.2@mail.example.com or call +1 (456) 555-2186 on 2024-02-29 " + prose(70)]
    texts += ["spaces" + " " * 5000 + prose(60), prose(4000)]
    order = rng.sample(range(len(texts)), len(texts))
    rows = [(k, texts[i]) for k, i in enumerate(order)] + [(None, prose(70))]
    return [(i, t, "en", "s", None if t is None else len(t), 5, 6, "z") for i, t in rows]


def plain_quality(rows):
    kept = []
    for r in rows:
        n, *_, repeats = quality.text_counts(r[1])[:5]
        if not (n < 50 or 100 * repeats > 50 * n):
            kept.append(r)
    return kept


def plain_lines(rows):
    """Windows of three lines with a word; all but the first place (by id, then text hash, then line) go."""
    at = defaultdict(list)
    for i, t, *_ in rows:
        content = [x.strip(lines.SPACES) for x in t.split("\n") if x.strip(lines.SPACES)]
        for k in range(len(content) - 2):
            at[tuple(content[k : k + 3])].append((lines.LAST_ID if i is None else i, k))
    gone = defaultdict(set)
    for places in at.values():
        for i, k in sorted(set(places))[1:]:
            gone[i].add(k)
    out = []
    for i, t, lang, source, _, *rest in rows:
        text = lines.without_lines(t, sorted(gone[lines.LAST_ID if i is None else i]))[0]
        out.append((i, text, lang, source, len(text), *rest))
    return out


def plain_near(rows):
    roots = brute_components([r[:2] for r in rows])
    return [r for r in rows if r[0] is None or roots[r[0]] == r[0]]


def plain_pii(rows):
    def known(value):
        return pii.pseudonym(*value, pii.KEY, True)

    out = []
    for i, t, lang, source, _, *rest in rows:
        text = pii.replace(t, known, [0] * len(pii.KINDS), pii.ANY_AREA)
        out.append((i, text, lang, source, len(text), *rest))
    return out


def test_every_stage_and_the_run(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    plain = {"quality_rules": plain_quality, "line_dedup": plain_lines, "near_dedup": plain_near, "pii": plain_pii}
    assert [n for n, _ in corpus_pipeline.STAGES] == [*plain, "packing"]
    sizes = [len(rows)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        rows = plain[name](rows)
        assert Counter(map(tuple, got.collect())) == Counter(rows), name
        sizes.append(len(rows))
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] == sizes[4]

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    want = Counter()
    for i, t, *_ in rows:
        ids, at = library.encode(t, add_special_tokens=False).ids + [0], 0
        for k, n in enumerate(packing.piece_lengths(len(ids))):
            want[i, k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())] += 1
            at += n
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        ends = [o + n for o, n in sorted(b)]
        assert [o for o, _ in sorted(b)] == [0, *ends[:-1]] and ends[-1] <= packing.SEQUENCE


def test_an_empty_table_passes_every_stage(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    assert language.op7_language(spark, str(tmp_path)).collect() == []
    assert quality.op8_quality(spark, str(tmp_path)).collect() == []


def test_language_query_learns_from_its_folds_only(spark, tmp_path):
    rng = random.Random(22)
    words = {k: ["".join(rng.choice(x) for _ in range(rng.randrange(5, 12))) for _ in range(40)] for k, x in (("aa", "abcdefg"), ("bb", "uvwxyzt"))}
    rows = []
    for k in range(240):
        lang = "aa" if k % 2 else "bb"
        text = " ".join(rng.choice(words[lang]) for _ in range(40))
        held = zlib.crc32(str(k).encode()) % 3 == 1
        # labels of held-out texts are wrong, so that learning from them would show
        rows.append((k, text, lang, ("aa" if lang == "bb" else "bb") if held else lang))
    rows += [(1000, None, "", "aa"), (1001, "12 ½ Ⅻ !", "", "aa"), (1002, "", "", None)]
    made = [(k, t, label, "s", 1, 2, 3, "x") for k, t, _, label in rows]
    spark.createDataFrame(made, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in language.op7_language(spark, str(tmp_path)).collect()}
    for k, _, lang, _ in rows:
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1)
        assert got[k].lang_pred == (lang or "und") and 0 <= got[k].score <= 1


@pytest.mark.parametrize("labelled", [False, True])
def test_quality_query(spark, tmp_path, labelled):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(r[0], int("x1" not in (r[1] or "")), 0) for r in rows if r[0] is not None] if labelled else []
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in quality.op8_quality(spark, str(tmp_path)).collect()}
    for i, t, *_ in rows:
        words = (t or "").encode().split()
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {k + j for k, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in range(3)}
        plain = [x for x in (t or "").split("\n") if x.strip(lines.SPACES)]
        r = got[i]
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines) == (len(words), len(covered), len(plain) - len(set(plain)))
        assert r.word_chars == sum(len(w.decode()) for w in words)
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert r.kept == (not r.base_failed) or (labelled and not r.kept)
