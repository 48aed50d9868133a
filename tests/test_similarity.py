import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.narration import partial_ratio
from ledgerloom.operators.attribution import _sharing_keys, attribute_bank_rows
from ledgerloom.operators.blocking import gated_pairs, shared_lead
from tests import brute


def word(r, letters, low, high):
    return "".join(r.choice(letters) for _ in range(r.randint(low, high)))


def mutated(r, text):
    out = list(text)
    for _ in range(r.randint(0, 3)):
        if not out:
            break
        i = r.randrange(len(out))
        kind = r.random()
        if kind < 0.4:
            out[i] = r.choice("0123X")
        elif kind < 0.7:
            out.pop(i)
        else:
            out.insert(i, r.choice("0123X"))
    return "".join(out)


def test_partial_ratio_matches_the_definition(spark):
    r = random.Random(1)
    pairs = [("UTR694524394", "UPI/3TR694524394/MERCH_004/NET STLMNT"), ("", ""), ("", "a"), ("abc", None), (None, None)]
    pairs += [(word(r, "abc1", 0, 15), word(r, "abc1", 0, 20)) for _ in range(250)]
    pairs += [(word(r, "abc1", 65, 70), word(r, "abc1", 65, 80)) for _ in range(3)]
    # around the ends of words of needle positions
    pairs += [(word(r, "abc1", n, n), word(r, "abc1", n, n + 6)) for n in (60, 61, 62, 121, 122, 123)]
    long = word(r, "abcdefgh", 150, 150)
    pairs += [(mutated(r, long), word(r, "abc", 0, 5) + mutated(r, long)), (long[:100], long)]
    rows = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", partial_ratio("a", "b").alias("full"), partial_ratio("a", "b", 85).alias("cut")
    )
    for row in rows.collect():
        want = brute.similarity(row.a, row.b)
        assert abs(row.full - want) < 1e-9
        assert (row.cut >= 85) == (want >= 85)
        if want >= 85:
            assert abs(row.cut - want) < 1e-9


def test_known_similarity(spark):
    row = spark.range(1).select(partial_ratio("'UTR694524394'", "'UPI/3TR694524394/MERCH_004/NET STLMNT'").alias("s")).first()
    assert round(row.s, 2) == 91.67


def texts_and_refs():
    r = random.Random(2)
    refs = sorted({word(r, "0123UTR", n, n) for n in (0, 1, 2, 3, 5, 7, 9, 12, 12, 13, 16, 22) for _ in range(12)})
    texts = set()
    for _ in range(220):
        core = mutated(r, r.choice(refs))
        texts.add(r.choice(["", word(r, "ABC01/", 0, 10)]) + core + r.choice(["", word(r, "ABC01/", 0, 10)]))
    return refs, sorted(texts | {""})


def test_block_keys_lose_no_pair(spark):
    refs, texts = texts_and_refs()
    day, amount = dt.date(2026, 8, 1), Decimal("10.00")
    asks = spark.createDataFrame([(x, amount, day) for x in refs], "ref string, expected_net decimal(18,4), day date")
    rows = spark.createDataFrame([(x, amount, day, 1) for x in texts], "text string, amount decimal(18,4), bank_day date, n int")
    listed = [(x.ref, x.text) for x in gated_pairs(asks, rows, (), 85, 0).collect()]
    want = {(a, b) for a in refs for b in texts if brute.similarity(a, b) >= 85}
    assert len(listed) == len(set(listed))
    assert want <= set(listed)
    assert len(listed) < len(refs) * len(texts) / 4


def banked(n, seed):
    """References that share a bank's code, and narrations that hold edited ones."""
    r = random.Random(seed)
    refs = sorted({"HDFC" + word(r, "0123456789", n - 4, n - 4) for _ in range(300)})
    texts = {mutated(r, x) if r.random() < 0.5 else "NEFT/" + mutated(r, x) + "/ACME"[: r.randrange(6)] for x in refs}
    return refs, sorted(texts), r


@pytest.mark.parametrize("n", [14, 16, 19, 20, 22, 26, 27, 34])
def test_block_keys_stay_selective_where_references_share_a_prefix(spark, n):
    refs, texts, r = banked(n, n)
    left = spark.createDataFrame([(x,) for x in refs], "ref string")
    right = spark.createDataFrame([(x,) for x in texts], "text string")
    pairs = _sharing_keys(left, right, "ref", "text", 85).unionByName(
        _sharing_keys(right.filter(F.length("text") <= n), left, "text", "ref", 85)
    )
    listed = {(x.ref, x.text) for x in pairs.distinct().collect()}
    for text in r.sample(texts, 5):
        assert {a for a in refs if brute.similarity(a, text) >= 85} <= {a for a, b in listed if b == text}
    assert len(listed) < 10 * len(texts)


def test_shared_lead(spark):
    frame = lambda rows: spark.createDataFrame([(x,) for x in rows], "t string")
    assert shared_lead(frame([f"HDFC{i}{i}" for i in range(9)] + ["X"]), "t") == 4
    assert shared_lead(frame(["ab", "cd", "ef", "gh", "ij"]), "t") == 0
    assert shared_lead(frame([]), "t") == 0


def test_attribution_is_the_argmax(spark):
    refs, texts = texts_and_refs()
    refs, texts = [x for x in refs if x], [x for x in texts if x]
    pg = spark.createDataFrame([(i, f"T{i}", x) for i, x in enumerate(refs)], "src_pos bigint, txn_id string, utr string")
    bank = spark.createDataFrame([(f"R{i}", x) for i, x in enumerate(texts)], "bank_ref string, narration string")
    got = {x.narration: (x.txn_id, x.similarity) for x in attribute_bank_rows(bank, pg).collect()}
    for text in texts:
        scores = [(brute.similarity(x, text), -i) for i, x in enumerate(refs)]
        best, at = max(scores)
        if best < 85:
            assert got[text][0] is None
        else:
            assert got[text][0] == f"T{-at}" and abs(got[text][1] - best) < 1e-9


def test_similarity_is_exact_for_containment(spark):
    assert spark.range(1).select(partial_ratio("'abc'", "'xxabcxx'").alias("s")).filter(F.col("s") == 100).count() == 1


def test_lists_of_keys_are_never_broadcast(spark):
    """A text has hundreds of keys, and the planner knows the size of the texts only."""
    refs = spark.createDataFrame([(f"UTR{100000000 + 7919 * i}",) for i in range(50)], "ref string")
    texts = refs.select(F.concat(F.lit("NEFT/"), "ref").alias("text"))
    plan = _sharing_keys(refs, texts, "ref", "text", 85)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_attribution_lists_no_deleted_characters_where_the_reference_stands_whole(spark, monkeypatch):
    from ledgerloom.operators import attribution

    searched = []
    whole = attribution._best_reference
    monkeypatch.setattr(
        attribution, "_best_reference", lambda refs, texts, floor: searched.append((floor, texts.count())) or whole(refs, texts, floor)
    )
    pg = spark.createDataFrame([(i, f"T{i}", f"UTR{100000000 + 7919 * i}") for i in range(40)], "src_pos bigint, txn_id string, utr string")
    bank = pg.select(
        F.col("txn_id").alias("bank_ref"),
        F.concat(F.lit("UPI/"), F.expr("if(src_pos = 3, replace(utr, 'U', 'V'), utr)"), F.lit("/M")).alias("narration"),
    )
    got = {x.bank_ref: x.txn_id for x in attribute_bank_rows(bank, pg).collect()}
    assert got == {f"T{i}": f"T{i}" for i in range(40)}
    assert searched == [(100, 40), (91, 1)]


@pytest.mark.parametrize("floor", [60, 85, 91, 100])
def test_batches_sort_out_the_pairs_below_the_floor_and_no_other(floor):
    from ledgerloom.functions.reach import reaches

    r = random.Random(floor)
    left, right = [], []
    for n in (0, 1, 2, 5, 12, 12, 16, 30, 61) * 12:
        a = word(r, "0123UTR", n, n)
        left.append(a)
        right.append(r.choice(["", "AB0/"]) + r.choice([mutated(r, a) if a else a, word(r, "0123UTR", 0, 16)]) + r.choice(["", "/1"]))
    assert [bool(x) for x in reaches(left, right, floor)] == [brute.similarity(a, b) >= floor for a, b in zip(left, right)]
    wide = ["x" * 62, "a", "\U0001F600b"]
    assert reaches(wide, ["y" * 70, "b" * 600, "cd"], floor).all()  # left to the expression


def test_pairs_below_the_floor_are_not_shuffled(spark):
    from ledgerloom.functions.narration import similar_pairs

    ids = spark.range(40).select(F.expr("concat('UTR', 100000000 + id * 7919)").alias("ref"))
    pairs = ids.crossJoin(ids.select(F.concat(F.lit("NEFT/"), "ref", F.lit("/M")).alias("text")))
    found = similar_pairs(pairs, "ref", "text", 91)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Repartition") < plan.index("ArrowEvalPython") < plan.index("Join")  # the filter is below the shuffle
    assert found.filter("similarity = 100").count() == 40
