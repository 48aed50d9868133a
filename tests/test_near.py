"""Verdicts on near rows, rejected rows and batch digests against plain definitions."""

from collections import Counter
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.operators.candidates import candidate_sets
from ledgerloom.operators.near import near_verdicts
from ledgerloom.operators.rejected import rejected_rows
from ledgerloom.plans import quality as Q
from tests import brute
from tests.test_candidates import frames, random_batch


def test_near_verdicts_count_what_a_scan_finds(spark):
    pg, bank, bills = random_batch(7)
    pg_df, bank_df, _ = frames(spark, pg, bank, bills)
    got = {r.src_pos: tuple(r)[2:] for r in near_verdicts(pg_df, bank_df).collect()}
    for p in pg:
        near = [b for b in bank if abs(p["net"] - b["amount"]) <= Decimal("0.01")]
        own = [b for b in near if p["txn"] and b["txn"] == p["txn"]]
        rest = [b for b in near if b not in own]
        rivals = [b for b in rest if abs((p["day"] - b["day"]).days) <= 3]
        assert got[p["pos"]] == (len(near), len(own), len(rivals), len(rest) - len(rivals))
    assert near_verdicts(pg_df.limit(0), bank_df).collect() == []
    assert {tuple(r)[2:] for r in near_verdicts(pg_df, bank_df.limit(0)).collect()} == {(0, 0, 0, 0)}


def test_rejected_rows_follow_the_rank_of_every_anchor(spark):
    pg, bank, bills = random_batch(9)
    pg_df, bank_df, bill_df = frames(spark, pg, bank, bills)
    sets = candidate_sets(pg_df, bank_df, bill_df)
    lists, askers = {}, Counter()
    for r in rejected_rows(sets, bank_df).collect():
        lists.setdefault((r.tier, r.key, r.ask_day, r.ask_net), {})[r.rank] = r.src_pos
        askers[r.tier, r.key, r.ask_day, r.ask_net] = r.anchors
    seen = Counter()
    for p in pg:
        found = brute.candidates(p, bank, bills)
        if found["bank_n"] < 2:
            continue
        tier = found["tier"]
        if tier == "exact_utr":
            rows = [b for b in bank if b["utr"] == p["utr"]]
        elif tier == "exact_txn":
            rows = [b for b in bank if b["txn"] == p["txn"]]
        else:
            rows = [b for b in bank if brute.in_gate(p, b) and brute.similarity(p["utr"], b["narration"]) >= 85]
        ranked = sorted(rows, key=lambda b: (abs((b["day"] - p["day"]).days), abs(p["net"] - b["amount"]), b["utr"] or "", b["pos"]))
        uniform = tier != "fuzzy" and len({(b["day"], b["amount"]) for b in rows}) == 1
        key = (p["txn"] if tier == "exact_txn" else p["utr"] or "")
        question = (tier, key, *((None, None) if uniform else (p["day"], p["net"].quantize(Decimal("0.0001")))))
        assert [lists[question][k] for k in sorted(lists[question])] == [b["pos"] for b in ranked[1:]]
        assert sorted(lists[question]) == list(range(1, len(ranked)))
        seen[question] += 1
    assert seen == askers and len({q[0] for q in seen}) == 3


def test_digests_see_lines_that_come_in_pairs(spark):
    def lines(*texts):
        return spark.createDataFrame([(t[:2], t) for t in texts], "txn_id string, line string")

    one, other = lines("aa", "aa", "ab", "c"), lines("bb", "bb", "ab", "c")
    a, b = Q.batch_digest(one).first(), Q.batch_digest(other).first()
    assert a.xor_digest == b.xor_digest and a.lines == b.lines
    assert (a.sum_digest_1, a.sum_digest_2) != (b.sum_digest_1, b.sum_digest_2)
    again = Q.batch_digest(lines("c", "ab", "aa", "aa").repartition(3)).first()
    assert tuple(again) == tuple(a)
    parts = Q.range_digests(one, 1).collect()
    assert sum(r.sum_digest_1 for r in parts) % Q.DIGEST_PRIME == a.sum_digest_1
    assert Q.batch_digest(lines("a").filter("false")).first().sum_digest_1 == 0
    inside = Q.range_snapshot(one, "a", "b").first()
    assert inside.lines == 3 and inside.digest == spark.range(1).select(F.sha2(F.lit("aa\naa\nab"), 256)).first()[0]
