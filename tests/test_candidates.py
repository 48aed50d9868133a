import datetime as dt
import random
from decimal import Decimal

import pytest

from ledgerloom.operators import blocking
from ledgerloom.operators.candidates import candidate_sets
from tests import brute

DAY0 = dt.date(2026, 8, 1)
PG = (
    "src_pos bigint, txn_id string, utr string, amount decimal(18,4), fee decimal(18,4), gst decimal(18,4), "
    "tds decimal(18,4), day date, opening decimal(18,4), expected_net decimal(18,4), expected_invoice decimal(18,4)"
)
BANK = "src_pos bigint, bank_ref string, txn_id string, utr string, amount decimal(18,4), day date, narration string"
INVOICE = (
    "src_pos bigint, invoice_id string, txn_id string, amount decimal(18,4), fee decimal(18,4), gst decimal(18,4), "
    "tds decimal(18,4), day date"
)


def random_batch(seed, anchors=60, banks=150, bills=90):
    """Few distinct keys, so that groups are large, mixed and hot, with missing and empty references."""
    r = random.Random(seed)
    utrs = [None, "", "UTR694524394", "UTR111111111", "UTR694524390", "AXIS12345678901X", "U1"]
    txns = [f"TXN_0000{i}" for i in range(6)]
    amounts = [Decimal(x) for x in ("10.00", "10.01", "10.02", "10.005", "1500.00", "2500.50", "99.99")]

    def day():
        return DAY0 + dt.timedelta(days=r.choice([0, 1, 2, 3, 4, 7, 30]))

    def text():
        utr = r.choice(utrs) or ""
        if utr and r.random() < 0.4:
            i = r.randrange(len(utr))
            utr = utr[:i] + r.choice("03X") + utr[i + 1 :]
        return r.choice([None, "", f"NEFT-{utr}-M1", f"{utr}/SETTLEMENT", f"CR {utr}", utr])

    pg = [
        dict(pos=i, txn=r.choice([*txns, "TXN_99999", ""]), utr=r.choice([*utrs, "QQQQQQQQQQQQ", "UTR694524391"]), net=r.choice(amounts), bill=r.choice(amounts), day=day())
        for i in range(anchors)
    ]
    bank = [
        dict(pos=i, txn=r.choice([*txns, None, None]), utr=r.choice([*utrs, None, None]), amount=r.choice(amounts), day=day(), narration=text())
        for i in range(banks)
    ]
    bank += [dict(b, pos=banks + k) for k, b in enumerate(bank[:10])]
    bills_ = [dict(pos=i, txn=r.choice([*txns, "TXN_99999"]), utr=None, amount=r.choice(amounts), day=DAY0) for i in range(bills)]
    return pg, bank, bills_


def frames(spark, pg, bank, bills):
    zero = Decimal("0")
    pg_df = spark.createDataFrame(
        [(p["pos"], p["txn"], p["utr"], p["net"], zero, zero, zero, p["day"], zero, p["net"], p["bill"]) for p in pg], PG
    )
    bank_df = spark.createDataFrame(
        [(b["pos"], f"REF{b['pos']}", b["txn"], b["utr"], b["amount"], b["day"], b["narration"]) for b in bank], BANK
    )
    bill_df = spark.createDataFrame(
        [(i["pos"], f"INV{i['pos']}", i["txn"], i["amount"], zero, zero, zero, i["day"]) for i in bills], INVOICE
    )
    return pg_df, bank_df, bill_df


@pytest.mark.parametrize(
    "seed,cell_pairs",
    [(1, 10**9), (2, 0)],
    ids=["plain", "salted-and-blocked"],
)
def test_candidate_sets_match_the_definitions(spark, monkeypatch, seed, cell_pairs):
    monkeypatch.setattr(blocking.gated_pairs, "__defaults__", (cell_pairs,))
    pg, bank, bills = random_batch(seed)
    got = {
        row.src_pos: {
            "tier": row.bank_match_type,
            "bank": row.bank and row.bank.src_pos,
            "invoice": row.invoice and row.invoice.src_pos,
            "bank_n": row.bank_candidate_count,
            "invoice_n": row.invoice_candidate_count,
            "rivals": row.bank_ambiguity_count,
            "duplicate": row.duplicate_detected,
        }
        for row in candidate_sets(*frames(spark, pg, bank, bills)).collect()
    }
    want = {p["pos"]: brute.candidates(p, bank, bills) for p in pg}
    assert len(got) == len(want)
    wrong = {k: (want[k], got[k]) for k in want if want[k] != got[k]}
    assert not wrong
    assert {w["tier"] for w in want.values()} == {"exact_utr", "exact_txn", "fuzzy", "none"}


def test_gate_is_an_equi_join(spark):
    from ledgerloom.operators.candidates import gate_totals

    pg, bank, bills = random_batch(3)
    pg_df, bank_df, _ = frames(spark, pg, bank, bills)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = gate_totals(pg_df, bank_df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "SortMergeJoin" in plan


def test_nearest_agrees_with_a_full_scan(spark):
    from pyspark.sql import functions as F

    from ledgerloom.operators.nearest import nearest

    r = random.Random(5)
    cands = [
        (k, DAY0 + dt.timedelta(days=r.randrange(40)), Decimal(r.randrange(0, 900000)) / 100, i, str(r.randrange(3)))
        for i, k in enumerate(r.choice(["hot", "hot", "hot", "a", "b"]) for _ in range(400))
    ]
    asks = [
        (r.choice(["hot", "a", "b", "none"]), DAY0 + dt.timedelta(days=r.randrange(-5, 45)), Decimal(r.randrange(0, 900000)) / 100)
        for _ in range(200)
    ]
    c = spark.createDataFrame(cands, "key string, day date, amount decimal(18,4), src_pos bigint, tie string").withColumn(
        "row", F.col("src_pos")
    )
    q = spark.createDataFrame(asks, "key string, day date, target decimal(18,4)")
    got = {(x.key, x.day, x.target): x.row for x in nearest(q, c, ["key"], "tie", "row").collect()}
    for key, day, target in asks:
        mine = [x for x in cands if x[0] == key]
        best = min(mine, key=lambda x: (abs((x[1] - day).days), abs(x[2] - target), x[4], x[3]), default=None)
        found = got.get((key, day, target.quantize(Decimal("0.0001"))))
        assert found == (best and best[3])
