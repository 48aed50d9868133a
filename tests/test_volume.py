"""What grows with the batch is neither sent through the driver nor written more often than it is read."""

import datetime as dt
import os
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import candidates as K
from ledgerloom.operators.attribution import attribute_bank_rows
from ledgerloom.plans import gold as G
from ledgerloom.plans import quality as Q
from ledgerloom.plans import registry as REG
from ledgerloom.plans import replay as RP
from ledgerloom.session import SHUFFLE_CLEANUP, stage
from tests.conftest import SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lists_as_long_as_the_cases_are_not_broadcast(small):
    for df in (
        REG._case_rows(small),
        small.owned_bank,
        RP.gold_comparison(small.replayed),
        G.compare_records(RP.frozen_decisions(small.cases, small.decided), RP.replayed_records(small.replayed)),
    ):
        plan = _plan(df)
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_frozen_decisions_fall_back_to_the_label(spark, small):
    cases = small.cases
    known = small.decided.filter("pmod(src_pos, 3) <> 0")
    rows = RP.frozen_decisions(cases, known).collect()
    assert len(rows) == cases.count()
    labels = {r.case_id: r.document for r in RP.frozen_labels(cases).collect()}
    decided = {r.txn_id for r in known.select("txn_id").collect()}
    txn = {r.case_id: r.txn_id for r in cases.collect()}
    for r in rows:
        assert (r.document == labels[r.case_id]) == (txn[r.case_id] not in decided)


def test_references_of_the_attribution_are_not_broadcast(spark, small, monkeypatch):
    from ledgerloom.operators import attribution as A

    plans = []
    real = A.stage

    def watched(df, name):
        if name.startswith("attribution-") and name[12:].isdigit():
            plans.append(_plan(df))
        return real(df, name)

    monkeypatch.setattr(A, "stage", watched)
    plans.append(_plan(attribute_bank_rows(Q.native_rows(small.batch.bank), small.batch.pg)))
    assert len(plans) > 1 and not any("Broadcast" in p for p in plans)


def _staged(monkeypatch, *modules):
    frames = {}
    for module in modules:
        real = module.stage
        monkeypatch.setattr(module, "stage", lambda df, name, real=real: frames.setdefault(name, real(df, name)))
    return frames


def test_a_group_and_an_anchor_hold_nothing_twice(small, monkeypatch):
    frames = _staged(monkeypatch, K)
    b = small.batch
    K.candidate_sets(b.pg, b.bank, b.invoice)
    written = frames["exact-groups"].schema
    assert not {"utr_key", "txn_key"} & set(written.names)
    assert written["u"].dataType.names == ["n", "row", "duplicate", "uniform", "one_amount", "one_txn"]
    groups = K.summarise(K.prepared_bank(b.bank).filter("utr is not null"), ["utr"])
    partial = _plan(groups).split("Exchange hashpartitioning")[1]
    assert partial.count("partial_") == 4 and "first.utr" not in _plan(groups)


def test_groups_tell_what_varies_in_them(spark):
    schema = "src_pos bigint, bank_ref string, txn_id string, utr string, amount decimal(18,4), day date, narration string"
    rows = []

    def add(utr, *members):
        for txn, amount, day in members:
            k = len(rows)
            rows.append((k, f"R{k}", txn, utr, Decimal(amount), dt.date(2026, 8, day), None))

    add("same", ("T", "1.00", 1), ("T", "1.00", 1))
    add("ids", ("T", "1.00", 1), ("S", "1.00", 1))
    add("some", ("T", "1.00", 1), (None, "1.00", 1))
    add("none", (None, "1.00", 1), (None, "1.00", 1))
    add("days", ("T", "1.00", 1), ("T", "1.00", 2))
    add("amounts", ("T", "1.00", 2), ("T", "2.00", 1), ("T", "1.00", 1))
    add("one", ("T", "1.00", 1))
    groups = K.summarise(K.prepared_bank(spark.createDataFrame(rows, schema)), ["utr"])
    got = {r.utr: r.group for r in groups.collect()}
    first = {utr: next(r for r in rows if r[3] == utr) for utr in got}
    flags = {u: (g.n, g.duplicate, g.uniform, g.one_amount, g.one_txn) for u, g in got.items()}
    assert flags == {
        "same": (2, True, True, True, True),
        "ids": (2, False, True, True, False),
        "some": (2, False, True, True, False),
        "none": (2, True, True, True, True),
        "days": (2, False, False, True, False),
        "amounts": (3, False, False, False, False),
        "one": (1, False, True, True, True),
    }
    assert {u: tuple(g.row) for u, g in got.items()} == first


def test_decisions_read_once_are_not_written(spark, monkeypatch):
    if not os.path.isdir(SMALL):
        pytest.skip("driver tables not present")
    frames = _staged(monkeypatch, REG)
    job = REG.Job(spark, SMALL)
    lazy = {name: sorted(map(tuple, REG.plain(REG.QUERIES[name](job)).collect())) for name in ("by_status", "tax_verification")}
    assert "decided" not in frames
    REG.QUERIES["multi_violation"](job)
    assert "decided" in frames
    for name, rows in lazy.items():
        assert sorted(map(tuple, REG.plain(REG.QUERIES[name](job)).collect())) == rows


def test_a_stage_leaves_no_shuffle_files(spark):
    def files():
        disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}

    before = files()
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    written = stage(counted, "counted")
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and written.count() == 7
    assert spark.conf.get(SHUFFLE_CLEANUP, "false") == "false"
    assert counted.count() == 7 and counted.count() == 7


def test_a_long_list_of_gate_cells_is_not_broadcast(small, monkeypatch):
    from ledgerloom.operators import skew

    bank = small.batch.bank
    asked = K.open_keys_of(small.batch.pg)
    rows = {r.src_pos for r in K.near_rows(asked, bank, ()).collect()}
    monkeypatch.setattr(skew, "SHORT_LIST", 1)
    near = K.near_rows(asked, bank, ())
    assert {r.src_pos for r in near.collect()} == rows and near.count() == len(rows)
    assert "Broadcast" not in _plan(near)
