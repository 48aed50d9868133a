import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerloom import config as C
from ledgerloom.operators.matching import match_invariants
from ledgerloom.plans import quality as Q
from ledgerloom.plans import reports as R

GOLDEN = os.environ.get("GOLDEN_FEED_DIR")  # a folder of the three feed files and ground_truth.json


def test_buckets_sum_to_the_total(small):
    lines = {r.line: r for r in R.cash_position(small.decided, small.batch.rejects).collect()}
    assert sum(lines[b].amount for b in C.CASH_BUCKETS) == lines["total_expected_settlement"].amount
    assert sum(lines[b].records for b in C.CASH_BUCKETS) == small.decided.count()
    assert lines["records_rejected_at_ingestion"].amount is None
    assert set(C.CASH_BUCKET_BY_STATUS) == set(C.STATUSES)


def test_bank_rows_are_partitioned(small):
    totals = R.completeness_totals(small.accounts).first()
    assert totals.selected + totals.duplicate_credits + totals.orphaned == totals.total_bank_rows == small.batch.bank.count()
    assert totals.is_complete


def test_matches_never_contradict_themselves(small):
    assert match_invariants(small.decided).isEmpty()
    assert small.decided.count() == small.batch.pg.count()


def test_triage_rank_is_dense_and_ordered(small):
    rows = R.triage_rank(R.exceptions(small.decided)).orderBy("triage_rank").collect()
    assert [r.triage_rank for r in rows] == list(range(1, len(rows) + 1))
    keys = [(r.policy_priority, r.confidence_score, r.txn_id) for r in rows]
    assert keys == sorted(keys)


def test_filters_partition_the_exceptions(small):
    whole = R.exceptions(small.decided).count()
    assert sum(R.exceptions(small.decided, s).count() for s in C.STATUSES) == whole
    with pytest.raises(ValueError, match="Unknown status"):
        R.exceptions(small.decided, "NOPE")


def test_unknown_transaction_is_its_own_error(small):
    with pytest.raises(LookupError):
        R.evidence_of(small.decided, "TXN_NOPE")


def test_digest_ignores_order_and_sees_every_row(small):
    lines = Q.decision_lines(small.decided)
    one = Q.batch_digest(lines).first()
    assert Q.batch_digest(lines.orderBy(F.desc("line"))).first() == one
    assert Q.batch_digest(lines.filter("txn_id <> (select 'TXN_00000001')")).first() != one


def test_queries_agree_with_their_sql(spark, small):
    import duckdb

    import __spark_entry__ as entry
    from tools.compare import TABLES, rows_of

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small.sf_dir}/{t}.parquet'")
    names = ["decisions", "bank_ambiguity", "cash_position", "exceptions", "bank_completeness", "fuzzy_sweep", "ungrounded_numbers"]
    for name in names:
        df = entry.queries()[name](spark, small.sf_dir)
        cur = con.execute(entry.oracle_sql()[name])
        assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in cur.description], cur.fetchall()), name


@pytest.mark.skipif(not GOLDEN, reason="GOLDEN_FEED_DIR not set")
def test_golden_batch(spark):
    import hashlib

    from ledgerloom.plans.pipeline import batch_from_folder

    batch = batch_from_folder(spark, GOLDEN)
    decided = batch.snapshot()
    lines = "\n".join(r.line for r in Q.decision_lines(decided).orderBy("txn_id").collect())
    assert hashlib.blake2b(lines.encode(), digest_size=8).hexdigest() == "d8134bab221d1046"
    cash = {r.line: (r.amount and str(r.amount), r.records) for r in R.cash_position(decided, batch.rejects).collect()}
    assert cash["settled_and_verified"] == ("292353.70", 24)
    assert cash["blocked_in_exceptions"] == ("601761.49", 32)
    assert cash["variance_vs_bank_credited"][0] == "38640.77"
    totals = R.completeness_totals(R.bank_completeness(batch.bank, decided)).first()
    assert (totals.selected, totals.duplicate_credits, totals.orphaned, str(totals.orphaned_value)) == (59, 3, 2, "517.48")
    assert json.loads(R.batch_summary(decided).filter("section = 'totals'").first().document) == {"total": 61, "matched": 24}
