"""Field-wise comparison of frozen and replayed decisions against plain Python."""

import json
import random

from ledgerloom.plans import gold as G
from ledgerloom.plans.registry import job


def _plain(value):
    """Numbers by value, names in order."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return int(value) if isinstance(value, float) and value == int(value) else value


def _text(value):
    return json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _record(rng):
    values = {
        "txn_id": lambda: rng.choice(["TXN_1", "TXN_2", "Ünï"]),
        "status": lambda: rng.choice(["MATCHED", "UNMATCHED", None]),
        "exception_code": lambda: rng.choice(["NONE", None]),
        "matched_sources": lambda: rng.sample(["pg", "bank", "invoice"], rng.randrange(1, 4)),
        "reason_codes": lambda: rng.choice([[], ["NONE"], ["A", "B"], ["B", "A"]]),
        "evidence": lambda: {"b": rng.choice([1, 1.0, 2.5]), "a": {"y": [rng.choice([1.5, 1.50, "1.5"])], "x": None}},
    }
    chosen = [f for f in values if rng.random() < 0.85]
    rng.shuffle(chosen)
    return {f: values[f]() for f in chosen}


def test_records_are_compared_as_plain_python_does(spark):
    rng = random.Random(17)
    category = ["exact_match", "ambiguous", "duplicate", "reference_mismatch_fuzzy", None]
    frozen, actual = {}, {}
    for i in range(400):
        record = _record(rng)
        if rng.random() < 0.95:
            frozen[f"c{i}"] = (rng.choice(category), record)
        if rng.random() < 0.95:
            actual[f"c{i}"] = dict(reversed(record.items())) if rng.random() < 0.5 else _record(rng)
    left = spark.createDataFrame([(k, c, json.dumps(r)) for k, (c, r) in frozen.items()], "case_id string, category string, document string")
    right = spark.createDataFrame([(k, json.dumps(r, indent=1)) for k, r in actual.items()], "case_id string, document string")
    compared = G.compare_records(left, right)
    got = {r.case_id: r for r in compared.collect()}
    assert set(got) == set(frozen) | set(actual)
    counts = dict.fromkeys(("MATCH", "BASELINE_DIVERGENCE", "NOT_EVALUABLE_PER_CASE", "KNOWN_POLICY_DIVERGENCE", "MISSING_ACTUAL", "MISSING_EXPECTED"), 0)
    for k, row in got.items():
        differences = []
        if k not in frozen:
            kind = "MISSING_EXPECTED"
        elif k not in actual:
            kind = "MISSING_ACTUAL"
        else:
            kept, want = frozen[k]
            for f in G.FROZEN_FIELDS:
                if f in want and _text(want[f]) != _text(actual[k].get(f)):
                    differences.append((f, _text(want[f]), _text(actual[k].get(f))))
            kind = (
                "MATCH" if not differences
                else "NOT_EVALUABLE_PER_CASE" if kept in ("ambiguous", "duplicate")
                else "KNOWN_POLICY_DIVERGENCE" if kept == "reference_mismatch_fuzzy"
                else "BASELINE_DIVERGENCE"
            )
        counts[kind] += 1
        assert (row.comparison, [tuple(d) for d in row.differences]) == (kind, differences), k
    assert all(counts.values())
    total = G.baseline(compared).first()
    assert (total.matched, total.divergent, total.not_evaluable, total.known_policy, total.missing_actual, total.missing_expected) == tuple(counts.values())
    assert total.raw_divergent == total.divergent + total.not_evaluable + total.known_policy and not total.stable


def test_a_document_that_is_no_json_is_missing(spark):
    left = spark.createDataFrame([("a", "x", "{broken"), ("b", "x", '{"status": "S"}')], "case_id string, category string, document string")
    right = spark.createDataFrame([("a", "{}"), ("b", None)], "case_id string, document string")
    got = {r.case_id: r.comparison for r in G.compare_records(left, right).collect()}
    assert got == {"a": "MISSING_EXPECTED", "b": "MISSING_ACTUAL"}


def test_frozen_batch_against_replay(small):
    rows = small.batch_gold.collect()
    assert len(rows) == small.cases.count()
    kinds = {r.comparison for r in rows}
    assert "MATCH" in kinds and "MISSING_EXPECTED" not in kinds
    for r in rows:  # a batch and a replay agree on everything unless a case needs its neighbours
        assert (not r.differences) == (r.comparison in ("MATCH", "MISSING_ACTUAL"))


def test_a_changed_table_is_another_job(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "orders.parquet"))
    first = job(spark, str(tmp_path))
    assert job(spark, str(tmp_path)) is first
    spark.range(3).write.mode("append").parquet(str(tmp_path / "orders.parquet"))
    assert job(spark, str(tmp_path)) is not first
