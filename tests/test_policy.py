from pyspark.sql import functions as F

from ledgerloom.operators.decide import CODE_BY_FACT, FACTS, RULES, policy_sweep


def test_all_2048_contexts(spark):
    """First applicable rule by priority, its code listed, three-state tax."""
    facts = spark.range(2048).select(
        *[F.call_function("shiftright", F.col("id"), F.lit(i)).bitwiseAND(F.lit(1)).cast("boolean").alias(f) for i, f in enumerate(FACTS)]
    )
    rows = policy_sweep(facts).collect()
    assert len(rows) == 2048
    for row in rows:
        on = {f for f in FACTS if row[f]}
        rule = next(r for r in sorted(RULES, key=lambda r: r.priority) if r.fact is None or r.fact in on)
        assert (row.verdict.rule, row.verdict.status, row.verdict.code) == (rule.name, rule.status, rule.code)
        listed = list(dict.fromkeys(code for fact, code in CODE_BY_FACT if fact in on)) or ["NONE"]
        assert row.reason_codes == listed
        if rule.fact not in (None, "fully_clean"):
            assert rule.code in listed
        skipped = on & {"no_candidates_found", "missing_invoice", "is_ambiguous", "duplicate_detected"}
        failed = bool(on & {"gst_mismatch", "tds_mismatch", "tax_unverifiable"})
        assert row.tax_verified is (None if skipped else not failed)


def test_priorities_are_dense():
    assert [r.priority for r in sorted(RULES, key=lambda r: r.priority)] == list(range(12))
