import random

from pyspark.sql import functions as F

from ledgerloom.functions.narration import narration_txn_id, resolved_txn_id
from ledgerloom.functions.text import numeric_literals
from ledgerloom.plans import faithfulness as FF
from ledgerloom.plans import text_eval as X


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in rows.orderBy("i").select(expr(F.col("v")).alias("out")).collect()]


def test_numeric_literals(spark):
    texts = ["INR 10,000.00 of ₹292353.70, 90.16%", "txn_001 ABC123 x1", "-5 and .50 and 007", "1,2 2026-08-01", "12.5x", None]
    assert column(spark, texts, numeric_literals) == [
        ["10000", "292353.7", "90.16"],
        [],
        ["-5", "0.5", "7"],
        ["1", "2", "2026", "8"],
        ["12"],
        [],
    ]


def test_narration_ids(spark):
    texts = ["pay txn_00012345 ok", "ref TXN-2026-0001", "PYT_1234567", "TXN_1234", "", None, "PYT_1234567 TXN_55555"]
    assert column(spark, texts, narration_txn_id) == ["TXN_00012345", "TXN-2026-0001", "PYT_1234567", None, None, None, "TXN_55555"]


def test_bank_reference_comes_first(spark):
    rows = spark.createDataFrame(
        [("BANKREF_TXN_00001_DUP", "TXN_99999"), ("BANKREF_", "TXN_99999"), ("HDFC1", None)], "r string, n string"
    ).select(resolved_txn_id(F.col("r"), F.col("n")).alias("t"))
    assert [r.t for r in rows.collect()] == ["TXN_00001", "TXN_99999", None]


def test_keyword_routes(spark):
    asks = ["Why is TXN_00012 blocked?", "How much money is blocked?", "how fast", "show ambiguous ones", "overall match rate", "hello"]
    assert column(spark, asks, X.keyword_route) == [
        "get_evidence", "get_cash_position", "get_throughput_report", "get_exceptions", "get_match_rate", "none",
    ]
    argument = column(spark, asks, lambda q: X.keyword_argument(q, X.keyword_route(q)))
    assert argument == ["TXN_00012", None, None, "AMBIGUOUS", None, None]


def test_explanation_violations(spark):
    schema = (
        "status string, reason_codes array<string>, evidence array<string>, claimed_amount string, expected_amount string, "
        "claimed_tax string, expected_tax string, explanation string"
    )
    rows = spark.createDataFrame(
        [
            ("REVIEW", ["ERR_A"], ["GST mismatch"], "10", None, None, "5", "Review: err_a, gst  mismatch, 10 and 5."),
            ("REVIEW", ["ERR_A"], [], "10", None, None, None, "it was approved"),
            ("MATCHED", [], [], None, None, None, None, "  "),
        ],
        schema,
    )
    got = [r.violations for r in X.explanation_violations(rows).collect()]
    assert got == [
        [],
        ["missing_verified_status", "missing_reason_code:ERR_A", "missing_claimed_amount:10", "contradictory_status:approved"],
        ["empty_explanation"],
    ]


def test_extraction_outcomes(spark):
    errors = ["Timed out", "429", "schema broke", "boom", None]
    rows = spark.createDataFrame([(e, None) for e in errors], "e string, p string")
    got = [r.o for r in rows.select(X.extraction_outcome(F.col("e"), F.col("p")).alias("o")).collect()]
    assert got == ["timeout", "quota_failure", "parse_failure", "provider_failure", "abstention"]


def test_explanation_scores(spark):
    from ledgerloom.plans.faithfulness import explanation_scores

    schema = (
        "case_id string, category string, status string, reason_codes array<string>, evidence array<string>, confidence_score double, "
        "claimed_amount string, expected_amount string, claimed_tax string, expected_tax string, explanation string"
    )
    fact = ("gst", "REVIEW", ["ERR_GST_MISMATCH"], ["GST mismatch"], 94.0, "6.00", "9.00", "6.00", "9.00")
    texts = {
        "clean": "This item is currently in REVIEW status due to a GST mismatch, which has resulted in a 94.0 confidence score. "
        "The claimed amount and tax of 6.00 do not align with the expected amount and tax of 9.00.",
        "stray": "REVIEW: gst discrepancy, confidence score is 94.0. Claimed 6.00, expected 9.00, a gap of ₹1,234.50.",
        "date": "REVIEW: gst discrepancy on invoice number 12.50, confidence 94.0. Claimed 6.00, expected 9.00.",
        "against": "Review was approved: gst mismatch, 94.0 confidence, 6.00 and 9.00.",
        "vague": "REVIEW. Something about 6.00.",
    }
    rows = spark.createDataFrame([(k, *fact, v) for k, v in texts.items()], schema)
    got = {r.case_id: r for r in explanation_scores(rows).collect()}
    assert got["clean"].score == 100 and got["clean"].semantically_faithful
    assert got["stray"].unsupported_claims == ["1234.5"] and got["stray"].score == 0
    assert got["date"].unsupported_claims == [] and got["date"].score == 100
    assert got["against"].contradictions == ["approved"]
    assert got["vague"].missing_facts == ["expected_amount:9.00", "expected_tax:9.00", "confidence_score:94.0"]
    assert got["vague"].score == 20


def test_surroundings_of_decimals_are_cut_once(spark):
    """Each text is split once, and the ends of sentences are as the regular expressions for them have it."""
    rng = random.Random(11)
    texts = ["".join(rng.choice("ab .!?\n\rü") for _ in range(rng.randrange(12))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    left, right = FF._sentence(F.col("t"), F.col("t"))
    wrong = rows.filter(
        (left != F.regexp_extract("t", r"([^.!?\n]*)$", 1)) | (right != F.regexp_extract("t", r"^([^.!?\n]*)", 1))
    )
    assert wrong.collect() == []
    money = rows.select(F.filter(FF._occurrences(F.col("t")), FF._is_money).alias("m"))
    plan = money._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
