"""Evaluation jobs over text: extraction quality, question routing, explanations and their grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import money_text
from ledgerloom.functions.narration import narration_txn_id
from ledgerloom.functions.text import contains_normalised, numeric_literals, squeezed
from ledgerloom.operators.selection import order_statistics
from ledgerloom.session import stage
from ledgerloom.plans.reports import percent



def _share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part / F.nullif(whole, F.lit(0)), 4))


# --- narration extraction --------------------------------------------------------------------


def _extraction_counts(counted: Column) -> list[Column]:
    """Quality counts over the rows where ``counted`` holds."""
    expected, predicted = F.col("expected"), F.col("predicted")
    same = predicted.eqNullSafe(expected)
    return [
        F.count_if(counted & same).alias("correct"),
        F.count_if(counted & expected.isNotNull()).alias("positive_cases"),
        F.count_if(counted & expected.isNotNull() & same).alias("true_positive"),
        F.count_if(counted & predicted.isNotNull()).alias("proposed"),
        F.count_if(counted & predicted.isNotNull() & ~same).alias("false_proposals"),
    ]


def _extraction_rates(cases: str) -> list[Column]:
    return [
        _share(F.col("correct"), F.col(cases)).alias("accuracy"),
        _share(F.col("true_positive"), F.col("proposed")).alias("precision"),
        _share(F.col("true_positive"), F.col("positive_cases")).alias("recall"),
        _share(F.col("false_proposals"), F.col(cases)).alias("false_proposal_rate"),
        _share(F.col("abstentions"), F.col(cases)).alias("abstention_rate"),
    ]


def narration_metrics(cases: DataFrame) -> DataFrame:
    """Quality of the pattern extractor. ``cases``: narration, expected (nullable id)."""
    rows = cases.withColumn("predicted", narration_txn_id(F.col("narration")))
    counts = rows.agg(
        F.count("*").alias("total"), *_extraction_counts(F.lit(True)), F.count_if(F.col("predicted").isNull()).alias("abstentions")
    )
    return counts.select("*", *_extraction_rates("total"))


def extraction_outcome(error: Column, predicted: Column) -> Column:
    """Class of a recorded extraction call, from its error text."""

    def says(*words: str) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(error), F.lit(w))
        return hit

    return (
        F.when(error.isNull(), F.when(predicted.isNull(), "abstention").otherwise("success"))
        .when(says("timeout", "timed out", "exceeded 10s"), "timeout")
        .when(says("429", "resource_exhausted", "quota"), "quota_failure")
        .when(says("parse", "schema", "validation"), "parse_failure")
        .otherwise("provider_failure")
    )


def extraction_metrics(outcomes: DataFrame) -> DataFrame:
    """Metrics of recorded extraction outcomes: expected, predicted, error, latency, id.

    Quality counts only evaluated calls, so an outage cannot look like caution.
    """
    rows = outcomes.withColumn("outcome", extraction_outcome(F.col("error"), F.col("predicted")))
    evaluated = F.col("outcome").isin("success", "abstention")
    counts = rows.agg(
        F.count("*").alias("total"),
        F.count_if(evaluated).alias("evaluated_cases"),
        *_extraction_counts(evaluated),
        F.count_if(F.col("outcome") == "abstention").alias("abstentions"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("timeout", "quota_failure", "parse_failure", "provider_failure")],
    )
    timed = rows.filter(evaluated & F.col("latency").isNotNull()).select("latency")
    timed = stage(timed, "latencies")
    n = timed.count()
    # nearest rank on positions 0..n-1, ties to even; the median averages the two middle rows
    p95 = round((n - 1) * 0.95) + 1
    low, high, late = order_statistics(timed, "latency", [(n + 1) // 2, (n + 2) // 2, p95])
    middle = None if low is None else (low + high) / 2
    return counts.select(
        "*",
        F.lit(middle).cast("double").alias("median_latency"),
        F.lit(late).cast("double").alias("p95_latency"),
        _share(F.col("evaluated_cases"), F.col("total")).alias("coverage"),
        *_extraction_rates("evaluated_cases"),
    )


# --- question routing ------------------------------------------------------------------------

# Keyword rules, tried in this order.
ROUTES = (
    ("get_evidence", ("txn_",)),
    (
        "get_cash_position",
        ("money", "cash", "rupee", "amount", "value", "blocked", "stuck", "owed", "variance", "settled"),
    ),
    ("get_throughput_report", ("fast", "speed", "throughput", "long", "performance")),
    ("get_exceptions", ("exception", "unresolved", "resolve", "failed", "review", "ambiguous", "mismatch")),
    ("get_match_rate", ("match rate", "matched", "overall", "reconcil", "tier")),
)
NO_TOOL = "none"
TOOLS = tuple(name for name, _ in ROUTES)
_STATUS_WORDS = ("HUMAN_REVIEW", "AMBIGUOUS", "TAX_MISMATCH", "PARTIAL_MATCH", "UNMATCHED", "MATCHED")


def keyword_route(question: Column) -> Column:
    q = F.lower(question)
    out = F.lit(NO_TOOL)
    for tool, words in reversed(ROUTES):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(q, F.lit(w))
        out = F.when(hit, tool).otherwise(out)
    return out


def keyword_argument(question: Column, tool: Column) -> Column:
    """The id or status a question names, where its tool takes one."""
    q = F.lower(question)
    start = F.locate("txn_", q)
    # an id has five to eight digits; anything else after the prefix is cut where the shortest id would end
    known = F.nullif(F.regexp_extract(F.upper(question), "TXN_[0-9]{5,8}", 0), F.lit(""))
    other = F.regexp_replace(F.upper(F.substr(question, start, F.lit(9))), r"^[ ?.,\-]+|[ ?.,\-]+$", "")
    token = F.coalesce(known, other)
    status = F.lit(None).cast("string")
    for name in reversed(_STATUS_WORDS):
        status = F.when(F.contains(q, F.lit(name.replace("_", " ").lower())), name).otherwise(status)
    return F.when(tool == "get_evidence", token).when(tool == "get_exceptions", status)


def selection_rows(recorded: DataFrame) -> DataFrame:
    """Verdicts for recorded selections: expected, selected, expected_argument, selected_argument, error."""
    tool_ok = F.coalesce(F.col("selected") == F.col("expected"), F.lit(False))
    return recorded.withColumn("tool_correct", tool_ok).withColumn(
        "arguments_correct", tool_ok & F.col("selected_argument").eqNullSafe(F.col("expected_argument"))
    ).withColumn("selection_valid", F.coalesce(F.col("selected").isin(NO_TOOL, *TOOLS), F.lit(False)))


def selection_metrics(rows: DataFrame) -> DataFrame:
    def starts(prefix: str) -> Column:
        return F.coalesce(F.col("error").startswith(prefix), F.lit(False))

    counts = rows.groupBy("category").agg(
        F.count("*").alias("total_cases"),
        F.count_if("tool_correct").alias("tool_correct"),
        F.count_if("arguments_correct").alias("arguments_correct"),
        F.count_if(~F.col("selection_valid")).alias("invalid_selections"),
        F.count_if(starts("provider_failure")).alias("provider_failures"),
        F.count_if(starts("parse_failure")).alias("parse_failures"),
    )
    return counts.select(
        "*",
        percent(F.col("tool_correct"), F.col("total_cases"), 2).alias("tool_accuracy_pct"),
        percent(F.col("arguments_correct"), F.col("total_cases"), 2).alias("arguments_accuracy_pct"),
    )


def selection_confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("expected", F.coalesce("selected", F.lit("<none returned>")).alias("selected")).agg(
        F.count("*").alias("n")
    )


# --- explanations ----------------------------------------------------------------------------


def _facts() -> list[Column]:
    return [
        F.filter("reason_codes", lambda c: c != "NONE").alias("reason_codes"),
        F.array().cast("array<string>").alias("evidence"),
        money_text(F.col("bank.amount")).alias("claimed_amount"),
        F.when(F.col("bank").isNotNull(), money_text(F.col("expected_net"))).alias("expected_amount"),
        F.lit(None).cast("string").alias("claimed_tax"),
        F.lit(None).cast("string").alias("expected_tax"),
    ]


def _sentence() -> Column:
    reasons = F.array_join(F.filter("reason_codes", lambda c: c != "NONE"), ", ")
    return F.when(
        F.col("status") == "MATCHED",
        F.format_string("Transaction %s matched successfully across all sources with no exceptions.", "txn_id"),
    ).otherwise(
        F.format_string(
            "Transaction %s was flagged as %s. Violated condition(s): %s. Confidence score: %d.",
            F.col("txn_id"),
            F.col("status"),
            F.when(reasons == "", "see evidence for details").otherwise(reasons),
            F.col("confidence_score"),
        )
    )


def explanation_facts(decided: DataFrame) -> DataFrame:
    """What an explanation of a decision must state. NONE is not a reason; tax amounts are not carried."""
    return decided.select("txn_id", "status", "confidence_score", *_facts())


def explanation_text(decided: DataFrame) -> DataFrame:
    """Deterministic explanation per decision."""
    return decided.select("txn_id", _sentence().alias("explanation"))


def explained(decided: DataFrame, *more: Column) -> DataFrame:
    """Facts and explanation side by side, with the feed position and what else a reader needs of the decision."""
    return decided.select(
        "src_pos", "txn_id", "status", "confidence_score", *_facts(), _sentence().alias("explanation"), *more
    )


# Words that contradict an evaluation status.
_CONTRADICTIONS = (
    ("MATCH", ("review", "rejected", "exception")),
    ("REVIEW", ("matched", "approved", "settled")),
    ("REJECT", ("matched", "approved")),
)


def explanation_violations(rows: DataFrame) -> DataFrame:
    """Facts an explanation leaves out and words that contradict its status.

    ``rows``: explanation_facts columns plus ``explanation``.
    """
    text = F.trim(F.coalesce("explanation", F.lit("")))

    def lacks(value: Column) -> Column:
        return ~contains_normalised(text, value)

    def missing(field: str) -> Column:
        return F.when(F.col(field).isNotNull() & lacks(F.col(field)), F.concat(F.lit(f"missing_{field}:"), F.col(field)))

    def listed(column: str, label: str) -> Column:
        absent = F.filter(column, lambda v: (v != "") & ~contains_normalised(text, v))
        return F.transform(absent, lambda v: F.concat(F.lit(f"{label}:"), v))

    against = []
    for status, words in _CONTRADICTIONS:
        for w in words:
            said = squeezed(text).rlike(rf"\b{w}\b")
            against.append(F.when((F.upper("status") == status) & said, f"contradictory_status:{w}"))
    found = F.concat(
        F.array_compact(F.array(F.when((F.col("status") != "") & lacks(F.col("status")), "missing_verified_status"))),
        listed("reason_codes", "missing_reason_code"),
        listed("evidence", "missing_evidence"),
        F.array_compact(F.array(*[missing(f) for f in ("claimed_amount", "expected_amount", "claimed_tax", "expected_tax")])),
        F.array_compact(F.array(*against)),
    )
    return rows.withColumn(
        "violations", F.when(text == "", F.array(F.lit("empty_explanation"))).otherwise(found)
    ).withColumn("passed", F.size("violations") == 0)


def ungrounded_numbers(rows: DataFrame) -> DataFrame:
    """Numbers an answer states that its payload does not contain. ``rows``: answer, payload (JSON or text)."""
    extra = F.array_sort(F.array_except(numeric_literals(F.col("answer")), numeric_literals(F.col("payload"))))
    return rows.withColumn("ungrounded", extra).withColumn("grounded", F.size("ungrounded") == 0)
