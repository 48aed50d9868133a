"""Explanation scoring against facts, its summary, and the report over aligned case tables.

``explanation_scores`` takes one row per case: case_id, category, status, reason_codes, evidence,
confidence_score, claimed_amount, expected_amount, claimed_tax, expected_tax, explanation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import canonical_number, normalise_text, once
from ledgerloom.plans.reports import percent

# Phrases accepted for a reason code or an evidence item besides its own wording.
REASON_ALIASES = {
    "ERR_GST_MISMATCH": (
        "gst mismatch", "goods and services tax mismatch", "gst discrepancy", "gst tax mismatch", "gst difference",
    ),
    "ERR_TDS_VARIANCE": (
        "tds variance", "tax deducted at source variance", "tds discrepancy", "tds difference",
        "tax deduction variance", "tax deduction discrepancy",
    ),
    "ERR_AMOUNT_MISMATCH": (
        "amount mismatch", "amount discrepancy", "amount difference", "claimed amount differs",
        "amount does not match", "total amount mismatch",
    ),
    "ERR_MISSING_EVIDENCE": (
        "missing evidence", "required evidence missing", "reconciliation evidence missing",
        "evidence was not provided", "required reconciliation evidence was not provided",
    ),
}
EVIDENCE_ALIASES = {
    "transaction reference matched": (
        "transaction reference matched", "transaction reference was successfully validated",
        "transaction reference was validated", "reference matched", "reference was validated",
    ),
    "GST mismatch": ("gst mismatch", "gst discrepancy", "gst tax mismatch", "goods and services tax mismatch"),
    "TDS variance": ("tds variance", "tds discrepancy", "tax deduction variance", "tax deducted at source variance"),
    "amount mismatch": ("amount mismatch", "amount discrepancy", "amount difference", "amount does not match"),
    "required reconciliation evidence missing": (
        "required reconciliation evidence is missing", "required reconciliation evidence missing",
        "reconciliation evidence is missing", "required evidence is missing", "evidence is missing",
    ),
    "all deterministic reconciliation checks passed": (
        "all deterministic reconciliation checks passed", "all reconciliation checks passed",
        "all deterministic checks passed", "reconciliation checks passed successfully", "all checks passed",
    ),
}
# Phrases that contradict a status.
FORBIDDEN = {
    "REVIEW": (
        "successfully matched", "matched successfully", "transaction is matched", "status is match",
        "status of match", "approved", "approved successfully",
    ),
    "MATCH": (
        "requires review", "needs review", "flagged for review", "status is review", "status of review",
        "reconciliation failed", "mismatch requires review",
    ),
}
# A money-looking decimal, and what around it makes it something else.
DECIMAL = r"(?<![A-Za-z0-9_])(?:₹\s*)?[0-9][0-9,]*\.[0-9]{1,2}(?![A-Za-z0-9_])"
_CONFIDENCE_BEFORE = (
    r"\bconfidence\s*$|\bconfidence\s+(?:score|level)\s*$"
    r"|\bconfidence\s+(?:score|level)\s+(?:is|of|:|=)\s*$|\bconfidence\s+(?:is|of|:|=)\s*$"
)
_CONFIDENCE_AFTER = r"^\s*%?\s*confidence\b"
_PERCENT_AFTER = r"^\s*(?:%|percent|percentage)\b"
_PERCENT_BEFORE = r"(?:%|percent|percentage)\s*$"
_IDENTIFIER_BEFORE = (
    r"\btxn[_\-\s]*$|\btransaction\s+(?:id|reference|ref)\s*(?:is|:|=)?\s*$"
    r"|\b(?:invoice|reference|batch)\s+(?:number|no|id)?\s*(?:is|:|=)?\s*$|\bref\s*(?:is|:|=)?\s*$"
)
_DATE_NEAR = r"\b20[0-9]{2}[-/][0-9]{1,2}[-/][0-9]{1,2}\b"
_MONEY_WORD = r"\b(?:amount|tax|gst|tds|payment|charge|fee|balance)\b"
_CONFIDENCE_REACH = 80
_NEIGHBOURS = _CONFIDENCE_REACH // 4 + 2

AMOUNTS = ("claimed_amount", "expected_amount")
TAXES = ("claimed_tax", "expected_tax")


def _occurrences(text: Column) -> Column:
    """Each decimal of a text with its surroundings.

    A sentence part ends at a full stop, and every decimal holds one, so it reaches no further than the next decimal on
    either side; the fixed reaches are at most ``_CONFIDENCE_REACH`` characters. A decimal and what separates it from
    the next have at least four, so ``_NEIGHBOURS`` of them are enough, and a long text costs no more than its length.
    """
    cut = F.struct(
        F.split(text, DECIMAL, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(DECIMAL), F.lit(0)).alias("numbers")
    )

    def around(x: Column) -> Column:
        pieces, numbers = x["pieces"], x["numbers"]

        def joined(start: Column, n: Column) -> Column:
            both = F.zip_with(
                F.slice(pieces, start, n), F.slice(numbers, start, n), lambda p, d: F.concat(p, F.coalesce(d, F.lit("")))
            )
            return F.array_join(both, "")

        def at(number: Column, i: Column) -> Column:
            start = F.greatest(i - _NEIGHBOURS + 1, F.lit(1))
            before = F.concat(joined(start, i - start + 1), F.get(pieces, i))
            after = joined(i + 2, F.lit(_NEIGHBOURS))
            return F.struct(number.alias("number"), before.alias("before"), after.alias("after"))

        return F.transform(numbers, at)

    # once for a text, not once for each decimal
    return once(cut, around)


def _last(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def _sentence(before: Column, after: Column) -> tuple[Column, Column]:
    """What stands between the ends of sentences on either side. A regular expression would try every place of the text
    and walk to the next end from each."""
    # as for ``$``, a line break at the very end counts for nothing
    size = F.length(before)
    open_end = (
        F.when(before.endswith("\r\n"), F.left(before, size - 2)).when(before.endswith("\n"), F.left(before, size - 1)).otherwise(before)
    )
    left, right = open_end, after
    for end in ".!?\n":
        left, right = F.substring_index(left, end, -1), F.substring_index(right, end, 1)
    return left, right


def _is_money(o: Column) -> Column:
    """Anything that is not confidence, a percentage, an identifier or a date counts as a claim."""

    def other(x: Column) -> Column:
        before, after, left, right = x["before"], x["after"], x["left"], x["right"]
        sentence = F.concat(left, x["number"], right)
        near = left.rlike(rf"\bconfidence\b[^\n]{{0,{_CONFIDENCE_REACH - len('confidence')}}}$") | F.concat(
            x["number"], right
        ).rlike(rf"^[^\n]{{0,{_CONFIDENCE_REACH}}}?\bconfidence\b")
        about_confidence = F.contains(sentence, F.lit("confidence")) & (
            F.contains(sentence, F.lit("confidence score")) | (sentence.rlike(r"\bconfidence\b") & ~sentence.rlike(_MONEY_WORD))
        )
        confidence = (
            _last(before, 72).rlike(_CONFIDENCE_BEFORE)
            | F.substring(after, 1, 72).rlike(_CONFIDENCE_AFTER)
            | (about_confidence & near)
        )
        share = F.substring(after, 1, 24).rlike(_PERCENT_AFTER) | _last(before, 24).rlike(_PERCENT_BEFORE)
        identifier = _last(before, 48).rlike(_IDENTIFIER_BEFORE)
        date = F.concat(_last(o["before"], 20), o["number"], F.substring(o["after"], 1, 20)).rlike(_DATE_NEAR)
        return ~(confidence | share | identifier | date)

    def lowered(x: Column) -> Column:
        left, right = _sentence(x["before"], x["after"])
        whole = F.struct(x["before"], x["after"], left.alias("left"), right.alias("right"), x["number"])
        return once(whole, other)

    return once(F.struct(F.lower(o["before"]).alias("before"), F.lower(o["after"]).alias("after"), o["number"]), lowered)


def _known(values: Column, aliases: dict[str, tuple[str, ...]], text: Column) -> Column:
    """Whether every value, or a phrase accepted for it, is said."""

    def said(v: Column) -> Column:
        hit = F.contains(text, normalise_text(v))
        for name, phrases in aliases.items():
            for phrase in phrases:
                hit = hit | ((v == name) & F.contains(text, F.lit(phrase)))
        return hit

    return F.forall(values, said)


def explanation_scores(cases: DataFrame) -> DataFrame:
    said = F.col("_said")
    fields = {f: canonical_number(F.col(f)).alias(f"_{f}") for f in (*AMOUNTS, *TAXES)}
    rows = cases.select(
        "*",
        normalise_text(F.col("explanation")).alias("_said"),
        canonical_number(F.col("confidence_score").cast("string")).alias("_confidence"),
        *fields.values(),
    )

    def stated(field: str) -> Column:
        return F.col(field).isNull() | F.contains(said, F.col(f"_{field}"))

    supplied = F.array_compact(F.array(*[f"_{f}" for f in fields]))
    claims = F.transform(F.filter(_occurrences(F.col("explanation")), _is_money), lambda o: canonical_number(o["number"]))
    against = [
        F.when((F.col("status") == status) & F.contains(said, F.lit(p)), p) for status, phrases in FORBIDDEN.items() for p in phrases
    ]

    def both(fields: tuple[str, ...]) -> Column:
        return reduce(lambda a, b: a & b, [stated(f) for f in fields])

    missing = [
        F.when(~F.col("status_preserved"), F.concat(F.lit("status:"), "status")),
        *[F.when(~stated(f), F.concat(F.lit(f"{f}:"), f)) for f in (*AMOUNTS, *TAXES)],
        F.when(~F.col("confidence_preserved"), F.concat(F.lit("confidence_score:"), F.col("confidence_score").cast("string"))),
    ]
    flags = (
        rows.withColumn("status_preserved", F.contains(said, normalise_text(F.col("status"))))
        .withColumn("amounts_preserved", both(AMOUNTS))
        .withColumn("tax_preserved", both(TAXES))
        .withColumn("confidence_preserved", F.coalesce(F.contains(said, F.col("_confidence")), F.lit(True)))
        .withColumn("reason_codes_preserved", _known(F.col("reason_codes"), REASON_ALIASES, said))
        .withColumn("evidence_preserved", _known(F.col("evidence"), EVIDENCE_ALIASES, said))
        .withColumn("contradictions", F.array_compact(F.array(*against)))
        .withColumn("unsupported_claims", F.array_sort(F.array_except(F.array_distinct(claims), supplied)))
        .withColumn("missing_facts", F.array_compact(F.array(*missing)))
    )
    unsafe = (F.size("contradictions") > 0) | (F.size("unsupported_claims") > 0)
    weights = {
        "status_preserved": 20,
        "amounts_preserved": 20,
        "tax_preserved": 20,
        "confidence_preserved": 10,
        "reason_codes_preserved": 15,
        "evidence_preserved": 15,
    }
    total = reduce(lambda a, b: a + b, [F.when(F.col(f), w).otherwise(0) for f, w in weights.items()])
    return flags.withColumn("safety_critical", unsafe).select(
        "case_id",
        "category",
        *weights,
        "contradictions",
        "unsupported_claims",
        "missing_facts",
        "safety_critical",
        (~F.col("safety_critical") & (F.size("missing_facts") == 0)).alias("semantically_faithful"),
        F.when(F.col("safety_critical"), 0).otherwise(total).alias("score"),
    )


def explanation_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.count("*").alias("total"),
        *[
            F.count_if(f).alias(f)
            for f in (
                "status_preserved", "amounts_preserved", "tax_preserved", "confidence_preserved",
                "reason_codes_preserved", "evidence_preserved", "semantically_faithful", "safety_critical",
            )
        ],
        F.count_if(F.size("contradictions") > 0).alias("contradictory_cases"),
        F.count_if(F.size("unsupported_claims") > 0).alias("unsupported_claim_cases"),
    )


def case_alignment(dataset: DataFrame, generated: DataFrame, scored: DataFrame) -> DataFrame:
    """Case ids absent from at least one of the three tables. Must be empty."""

    def ids(df: DataFrame, name: str) -> DataFrame:
        return df.select("case_id").distinct().withColumn(name, F.lit(True))

    joined = (
        ids(dataset, "in_dataset")
        .join(ids(generated, "in_generated"), "case_id", "full_outer")
        .join(ids(scored, "in_scored"), "case_id", "full_outer")
        .fillna(False, ["in_dataset", "in_generated", "in_scored"])
    )
    return joined.filter(~(F.col("in_dataset") & F.col("in_generated") & F.col("in_scored")))


def faithfulness_report(dataset: DataFrame, generated: DataFrame, scores: DataFrame) -> DataFrame:
    """Coverage, safety and quality rates in percent. Misaligned case tables are an error.

    ``generated``: case_id, succeeded.
    """
    if not case_alignment(dataset, generated, scores).isEmpty():
        raise ValueError("case tables do not hold the same case ids")
    rows = scores.join(generated.select("case_id", "succeeded"), "case_id")
    measures = {
        "generation_success": F.col("succeeded"),
        "safety_failure": F.col("safety_critical"),
        "contradiction": F.size("contradictions") > 0,
        "unsupported_claim": F.size("unsupported_claims") > 0,
        "semantic_faithfulness": F.col("semantically_faithful"),
        "status_preserved": F.col("status_preserved"),
        "amounts_preserved": F.col("amounts_preserved"),
        "tax_preserved": F.col("tax_preserved"),
        "confidence_preserved": F.col("confidence_preserved"),
        "reason_codes_preserved": F.col("reason_codes_preserved"),
        "evidence_preserved": F.col("evidence_preserved"),
    }
    counts = rows.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in measures.items()])
    lines = F.array(
        *[F.struct(F.lit(n).alias("measure"), F.col(n).alias("cases"), F.col("total").alias("total")) for n in measures]
    )
    flat = counts.select(F.explode(lines).alias("x")).select("x.*")
    return flat.withColumn("rate_percent", percent(F.col("cases"), F.col("total"), 4))


def faithfulness_gaps(scores: DataFrame) -> DataFrame:
    """Cases behind each quality gap."""
    gaps = F.array_compact(
        F.array(
            F.when(~F.col("reason_codes_preserved"), "reason_code_semantic_gap"),
            F.when(~F.col("evidence_preserved"), "evidence_semantic_gap"),
            F.when(F.size("missing_facts") > 0, "material_fact_gap"),
        )
    )
    return scores.select(F.explode(gaps).alias("gap"), "case_id")
