"""Policy: eleven facts per match, one primary verdict, every violated code."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import config as C
from ledgerloom.functions.money import within_amount
from ledgerloom.operators.scoring import auto_matchable, signals
from ledgerloom.operators.tax import with_tax

FACTS = (
    "no_candidates_found",
    "is_ambiguous",
    "duplicate_detected",
    "low_confidence",
    "missing_bank",
    "missing_invoice",
    "amount_mismatch",
    "gst_mismatch",
    "tds_mismatch",
    "tax_unverifiable",
    "fully_clean",
)


@dataclass(frozen=True)
class Rule:
    priority: int
    name: str
    fact: str | None  # None always applies
    status: str
    code: str


# The policy, lowest priority number first.
RULES = (
    Rule(0, "no_candidates_at_all", "no_candidates_found", "UNMATCHED", "HUMAN_REVIEW_REQUIRED"),
    Rule(1, "duplicate_detected", "duplicate_detected", "HUMAN_REVIEW", "DUPLICATE_DETECTED"),
    Rule(2, "ambiguous_takes_priority_over_tax_and_confidence_state", "is_ambiguous", "AMBIGUOUS", "AMBIGUOUS_MATCH"),
    Rule(3, "amount_mismatch", "amount_mismatch", "HUMAN_REVIEW", "AMOUNT_MISMATCH"),
    Rule(4, "missing_bank_unmatched", "missing_bank", "UNMATCHED", "MISSING_IN_BANK"),
    Rule(5, "missing_invoice_otherwise_clean", "missing_invoice", "PARTIAL_MATCH", "MISSING_IN_INVOICE"),
    Rule(6, "low_confidence_requires_human_review", "low_confidence", "HUMAN_REVIEW", "REFERENCE_MISMATCH"),
    Rule(7, "gst_mismatch_takes_priority_over_tds", "gst_mismatch", "TAX_MISMATCH", "ERR_GST_MISMATCH"),
    Rule(8, "tds_mismatch", "tds_mismatch", "TAX_MISMATCH", "ERR_TDS_VARIANCE"),
    Rule(9, "tax_unverifiable_but_matched", "tax_unverifiable", "HUMAN_REVIEW", "HUMAN_REVIEW_REQUIRED"),
    Rule(10, "fully_clean_match", "fully_clean", "MATCHED", "NONE"),
    Rule(11, "catch_all_unresolved_state", None, "HUMAN_REVIEW", "HUMAN_REVIEW_REQUIRED"),
)
CATCH_ALL = RULES[-1].name

# Order in which violated codes are listed.
CODE_BY_FACT = (
    ("no_candidates_found", "HUMAN_REVIEW_REQUIRED"),
    ("duplicate_detected", "DUPLICATE_DETECTED"),
    ("is_ambiguous", "AMBIGUOUS_MATCH"),
    ("amount_mismatch", "AMOUNT_MISMATCH"),
    ("low_confidence", "REFERENCE_MISMATCH"),
    ("gst_mismatch", "ERR_GST_MISMATCH"),
    ("tds_mismatch", "ERR_TDS_VARIANCE"),
    ("missing_bank", "MISSING_IN_BANK"),
    ("missing_invoice", "MISSING_IN_INVOICE"),
    ("tax_unverifiable", "HUMAN_REVIEW_REQUIRED"),
)


def context(matches: DataFrame) -> DataFrame:
    """Adds ``seller_gross``, ``tax`` and the struct ``context`` of the eleven facts."""
    rows = with_tax(matches)
    no_bank, no_invoice = F.col("bank").isNull(), F.col("invoice").isNull()
    settled = ~F.col("is_ambiguous") & ~F.col("duplicate_detected")
    amount_off = ~F.coalesce(within_amount(F.col("bank.amount"), F.col("expected_net")), F.lit(True))
    taxed = settled & ~no_invoice
    known = F.col("seller_gross").isNotNull()
    facts = F.struct(
        (no_bank & no_invoice).alias("no_candidates_found"),
        F.col("is_ambiguous"),
        F.col("duplicate_detected"),
        (settled & ~no_bank & ~no_invoice & ~auto_matchable(F.col("confidence"))).alias("low_confidence"),
        no_bank.alias("missing_bank"),
        no_invoice.alias("missing_invoice"),
        (settled & ~no_bank & amount_off).alias("amount_mismatch"),
        (taxed & known & ~F.col("tax.gst.verified")).alias("gst_mismatch"),
        (taxed & known & ~F.col("tax.tds.verified")).alias("tds_mismatch"),
        (taxed & ~known).alias("tax_unverifiable"),
    )
    staged = rows.withColumn("context", facts)
    dirty = F.lit(False)
    for name in FACTS[:-1]:
        dirty = dirty | F.col(f"context.{name}")
    return staged.withColumn("context", F.col("context").withField("fully_clean", ~dirty))


def verdict(facts: Column) -> Column:
    """The first applicable rule, as one CASE over the facts."""

    def outcome(rule: Rule) -> Column:
        return F.struct(
            F.lit(rule.name).alias("rule"),
            F.lit(rule.status).alias("status"),
            F.lit(rule.code).alias("code"),
            F.lit(rule.priority).alias("priority"),
        )

    ordered = sorted(RULES, key=lambda r: r.priority)
    case = outcome(ordered[-1])
    for rule in reversed(ordered[:-1]):
        case = F.when(facts[rule.fact], outcome(rule)).otherwise(case)
    return case


def reason_codes(facts: Column) -> Column:
    """Every violated code once, in policy order; NONE when there is none."""
    listed = F.array_distinct(F.array_compact(F.array(*[F.when(facts[f], code) for f, code in CODE_BY_FACT])))
    return F.when(F.size(listed) == 0, F.array(F.lit("NONE"))).otherwise(listed)


def tax_evaluated(facts: Column) -> Column:
    return ~(
        facts["no_candidates_found"] | facts["missing_invoice"] | facts["is_ambiguous"] | facts["duplicate_detected"]
    )


def tax_verified(facts: Column) -> Column:
    """True or false only where tax was evaluated; null claims nothing."""
    failed = facts["gst_mismatch"] | facts["tds_mismatch"] | facts["tax_unverifiable"]
    return F.when(tax_evaluated(facts), ~failed)


def decide(matches: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Match rows with their decision. ``confidence_score`` is the raw total, not the normalised one."""
    rows = context(matches)
    facts = F.col("context")
    judged = rows.withColumn("_v", verdict(facts))
    return judged.select(
        *matches.columns,
        "seller_gross",
        "tax",
        "context",
        F.col("_v.status").alias("status"),
        F.col("_v.code").alias("exception_code"),
        F.col("_v.rule").alias("matched_rule"),
        F.col("_v.priority").alias("policy_priority"),
        reason_codes(facts).alias("reason_codes"),
        F.col("score.total_score").alias("confidence_score"),
        tax_evaluated(facts).alias("tax_evaluated"),
        tax_verified(facts).alias("tax_verified"),
    )


def catch_all_alarms(decided: DataFrame) -> DataFrame:
    """Decisions no explicit rule covered. Must be empty on real data."""
    return decided.filter(F.col("matched_rule") == CATCH_ALL)


def policy_sweep(facts: DataFrame) -> DataFrame:
    """Verdict and codes for a table of arbitrary fact combinations."""
    packed = F.struct(*FACTS)
    return facts.withColumn("_f", packed).select(
        *FACTS,
        verdict(F.col("_f")).alias("verdict"),
        reason_codes(F.col("_f")).alias("reason_codes"),
        tax_verified(F.col("_f")).alias("tax_verified"),
    )


def priority_of(rule: Column, code: Column) -> Column:
    """Triage priority by rule name, else the most severe priority of the code, else 99."""
    by_code: dict[str, int] = {}
    for r in RULES:
        by_code[r.code] = min(r.priority, by_code.get(r.code, 99))
    out = F.lit(99)
    for name, priority in by_code.items():
        out = F.when(code == name, priority).otherwise(out)
    for r in RULES:
        out = F.when(rule == r.name, r.priority).otherwise(out)
    return out


assert {r.status for r in RULES} <= set(C.STATUSES)
assert {r.code for r in RULES} <= set(C.EXCEPTION_CODES)
