"""Candidate resolution: one self-consistent match row per anchor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.candidates import candidate_sets
from ledgerloom.operators.scoring import auto_matchable, confidence_tier, with_score


def _reason(count: str, match_type: str, ties: str) -> Column:
    n = F.col(count)
    return (
        F.when(n == 0, "no candidates found")
        .when(n == 1, F.concat(F.lit("only candidate found via "), F.col(match_type)))
        .otherwise(
            F.concat(
                F.lit("selected from "), n.cast("string"), F.lit(" candidates via "), F.col(match_type), F.lit(ties)
            )
        )
    )


# Audit texts.
_BANK_TIES = " tier; tie-broken by lowest date delta, then expected-net amount delta, then utr"
_INVOICE_TIES = " tier; tie-broken by lowest expected-invoice amount delta, then txn_id"
_DUPLICATE_NOTE = "duplicate candidate set detected"
_RIVAL_NOTE = "multiple competing candidates detected"
_NOT_SAFE_NOTE = "selected pairing is non-authoritative for downstream financial reconciliation"


def resolve(candidates: DataFrame) -> DataFrame:
    """Structural state, score, confidence and authority. The winner never overrides ambiguity."""
    rivals = (
        (F.col("bank_candidate_count") > 1)
        | (F.col("invoice_candidate_count") > 1)
        | (F.col("bank_ambiguity_count") > 0)
        | (F.col("invoice_ambiguity_count") > 0)
    )
    scored = with_score(candidates.withColumn("is_ambiguous", ~F.col("duplicate_detected") & rivals))
    s = F.col("score")
    tier = confidence_tier(s["normalized_score"], s["txn_id_matched_bank"] | s["txn_id_matched_invoice"])
    uncertain = F.col("is_ambiguous") | F.col("duplicate_detected")
    graded = scored.withColumn("_tier", tier).withColumn(
        "confidence", F.when(uncertain & auto_matchable(F.col("_tier")), "LOW").otherwise(F.col("_tier"))
    )
    safe = (F.col("confidence") != "NO_MATCH") & ~uncertain & (s["bank_present"] | s["invoice_present"])
    return (
        graded.drop("_tier")
        .withColumn("authoritative_match", safe)
        .withColumn(
            "sources_present",
            F.array_compact(
                F.array(F.lit("pg"), F.when(s["bank_present"], "bank"), F.when(s["invoice_present"], "invoice"))
            ),
        )
        .withColumn(
            "selection_reason",
            F.concat_ws(
                "; ",
                F.concat(F.lit("bank: "), _reason("bank_candidate_count", "bank_match_type", _BANK_TIES)),
                F.concat(F.lit("invoice: "), _reason("invoice_candidate_count", "invoice_match_type", _INVOICE_TIES)),
                F.when(F.col("duplicate_detected"), _DUPLICATE_NOTE).when(F.col("is_ambiguous"), _RIVAL_NOTE),
                F.when(~F.col("authoritative_match"), _NOT_SAFE_NOTE),
            ),
        )
    )


def structural_evidence(matches: DataFrame) -> DataFrame:
    return matches.select(
        "txn_id",
        F.struct(
            "is_ambiguous",
            "duplicate_detected",
            "bank_candidate_count",
            "invoice_candidate_count",
            F.col("bank_ambiguity_count").alias("additional_bank_ambiguity_count"),
            F.col("invoice_ambiguity_count").alias("additional_invoice_ambiguity_count"),
            "bank_match_type",
            "invoice_match_type",
        ).alias("structure"),
    )


def match_invariants(matches: DataFrame) -> DataFrame:
    """Rows that contradict themselves, with the broken rule. Must be empty."""
    has = F.array_contains
    present = F.col("sources_present")
    rules = {
        "negative_bank_count": F.col("bank_candidate_count") < 0,
        "negative_invoice_count": F.col("invoice_candidate_count") < 0,
        "negative_ambiguity_count": F.col("bank_ambiguity_count") < 0,
        "pg_missing": ~has(present, "pg"),
        "bank_unlisted": F.col("bank").isNotNull() & ~has(present, "bank"),
        "invoice_unlisted": F.col("invoice").isNotNull() & ~has(present, "invoice"),
        "authority_without_match": F.col("authoritative_match") & (F.col("confidence") == "NO_MATCH"),
        "authority_while_ambiguous": F.col("authoritative_match") & F.col("is_ambiguous"),
        "authority_while_duplicate": F.col("authoritative_match") & F.col("duplicate_detected"),
        "authority_without_source": F.col("authoritative_match") & F.col("bank").isNull() & F.col("invoice").isNull(),
    }
    broken = F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()]))
    return matches.select("txn_id", F.explode(broken).alias("broken_rule"))


def matching_summary(matches: DataFrame) -> DataFrame:
    tier = F.col("confidence")
    return matches.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(tier == "HIGH").alias("high"),
        F.count_if(tier == "MEDIUM").alias("medium"),
        F.count_if(tier == "LOW").alias("low"),
        F.count_if(tier == "NO_MATCH").alias("no_match"),
        F.count_if("is_ambiguous").alias("ambiguous_flagged"),
    )
