"""Frozen decisions against replayed ones, field by field on canonical values.

A record is one JSON object for each case. Values are compared as VARIANT written back as text: names of an object in
order, no spaces, numbers as their shortest plain decimal, so neither the order of names nor 1.50 against 1.5 is a
difference. The order of a list is. A field that the frozen record doesn't hold is not compared; one that it holds as
null asks for null or nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields that a frozen record may hold, in the order they are reported.
FROZEN_FIELDS = ("txn_id", "status", "exception_code", "matched_sources", "reason_codes", "evidence")
# Categories whose labels one isolated case cannot show, and where policy overrides the label.
BATCH_RELATIONAL = ("ambiguous", "duplicate")
POLICY_OVERRIDES = ("reference_mismatch_fuzzy",)


def canonical(document: Column, field: str) -> Column:
    """Canonical text of a top-level field of a VARIANT; null where the field is absent, 'null' where it is null."""
    return F.to_json(F.try_variant_get(document, f"$.{field}", "variant"))


def decision_record(*fields: Column) -> Column:
    """One decision as a JSON object. Absent values are left out, as a frozen record leaves them out."""
    return F.to_json(F.struct(*fields))


def compare_records(frozen: DataFrame, actual: DataFrame) -> DataFrame:
    """One row for each case that either side has: its class and its differing fields with both canonical values.

    ``frozen``: case_id, category, document; ``actual``: case_id, document; case_id is unique on each side and the
    documents are JSON objects. A side without a document (or whose text isn't JSON) is missing.
    """
    left = frozen.select("case_id", "category", F.try_parse_json("document").alias("expected"))
    right = actual.select("case_id", F.try_parse_json("document").alias("actual"))
    both = left.join(right, "case_id", "full")
    values = [
        c
        for f in FROZEN_FIELDS
        for c in (canonical(F.col("expected"), f).alias(f"want_{f}"), canonical(F.col("actual"), f).alias(f"got_{f}"))
    ]
    read = both.select("case_id", "category", F.col("expected").isNull().alias("no_expected"), F.col("actual").isNull().alias("no_actual"), *values)

    def difference(f: str) -> Column:
        want, got = F.col(f"want_{f}"), F.coalesce(f"got_{f}", F.lit("null"))
        entry = F.struct(F.lit(f).alias("field"), want.alias("expected"), got.alias("actual"))
        return F.when(want.isNotNull() & (want != got), entry)

    compared = ~F.col("no_expected") & ~F.col("no_actual")
    found = F.array_compact(F.array(*[difference(f) for f in FROZEN_FIELDS]))
    differing = read.withColumn("differences", F.when(compared, found).otherwise(F.filter(found, lambda _: F.lit(False))))
    kind = (
        F.when(F.col("no_expected"), "MISSING_EXPECTED")
        .when(F.col("no_actual"), "MISSING_ACTUAL")
        .when(F.size("differences") == 0, "MATCH")
        .when(F.col("category").isin(*BATCH_RELATIONAL), "NOT_EVALUABLE_PER_CASE")
        .when(F.col("category").isin(*POLICY_OVERRIDES), "KNOWN_POLICY_DIVERGENCE")
        .otherwise("BASELINE_DIVERGENCE")
    )
    return differing.select("case_id", "category", kind.alias("comparison"), "differences")


def field_report(compared: DataFrame) -> DataFrame:
    """How many cases differ in each field, by class."""
    return (
        compared.select("comparison", F.explode("differences").alias("d"))
        .groupBy("comparison", F.col("d.field").alias("field"))
        .agg(F.count(F.lit(1)).alias("cases"))
    )


def baseline(compared: DataFrame) -> DataFrame:
    """Case counts for each class; raw divergence is the sum of its three explained parts, and the baseline is stable
    where no case diverges unexplained and none is missing on either side."""
    c = F.col("comparison")
    of = lambda *kinds: F.count_if(c.isin(*kinds))
    return compared.agg(
        F.count_if(c != "MISSING_EXPECTED").alias("cases"),
        of("MATCH").alias("matched"),
        of("BASELINE_DIVERGENCE").alias("divergent"),
        of("NOT_EVALUABLE_PER_CASE").alias("not_evaluable"),
        of("KNOWN_POLICY_DIVERGENCE").alias("known_policy"),
        of("MISSING_ACTUAL").alias("missing_actual"),
        of("MISSING_EXPECTED").alias("missing_expected"),
        of("BASELINE_DIVERGENCE", "NOT_EVALUABLE_PER_CASE", "KNOWN_POLICY_DIVERGENCE").alias("raw_divergent"),
        (of("BASELINE_DIVERGENCE", "MISSING_ACTUAL", "MISSING_EXPECTED") == 0).alias("stable"),
    )
