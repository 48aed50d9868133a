"""Accuracy against labels and data-quality jobs over labelled feeds. Labels never reach the pipeline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import config as C
from ledgerloom.functions.money import AMOUNT, gst_on, money, within_amount
from ledgerloom.functions.narration import BANK_REF_PREFIX, ref_txn_id
from ledgerloom.operators.candidates import near_rows, scored_pairs
from ledgerloom.operators.gates import gate_join
from ledgerloom.operators.skew import lookup
from ledgerloom.plans.reports import percent
from ledgerloom.session import stage


# Statuses a label of each category may carry.
ALLOWED_STATUSES = (
    ("exact_match", ("MATCHED",)),
    ("timing_difference", ("MATCHED",)),
    ("reference_mismatch_fuzzy", ("MATCHED",)),
    ("amount_fee_discrepancy", ("HUMAN_REVIEW",)),
    ("tax_mismatch", ("TAX_MISMATCH",)),
    ("missing_in_source", ("UNMATCHED", "PARTIAL_MATCH")),
    ("duplicate", ("HUMAN_REVIEW",)),
    ("ambiguous", ("AMBIGUOUS",)),
    ("corrupted", ("UNMATCHED",)),
    ("unresolvable", ("HUMAN_REVIEW",)),
    ("refund", ("UNMATCHED",)),
)


def one_per_txn(rows: DataFrame, *columns: str, last: bool = True) -> DataFrame:
    """One row per transaction id, the last (or first) in feed order.

    Aggregated map-side, so a repeated id is a single row before any join on it.
    """
    pick = F.max_by if last else F.min_by
    kept = rows.groupBy("txn_id").agg(pick(F.struct(*columns), F.col("src_pos")).alias("kept"))
    return kept.select("txn_id", "kept.*")


def labelled(labels: DataFrame, decided: DataFrame) -> DataFrame:
    """Every label with the decision of its transaction, null where ingestion rejected it."""
    verdicts = one_per_txn(decided, "status", "exception_code", "reason_codes", "confidence", "bank_match_type")
    joined = labels.join(verdicts, "txn_id", "left")
    return joined.withColumn("status_ok", F.col("status") == F.col("expected_status")).withColumn(
        "code_ok", F.col("exception_code") == F.col("expected_exception_code")
    )


def accuracy(rows: DataFrame) -> DataFrame:
    counts = rows.agg(
        F.count("*").alias("labels"),
        F.count("status").alias("evaluated"),
        F.count_if("status_ok").alias("status_correct"),
        F.count_if("code_ok").alias("code_correct"),
    )
    return counts.select(
        "*",
        (F.col("labels") - F.col("evaluated")).alias("rejected"),
        percent(F.col("status_correct"), F.col("evaluated"), 2).alias("status_pct"),
        percent(F.col("code_correct"), F.col("evaluated"), 2).alias("code_pct"),
        percent(F.col("status_correct"), F.col("labels"), 2).alias("status_pct_all"),
    )


def accuracy_by_category(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category").agg(
        F.count("*").alias("total"),
        F.count_if("status_ok").alias("status_ok"),
        F.count_if("code_ok").alias("code_ok"),
        F.count_if(F.col("status").isNull()).alias("not_evaluable"),
        F.count("status").alias("evaluable"),
    )


def divergences(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("status").isNotNull() & ~(F.col("status_ok") & F.col("code_ok"))).select(
        "txn_id",
        "category",
        "expected_status",
        F.col("status").alias("actual_status"),
        "expected_exception_code",
        F.col("exception_code").alias("actual_exception_code"),
        "reason_codes",
    )


def rejected_labels(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("status").isNull()).select("txn_id", "category", "expected_status")


def label_reachability(labels: DataFrame) -> DataFrame:
    """Labels whose status their category does not allow, or whose category is unknown."""
    allowed = F.lit(False)
    for category, statuses in ALLOWED_STATUSES:
        allowed = allowed | ((F.col("category") == category) & F.col("expected_status").isin(*statuses))
    return labels.groupBy("category", "expected_status").agg(F.count("*").alias("n")).withColumn("reachable", allowed)


def label_coverage(labels: DataFrame, decided: DataFrame) -> DataFrame:
    """Transaction ids on one side only."""
    mine, theirs = labels.select("txn_id"), decided.select("txn_id")
    undecided = mine.join(theirs, "txn_id", "left_anti").withColumn("missing_from", F.lit("decisions"))
    unlabelled = theirs.join(mine, "txn_id", "left_anti").withColumn("missing_from", F.lit("labels"))
    return undecided.unionByName(unlabelled)


def tier_by_category(rows: DataFrame) -> DataFrame:
    tier = F.col("bank_match_type")
    return rows.filter(tier.isNotNull()).groupBy("category").agg(
        *[F.count_if(tier == t).alias(t) for t in C.MATCH_TYPES]
    )


def tax_mismatch_precision(rows: DataFrame) -> DataFrame:
    flagged = rows.filter(F.col("status") == "TAX_MISMATCH")
    return flagged.groupBy("category").agg(
        F.count("*").alias("flagged"),
        F.count_if("status_ok").alias("correct"),
        F.count_if(~F.col("status_ok")).alias("false_positive"),
    )


# --- threshold sweep -------------------------------------------------------------------------

SWEEP = tuple(range(60, 100, 5))


def fuzzy_sweep(decided: DataFrame, bank: DataFrame) -> DataFrame:
    """Selection quality per similarity threshold among anchors that reach tier 3.

    The best row is the most similar one, ties by input order. Reaching tier 3 means some row scores
    at the production floor, so the best is found among those pairs whatever the threshold. It also
    means no bank row carries the anchor's id: truth is a row without an id at exactly the net.
    """
    anchors = decided.filter(F.col("bank_match_type") == "fuzzy").select(
        "src_pos", F.coalesce("utr", F.lit("")).alias("ref"), "expected_net", "day"
    )
    key = ["ref", "expected_net", "day"]
    asked = stage(anchors.select(*key).distinct(), "sweep-asked")
    anonymous = F.col("txn_id").isNull().alias("anonymous")
    near = near_rows(asked, bank, ())
    points = stage(
        near.groupBy("amount", F.col("day").alias("bank_day"), F.coalesce("narration", F.lit("")).alias("text")).agg(
            F.min(F.struct("src_pos", anonymous)).alias("first"), F.max(anonymous).alias("any_anonymous")
        ),
        "sweep-points",
    )
    scored = scored_pairs(asked, points, (), C.FUZZY_MIN_SIMILARITY)
    exact = F.col("amount") == F.col("expected_net")
    best = scored.groupBy(*key).agg(
        F.max_by(
            F.struct("similarity", (F.col("first.anonymous") & exact).alias("right")),
            F.struct("similarity", (-F.col("first.src_pos")).alias("earlier")),
        ).alias("best")
    )
    there = (
        gate_join(asked, points.filter("any_anonymous").select("amount", "bank_day").distinct(), [])
        .groupBy(*key)
        .agg(F.max(exact).alias("exists"))
    )
    answers = best.join(there, key, "left")
    per_anchor = lookup(anchors, answers, key, "src_pos")
    hit = [F.col("best.similarity") >= t for t in SWEEP]
    counts = per_anchor.agg(
        *[F.count_if(h & F.col("best.right")).alias(f"tp{t}") for h, t in zip(hit, SWEEP)],
        *[F.count_if(h & ~F.col("best.right")).alias(f"fp{t}") for h, t in zip(hit, SWEEP)],
        *[F.count_if(~h & F.coalesce("exists", F.lit(False))).alias(f"fn{t}") for h, t in zip(hit, SWEEP)],
    )
    lines = F.array(
        *[
            F.struct(
                F.lit(t).alias("threshold"), F.col(f"tp{t}").alias("tp"), F.col(f"fp{t}").alias("fp"), F.col(f"fn{t}").alias("fn")
            )
            for t in SWEEP
        ]
    )
    flat = counts.select(F.explode(lines).alias("x")).select("x.*")

    def rate(other: str) -> Column:
        whole = F.col("tp") + F.col(other)
        return F.when(whole == 0, F.lit(float("nan"))).otherwise(F.round(F.col("tp") / F.nullif(whole, F.lit(0)), 2))

    return flat.withColumn("precision", rate("fp")).withColumn("recall", rate("fn"))


# --- data quality ----------------------------------------------------------------------------


def dq_categories(labels: DataFrame, expected: dict[str, int] | None = None) -> DataFrame:
    """Labels per category; with expectations, both counts and whether they agree (ambiguous counts double)."""
    actual = labels.groupBy("category").agg(F.count("*").alias("actual"))
    if expected is None:
        return actual
    spark = labels.sparkSession
    rows = [(c, n * 2 if c == "ambiguous" else n) for c, n in expected.items()]
    wanted = spark.createDataFrame(rows, "category string, expected bigint")
    return actual.join(wanted, "category", "full_outer").withColumn("ok", F.col("actual").eqNullSafe(F.col("expected")))


def dq_pg_gst(pg: DataFrame) -> DataFrame:
    """Settlements whose GST is not 18 % of the fee."""
    expected = gst_on(F.col("fee"))
    return pg.filter(F.abs(expected - F.col("gst")) > F.lit(C.TAX_TOLERANCE)).select(
        "txn_id", money(F.col("gst")).alias("actual_gst"), expected.alias("expected_gst")
    )


def dq_tds_split(pg: DataFrame) -> DataFrame:
    return pg.agg(
        F.count_if(F.col("tds") == 0).alias("zero_tds"),
        F.count_if(F.col("tds") > 0).alias("nonzero_tds"),
        (F.count_if(F.col("tds") > 0) > 0).alias("ok"),
    )


def raw_presence(labels: DataFrame, pg: DataFrame, bank: DataFrame, invoice: DataFrame, native: DataFrame) -> DataFrame:
    """Per label: rows in each raw feed. ``native`` attributes bank rows without our reference.

    Counts are taken per transaction before any join, so a hot id is one row by then.
    """

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("txn_id").agg(F.count("*").alias(name))

    owned = bank.select(ref_txn_id(F.col("bank_ref")).alias("txn_id")).filter("txn_id is not null")
    linked = owned.unionByName(native.filter("txn_id is not null").select("txn_id"))
    out = labels.join(counted(pg, "pg_rows"), "txn_id", "left")
    out = out.join(counted(linked, "bank_rows"), "txn_id", "left")
    out = out.join(counted(invoice, "invoice_rows"), "txn_id", "left")
    return out.fillna(0, ["pg_rows", "bank_rows", "invoice_rows"])


def dq_referential(presence: DataFrame) -> DataFrame:
    """Labels whose feeds are not populated the way their category says."""
    pg, bank, bill = F.col("pg_rows") > 0, F.col("bank_rows") > 0, F.col("invoice_rows") > 0
    ok = (
        F.when(F.col("category") == "corrupted", True)
        .when(F.col("category") == "missing_in_source", pg & (bank != bill))
        .otherwise(pg & bank & bill)
    )
    return presence.filter(~ok).select("txn_id", "category", "pg_rows", "bank_rows", "invoice_rows")


def dq_duplicate_rows(presence: DataFrame) -> DataFrame:
    return presence.filter((F.col("category") == "duplicate") & (F.col("bank_rows") != 2)).select("txn_id", "bank_rows")


def native_rows(bank: DataFrame) -> DataFrame:
    """Bank rows without our reference convention."""
    return bank.filter(~F.coalesce(F.col("bank_ref").startswith(BANK_REF_PREFIX), F.lit(False)))


def dq_fuzzy_reachable(bank: DataFrame, attributed: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the fuzzy category that an exact tier would resolve after all."""
    mine = labels.filter(F.col("category") == "reference_mismatch_fuzzy").select("txn_id")
    refs = attributed.join(mine, "txn_id").select("bank_ref", F.col("txn_id").alias("label_txn"))
    rows = bank.select("bank_ref", "utr", F.col("txn_id").alias("bank_txn"), "narration").join(refs, "bank_ref")
    problem = (
        F.when(F.col("utr").isNotNull(), "exposes a utr")
        .when(F.col("bank_txn").isNotNull(), "resolves to a transaction id")
        .when(F.coalesce("narration", F.lit("")) == "", "has no narration")
    )
    return rows.withColumn("problem", problem).filter("problem is not null").select("bank_ref", "label_txn", "problem")


def dq_collisions(labels: DataFrame, pg: DataFrame) -> DataFrame:
    """Ambiguous labels per (gross, day): groups of at least two are genuine."""
    rows = labels.filter(F.col("category") == "ambiguous").join(one_per_txn(pg, "amount", "day", last=False), "txn_id")
    return (
        rows.groupBy(money(F.col("amount")).alias("gross"), "day")
        .agg(F.count("*").alias("n"))
        .withColumn("genuine", F.col("n") >= 2)
    )


def dq_narration_shapes(bank: DataFrame) -> DataFrame:
    text = F.col("narration")
    marks = [F.contains(text, F.lit(m)).alias(name) for m, name in (("-", "dash"), ("/", "slash"), ("*", "star"), (" CR ", "cr"))]
    return bank.filter(F.coalesce(text, F.lit("")) != "").groupBy(*marks).agg(F.count("*").alias("n"))


def dq_corrupted_similarity(attributed: DataFrame, labels: DataFrame) -> DataFrame:
    """Similarity left in fuzzy-category narrations, and whether the reference prefix survived."""
    mine = labels.filter(F.col("category") == "reference_mismatch_fuzzy").select("txn_id")
    return attributed.join(mine, "txn_id").select(
        "txn_id",
        "bank_ref",
        F.round("similarity", 2).alias("similarity"),
        (F.col("similarity") >= C.FUZZY_MIN_SIMILARITY).alias("recoverable"),
        (~F.contains("narration", F.lit("UTR"))).alias("prefix_corrupted"),
    )


def net_collisions(pg: DataFrame, labels: DataFrame) -> DataFrame:
    """Nets shared by several settlements outside the ambiguous category."""
    others = labels.filter(F.col("category") != "ambiguous").select("txn_id")
    rows = pg.join(others, "txn_id", "left_semi")
    return rows.groupBy(money(F.col("expected_net")).alias("net")).agg(F.count("*").alias("n")).filter("n > 1")


def dq_tax_detectable(labels: DataFrame, pg: DataFrame, invoice: DataFrame) -> DataFrame:
    mine = labels.filter(F.col("category") == "tax_mismatch").select("txn_id")
    bills = one_per_txn(invoice, "gst", "tds").withColumnsRenamed({"gst": "claimed_gst", "tds": "claimed_tds"})
    rows = mine.join(one_per_txn(pg, "fee", "tds"), "txn_id").join(bills, "txn_id")
    gst_off = F.abs(gst_on(F.col("fee")) - F.col("claimed_gst")) > F.lit(C.TAX_TOLERANCE)
    tds_off = F.abs(F.col("tds") - F.col("claimed_tds")) > F.lit(C.TAX_TOLERANCE)
    return rows.agg(
        F.count("*").alias("records"),
        F.count_if(gst_off).alias("gst_cases"),
        F.count_if(tds_off).alias("tds_cases"),
        F.count_if(~gst_off & ~tds_off).alias("undetectable"),
    )


def mdr_mix(pg: DataFrame) -> DataFrame:
    return pg.groupBy("payment_method").agg(F.count("*").alias("n"), F.count_if(F.col("fee") == 0).alias("zero_fee"))


def ambiguity_diagnosis(decided: DataFrame, bank: DataFrame) -> DataFrame:
    """Gated bank rows per anchor by verdict: its own (SKIPPED) or a rival (EVIDENCE).

    Verdicts are counted from grouped rows; near pairs are never listed.
    """
    return decided.filter(F.col("gated_bank_rows") > 0).select(
        "txn_id",
        F.col("gated_bank_rows"),
        (F.col("gated_bank_rows") - F.col("bank_ambiguity_count")).alias("skipped_rows"),
        F.col("bank_ambiguity_count").alias("evidence_rows"),
        F.when(F.col("bank_ambiguity_count") > 0, "EVIDENCE").otherwise("SKIPPED").alias("verdict"),
    )


def decision_lines(decided: DataFrame) -> DataFrame:
    """One canonical line per decision and its digest."""
    line = F.concat_ws(
        "|",
        "txn_id",
        "status",
        "exception_code",
        F.array_join("reason_codes", ","),
        F.col("confidence_score").cast("string"),
        "matched_rule",
    )
    return decided.select("txn_id", line.alias("line")).withColumn("digest", F.sha2("line", 256))


# A Mersenne prime: sums of digests modulo it stay below 2^61.
DIGEST_PRIME = 2**61 - 1


def _halves(line: Column) -> list[Column]:
    """Two 60-bit numbers from a line's digest."""
    digest = F.sha2(line, 256)
    return [F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)") for k in range(2)]


def batch_digest(lines: DataFrame) -> DataFrame:
    """Order-free digest of a batch, combined map-side: count, xor, and two sums of 60-bit row hashes modulo a prime.

    The xor is blind to lines that come in pairs; the sums count every line as often as it occurs. Digests of parts
    merge by adding them modulo the prime.
    """
    h = F.conv(F.substring(F.md5(F.col("line").cast("binary")), 1, 15), 16, 10).cast("bigint")
    first, second = _halves(F.col("line"))
    prime = F.lit(DIGEST_PRIME).cast("decimal(38,0)")

    def total(half: Column) -> Column:
        return F.coalesce((F.sum(half) % prime).cast("bigint"), F.lit(0))

    return lines.agg(
        F.bit_xor(h).alias("xor_digest"),
        F.count("*").alias("lines"),
        total(first).alias("sum_digest_1"),
        total(second).alias("sum_digest_2"),
    )


def range_digests(lines: DataFrame, width: int) -> DataFrame:
    """The same sums for each range of transaction ids that begin alike, to find where two batches differ: (range,
    lines, sum_digest_1, sum_digest_2). Their sums modulo the prime are those of the batch."""
    first, second = _halves(F.col("line"))
    prime = F.lit(DIGEST_PRIME).cast("decimal(38,0)")
    return lines.groupBy(F.substring("txn_id", 1, width).alias("range")).agg(
        F.count("*").alias("lines"),
        (F.sum(first) % prime).cast("bigint").alias("sum_digest_1"),
        (F.sum(second) % prime).cast("bigint").alias("sum_digest_2"),
    )


def range_snapshot(lines: DataFrame, low: str, high: str) -> DataFrame:
    """One digest that depends on the order: of the lines of ids in [low, high), sorted and joined by line feeds.

    The lines of the range meet in one row; whoever asks names a range of a size that suits.
    """
    inside = lines.filter((F.col("txn_id") >= low) & (F.col("txn_id") < high))
    text = F.array_join(F.array_sort(F.collect_list("line")), "\n")
    return inside.agg(F.count("*").alias("lines"), F.sha2(text, 256).alias("digest"))


def amount_control(decided: DataFrame) -> DataFrame:
    """The settlement amount control on its own: rows and value per outcome."""
    off = ~within_amount(F.col("bank.amount"), F.col("expected_net"))
    return (
        decided.filter(F.col("bank").isNotNull())
        .withColumn("differs", off)
        .groupBy("differs", F.col("context.amount_mismatch").alias("amount_mismatch"))
        .agg(F.count("*").alias("n"), F.sum((F.col("expected_net") - F.col("bank.amount")).cast(AMOUNT)).cast("decimal(28,2)").alias("gap"))
    )
