"""Every operator as a named query over the driver tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import config as C
from ledgerloom.functions import money as M
from ledgerloom.functions.narration import narration_txn_id
from ledgerloom.functions.text import normalise_text, numeric_literals
from ledgerloom.operators import candidates as K
from ledgerloom.operators import decide as D
from ledgerloom.operators import matching as MT
from ledgerloom.operators import normalize as N
from ledgerloom.operators import scoring as S
from ledgerloom.operators.attribution import attribute_bank_rows
from ledgerloom.operators.near import near_verdicts
from ledgerloom.operators.rejected import rejected_rows
from ledgerloom.operators.skew import lookup
from ledgerloom.plans import faithfulness as FF
from ledgerloom.plans import gold as G
from ledgerloom.plans import pipeline as P
from ledgerloom.plans import quality as Q
from ledgerloom.plans import replay as RP
from ledgerloom.plans import reports as R
from ledgerloom.plans import text_eval as X
from ledgerloom.session import checkpoint_dir, remove, stage
from ledgerloom.sources import bundle as B
from ledgerloom.sources.ingest import checked, from_table, ingest, ingest_summary, scan_json_array
from ledgerloom.sources.schemas import FEEDS
from ledgerloom.sources.sinks import as_json, write_json_arrays


class Job:
    """Frames of one batch of driver tables; each is built on first use and shared by the queries."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))

    @cached_property
    def feeds(self) -> dict[str, DataFrame]:
        return P.landed_feeds(self.spark, self.sf_dir)

    @cached_property
    def batch(self) -> P.Batch:
        return P.batch_from_feeds(self.feeds)

    @cached_property
    def exact(self) -> DataFrame:
        b = self.batch
        return stage(K.exact_groups(b.pg, b.bank, b.invoice), "exact")

    @cached_property
    def judged(self) -> DataFrame:
        """Decisions as a projection of the written candidates."""
        return self.batch.decided()

    @cached_property
    def decided(self) -> DataFrame:
        """Decisions written down, for queries that read them more than once or filter by what was decided: such a filter
        would be planned, and evaluated, apart from the columns that are shown."""
        return stage(self.judged, "decided")

    @property
    def verdicts(self) -> DataFrame:
        """Decisions for one reading: the columns it asks for, not written again for it; read from where they were written
        already."""
        return self.decided if "decided" in self.__dict__ else self.judged

    @property
    def labelled(self) -> DataFrame:
        return Q.labelled(self.feeds["labels"], self.verdicts)

    @property
    def accounts(self) -> DataFrame:
        return R.bank_completeness(self.batch.bank, self.decided)

    @cached_property
    def attributed(self) -> DataFrame:
        b = self.batch
        return stage(attribute_bank_rows(Q.native_rows(b.bank), b.pg), "attributed")

    @property
    def presence(self) -> DataFrame:
        return Q.raw_presence(
            self.feeds["labels"], self.feeds["pg"], self.feeds["bank"], self.feeds["invoice"], self._native_owner
        )

    @staticmethod
    def _utr_owner(pg: DataFrame) -> DataFrame:
        """First settlement of each UTR."""
        return pg.filter("utr is not null").groupBy("utr").agg(F.min_by("txn_id", "src_pos").alias("owner"))

    @property
    def _native_owner(self) -> DataFrame:
        """Owners of native-reference rows by narration."""
        return self.attributed.select("bank_ref", "txn_id")

    @cached_property
    def cases(self) -> DataFrame:
        return RP.cases(self.feeds["labels"])

    @cached_property
    def owned_bank(self) -> DataFrame:
        owner = self._native_owner.groupBy("bank_ref").agg(F.min("txn_id").alias("attributed"))
        ref = RP.ref_txn_id(F.col("bank_ref"))
        # a list that grows with the batch; its files are small enough to be planned as a broadcast
        rows = lookup(self.feeds["bank"], owner.hint("merge"), ["bank_ref"], "src_pos")
        return rows.withColumn("txn_id", F.coalesce(ref, "attributed")).drop("attributed")

    @cached_property
    def replayed(self) -> DataFrame:
        return stage(RP.replay_cases(self.feeds, self.cases, self.owned_bank), "replayed")

    @cached_property
    def batch_gold(self) -> DataFrame:
        """What the whole batch decided of each case, frozen, against its replay in isolation."""
        frozen = RP.frozen_decisions(self.cases, self.decided)
        return stage(G.compare_records(frozen, RP.replayed_records(self.replayed)), "gold")

    @property
    def explanations(self) -> DataFrame:
        return X.explained(self.decided)

    @property
    def answers(self) -> DataFrame:
        """Explanations quoting both amounts; every seventh misstates one, every fifth leaves them out."""
        rows = self.explanations.withColumnsRenamed({"txn_id": "case_id"})
        wrong = F.pmod(F.col("src_pos"), F.lit(7)) == 0
        shown = F.when(wrong, M.money_text(F.col("expected_amount").cast(M.MONEY) + 1)).otherwise(F.col("expected_amount"))
        quoted = F.concat(F.lit(" Claimed INR "), "claimed_amount", F.lit(", expected INR "), shown, F.lit("."))
        silent = F.pmod(F.col("src_pos"), F.lit(5)) == 0
        text = F.concat("explanation", F.when(silent, "").otherwise(F.coalesce(quoted, F.lit(""))))
        return rows.withColumn("explanation", text).withColumn("category", F.col("status"))

    @cached_property
    def scores(self) -> DataFrame:
        return stage(FF.explanation_scores(self.answers), "scores")

    @property
    def questions(self) -> DataFrame:
        return self.table("conversations").filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))

    @property
    def selections(self) -> DataFrame:
        """User turns routed by their own text against the route of the reply that follows."""
        talk = self.table("conversations")
        asked = talk.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
        reply = talk.filter(F.col("role") == "assistant").select(
            "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply")
        )
        rows = asked.join(reply, ["conv_id", "turn"], "left")
        want, got = X.keyword_route(F.col("question")), X.keyword_route(F.col("reply"))
        return X.selection_rows(
            rows.select(
                F.pmod(F.col("turn"), F.lit(4)).alias("category"),
                want.alias("expected"),
                F.when(F.col("reply").isNotNull(), got).alias("selected"),
                X.keyword_argument(F.col("question"), want).alias("expected_argument"),
                X.keyword_argument(F.col("reply"), got).alias("selected_argument"),
                F.when(F.col("reply").isNull(), "provider_failure: no reply").alias("error"),
            )
        )

    @property
    def narrations(self) -> DataFrame:
        """Every bank narration with the id it ought to yield: its settlement's, where the text carries it; else none,
        as for rows without a UTR, whose right answer is to abstain."""
        b = self.batch
        rows = lookup(b.bank, self._utr_owner(b.pg), ["utr"], "src_pos")
        carries = F.contains(F.upper("narration"), F.col("owner"))
        return rows.select("src_pos", "narration", F.when(carries, F.col("owner")).alias("expected"))

    @property
    def extraction_outcomes(self) -> DataFrame:
        """Extraction calls over those narrations, with the failures of a busy service."""
        k = F.col("src_pos")
        error = (
            F.when(F.pmod(k, F.lit(40)) == 0, "call exceeded 10s")
            .when(F.pmod(k, F.lit(44)) == 0, "429 RESOURCE_EXHAUSTED")
            .when(F.pmod(k, F.lit(52)) == 0, "response failed schema validation")
            .when(F.pmod(k, F.lit(68)) == 0, "connection reset")
        )
        return self.narrations.select(
            k.alias("id"),
            "expected",
            error.alias("error"),
            F.when(error.isNull(), narration_txn_id(F.col("narration"))).alias("predicted"),
            (F.pmod(k * 37, F.lit(1000)) / 100).alias("latency"),
        )


def plain(df: DataFrame) -> DataFrame:
    """Comparable columns: integers as BIGINT, money, dates and lists as text."""

    def one(field: T.StructField):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DecimalType, T.DateType, T.TimestampType)):
            c = c.cast("string")
        elif isinstance(field.dataType, T.ArrayType):
            c = F.array_join(c, ",")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        return c.alias(field.name)

    return df.select(*[one(f) for f in df.schema.fields])


def _two(column: str):
    return M.money(F.col(column))


_PG_RAW = ("src_pos", "settlement_id", "txn_id", "merchant_id", "payment_method", "utr", "merchant_gstin")
_PG_MONEY = ("gross_amount", "pg_fee", "gst_on_fee", "tds_withheld", "net_payout", "merchant_ytd_gross_opening")


def _ingest_valid(j: Job) -> DataFrame:
    i = j.batch.ingested
    return (
        i["pg"].valid.select(F.lit("pg").alias("source"), "src_pos", F.col("txn_id").alias("ref"), _two("gross_amount").alias("amount"))
        .unionByName(i["bank"].valid.select(F.lit("bank").alias("source"), "src_pos", F.col("bank_ref").alias("ref"), _two("credited_amount").alias("amount")))
        .unionByName(i["invoice"].valid.select(F.lit("invoice").alias("source"), "src_pos", F.col("invoice_id").alias("ref"), _two("invoice_amount").alias("amount")))
    )


def _money_firewall(j: Job) -> DataFrame:
    raw = j.batch.raw["pg"]
    return (
        checked(raw, "pg")
        .groupBy("valid", F.coalesce("error_code", F.lit("NONE")).alias("error_code"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(_two("gross_amount")).cast("decimal(28,2)").alias("gross"))
    )


def _tiers(j: Job, column: str) -> DataFrame:
    return j.exact.filter(F.col(column).isNotNull()).select(
        "txn_id",
        F.col(f"{column}.n").alias("candidates"),
        F.col(f"{column}.duplicate").alias("duplicate"),
    )


def _match_fuzzy(j: Job) -> DataFrame:
    b = j.batch
    open_rows = j.exact.filter("exact_tier is null")
    hits = K.match_fuzzy(open_rows, b.bank)
    return hits.join(open_rows.select("src_pos", "txn_id"), "src_pos").select(
        "txn_id", F.col("f.n").alias("candidates"), F.col("f.row.bank_ref").alias("bank_ref")
    )


def _narration_similarity(j: Job) -> DataFrame:
    b = j.batch
    asked = K.open_keys_of(j.exact.filter("exact_tier is null"))
    points = K.fuzzy_points(asked, b.bank, ())
    pairs = K.scored_pairs(asked, points, (), C.FUZZY_MIN_SIMILARITY)
    return pairs.select("ref", "text", F.round("similarity", 2).alias("similarity")).distinct()


def _proposals(j: Job) -> DataFrame:
    """Every label's id, and as many that exist nowhere."""
    ids = j.feeds["labels"].select("txn_id")
    made = ids.select(F.concat("txn_id", F.lit("X")).alias("txn_id"))
    rows = ids.unionByName(made).select(F.col("txn_id").alias("proposed_txn_id"), F.xxhash64("txn_id").alias("proposal_id"))
    return K.proposal_lookup(rows, j.batch.bank).select("proposed_txn_id", "found", "bank_rows")


def _rejected_candidates(j: Job) -> DataFrame:
    """Candidates beyond the winner, per anchor: how many on each side."""
    return j.verdicts.filter("bank_candidate_count > 1 or invoice_candidate_count > 1").select(
        "txn_id",
        F.greatest(F.col("bank_candidate_count") - 1, F.lit(0)).alias("rejected_bank"),
        F.greatest(F.col("invoice_candidate_count") - 1, F.lit(0)).alias("rejected_invoice"),
        F.col("bank.bank_ref").alias("kept_bank_ref"),
    )


def _score(j: Job) -> DataFrame:
    s = "score"
    flags = ("txn_id_matched_bank", "txn_id_matched_invoice", "amount_matched_bank", "amount_matched_invoice",
             "date_matched_bank", "date_matched_invoice", "utr_matched", "fee_consistent")
    return j.verdicts.select(
        "txn_id",
        F.col(f"{s}.total_score").alias("total_score"),
        F.col(f"{s}.max_achievable").alias("max_achievable"),
        F.col(f"{s}.normalized_score").alias("normalized_score"),
        *[F.col(f"{s}.{f}").alias(f) for f in flags],
    )


def _signals(j: Job) -> DataFrame:
    g = "signals"
    return S.signals(j.verdicts).select(
        "txn_id",
        F.col(f"{g}.missing_bank").alias("missing_bank"),
        F.col(f"{g}.missing_invoice").alias("missing_invoice"),
        F.col(f"{g}.amount_bank.delta").cast("decimal(18,2)").alias("bank_delta"),
        F.col(f"{g}.amount_invoice.delta").cast("decimal(18,2)").alias("invoice_delta"),
        F.col(f"{g}.date_bank.delta_days").alias("bank_days"),
        F.col(f"{g}.date_invoice.delta_days").alias("invoice_days"),
        F.col(f"{g}.date_points_awarded").alias("date_points"),
        F.col(f"{g}.utr.points_awarded").alias("utr_points"),
        F.col(f"{g}.fee_consistency.points_awarded").alias("fee_points"),
    )


def _tax(j: Job, which: str, *extra: str) -> DataFrame:
    t = f"tax.{which}"
    return j.verdicts.select(
        "txn_id",
        *[F.col(f"{t}.{e}").alias(e) for e in extra],
        _two(f"{t}.expected").alias("expected"),
        _two(f"{t}.claimed").alias("claimed"),
        _two(f"{t}.delta").alias("delta"),
        F.col(f"{t}.verified").alias("verified"),
    )


def _decisions(j: Job) -> DataFrame:
    return j.verdicts.select(
        "txn_id", "status", "exception_code", "reason_codes", "confidence_score",
        F.col("sources_present").alias("matched_sources"), "tax_verified", "matched_rule",
    )


def _evidence(j: Job) -> DataFrame:
    return j.verdicts.select(
        "txn_id", "status", "exception_code", "confidence_score", F.col("confidence").alias("confidence_tier"),
        "tax_evaluated", "tax_verified", "matched_rule", "selection_reason", "authoritative_match",
    )


def _evidence_one(j: Job) -> DataFrame:
    """Dossier of the newest open case, looked up by its id."""
    newest = j.decided.filter("status <> 'MATCHED'").agg(F.max("txn_id")).first()[0]
    return R.evidence_of(_evidence(j), newest)


def _ungrounded(j: Job) -> DataFrame:
    """Answers quoting both amounts, checked against payloads that carry only the expected one."""
    d = X.explained(j.verdicts, M.money_text(F.col("expected_net")).alias("net"))
    expected, credited = F.col("net"), F.col("claimed_amount")
    answer = F.concat(F.col("explanation"), F.lit(" Expected INR "), expected, F.coalesce(F.concat(F.lit(", credited INR "), credited), F.lit("")), F.lit("."))
    payload = F.to_json(F.struct("txn_id", "status", "confidence_score", expected.alias("expected_net")))
    return X.ungrounded_numbers(d.select("txn_id", answer.alias("answer"), payload.alias("payload"))).select(
        "txn_id", "ungrounded", "grounded"
    )


def _case_rows(j: Job) -> DataFrame:
    rows = RP.case_rows(j.cases, j.feeds["pg"], j.owned_bank, j.feeds["invoice"])
    return RP.case_table(j.cases, rows).select("case_id", "txn_id", "category", "expected_status", "expected_exception_code", "pg_rows", "bank_rows", "invoice_rows")


def _case_alignment(j: Job) -> DataFrame:
    """Every case, the cases whose explanation has an amount to quote, and the scores of cases that need a review."""
    quoting = j.answers.filter("claimed_amount is not null")
    reviewed = j.answers.filter("status <> 'MATCHED'")
    return FF.case_alignment(j.answers, quoting, j.scores.join(reviewed, "case_id", "left_semi"))


def _scan_array(j: Job) -> DataFrame:
    """The bank feed written as JSON arrays and read back through the array scan."""
    path = os.path.join(checkpoint_dir(j.spark), f"array-{uuid.uuid4().hex}")
    write_json_arrays(j.feeds["bank"], path, "src_pos")
    found = ingest(scan_json_array(j.spark, path), "bank")
    valid = found.valid.select("bank_ref", "utr", "value_date", "narration", _two("credited_amount").cast("string").alias("credited_amount"))
    gone = found.rejects.select(
        F.variant_get(F.parse_json("raw"), "$.bank_ref", "string").alias("bank_ref"),
        F.col("error_code").alias("utr"),
        F.lit(None).cast("date").alias("value_date"),
        F.col("message").alias("narration"),
        F.lit("").alias("credited_amount"),
    )
    return valid.withColumn("kind", F.lit("valid")).unionByName(gone.withColumn("kind", F.lit("rejected")))


def _round_trip(j: Job) -> DataFrame:
    """Every feed and the labels written as a checked folder in each form, read back and ingested: records of either kind,
    and whether their values are those of the tables."""

    def digests(raw: dict[str, DataFrame], labels: DataFrame, form: str) -> DataFrame:
        """One pass over each feed: records of either kind and a sum of their hashes."""
        parts = []
        for source, rows in raw.items():
            fields = [f.name for f in FEEDS[source]]
            value = F.when(F.col("valid"), F.xxhash64(*fields)).otherwise(F.xxhash64("errors", "error_code"))
            parts.append(checked(rows, source).select(F.lit(source).alias("feed"), "valid", value.alias("h")))
        names = ("txn_id", "expected_status", "expected_exception_code", "category")
        parts.append(labels.select(F.lit("labels").alias("feed"), F.lit(True).alias("valid"), F.xxhash64(*names).alias("h")))
        counted = [
            p.groupBy("feed").agg(
                F.lit(form).alias("form"),
                F.count_if("valid").alias("valid"),
                F.count_if(~F.col("valid")).alias("rejected"),
                F.sum(F.col("h").cast("decimal(38,0)")).alias("digest"),
            )
            for p in parts
        ]
        return stage(reduce(DataFrame.unionByName, counted), f"digest-{form}")

    root = os.path.join(checkpoint_dir(j.spark), f"bundles-{uuid.uuid4().hex}")
    back = []
    for form in B.FORMS:
        folder = os.path.join(root, form)
        B.write_bundle(j.feeds, folder, form)
        raw = B.read_bundle(j.spark, folder, (*FEEDS, "labels"))
        labels = raw.pop("labels")
        back.append(digests(raw, labels, form))
    remove(j.spark, root)  # the digests are written down
    first = digests({s: from_table(j.feeds[s], s) for s in FEEDS}, j.feeds["labels"], "table")
    found = reduce(DataFrame.unionByName, back).join(first.select("feed", F.col("digest").alias("first")), "feed", "left")
    return found.select("form", "feed", "valid", "rejected", F.col("digest").eqNullSafe(F.col("first")).alias("same_values"))


def _distinct_rows(j: Job) -> DataFrame:
    """Bank rows and their copies without the position: exact copies collapse."""
    rows = j.feeds["bank"].drop("src_pos", "bank_ref")
    return N.drop_exact_copies(rows).groupBy("value_date").agg(F.count(F.lit(1)).alias("n"))


def _gate(j: Job) -> DataFrame:
    totals = K.gate_totals(j.batch.pg, j.batch.bank)
    return totals.select(_two("expected_net").alias("net"), "day", "in_gate")


def _explanation_violations(j: Job) -> DataFrame:
    return X.explanation_violations(X.explained(j.verdicts)).select("txn_id", "violations", "passed")


def _by(j: Job, column: str) -> DataFrame:
    return j.verdicts.select("txn_id", column)


QUERIES: dict[str, Callable[[Job], DataFrame]] = {
    # sources
    "ingest_valid": _ingest_valid,
    "ingest_rejects": lambda j: j.batch.rejects.select("source", "src_pos", "message", "error_code"),
    "ingest_summary": lambda j: ingest_summary(j.batch.raw),
    "scan_pg": lambda j: j.batch.ingested["pg"].valid.select(*_PG_RAW, F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), *[_two(c).alias(c) for c in _PG_MONEY]),
    "scan_bank": lambda j: j.batch.ingested["bank"].valid.select("src_pos", "bank_ref", "utr", "value_date", "narration", _two("credited_amount").alias("credited_amount"), _two("bank_charges").alias("bank_charges")),
    "scan_array": _scan_array,
    "feeds_round_trip": _round_trip,
    "scan_invoice": lambda j: j.batch.ingested["invoice"].valid.select("src_pos", "invoice_id", "txn_id", "irn", "gstin", "period", *[_two(c).alias(c) for c in ("invoice_amount", "claimed_gst", "claimed_tds")]),
    "scan_labels": lambda j: j.feeds["labels"],
    "batch_summary": lambda j: R.batch_summary(j.decided),
    "decisions_json": lambda j: as_json(_decisions(j)),
    # expressions
    "money_firewall": _money_firewall,
    "expected_net": lambda j: j.batch.pg.select("txn_id", _two("expected_net").alias("expected_net"), _two("expected_invoice").alias("expected_invoice")),
    "mdr_fee": lambda j: j.batch.pg.select("txn_id", M.mdr_fee(F.col("amount"), F.col("payment_method")).alias("fee_due"), _two("fee").alias("fee")),
    "narration_txn_id": lambda j: j.batch.bank.select("src_pos", narration_txn_id(F.col("narration")).alias("narration_txn_id"), F.col("txn_id").alias("resolved_txn_id")),
    "narration_similarity": _narration_similarity,
    "text_normalise": lambda j: j.table("documents").select("doc_id", normalise_text(F.col("text")).alias("normalised")),
    "numeric_literals": lambda j: j.table("documents").select("doc_id", F.array_sort(numeric_literals(F.col("text"))).alias("numbers")),
    "confidence_tier": lambda j: j.verdicts.select("txn_id", F.col("confidence"), S.auto_matchable(F.col("confidence")).alias("auto_matchable")),
    # normalisation
    "normalize_pg": lambda j: j.batch.pg.select("src_pos", "txn_id", "utr", _two("amount").alias("amount"), _two("fee").alias("fee"), _two("gst").alias("gst"), _two("tds").alias("tds"), "day"),
    "normalize_bank": lambda j: j.batch.bank.select("src_pos", "txn_id", "utr", _two("amount").alias("amount"), "day"),
    "normalize_invoice": lambda j: j.batch.invoice.select("src_pos", "txn_id", _two("amount").alias("amount"), _two("fee").alias("fee"), _two("gst").alias("gst"), _two("tds").alias("tds"), "day"),
    "normalized": lambda j: N.normalized(j.batch.pg, j.batch.bank, j.batch.invoice).select("source", "src_pos", "txn_id", _two("amount").alias("amount"), "day"),
    "linkage_report": lambda j: N.linkage_report(j.batch.pg, j.batch.bank, j.batch.invoice),
    "source_partitions": lambda j: N.normalized(j.batch.pg, j.batch.bank, j.batch.invoice).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(_two("amount")).cast("decimal(28,2)").alias("amount")),
    "label_coverage": lambda j: Q.label_coverage(j.feeds["labels"], j.decided),
    "distinct_rows": _distinct_rows,
    # candidates
    "match_exact_utr": lambda j: _tiers(j, "u"),
    "match_exact_txn": lambda j: j.exact.filter("exact_tier = 'exact_txn'").select("txn_id", F.col("t.n").alias("candidates"), F.col("t.duplicate").alias("duplicate")),
    "match_fuzzy": _match_fuzzy,
    "match_invoice": lambda j: _tiers(j, "i"),
    "bank_match_type": lambda j: _by(j, "bank_match_type"),
    "gate_totals": _gate,
    "bank_ambiguity": lambda j: j.verdicts.filter("bank_ambiguity_count > 0").select("txn_id", "bank_ambiguity_count"),
    "candidate_counts": lambda j: j.verdicts.select("txn_id", "bank_candidate_count", "invoice_candidate_count", "bank_ambiguity_count", "invoice_ambiguity_count"),
    "proposal_lookup": _proposals,
    "attribute_bank_rows": lambda j: j.attributed.select("bank_ref", "txn_id", F.round("similarity", 2).alias("similarity")),
    # selection
    "best_bank": lambda j: j.verdicts.select("txn_id", F.col("bank.bank_ref").alias("bank_ref"), _two("bank.amount").alias("amount")),
    "best_invoice": lambda j: j.verdicts.select("txn_id", F.col("invoice.invoice_id").alias("invoice_id")),
    "rejected_candidates": _rejected_candidates,
    "rejected_rows": lambda j: rejected_rows(j.decided, j.batch.bank).select("tier", "key", "ask_day", _two("ask_net").alias("ask_net"), "anchors", "rank", "bank_ref"),
    "duplicate_flag": lambda j: _by(j, "duplicate_detected"),
    "ambiguity_flag": lambda j: _by(j, "is_ambiguous"),
    "authoritative": lambda j: j.verdicts.select("txn_id", "authoritative_match", F.col("sources_present").alias("sources")),
    "selection_reason": lambda j: _by(j, "selection_reason"),
    "structural_evidence": lambda j: MT.structural_evidence(j.verdicts).select("txn_id", "structure.*"),
    "match_invariants": lambda j: MT.match_invariants(j.decided),
    "matching_summary": lambda j: MT.matching_summary(j.verdicts),
    "match_score": _score,
    "score_signals": _signals,
    "score_range": lambda j: S.score_out_of_range(j.decided).select("txn_id"),
    # tax and policy
    "gst_check": lambda j: _tax(j, "gst"),
    "tds_check": lambda j: _tax(j, "tds", "applicable"),
    "tax_verification": lambda j: j.verdicts.select("txn_id", F.col("tax.fully_verified").alias("fully_verified")),
    "seller_gross": lambda j: j.verdicts.select("txn_id", _two("seller_gross").alias("seller_gross")),
    "amount_control": lambda j: Q.amount_control(j.verdicts),
    "decision_context": lambda j: j.verdicts.select("txn_id", "context.*"),
    "decisions": _decisions,
    "reason_codes": lambda j: _by(j, "reason_codes"),
    "tax_state": lambda j: j.verdicts.select("txn_id", "tax_evaluated", "tax_verified"),
    "catch_all": lambda j: D.catch_all_alarms(j.decided).select("txn_id", "matched_rule"),
    "policy_priority": lambda j: j.verdicts.select("txn_id", D.priority_of(F.col("matched_rule"), F.col("exception_code")).alias("by_rule"), D.priority_of(F.lit("?"), F.col("exception_code")).alias("by_code")),
    # reports
    "match_rate": lambda j: R.match_rate(j.verdicts),
    "by_status": lambda j: R.by_status(j.verdicts),
    "by_tier": lambda j: R.by_tier(j.verdicts),
    "tier_mix": lambda j: R.tier_mix(j.verdicts),
    "status_table": lambda j: R.status_table(j.verdicts),
    "exceptions": lambda j: R.exceptions(j.decided),
    "exceptions_ambiguous": lambda j: R.exceptions(j.decided, "AMBIGUOUS").select("txn_id", "exception_code", "confidence_score"),
    "triage_rank": lambda j: R.triage_rank(R.exceptions(j.decided).select("txn_id", "policy_priority", "confidence_score")),
    "case_dossier": lambda j: R.case_dossier(j.verdicts),
    "evidence": _evidence,
    "evidence_one": _evidence_one,
    "cash_position": lambda j: R.cash_position(j.verdicts, j.batch.rejects),
    "blocked_share": lambda j: R.blocked_share(j.verdicts),
    "bank_completeness": lambda j: j.accounts,
    "completeness_totals": lambda j: R.completeness_totals(j.accounts),
    "orphans": lambda j: R.orphans(j.accounts),
    "multi_violation": lambda j: R.multi_violation(j.decided),
    # evaluation and quality
    "decision_labels": lambda j: j.labelled.select("txn_id", "category", "expected_status", "status", "status_ok", "code_ok"),
    "accuracy": lambda j: Q.accuracy(j.labelled),
    "accuracy_by_category": lambda j: Q.accuracy_by_category(j.labelled),
    "divergences": lambda j: Q.divergences(j.labelled),
    "rejected_labels": lambda j: Q.rejected_labels(j.labelled),
    "label_reachability": lambda j: Q.label_reachability(j.feeds["labels"]),
    "tier_by_category": lambda j: Q.tier_by_category(j.labelled),
    "fuzzy_sweep": lambda j: Q.fuzzy_sweep(j.verdicts, j.batch.bank),
    "dq_categories": lambda j: Q.dq_categories(j.feeds["labels"]),
    "dq_pg_gst": lambda j: Q.dq_pg_gst(j.batch.pg),
    "dq_tds_split": lambda j: Q.dq_tds_split(j.batch.pg),
    "dq_presence": lambda j: j.presence.select("txn_id", "category", "pg_rows", "bank_rows", "invoice_rows"),
    "dq_referential": lambda j: Q.dq_referential(j.presence),
    "dq_duplicate_rows": lambda j: Q.dq_duplicate_rows(j.presence),
    "dq_fuzzy_reachable": lambda j: Q.dq_fuzzy_reachable(j.batch.bank, j.attributed, j.feeds["labels"]),
    "dq_collisions": lambda j: Q.dq_collisions(j.feeds["labels"], j.batch.pg),
    "dq_narration_shapes": lambda j: Q.dq_narration_shapes(j.batch.bank),
    "dq_corrupted_similarity": lambda j: Q.dq_corrupted_similarity(j.attributed, j.feeds["labels"]),
    "dq_tax_detectable": lambda j: Q.dq_tax_detectable(j.feeds["labels"], j.batch.pg, j.batch.invoice),
    "net_collisions": lambda j: Q.net_collisions(j.batch.pg, j.feeds["labels"]),
    "mdr_mix": lambda j: Q.mdr_mix(j.batch.pg),
    "tax_mismatch_precision": lambda j: Q.tax_mismatch_precision(j.labelled),
    "near_verdicts": lambda j: near_verdicts(j.batch.pg, j.batch.bank).drop("src_pos"),
    "fuzzy_checked": lambda j: j.verdicts.filter("bank_match_type in ('fuzzy', 'none')").select("txn_id", "bank_match_type", F.col("gated_bank_rows").alias("fuzzy_candidates_checked")),
    "ambiguity_diagnosis": lambda j: Q.ambiguity_diagnosis(j.decided, j.batch.bank),
    "decision_lines": lambda j: Q.decision_lines(j.verdicts),
    "batch_digest": lambda j: Q.batch_digest(Q.decision_lines(j.decided)),
    "range_digests": lambda j: Q.range_digests(Q.decision_lines(j.decided), 8),
    "case_table": _case_rows,
    "replay_cases": lambda j: j.replayed.select("case_id", "txn_id", "status", "exception_code", "confidence_score", "outcome"),
    "gold_comparison": lambda j: RP.gold_comparison(j.replayed),
    "gold_baseline": lambda j: G.baseline(RP.gold_comparison(j.replayed)),
    "gold_fields": lambda j: j.batch_gold.select("case_id", F.explode("differences").alias("d"), "comparison").select("case_id", "comparison", F.col("d.field").alias("field"), F.col("d.expected").alias("expected"), F.col("d.actual").alias("actual")),
    "gold_field_report": lambda j: G.field_report(j.batch_gold),
    # text
    "narration_metrics": lambda j: X.narration_metrics(j.narrations),
    "extraction_metrics": lambda j: X.extraction_metrics(j.extraction_outcomes),
    "keyword_route": lambda j: j.questions.select("conv_id", "turn", X.keyword_route(F.col("question")).alias("tool"), X.keyword_argument(F.col("question"), X.keyword_route(F.col("question"))).alias("argument")),
    "selection_metrics": lambda j: X.selection_metrics(j.selections),
    "selection_confusion": lambda j: X.selection_confusion(j.selections),
    "explanation_facts": lambda j: X.explanation_facts(j.verdicts).select("txn_id", "status", "reason_codes", "confidence_score", "claimed_amount", "expected_amount"),
    "explanation_text": lambda j: X.explanation_text(j.verdicts),
    "explanation_violations": _explanation_violations,
    "ungrounded_numbers": _ungrounded,
    "explanation_scores": lambda j: j.scores.drop("category"),
    "explanation_summary": lambda j: FF.explanation_summary(j.scores),
    "case_alignment": _case_alignment,
    "faithfulness_report": lambda j: FF.faithfulness_report(j.answers, j.answers.select("case_id", F.col("claimed_amount").isNotNull().alias("succeeded")), j.scores),
    "faithfulness_gaps": lambda j: FF.faithfulness_gaps(j.scores),
}

_jobs: dict[tuple[str, str], tuple[tuple, Job]] = {}


def _files(spark: SparkSession, folder: str) -> tuple:
    """Name, size and time of every file under ``folder``: a table that changed is another table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listing, found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True), []
    while listing.hasNext():
        f = listing.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def job(spark: SparkSession, sf_dir: str) -> Job:
    """The job of a folder of tables, kept while none of its files changes."""
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir) if "://" not in sf_dir else sf_dir)
    files = _files(spark, sf_dir)
    if key not in _jobs or _jobs[key][0] != files:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        _jobs[key] = (files, Job(spark, sf_dir))
    return _jobs[key][1]
