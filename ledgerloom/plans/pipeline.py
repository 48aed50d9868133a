"""The reconciliation batch: feeds in, one decided row per settlement out."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators.candidates import candidate_sets
from ledgerloom.operators.decide import decide
from ledgerloom.operators.matching import resolve
from ledgerloom.operators.normalize import normalize_bank, normalize_invoice, normalize_pg
from ledgerloom.operators.skew import prepare
from ledgerloom.session import stage
from ledgerloom.sources.derived import derived_feeds
from ledgerloom.sources.ingest import Ingested, all_rejects, from_table, ingest, scan_json_array, scan_json_lines
from ledgerloom.sources.schemas import FEED_FILES


@dataclass(frozen=True)
class Batch:
    """Lazy frames of one batch. ``decided`` is staged once when several reports will read it."""

    raw: dict[str, DataFrame]
    ingested: dict[str, Ingested]
    pg: DataFrame
    bank: DataFrame
    invoice: DataFrame
    labels: DataFrame | None = None
    scope: tuple[str, ...] = ()

    @property
    def rejects(self) -> DataFrame:
        return all_rejects(self.ingested)

    def candidates(self) -> DataFrame:
        """Staged: scoring and policy are one long projection, and joined to the lookups' generated code
        it would outgrow what the JVM compiles."""
        return stage(candidate_sets(self.pg, self.bank, self.invoice, self.scope), "candidates")

    def matches(self) -> DataFrame:
        return resolve(self.candidates())

    def decided(self) -> DataFrame:
        return decide(self.matches(), self.scope)

    def snapshot(self) -> DataFrame:
        """Decided rows written once; every report reads the same rows."""
        return stage(self.decided(), "decided")


def batch_from_raw(
    raw: dict[str, DataFrame],
    labels: DataFrame | None = None,
    scope: tuple[str, ...] = (),
    staged: bool = True,
) -> Batch:
    """Validate and normalise the feeds.

    The normalised feeds are read by every join of the pipeline, so they are written once instead of
    being parsed again per branch. ``staged=False`` keeps them lazy for a job with a single reader.
    """
    prepare(next(iter(raw.values())).sparkSession)
    ingested = {source: ingest(frame, source) for source, frame in raw.items()}
    keep = stage if staged else (lambda df, _: df)
    return Batch(
        raw=raw,
        ingested=ingested,
        pg=keep(normalize_pg(ingested["pg"].valid, scope), "pg"),
        bank=keep(normalize_bank(ingested["bank"].valid, scope), "bank"),
        invoice=keep(normalize_invoice(ingested["invoice"].valid, scope), "invoice"),
        labels=labels,
        scope=scope,
    )


def batch_from_folder(spark: SparkSession, folder: str, labels: DataFrame | None = None, lines: bool = False) -> Batch:
    """The three feeds of a folder: JSON arrays, or with ``lines`` the splittable JSON Lines files (``.jsonl``)."""
    scan = scan_json_lines if lines else scan_json_array
    raw = {s: scan(spark, os.path.join(folder, n + "l" * lines)) for s, n in FEED_FILES.items()}
    return batch_from_raw(raw, labels)


def landed_feeds(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The derived feeds written as tables of strings, as an export would arrive."""
    return {name: stage(frame, f"feed-{name}") for name, frame in derived_feeds(spark, sf_dir).items()}


def batch_from_feeds(feeds: dict[str, DataFrame], staged: bool = True) -> Batch:
    raw = {s: from_table(feeds[s], s) for s in FEED_FILES}
    return batch_from_raw(raw, feeds.get("labels"), staged=staged)


__all__ = ["Batch", "batch_from_feeds", "batch_from_folder", "batch_from_raw", "landed_feeds"]
