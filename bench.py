"""Headline timings at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The derived feeds are landed first and not timed (the baseline does not time generation either).
``pipeline`` is everything from raw feeds to decided rows on disk: validate, normalise, match, score,
tax, decide. Reports are then timed over that snapshot. A run over the smallest tables warms the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerloom.plans.registry import QUERIES, Job  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPORTS = (
    "cash_position",
    "match_rate",
    "status_table",
    "exceptions",
    "triage_rank",
    "case_dossier",
    "bank_ambiguity",
    "bank_completeness",
    "completeness_totals",
    "accuracy",
    "tier_by_category",
    "fuzzy_sweep",
    "decision_lines",
    "explanation_violations",
    "numeric_literals",
    "keyword_route",
)


def consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    started = time.perf_counter()
    action()
    return round(time.perf_counter() - started, 3)


def run(spark: SparkSession, sf_dir: str) -> tuple[dict[str, float], int]:
    job = Job(spark, sf_dir)
    _ = job.feeds
    seconds = {
        "normalise": timed(lambda: job.batch),
        "decide": timed(lambda: job.decided),
    }
    seconds["pipeline"] = round(seconds["normalise"] + seconds["decide"], 3)
    for name in REPORTS:
        seconds[name] = timed(lambda name=name: consume(QUERIES[name](job)))
    return seconds, job.decided.count()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    warm = os.path.join(os.path.dirname(os.path.abspath(SF_DIR)), "sf0.001")
    if os.path.isdir(warm):
        run(spark, warm)
    seconds, rows = run(spark, SF_DIR)
    print(
        json.dumps(
            {
                "metric": "reconciliation pipeline, raw feeds to decided rows",
                "value": seconds["pipeline"],
                "unit": "sec",
                "queries": seconds,
                "records": rows,
                "records_per_second": round(rows / seconds["pipeline"], 1),
                "sf": os.path.basename(os.path.abspath(SF_DIR)),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
