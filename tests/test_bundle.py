"""Feeds written as a folder with a manifest and read back; order statistics without a sort."""

import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.selection import order_statistics
from ledgerloom.sources import bundle as B
from ledgerloom.sources.ingest import ingest

BANK = "src_pos long, bank_ref string, utr string, credited_amount string, value_date string, narration string, bank_charges string"
ODD = ['say "hi"', "a,b", "", None, "back\\slash", "']}", "[{\"x\": 1}, 2]", " kept ", "Ünï😀"]


def feeds(spark):
    rows = [(i, f"B{i}", None if i % 3 else f"U{i}", "1.50" if i % 7 else "bad", "2026-08-01", ODD[i % len(ODD)], None) for i in range(90)]
    labels = [(f"T{i:03}", "MATCHED", "NONE", "exact_match") for i in range(40)]
    none = spark.createDataFrame([], "src_pos long, invoice_id string, txn_id string")
    return {
        "bank": spark.createDataFrame(rows, BANK).repartition(4),
        "invoice": none,
        "labels": spark.createDataFrame(labels, "txn_id string, expected_status string, expected_exception_code string, category string"),
    }


@pytest.mark.parametrize("form", B.FORMS)
def test_round_trip(spark, tmp_path, form):
    folder, written = str(tmp_path / "batch"), feeds(spark)
    B.write_bundle(written, folder, form)
    back = B.read_bundle(spark, folder, ("bank", "invoice", "labels"))
    found = ingest(back["bank"], "bank")
    assert [(r.bank_ref, r.narration, r.utr) for r in found.valid.orderBy("src_pos").collect()] == [
        (f"B{i}", (ODD[i % len(ODD)] or None) if form == "csv" else ODD[i % len(ODD)], None if i % 3 else f"U{i}")
        for i in range(90)
        if i % 7
    ]
    assert found.rejects.count() == 13
    assert ingest(back["invoice"], "invoice").valid.count() == 0
    assert sorted(r.txn_id for r in back["labels"].collect()) == [f"T{i:03}" for i in range(40)]
    assert {r.expected_exception_code for r in back["labels"].collect()} == {"NONE"}


def part_files(folder):
    return sorted(f for f in os.listdir(folder) if f.startswith("part-") and os.path.getsize(os.path.join(folder, f)))


def test_other_folders_are_refused(spark, tmp_path):
    folder = str(tmp_path / "batch")
    with pytest.raises(B.IncompleteBatch, match="never finished"):
        B.read_bundle(spark, folder)
    B.write_bundle(feeds(spark), folder, "lines")
    kept = ("bank", "labels")
    B.read_bundle(spark, folder, kept)
    with pytest.raises(B.IncompleteBatch, match="pg is missing"):
        B.read_bundle(spark, folder, ("pg", "bank"))
    first = os.path.join(folder, "bank", part_files(os.path.join(folder, "bank"))[0])
    whole = open(first).read()

    def now(text):
        with open(first, "w") as f:
            f.write(text)
        crc = os.path.join(os.path.dirname(first), f".{os.path.basename(first)}.crc")
        if os.path.exists(crc):
            os.remove(crc)

    now(whole.replace("B", "C", 1))  # as long, other content
    with pytest.raises(B.IncompleteBatch, match="1 files"):
        B.read_bundle(spark, folder, kept)
    now("".join(whole.splitlines(True)[:-1]))  # cut short
    with pytest.raises(B.IncompleteBatch, match="1 files"):
        B.read_bundle(spark, folder, kept)
    now(whole)
    B.read_bundle(spark, folder, kept)
    with open(os.path.join(folder, "bank", "part-extra.json"), "w") as f:
        f.write("{}\n")
    with pytest.raises(B.IncompleteBatch, match="part-extra"):
        B.read_bundle(spark, folder, kept)


def test_a_line_break_in_csv_is_an_error(spark, tmp_path):
    rows = {"bank": spark.createDataFrame([(1, "a\nb")], "src_pos long, bank_ref string")}
    with pytest.raises(Exception, match="line break"):
        B.write_bundle(rows, str(tmp_path / "batch"), "csv")


@pytest.mark.parametrize("kind", ["unlike", "ties", "two", "one"])
def test_order_statistics(spark, kind):
    rng = random.Random(7)
    values = [
        {"unlike": rng.gauss(0, 1e6), "ties": float(rng.randrange(40)), "two": float(i % 2), "one": 3.25}[kind] for i in range(6001)
    ]
    rows = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(5)
    values.sort()
    ranks = [1, 2, 17, 3000, 3001, 3002, 5701, 6001]
    # a small limit and a coarse proposal, so that intervals shrink in many passes
    assert order_statistics(rows, "v", [*ranks, 0, 6002], small=20, accuracy=30) == [*[values[r - 1] for r in ranks], None, None]
    assert order_statistics(rows, "v", [3001])[0] == statistics.median(values)
    assert order_statistics(rows.filter("v is null"), "v", [1]) == [None]
