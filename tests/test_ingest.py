import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import ingest as I
from ledgerloom.sources.sinks import write_csv, write_json

GOOD = {
    "bank_ref": "BANKREF_TXN_00001",
    "utr": "UTR1",
    "credited_amount": "10.00",
    "value_date": "2026-08-01",
    "narration": None,
    "extra": "ignored",
}


def bank(tmp_path, spark, *records):
    path = tmp_path / "bank.json"
    path.write_text(json.dumps(list(records)))
    return I.ingest(I.scan_json_array(spark, str(path)), "bank")


@pytest.mark.parametrize(
    "amount,code",
    [
        ("10.00", None),
        (12, None),
        ("0", None),
        (10.5, "credited_amount:NOT_EXACT_MONEY"),
        (True, "credited_amount:NOT_EXACT_MONEY"),
        (None, "credited_amount:NULL_MONEY"),
        ("NaN", "credited_amount:NOT_A_NUMBER"),
        ("Infinity", "credited_amount:NOT_A_NUMBER"),
        ("NOT_A_NUMBER", "credited_amount:NOT_A_NUMBER"),
        ("1.23456", "credited_amount:OUT_OF_RANGE"),
        ("-5.00", "credited_amount:UNSUPPORTED_TRANSACTION_TYPE"),
    ],
)
def test_money_firewall(spark, tmp_path, amount, code):
    out = bank(tmp_path, spark, dict(GOOD, credited_amount=amount))
    rejects = out.rejects.collect()
    assert (rejects[0].errors == [code]) if code else (out.valid.count() == 1 and not rejects)
    if code and code.endswith("UNSUPPORTED_TRANSACTION_TYPE"):
        assert rejects[0].error_code == "UNSUPPORTED_TRANSACTION_TYPE"


def test_one_bad_row_never_stops_the_batch(spark, tmp_path):
    missing = {k: v for k, v in GOOD.items() if k != "credited_amount"}
    out = bank(tmp_path, spark, GOOD, missing, dict(GOOD, value_date="01/08/2026"), GOOD)
    assert [r.src_pos for r in out.valid.orderBy("src_pos").collect()] == [0, 3]
    rejects = {r.src_pos: r for r in out.rejects.collect()}
    assert rejects[1].errors == ["credited_amount:MISSING"]
    assert rejects[2].errors == ["value_date:BAD_DATE"]
    assert json.loads(rejects[1].raw)["bank_ref"] == "BANKREF_TXN_00001"
    assert out.valid.first().bank_charges == 0


def test_hard_failures(spark, tmp_path):
    path = tmp_path / "root.json"
    path.write_text('{"not": "an array"}')
    with pytest.raises(Exception, match="not a JSON array"):
        I.scan_json_array(spark, str(path)).collect()
    path.write_text("[{broken")
    with pytest.raises(Exception, match="MALFORMED"):
        I.scan_json_array(spark, str(path)).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        I.scan_json_array(spark, str(tmp_path / "none.json")).collect()


def test_json_lines_scan_keeps_order(spark, tmp_path):
    path = tmp_path / "bank.jsonl"
    path.write_text("\n".join(json.dumps(dict(GOOD, bank_ref=f"R{i}")) for i in range(5)))
    rows = I.ingest(I.scan_json_lines(spark, str(path)), "bank").valid.orderBy("src_pos").collect()
    assert [r.bank_ref for r in rows] == [f"R{i}" for i in range(5)]


def test_sinks_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "k int, a string, b string")
    write_json(rows, str(tmp_path / "j"))
    write_csv(rows, str(tmp_path / "c"))
    assert spark.read.schema(rows.schema).json(str(tmp_path / "j")).count() == 2
    back = spark.read.option("header", True).csv(str(tmp_path / "c"))
    assert back.filter(F.col("b").isNull()).count() == 1


def test_json_lines_keep_file_order_and_broken_lines(spark, tmp_path):
    from ledgerloom.sources.ingest import ingest, scan_json_lines

    good = {"invoice_id": "I", "txn_id": "T", "invoice_amount": "1.00", "claimed_gst": "0", "claimed_tds": "0", "period": "2026-08"}
    rows = [json.dumps({**good, "invoice_id": f"a{i}"}) for i in range(3)]
    (tmp_path / "a.jsonl").write_text("\n".join([rows[0], '{"invoice_id": ', rows[2]]) + "\n")
    (tmp_path / "b.jsonl").write_text("".join(json.dumps({**good, "invoice_id": f"b{i}"}) + "\n" for i in range(400)))
    out = ingest(scan_json_lines(spark, str(tmp_path)), "invoice")
    names = [r.invoice_id for r in out.valid.orderBy("src_pos").collect()]
    assert names == ["a0", "a2", *[f"b{i}" for i in range(400)]]
    (bad,) = out.rejects.collect()
    assert "invoice_id" in bad.raw and bad.src_pos == 1
