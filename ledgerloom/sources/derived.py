"""The three feeds and their labels, derived from an orders table.

Each order becomes one settlement with its bank credit and invoice, or one of the labelled anomalies,
chosen by the order key. A pure projection of orders: no window, no shuffle, and it grows with them.
All feed columns are strings, as in a real export, so ingestion is exercised.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.money import MONEY, gst_on, mdr_fee, money, tds_on

# Anomaly slots of the order key modulo 25; every other slot is an exact match.
SLOTS = 25
CORRUPTED, DUPLICATE, AMBIGUOUS, NO_BANK, NO_INVOICE = 0, 1, 2, 3, 4
GST_WRONG, TDS_WRONG, SHORT_FIVE, SHORT_SMALL = 5, 6, 7, 8
NARRATION_INTACT, NARRATION_CORRUPT, LATE_TWO, LATE_THREE = 9, 10, 11, 12
UNRESOLVABLE, REFUND = 13, 14

# Fixed values: (slot, category, expected status, expected code).
LABELS = (
    (CORRUPTED, "corrupted", "UNMATCHED", "CORRUPTED_RECORD"),
    (DUPLICATE, "duplicate", "HUMAN_REVIEW", "DUPLICATE_DETECTED"),
    (AMBIGUOUS, "ambiguous", "AMBIGUOUS", "AMBIGUOUS_MATCH"),
    (NO_BANK, "missing_in_source", "UNMATCHED", "MISSING_IN_BANK"),
    (NO_INVOICE, "missing_in_source", "PARTIAL_MATCH", "MISSING_IN_INVOICE"),
    (GST_WRONG, "tax_mismatch", "TAX_MISMATCH", "ERR_GST_MISMATCH"),
    (TDS_WRONG, "tax_mismatch", "TAX_MISMATCH", "ERR_TDS_VARIANCE"),
    (SHORT_FIVE, "amount_fee_discrepancy", "HUMAN_REVIEW", "AMOUNT_MISMATCH"),
    (SHORT_SMALL, "amount_fee_discrepancy", "HUMAN_REVIEW", "AMOUNT_MISMATCH"),
    (NARRATION_INTACT, "reference_mismatch_fuzzy", "MATCHED", "NONE"),
    (NARRATION_CORRUPT, "reference_mismatch_fuzzy", "MATCHED", "NONE"),
    (LATE_TWO, "timing_difference", "MATCHED", "NONE"),
    (LATE_THREE, "timing_difference", "MATCHED", "NONE"),
    (UNRESOLVABLE, "unresolvable", "HUMAN_REVIEW", "AMOUNT_MISMATCH"),
    (REFUND, "refund", "UNMATCHED", "MISSING_IN_BANK"),
)
DEFAULT_LABEL = ("exact_match", "MATCHED", "NONE")


def _pad8(k: Column) -> Column:
    """Eight digits, more when the key needs them."""
    return F.when(k < 10**8, F.lpad(k.cast("string"), 8, "0")).otherwise(k.cast("string"))


def _by_slot(slot: Column, position: int) -> Column:
    out = F.lit(DEFAULT_LABEL[position])
    for row in LABELS:
        out = F.when(slot == row[0], row[position + 1]).otherwise(out)
    return out


def economics(orders: DataFrame) -> DataFrame:
    """One row per settlement (an ambiguous order yields two) with typed amounts."""
    k = F.col("o_orderkey")
    slot = F.pmod(k, F.lit(SLOTS))
    base = orders.select(
        k.alias("k"),
        slot.alias("slot"),
        F.format_string("MERCH_%03d", F.pmod(F.col("o_custkey"), F.lit(50)).cast("int")).alias("merchant_id"),
        F.col("o_totalprice").cast(MONEY).alias("gross"),
        F.when(slot == GST_WRONG, "CARD")
        .otherwise(
            F.element_at(F.array(F.lit("UPI"), F.lit("CARD"), F.lit("NETBANKING")), (F.pmod(k, F.lit(3)) + 1).cast("int"))
        )
        .alias("method"),
        F.to_date("o_orderdate").alias("day"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("timestamp"),
        F.when(slot == AMBIGUOUS, F.lit(0)).otherwise(F.pmod(k * 7919, F.lit(900000))).cast(MONEY).alias("opening"),
        F.explode(F.when(slot == AMBIGUOUS, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("sibling"),
    )
    cycle = F.lit(899999999)
    number = F.lit(100000000) + F.pmod(F.col("k") * 7919, cycle) + F.floor(F.col("k") / cycle) * 1000000000
    priced = (
        base.withColumn("fee", mdr_fee(F.col("gross"), F.col("method")))
        .withColumn("gst", gst_on(F.col("fee")))
        .withColumn("tds", tds_on(F.col("gross"), F.col("opening") + F.col("gross")))
        .withColumn("net", (F.col("gross") - F.col("fee") - F.col("gst") - F.col("tds")).cast(MONEY))
        .withColumn(
            "txn_id",
            F.concat(F.when(F.col("sibling") == 1, "PYT_").otherwise("TXN_"), _pad8(F.col("k"))),
        )
        .withColumn(
            "utr",
            F.concat(F.when(F.col("sibling") == 1, "UTS").otherwise("UTR"), number.cast("bigint").cast("string")),
        )
    )
    return priced


def pg_rows(settlements: DataFrame) -> DataFrame:
    return settlements.select(
        (F.col("k") * 2 + F.col("sibling")).alias("src_pos"),
        F.concat(F.lit("SET_"), "txn_id").alias("settlement_id"),
        "txn_id",
        "merchant_id",
        F.when(F.col("slot") == CORRUPTED, "NOT_A_NUMBER").otherwise(F.col("gross").cast("string")).alias("gross_amount"),
        F.col("fee").cast("string").alias("pg_fee"),
        F.col("gst").cast("string").alias("gst_on_fee"),
        F.col("tds").cast("string").alias("tds_withheld"),
        F.col("net").cast("string").alias("net_payout"),
        F.concat(F.lit("29AAAAA"), F.substring("merchant_id", 7, 3), F.lit("A1Z5")).alias("merchant_gstin"),
        F.col("opening").cast("string").alias("merchant_ytd_gross_opening"),
        F.col("method").alias("payment_method"),
        "utr",
        "timestamp",
    )


def _narration() -> Column:
    """One of five statement shapes around the reference, or the transaction id itself."""
    turn = F.floor(F.col("k") / SLOTS)
    at = (F.pmod(turn, F.lit(12)) + 1).cast("int")
    original = F.substr(F.col("utr"), at, F.lit(1))
    swapped = F.when(original == "3", "8").otherwise("3")
    corrupted = F.concat(
        F.substr(F.col("utr"), F.lit(1), at - 1), swapped, F.substr(F.col("utr"), at + 1, F.length("utr"))
    )
    ref = F.when(F.col("slot") == NARRATION_CORRUPT, corrupted).otherwise(F.col("utr"))
    m = F.col("merchant_id")
    shape = F.pmod(turn, F.lit(5))
    text = (
        F.when(shape == 0, F.concat(F.lit("NEFT-HDFC0001234-"), ref, F.lit("-"), m))
        .when(
            shape == 1,
            F.concat(F.lit("IMPS/"), (F.lit(100000000000) + F.col("k")).cast("string"), F.lit("/"), ref, F.lit("/SETTLEMENT")),
        )
        .when(shape == 2, F.concat(F.lit("BY TRANSFER-NEFT*HDFC*"), ref, F.lit("*GATEWAY-")))
        .when(shape == 3, F.concat(F.lit("RTGS CR "), ref, F.lit(" "), m, F.lit(" SETTLEMENT")))
        .otherwise(F.concat(F.lit("UPI/"), ref, F.lit("/"), m, F.lit("/NET STLMNT")))
    )
    carries_id = F.concat(F.lit("SETTLEMENT "), F.lower("txn_id"), F.lit(" "), F.col("utr"))
    return F.when(F.col("slot") == LATE_THREE, carries_id).otherwise(text)


def bank_rows(settlements: DataFrame) -> DataFrame:
    slot = F.col("slot")
    copies = F.when(slot == DUPLICATE, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    credited = (
        F.when(slot == SHORT_FIVE, F.col("net") - F.lit(5))
        .when(slot == SHORT_SMALL, F.col("net") - F.lit("0.75").cast(MONEY))
        .when(slot == UNRESOLVABLE, F.col("net") - F.lit(50))
        .when(slot == REFUND, -F.col("net"))
        .otherwise(F.col("net"))
        .cast(MONEY)
    )
    delay = (
        F.when(slot == LATE_TWO, 2).when(slot == LATE_THREE, 3).when(slot == UNRESOLVABLE, 9).otherwise(1)
    )
    native = F.concat(F.lit("HDFC0001234N"), (F.lit(10000000) + F.col("k")).cast("string"))
    own = F.concat(F.lit("BANKREF_"), "txn_id", F.when(F.col("copy") == 1, "_DUP").otherwise(""))
    return (
        settlements.filter(slot != NO_BANK)
        .withColumn("copy", F.explode(copies))
        .select(
            (F.col("k") * 4 + F.col("copy") + F.col("sibling") * 2).alias("src_pos"),
            F.when(slot.isin(NARRATION_INTACT, NARRATION_CORRUPT, LATE_THREE), native).otherwise(own).alias("bank_ref"),
            F.when(~slot.isin(NARRATION_INTACT, NARRATION_CORRUPT, UNRESOLVABLE), F.col("utr")).alias("utr"),
            credited.cast("string").alias("credited_amount"),
            F.date_add("day", delay).cast("string").alias("value_date"),
            _narration().alias("narration"),
            F.lit("0.00").alias("bank_charges"),
        )
    )


def invoice_rows(settlements: DataFrame) -> DataFrame:
    slot = F.col("slot")
    gst = F.when(slot == GST_WRONG, money(F.col("fee") * F.lit("0.12").cast("decimal(4,2)"))).otherwise(F.col("gst"))
    tds = F.when(slot == TDS_WRONG, money(F.col("gross") * F.lit("0.01").cast("decimal(4,2)"))).otherwise(F.col("tds"))
    return settlements.filter(slot != NO_INVOICE).select(
        (F.col("k") * 2 + F.col("sibling")).alias("src_pos"),
        F.concat(F.lit("INV_"), "txn_id").alias("invoice_id"),
        "txn_id",
        F.sha2("txn_id", 256).alias("irn"),
        F.concat(F.lit("29AAAAA"), F.substring("merchant_id", 7, 3), F.lit("A1Z5")).alias("gstin"),
        (F.col("fee") + F.col("gst")).cast(MONEY).cast("string").alias("invoice_amount"),
        gst.cast(MONEY).cast("string").alias("claimed_gst"),
        tds.cast(MONEY).cast("string").alias("claimed_tds"),
        F.date_format("day", "yyyy-MM").alias("period"),
    )


def label_rows(settlements: DataFrame) -> DataFrame:
    slot = F.col("slot")
    return settlements.select(
        "txn_id",
        _by_slot(slot, 1).alias("expected_status"),
        _by_slot(slot, 2).alias("expected_exception_code"),
        _by_slot(slot, 0).alias("category"),
    )


def _spread(orders: DataFrame) -> DataFrame:
    """A table of fewer splits than cores (one small file) is dealt out; a large one is left as scanned."""
    cores = orders.sparkSession.sparkContext.defaultParallelism
    used = orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return used.repartition(cores, "o_orderkey") if used.rdd.getNumPartitions() < cores else used


def derived_feeds(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Tables of string columns: pg, bank, invoice and labels."""
    orders = spark.read.parquet(os.path.join(sf_dir, "orders.parquet"))
    settlements = economics(_spread(orders))
    return {
        "pg": pg_rows(settlements),
        "bank": bank_rows(settlements),
        "invoice": invoice_rows(settlements),
        "labels": label_rows(settlements),
    }
