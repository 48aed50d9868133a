"""Declared feed schemas and the rules each field must satisfy."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # text | money | value | timestamp | date | period
    required: bool = True
    zero: bool = False  # an absent optional money field reads as zero


PG = (
    Field("settlement_id", "text"),
    Field("txn_id", "text"),
    Field("merchant_id", "text"),
    Field("gross_amount", "value"),
    Field("pg_fee", "money"),
    Field("gst_on_fee", "money"),
    Field("tds_withheld", "money", required=False, zero=True),
    Field("net_payout", "money"),
    Field("merchant_gstin", "text", required=False),
    Field("merchant_ytd_gross_opening", "money", required=False, zero=True),
    Field("payment_method", "text", required=False),
    Field("utr", "text", required=False),
    Field("timestamp", "timestamp"),
)

BANK = (
    Field("bank_ref", "text"),
    Field("utr", "text", required=False),
    Field("credited_amount", "value"),
    Field("value_date", "date"),
    Field("narration", "text", required=False),
    Field("bank_charges", "money", required=False, zero=True),
)

INVOICE = (
    Field("invoice_id", "text"),
    Field("txn_id", "text"),
    Field("irn", "text", required=False),
    Field("gstin", "text", required=False),
    Field("invoice_amount", "value"),
    Field("claimed_gst", "money"),
    Field("claimed_tds", "money"),
    Field("period", "period"),
)

FEEDS = {"pg": PG, "bank": BANK, "invoice": INVOICE}

# Feed file names inside a batch folder.
FEED_FILES = {
    "pg": "pg_settlement.json",
    "bank": "bank_statement.json",
    "invoice": "merchant_invoice.json",
}
