"""Rates, tolerances, weights and policy values. Nothing else hardcodes them."""

from decimal import Decimal

# Tax rules.
GST_RATE_ON_FEE = Decimal("0.18")
TDS_RATE = Decimal("0.001")
TDS_ANNUAL_THRESHOLD = Decimal("500000")
MDR_BY_METHOD = {
    "UPI": Decimal("0"),
    "CARD": Decimal("0.02"),
    "NETBANKING": Decimal("0.018"),
}

# Score weights (they sum to 100).
SCORE_TXN_ID_BANK = 20
SCORE_TXN_ID_INVOICE = 20
SCORE_AMOUNT_BANK = 15
SCORE_AMOUNT_INVOICE = 15
SCORE_DATE_PROXIMITY = 15
SCORE_UTR_EXACT = 10
SCORE_FEE_EXACT = 5

# Confidence cuts on the normalised score.
CONFIDENCE_HIGH = 95
CONFIDENCE_MEDIUM = 85
CONFIDENCE_LOW = 70

# Tolerances, all inclusive.
AMOUNT_TOLERANCE = Decimal("0.01")
TAX_TOLERANCE = Decimal("0.01")
DATE_TOLERANCE_DAYS = 3
FUZZY_MIN_SIMILARITY = 85

# Vocabulary.
STATUSES = (
    "MATCHED",
    "PARTIAL_MATCH",
    "TAX_MISMATCH",
    "AMBIGUOUS",
    "HUMAN_REVIEW",
    "UNMATCHED",
)
EXCEPTION_CODES = (
    "NONE",
    "AMOUNT_MISMATCH",
    "MISSING_IN_BANK",
    "MISSING_IN_INVOICE",
    "TIMING_GAP",
    "DUPLICATE_DETECTED",
    "REFERENCE_MISMATCH",
    "ERR_GST_MISMATCH",
    "ERR_TDS_VARIANCE",
    "ERR_TDS_BELOW_THRESHOLD",
    "ERR_MISSING_IRN",
    "AMBIGUOUS_MATCH",
    "CORRUPTED_RECORD",
    "HUMAN_REVIEW_REQUIRED",
)
CONFIDENCE_TIERS = ("HIGH", "MEDIUM", "LOW", "NO_MATCH")
MATCH_TYPES = ("exact_utr", "exact_txn", "fuzzy", "none")
CASH_BUCKET_BY_STATUS = {
    "MATCHED": "settled_and_verified",
    "PARTIAL_MATCH": "awaiting_verification",
    "HUMAN_REVIEW": "blocked_in_exceptions",
    "AMBIGUOUS": "blocked_in_exceptions",
    "TAX_MISMATCH": "blocked_in_exceptions",
    "UNMATCHED": "not_yet_credited",
}
CASH_BUCKETS = (
    "settled_and_verified",
    "awaiting_verification",
    "blocked_in_exceptions",
    "not_yet_credited",
)
UNSUPPORTED_TRANSACTION_TYPE = "UNSUPPORTED_TRANSACTION_TYPE"
SCHEMA_VALIDATION_FAILED = "SCHEMA_VALIDATION_FAILED"
