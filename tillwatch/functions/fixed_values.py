"""They decide results, so they must equal the published ones.

Nothing here is computed; the operators read these tables and nothing else.
"""

# --- fixed values: rules, in evaluation order --------------------------------

HIGH_AMOUNT_THRESHOLDS = {
    "OMR": 500000,
    "INR": 5000000,
    "USD": 500000,
    "AED": 1837500,
    "SAR": 1875000,
    "BHD": 188500,
    "KWD": 153000,
}
HIGH_AMOUNT_DEFAULT = 500000

RISKY_MCCS = ["7995", "7994", "5999", "6011", "6010", "4829", "6051", "7273", "5912"]
CRYPTO_MCCS = ["6051", "6099"]
DOMESTIC_CURRENCIES = ["OMR", "AED", "SAR", "BHD", "KWD", "QAR"]

RULES = [
    {
        "id": "HIGH_AMOUNT",
        "enabled": True,
        "score_contribution": 200,
        "condition": {
            "type": "amount_threshold",
            "thresholds": {**HIGH_AMOUNT_THRESHOLDS, "DEFAULT": HIGH_AMOUNT_DEFAULT},
        },
    },
    {
        "id": "ROUND_AMOUNT",
        "enabled": True,
        "score_contribution": 80,
        "condition": {"type": "round_amount", "divisible_by": 100000, "min_minor": 100000},
    },
    {
        "id": "RISKY_MCC",
        "enabled": True,
        "score_contribution": 150,
        "condition": {"type": "mcc_list", "mcc_codes": RISKY_MCCS},
    },
    {
        "id": "CRYPTO_EXCHANGE_MCC",
        "enabled": True,
        "score_contribution": 120,
        "condition": {"type": "mcc_list", "mcc_codes": CRYPTO_MCCS},
    },
    {
        "id": "NIGHT_TRANSACTION",
        "enabled": True,
        "score_contribution": 60,
        "condition": {"type": "time_window", "start_hour_utc": 0, "end_hour_utc": 5},
    },
    {
        "id": "WEEKEND_HIGH_AMOUNT",
        "enabled": True,
        "score_contribution": 40,
        "condition": {
            "type": "composite",
            "requires_rules": ["HIGH_AMOUNT"],
            "day_of_week": ["SATURDAY", "SUNDAY"],
        },
    },
    {
        "id": "CARD_NOT_PRESENT",
        "enabled": True,
        "score_contribution": 50,
        "condition": {"type": "channel_match", "channels": ["PG"]},
    },
    {
        "id": "FOREIGN_CURRENCY",
        "enabled": True,
        "score_contribution": 70,
        "condition": {"type": "currency_not_in", "domestic_currencies": DOMESTIC_CURRENCIES},
    },
]

# id, feature column, threshold (fires at or above it), points
VELOCITY_RULES = [
    ("TXN_COUNT_1MIN", "txn_count_1min", 5, 250),
    ("TXN_COUNT_5MIN", "txn_count_5min", 10, 150),
    ("TXN_COUNT_1HR", "txn_count_1hr", 20, 80),
    ("AMOUNT_SUM_1MIN", "amount_sum_1min", 100000, 200),
    ("AMOUNT_SUM_1HR", "amount_sum_1hr", 1000000, 100),
    ("UNIQUE_MERCHANTS_5MIN", "unique_merchants_5min", 3, 180),
    ("UNIQUE_TERMINALS_5MIN", "unique_terminals_5min", 4, 120),
]

MERCHANT_OVERRIDES = {
    "M_TRUSTED_001": 0.05,
    "M_TRUSTED_002": 0.10,
    "M_RISKY_001": 0.90,
    "M_RISKY_002": 0.85,
}
UNKNOWN_MERCHANT_RISK = 0.5

# --- fixed values: velocity windows, milliseconds ----------------------------

MINUTE_MS = 60_000
FIVE_MINUTES_MS = 300_000
HOUR_MS = 3_600_000
DAY_MS = 86_400_000

# --- fixed values: scoring model (name, weight, method, cap), in order -------

MODEL = [
    ("amount_minor", 0.20, "log10", 999999999999.0),
    ("txn_count_1min", 0.15, "linear_cap", 20.0),
    ("txn_count_5min", 0.10, "linear_cap", 30.0),
    ("txn_count_1hr", 0.05, "linear_cap", 50.0),
    ("amount_sum_1min", 0.15, "log10", 1000000000.0),
    ("amount_sum_1hr", 0.08, "log10", 10000000000.0),
    ("unique_merchants_5min", 0.10, "linear_cap", 10.0),
    ("unique_terminals_5min", 0.07, "linear_cap", 10.0),
    ("merchant_risk", 0.05, "passthrough", None),
    ("is_night", 0.02, "binary", None),
    ("is_risky_mcc", 0.02, "binary", None),
    ("is_card_not_present", 0.01, "binary", None),
]
FACTOR_SHARE = 0.05
APPROVE_BELOW = 400
DECLINE_ABOVE = 700
FALLBACK_SCORE = 600

# --- fixed values: enum codes and labels -------------------------------------

DECISIONS = {1: "APPROVE", 2: "DECLINE", 3: "REVIEW"}
STATUS_LABELS = {1: "APPROVED", 2: "DECLINED", 3: "REVIEW"}
TRANSACTION_TYPES = {1: "sales", 2: "void", 3: "refund", 4: "reversal"}
CHANNELS = {1: "pos", 2: "pg"}
SCHEMES = {1: "mastercard", 2: "visa", 3: "amex", 4: "union_pay"}

# --- fixed values: request validation ----------------------------------------

SUPPORTED_CURRENCIES = ["OMR", "INR", "USD", "AED", "SAR", "BHD", "KWD", "QAR"]
AMOUNT_MIN = 1
AMOUNT_MAX = 999999999999
TERMINAL_ID_MAX = 16
MERCHANT_ID_MAX = 20
# what a failed check says; currency is followed by the value in quotes
CHECK_TEXTS = {
    "idempotency_key": "idempotency_key: required",
    "card_hash": "card_hash: required",
    "pan_last4": "pan_last4: must be exactly 4 digits",
    "amount": "amount_minor: must be 1–999999999999",
    "currency": "currency: unsupported value ",
    "transaction_type": "transaction_type: required",
    "channel": "channel: required",
    "mcc": "mcc: does not match pattern ^[0-9]{4}$",
    "terminal_id": "terminal_id: exceeds max length 16",
    "merchant_id": "merchant_id: exceeds max length 20",
}
ALLOWED_TYPES = ["sales", "refund", "void", "auth"]
ALLOWED_CHANNELS = ["pos", "pg", "atm", "moto"]
REQUESTS_PER_SECOND = 100
REQUEST_BURST = 200

# --- fixed values: stored table ----------------------------------------------

# column -> widest value, in characters
COLUMN_WIDTHS = {
    "card_hash": 64,
    "masked_pan": 19,
    "currency": 3,
    "merchant_id": 50,
    "transaction_type": 20,
    "channel": 10,
    "scheme": 20,
    "rrn": 12,
    "terminal_id": 50,
    "mcc": 4,
    "status": 10,
}
REQUIRED_COLUMNS = ["txn_id", "card_hash", "amount_minor", "currency", "txn_timestamp"]
SCORE_MIN = 100
SCORE_MAX = 1000
FIRST_MONTH = "2025-01"
LAST_MONTH = "2026-12"
DEFAULT_MONTH = "default"
RESULT_TOPIC = "fraud_results"
BATCH_FAILURE = "db_error after {attempts} attempts: {error}"
QUARANTINE_TIME = "yyyy-MM-dd'T'HH:mm:ss'Z'"
# write attempts; seconds before the second, growth, and the longest wait
MAX_ATTEMPTS = 3
RETRY_DELAY = 5.0
RETRY_GROWTH = 2.0
RETRY_LONGEST = 10.0

# --- fixed values: histogram buckets -----------------------------------------

SCORE_BUCKETS = [100, 200, 300, 400, 500, 600, 700, 800, 900, 1000]
BATCH_BUCKETS = [1, 51, 101, 151, 201, 251, 301, 351, 401, 451, 501]
LATENCY_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]

# --- fixed values: failed-call episodes --------------------------------------

FAILURE_GAP_MS = 30_000
FAILURE_THRESHOLD = 5
