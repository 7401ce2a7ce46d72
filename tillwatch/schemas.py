"""Explicit schemas; nothing is inferred from files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.columns import present


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()

REQUESTS = _schema(
    ("pan", _S), ("pan_last4", _S), ("card_expiry", _S), ("card_hash", _S),
    ("amount_minor", _L), ("currency", _S), ("merchant_id", _S), ("mcc", _S),
    ("transaction_type", _I), ("channel", _I), ("terminal_id", _S),
    ("idempotency_key", _S), ("client_id", _S), ("ts", T.TimestampType()),
)

TRANSACTIONS = _schema(
    ("txn_id", _S), ("txn_timestamp", _S), ("card_hash", _S), ("masked_pan", _S),
    ("amount_minor", _L), ("currency", _S), ("merchant_id", _S), ("terminal_id", _S),
    ("mcc", _S), ("transaction_type", _I), ("channel", _I), ("scheme", _I), ("rrn", _S),
)

FEATURES = _schema(
    ("txn_count_1min", _I), ("txn_count_5min", _I), ("txn_count_1hr", _I),
    ("amount_sum_1min", _L), ("amount_sum_1hr", _L),
    ("unique_merchants_5min", _I), ("unique_terminals_5min", _I),
    ("merchant_risk", _D), ("is_night", _I), ("is_risky_mcc", _I), ("is_card_not_present", _I),
)

FRAUD_RESULTS = T.StructType(
    TRANSACTIONS.fields
    + _schema(
        ("processed_at", _S), ("decision", _I), ("risk_score", _I),
        ("triggered_rules", T.ArrayType(_S)),
    ).fields
)

STORED = _schema(
    ("txn_id", _S), ("card_hash", _S), ("masked_pan", _S), ("amount_minor", _L), ("currency", _S),
    ("merchant_id", _S), ("transaction_type", _S), ("channel", _S), ("scheme", _S), ("rrn", _S),
    ("terminal_id", _S), ("mcc", _S), ("txn_timestamp", T.TimestampType()), ("status", _S),
    ("risk_score", _I), ("triggered_rules", _S), ("decision", _S),
    ("processed_at", T.TimestampType()), ("created_at", T.TimestampType()),
    ("updated_at", T.TimestampType()), ("txn_month", _S),
)

QUARANTINE = _schema(
    ("key", T.BinaryType()), ("value", T.BinaryType()),
    ("dlq_original_topic", _S), ("dlq_original_partition", _S), ("dlq_original_offset", _S),
    ("dlq_failure_reason", _S), ("dlq_retry_count", _S), ("dlq_failed_at", _S),
)

MERCHANTS = _schema(
    ("merchant_id", _S), ("risk_score", T.DecimalType(4, 3)), ("updated_at", T.TimestampType()),
)

RAW_FRAMES = _schema(("partition", _I), ("offset", _L), ("key", _S), ("value", T.BinaryType()))


def fill_absent(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Give every column of ``schema`` that ``df`` holds its absent value: '' or 0."""
    fixed = {}
    for field in schema.fields:
        if field.name not in df.columns:
            continue
        if isinstance(field.dataType, T.StringType):
            fixed[field.name] = present(F.col(field.name), "")
        elif isinstance(field.dataType, (T.LongType, T.IntegerType)):
            fixed[field.name] = present(F.col(field.name), 0).cast(field.dataType)
        elif isinstance(field.dataType, T.DoubleType):
            fixed[field.name] = present(F.col(field.name), 0.0)
    return df.withColumns(fixed)
