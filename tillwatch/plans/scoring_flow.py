"""From transactions to decided results, as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.dedup import first_requests
from ..operators.joins import with_merchant_risk
from ..operators.rules import with_rules
from ..operators.scoring import with_features, with_score
from ..operators.validation import accepted, with_failures
from ..operators.velocity import BLOCK_MS, VELOCITY_COLUMNS, with_velocity
from ..schemas import FEATURES, FRAUD_RESULTS, REQUESTS, TRANSACTIONS, fill_absent

RESULT_COLUMNS = [
    *[f.name for f in TRANSACTIONS.fields],
    "processed_at", "decision", "risk_score", "triggered_rules",
    "score_source", "contributing_factors",
]


def submit(requests: DataFrame, secret: str) -> DataFrame:
    """Valid first-time requests as transactions. ``requests`` needs pan and ts.

    Absent fields count as empty; a request without a time cannot be placed in its 24 hours,
    so ``with_failures`` rejects it with a reason.
    """
    r = accepted(with_failures(fill_absent(requests, REQUESTS)))
    r = r.withColumn("ms", F.unix_millis("ts")).withColumn("txn_id", C.txn_id_for(F.col("idempotency_key"), F.col("ms")))
    return to_events(first_requests(r), secret)


def to_events(requests: DataFrame, secret: str) -> DataFrame:
    """Request rows as transaction events; the card number itself is dropped here."""
    for name in ("scheme", "rrn"):
        if name not in requests.columns:
            absent = F.lit(0) if name == "scheme" else F.lit("")
            requests = requests.withColumn(name, absent)
    return requests.select(
        "txn_id",
        C.format_ts(F.col("ts")).alias("txn_timestamp"),
        C.card_hash(F.col("pan"), secret).alias("card_hash"),
        F.when(F.col("pan") != "", C.mask_pan(F.col("pan"))).otherwise(C.mask_last4(F.col("pan_last4"))).alias("masked_pan"),
        "amount_minor", "currency", "merchant_id", "terminal_id", "mcc",
        "transaction_type", "channel", "scheme", "rrn",
    )


def score_transactions(
    txns: DataFrame,
    merchants: DataFrame,
    now: Column,
    clock_ms: Column | None = None,
    answered: Column | None = None,
    overrides: dict[str, float] | None = None,
    rules: list[dict] | None = None,
    block_ms: int = BLOCK_MS,
) -> DataFrame:
    """Rules, velocity, merchant risk, features, score and decision for every row.

    ``clock_ms`` is the velocity clock (default: the transaction time). ``answered``
    is false on rows whose scoring call failed. Extra columns of ``txns`` are kept.
    """
    df = fill_absent(txns, TRANSACTIONS)
    clock = F.unix_millis(F.coalesce(C.parse_ts(F.col("txn_timestamp")), now)) if clock_ms is None else clock_ms
    df = with_velocity(df.withColumn("ms", clock), block_ms)
    return score_rows(df, merchants, now, answered, overrides, rules)


def score_rows(
    txns: DataFrame,
    merchants: DataFrame,
    now: Column,
    answered: Column | None = None,
    overrides: dict[str, float] | None = None,
    rules: list[dict] | None = None,
) -> DataFrame:
    """The row-wise part, for batches and streams; absent velocity counts as zero."""
    df = with_rules(fill_absent(txns, TRANSACTIONS), now, rules)
    df = with_merchant_risk(df, merchants, overrides)
    return with_score(with_features(df), answered)


def features_struct() -> Column:
    return F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FEATURES.fields]).alias("features")


def results(scored: DataFrame, processed_at: Column) -> DataFrame:
    return scored.withColumn("processed_at", processed_at).select(*RESULT_COLUMNS, *VELOCITY_COLUMNS)


def risk_requests(featured: DataFrame) -> DataFrame:
    """Scoring requests; rows without an id or features cannot be asked."""
    return featured.select(
        "txn_id", "card_hash", "amount_minor", "currency", "merchant_id", "mcc",
        "transaction_type", "channel", features_struct(),
    ).filter((F.col("txn_id") != "") & F.col("features").isNotNull())


def fraud_result_events(scored: DataFrame, processed_at: Column) -> DataFrame:
    """Exactly the columns of the result topic."""
    return scored.withColumn("processed_at", processed_at).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in FRAUD_RESULTS.fields]
    )
