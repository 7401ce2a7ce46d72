"""Key lookups and reconciliation joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed_values as fv

NUMERIC = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"


def as_score(col: Column) -> Column:
    """Stored scores may be text; anything unreadable is NULL."""
    text = col.cast("string")
    return F.when(text.rlike(NUMERIC), text.try_cast("double"))


def newest_merchants(merchants: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` most recently updated merchants."""
    return merchants.orderBy(F.desc("updated_at"), "merchant_id").limit(limit)


def merchant_scores(merchants: DataFrame, overrides: dict[str, float] | None = None) -> DataFrame:
    """(merchant_id, stored_risk) of all merchants: the override, else the score updated last."""
    scores = merchants.groupBy("merchant_id").agg(F.max_by(as_score(F.col("risk_score")), "updated_at").alias("stored_risk"))
    if not overrides:
        return scores
    given = merchants.sparkSession.createDataFrame(list(overrides.items()), "merchant_id string, override double")
    return scores.join(given, "merchant_id", "full").select(
        "merchant_id", F.coalesce("override", "stored_risk").alias("stored_risk")
    )


def with_merchant_risk(
    txns: DataFrame, merchants: DataFrame, overrides: dict[str, float] | None = None
) -> DataFrame:
    """Add ``merchant_risk``: override, else stored score, else the neutral value.

    Any number of merchants. Spark broadcasts the scores when they are small; otherwise both
    sides are shuffled, and adaptive execution splits the rows of a busy merchant.
    """
    joined = txns.join(merchant_scores(merchants, overrides), "merchant_id", "left")
    risk = F.coalesce(F.col("stored_risk"), F.lit(fv.UNKNOWN_MERCHANT_RISK))
    return joined.withColumn("merchant_risk", risk).drop("stored_risk")


def threshold_table(spark: SparkSession, thresholds: dict[str, int] | None = None) -> DataFrame:
    """Currency limits as rows; configured ones are laid over the built-in ones."""
    limits = {**fv.HIGH_AMOUNT_THRESHOLDS, **(thresholds or {})}
    return spark.createDataFrame(list(limits.items()), "currency string, threshold long")


def with_threshold(txns: DataFrame, thresholds: DataFrame, default: int = fv.HIGH_AMOUNT_DEFAULT) -> DataFrame:
    """Add ``threshold``: the limit of the row's currency, else ``default``."""
    joined = txns.join(thresholds, "currency", "left")
    return joined.withColumn("threshold", F.coalesce("threshold", F.lit(default)))


def status_lookup(ids: DataFrame, submitted: DataFrame, results: DataFrame) -> DataFrame:
    """Status of each asked txn_id: decided, PENDING, or NOT_FOUND.

    Repeated submissions and results collapse first, so no id is multiplied; the
    latest result counts.
    """
    known = submitted.groupBy("txn_id").agg(F.min("txn_timestamp").alias("submitted_at"))
    decided = results.groupBy("txn_id").agg(
        F.max(F.struct("processed_at", "risk_score", "decision")).alias("result")
    )
    joined = ids.join(known, "txn_id", "left").join(decided, "txn_id", "left")
    decision = F.col("result.decision")
    return joined.select(
        "txn_id",
        F.when(F.col("result").isNotNull(), C.status_label(decision))
        .when(F.col("submitted_at").isNotNull(), F.lit("PENDING"))
        .otherwise(F.lit("NOT_FOUND"))
        .alias("status"),
        C.label(decision, fv.DECISIONS, "").alias("fraud_decision"),
        F.coalesce("result.risk_score", F.lit(0)).alias("risk_score"),
        F.coalesce("submitted_at", F.lit("")).alias("submitted_at"),
        F.coalesce("result.processed_at", F.lit("")).alias("decided_at"),
    )


def unprocessed(submitted: DataFrame, results: DataFrame) -> DataFrame:
    """Submitted transactions that have no result yet."""
    return submitted.join(results.select("txn_id"), "txn_id", "left_anti")


def not_stored(quarantined: DataFrame, stored: DataFrame) -> DataFrame:
    """Quarantined rows whose primary key is not in the table."""
    return quarantined.join(stored.select("txn_id", "txn_timestamp"), ["txn_id", "txn_timestamp"], "left_anti")
