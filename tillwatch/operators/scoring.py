"""Weighted linear risk score, decision bands and contributing factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed_values as fv
from .rules import rule_flags

Model = list[tuple[str, float, str, float | None]]


def check_model(model: Model) -> Model:
    if not model:
        raise ValueError("a scoring model needs at least one feature")
    total = sum(weight for _, weight, _, _ in model)
    if total > 1.0 + 1e-9:
        raise ValueError(f"the feature weights add up to {total:.4f}, more than 1")
    return model


def model_faults(models: DataFrame, features: DataFrame) -> DataFrame:
    """(model_id, fault) of stored models: ``models`` (model_id) with their ``features`` (model_id, feature, weight).

    Faults are those that ``check_model`` refuses, and a feature listed twice; a model has a row for each. Weights are
    added in millionths, so the order of the rows does not matter.
    """
    listed = features.groupBy("model_id", "feature").agg(
        F.sum(F.round(F.col("weight") * 1_000_000).cast("long")).alias("millionths"), F.count("*").alias("times")
    )
    sums = listed.groupBy("model_id").agg(F.sum("millionths").alias("total"), F.max("times").alias("times"))
    met = models.select("model_id").distinct().join(sums, "model_id", "left")
    faults = F.array(
        F.when(F.col("total").isNull(), F.lit("no feature")),
        F.when(F.col("total") > 1_000_000, F.lit("weights add up to more than 1")),
        F.when(F.col("times") > 1, F.lit("a feature is listed twice")),
    )
    return met.select("model_id", F.explode(F.array_compact(faults)).alias("fault"))


Contribution = tuple[str, float, Column]


def contributions(model: Model | None = None) -> list[Contribution]:
    """(feature, weight, weighted normalised value) in model order."""
    return [
        (name, weight, C.normalise(F.col(name), method, cap) * F.lit(weight))
        for name, weight, method, cap in check_model(fv.MODEL if model is None else model)
    ]


def risk_score(parts: list[Contribution]) -> Column:
    """round(100 + 900 * weighted sum), within [100, 1000]; terms add up in model order."""
    total = F.lit(0.0)
    for _, _, part in parts:
        total = total + part
    score = F.floor(F.lit(100.0) + total * F.lit(900.0) + F.lit(0.5)).cast("int")
    return F.greatest(F.lit(fv.SCORE_MIN), F.least(F.lit(fv.SCORE_MAX), score))


def contributing_factors(parts: list[Contribution], share: float = fv.FACTOR_SHARE) -> Column:
    return C.texts_where([(part > F.lit(share * weight), F.lit(name)) for name, weight, part in parts])


def decide(score: Column, approve_below: int = fv.APPROVE_BELOW, decline_above: int = fv.DECLINE_ABOVE) -> Column:
    """Decision code; both limits themselves are REVIEW."""
    codes = {name: code for code, name in fv.DECISIONS.items()}
    return (
        F.when(score < approve_below, F.lit(codes["APPROVE"]))
        .when(score > decline_above, F.lit(codes["DECLINE"]))
        .otherwise(F.lit(codes["REVIEW"]))
    )


def decision_name(decision: Column) -> Column:
    return C.label(decision, fv.DECISIONS, "DECISION_UNSPECIFIED")


def with_features(df: DataFrame) -> DataFrame:
    """Complete the feature vector; velocity that was not computed counts as zero."""
    from .velocity import LONG_COLUMNS, VELOCITY_COLUMNS

    missing = {
        c: F.lit(0).cast("long" if c in LONG_COLUMNS else "int")
        for c in VELOCITY_COLUMNS
        if c not in df.columns
    }
    return df.withColumns({**missing, **rule_flags(F.col("event_ts"))})


def with_fallback(df: DataFrame, answered: Column) -> DataFrame:
    """Decide every row; one whose scoring call got no answer takes the fallback score."""
    return (
        df.withColumn("score_source", F.when(answered, F.lit("model")).otherwise(F.lit("fallback")))
        .withColumn("risk_score", F.when(answered, F.col("risk_score")).otherwise(F.lit(fv.FALLBACK_SCORE)))
        .withColumn("decision", decide(F.col("risk_score")))
    )


def with_score(df: DataFrame, answered: Column | None = None, model: Model | None = None) -> DataFrame:
    """Add risk_score, contributing_factors, score_source and decision.

    A request without a transaction id is never answered.
    """
    valid = F.col("txn_id") != ""
    parts = contributions(model)
    # every term is computed once, into an array that score and factors read
    df = df.withColumn("_terms", F.array(*[part for _, _, part in parts]))
    once = [(name, weight, F.col("_terms")[i]) for i, (name, weight, _) in enumerate(parts)]
    scored = df.withColumns({"risk_score": risk_score(once), "contributing_factors": contributing_factors(once)})
    return with_fallback(scored.drop("_terms"), valid if answered is None else valid & answered)
