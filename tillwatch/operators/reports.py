"""Operational reports. All aggregate map-side and shuffle only their groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed_values as fv
from .scoring import decision_name


def decision_counts(results: DataFrame) -> DataFrame:
    return results.groupBy(decision_name(F.col("decision")).alias("decision")).agg(F.count("*").alias("transactions"))


def labelled(buckets: list[float], scale: int = 1) -> dict[str, float]:
    return {f"{b:g}": b * scale for b in buckets}


def cumulative_histogram(
    df: DataFrame, value: Column, buckets: dict[str, float], by: list[str] | None = None
) -> DataFrame:
    """Cumulative ``le`` buckets with +Inf, plus sum and count, in one aggregation."""
    by = by or []
    bounds = [(le, F.count(F.when(F.col("_v") <= b, 1))) for le, b in buckets.items()] + [("+Inf", F.count("_v"))]
    agg = (
        df.select(*by, value.alias("_v"))
        .groupBy(*by)
        .agg(
            *[n.alias(f"b{i}") for i, (_, n) in enumerate(bounds)],
            F.coalesce(F.sum("_v"), F.lit(0)).alias("value_sum"),
            F.count("_v").alias("value_count"),
        )
    )
    rows = F.array(
        *[
            F.struct(F.lit(le).alias("le"), F.col(f"b{i}").alias("bucket_count"))
            for i, (le, _) in enumerate(bounds)
        ]
    )
    return agg.select(*by, F.inline(rows), "value_sum", "value_count")


def score_histogram(results: DataFrame) -> DataFrame:
    return cumulative_histogram(results, F.col("risk_score"), labelled(fv.SCORE_BUCKETS))


def score_histogram_by_decision(results: DataFrame) -> DataFrame:
    named = results.withColumn("decision", decision_name(F.col("decision")))
    return cumulative_histogram(named, F.col("risk_score"), labelled(fv.SCORE_BUCKETS), ["decision"])


def _array_rates(results: DataFrame, column: str, names: list[str], label: str) -> DataFrame:
    """How often each name occurs in an array column. Every name that occurs is counted, and
    those of ``names`` that never do count 0."""
    everything = ""  # stands for the row itself, so that one pass counts names and rows
    seen = F.explode(F.concat(F.array(F.lit(everything)), F.array_distinct(F.coalesce(column, F.array()))))
    found = results.select(seen.alias(label)).groupBy(label).agg(F.count("*").alias("n"))
    known = results.sparkSession.createDataFrame([(n,) for n in (*names, everything)], f"{label} string")
    counted = known.join(found, label, "full").select(label, F.coalesce("n", F.lit(0)).alias("triggered"))
    total = F.max(F.when(F.col(label) == everything, F.col("triggered"))).over(Window.partitionBy())
    rates = counted.withColumn("total", total).filter(F.col(label) != everything)
    return rates.withColumn("rate", F.try_divide("triggered", "total"))


def rule_trigger_rates(results: DataFrame, rules: list[str] | None = None) -> DataFrame:
    return _array_rates(results, "triggered_rules", rules or [r["id"] for r in fv.RULES], "rule_id")


def factor_counts(results: DataFrame, factors: list[str] | None = None) -> DataFrame:
    rates = _array_rates(results, "contributing_factors", factors or [f[0] for f in fv.MODEL], "factor")
    return rates.select("factor", F.col("triggered").alias("transactions"))


def fraud_ratio(results: DataFrame) -> DataFrame:
    declined = {name: code for code, name in fv.DECISIONS.items()}["DECLINE"]
    return results.agg(
        F.count(F.when(F.col("decision") == declined, 1)).alias("declined"), F.count("*").alias("transactions")
    ).withColumn("fraud_ratio", F.col("declined") / F.col("transactions"))


def per_window(df: DataFrame, ts: Column, seconds: int) -> DataFrame:
    """Rows and rows per second in tumbling windows."""
    return (
        df.groupBy(F.window(ts, f"{seconds} seconds").alias("w"))
        .agg(F.count("*").alias("n_rows"))
        .select(
            F.unix_millis("w.start").alias("window_start_ms"),
            "n_rows",
            (F.col("n_rows") / F.lit(seconds)).alias("rows_per_second"),
        )
    )


def throughput(txns: DataFrame, ts: Column) -> DataFrame:
    return per_window(txns, ts, 60)


#: Windows of a time grid that are laid out at once.
GRID_SPAN = 1000


def quarantine_rate(quarantine: DataFrame, seconds: int = 300) -> DataFrame:
    return per_window(quarantine, C.parse_ts(F.col("dlq_failed_at")), seconds)


def quarantine_alerts(quarantine: DataFrame, seconds: int = 120) -> DataFrame:
    """All windows from the first quarantined row to the last; an alert where anything was quarantined.

    The time grid comes from two aggregates, so quiet windows are rows too. It is laid out in spans of
    ``GRID_SPAN`` windows, which go to many tasks; a time far from all others makes it long, but no array is.
    """
    rate = quarantine_rate(quarantine, seconds)
    step = seconds * 1000
    ends = rate.agg(
        F.expr(f"min(window_start_ms) div {step}").alias("first"), F.expr(f"max(window_start_ms) div {step}").alias("last")
    ).filter("first IS NOT NULL")
    span = F.explode(F.sequence(F.floor(F.col("first") / GRID_SPAN), F.floor(F.col("last") / GRID_SPAN))).alias("span")
    spans = ends.select("first", "last", span).repartition("span")
    begin, end = F.col("span") * GRID_SPAN, F.col("span") * GRID_SPAN + (GRID_SPAN - 1)
    places = F.explode(F.sequence(F.greatest("first", begin), F.least("last", end)))
    grid = spans.select(places.alias("place")).select((F.col("place") * step).alias("window_start_ms"))
    filled = grid.join(rate, "window_start_ms", "left").select(
        "window_start_ms",
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce("rows_per_second", F.lit(0.0)).alias("rows_per_second"),
    )
    return filled.withColumn("alert", F.col("n_rows") > 0)


def write_outcomes(audit: DataFrame) -> DataFrame:
    return audit.groupBy("status").agg(F.sum("units").alias("units"))


def batch_size_histogram(rows: DataFrame) -> DataFrame:
    sizes = rows.groupBy("batch_id").agg(F.count("*").alias("batch_rows"))
    return cumulative_histogram(sizes, F.col("batch_rows"), labelled(fv.BATCH_BUCKETS))


def latency_histogram(results: DataFrame, received_ms: Column, processed_ms: Column) -> DataFrame:
    """Buckets are seconds; the sum stays in whole milliseconds."""
    latency = results.select((processed_ms - received_ms).alias("latency_ms"))
    return cumulative_histogram(latency, F.col("latency_ms"), labelled(fv.LATENCY_BUCKETS, 1000))


def fallback_count(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.when(F.col("score_source") == "fallback", 1)).alias("fallbacks"),
        F.count("*").alias("decisions"),
    )


def request_rate(
    requests: DataFrame, ts: Column, rate: int = fv.REQUESTS_PER_SECOND, burst: int = fv.REQUEST_BURST
) -> DataFrame:
    """Requests per client and second, flagged above the sustained rate and the burst."""
    return (
        requests.groupBy("client_id", F.unix_seconds(ts).alias("second"))
        .agg(F.count("*").alias("requests"))
        .withColumns({"over_rate": F.col("requests") > rate, "over_burst": F.col("requests") > burst})
    )


def table_profile(stored: DataFrame) -> DataFrame:
    return stored.groupBy("txn_month", "status").agg(
        F.count("*").alias("n_rows"), F.sum("amount_minor").alias("amount_minor")
    )
