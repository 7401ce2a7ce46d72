"""Stored sketches: exact for few values, within their error for many."""

import pytest
from pyspark.sql import functions as F

from tillwatch.operators import reports, rules, sketches
from tillwatch.operators.storage import union_of
from tillwatch.session import new_table_path


def test_quantiles_within_the_rank_error(spark):
    n = 300_000
    rows = spark.range(n).select(F.col("id").alias("ms"), F.pmod(F.xxhash64("id"), F.lit(n)).alias("v"), F.lit("a").alias("g"))
    minutes = sketches.quantile_states(rows, F.col("v"), F.col("ms"), "g", width_ms=1000)
    assert minutes.count() == 300
    found = sketches.quantiles(sketches.rolled_up(minutes, "g", width_ms=n), 50, 95, 99).first()
    assert found["n_rows"] == n
    for p in (50, 95, 99):
        rank = rows.filter(F.col("v") <= found[f"p{p}"]).count() / n
        assert abs(rank - p / 100) < 0.002


def test_few_values_are_exact(spark):
    rows = spark.createDataFrame([(i, i * 10, "a") for i in range(100)] + [(5, None, "a"), (5, 7, "b")], "ms long, v long, g string")
    states = sketches.quantile_states(rows, F.col("v"), F.col("ms"), "g", width_ms=7)
    found = {r["g"]: tuple(r) for r in sketches.quantiles(sketches.rolled_up(states, "g", width_ms=1000), 50, 99).collect()}
    assert found == {"a": ("a", 0, 100, 490, 980), "b": ("b", 0, 1, 7, 7)}


def test_counted_quantiles_are_exact_for_many_rows(spark):
    n = 300_000
    rows = spark.range(n).select(F.col("id").alias("ms"), (F.col("id") * 7919 % 30_000).alias("v"), F.lit("a").alias("g"))
    counts = sketches.value_counts(rows.union(rows.filter("id < 0")), F.col("v"), F.col("ms"), "g", width_ms=1000)
    found = sketches.counted_quantiles(counts, 1, 50, 95, 99, 100, by=("g",), width_ms=n).first()
    assert tuple(found) == ("a", 0, n, 299, 14_999, 28_499, 29_699, 29_999)


@pytest.mark.parametrize("name", ["a02_score_quantiles", "a10_latency_quantiles"])
def test_quantile_queries_beyond_a_sketch(spark, name):
    import oracle

    from tillwatch.plans.catalog import ORACLES, QUERIES

    base, folder = "/root/testdata/sf0.1", new_table_path(spark, "copies")
    events = spark.read.parquet(f"{base}/events.parquet")
    copies = [events.withColumn("event_id", F.col("event_id") + k * 100_000) for k in range(6)]
    union_of(copies).coalesce(1).write.parquet(f"{folder}/events.parquet")
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    assert oracle.spark_rows(QUERIES[name](spark, folder)) == oracle.duck_rows(con, ORACLES[name])


def test_distinct_counts_over_ranges(spark):
    rows = spark.range(200_000).select(
        F.lit("c").alias("card_hash"), (F.col("id") * 30).alias("ms"), (F.col("id") % 40_000).cast("string").alias("merchant_id"),
        (F.col("id") % 7).cast("string").alias("terminal_id"),
    )
    states = sketches.bucket_states(rows).persist()
    assert states.count() == 20
    whole = sketches.between(states, 0, 19).first()
    assert abs(whole["unique_merchants"] - 40_000) < 3 * 0.0081 * 40_000
    assert whole["unique_terminals"] == 7
    part = sketches.between(states, 3, 4).first()
    assert abs(part["unique_merchants"] - 20_000) < 3 * 0.0081 * 20_000


def test_a_stray_time_makes_no_large_array(spark):
    rows = spark.createDataFrame([("1999-01-01T00:00:00Z",), ("2001-01-01T00:00:00Z",)], "dlq_failed_at string")
    alerts = reports.quarantine_alerts(rows, seconds=120)
    assert alerts.count() == 731 * 720 + 1
    assert alerts.filter("alert").count() == 2


def test_rules_that_name_later_unknown_and_circular_rules(spark):
    def rule(name, *needed):
        kind = {"type": "composite", "requires_rules": list(needed)} if needed else {"type": "round_amount", "min_minor": 0, "divisible_by": 10}
        return {"id": name, "enabled": True, "score_contribution": 1, "condition": kind}

    ts = F.current_timestamp()
    before = list(rules.rule_columns(ts, [rule("a"), rule("b", "a")]))
    assert before == ["a", "b"]
    assert list(rules.rule_columns(ts, [rule("b", "a"), rule("a")])) == ["b", "a"]
    with pytest.raises(ValueError, match="unknown rule 'x'"):
        rules.rule_columns(ts, [rule("a"), rule("b", "x")])
    with pytest.raises(ValueError, match="require each other"):
        rules.rule_columns(ts, [rule("a", "b"), rule("b", "a")])
