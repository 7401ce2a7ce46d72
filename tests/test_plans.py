"""What the plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from tillwatch.operators import dedup, storage
from tillwatch.plans import queries as q
from tillwatch.plans.catalog import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan_of(df))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_python(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "MapInArrow"):
        assert word not in plan


@pytest.fixture()
def shuffled_joins(spark):
    """Plans as they are for tables too large to broadcast by estimate."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_scoring_shuffles(spark, sf_dir, shuffled_joins):
    df = q.scored(spark, sf_dir)
    keys = [re.sub(r"#\d+L?", "", e) for e in exchanges(df)]
    # two narrow velocity shuffles, then both sides of the join on (card, ms)
    assert sorted(keys) == sorted(
        ["card_hash, kind, slot, item, 4", "card_hash, block, 4", "card_hash, ms, 4", "card_hash, ms, 4"]
        + ["merchant_id, 4"] * 2
    )
    assert "SortMergeJoin [merchant_id" in plan_of(df)


def test_small_merchant_tables_are_broadcast_by_the_optimizer(spark, sf_dir):
    plan = plan_of(q.j01(spark, sf_dir))
    assert "BroadcastHashJoin [merchant_id" in plan or "BroadcastExchange" in plan or "AdaptiveSparkPlan" in plan


def test_idempotency_never_shuffles_requests_by_key_alone(spark, sf_dir, shuffled_joins):
    from tillwatch.sources import sample_data as sd

    keys = exchanges(dedup.with_original(sd.requests(spark, sf_dir)))
    assert keys and all(re.search(r"\b(ms|origin_ms|block)#", k) for k in keys)


def test_merge_collapses_copies_before_the_shuffle(spark, sf_dir):
    plan = plan_of(q.merged_rows(spark, sf_dir))
    assert plan.index("partial_min_by") > plan.index("Exchange hashpartitioning")
    assert len(exchanges(q.merged_rows(spark, sf_dir))) == 1


def test_newest_per_card_limits_before_the_shuffle(spark, sf_dir):
    assert "row_number(), 3, Partial" in plan_of(q.t03(spark, sf_dir))


def test_only_needed_columns_are_read(spark, sf_dir):
    plan = plan_of(QUERIES["r02_round_amount"](spark, sf_dir))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "props" not in schema and "user_id" not in schema


def test_status_filter_reaches_the_files(spark, sf_dir):
    from tillwatch.operators import lookups
    from tillwatch.session import new_table_path

    path = new_table_path(spark, "table")
    storage.write_table(q.month_rows(spark, sf_dir), path)
    table = storage.read_table(spark, path)
    assert "EqualTo(status,DECLINED)" in plan_of(lookups.by_status(table, "DECLINED"))
    assert "EqualTo(rrn,000000000042)" in plan_of(lookups.by_rrn(table, "000000000042"))
    assert "EqualTo(card_hash,x)" in plan_of(lookups.card_history(table, "x", 5).filter(F.lit(True)))
