"""The stored table on disk."""

import pytest
from pyspark.sql import functions as F

from tillwatch.operators import lookups, storage
from tillwatch.plans import queries as q
from tillwatch.session import new_table_path
from tillwatch.sources import frames, readers, replay
from tillwatch.sources import sample_data as sd


def at(text):
    return F.lit(text).cast("timestamp")


def content(df, *drop):
    return sorted(map(repr, df.drop(*drop).select(sorted(c for c in df.columns if c not in drop)).collect()))


@pytest.fixture()
def table(spark):
    return new_table_path(spark, "table")


def test_months_on_disk(spark, sf_dir, table):
    rows = q.month_rows(spark, sf_dir)
    storage.write_table(rows, table)
    back = storage.read_table(spark, table)
    assert content(back) == content(rows)
    assert back.select("txn_month").distinct().count() == 25
    pruned = lookups.date_range(back, "2025-03-10 00:00:00", "2025-05-20 00:00:00")
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(txn_month" in plan
    months = {r[0] for r in pruned.select("txn_month").distinct().collect()}
    assert months == {"2025-03", "2025-04", "2025-05"}


def test_upsert_equals_merge_and_is_idempotent(spark, sf_dir, table):
    existing, incoming = q.upsert_sets(spark, sf_dir)
    storage.upsert(spark, table, existing, at("2024-02-01"))
    storage.upsert(spark, table, incoming, q.now())
    expected = content(storage.merge_rows(existing, incoming, q.now()))
    assert content(storage.read_table(spark, table)) == expected
    storage.upsert(spark, table, incoming, q.now())
    assert content(storage.read_table(spark, table), "updated_at") == content(
        storage.merge_rows(existing, incoming, q.now()), "updated_at"
    )


def test_upsert_leaves_other_months_alone(spark, sf_dir, table):
    rows = q.month_rows(spark, sf_dir)
    storage.upsert(spark, table, rows, q.now())
    files = lambda: {r[0] for r in spark.read.parquet(table).select(F.input_file_name()).distinct().collect()}
    before = files()
    storage.upsert(spark, table, rows.filter("txn_month = '2025-07'"), q.now())
    changed = before ^ files()
    assert changed and all("txn_month=2025-07" in f for f in changed)


def test_empty_upsert(spark, sf_dir, table):
    storage.upsert(spark, table, q.month_rows(spark, sf_dir).limit(0), q.now())
    assert storage.read_table(spark, table) is None


def test_unreadable_times(spark, sf_dir):
    d = sd.decided(spark, sf_dir).limit(1).withColumns({"txn_timestamp": F.lit("x"), "processed_at": F.lit("x")})
    row = storage.to_stored(d, q.now()).select(
        F.col("txn_timestamp").cast("string"), F.col("processed_at") == q.now(), "txn_month"
    ).first()
    assert tuple(row) == ("0001-01-01 00:00:00", True, "default")


def test_empty_rules_are_a_list(spark, sf_dir):
    d = sd.decided(spark, sf_dir).limit(1).withColumn("triggered_rules", F.lit(None).cast("array<string>"))
    assert storage.to_stored(d, q.now()).first()["triggered_rules"] == "[]"


def test_replay_of_the_quarantine(spark, sf_dir, table):
    failed = q.uuid_frames(spark, sf_dir).withColumn("reason", F.lit(frames.batch_failure_reason("timeout")))
    path = new_table_path(spark, "quarantine")
    frames.to_quarantine(failed, F.timestamp_millis("event_ms"), 3).write.parquet(path)
    decided = q.with_uuids(sd.decided(spark, sf_dir))
    storage.upsert(spark, table, storage.to_stored(decided.filter("event_type = 'purchase'"), q.now()), q.now())
    before = storage.read_table(spark, table).count()
    replay.replay(spark, path, table, q.now())
    good = decided.filter("event_id % 50 > 2 AND event_id % 41 <> 0 AND event_type <> 'purchase'").count()
    assert storage.read_table(spark, table).count() == before + good
    left = replay.open_quarantine(spark, path)
    reasons = {r[0]: r[1] for r in left.groupBy("dlq_failure_reason").count().collect()}
    assert reasons["constraint_violation: txn_id is not a uuid"] == decided.filter("event_id % 50 > 2 AND event_id % 41 = 0").count()
    assert sum(reasons.values()) == decided.filter("event_id % 50 <= 2 OR event_id % 41 = 0").count()
    assert [r[0] for r in left.select("dlq_retry_count").distinct().collect()] == ["4"]
    replay.replay(spark, path, table, q.now())  # nothing new passes
    assert storage.read_table(spark, table).count() == before + good
    assert [r[0] for r in replay.open_quarantine(spark, path).select("dlq_retry_count").distinct().collect()] == ["5"]
    assert spark.read.parquet(path).count() == failed.count()


def test_read_transactions(spark, sf_dir):
    path = new_table_path(spark, "transactions")
    sd.transactions(spark, sf_dir).write.parquet(path)
    assert readers.read_transactions(spark, path).count() == sd.transactions(spark, sf_dir).count()


def test_the_staged_copy_is_not_dealt_anew(spark, sf_dir, monkeypatch):
    dealt = []
    plain = storage.write_table
    monkeypatch.setattr(storage, "write_table", lambda rows, path, *a, **k: dealt.append(k.get("balanced", False)) or plain(rows, path, *a, **k))
    existing, incoming = q.upsert_sets(spark, sf_dir)
    path = new_table_path(spark, "table")
    storage.upsert(spark, path, existing, q.now())
    storage.upsert(spark, path, incoming, q.now())
    assert dealt == [False, True, False, True]
    got = storage.read_table(spark, path)
    assert got.count() == storage.merge_rows(existing, incoming, q.now()).count()
