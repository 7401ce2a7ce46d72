"""The snapshot table: commits, crashes, skipping, compaction."""

import os

import pytest
from pyspark.sql import functions as F

from tillwatch.operators import lookups, snapshots, storage
from tillwatch.plans import queries as q
from tillwatch.plans.stream_queries import Stopped, stop_at
from tillwatch.session import new_table_path


def content(df, *drop):
    return sorted(map(repr, df.select(sorted(c for c in df.columns if c not in drop)).collect()))


@pytest.fixture(scope="module")
def sets(spark, sf_dir):
    return tuple(rows.persist() for rows in q.upsert_sets(spark, sf_dir))


@pytest.fixture()
def table(spark):
    return new_table_path(spark, "snapshots")


def at(text):
    return F.lit(text).cast("timestamp")


def test_crash_before_publishing_changes_nothing(spark, sets, table):
    existing, incoming = sets
    snapshots.upsert(spark, table, existing, at("2024-02-01"))
    before = content(snapshots.read(spark, table))
    with pytest.raises(Stopped):
        snapshots.upsert(spark, table, incoming, q.now(), after=stop_at("staged"))
    assert snapshots.versions(spark, table) == [1]
    assert content(snapshots.read(spark, table)) == before
    snapshots.upsert(spark, table, incoming, q.now())
    assert content(snapshots.read(spark, table)) == content(storage.merge_rows(existing, incoming, q.now()))
    assert content(snapshots.read(spark, table, version=1)) == before


def test_a_crash_after_publishing_repeats_nothing(spark, sets, table):
    existing, incoming = sets
    snapshots.upsert(spark, table, existing, at("2024-02-01"), "job", 0)
    with pytest.raises(Stopped):
        snapshots.upsert(spark, table, incoming, q.now(), "job", 1, after=stop_at("published"))
    once = content(snapshots.read(spark, table))
    snapshots.upsert(spark, table, incoming, at("2030-01-01"), "job", 1)
    snapshots.upsert(spark, table, existing.limit(0), q.now(), "job", 2)  # an empty batch is remembered too
    assert snapshots.snapshot(spark, table)["batches"] == {"job": 2}
    assert content(snapshots.read(spark, table)) == once


def test_many_upserts_equal_one_after_the_other(spark, sets, table):
    """Every read equals rewriting the table, before, during and after compaction."""
    existing, incoming = sets
    parts = [existing, *[incoming.filter(F.pmod(F.xxhash64("txn_id"), F.lit(3)) <= n) for n in range(3)]]
    whole = None
    for n, part in enumerate(parts):
        stamp = at(f"2024-03-0{n + 1}")
        whole = storage.merge_rows(whole, part, stamp).persist()
        snapshots.upsert(spark, table, part, stamp, most_deltas=2)
        assert content(snapshots.read(spark, table)) == content(whole)
    kinds = [s["kind"] for s in snapshots.snapshot(spark, table)["segments"]]
    assert kinds == ["base"]  # the third upsert was over the limit


def test_an_upsert_writes_its_batch_only(spark, sf_dir, table):
    rows = q.month_rows(spark, sf_dir)
    snapshots.upsert(spark, table, rows, q.now())
    one = rows.filter("txn_month = '2025-07'").limit(3)
    snapshots.upsert(spark, table, one, q.now())
    first, second = snapshots.snapshot(spark, table)["segments"]
    assert second["months"] == ["2025-07"]
    assert snapshots.stats_of(spark, table, [second["id"]]).agg(F.sum("n_rows")).first()[0] == 3
    assert snapshots.compact(spark, table)
    base, rest = snapshots.snapshot(spark, table)["segments"]
    assert base["months"] == ["2025-07"] and rest["id"] == first["id"] and "2025-07" not in rest["months"]
    assert content(snapshots.read(spark, table), "updated_at") == content(rows, "updated_at")


def test_two_writers(spark, sets, table, monkeypatch):
    """A writer that finds its version taken publishes as the next one; a compaction keeps what came meanwhile."""
    existing, incoming = sets
    snapshots.upsert(spark, table, existing, at("2024-02-01"))
    snapshots.upsert(spark, table, incoming.filter("risk_score < 400"), q.now())
    plain = snapshots.publish

    def late(spark, table, change):
        monkeypatch.setattr(snapshots, "publish", plain)
        snapshots.upsert(spark, table, incoming.filter("risk_score >= 400"), q.now())
        return plain(spark, table, change)

    monkeypatch.setattr(snapshots, "publish", late)
    assert snapshots.compact(spark, table)
    one = storage.merge_rows(existing, incoming.filter("risk_score < 400"), q.now())
    both = storage.merge_rows(one, incoming.filter("risk_score >= 400"), q.now())
    assert content(snapshots.read(spark, table)) == content(both)
    manifest = snapshots.snapshot(spark, table)
    assert not snapshots._create(spark, table, manifest)


@pytest.fixture()
def sixteen_files(spark):
    """Tables of this size in sixteen files."""
    keys = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_lookups_open_matching_files_only(spark, sf_dir, table, sixteen_files):
    rows = q.stored_rows(spark, sf_dir)
    snapshots.upsert(spark, table, rows, q.now())
    card, rrn = rows.select("card_hash", "rrn").first()
    found = snapshots.lookup(spark, table, "card_hash", card)
    segment = snapshots.snapshot(spark, table)["segments"][0]
    assert snapshots.stats_of(spark, table, [segment["id"]]).count() == 16
    assert 0 < len(found.inputFiles()) <= 3
    assert content(found) == content(rows.filter(F.col("card_hash") == card))
    assert "PushedFilters: [IsNotNull(card_hash), EqualTo(card_hash" in found._jdf.queryExecution().executedPlan().toString()
    assert snapshots.lookup(spark, table, "rrn", rrn).count() == rows.filter(F.col("rrn") == rrn).count()
    assert snapshots.lookup(spark, table, "rrn", "none").count() == 0


def test_ranges_open_matching_files_only(spark, sf_dir, table):
    rows = q.month_rows(spark, sf_dir)
    snapshots.upsert(spark, table, rows, q.now())
    span = ("2025-03-10 00:00:00", "2025-03-20 00:00:00")
    ranged = snapshots.date_range(spark, table, *span)
    assert len(ranged.inputFiles()) < len(snapshots.read(spark, table).inputFiles()) / 5
    assert content(ranged) == content(lookups.date_range(rows, *span))


def test_keys_are_read_from_the_months_of_the_rows_only(spark, sf_dir, table):
    rows = q.month_rows(spark, sf_dir)
    held = F.pmod(F.xxhash64("txn_id"), F.lit(3)) > 0
    snapshots.upsert(spark, table, rows.filter(held & (F.col("amount_minor") % 2 == 0)), q.now())
    snapshots.upsert(spark, table, rows.filter(held & (F.col("amount_minor") % 2 == 1)), q.now())
    month = rows.filter(~held).first()["txn_month"]
    asked = rows.filter(F.col("txn_month") == month)
    asked = asked.unionByName(asked.limit(1).withColumn("txn_id", F.lit(None).cast("string")))
    keys = snapshots.stored_keys(spark, table, [month])
    assert keys.columns == storage.KEY and keys.inputFiles()
    assert all(f"txn_month={month}/" in f for f in keys.inputFiles())
    assert len(keys.inputFiles()) < len(snapshots.stored_keys(spark, table).inputFiles())
    expected = content(asked.join(rows.filter(held), storage.KEY, "left_anti"))
    assert content(snapshots.unstored(spark, table, asked)) == expected
    snapshots.compact(spark, table)
    assert content(snapshots.unstored(spark, table, asked)) == expected
    assert snapshots.unstored(spark, table, asked.limit(0)).count() == 0
    assert content(snapshots.unstored(spark, f"{table}-none", asked)) == content(asked)


def test_bloom_filters_are_in_the_files(spark, sf_dir, table):
    """A filter sized for BLOOM_VALUES is far larger than the few rows of a month; a column that repeats few values
    has a dictionary instead, which rules out row groups as well."""
    snapshots.upsert(spark, table, q.month_rows(spark, sf_dir), q.now())
    segment = snapshots.snapshot(spark, table)["segments"][0]["id"]
    files = [r["file"].removeprefix("file:") for r in snapshots.stats_of(spark, table, [segment]).collect()]
    assert min(os.path.getsize(f) for f in files) > snapshots.BLOOM_VALUES


def test_a_lookup_follows_the_first_description(spark, sets, table):
    """An upsert naming another card neither moves a row to it nor hides its new decision."""
    existing, _ = sets
    row = existing.orderBy("txn_id").limit(1).persist()
    card = row.first()["card_hash"]
    other = row.withColumns({"card_hash": F.lit("zz"), "risk_score": F.lit(999)})
    snapshots.upsert(spark, table, existing, at("2024-02-01"))
    snapshots.upsert(spark, table, other, q.now())
    assert snapshots.lookup(spark, table, "card_hash", "zz").count() == 0
    mine = snapshots.lookup(spark, table, "card_hash", card)
    assert content(mine) == content(snapshots.read(spark, table).filter(F.col("card_hash") == card))
    assert mine.filter("risk_score = 999").count() == 1


def test_vacuum_keeps_what_is_named(spark, sets, table):
    existing, incoming = sets
    snapshots.upsert(spark, table, existing, at("2024-02-01"))
    snapshots.upsert(spark, table, incoming, q.now())
    snapshots.compact(spark, table)
    whole = content(snapshots.read(spark, table))
    assert snapshots.vacuum(spark, table, keep=1, staged_before_ms=0) == 0  # too young to be given up
    assert snapshots.vacuum(spark, table, keep=1, staged_before_ms=2**62) == 2
    assert snapshots.versions(spark, table) == [3]
    assert content(snapshots.read(spark, table)) == whole


def test_no_table(spark, table):
    assert snapshots.read(spark, table).count() == 0
    assert snapshots.lookup(spark, table, "rrn", "x").count() == 0
    assert snapshots.date_range(spark, table, "2024-01-01", "2025-01-01").count() == 0
    assert snapshots.compact(spark, table)


def test_reads_move_the_base_once(spark, sets, table):
    """An upsert is merged by one join with the base, not by grouping both; keys without a time stay as they are."""
    existing, incoming = sets
    nameless = existing.limit(2).withColumn("txn_timestamp", F.lit(None).cast("timestamp")).withColumn("txn_month", storage.month_of(F.lit(None).cast("timestamp")))
    snapshots.upsert(spark, table, existing.unionByName(nameless), at("2024-02-01"))
    snapshots.upsert(spark, table, incoming, q.now())
    got = snapshots.read(spark, table)
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    expected = storage.merge_rows(existing, incoming, q.now()).unionByName(
        storage.merge_rows(None, nameless, at("2024-02-01")).select(*existing.columns), allowMissingColumns=True
    )
    assert content(got) == content(expected.select(got.columns))


def test_date_range_merges_by_join(spark, sets, table):
    existing, incoming = sets
    snapshots.upsert(spark, table, existing, at("2024-02-01"))
    snapshots.upsert(spark, table, incoming, q.now())
    got = snapshots.date_range(spark, table, "2024-01-10 00:00:00", "2024-01-20 00:00:00")
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    inside = (F.col("txn_timestamp") >= at("2024-01-10")) & (F.col("txn_timestamp") < at("2024-01-20"))
    assert content(got) == content(storage.merge_rows(existing, incoming, q.now()).filter(inside).select(got.columns))


@pytest.mark.parametrize("most", [0, 500_000])
def test_only_repeated_keys_of_a_batch_are_merged(spark, sets, table, monkeypatch, most):
    staged = []
    plain = snapshots.stage
    monkeypatch.setattr(snapshots, "MOST_REPEATED", most)
    monkeypatch.setattr(snapshots, "stage", lambda spark, table, rows: staged.append(rows) or plain(spark, table, rows))
    rows = sets[0].withColumn("batch_seq", F.lit(1).cast("long"))
    once = storage.merge_rows(None, rows, q.now()).withColumn("batch_seq", F.lit(1).cast("long")).localCheckpoint()
    snapshots.upsert(spark, table, once, q.now())
    assert "Aggregate" not in staged[0]._jdf.queryExecution().optimizedPlan().toString()
    nameless = once.limit(1).withColumn("txn_id", F.lit(None).cast("string"))
    again = once.limit(3).withColumn("risk_score", F.lit(7)).withColumn("batch_seq", F.lit(2).cast("long"))
    batch = once.unionByName(again).unionByName(nameless).unionByName(nameless).localCheckpoint()
    other = new_table_path(spark, "snapshots")
    snapshots.upsert(spark, other, batch, q.now())
    expected = storage.merge_rows(None, batch, q.now())
    assert content(snapshots.read(spark, other)) == content(expected.select(snapshots.read(spark, other).columns))
