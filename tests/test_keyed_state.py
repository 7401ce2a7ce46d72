"""Late arrivals, pane state and session state on streams."""

import random

import pytest
from pyspark.sql import functions as F

from tillwatch.functions import fixed_values as fv
from tillwatch.operators import sessions as batch_sessions
from tillwatch.operators.velocity import VELOCITY_COLUMNS, velocity_by_ms, with_velocity
from tillwatch.plans.catalog import QUERIES
from tillwatch.session import new_table_path
from tillwatch.sources import readers
from tillwatch.streaming import panes, sessions
from tillwatch.streaming import velocity as sv

SCHEMA = "event_id long, txn_id string, card_hash string, ms long, amount_minor long, merchant_id string, terminal_id string"
START = 1_700_000_100_000


@pytest.fixture(scope="module")
def rows():
    """Three hours with a third of the rows on one card; equal times, and times at the edges of panes."""
    draw = random.Random(4)
    out = []
    for n in range(900):
        card = "hot" if n % 3 == 0 else f"c{draw.randint(0, 8)}"
        ms = START + draw.choice([draw.randrange(3 * fv.HOUR_MS), draw.randrange(36) * fv.FIVE_MINUTES_MS])
        out.append((n, f"t{n:04d}", card, ms, draw.randint(0, 500), f"m{draw.randint(0, 5)}", f"e{draw.randint(0, 3)}"))
    return out


def fed(spark, parts, start, schema=SCHEMA):
    """Run ``start(stream, checkpoint)`` after each part has arrived; the last query."""
    path, checkpoint, query = new_table_path(spark, "in"), new_table_path(spark, "cp"), None
    for part in parts:
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(path)
        query = start(readers.stream_files(spark, path, spark.createDataFrame([], schema).schema), checkpoint)
        assert query.awaitTermination(200)
    return query


def velocities(df):
    return sorted(map(tuple, df.select("txn_id", *VELOCITY_COLUMNS).collect()))


def test_corrections_after_any_order_of_arrival(spark, rows):
    shuffled = random.Random(1).sample(rows, len(rows))
    job = sv.VelocityJob(new_table_path(spark, "velocity"), lateness_ms=10 * fv.HOUR_MS, corrections=True)
    fed(spark, [shuffled[:400], shuffled[400:450], shuffled[450:]], lambda s, cp: job.start(s, cp, availableNow=True))
    got = sv.corrected(spark, job.folder)
    assert velocities(got) == velocities(with_velocity(spark.createDataFrame(rows, SCHEMA)))
    plain = spark.read.parquet(f"{job.folder}/results")
    assert velocities(plain) != velocities(got)
    assert got.filter("version < batch_id").count() == 0 and got.filter("version > batch_id").count() > 0


def test_no_corrections_in_order(spark, rows):
    ordered = sorted(rows, key=lambda r: r[3])
    job = sv.VelocityJob(new_table_path(spark, "velocity"), corrections=True)
    early = [r for r in ordered if r[3] < START + fv.HOUR_MS]
    fed(spark, [early, ordered[len(early) :]], lambda s, cp: job.start(s, cp, availableNow=True))
    assert velocities(sv.corrected(spark, job.folder)) == velocities(with_velocity(spark.createDataFrame(rows, SCHEMA)))


def test_panes_equal_batch_and_leave_no_state(spark, rows):
    """Rows come in any order within the watermark; a row after its pane is given out as late."""
    shuffled = random.Random(2).sample(rows, len(rows))
    end = (10_000, "end", "end", START + 9 * fv.HOUR_MS, 0, "", "")
    late = (10_001, "late", "hot", START + 5, 1, "m0", "e0")
    out = new_table_path(spark, "out")
    progress = []

    def start(stream, checkpoint):
        result = panes.pane_velocity(stream.withColumn("clock", F.timestamp_millis("ms")), lateness="4 hours")
        query = result.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination(200)
        progress.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        return query

    fed(spark, [shuffled[:500], [*shuffled[500:], end], [late]], start)
    got = spark.read.schema(panes.RESULT).parquet(out)
    assert velocities(got.filter("card_hash <> 'end' AND NOT is_late")) == velocities(with_velocity(spark.createDataFrame(rows, SCHEMA)))
    assert [r["txn_id"] for r in got.filter("is_late").collect()] == ["late"]
    # the state of 300 rows of the hot card and all others is gone; the panes of the last row are left
    assert progress[0] > 500 and progress[1] < 60


def pane_results(spark, parts, lateness="4 hours"):
    """(what the pane stream gives out, rows of its state after each part)."""
    out, state = new_table_path(spark, "out"), []

    def start(stream, checkpoint):
        result = panes.pane_velocity(stream.withColumn("clock", F.timestamp_millis("ms")), lateness=lateness)
        query = result.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination(200)
        state.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        return query

    fed(spark, parts, start)
    return spark.read.schema(panes.RESULT).parquet(out).filter("NOT card_hash <=> 'end'"), state


def test_pane_state_does_not_grow_with_cards(spark):
    """State, and with it the calls to its store, follows groups and panes."""
    rows = [(n, f"t{n}", f"card{n % 3000}", START + n % 7 * 1000, n % 50, f"m{n % 3}", f"e{n % 2}") for n in range(6000)]
    end = (9000, "end", "end", START + 9 * fv.HOUR_MS, 0, "", "")
    got, state = pane_results(spark, [rows, [end]])
    assert velocities(got) == velocities(with_velocity(spark.createDataFrame(rows, SCHEMA)))
    assert state[0] < 3000


def test_panes_of_rows_with_nulls(spark):
    """Null cards are one card, a null amount is none, a null merchant is not counted; rows without a time have no window."""
    rows = [
        (1, "a", None, START, 5, "m0", "e0"), (2, "b", None, START + fv.FIVE_MINUTES_MS, None, None, "e1"),
        (3, "c", "c1", None, 5, "m0", "e0"), (4, "d", None, None, 5, "m0", "e0"), (5, "e", "c1", START, 7, None, None),
    ]
    end = (9000, "end", "end", START + 9 * fv.HOUR_MS, 0, "", "")
    got, _ = pane_results(spark, [rows, [end]])
    none = (0,) * 7
    assert velocities(got) == [
        ("a", 1, 1, 1, 5, 5, 1, 1), ("b", 1, 1, 2, 0, 5, 0, 1), ("c", *none), ("d", *none), ("e", 1, 1, 1, 7, 7, 0, 0),
    ]
    assert {r["txn_id"]: r["ms"] for r in got.collect()} == {r[1]: r[3] for r in rows}


def test_late_rows_enter_panes_still_open(spark):
    """A late row has zeros; a pane given out with its batch does not see it, one still open does."""
    minute, pane = fv.MINUTE_MS, fv.FIVE_MINUTES_MS
    begin = START // fv.HOUR_MS * fv.HOUR_MS
    parts = [
        [(1, "first", "c", begin + 2 * pane, 1, "m", "e"), (2, "clock", "x", begin + 3 * pane + minute, 1, "m", "e")],
        [(3, "late", "c", begin + pane, 10, "m", "e"), (4, "open", "c", begin + 4 * pane, 100, "m", "e")],
        [(5, "end", "end", begin + 9 * fv.HOUR_MS, 0, "", "")],
    ]
    got, _ = pane_results(spark, parts, lateness="0 seconds")
    found = {r["txn_id"]: (r["is_late"], r["txn_count_1hr"], r["amount_sum_1hr"]) for r in got.collect()}
    assert found == {"first": (False, 1, 1), "clock": (False, 1, 1), "late": (True, 0, 0), "open": (False, 3, 111)}


def test_sessions_open_as_in_batch(spark):
    draw = random.Random(6)
    rows = []
    for dependency in range(4):
        ms = START
        for _ in range(300 if dependency == 0 else 40):
            ms += draw.choice([0, 1, 500, 29_999, 30_000, 90_000] if dependency else [0, 200, 29_999])
            rows.append((dependency, ms))
    schema = "dependency long, ms long"
    out = new_table_path(spark, "out")

    def start(stream, checkpoint):
        result = sessions.failure_sessions(stream.withColumn("ts", F.timestamp_millis("ms")), delay="10 hours")
        return result.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    shuffled = draw.sample(rows, len(rows))
    fed(spark, [shuffled[:200], [*shuffled[200:], (-1, START + 40 * fv.HOUR_MS)]], start, schema)
    got = spark.read.schema(sessions.SESSION).parquet(out).filter("dependency >= 0")
    want = batch_sessions.failure_sessions(spark.createDataFrame(rows, schema))
    columns = ["dependency", "start_ms", "end_ms", "failures", "opened_ms", "is_episode"]
    assert sorted(map(repr, got.select(columns).collect())) == sorted(map(repr, want.select(columns).collect()))


def test_pieces_merge_in_any_order():
    draw = random.Random(8)
    times = sorted(draw.randrange(2000) for _ in range(60))
    whole = sessions.merged([(t, t, 1, [t]) for t in times], 30, 5)
    for _ in range(20):
        shuffled = draw.sample(times, len(times))
        cut = draw.randrange(60)
        parts = [sessions.merged([(t, t, 1, [t]) for t in part], 30, 5) for part in (shuffled[:cut], shuffled[cut:])]
        assert sessions.merged([*parts[1], *parts[0]], 30, 5) == whole


def test_keyed_state_in_a_session_of_another_store(spark, sf_dir):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        found = QUERIES["x08_stream_sessions"](spark, sf_dir)
        assert found.count() == QUERIES["a15_failure_sessions"](spark, sf_dir).count() > 0
    finally:
        spark.conf.set(key, before)


def test_corrections_take_one_computation(spark, rows, monkeypatch):
    """What a micro-batch corrects and what it reports come from one velocity table."""
    calls = []
    monkeypatch.setattr(sv, "velocity_by_ms", lambda *a, **k: calls.append(1) or velocity_by_ms(*a, **k))
    job = sv.VelocityJob(new_table_path(spark, "velocity"), lateness_ms=10 * fv.HOUR_MS, corrections=True)
    shuffled = random.Random(3).sample(rows, len(rows))
    for n, part in enumerate((shuffled[:300], shuffled[300:600], shuffled[600:])):
        job(spark.createDataFrame(part, SCHEMA), n)
    assert len(calls) == 3
    assert velocities(sv.corrected(spark, job.folder)) == velocities(with_velocity(spark.createDataFrame(rows, SCHEMA)))
