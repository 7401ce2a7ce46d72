"""Streams give what the batch operators give."""

import random

import pytest
from pyspark.sql import functions as F

from tillwatch.functions import columns as C
from tillwatch.functions import fixed_values as fv
from tillwatch.operators import dedup, reports, sessions, storage, velocity
from tillwatch.plans import queries as q
from tillwatch.plans import scoring_flow as flow
from tillwatch.plans.stream_queries import in_order
from tillwatch.schemas import RAW_FRAMES
from tillwatch.session import new_table_path
from tillwatch.sources import frames, readers, sinks
from tillwatch.sources import sample_data as sd
from tillwatch.streaming import aggregates, persist
from tillwatch.streaming import velocity as sv
from tillwatch.streaming.idempotency import IdempotencyJob


def arrive(spark, df, order, parts, name):
    """Write ``df`` as ``parts`` files in order of ``order``; each is one micro-batch."""
    path = new_table_path(spark, name)
    cuts = df.stat.approxQuantile(order, [i / parts for i in range(1, parts)], 0.0)
    lower = None
    for cut in cuts + [None]:
        part = df
        if lower is not None:
            part = part.filter(F.col(order) > lower)
        if cut is not None:
            part = part.filter(F.col(order) <= cut)
        part.coalesce(1).write.mode("append").parquet(path)
        lower = cut
    return path


def follow(spark, path, schema):
    return readers.stream_files(spark, path, schema, files_per_trigger=1)


def run_to_memory(spark, stream, name, mode="append"):
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", new_table_path(spark, "cp")).trigger(availableNow=True).start()
    )
    if not query.awaitTermination(240):
        query.stop()
        raise AssertionError(f"{name} did not finish")
    return spark.table(name)


@pytest.fixture(scope="module")
def txns(spark, sf_dir):
    df = q.vms_transactions(spark, sf_dir).withColumn("clock", F.timestamp_millis("ms")).drop("ts")
    return arrive(spark, df, "ms", 4, "txns"), df


def batch_velocity(df):
    cols = ["txn_id", *velocity.VELOCITY_COLUMNS]
    return sorted(map(tuple, velocity.with_velocity(df).select(cols).collect()))


def test_a_micro_batch_arrives_as_files_of_all_tasks(spark):
    rows = spark.range(0, 900, 1, 4).withColumnRenamed("id", "ms")
    seen = {}

    def job(batch, batch_id):
        files = batch.select(F.input_file_name().alias("f")).distinct().count()
        seen[batch_id] = (files, *batch.agg(F.count("*"), F.min("ms"), F.max("ms")).first())

    def start(stream, checkpoint):
        return stream.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    in_order(spark, rows.repartition(4), "ms", "numbers", start)
    assert [seen[n][1:] for n in range(3)] == [(300, 0, 299), (300, 300, 599), (300, 600, 899)]
    assert all(seen[n][0] > 1 for n in range(3))


def test_velocity_job_equals_batch(spark, sf_dir, txns):
    path, df = txns
    folder, checkpoint = new_table_path(spark, "velocity"), new_table_path(spark, "cp")
    job = sv.VelocityJob(folder, sv.scorer(sd.merchants(spark, sf_dir), q.now()))
    job.start(follow(spark, path, df.schema), checkpoint, availableNow=True).awaitTermination(600)
    out = spark.read.parquet(f"{folder}/results")
    assert out.select("batch_id").distinct().count() == 4
    assert sorted(map(tuple, out.select("txn_id", *velocity.VELOCITY_COLUMNS).collect())) == batch_velocity(df)
    want = q.scored(spark, sf_dir).select("txn_id", "risk_score", "decision")
    assert sorted(map(tuple, out.select("txn_id", "risk_score", "decision").collect())) == sorted(map(tuple, want.collect()))
    # a restart finds nothing new; replaying the last batch changes nothing
    job.start(follow(spark, path, df.schema), checkpoint, availableNow=True).awaitTermination(600)
    job(spark.read.schema(df.schema).parquet(path).join(out.filter("batch_id = 3").select("txn_id"), "txn_id", "left_semi"), 3)
    again = spark.read.parquet(f"{folder}/results")
    assert sorted(map(tuple, again.select("txn_id", *velocity.VELOCITY_COLUMNS).collect())) == batch_velocity(df)


def test_late_rows_are_set_aside(spark):
    folder = new_table_path(spark, "late")
    t = 1_700_000_000_000
    schema = "txn_id string, card_hash string, ms long, amount_minor long, merchant_id string, terminal_id string"
    job = sv.VelocityJob(folder)
    job(spark.createDataFrame([("a", "c", t, 1, "m", "p"), ("b", "c", t + 1000, 2, "m", "p")], schema), 0)
    job(
        spark.createDataFrame(
            [("late", "c", t - fv.HOUR_MS, 4, "m", "p"), ("old", "c", t - 5000, 8, "m", "p"), ("new", "c", t + 2000, 16, "m", "p")],
            schema,
        ),
        1,
    )
    out = {r["txn_id"]: (r["txn_count_1min"], r["amount_sum_1min"]) for r in spark.read.parquet(f"{folder}/results").collect()}
    assert out == {"a": (1, 1), "b": (2, 3), "old": (1, 8), "new": (4, 27)}
    late = spark.read.parquet(f"{folder}/late")
    assert [r["txn_id"] for r in late.collect()] == ["late"]
    assert [tuple(r) for r in sv.late_counts(late).collect()] == [(1, 1)]


def test_rows_out_of_order_see_everything_in_reach(spark):
    """Minutes 0, 30, 40, then 120, then 65: the last is within the hour of lateness and counts 30, 40 and itself."""
    folder, t = new_table_path(spark, "order"), 1_700_000_000_000
    schema = "txn_id string, card_hash string, ms long, amount_minor long, merchant_id string, terminal_id string"
    job = sv.VelocityJob(folder)
    for n, minutes in enumerate([(0, 30, 40), (120,), (65,)]):
        job(spark.createDataFrame([(f"t{m}", "c", t + m * 60_000, 1, "m", "p") for m in minutes], schema), n)
    got = {r["txn_id"]: r["txn_count_1hr"] for r in spark.read.parquet(f"{folder}/results").collect()}
    assert got == {"t0": 1, "t30": 2, "t40": 3, "t120": 1, "t65": 3}


def test_stateless_scoring_equals_batch(spark, sf_dir, txns):
    path, df = txns
    cols = ["txn_id", "risk_score", "decision"]
    stream = flow.score_rows(follow(spark, path, df.schema), sd.merchants(spark, sf_dir), q.now())
    got = run_to_memory(spark, stream.select(*cols, C.transaction_type_label(F.col("transaction_type")).alias("t")), "stateless")
    want = flow.score_rows(df, sd.merchants(spark, sf_dir), q.now())
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_idempotency_job_equals_batch_on_ordered_arrival(spark):
    rnd = random.Random(5)
    start = 1_700_000_000_000
    rows = [
        ("busy" if rnd.random() < 0.6 else f"k{rnd.randrange(6)}", start + rnd.randrange(5 * 864) * 100_000, f"t{i:04d}")
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, "idempotency_key string, ms long, txn_id string")
    path = arrive(spark, df, "ms", 3, "requests")
    folder, checkpoint = new_table_path(spark, "idempotency"), new_table_path(spark, "cp")
    job = IdempotencyJob(folder)
    job.start(follow(spark, path, df.schema), checkpoint, availableNow=True).awaitTermination(300)
    cols = ["txn_id", "original_txn_id", "is_duplicate"]
    want = sorted(map(tuple, dedup.with_original(df).select(cols).collect()))
    out = spark.read.parquet(f"{folder}/requests")
    assert sorted(map(tuple, out.select(cols).collect())) == want
    last = [r["txn_id"] for r in out.filter("batch_id = 2").select("txn_id").collect()]
    job(df.filter(F.col("txn_id").isin(last)), 2)  # a replay changes nothing
    assert sorted(map(tuple, spark.read.parquet(f"{folder}/requests").select(cols).collect())) == want


def plain_policy(batches):
    """The written policy, request by request."""
    known, out = {}, {}
    for batch in batches:
        fresh = {}
        for key, ms, txn in batch:
            near = [(o > ms, abs(ms - o), i) for o, i in known.get(key, {}).items() if abs(ms - o) < fv.DAY_MS]
            if near:
                out[txn] = (min(near)[2], True)
            else:
                fresh.setdefault(key, []).append((ms, txn))
        for key, rows in fresh.items():
            origin = None
            for ms, txn in sorted(rows):
                if origin is None or ms - origin[0] >= fv.DAY_MS:
                    origin = (ms, txn)
                    known.setdefault(key, {})[ms] = txn
                out[txn] = (origin[1], txn != origin[1])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_idempotency_job_follows_the_policy_out_of_order(spark, seed):
    rnd = random.Random(seed)
    start = 1_700_000_000_000
    rows = [(f"k{min(rnd.randrange(5), 2)}", start + rnd.randrange(10 * 864) * 100_000, f"t{i:04d}") for i in range(80)]
    batches = [rows[i::4] for i in range(4)]
    folder = new_table_path(spark, "idempotency")
    job = IdempotencyJob(folder)
    for n, batch in enumerate(batches):
        job(spark.createDataFrame(batch, "idempotency_key string, ms long, txn_id string"), n)
    got = spark.read.parquet(f"{folder}/requests").collect()
    assert {r["txn_id"]: (r["original_txn_id"], r["is_duplicate"]) for r in got} == plain_policy(batches)


def test_request_days_before_an_original_is_its_own(spark):
    folder, t = new_table_path(spark, "idempotency"), 1_700_000_000_000
    schema = "idempotency_key string, ms long, txn_id string"
    job = IdempotencyJob(folder)
    job(spark.createDataFrame([("k", t + 10 * fv.DAY_MS, "a")], schema), 0)
    job(spark.createDataFrame([("k", t + 5 * fv.DAY_MS, "b")], schema), 1)
    got = {r["txn_id"]: r["is_duplicate"] for r in spark.read.parquet(f"{folder}/requests").collect()}
    assert got == {"a": False, "b": False}


def test_late_request_repeats_the_known_original(spark):
    folder, t = new_table_path(spark, "idempotency"), 1_700_000_000_000
    schema = "idempotency_key string, ms long, txn_id string"
    job = IdempotencyJob(folder)
    job(spark.createDataFrame([("k", t, "b")], schema), 0)
    job(spark.createDataFrame([("k", t - 5, "a"), ("k", t + fv.DAY_MS - 1, "c"), ("k", t + fv.DAY_MS, "d")], schema), 1)
    got = {r["txn_id"]: r["original_txn_id"] for r in spark.read.parquet(f"{folder}/requests").collect()}
    assert got == {"a": "b", "b": "b", "c": "b", "d": "d"}


def test_bucket_stream_equals_batch(spark, txns):
    path, df = txns
    got = run_to_memory(spark, aggregates.bucket_distinct(follow(spark, path, df.schema), "clock"), "buckets", "complete")
    want = velocity.bucket_distinct_approx(df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))


def test_decisions_per_minute(spark, sf_dir):
    df = q.scored(spark, sf_dir).select("txn_id", "decision", F.timestamp_millis("vms").alias("clock"), "vms")
    path = arrive(spark, df, "vms", 3, "decisions")
    schema = spark.read.parquet(path).schema
    stream = aggregates.decisions_per_minute(follow(spark, path, schema), "clock")
    got = run_to_memory(spark, stream, "decisions", "complete")
    want = reports.decision_counts(df)
    sums = {r["decision"]: r["n"] for r in got.groupBy("decision").agg(F.sum("transactions").alias("n")).collect()}
    assert sums == {r["decision"]: r["transactions"] for r in want.collect()}
    minutes = reports.throughput(df, F.col("clock"))
    per_minute = {r["minute_ms"]: r["n"] for r in got.groupBy("minute_ms").agg(F.sum("transactions").alias("n")).collect()}
    assert per_minute == {r["window_start_ms"]: r["n_rows"] for r in minutes.collect()}


def test_session_stream_equals_batch(spark, sf_dir):
    df = sd.failures(spark, sf_dir).withColumn("clock", F.timestamp_millis("ms"))
    last = spark.createDataFrame([(-1, 1_800_000_000_000)], "dependency long, ms long").withColumn("clock", F.timestamp_millis("ms"))
    path = arrive(spark, df.unionByName(last), "ms", 3, "failures")
    stream = aggregates.failure_sessions(follow(spark, path, spark.read.parquet(path).schema), "clock")
    got = run_to_memory(spark, stream, "failure_sessions").filter("dependency >= 0")
    cols = ["dependency", "start_ms", "end_ms", "failures", "is_episode"]
    want = sessions.failure_sessions(sd.failures(spark, sf_dir))
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def result_frames(spark, sf_dir):
    """Frames whose ids are UUIDs, one in 41 excepted."""
    d = sd.decided(spark, sf_dir)
    d = d.withColumn("txn_id", F.when(F.expr("event_id % 41 = 0"), F.col("txn_id")).otherwise(C.txn_id_for(F.col("txn_id"), F.col("event_ms"))))
    events = flow.fraud_result_events(d, F.col("processed_at"))
    framed = frames.frame(F.to_json(F.struct(*events.columns)), 7)
    value = F.when(F.expr("offset % 50 = 0"), F.lit(b"\1\2")).otherwise(framed)
    return events.withColumn("offset", F.col("rrn").cast("long")).select(
        F.lit(0).alias("partition"), "offset", F.col("card_hash").alias("key"), value.alias("value")
    )


def test_persist_job(spark, sf_dir):
    source = result_frames(spark, sf_dir)
    path = arrive(spark, source, "offset", 3, "frames")
    folder, table = (new_table_path(spark, n) for n in ("job", "table"))
    checkpoint = new_table_path(spark, "cp")
    job = persist.PersistJob(folder, persist.month_writer(table, q.now()), q.now())
    for _ in range(2):  # the second run resumes and finds nothing to do
        job.start(follow(spark, path, RAW_FRAMES), checkpoint, availableNow=True).awaitTermination(600)
    job(source.filter("offset < 10"), 0)  # a finished batch again: skipped
    n = source.count()
    framed_badly = source.filter("offset % 50 = 0").count()
    no_uuid = source.filter("offset % 50 <> 0 AND offset % 41 = 0").count()
    stored = storage.read_table(spark, table)
    assert stored.count() == stored.select("txn_id").distinct().count() == n - framed_badly - no_uuid
    quarantine = spark.read.parquet(f"{folder}/quarantine")
    reasons = {r[0]: r[1] for r in quarantine.groupBy("dlq_failure_reason").count().collect()}
    assert reasons == {
        "message too short (2 bytes)": framed_badly,
        "constraint_violation: txn_id is not a uuid": no_uuid,
    }
    outcomes = {r["status"]: r["units"] for r in reports.write_outcomes(spark.read.parquet(f"{folder}/audit")).collect()}
    assert outcomes == {"success": n - framed_badly - no_uuid, "retry": 0, "dlq": framed_badly + no_uuid}


def test_failed_batch_goes_to_quarantine(spark, sf_dir):
    calls, waits = [], []

    def broken(rows, batch_id):
        calls.append(batch_id)
        raise OSError("disk full")

    folder = new_table_path(spark, "job")
    source = result_frames(spark, sf_dir).filter("offset < 60")
    persist.PersistJob(folder, broken, q.now(), sleep=waits.append)(source, 5)
    assert calls == [5, 5, 5] and waits == [5.0, 10.0]
    quarantine = spark.read.parquet(f"{folder}/quarantine")
    found = {(r["dlq_failure_reason"], r["dlq_retry_count"]): r["count"] for r in quarantine.groupBy("dlq_failure_reason", "dlq_retry_count").count().collect()}
    framed_badly = source.filter("offset % 50 = 0").count()
    no_uuid = source.filter("offset % 50 <> 0 AND offset % 41 = 0").count()
    assert found == {
        ("message too short (2 bytes)", "0"): framed_badly,
        ("constraint_violation: txn_id is not a uuid", "0"): no_uuid,
        ("db_error after 3 attempts: OSError", "3"): source.count() - framed_badly - no_uuid,
    }


def test_retry_waits_grow_and_stop():
    waits, tries = [], []

    def third_time(error):
        tries.append(1)
        if len(tries) < 3:
            raise error

    assert persist.with_retry(lambda: third_time(OSError()), sleep=waits.append) == (3, None) and waits == [5.0, 10.0]
    tries.clear()
    tried, error = persist.with_retry(lambda: third_time(ValueError()), sleep=waits.append)
    assert tried == 1 and isinstance(error, ValueError) and len(waits) == 2
    tried, error = persist.with_retry(lambda: third_time(OSError()) or third_time(OSError()), attempts=1, sleep=waits.append)
    assert (tried, error) == (1, None) or isinstance(error, OSError)


def test_from_request_to_table(spark, sf_dir):
    """Submit, score, publish, follow the records as a stream, store; then compare with the direct way."""
    accepted = flow.submit(sd.requests(spark, sf_dir), sd.SECRET)
    scored = flow.score_transactions(accepted, sd.merchants(spark, sf_dir), q.now())
    events = flow.fraud_result_events(scored, C.format_ts(q.now()))
    assert "pan" not in events.columns
    path, table = new_table_path(spark, "topic"), new_table_path(spark, "table")
    records = frames.publish(events, schema_id=7).withColumns(
        {"partition": F.lit(0), "offset": F.monotonically_increasing_id()}
    )
    sinks.append_records(records.select("partition", "offset", "key", "value"), path)
    job = persist.PersistJob(new_table_path(spark, "job"), persist.month_writer(table, q.now()), q.now())
    job.start(
        readers.stream_files(spark, path, RAW_FRAMES), new_table_path(spark, "cp"), availableNow=True
    ).awaitTermination(300)
    cols = ["txn_id", "card_hash", "masked_pan", "status", "risk_score", "triggered_rules", "txn_month"]
    direct = storage.to_stored(events, q.now()).select(cols)
    stored = storage.read_table(spark, table).select(cols)
    assert stored.count() > 0
    assert sorted(map(repr, stored.collect())) == sorted(map(repr, direct.collect()))


def test_records_stream_to_files(spark, sf_dir):
    events = flow.fraud_result_events(sd.decided(spark, sf_dir), F.col("processed_at"))
    source, target = new_table_path(spark, "events"), new_table_path(spark, "records")
    events.write.parquet(source)
    stream = frames.publish(readers.stream_files(spark, source, events.schema))
    sinks.stream_records(stream, target, new_table_path(spark, "cp"), availableNow=True).awaitTermination(300)
    want = frames.publish(events)
    assert sorted(map(tuple, spark.read.parquet(target).collect())) == sorted(map(tuple, want.collect()))


def test_a_batch_is_decoded_once(spark, sf_dir, monkeypatch):
    """Writing, counting and quarantining read the decoded rows; only a failed write decodes again."""
    seen = spark.sparkContext.accumulator(0)

    def counted(triaged, schema):
        touch = F.udf(lambda payload: seen.add(1) or payload, "binary")
        return frames.decode(triaged.withColumn("payload", touch("payload")), schema)

    monkeypatch.setattr(persist, "decode", counted)
    source = q.uuid_frames(spark, sf_dir).select([f.name for f in RAW_FRAMES.fields]).limit(200).localCheckpoint()
    for write, times in ((persist.snapshot_writer(new_table_path(spark, "table"), q.now()), 1), (lambda rows, batch_id: 1 / 0, 2)):
        seen.value = 0
        folder = new_table_path(spark, "job")
        persist.PersistJob(folder, write, q.now(), attempts=1)(source, 0)
        assert 200 <= seen.value <= 200 * times
        quarantine = spark.read.parquet(f"{folder}/quarantine")
        audit = {r["status"]: r["units"] for r in spark.read.parquet(f"{folder}/audit").collect()}
        assert quarantine.count() == audit["dlq"] == 200 - audit["success"]
        frame = ["dlq_original_offset", "key", "value"]
        whole = source.select(F.col("offset").cast("string"), F.col("key").cast("binary"), "value")
        assert {tuple(map(bytes, r[1:])) for r in quarantine.select(frame).collect()} <= {tuple(map(bytes, r[1:])) for r in whole.collect()}
    assert audit["success"] == 0


def test_a_batch_is_dealt_to_all_tasks(spark, sf_dir):
    """A batch that lies in one part is decoded by as many tasks as there are cores."""
    tasks = []
    source = q.uuid_frames(spark, sf_dir).select([f.name for f in RAW_FRAMES.fields]).coalesce(1)
    write = lambda rows, batch_id: tasks.extend(r[0] for r in rows.select(F.spark_partition_id()).distinct().collect())
    persist.PersistJob(new_table_path(spark, "job"), write, q.now())(source, 0)
    assert len(tasks) >= spark.sparkContext.defaultParallelism
