"""Streams and the stored table as queries: each runs its job over the given tables and reads what it wrote."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed_values as fv
from ..operators import lookups, reports, snapshots, storage
from ..schemas import RAW_FRAMES
from ..session import new_table_path
from ..sources import readers, replay
from ..sources import sample_data as sd
from ..streaming import aggregates, persist, sessions
from ..streaming.idempotency import IdempotencyJob
from ..streaming.panes import RESULT, pane_velocity
from ..streaming.velocity import VelocityJob, corrected
from . import oracles as o
from . import queries as q
from . import scoring_flow as flow
from .queries import ORACLES, now, query

BATCHES = 3


def in_order(spark: SparkSession, rows: DataFrame, order: str, name: str, start) -> None:
    """Run a job on ``rows`` by ``start(stream, checkpoint)``, micro-batch by micro-batch in order of ``order``: each is
    written by all tasks, shuffled within their files, and the job resumed from its checkpoint."""
    path, checkpoint = new_table_path(spark, name), new_table_path(spark, "cp")
    first, last = rows.agg(F.min(order), F.max(order)).first()
    parts = [rows]
    if first is not None:
        step = (last - first) // BATCHES + 1
        cuts = [first + n * step for n in range(BATCHES + 1)]
        parts = [rows.filter((F.col(order) >= low) & (F.col(order) < high)) for low, high in zip(cuts, cuts[1:])]
    for part in parts:
        part.sortWithinPartitions(F.xxhash64(order)).write.mode("append").parquet(path)
        finish(start(readers.stream_files(spark, path, rows.schema), checkpoint))


def finish(running) -> None:
    running.awaitTermination()
    if running.exception() is not None:
        raise running.exception()


def written_stream(spark: SparkSession, rows: DataFrame, order: str, name: str, plan, mode: str = "append") -> DataFrame:
    """``plan(stream)`` of ``rows`` arriving in order, run to its end into files; in complete mode the last result stays."""
    path, schemas = new_table_path(spark, "out"), []

    def start(stream, checkpoint):
        result = plan(stream)
        schemas.append(result.schema)
        writer = result.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        if mode == "append":
            return writer.format("parquet").option("path", path).start()
        return writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()

    in_order(spark, rows, order, name, start)
    return spark.read.schema(schemas[0]).parquet(path)


# --- velocity, idempotency, scoring ----------------------------------------------

_VELOCITY_COLUMNS = list(o.VELOCITY_SQL)


@query("x01_stream_velocity", f"WITH {o.VELOCITY} SELECT txn_id, {', '.join(_VELOCITY_COLUMNS)} FROM vel")
def x01(spark, sf):
    txns = q.vms_transactions(spark, sf).select("txn_id", "card_hash", "ms", "amount_minor", "merchant_id", "terminal_id")
    job = VelocityJob(new_table_path(spark, "velocity"))
    in_order(spark, txns, "ms", "txns", lambda stream, cp: job.start(stream, cp, availableNow=True))
    return spark.read.parquet(f"{job.folder}/results").select("txn_id", *_VELOCITY_COLUMNS)


#: Where a row arrives out of order: in which of the micro-batches, whatever its time.
_ARRIVAL = f"(event_id * 7919) % 1000 * {BATCHES} // 1000"


def out_of_order(spark: SparkSession, rows: DataFrame, start) -> None:
    """Run a job on ``rows`` (event_id, ...) by ``start(stream, checkpoint)``, micro-batch by micro-batch: each is written
    as files of several tasks, and the job resumed from its checkpoint."""
    path, checkpoint = new_table_path(spark, "arrivals"), new_table_path(spark, "cp")
    arrival = F.expr(f"cast((event_id * 7919) % 1000 * {BATCHES} div 1000 AS int)")
    for n in range(BATCHES):
        rows.filter(arrival == n).write.mode("append").parquet(path)
        finish(start(readers.stream_files(spark, path, rows.schema), checkpoint))


def velocity_rows(spark: SparkSession, sf: str) -> DataFrame:
    columns = ("event_id", "txn_id", "card_hash", "ms", "amount_minor", "merchant_id", "terminal_id")
    return q.vms_transactions(spark, sf).select(*columns)


@query("x10_late_corrections", ORACLES["x01_stream_velocity"])
def x10(spark, sf):
    job = VelocityJob(new_table_path(spark, "velocity"), corrections=True)
    out_of_order(spark, velocity_rows(spark, sf), lambda s, cp: job.start(s, cp, availableNow=True))
    return corrected(spark, job.folder).select("txn_id", *_VELOCITY_COLUMNS)


@query("x01_pane_velocity", ORACLES["x01_stream_velocity"])
def x01_panes(spark, sf):
    rows = velocity_rows(spark, sf)
    # a row long after the last one moves the watermark past every pane; it arrives last
    last = next(n for n in range(1000) if n * 7919 % 1000 == 999)
    end = rows.groupBy().agg(F.max("ms").alias("ms")).filter("ms IS NOT NULL").select(
        F.lit(last).cast("long").alias("event_id"), F.lit("end").alias("txn_id"), F.lit("end").alias("card_hash"),
        (F.col("ms") + 3 * fv.HOUR_MS).alias("ms"), F.lit(0).cast("long").alias("amount_minor"),
        F.lit("").alias("merchant_id"), F.lit("").alias("terminal_id"),
    )
    out = new_table_path(spark, "out")

    def start(stream, checkpoint):
        result = pane_velocity(stream.withColumn("clock", F.timestamp_millis("ms")))
        return (
            result.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )

    out_of_order(spark, rows.unionByName(end), start)
    return spark.read.schema(RESULT).parquet(out).filter("NOT card_hash <=> 'end'").select("txn_id", *_VELOCITY_COLUMNS)


_LATENESS = 300_000


@query(
    "x10_late_data",
    f"""WITH {o.TX}, arr AS (SELECT txn_id, vms, {_ARRIVAL} AS batch FROM tx)
    SELECT txn_id, batch::BIGINT AS batch_id FROM arr WHERE vms < (SELECT max(vms) FROM arr e WHERE e.batch < arr.batch) - {_LATENESS}""",
)
def x10_late(spark, sf):
    job = VelocityJob(new_table_path(spark, "velocity"), lateness_ms=_LATENESS)
    out_of_order(spark, velocity_rows(spark, sf), lambda s, cp: job.start(s, cp, availableNow=True))
    return spark.read.parquet(f"{job.folder}/late").select("txn_id", F.col("batch_id").cast("long").alias("batch_id"))


@query("x02_stream_dedup", q.ORACLES["w11_idempotency"])
def x02(spark, sf):
    requests = sd.requests(spark, sf).select("idempotency_key", "ms", "txn_id")
    job = IdempotencyJob(new_table_path(spark, "idempotency"))
    in_order(spark, requests, "ms", "requests", lambda stream, cp: job.start(stream, cp, availableNow=True))
    return spark.read.parquet(f"{job.folder}/requests").select("txn_id", "original_txn_id", "is_duplicate")


_UNSEEN = ", ".join(f"0 AS {c}" for c in _VELOCITY_COLUMNS)


@query(
    "x03_stream_score",
    "WITH "
    + o.SCORED.replace(o.VELOCITY, f"{o.TX}, vel AS MATERIALIZED (SELECT *, {_UNSEEN} FROM tx)")
    + " SELECT txn_id, risk_score, decision, triggered_rules FROM scored",
)
def x03(spark, sf):
    def plan(stream):
        scored = flow.score_rows(stream, sd.merchants(spark, sf), now())
        return scored.select("txn_id", "risk_score", "decision", "triggered_rules")

    out = written_stream(spark, sd.transactions(spark, sf), "vms", "txns", plan)
    return out.select("txn_id", "risk_score", "decision", q.text("triggered_rules"))


# --- persistence -----------------------------------------------------------------


def persisted(spark: SparkSession, sf: str) -> tuple[str, str]:
    """(table, folder of the job) after all framed results have arrived."""
    source = q.uuid_frames(spark, sf).select([f.name for f in RAW_FRAMES.fields])
    table, folder = new_table_path(spark, "table"), new_table_path(spark, "job")
    job = persist.PersistJob(folder, persist.month_writer(table, now()), now())
    in_order(spark, source, "offset", "frames", lambda stream, cp: job.start(stream, cp, availableNow=True))
    return table, folder


@query(
    "x04_stream_upsert",
    f"""WITH {o.FRAMES} SELECT {q.UUID_SQL} AS txn_id, txn_timestamp, risk_score,
    {o.case('decision', fv.STATUS_LABELS, 'UNKNOWN')} AS status FROM decoded WHERE reason IS NULL AND event_id % 41 <> 0""",
)
def x04(spark, sf):
    table, _ = persisted(spark, sf)
    return storage.read_table(spark, table).select(
        "txn_id", C.format_ts(F.col("txn_timestamp")).alias("txn_timestamp"), "risk_score", "status"
    )


@query(
    "x05_stream_quarantine",
    f"""WITH {o.FRAMES} SELECT event_id::VARCHAR AS dlq_original_offset,
    coalesce(reason, 'constraint_violation: txn_id is not a uuid') AS dlq_failure_reason, '0' AS dlq_retry_count
    FROM decoded WHERE reason IS NOT NULL OR event_id % 41 = 0""",
)
def x05(spark, sf):
    _, folder = persisted(spark, sf)
    return spark.read.parquet(f"{folder}/quarantine").select("dlq_original_offset", "dlq_failure_reason", "dlq_retry_count")


query(
    "a08_write_outcomes",
    f"""WITH {o.FRAMES} SELECT 'success' AS status, count(*) FILTER (reason IS NULL AND event_id % 41 <> 0) AS units FROM decoded
    UNION ALL SELECT 'retry', 0 UNION ALL SELECT 'dlq', count(*) FILTER (reason IS NOT NULL OR event_id % 41 = 0) FROM decoded""",
)(lambda spark, sf: reports.write_outcomes(spark.read.parquet(f"{persisted(spark, sf)[1]}/audit")))


class Stopped(RuntimeError):
    """Stands for a machine that is lost at this point."""


class Stops:
    """Stops a job after each of its steps once: a step in every batch, and one between staging and publishing."""

    def __init__(self) -> None:
        self.open = {("written", 0), ("quarantined", 1), ("audited", 2), ("staged", None), ("published", None)}

    def __call__(self, step: str, batch_id: int | None = None) -> None:
        if (step, batch_id) in self.open:
            self.open.remove((step, batch_id))
            raise Stopped(step)


def resumed(spark: SparkSession, sf: str) -> tuple[str, str]:
    """(table, folder of the job) after a run that was stopped after every step and resumed from its checkpoint."""
    source = q.uuid_frames(spark, sf).select([f.name for f in RAW_FRAMES.fields])
    table, folder = new_table_path(spark, "snapshots"), new_table_path(spark, "job")
    stops = Stops()

    def start(stream, checkpoint):
        while True:
            write = persist.snapshot_writer(table, now(), after=stops)
            job = persist.PersistJob(folder, write, now(), sleep=lambda seconds: None, after=stops)
            running = job.start(stream, checkpoint, availableNow=True)
            try:
                finish(running)
                return running
            except StreamingQueryException as error:
                if "Stopped" not in str(error):
                    raise

    in_order(spark, source, "offset", "frames", start)
    return table, folder


@query("x09_resume", ORACLES["x04_stream_upsert"])
def x09(spark, sf):
    table, _ = resumed(spark, sf)
    return snapshots.read(spark, table).select(
        "txn_id", C.format_ts(F.col("txn_timestamp")).alias("txn_timestamp"), "risk_score", "status"
    )


@query("x09_resume_quarantine", ORACLES["x05_stream_quarantine"])
def x09_quarantine(spark, sf):
    _, folder = resumed(spark, sf)
    return spark.read.parquet(f"{folder}/quarantine").select("dlq_original_offset", "dlq_failure_reason", "dlq_retry_count")


@query(
    "s10_replay_between_batches",
    f"""WITH {o.FRAMES}, cut AS (SELECT max(event_id) // 2 AS half FROM decoded)
    SELECT event_id::VARCHAR AS dlq_original_offset, coalesce(reason, 'constraint_violation: txn_id is not a uuid') AS dlq_failure_reason,
    CASE WHEN event_id <= half THEN '2' ELSE '1' END AS dlq_retry_count
    FROM decoded, cut WHERE reason IS NOT NULL OR event_id % 41 = 0""",
)
def s10_between(spark, sf):
    """A batch, a replay, another batch, another replay: every reject stays visible and counts its replays."""
    source = q.uuid_frames(spark, sf).select([f.name for f in RAW_FRAMES.fields])
    half = (source.agg(F.max("offset")).first()[0] or 0) // 2
    table, folder = new_table_path(spark, "snapshots"), new_table_path(spark, "job")
    job = persist.PersistJob(folder, persist.snapshot_writer(table, now()), now())
    for batch_id, part in enumerate((source.filter(F.col("offset") <= half), source.filter(F.col("offset") > half))):
        job(part, batch_id)
        replay.replay(spark, f"{folder}/quarantine", table, now(), replay.SnapshotStore())
    return replay.open_quarantine(spark, f"{folder}/quarantine").select(
        "dlq_original_offset", "dlq_failure_reason", "dlq_retry_count"
    )


# --- aggregates ------------------------------------------------------------------


@query(
    "x07_stream_metrics",
    f"""WITH {o.DECIDED} SELECT vms // 60000 * 60000 AS minute_ms, {o.case('decision', fv.DECISIONS, '')} AS decision,
    count(*) AS transactions, count(*) / 60 AS per_second FROM dec GROUP BY ALL""",
)
def x07(spark, sf):
    rows = sd.decided(spark, sf).select("decision", "vms", F.timestamp_millis("vms").alias("clock"))
    return written_stream(spark, rows, "vms", "decisions", lambda s: aggregates.decisions_per_minute(s, "clock"), "complete")


@query("x08_stream_sessions", ORACLES["a15_failure_sessions"])
def x08(spark, sf):
    failures = sd.failures(spark, sf).withColumn("clock", F.timestamp_millis("ms"))
    # a row an hour after the last one moves the watermark past every session
    end = failures.groupBy().agg(F.max("ms").alias("ms")).filter("ms IS NOT NULL").select(
        F.lit(-1).cast("long").alias("dependency"), (F.col("ms") + fv.HOUR_MS).alias("ms")
    )
    rows = failures.unionByName(end.withColumn("clock", F.timestamp_millis("ms")))
    found = written_stream(spark, rows, "ms", "failures", lambda s: sessions.failure_sessions(s, "clock"))
    return found.filter("dependency >= 0")


# --- the stored table ------------------------------------------------------------


def month_table(spark: SparkSession, sf: str) -> DataFrame:
    path = new_table_path(spark, "table")
    storage.write_table(q.month_rows(spark, sf), path)
    return storage.read_table(spark, path)


@query("s07_txn_table_write", q.ORACLES["s07_txn_table_write"])
def s07(spark, sf):
    return month_table(spark, sf).groupBy("txn_month").agg(
        F.count("*").alias("n_rows"), F.sum("amount_minor").alias("amount_minor")
    )


@query("s08_upsert_table", q.ORACLES["s08_upsert"])
def s08_table(spark, sf):
    path = new_table_path(spark, "table")
    existing, incoming = q.upsert_sets(spark, sf)
    storage.upsert(spark, path, existing, now())
    storage.upsert(spark, path, incoming, now())
    return q.merge_view(storage.read_table(spark, path))


def stop_at(wanted: str):
    """A step hook that stops at step ``wanted``."""

    def hook(step: str) -> None:
        if step == wanted:
            raise Stopped(step)

    return hook


def snapshot_table(spark: SparkSession, sf: str) -> str:
    """Two upserts; each is stopped between staging and publishing, and run again."""
    path = new_table_path(spark, "snapshots")
    for n, rows in enumerate(q.upsert_sets(spark, sf)):
        rows = storage.written(rows, f"batch-{n}")  # as it arrived: it is read by both runs
        written = F.lit("2024-02-01 00:00:00").cast("timestamp") if not snapshots.versions(spark, path) else now()
        for hook in (stop_at("staged"), stop_at("nowhere")):
            try:
                snapshots.upsert(spark, path, rows, written, after=hook)
            except Stopped:
                pass
    return path


@query("s08_snapshot_upsert", q.ORACLES["s08_upsert"])
def s08_snapshot(spark, sf):
    return q.merge_view(snapshots.read(spark, snapshot_table(spark, sf)))


@query("s08_snapshot_compacted", q.ORACLES["s08_upsert"])
def s08_compacted(spark, sf):
    path = snapshot_table(spark, sf)
    snapshots.compact(spark, path)
    return q.merge_view(snapshots.read(spark, path))


@query(
    "s08_snapshot_history",
    f"""WITH {q._MERGED} SELECT 1 AS version, count(*) AS n_rows, sum(risk_score) AS scores FROM writes WHERE seq < 0
    UNION ALL SELECT 2, count(*), sum(risk_score) FROM merged""",
)
def s08_history(spark, sf):
    path = snapshot_table(spark, sf)
    return storage.union_of([
        snapshots.read(spark, path, version).agg(
            F.lit(version).alias("version"), F.count("*").alias("n_rows"), F.sum("risk_score").alias("scores")
        )
        for version in (1, 2)
    ])


def looked_up(spark: SparkSession, sf: str) -> str:
    """The stored rows as a snapshot table, a part of them upserted again as they are."""
    path = new_table_path(spark, "snapshots")
    rows = storage.written(q.stored_rows(spark, sf), "batch")
    snapshots.upsert(spark, path, rows, now())
    snapshots.upsert(spark, path, rows.filter("risk_score % 3 = 0"), now())
    return path


@query("t02_card_history", q.ORACLES["t02_card_history"])
def t02(spark, sf):
    rows = snapshots.lookup(spark, looked_up(spark, sf), "card_hash", q.one_card())
    return lookups.card_history(rows, q.one_card(), 20).select(
        "txn_id", C.format_ts(F.col("txn_timestamp")).alias("txn_timestamp"), "risk_score"
    )


@query("t03_latest_per_card", q.ORACLES["t03_latest_per_card"])
def t03(spark, sf):
    return lookups.latest_per_card(snapshots.read(spark, looked_up(spark, sf)), 3).select("card_hash", "txn_id", "recency")


@query("t04_by_rrn", q.ORACLES["t04_by_rrn"])
def t04(spark, sf):
    rows = snapshots.lookup(spark, looked_up(spark, sf), "rrn", "000000000042")
    return rows.select("txn_id", "rrn", "risk_score")


@query("t06_snapshot_range", q.ORACLES["t06_date_range"])
def t06_snapshot(spark, sf):
    path = new_table_path(spark, "snapshots")
    rows = storage.written(q.month_rows(spark, sf), "batch")
    snapshots.upsert(spark, path, rows, now())
    snapshots.upsert(spark, path, rows.filter("risk_score % 2 = 0"), now())
    return snapshots.date_range(spark, path, "2024-12-15 00:00:00", "2025-05-20 00:00:00").select("txn_id", "txn_month")


@query("t05_by_status", q.ORACLES["t05_by_status"])
def t05(spark, sf):
    path = new_table_path(spark, "table")
    storage.write_table(q.stored_rows(spark, sf), path)
    return lookups.by_status(storage.read_table(spark, path), "DECLINED").select("txn_id", "risk_score")


@query("t06_date_range", q.ORACLES["t06_date_range"])
def t06(spark, sf):
    rows = lookups.date_range(month_table(spark, sf), "2024-12-15 00:00:00", "2025-05-20 00:00:00")
    return rows.select("txn_id", "txn_month")
