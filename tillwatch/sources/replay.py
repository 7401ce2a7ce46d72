"""Second attempt for quarantined results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import fixed_values as fv
from ..operators import snapshots
from ..operators.joins import not_stored
from ..operators.storage import read_if_present, read_table, to_stored, upsert
from ..operators.validation import with_constraint_reason
from ..schemas import FRAUD_RESULTS, QUARANTINE, STORED, fill_absent
from .frames import decode, triage

QUARANTINE_COLUMNS = [
    "key", "value", "dlq_original_topic", "dlq_original_partition", "dlq_original_offset", "dlq_failure_reason",
    "dlq_retry_count", "dlq_failed_at",
]
_KEPT = tuple(c for c in QUARANTINE_COLUMNS if c != "dlq_failure_reason")


def checked_rows(quarantine: DataFrame, now: Column) -> DataFrame:
    """Quarantined records as stored rows with ``reason``: what still keeps them out, or NULL.

    The same checks as on the way in: frame, payload, absent values, constraints.
    """
    decoded = decode(triage(quarantine), FRAUD_RESULTS)
    fields = [F.col(f"event.{f.name}").alias(f.name) for f in FRAUD_RESULTS.fields]
    events = decoded.select(*_KEPT, F.col("reason").alias("unread"), *fields)
    rows = with_constraint_reason(to_stored(fill_absent(events, FRAUD_RESULTS), now, (*_KEPT, "unread")))
    return rows.withColumn("reason", F.coalesce("unread", "reason")).drop("unread")


def replay_rows(quarantine: DataFrame, stored: DataFrame | None, now: Column) -> DataFrame:
    """Quarantined records that pass all checks and are not in the table yet."""
    rows = checked_rows(quarantine, now).filter("reason IS NULL").select([f.name for f in STORED.fields])
    return rows if stored is None else not_stored(rows, stored)


def still_rejected(quarantine: DataFrame, now: Column) -> DataFrame:
    """Records that fail again, with the reason found now and a higher retry count."""
    return _rejected(checked_rows(quarantine, now), now)


def _rejected(checked: DataFrame, now: Column) -> DataFrame:
    return checked.filter("reason IS NOT NULL").withColumns(
        {
            "dlq_failure_reason": F.col("reason"),
            "dlq_retry_count": (F.coalesce(F.col("dlq_retry_count").try_cast("int"), F.lit(0)) + 1).cast("string"),
            "dlq_failed_at": F.date_format(now, fv.QUARANTINE_TIME),
        }
    ).select(QUARANTINE_COLUMNS)


#: What tells quarantined records apart.
RECORD = ["dlq_original_topic", "dlq_original_partition", "dlq_original_offset"]
_CHANGED = ["dlq_failure_reason", "dlq_retry_count", "dlq_failed_at"]
LOG = StructType(
    [StructField(c, StringType()) for c in [*RECORD, *_CHANGED]] + [StructField("run", LongType())]
)


def log_path(quarantine_path: str) -> str:
    return f"{quarantine_path.rstrip('/')}_replays"


def open_quarantine(spark: SparkSession, quarantine_path: str) -> DataFrame:
    """The quarantined records that no replay has stored, each with what its last replay found.

    The quarantine itself is only ever appended to, by the jobs that fill it; replays keep a log
    beside it. A record's last entry counts: without a reason it was stored, otherwise it has the
    reason and retry count of then. The log's rows are narrow and are one per record after the
    aggregate, so a hot partition of the topic is no hot key.
    """
    quarantine = spark.read.schema(QUARANTINE).parquet(quarantine_path)
    log = read_if_present(spark, log_path(quarantine_path), LOG)
    if log is None:
        return quarantine
    last = log.groupBy(*RECORD).agg(F.max_by(F.struct(*_CHANGED), "run").alias("last"))
    same = [quarantine[c].eqNullSafe(last[c]) for c in RECORD]
    met = quarantine.join(last, same, "left")
    seen = F.col("last").isNotNull()
    changed = {c: F.when(seen, F.col(f"last.{c}")).otherwise(quarantine[c]) for c in _CHANGED}
    rows = met.filter(~seen | F.col("last.dlq_failure_reason").isNotNull())
    return rows.select(*[changed[c].alias(c) if c in changed else quarantine[c] for c in QUARANTINE_COLUMNS])


def replay(spark: SparkSession, quarantine_path: str, table: str, now: Column, store: Store | None = None) -> None:
    """Store what passes now and log the outcome of every record; ``open_quarantine`` has the rest.

    Nothing is overwritten, so records that are quarantined before, during or after a replay stay
    visible. The log of a run is written last: a replay that is cut off can be run again, as storing the
    same rows again changes nothing. ``store`` is where rows go: the month table at ``table`` by
    default, or ``SnapshotStore``. Only the months of the records are read from the table.
    """
    store = store or MonthStore()
    records = open_quarantine(spark, quarantine_path).persist()
    try:
        checked = checked_rows(records, now).persist()
        good = checked.filter("reason IS NULL").select([f.name for f in STORED.fields])
        months = [r[0] for r in good.select("txn_month").distinct().collect()]
        if months:
            stored = store.read(spark, table, months)
            rows = good if stored is None else not_stored(good, stored)
            rows = rows.withColumn("batch_seq", F.lit(0).cast("long")).persist()  # the store reads it several times
            try:
                store.write(spark, table, rows, now)
            finally:
                rows.unpersist()
        rejected = _rejected(checked, now).select(*RECORD, *_CHANGED)
        passed = checked.filter("reason IS NULL").select(*RECORD, *[F.lit(None).cast("string").alias(c) for c in _CHANGED])
        before = read_if_present(spark, log_path(quarantine_path), LOG)
        run = 1 if before is None else (before.agg(F.max("run")).first()[0] or 0) + 1
        outcome = rejected.unionByName(passed)
        # a run's folder, so that a second attempt at logging replaces the first
        outcome.write.mode("overwrite").parquet(f"{log_path(quarantine_path)}/run={run}")
        checked.unpersist()
    finally:
        records.unpersist()


class MonthStore:
    """The month table; ``read`` has at least the keys of the months."""

    def read(self, spark: SparkSession, table: str, months: list[str]) -> DataFrame | None:
        stored = read_table(spark, table)
        return None if stored is None else stored.filter(F.col("txn_month").isin(months))

    def write(self, spark: SparkSession, table: str, rows: DataFrame, now: Column) -> None:
        upsert(spark, table, rows, now)


class SnapshotStore:
    """The snapshot table."""

    def read(self, spark: SparkSession, table: str, months: list[str]) -> DataFrame:
        return snapshots.stored_keys(spark, table, months)

    def write(self, spark: SparkSession, table: str, rows: DataFrame, now: Column) -> None:
        snapshots.upsert(spark, table, rows, now)


Store = MonthStore | SnapshotStore
