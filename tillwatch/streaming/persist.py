"""Result records to the stored table, batch by batch.

Rows that cannot be decoded or that break a constraint go to the quarantine with their
own reason, and the rest carries on. A write that fails is tried again after growing
waits, unless trying again cannot help; rows that still cannot be written go to the
quarantine too. The audit table records each finished batch, so a batch replayed after
a restart is skipped or writes the same rows again.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from ..functions import fixed_values as fv
from ..operators import snapshots
from ..operators.storage import read_if_present, to_stored, upsert
from ..operators.validation import with_constraint_reason
from ..schemas import FRAUD_RESULTS, STORED, fill_absent
from ..sources.frames import batch_failure_reason, decode, to_quarantine, triage
from .batches import put_batch, start_batches

AUDIT = StructType(
    [StructField("status", StringType()), StructField("units", LongType()), StructField("batch_id", LongType())]
)

Writer = Callable[[DataFrame, int], None]


def month_writer(table: str, now: Column) -> Writer:
    """Merge each batch into the month table. Rewrites the months it touches."""
    return lambda rows, batch_id: upsert(rows.sparkSession, table, rows, now)


def snapshot_writer(table: str, now: Column, writer: str = "persist", after: Callable[[str], None] = lambda step: None) -> Writer:
    """Commit each batch to the snapshot table, once, however often the batch is run; the cost follows the batch."""
    return lambda rows, batch_id: snapshots.upsert(rows.sparkSession, table, rows, now, writer, batch_id, after)


#: Errors of the data or of the program: the same write would fail again.
NOT_RETRYABLE = (AnalysisException, ValueError, TypeError, KeyError)


def may_pass_later(error: Exception) -> bool:
    return not isinstance(error, NOT_RETRYABLE)


def with_retry(
    write: Callable[[], None],
    attempts: int = fv.MAX_ATTEMPTS,
    retryable: Callable[[Exception], bool] = may_pass_later,
    sleep: Callable[[float], None] = time.sleep,
) -> tuple[int, Exception | None]:
    """(attempts made, last error or None). Waits grow up to a longest one."""
    delay = fv.RETRY_DELAY
    for tried in range(1, attempts + 1):
        try:
            write()
            return tried, None
        except Exception as error:  # noqa: BLE001 - any write failure sends the rows to quarantine
            if tried == attempts or not retryable(error):
                return tried, error
        sleep(delay)
        delay = min(delay * fv.RETRY_GROWTH, fv.RETRY_LONGEST)
    return attempts, None


class PersistJob:
    def __init__(
        self,
        folder: str,
        write: Writer,
        now: Column,
        attempts: int = fv.MAX_ATTEMPTS,
        sleep: Callable[[float], None] = time.sleep,
        after: Callable[[str, int], None] = lambda step, batch_id: None,
    ) -> None:
        """``after`` is called after each step of a batch: "written", "quarantined", "audited"."""
        self.after = after
        self.folder = folder.rstrip("/")
        self.write = write
        self.now = now
        self.attempts = attempts
        self.sleep = sleep

    def _finished(self, spark: SparkSession, batch_id: int) -> bool:
        """Looks at this batch's folder only, however many batches there were."""
        audit = read_if_present(spark, f"{self.folder}/audit/batch_id={batch_id}", AUDIT)
        return audit is not None and not audit.isEmpty()

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if self._finished(spark, batch_id):
            return
        # a topic or file may have fewer parts than there are cores, or all of a batch in a few of them
        parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        checked = self._checked(batch.repartition(parts, "partition", "offset"))
        # decoded once; the frames are kept of refused rows only
        frame = {c: F.when(F.col("reason").isNotNull(), F.col(c)) for c in ("key", "value")}
        rows = checked.withColumns(frame).persist()
        try:
            self._run(spark, rows, checked, batch_id)
        finally:
            rows.unpersist()

    def _checked(self, batch: DataFrame) -> DataFrame:
        """Every frame as a stored row, with the frame and ``reason``: what keeps it out, or NULL."""
        decoded = decode(triage(batch), FRAUD_RESULTS)
        events = decoded.select(
            "key", "value", "partition", "offset", F.col("offset").alias("batch_seq"), F.col("reason").alias("unread"),
            *[F.col(f"event.{f.name}").alias(f.name) for f in FRAUD_RESULTS.fields],
        )
        kept = ("key", "value", "partition", "offset", "batch_seq", "unread")
        rows = with_constraint_reason(to_stored(fill_absent(events, FRAUD_RESULTS), self.now, kept))
        return rows.withColumn("reason", F.coalesce("unread", "reason")).drop("unread")

    def _run(self, spark: SparkSession, rows: DataFrame, checked: DataFrame, batch_id: int) -> None:
        """``rows`` are ``checked``, kept, without the frames of good rows."""
        good = rows.filter("reason IS NULL").select(*[f.name for f in STORED.fields], "batch_seq")
        frame_columns = ["key", "value", "partition", "offset", "reason"]
        tried, error = with_retry(lambda: self.write(good, batch_id), self.attempts, sleep=self.sleep)
        quarantine = to_quarantine(rows.filter("reason IS NOT NULL").select(*frame_columns), self.now)
        good_count, refused = rows.agg(F.count_if(F.isnull("reason")), F.count("reason")).first()
        if error is not None:
            reason = batch_failure_reason(type(error).__name__, tried)
            unwritten = checked.filter("reason IS NULL").withColumn("reason", F.lit(reason)).select(*frame_columns)
            quarantine = quarantine.unionByName(to_quarantine(unwritten, self.now, tried))
            good_count, refused = 0, refused + good_count
        self.after("written", batch_id)
        put_batch(quarantine, f"{self.folder}/quarantine", batch_id)
        self.after("quarantined", batch_id)
        counts = [("success", good_count), ("retry", tried - 1 if error is None else tried), ("dlq", refused)]
        audit = spark.createDataFrame(counts, StructType(AUDIT.fields[:2]))
        put_batch(audit.coalesce(1), f"{self.folder}/audit", batch_id)
        self.after("audited", batch_id)

    def start(self, frames: DataFrame, checkpoint: str, **trigger):
        """``frames`` needs partition, offset, key and value."""
        return start_batches(frames, self, checkpoint, trigger)
