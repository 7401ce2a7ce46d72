"""The 24-hour idempotency rule on a stream.

The policy: the first request of a key to arrive is its original. A request less than
24 hours after or before a known original of its key repeats it: the latest original at
or before it, else the earliest after it. Requests of a micro-batch that repeat nothing
known are decided among themselves by the batch operator, in order of their times.

Originals are kept as narrow rows in a table partitioned by day; a micro-batch reads
the days its own times reach and no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv
from ..operators.dedup import with_original
from ..operators.storage import existing_paths, read_if_present
from .batches import put_batch, start_batches

ORIGINS = T.StructType(
    [
        T.StructField("idempotency_key", T.StringType()),
        T.StructField("origin_ms", T.LongType()),
        T.StructField("original_txn_id", T.StringType()),
        T.StructField("day", T.LongType()),
        T.StructField("batch_id", T.LongType()),
    ]
)


class IdempotencyJob:
    """``folder`` receives ``requests`` (all, with original_txn_id and is_duplicate) and ``origins``.

    Days whose requests can no longer arrive may be deleted by a storage lifecycle rule.
    """

    def __init__(self, folder: str, ttl_ms: int = fv.DAY_MS) -> None:
        self.folder = folder.rstrip("/")
        self.ttl_ms = ttl_ms

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            self._run(batch, batch_id)
        finally:
            batch.unpersist()

    def _known(self, batch: DataFrame, batch_id: int) -> DataFrame | None:
        """Originals of earlier batches in the days around the batch, by (key, day) of the requests they can meet."""
        day = F.call_function("div", F.col("ms"), F.lit(self.ttl_ms))
        days = {row["day"] + k for row in batch.select(day.alias("day")).distinct().collect() if row["day"] is not None for k in (-1, 0, 1)}
        spark, place = batch.sparkSession, f"{self.folder}/origins"
        paths = existing_paths(spark, [f"{place}/day={day}" for day in sorted(days)])
        if not paths:
            return None
        origins = spark.read.schema(ORIGINS).option("basePath", place).parquet(*paths)
        known = origins.filter(F.col("batch_id") < batch_id)
        known = known.groupBy("idempotency_key", "origin_ms").agg(F.min("original_txn_id").alias("original_txn_id"))
        own = F.call_function("div", F.col("origin_ms"), F.lit(self.ttl_ms))
        return known.withColumn("request_day", F.explode(F.sequence(own - 1, own + 1)))

    def _run(self, batch: DataFrame, batch_id: int) -> None:
        fresh, repeats = batch, None
        known = self._known(batch, batch_id)
        if known is not None:
            day = F.call_function("div", F.col("ms"), F.lit(self.ttl_ms))
            stamps = batch.select("idempotency_key", "ms").distinct().withColumn("request_day", day)
            apart = F.col("ms") - F.col("origin_ms")
            near = stamps.join(known, ["idempotency_key", "request_day"]).filter(F.abs(apart) < self.ttl_ms)
            order = F.struct((apart < 0).alias("later"), F.abs(apart).alias("apart"))
            met = near.groupBy("idempotency_key", "ms").agg(F.min_by("original_txn_id", order).alias("original_txn_id"))
            decided = batch.join(met, ["idempotency_key", "ms"], "left")
            repeats = decided.filter("original_txn_id IS NOT NULL").select(
                *batch.columns, "original_txn_id", F.lit(True).alias("is_duplicate")
            )
            fresh = decided.filter("original_txn_id IS NULL").select(*batch.columns)
        decided = with_original(fresh, self.ttl_ms)
        whole = decided if repeats is None else decided.unionByName(repeats)
        put_batch(whole, f"{self.folder}/requests", batch_id)
        # the originals are read from what was written, so that nothing is decided twice; repeats are duplicates
        done = read_if_present(batch.sparkSession, f"{self.folder}/requests/batch_id={batch_id}", whole.schema)
        if done is None:
            return
        new = (
            done.filter(~F.col("is_duplicate"))
            .groupBy("idempotency_key", F.col("ms").alias("origin_ms"))
            .agg(F.min("original_txn_id").alias("original_txn_id"))
            .withColumn("day", F.call_function("div", F.col("origin_ms"), F.lit(self.ttl_ms)))
        )
        put_batch(new, f"{self.folder}/origins", batch_id, "day")

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        """``stream`` needs idempotency_key, ms and txn_id."""
        return start_batches(stream, self, checkpoint, trigger)
