"""Velocity on a stream.

``VelocityJob`` runs the batch operator on each micro-batch together with the last hour
of history, kept as narrow rows in a table partitioned by hour. A card with a third of
the traffic is spread exactly as in batch, and nothing has to fit in one task's state.

A row's velocity counts the rows that had arrived with or before its micro-batch. Rows
that arrive in order of time, in any order within a micro-batch, get what the batch
operator gives; a row that arrives in a later micro-batch than rows after it sees all of
them that its windows reach, and does not change what was already reported for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv
from ..operators.storage import existing_paths, read_if_present, written
from ..operators.velocity import BLOCK_MS, LONG_COLUMNS, VELOCITY_COLUMNS, velocity_by_ms
from .batches import put_batch, start_batches

HISTORY = T.StructType(
    [
        T.StructField("card_hash", T.StringType()),
        T.StructField("ms", T.LongType()),
        T.StructField("amount_minor", T.LongType()),
        T.StructField("merchant_id", T.StringType()),
        T.StructField("terminal_id", T.StringType()),
        T.StructField("hour", T.LongType()),
        T.StructField("batch_id", T.LongType()),
    ]
)
_NARROW = [f.name for f in HISTORY.fields[:5]]


class VelocityJob:
    """Per micro-batch: split off late rows, add velocity, write, remember the batch.

    Of the history, only the hours its windows reach and the cards it holds are used.

    ``folder`` is shared storage; it receives ``results``, ``late`` and ``history``.
    Rows more than ``lateness_ms`` behind the newest earlier row are late: windows
    already reported may have needed them, so they are set aside, not dropped.
    Hours older than the lateness plus one hour are never read again and may be
    deleted by a storage lifecycle rule.

    With ``corrections``, it also receives ``corrections``: one row per card and millisecond
    whose windows a row of this micro-batch entered after it had been reported.
    """

    def __init__(
        self,
        folder: str,
        score=None,
        lateness_ms: int = fv.HOUR_MS,
        block_ms: int = BLOCK_MS,
        corrections: bool = False,
    ) -> None:
        self.corrections = corrections
        self.folder = folder.rstrip("/")
        self.score = score
        self.lateness_ms = lateness_ms
        self.block_ms = block_ms
        self._seen: tuple[int, int | None] | None = None

    def _newest(self, spark: SparkSession, batch_id: int) -> int | None:
        """Newest time of earlier batches: remembered, or looked up once after a restart."""
        if self._seen is None or self._seen[0] != batch_id - 1:
            table = read_if_present(spark, f"{self.folder}/history", HISTORY)
            found = None if table is None else table.filter(F.col("batch_id") < batch_id).agg(F.max("ms")).first()[0]
            self._seen = (batch_id - 1, found)
        return self._seen[1]

    def _history(self, spark: SparkSession, batch_id: int, since: int, until: int) -> DataFrame | None:
        """Rows of earlier batches in (since, until]; opens the folders of those hours only."""
        hours = range(since // fv.HOUR_MS, until // fv.HOUR_MS + 1)
        paths = existing_paths(spark, [f"{self.folder}/history/hour={h}" for h in hours])
        if not paths:
            return None
        table = spark.read.schema(HISTORY).option("basePath", f"{self.folder}/history").parquet(*paths)
        return table.filter((F.col("batch_id") < batch_id) & (F.col("ms") > since) & (F.col("ms") <= until))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            self._run(spark, batch, batch_id)
        finally:
            batch.unpersist()

    def _run(self, spark: SparkSession, batch: DataFrame, batch_id: int) -> None:
        newest = self._newest(spark, batch_id)
        on_time = batch
        if newest is not None:
            horizon = newest - self.lateness_ms
            on_time = batch.filter(F.col("ms") >= horizon)
            put_batch(batch.filter(F.col("ms") < horizon), f"{self.folder}/late", batch_id)
        known = on_time.select(*_NARROW)
        first_ms, last_ms = known.agg(F.min("ms"), F.max("ms")).first()
        earlier, before = None, newest is not None and first_ms is not None and newest >= first_ms
        if newest is not None and first_ms is not None:
            after = fv.HOUR_MS - 1 if self.corrections and before else 0
            earlier = self._history(spark, batch_id, first_ms - fv.HOUR_MS, last_ms + after)
            if earlier is not None:
                cards = known.select("card_hash").distinct()
                earlier = earlier.select(*_NARROW).join(cards, "card_hash", "left_semi")
        if self.corrections and earlier is not None and before:
            vel = self._corrected(earlier, known, batch_id)
        else:
            vel = velocity_by_ms(known if earlier is None else earlier.unionByName(known), self.block_ms)
        out = on_time.join(vel, ["card_hash", "ms"], "left")
        if self.score is not None:
            out = self.score(out)
        put_batch(out, f"{self.folder}/results", batch_id)
        remembered = on_time.select(*_NARROW, F.expr(f"ms div {fv.HOUR_MS}").alias("hour"))
        put_batch(remembered, f"{self.folder}/history", batch_id, "hour")
        self._seen = (batch_id, max((x for x in (newest, last_ms) if x is not None), default=None))

    def _corrected(self, earlier: DataFrame, fresh: DataFrame, batch_id: int) -> DataFrame:
        """The velocity of the rows of ``fresh``. That of ``earlier`` rows with one of them in their hour goes to the
        corrections; both come from one computation, whose narrow result is written."""
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        known = earlier.withColumn("is_fresh", none).unionByName(fresh.withColumn("is_fresh", one))
        vel = written(velocity_by_ms(known, self.block_ms, F.col("is_fresh")), "velocity")
        columns = ["card_hash", "ms", *VELOCITY_COLUMNS]
        entered = vel.filter("fresh_1hr > 0 AND others_now > 0").select(columns)
        put_batch(entered, f"{self.folder}/corrections", batch_id)
        return vel.filter("fresh_now > 0").select(columns)

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        """``stream`` needs card_hash, ms, amount_minor, merchant_id and terminal_id."""
        return start_batches(stream, self, checkpoint, trigger)


CORRECTIONS = T.StructType(
    [T.StructField("card_hash", T.StringType()), T.StructField("ms", T.LongType())]
    + [T.StructField(c, T.LongType() if c in LONG_COLUMNS else T.IntegerType()) for c in VELOCITY_COLUMNS]
    + [T.StructField("batch_id", T.LongType())]
)


def corrected(spark: SparkSession, folder: str) -> DataFrame:
    """The results with the newest velocity of every row and its version, the micro-batch that computed it."""
    results = spark.read.parquet(f"{folder.rstrip('/')}/results")
    changes = read_if_present(spark, f"{folder.rstrip('/')}/corrections", CORRECTIONS)
    if changes is None:
        return results.withColumn("version", F.col("batch_id"))
    newest = changes.groupBy("card_hash", "ms").agg(
        F.max_by(F.struct(*VELOCITY_COLUMNS), "batch_id").alias("change"), F.max("batch_id").alias("changed_in")
    )
    met = results.join(newest, ["card_hash", "ms"], "left")
    newer = F.col("changed_in") > F.col("batch_id")
    values = {c: F.when(newer, F.col(f"change.{c}")).otherwise(F.col(c)) for c in VELOCITY_COLUMNS}
    values["version"] = F.when(newer, F.col("changed_in")).otherwise(F.col("batch_id"))
    return met.withColumns(values).drop("change", "changed_in")


def late_counts(late: DataFrame) -> DataFrame:
    return late.groupBy("batch_id").agg(F.count("*").alias("late_rows"))


def scorer(merchants: DataFrame, now: Column, **options):
    """Scoring step for ``VelocityJob``."""
    from ..plans.scoring_flow import score_rows

    return lambda rows: score_rows(rows, merchants, now, **options)
