"""Episodes of failed scoring calls.

Failures of one dependency less than 30 s apart form a session; the fifth opens
an episode. One dependency may fail for a third of all rows, so failures are
counted per millisecond and first chained within an hour. What is left per hour
is a few pieces, at most one per 30 s, and only those are chained across hours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv

BLOCK_MS = fv.HOUR_MS


def _breaks(previous: Column, current: Column, gap_ms: int) -> Column:
    """1 where a new session starts."""
    return F.when(current - previous < gap_ms, F.lit(0)).otherwise(F.lit(1))


def failure_sessions(
    failures: DataFrame,
    gap_ms: int = fv.FAILURE_GAP_MS,
    threshold: int = fv.FAILURE_THRESHOLD,
    block_ms: int = BLOCK_MS,
) -> DataFrame:
    """``failures`` (dependency, ms) to one row per session."""
    in_block = Window.partitionBy("dependency", "block").orderBy("ms")
    in_piece = Window.partitionBy("dependency", "block", "piece").orderBy("ms")
    pieces = (
        failures.groupBy("dependency", "ms")
        .agg(F.count("*").alias("n"))
        .withColumn("block", F.expr(f"ms div {block_ms}"))
        .withColumn("breaks", _breaks(F.lag("ms").over(in_block), F.col("ms"), gap_ms))
        .withColumn("piece", F.sum("breaks").over(in_block))
        .withColumn("upto", F.sum("n").over(in_piece.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy("dependency", "block", "piece")
        .agg(
            F.min("ms").alias("start_ms"),
            F.max("ms").alias("end_ms"),
            F.sum("n").alias("n"),
            # no more than `threshold` entries: the times at which the count may reach it
            F.collect_list(F.when(F.col("upto") - F.col("n") < threshold, F.struct("upto", "ms"))).alias("firsts"),
        )
    )
    over_pieces = Window.partitionBy("dependency").orderBy("start_ms")
    in_session = Window.partitionBy("dependency", "session").orderBy("start_ms")
    before = F.coalesce(F.sum("n").over(in_session.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = F.filter("firsts", lambda x: x["upto"] + F.col("before") >= threshold)
    return (
        pieces.withColumn("breaks", _breaks(F.lag("end_ms").over(over_pieces), F.col("start_ms"), gap_ms))
        .withColumn("session", F.sum("breaks").over(over_pieces))
        .withColumn("before", before)
        .withColumn("opened_ms", F.array_min(F.transform(reached, lambda x: x["ms"])))
        .groupBy("dependency", "session")
        .agg(
            F.min("start_ms").alias("start_ms"),
            F.max("end_ms").alias("end_ms"),
            F.sum("n").alias("failures"),
            F.min("opened_ms").alias("opened_ms"),
        )
        .withColumn("is_episode", F.col("opened_ms").isNotNull())
        .drop("session")
    )
