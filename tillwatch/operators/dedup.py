"""Idempotency: the first request for a key wins for 24 hours.

A repeat does not extend the 24 hours; the first request after they end is a new
original. That is a chain per key, and originals are at least 24 hours apart.

* Only the first request of each (key, millisecond) can be an original, so the
  chain runs on rows aggregated to that grain, without payload.
* The successor of a stamp is the key's first stamp 24 hours later or more. It is
  looked for among the stamps of one hour, a window bounded by its milliseconds, and
  otherwise is the first stamp of the key's next hour that has any. Hours further off than 24
  do not matter, as chains begin anew there, so hours are looked through in spans of some weeks.
* A stamp with none in the 24 hours before it is an original whatever came earlier,
  so chains begin anew there, and no link to it is followed.
* In between, chains are followed by doubling: successors, successors of successors,
  and so on, each round one join on (key, millisecond). Rounds grow with the logarithm
  of the days without such a gap, and no key is ever gathered.
* The original of a stamp is the last one up to it: of its hour, else of the key's
  last hour that has one. Requests find their stamp by (key, millisecond), so a busy
  key is spread however busy it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from .storage import union_of, written

BLOCK_MS = fv.HOUR_MS
#: Times the hours that a request reaches, which make a span of hours.
SPAN = 32


def _block(ms: Column) -> Column:
    return F.call_function("div", ms, F.lit(BLOCK_MS))


def _beside(hours: DataFrame, ttl_ms: int, **carried: tuple[str, bool]) -> DataFrame:
    """(idempotency_key, block) of ``hours`` with what the key's other hours hold, all within ``ttl_ms`` among them.
    ``carried`` names columns: the least of a column over later hours (name=(column, True)), or the greatest over earlier ones.

    Windows run per key and span of hours; the hours near an edge also go to the span beyond it.
    """
    reach = ttl_ms // BLOCK_MS + 1
    hour = F.col("hour")

    def span(shift: int = 0) -> Column:
        return F.call_function("div", hour + shift, F.lit(SPAN * reach))

    rows = hours.withColumnRenamed("block", "hour")
    near = [rows.filter(span(shift) != span()).withColumn("block", span(shift)) for shift in (reach, -reach)]
    known = union_of([rows.withColumn("block", span()), *near])
    by_span = Window.partitionBy("idempotency_key", "block")
    # both frames only ever grow
    later = by_span.orderBy(F.desc("hour")).rowsBetween(Window.unboundedPreceding, -1)
    earlier = by_span.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    found = known.withColumns({n: F.min(c).over(later) if after else F.max(c).over(earlier) for n, (c, after) in carried.items()})
    return found.filter(F.col("block") == span()).select("idempotency_key", hour.alias("block"), *carried)


def links(stamps: DataFrame, ttl_ms: int = fv.DAY_MS) -> DataFrame:
    """(idempotency_key, ms, next_ms) of ``stamps``: the successor of each that has one, unless that begins a chain
    anew; and each stamp that begins a chain, with next_ms null."""
    asked = stamps.select("idempotency_key", (F.col("ms") + ttl_ms).alias("at"), F.lit(None).cast("long").alias("stamp"))
    known = stamps.select("idempotency_key", F.col("ms").alias("at"), F.col("ms").alias("stamp"))
    rows = asked.unionByName(known).withColumn("block", _block(F.col("at")))
    hours = rows.groupBy("idempotency_key", "block").agg(F.min("stamp").alias("first"), F.max("stamp").alias("last"))
    hours = _beside(hours, ttl_ms, next_hour=("first", True), hour_before=("last", False))
    # from the last row on, a stamp before a question for its own time
    by_time = Window.partitionBy("idempotency_key", "block").orderBy(F.desc("at"), F.desc_nulls_last("stamp"))
    ahead = F.min("stamp").over(by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    behind = F.expr(
        "lead(stamp) IGNORE NULLS OVER (PARTITION BY idempotency_key, block ORDER BY at DESC, stamp DESC NULLS LAST)"
    )
    met = rows.withColumns({"ahead": ahead, "behind": behind}).join(hours, ["idempotency_key", "block"])
    found = met.select(
        "idempotency_key", "at", "stamp",
        F.coalesce("ahead", "next_hour").alias("next_ms"), F.coalesce("behind", "hour_before").alias("before"),
    )
    apart = F.col("next_ms") - F.col("before") >= ttl_ms
    begins = F.col("stamp").isNotNull() & (F.col("before").isNull() | apart)
    follows = F.col("stamp").isNull() & F.col("next_ms").isNotNull() & ~apart
    is_link = F.col("stamp").isNull()
    return found.filter(begins | follows).select(
        "idempotency_key", F.when(is_link, F.col("at") - ttl_ms).otherwise(F.col("stamp")).alias("ms"),
        F.when(is_link, F.col("next_ms")).alias("next_ms"),
    )


def originals(stamps: DataFrame, ttl_ms: int = fv.DAY_MS) -> DataFrame:
    """(idempotency_key, origin_ms) of the stamps (idempotency_key, ms) that are originals.

    Every round is written to the shared folder.
    """
    found = written(links(stamps, ttl_ms), "links")
    parts = [found.filter("next_ms IS NULL").select("idempotency_key", "ms")]
    step = found.filter("next_ms IS NOT NULL")
    while not step.isEmpty():
        reached = union_of(parts)
        further = reached.join(step, ["idempotency_key", "ms"]).select("idempotency_key", F.col("next_ms").alias("ms"))
        parts.append(written(further, "reached"))
        beyond = step.select("idempotency_key", F.col("ms").alias("next_ms"), F.col("next_ms").alias("beyond_ms"))
        step = step.join(beyond, ["idempotency_key", "next_ms"]).select(
            "idempotency_key", "ms", F.col("beyond_ms").alias("next_ms")
        )
        step = written(step, "successors")
    return union_of(parts).withColumnRenamed("ms", "origin_ms")


def _stamps_with_origin(stamps: DataFrame, ttl_ms: int) -> DataFrame:
    """``stamps`` (idempotency_key, ms, first_id) with original_txn_id."""
    origins = originals(stamps.select("idempotency_key", "ms"), ttl_ms)
    named = stamps.join(origins.withColumn("ms", F.col("origin_ms")), ["idempotency_key", "ms"], "left")
    origin = F.when(F.col("origin_ms").isNotNull(), F.struct("ms", "first_id"))
    rows = named.select("idempotency_key", "ms", origin.alias("origin"), _block(F.col("ms")).alias("block"))
    rows = written(rows, "origins")
    hours = rows.groupBy("idempotency_key", "block").agg(F.max("origin").alias("last"))
    hours = _beside(hours, ttl_ms, hour_before=("last", False))
    by_time = Window.partitionBy("idempotency_key", "block").orderBy("ms")
    so_far = F.max("origin").over(by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = rows.withColumn("so_far", so_far).join(hours, ["idempotency_key", "block"])
    return met.select("idempotency_key", "ms", F.coalesce("so_far", "hour_before")["first_id"].alias("original_txn_id"))


def with_original(requests: DataFrame, ttl_ms: int = fv.DAY_MS) -> DataFrame:
    """Add ``original_txn_id`` and ``is_duplicate``; ties in time go to the lower txn_id.

    A request without a key or time has no original.
    """
    stamps = requests.filter("idempotency_key IS NOT NULL AND ms IS NOT NULL").groupBy("idempotency_key", "ms")
    stamps = written(stamps.agg(F.min("txn_id").alias("first_id")), "stamps")
    joined = requests.join(_stamps_with_origin(stamps, ttl_ms), ["idempotency_key", "ms"], "left")
    return joined.select(
        *requests.columns, "original_txn_id", (F.col("txn_id") != F.col("original_txn_id")).alias("is_duplicate")
    )


def first_requests(requests: DataFrame, ttl_ms: int = fv.DAY_MS) -> DataFrame:
    """Only the originals, each once."""
    kept = with_original(requests, ttl_ms).filter(~F.col("is_duplicate"))
    return kept.drop("original_txn_id", "is_duplicate").dropDuplicates(["txn_id"])
