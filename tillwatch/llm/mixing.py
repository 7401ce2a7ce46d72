"""Mixing sources to target weights by systematic sampling.

Within a source, every document gets an expected number of copies; these are added
up along an order, one random offset is added, and a document is taken once for
every whole number its interval crosses.

The order runs through size classes, then by a hash of id and text. The running sum
has three levels (classes of a source, buckets of a class, documents of a bucket);
a bucket is a range of hashes, so no task gets a whole source, a whole size, or the
rows of one repeated or null id. Rows equal in id and text are in one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fraction_of, numbered, written

WORDS = r"[^\x20\x09-\x0D]+"
#: Copies are added up as whole numbers of this many parts.
UNIT = 1_000_000_000_000
#: Leading bits of the 32 of a hash that tell its bucket. The order, hence the mix, does not depend on them.
BUCKET_BITS = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """``sizes`` (source, source_size) with target.

    Sources in code point order, null last, weigh ``weights``, repeating. The whole size
    is shared by weight; a target stops at ``most`` times its source, and what is left is
    reshared until none is above. Sources reach their limit in the order of limit per
    weight, so one running sum finds all of them. One row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    ranked = sizes.withColumn("_w", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)))
    by_limit = Window.orderBy(F.col("_limit") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    after = by_limit.rowsBetween(0, Window.unboundedFollowing)
    every = by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = (
        ranked.withColumn("_limit", F.col("source_size") * F.lit(float(most)))
        .withColumn("_left", F.sum("source_size").over(every) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0)))
        .withColumn("_level", F.col("_left") / F.sum("_w").over(after))
        .withColumn("_full", F.col("_limit") <= F.col("_level") * F.col("_w"))
        .withColumn("_share", F.max(F.when(~F.col("_full"), F.col("_level"))).over(every))
    )
    target = F.when(F.col("_full"), F.col("_limit")).otherwise(F.col("_share") * F.col("_w"))
    return shared.withColumn("target", target.cast("double")).drop("_w", "_limit", "_left", "_level", "_full", "_share")


def _size_class(size: Column) -> Column:
    """A non-decreasing whole number: the size itself below 32, else its leading five bits and their place."""
    more = F.greatest(F.length(F.bin(size)) - 5, F.lit(0)).cast("int")
    return F.call_function("shiftright", size, more) + more * 32


def hash_of(doc_id: Column, text: Column) -> Column:
    """32 bits of an MD5 of id and text, null like empty."""
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(both), 1, 8), 16, 10).cast("long")


def bucket_of(hashed: Column) -> Column:
    return F.call_function("shiftright", hashed, F.lit(32 - BUCKET_BITS)).cast("int")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: int = 11) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size, target and copies.

    ``copies`` is how often the mix takes the document: its source's target over its size,
    rounded up or down, hence at most ``most`` when that is whole. Null texts have size 0
    and are treated like any text without words; a null source is a source of its own. A
    source without words has target 0 and copies 0. Repeated rows are separate documents.
    Result columns replace input columns of the same name. Reruns agree.
    """
    own = ["size", "source_size", "target", "copies"]
    start_with, end_with = numbered(docs, [c for c in docs.columns if c not in own])
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    placed = (
        docs.select(
            *start_with, "doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("_src"),
            hash_of(F.col("doc_id"), F.col("text")).alias("_hash"),
        )
        .withColumn("_class", _size_class(F.col("size")))
        .withColumn("_bucket", bucket_of(F.col("_hash")))
    )
    cells = written(
        placed.groupBy("_src", "_class", "_bucket").agg(
            F.sum("size").alias("words"), F.count("*").alias("docs"), F.min("source").alias("source")
        ),
        "cells",
    )
    plan = targets(cells.groupBy("_src", "source").agg(F.sum("words").alias("source_size")), weights, most)
    each = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * F.lit(float(UNIT)))).otherwise(0)
    start = F.floor(fraction_of(F.lit(str(seed)), F.col("_src")) * F.lit(float(UNIT)))
    plan = plan.select("_src", "source_size", "target", each.cast("decimal(20,0)").alias("_each"), start.alias("_start"))

    def docs_before(order: str, *within: str) -> Column:
        rows = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(F.col("docs").cast("decimal(20,0)")).over(rows), F.lit(0))

    classes = cells.groupBy("_src", "_class").agg(F.sum("docs").alias("docs"))
    classes = classes.select("_src", "_class", docs_before("_class", "_src").alias("_above")).join(plan, "_src")
    starts = (
        cells.select("_src", "_class", "_bucket", docs_before("_bucket", "_src", "_class").alias("_near"))
        .join(classes, ["_src", "_class"])
        .withColumn("_ahead", F.col("_above") + F.col("_near"))
        .drop("_above", "_near")
    )
    order = Window.partitionBy("_src", "_class", "_bucket").orderBy("_hash", "size", "doc_id")
    ranked = placed.withColumn("_rank", F.row_number().over(order))
    met = ranked.join(starts, ["_src", "_class", "_bucket"])
    last = (F.col("_ahead") + F.col("_rank")).cast("decimal(18,0)") * F.col("_each") + F.col("_start")
    crossed = F.expr(f"cast((_last div {UNIT}) - ((_last - _each) div {UNIT}) as bigint)")
    return met.withColumn("_last", last).select(*end_with, "size", "source_size", "target", crossed.alias("copies"))


def repeated(mixed: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it, numbered by ``copy`` from 1."""
    kept = [c for c in mixed.columns if c != "copy"]
    return mixed.filter("copies > 0").select(*kept, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
