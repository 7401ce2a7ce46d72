"""Helpers shared by the text operators: written tables, tiles for busy groups, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; a temporary folder only in local mode without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, and no lineage to lose."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, keep: list[str]) -> tuple[list[Column], list[Column]]:
    """(columns to start with, columns to end with): ``keep`` passes through under names of numbers,
    so that no name of the input meets one that an operator uses on the way."""
    names = [f"in:{n}" for n in range(len(keep))]
    start = [F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)]
    return start, [F.col(f"`{n}`").alias(c) for c, n in zip(keep, names)]


def fraction_of(*parts: Column) -> Column:
    """A reproducible number in [0, 1) from text parts: 32 bits of an MD5."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def in_tiles(df: DataFrame, keys: list[str], member: Column, most: int) -> DataFrame:
    """Deal the members of each group to tiles (``tile_a``, ``tile_b``), so that every two of them meet.

    A group of n members is cut into ``ceil(n / most)`` slices by a hash of ``member``;
    a slice goes to the tiles that pair it with every slice. ``slice`` is the row's own.
    Groups of one member have no pairs and are left out. A tile holds two slices, so
    no task gets a whole busy group.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1")
    slices = F.ceil(F.col("_n") / F.lit(most)).cast("int")
    return (
        df.join(sizes, keys)
        .withColumn("_slices", slices)
        .withColumn("slice", F.pmod(F.xxhash64(member), F.col("_slices").cast("long")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))
        .withColumn("tile_a", F.least("slice", "_other"))
        .withColumn("tile_b", F.greatest("slice", "_other"))
        .drop("_n", "_slices", "_other")
    )


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root is the smallest node it is connected with.

    Alternating large-star and small-star steps: each replaces a node's links by links
    to its smallest neighbour. A step is an aggregate and a join on one node, so a hub's
    rows can be split; every round is written to the shared folder.
    """

    def directed(links: DataFrame) -> DataFrame:
        return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()

    now = written(directed(edges), name)
    state = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = directed(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        now = written(directed(small), name)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
