"""The stored table as snapshots: atomic commits, writes that follow the batch, reads that skip files.

A commit writes its rows as a segment of new files and publishes a manifest that names
the live segments; manifests are created atomically and never changed, and readers take the
newest. An upsert adds a segment of its batch only. Reads merge the segments of a key;
``compact`` does so for good, month by month. A run that is cut off before publishing leaves
files that no manifest names; running it again gives the same table.

Files are clustered by month, card and time. Each segment has the range of every file, and
Parquet Bloom filters on card and reference number, so lookups open few files and skip row groups.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import STORED
from .joins import not_stored
from .storage import DECISION_COLUMNS, KEY, merge_rows, month_of

SEGMENT = T.StructType([*STORED.fields, T.StructField("committed_at", T.TimestampType())])
#: Ranges kept of every file.
RANGED = ("card_hash", "rrn", "txn_timestamp")
#: Distinct values a row group's Bloom filter is sized for.
BLOOM_VALUES = 100_000
#: Segments of upserts before they are compacted.
MOST_DELTAS = 8
#: Keys that repeat within a batch and may be broadcast; with more, all rows are merged by a shuffle.
MOST_REPEATED = 500_000

Step = Callable[[str], None]


def _nothing(step: str) -> None:
    pass


# --- manifests -------------------------------------------------------------------


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(p.rstrip("/") for p in parts))


def _files(spark: SparkSession, place):
    return place.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, table: str) -> list[int]:
    folder = _path(spark, table, "manifest")
    files = _files(spark, folder)
    if not files.exists(folder):
        return []
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def snapshot(spark: SparkSession, table: str, version: int | None = None) -> dict:
    """The manifest of ``version`` or the newest one: version, segments, batches."""
    known = versions(spark, table)
    if not known:
        return {"version": 0, "segments": [], "batches": {}}
    place = _path(spark, table, "manifest", f"{version or known[-1]:020d}.json")
    stream = _files(spark, place).open(place)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _create(spark: SparkSession, table: str, manifest: dict) -> bool:
    """Publish ``manifest`` unless its version exists: a finished file takes its name in one rename."""
    name = f"{manifest['version']:020d}.json"
    draft = _path(spark, table, "manifest", f".{name}.{uuid.uuid4().hex}")
    stream = _files(spark, draft).create(draft, False)
    stream.write(bytearray(json.dumps(manifest).encode()))
    stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    try:
        context.rename(draft, _path(spark, table, "manifest", name), options)
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in error.java_exception.getClass().getName():
            raise
        _files(spark, draft).delete(draft, False)
        return False
    return True


def publish(spark: SparkSession, table: str, change: Callable[[dict], dict | None]) -> dict | None:
    """Apply ``change`` to the newest manifest and publish the result as the next version, again and again
    while other writers come first. None from ``change`` publishes nothing."""
    while True:
        now = snapshot(spark, table)
        after = change(now)
        if after is None:
            return None
        after = {**after, "version": now["version"] + 1}
        if _create(spark, table, after):
            return after


# --- writing ---------------------------------------------------------------------


def stage(spark: SparkSession, table: str, rows: DataFrame) -> dict | None:
    """Write ``rows`` as a segment that no manifest names yet; None for no rows."""
    segment = uuid.uuid4().hex
    order = ["txn_month", "card_hash", "txn_timestamp"]
    writer = rows.select([f.name for f in SEGMENT.fields]).repartitionByRange(*order).sortWithinPartitions(*order).write
    for column in ("rrn", "card_hash"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(
            f"parquet.bloom.filter.expected.ndv#{column}", str(BLOOM_VALUES)
        )
    place = f"{table.rstrip('/')}/data/{segment}"
    writer.partitionBy("txn_month").parquet(place)
    ranges = [f(c).alias(f"{n}_{c}") for c in RANGED for n, f in (("min", F.min), ("max", F.max))]
    written = spark.read.schema(SEGMENT).parquet(place)
    stats = written.groupBy(F.col("_metadata.file_path").alias("file"), "txn_month").agg(F.count("*").alias("n_rows"), *ranges)
    stats.coalesce(1).write.parquet(f"{table.rstrip('/')}/stats/{segment}")
    months = [r[0] for r in stats_of(spark, table, [segment]).select("txn_month").distinct().collect()]
    return {"id": segment, "months": sorted(months)} if months else None


STATS = T.StructType(
    [T.StructField("file", T.StringType()), T.StructField("txn_month", T.StringType()), T.StructField("n_rows", T.LongType())]
    + [T.StructField(f"{n}_{c}", STORED[c].dataType) for c in RANGED for n in ("min", "max")]
)


def stats_of(spark: SparkSession, table: str, segments: list[str]) -> DataFrame:
    """The range of every file of ``segments``."""
    return spark.read.schema(STATS).parquet(*[f"{table.rstrip('/')}/stats/{s}" for s in segments])


def _one_per_key(incoming: DataFrame, now: Column) -> tuple[DataFrame, bool]:
    """``merge_rows`` of a batch alone, and whether its rows cost more than reading the batch. Only rows whose key
    repeats are moved and merged; these are found by counts per hash of the key, where a collision merges nothing."""
    names = [*KEY, *[c for c in incoming.columns if c not in [*KEY, "batch_seq"]]]
    key = F.xxhash64(*KEY)
    counts = incoming.groupBy(key.alias("_key")).agg(F.count("*").alias("_n"))
    repeated = counts.filter("_n > 1").select("_key").persist()
    try:
        many = repeated.count()
        if many == 0:
            return incoming.select(names), False
        if many > MOST_REPEATED:
            return merge_rows(None, incoming, now), True
        spark = incoming.sparkSession
        found = F.broadcast(spark.createDataFrame(repeated.toArrow(), repeated.schema))
    finally:
        repeated.unpersist()
    keyed = incoming.withColumn("_key", key)
    merged = merge_rows(None, keyed.join(found, "_key", "left_semi").drop("_key"), now)
    return keyed.join(found, "_key", "left_anti").select(names).unionByName(merged), True


def upsert(
    spark: SparkSession, table: str, incoming: DataFrame, now: Column, writer: str = "", batch_id: int = -1,
    after: Step = _nothing, most_deltas: int = MOST_DELTAS,
) -> None:
    """Merge ``incoming`` into the table: rows of one key as in ``merge_rows``, later commits after earlier ones.

    The cost is that of ``incoming``, which is read three times: callers keep what is costly to compute. With ``writer`` and ``batch_id``, a batch that was published
    before is not published again. ``after`` is called after the steps "staged" and "published".
    """
    if writer and snapshot(spark, table)["batches"].get(writer, -1) >= batch_id:
        return
    rows, merged = _one_per_key(incoming, now)
    rows = rows.withColumn("committed_at", now)
    if merged:  # the ranges of the files are sampled, so the rows are computed once
        rows.persist()
    try:
        segment = stage(spark, table, rows)
    finally:
        rows.unpersist()
    after("staged")

    def add(manifest: dict) -> dict | None:
        if writer and manifest["batches"].get(writer, -1) >= batch_id:
            return None
        batches = {**manifest["batches"], **({writer: batch_id} if writer else {})}
        kind = "delta" if manifest["segments"] else "base"
        added = [{**segment, "kind": kind, "seq": manifest["version"] + 1}] if segment else []
        return {"segments": manifest["segments"] + added, "batches": batches}

    if segment or writer:
        published = publish(spark, table, add)
        after("published")
        if published and sum(s["kind"] == "delta" for s in published["segments"]) > most_deltas:
            compact(spark, table)


def compact(spark: SparkSession, table: str) -> bool:
    """Merge the upserts into the base of the months they touch; False if another compaction came first.

    Upserts that are published meanwhile stay as they are, after the new base.
    """
    before = snapshot(spark, table)
    deltas = [s for s in before["segments"] if s["kind"] == "delta"]
    months = sorted({m for s in deltas for m in s["months"]})
    if not months:
        return True
    segment = stage(spark, table, _merged(spark, table, before, months))
    taken = {s["id"]: s["months"] for s in before["segments"]}
    last = max(s["seq"] for s in before["segments"])

    def swap(manifest: dict) -> dict | None:
        live = {s["id"]: s["months"] for s in manifest["segments"]}
        if any(live.get(i) != m for i, m in taken.items()):
            return None
        left = [{**s, "months": [m for m in s["months"] if s["id"] not in taken or m not in months]} for s in manifest["segments"]]
        base = {**segment, "kind": "base", "seq": last}
        return {**manifest, "segments": [base, *[s for s in left if s["months"]]]}

    return publish(spark, table, swap) is not None


def vacuum(spark: SparkSession, table: str, keep: int = 2, staged_before_ms: int = 0) -> int:
    """Delete manifests but the newest ``keep``, and segments that none of these names and that were
    staged before ``staged_before_ms`` (a running commit's segment is named by none yet). Their number."""
    known = versions(spark, table)
    named = {s["id"] for v in known[-keep:] for s in snapshot(spark, table, v)["segments"]}
    for version in known[:-keep]:
        place = _path(spark, table, "manifest", f"{version:020d}.json")
        _files(spark, place).delete(place, False)
    data = _path(spark, table, "data")
    gone = 0
    for status in _files(spark, data).listStatus(data) if known else []:
        segment = status.getPath().getName()
        if segment not in named and status.getModificationTime() < staged_before_ms:
            for part in ("data", "stats"):
                place = _path(spark, table, part, segment)
                _files(spark, place).delete(place, True)
            gone += 1
    return gone


# --- reading ---------------------------------------------------------------------


def _segment(spark: SparkSession, table: str, segment: dict, months: list[str] | None = None) -> DataFrame | None:
    """The rows of a segment's live months, with seq."""
    live = [m for m in segment["months"] if months is None or m in months]
    if not live:
        return None
    place = f"{table.rstrip('/')}/data/{segment['id']}"
    rows = spark.read.schema(SEGMENT).option("basePath", place).parquet(*[f"{place}/txn_month={m}" for m in live])
    return rows.withColumn("seq", F.lit(segment["seq"]).cast("long"))


def _union(frames: list[DataFrame | None]) -> DataFrame | None:
    whole = None
    for frame in frames:
        if frame is not None:
            whole = frame if whole is None else whole.unionByName(frame)
    return whole


def _folded(rows: DataFrame) -> DataFrame:
    """One row per key from its rows in several segments: the first describes it, the last decides."""
    fixed = [f.name for f in STORED.fields if f.name not in [*KEY, *DECISION_COLUMNS]]
    merged = rows.groupBy(*KEY).agg(
        F.min_by(F.struct(*fixed), "seq").alias("first"),
        F.max_by(F.struct(*DECISION_COLUMNS, "committed_at"), "seq").alias("last"),
        F.count("*").alias("writes"),
    )
    values = {c: F.col(f"last.{c}" if c in DECISION_COLUMNS else f"first.{c}") for c in [*fixed, *DECISION_COLUMNS]}
    values["updated_at"] = F.when(F.col("writes") > 1, F.col("last.committed_at")).otherwise(F.col("first.updated_at"))
    values["committed_at"] = F.col("last.committed_at")
    return merged.select(*KEY, *[v.alias(c) for c, v in values.items()])


def _upserted(base: DataFrame | None, deltas: DataFrame, several: bool) -> DataFrame:
    """``base`` (one row per key) with the rows of upserts merged in: its whole rows are moved once and its keys once
    more, or neither where the upserts are few enough to be broadcast. ``several``: a key may be in more than one upsert."""
    names = [f.name for f in SEGMENT.fields]
    last = (_folded(deltas) if several else deltas).select(names)
    if base is None:
        return last
    decided = last.select(*KEY, *[F.col(c).alias(f"new_{c}") for c in (*DECISION_COLUMNS, "committed_at")])
    met = base.select(names).join(decided, KEY, "left")
    hit = F.col("new_committed_at").isNotNull()
    values = {c: F.when(hit, F.col(f"new_{c}")).otherwise(F.col(c)) for c in (*DECISION_COLUMNS, "committed_at")}
    values["updated_at"] = F.when(hit, F.col("new_committed_at")).otherwise(F.col("updated_at"))
    changed = met.select([values.get(c, F.col(c)).alias(c) for c in names])
    known = base.select(*KEY).join(last.select(*KEY), KEY, "left_semi")
    return changed.unionByName(last.join(known, KEY, "left_anti"))


def _merged(spark: SparkSession, table: str, manifest: dict, months: list[str] | None = None) -> DataFrame | None:
    """All rows of a snapshot. Base rows of months without an upsert are read as they are."""
    names = [f.name for f in SEGMENT.fields]
    bases = [s for s in manifest["segments"] if s["kind"] == "base"]
    changes = [s for s in manifest["segments"] if s["kind"] == "delta"]
    deltas = _union([_segment(spark, table, s, months) for s in changes])
    if deltas is None:
        base = _union([_segment(spark, table, s, months) for s in bases])
        return None if base is None else base.select(names)
    touched = {m for s in changes for m in s["months"]}
    calm = _union([_segment(spark, table, s, [m for m in s["months"] if m not in touched and (not months or m in months)]) for s in bases])
    busy = _union([_segment(spark, table, s, [m for m in s["months"] if m in touched and (not months or m in months)]) for s in bases])
    return _union([None if calm is None else calm.select(names), _upserted(busy, deltas, len(changes) > 1)])


def read(spark: SparkSession, table: str, version: int | None = None, months: list[str] | None = None) -> DataFrame:
    """The table at the newest or an earlier version, or those months of it."""
    rows = _merged(spark, table, snapshot(spark, table, version), months)
    columns = [f.name for f in STORED.fields]
    return spark.createDataFrame([], STORED) if rows is None else rows.select(columns)


def stored_keys(spark: SparkSession, table: str, months: list[str] | None = None) -> DataFrame:
    """The primary keys of the table, or of those months of it; one may repeat. No upsert deletes, so a key that
    any live segment has is stored: nothing is merged, and two columns of the months' files are read."""
    parts = _union([_segment(spark, table, s, months) for s in snapshot(spark, table)["segments"]])
    return spark.createDataFrame([], STORED).select(*KEY) if parts is None else parts.select(*KEY)


def unstored(spark: SparkSession, table: str, rows: DataFrame) -> DataFrame:
    """The rows whose primary key is not in the table. The key holds the time and the time tells the month, so only
    files of the months of ``rows`` are opened; a null in the key is in no table."""
    found = rows.select(month_of(F.col("txn_timestamp"))).distinct().collect()
    return not_stored(rows, stored_keys(spark, table, [r[0] for r in found]))


def files_with(spark: SparkSession, table: str, segments: list[dict], condition: Column) -> list[str]:
    """The files of the segments' live months whose ranges satisfy ``condition``; they are found by a query over the
    ranges, and only their names come to the driver."""
    if not segments:
        return []
    stats = stats_of(spark, table, [s["id"] for s in segments]).withColumn("segment", F.regexp_extract("file", "/data/([0-9a-f]+)/", 1))
    live = [F.struct(F.lit(s["id"]).alias("segment"), F.lit(m).alias("txn_month")) for s in segments for m in s["months"]]
    alive = F.array_contains(F.array(*live), F.struct("segment", "txn_month"))
    return [r[0] for r in stats.filter(alive & condition).select("file").collect()]


def _opened(spark: SparkSession, table: str, segments: list[dict], condition: Column) -> DataFrame | None:
    parts = []
    for segment in segments:
        files = files_with(spark, table, [segment], condition)
        if files:
            place = f"{table.rstrip('/')}/data/{segment['id']}"
            rows = spark.read.schema(SEGMENT).option("basePath", place).parquet(*files)
            parts.append(rows.withColumn("seq", F.lit(segment["seq"]).cast("long")))
    return _union(parts)


def lookup(spark: SparkSession, table: str, column: str, value: str) -> DataFrame:
    """The rows whose ``column`` (card_hash or rrn) is ``value``, from the files that can hold them.

    An upsert may name another card or number than the row it changes, and the first one counts. So
    the rows of upserts that match are looked up by key too, in files that span their times.
    """
    manifest = snapshot(spark, table)
    bases = [s for s in manifest["segments"] if s["kind"] == "base"]
    changes = [s for s in manifest["segments"] if s["kind"] == "delta"]
    holds = (F.col(f"min_{column}") <= value) & (F.col(f"max_{column}") >= value)
    is_value = F.col(column) == value
    columns = [f.name for f in STORED.fields]
    opened = _opened(spark, table, bases, holds)
    found = None if opened is None else opened.filter(is_value)
    if changes:
        deltas = _union([_segment(spark, table, s) for s in changes])
        named = _opened(spark, table, changes, holds)
        if named is not None:
            named = named.filter(is_value)
            first, last = named.agg(F.min("txn_timestamp"), F.max("txn_timestamp")).first()
            if first is not None:
                spans = (F.col("min_txn_timestamp") <= F.lit(last)) & (F.col("max_txn_timestamp") >= F.lit(first))
                others = _opened(spark, table, bases, spans)
                if others is not None:
                    others = others.filter(~is_value | F.col(column).isNull()).join(named.select(*KEY).distinct(), KEY, "left_semi")
                    found = _union([found, others])
        keys = _union([None if f is None else f.select(*KEY) for f in (found, named)])
        if keys is not None:
            found = _union([found, deltas.join(keys.distinct(), KEY, "left_semi")])
    if found is None:
        return spark.createDataFrame([], STORED)
    return (_folded(found) if changes else found).select(columns).filter(is_value)


def date_range(spark: SparkSession, table: str, start: str, end: str) -> DataFrame:
    """Rows with start <= txn_timestamp < end, from the files whose times reach into the range."""
    manifest = snapshot(spark, table)
    begin, stop = F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))
    spans = (F.col("min_txn_timestamp") < stop) & (F.col("max_txn_timestamp") >= begin)
    segments = {kind: [s for s in manifest["segments"] if s["kind"] == kind] for kind in ("base", "delta")}
    opened = {kind: _opened(spark, table, found, spans) for kind, found in segments.items()}
    inside = {
        kind: None if rows is None else rows.filter((F.col("txn_timestamp") >= begin) & (F.col("txn_timestamp") < stop))
        for kind, rows in opened.items()
    }
    rows = inside["base"]
    if inside["delta"] is not None:
        rows = _upserted(rows, inside["delta"], len(segments["delta"]) > 1)
    columns = [f.name for f in STORED.fields]
    return spark.createDataFrame([], STORED) if rows is None else rows.select(columns)
