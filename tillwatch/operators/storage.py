"""The stored table: month layout, merge semantics and publishing.

Parquet has no MERGE, so an upsert rewrites the months it touches: the merged
rows are written next to the table first, then replace those months by dynamic
partition overwrite. A failed run leaves the old months or the staged copy, and
running it again gives the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from ..functions import columns as C
from ..functions import fixed_values as fv
from ..schemas import STORED
from ..session import new_table_path

KEY = ["txn_id", "txn_timestamp"]
DECISION_COLUMNS = ["status", "risk_score", "triggered_rules", "decision", "processed_at"]


def month_of(ts: Column) -> Column:
    """Month partition, 'yyyy-MM', or the default one outside the declared range."""
    month = F.date_format(ts, "yyyy-MM")
    return F.when(month.between(fv.FIRST_MONTH, fv.LAST_MONTH), month).otherwise(F.lit(fv.DEFAULT_MONTH))


def to_stored(results: DataFrame, now: Column, keep: tuple[str, ...] = ("batch_seq",)) -> DataFrame:
    """Result events as stored rows, with the columns in ``keep`` passed on.

    Unreadable transaction times become year 1, unreadable decision times ``now``.
    """
    zero = F.lit("0001-01-01 00:00:00").cast("timestamp")
    status = C.status_label(F.col("decision"))
    ts = C.parse_ts(F.col("txn_timestamp"), zero)
    extra = [c for c in keep if c in results.columns]
    return results.select(
        "txn_id", "card_hash", "masked_pan", "amount_minor", "currency", "merchant_id",
        C.transaction_type_label(F.col("transaction_type")).alias("transaction_type"),
        C.channel_label(F.col("channel")).alias("channel"),
        C.scheme_label(F.col("scheme")).alias("scheme"),
        "rrn", "terminal_id", "mcc",
        ts.alias("txn_timestamp"),
        status.alias("status"),
        "risk_score",
        F.to_json(F.coalesce("triggered_rules", F.array().cast("array<string>"))).alias("triggered_rules"),
        status.alias("decision"),
        C.parse_ts(F.col("processed_at"), now).alias("processed_at"),
        now.alias("created_at"),
        now.alias("updated_at"),
        month_of(ts).alias("txn_month"),
        *extra,
    )


def merge_rows(existing: DataFrame | None, incoming: DataFrame, now: Column) -> DataFrame:
    """Insert or update by primary key, as if ``incoming`` ran in ``batch_seq`` order.

    The first row of a key fixes the descriptive columns, the last one sets the
    decision columns. Both are aggregates, so many copies of one key collapse
    before the shuffle.
    """
    if "batch_seq" not in incoming.columns:
        incoming = incoming.withColumn("batch_seq", F.lit(1).cast("long"))
    rows = incoming
    if existing is not None:
        rows = existing.withColumn("batch_seq", F.lit(-1).cast("long")).unionByName(incoming)
    values = [c for c in rows.columns if c not in KEY + ["batch_seq"]]
    fixed = [c for c in values if c not in DECISION_COLUMNS]
    order = F.struct("batch_seq", "processed_at", "risk_score")
    merged = rows.groupBy(*KEY).agg(
        F.min_by(F.struct(*fixed), order).alias("first"),
        F.max_by(F.struct(*DECISION_COLUMNS), order).alias("last"),
        F.count("*").alias("writes"),
    )
    source = {c: F.col(f"last.{c}" if c in DECISION_COLUMNS else f"first.{c}") for c in values}
    source["updated_at"] = F.when(F.col("writes") > 1, now).otherwise(F.col("first.updated_at"))
    return merged.select(*KEY, *[source[c].alias(c) for c in values])


def write_table(rows: DataFrame, path: str, overwrite: str = "dynamic", balanced: bool = False) -> None:
    """Write whole months. Large months are split over tasks, small ones share files.

    ``dynamic`` replaces only the months in ``rows``, ``static`` the whole table. Rows that are ``balanced`` already,
    as read from a table written here, are not dealt anew.
    """
    rows = rows.select([f.name for f in STORED.fields])
    (
        (rows if balanced else rows.hint("rebalance", "txn_month"))
        .sortWithinPartitions("txn_month", "card_hash", "txn_timestamp")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", overwrite)
        .partitionBy("txn_month")
        .parquet(path)
    )


def union_of(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and no lineage to lose."""
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_if_present(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """The table at ``path``, or None before its first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def existing_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of ``paths`` that exist, asked one by one, so no parent folder is listed."""
    configuration = spark._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(configuration).exists(place):
            found.append(path)
    return found


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    return read_if_present(spark, path, STORED)


def upsert(spark: SparkSession, path: str, incoming: DataFrame, now: Column) -> None:
    """Merge ``incoming`` into the table at ``path``, rewriting only the months it touches.

    One writer per table: the staged copy next to it is reused by every upsert.
    """
    incoming = incoming.persist()
    try:
        _replace_months(spark, path, incoming, now)
    finally:
        incoming.unpersist()


def _replace_months(spark: SparkSession, path: str, incoming: DataFrame, now: Column) -> None:
    months = [row["txn_month"] for row in incoming.select("txn_month").distinct().collect()]
    if not months:
        return
    existing = read_table(spark, path)
    if existing is not None:
        existing = existing.filter(F.col("txn_month").isin(months))
    staged = f"{path.rstrip('/')}_staged"
    write_table(merge_rows(existing, incoming, now), staged, "static")
    write_table(spark.read.schema(STORED).parquet(staged), path, balanced=True)

