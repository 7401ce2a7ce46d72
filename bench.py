"""Headline timings: median of three runs after one warm-up, one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the number of cores.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import tempfile
import time

from pyspark.sql import functions as F

from tillwatch.operators import reports, storage, velocity
from tillwatch.plans import queries as q
from tillwatch.session import local_session, new_table_path
from tillwatch.sources import readers
from tillwatch.sources import sample_data as sd
from tillwatch.streaming.velocity import VelocityJob

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(spark, make) -> int:
    """Shuffle exchanges of any kind in the plan as it is for tables too large to broadcast by estimate."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        nodes = re.findall(r"^[\s:+*\-()0-9]*(\w*Exchange)\b", plan_text(make()), flags=re.M)
        return sum(node not in ("BroadcastExchange", "ReusedExchange") for node in nodes)
    finally:
        spark.conf.set(key, before)


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def median_of(action) -> float:
    action()
    return statistics.median(timed(action) for _ in range(RUNS))


def main() -> None:
    work = tempfile.mkdtemp(prefix="run-")
    spark = local_session(CPUS, os.environ.get("BENCH_MEMORY", "16g"), **{
        "spark.checkpoint.dir": work,
        "spark.sql.shuffle.partitions": CPUS if CPUS.isdigit() else "8",
    })
    n = sd.table(spark, SF_DIR, "events").count()

    frames = {
        "w01_w07_velocity": lambda: velocity.with_velocity(q.vms_transactions(spark, SF_DIR)),
        "v11_validate": lambda: q.v11(spark, SF_DIR),
        "p04_card_hash": lambda: q.QUERIES["p04_card_hash"](spark, SF_DIR),
        "r09_triggered_rules": lambda: q.r09(spark, SF_DIR),
        "j01_merchant_risk": lambda: q.j01(spark, SF_DIR),
        "w11_idempotency": lambda: q.w11(spark, SF_DIR),
        "s03_payload_decode": lambda: q.s03(spark, SF_DIR),
        "s08_merge": lambda: q.merged_rows(spark, SF_DIR),
        "t03_latest_per_card": lambda: q.t03(spark, SF_DIR),
        "a03_score_histogram_by_decision": lambda: reports.score_histogram_by_decision(q.scored(spark, SF_DIR)),
        "a15_failure_sessions": lambda: q.QUERIES["a15_failure_sessions"](spark, SF_DIR),
        "c10_score_transactions": lambda: q.c10(spark, SF_DIR),
    }
    seconds, plans = {}, {}
    for name, make in frames.items():
        seconds[name] = median_of(lambda: make().write.format("noop").mode("overwrite").save())
        plans[name] = shuffles(spark, make)

    existing, incoming = q.upsert_sets(spark, SF_DIR)
    table = new_table_path(spark, "table")
    storage.upsert(spark, table, existing, q.now())
    seconds["s08_upsert_table"] = median_of(lambda: storage.upsert(spark, table, incoming, q.now()))

    txns = q.vms_transactions(spark, SF_DIR).drop("ts")
    arrivals = new_table_path(spark, "arrivals")
    first, last = txns.agg(F.min("ms"), F.max("ms")).first()
    step = (last - first) // 4 + 1
    for k in range(4):
        part = txns.filter((F.col("ms") >= first + k * step) & (F.col("ms") < first + (k + 1) * step))
        part.coalesce(1).write.mode("append").parquet(arrivals)

    def stream():
        job = VelocityJob(new_table_path(spark, "velocity"))
        source = readers.stream_files(spark, arrivals, txns.schema, files_per_trigger=1)
        job.start(source, new_table_path(spark, "cp"), availableNow=True).awaitTermination(300)

    stream()
    seconds["x01_stream_velocity"] = timed(stream)

    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in seconds.items()},
        "rows_per_second": {k: round(n / v) for k, v in seconds.items()},
        "shuffles": plans,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "rows": n,
        "cpus": CPUS,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
