"""Grouped operators against plain Python, with one key holding most rows."""

import random
from collections import defaultdict

import pytest

from tillwatch.functions import fixed_values as fv
from tillwatch.operators import dedup, joins, sessions, velocity
from tillwatch.session import new_table_path
from tillwatch.streaming import idempotency as stream_idempotency

HOUR = fv.HOUR_MS


def timeline(seed, n, span):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        card = "busy" if rnd.random() < 0.6 else f"c{rnd.randrange(5)}"
        ms = 1_700_000_000_000 + rnd.randrange(span)
        if rnd.random() < 0.3:
            ms -= ms % 60_000
        rows.append((f"t{i:05d}", card, ms, rnd.randrange(1, 10**6), f"m{rnd.randrange(12)}", f"p{rnd.randrange(8)}"))
    return rows


def brute_velocity(rows):
    by_card = defaultdict(list)
    for r in rows:
        by_card[r[1]].append(r)
    out = {}
    for txn, card, ms, *_ in rows:
        mine = by_card[card]

        def within(w):
            return [r for r in mine if ms - w < r[2] <= ms]

        bucket = [r for r in mine if r[2] // 300000 == ms // 300000 and r[2] <= ms]
        out[txn] = (
            len(within(60000)), len(within(300000)), len(within(HOUR)),
            sum(r[3] for r in within(60000)), sum(r[3] for r in within(HOUR)),
            len({r[4] for r in bucket}), len({r[5] for r in bucket}),
        )
    return out


SCHEMA = "txn_id string, card_hash string, ms long, amount_minor long, merchant_id string, terminal_id string"


def spark_velocity(spark, rows, block_ms):
    df = velocity.with_velocity(spark.createDataFrame(rows, SCHEMA), block_ms)
    return {r["txn_id"]: tuple(r[c] for c in velocity.VELOCITY_COLUMNS) for r in df.collect()}


@pytest.mark.parametrize("seed,span,block", [(1, 4 * HOUR, HOUR), (2, 30 * HOUR, 4 * HOUR), (3, 600_000, HOUR)])
def test_velocity_equals_brute_force(spark, seed, span, block):
    rows = timeline(seed, 700, span)
    assert spark_velocity(spark, rows, block) == brute_velocity(rows)


def test_velocity_window_edges(spark):
    t = 1_700_000_100_000 - 1_700_000_100_000 % HOUR  # a block and bucket edge
    rows = [
        ("a", "c", t - 60000, 1, "m1", "p1"), ("b", "c", t - 59999, 2, "m1", "p1"),
        ("d", "c", t, 4, "m2", "p1"), ("e", "c", t, 8, "m3", "p1"), ("f", "c", t + HOUR, 16, "m3", "p1"),
    ]
    got = spark_velocity(spark, rows, HOUR)
    assert got["d"] == got["e"] == (3, 4, 4, 14, 15, 2, 1)
    assert got["f"] == (1, 1, 1, 16, 16, 1, 1)
    assert got == brute_velocity(rows)


def test_velocity_rejects_partial_hours(spark):
    with pytest.raises(ValueError):
        velocity.velocity_by_ms(spark.createDataFrame([], SCHEMA), 1000)


def test_velocity_never_groups_by_card_alone(spark):
    plan = velocity.velocity_by_ms(spark.createDataFrame(timeline(4, 50, HOUR), SCHEMA))
    text = plan._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 2
    assert all("block" in e or "slot" in e for e in exchanges)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def brute_originals(rows, ttl):
    out, origin = {}, {}
    for key, ms, txn in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if key not in origin or ms - origin[key][0] >= ttl:
            origin[key] = (ms, txn)
        out[txn] = origin[key][1]
    return out


def request_rows(seed, n, days):
    rnd = random.Random(seed)
    return [
        ("busy" if rnd.random() < 0.6 else f"k{rnd.randrange(8)}", 1_700_000_000_000 + rnd.randrange(days * 864) * 100_000, f"t{i:05d}")
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", [0, 30])
def test_idempotency_equals_brute_force(spark, seed):
    rows = request_rows(seed, 500, 9)
    df = spark.createDataFrame(rows, "idempotency_key string, ms long, txn_id string")
    got = dedup.with_original(df).collect()
    expected = brute_originals(rows, fv.DAY_MS)
    assert {r["txn_id"]: r["original_txn_id"] for r in got} == expected
    assert len(got) == len(rows)
    assert all(r["is_duplicate"] == (r["txn_id"] != r["original_txn_id"]) for r in got)
    firsts = dedup.first_requests(df).collect()
    assert {r["txn_id"] for r in firsts} == set(expected.values())


@pytest.mark.parametrize("seed", [3, 4])
def test_idempotency_over_many_spans_of_hours(spark, seed):
    """Requests years long, before 1970 too: windows over hours run per key and span, and no hour goes by its key alone."""
    rnd = random.Random(seed)
    span = dedup.SPAN * 25 * fv.HOUR_MS
    rows = []
    for n in range(400):
        # about the edges of spans, close together and far apart
        ms = rnd.randrange(-4, 6) * span + rnd.choice([rnd.randrange(-2 * fv.DAY_MS, 2 * fv.DAY_MS), rnd.randrange(span)])
        rows.append(("busy" if n % 2 else f"k{n % 3}", ms // 60_000 * 60_000, f"t{n:05d}"))
    df = spark.createDataFrame(rows, "idempotency_key string, ms long, txn_id string")
    assert {r["txn_id"]: r["original_txn_id"] for r in dedup.with_original(df).collect()} == brute_originals(rows, fv.DAY_MS)


def test_idempotency_edge(spark):
    t = 1_700_000_000_000
    rows = [("k", t, "a"), ("k", t, "b"), ("k", t + 86399999, "c"), ("k", t + 86400000, "d"), ("k", t + 86400001, "e"),
            ("k", t + 5 * 86400000 + 7, "f")]
    df = spark.createDataFrame(rows, "idempotency_key string, ms long, txn_id string")
    got = {r["txn_id"]: r["original_txn_id"] for r in dedup.with_original(df).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f"}


def brute_sessions(rows, gap, threshold):
    out = []
    for dep in {d for d, _ in rows}:
        times, cur = sorted(ms for d, ms in rows if d == dep), []
        for ms in times + [None]:
            if cur and (ms is None or ms - cur[-1] >= gap):
                opened = cur[threshold - 1] if len(cur) >= threshold else None
                out.append((dep, cur[0], cur[-1], len(cur), opened, opened is not None))
                cur = []
            if ms is not None:
                cur.append(ms)
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [40_000, HOUR])
def test_sessions_equal_brute_force(spark, block):
    rnd = random.Random(block)
    rows = [(0 if rnd.random() < 0.6 else rnd.randrange(1, 5), 1_700_000_000_000 + rnd.randrange(6000) * 1000) for _ in range(500)]
    rows += [(9, 1_700_000_000_000), (9, 1_700_000_000_000 + 29_999), (9, 1_700_000_000_000 + 59_999)]
    df = spark.createDataFrame(rows, "dependency long, ms long")
    got = sessions.failure_sessions(df, block_ms=block)
    cols = ["dependency", "start_ms", "end_ms", "failures", "opened_ms", "is_episode"]
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr) == brute_sessions(rows, 30_000, 5)


def test_sketched_buckets_are_close(spark):
    rows = [(f"t{i}", "c", 1_700_000_000_000 + i % 50, 1, f"m{i % 3000}", f"p{i % 40}") for i in range(6000)]
    row = velocity.bucket_distinct_approx(spark.createDataFrame(rows, SCHEMA)).first()
    assert abs(row["unique_merchants_5min"] - 3000) <= 3000 * 0.0081 * 4
    assert abs(row["unique_terminals_5min"] - 40) <= 1


def test_copies_do_not_multiply(spark):
    ids = spark.createDataFrame([("a",), ("a",), ("b",), ("z",)], "txn_id string")
    submitted = spark.createDataFrame([("a", "T1")] * 50 + [("b", "T2")], "txn_id string, txn_timestamp string")
    results = spark.createDataFrame(
        [("a", 1, 300, "P1")] * 50 + [("a", 2, 800, "P2")], "txn_id string, decision int, risk_score int, processed_at string"
    )
    got = sorted(tuple(r) for r in joins.status_lookup(ids, submitted, results).collect())
    declined = ("a", "DECLINED", "DECLINE", 800, "T1", "P2")
    assert got == [declined, declined, ("b", "PENDING", "", 0, "T2", ""), ("z", "NOT_FOUND", "", 0, "", "")]


def test_chains_begin_anew_after_a_day_without_requests(spark):
    """A link to a stamp that nothing can cover is not followed, and a stamp finds its original in an earlier hour."""
    day, hour = fv.DAY_MS, fv.HOUR_MS
    times = [0, 5 * hour, day, day + 1, 2 * day - 1, 2 * day, 2 * day + 1, 4 * day, 5 * day - 1, 6 * day, 6 * day + 23 * hour]
    rows = [("k", t, f"t{n:02d}") for n, t in enumerate(times)] + [("other", 7, "o")]
    requests = spark.createDataFrame(rows, "idempotency_key string, ms long, txn_id string")
    stamps = requests.select("idempotency_key", "ms")
    found = {(r["ms"], r["next_ms"]) for r in dedup.links(stamps).filter("idempotency_key = 'k'").collect()}
    # from 2 days + 1 ms on the next stamp a day later is at 4 days, and nothing covers that one
    assert {(0, None), (4 * day, None), (6 * day, None)} <= found
    assert not [x for x in found if x[1] in (4 * day, 6 * day)]
    got = {(r["idempotency_key"], r["ms"]): r["original_txn_id"] for r in dedup.with_original(requests).collect()}
    origin, last = {}, {}
    for key, ms, txn in rows:
        if key not in last or ms - last[key][0] >= day:
            last[key] = (ms, txn)
        origin[key, ms] = last[key][1]
    assert got == origin
    plan = dedup.with_original(requests)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # no original is sent to every hour it covers


def test_stream_originals_come_from_the_written_requests(spark, monkeypatch):
    """The chain of a micro-batch is followed once: its originals are read back."""
    sources = {}
    plain = stream_idempotency.put_batch
    monkeypatch.setattr(
        stream_idempotency, "put_batch",
        lambda df, path, batch_id, *by: sources.update({(path.split("/")[-1], batch_id): df.inputFiles()}) or plain(df, path, batch_id, *by),
    )
    job = stream_idempotency.IdempotencyJob(new_table_path(spark, "idempotency"))
    schema, rows = "idempotency_key string, ms long, txn_id string", request_rows(5, 200, 9)
    rows.sort(key=lambda r: r[1])
    for n, part in enumerate((rows[:100], [], rows[100:])):
        job(spark.createDataFrame(part, schema), n)
    assert all("/requests/batch_id=0/" in f for f in sources["origins", 0]) and sources["origins", 0]
    got = spark.read.parquet(f"{job.folder}/requests")
    assert {r["txn_id"]: r["original_txn_id"] for r in got.collect()} == brute_originals(rows, fv.DAY_MS)
