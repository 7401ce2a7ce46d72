"""The token bucket by tables against a bucket that is asked request by request."""

import random
from fractions import Fraction

import pytest

from tillwatch.operators import admission


def asked_one_by_one(requests, rate, burst):
    """{request_id: admitted}"""
    state, answers = {}, {}
    for client, ms, request in sorted(requests):
        tokens, last = state.get(client, (Fraction(burst), ms))
        tokens = min(Fraction(burst), tokens + Fraction(rate, 1000) * (ms - last))
        answers[request] = tokens >= 1
        state[client] = (tokens - 1 if tokens >= 1 else tokens, ms)
    return answers


@pytest.mark.parametrize(("rate", "burst"), [(100, 20), (7, 3), (1000, 1), (3000, 5)])
def test_equals_a_bucket_asked_one_by_one(spark, rate, burst):
    draw = random.Random(rate)
    rows, n = [], 0
    for client in ("hot", "calm", "burst"):
        ms = 1_700_000_000_000
        for _ in range(1500 if client == "hot" else 60):
            step = {"hot": draw.choice([0, 0, 1, 3, 9]), "calm": draw.randint(0, 4000), "burst": draw.choice([0] * 8 + [700])}[client]
            ms += step
            rows.append((client, ms, f"r{n:06d}"))
            n += 1
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "client_id string, ms long, request_id string").repartition(3)
    got = admission.per_request(df, rate, burst, block_ms=250, chunk=3)
    assert {r["request_id"]: r["admitted"] for r in got.collect()} == asked_one_by_one(rows, rate, burst)


def test_blocks_with_an_idle_fill_have_one_end(spark):
    import numpy as np
    import pandas as pd

    bucket = admission.Bucket(100, 20)
    every = np.arange(bucket.full + 1)
    idle = pd.DataFrame({"ms": [5, 300], "n": [1, 30]})
    table, _ = admission._through(bucket, every, idle, 0, 400)
    assert len(table) == 1 and table[0] == 100
    busy = pd.DataFrame({"ms": [5, 100], "n": [1, 2]})
    assert len(admission._through(bucket, every, busy, 0, 120)[0]) == bucket.full + 1


def test_no_requests(spark):
    none = spark.createDataFrame([], "client_id string, ms long, request_id string")
    assert admission.per_request(none, 100, 200).collect() == []
