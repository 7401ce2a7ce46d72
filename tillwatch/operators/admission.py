"""Admission audit: which requests a token bucket per client would have refused.

A bucket's next state depends on the one before, request by request, but it has few states: tokens are
whole multiples of a fixed part. So a block of time is a table from the state at its
start to the state at its end, and tables compose: blocks into chunks, chunks along a client. What is then
known at the start of every chunk is handed down to its blocks and to their milliseconds. A task gets one
block's milliseconds, one chunk's blocks or one client's chunks, never a client's requests.
A block with an idle time in which the bucket fills has one end for all starts, and a table of one entry.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import new_table_path

#: Milliseconds of a block, and blocks of a chunk.
BLOCK_MS, CHUNK = 60_000, 60


def _written(df: DataFrame, name: str) -> DataFrame:
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Bucket:
    """``rate`` tokens a second up to ``burst``; a request takes one. State counts parts of a token, so that a
    millisecond refills a whole number of them."""

    rate: int
    burst: int

    @property
    def cost(self) -> int:
        return 1000 // gcd(self.rate, 1000)

    @property
    def refill(self) -> int:
        return self.rate // gcd(self.rate, 1000)

    @property
    def full(self) -> int:
        return self.burst * self.cost

    def after(self, state, elapsed_ms: int):
        return np.minimum(state + self.refill * min(elapsed_ms, -(-self.full // self.refill)), self.full)

    def admitted(self, state, n: int):
        return np.minimum(state // self.cost, n)


def _through(bucket: Bucket, start, members: pd.DataFrame, begin: int, end: int):
    """(state at ``end``, admitted per millisecond) from ``start`` at ``begin``, one state or all of them at once."""
    state, now, admitted = start, begin, []
    for ms, n in zip(members["ms"], members["n"]):
        state = bucket.after(state, int(ms) - now)
        if np.ndim(state) and state[0] == state.min() == state.max():
            state = state[:1]  # every start has led here
        took = bucket.admitted(state, int(n))
        admitted.append(took)
        state, now = state - took * bucket.cost, int(ms)
    return bucket.after(state, end - now), admitted


def _at(table: np.ndarray, state: int) -> int:
    return int(table[0] if len(table) == 1 else table[state])


def _composed(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    return then if len(then) == 1 else then[first]


def per_request(
    requests: DataFrame, rate: int, burst: int, block_ms: int = BLOCK_MS, chunk: int = CHUNK
) -> DataFrame:
    """``requests`` (client_id, ms, request_id) with ``admitted``.

    A client's bucket is full before its first request. Requests of a client in one millisecond are
    taken in the order of request_id, which tells requests apart. Refused requests take nothing. The tables of the
    blocks and the room of each millisecond are written to the shared folder.
    """
    bucket = Bucket(rate, burst)
    span = block_ms * chunk
    key = [F.col("client_id"), F.expr(f"ms div {block_ms}").alias("block")]
    per_ms = requests.groupBy("client_id", "ms").agg(F.count("*").alias("n"))
    every = np.arange(bucket.full + 1, dtype=np.int64)

    def summary(members: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values("ms")
        block = int(members["ms"].iloc[0]) // block_ms
        table, _ = _through(bucket, every, members, block * block_ms, (block + 1) * block_ms)
        return pd.DataFrame({"client_id": members["client_id"].iloc[:1].to_numpy(), "block": [block], "ends": [table.tolist()]})

    # read twice, on the way up and on the way down
    blocks = _written(per_ms.groupBy(*key).applyInPandas(summary, "client_id string, block long, ends array<int>"), "blocks")

    def along(members: pd.DataFrame, column: str, width: int, begin: int, start) -> list:
        """The states before each member's time (number in ``column``, of ``width``), from ``start`` at ``begin``."""
        state, now, states = start, begin, []
        for number, ends in zip(members[column], members["ends"]):
            state = bucket.after(state, int(number) * width - now)
            states.append(state)
            table = np.asarray(ends, dtype=np.int64)
            state = _composed(state, table) if np.ndim(state) else _at(table, state)
            now = (int(number) + 1) * width
        return [*states, bucket.after(state, max(begin + span, now) - now)]

    def chunk_summary(members: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values("block")
        number = int(members["block"].iloc[0]) // chunk
        ends = along(members, "block", block_ms, number * span, every)[-1]
        return pd.DataFrame({"client_id": members["client_id"].iloc[:1].to_numpy(), "chunk": [number], "ends": [ends.tolist()]})

    in_chunks = blocks.withColumn("chunk", F.expr(f"block div {chunk}"))
    chunks = in_chunks.groupBy("client_id", "chunk").applyInPandas(chunk_summary, "client_id string, chunk long, ends array<int>")

    def chunk_starts(members: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values("chunk")
        states = along(members, "chunk", span, int(members["chunk"].iloc[0]) * span, bucket.full)
        return members[["client_id", "chunk"]].assign(state=[int(s) for s in states[:-1]])

    starts = chunks.groupBy("client_id").applyInPandas(chunk_starts, "client_id string, chunk long, state int")

    def block_starts(members: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values("block")
        state, number = int(start["state"].iloc[0]), int(start["chunk"].iloc[0])
        states = along(members, "block", block_ms, number * span, state)
        return members[["client_id", "block"]].assign(state=[int(s) for s in states[:-1]])

    block_state = in_chunks.groupBy("client_id", "chunk").cogroup(starts.groupBy("client_id", "chunk")).applyInPandas(
        block_starts, "client_id string, block long, state int"
    )

    def admit(members: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values("ms")
        block = int(start["block"].iloc[0])
        _, admitted = _through(bucket, int(start["state"].iloc[0]), members, block * block_ms, (block + 1) * block_ms)
        return members[["client_id", "ms"]].assign(room=[int(a) for a in admitted])

    rooms = per_ms.groupBy(*key).cogroup(block_state.groupBy("client_id", "block")).applyInPandas(
        admit, "client_id string, ms long, room int"
    )
    rooms = _written(rooms, "rooms")
    # no more than ``burst`` requests of a millisecond can be admitted, so no task ranks more of one than that
    first = Window.partitionBy("client_id", "ms").orderBy("request_id")
    early = requests.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= burst)
    taken = early.join(rooms, ["client_id", "ms"]).filter(F.col("place") <= F.col("room"))
    taken = taken.select("client_id", "ms", "request_id", F.lit(True).alias("admitted"))
    return requests.join(taken, ["client_id", "ms", "request_id"], "left").withColumn("admitted", F.coalesce("admitted", F.lit(False)))
