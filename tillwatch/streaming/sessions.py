"""Episodes of failed scoring calls on a stream, with the time at which they open.

A session is kept as its start, end, number of failures and its few smallest times, which is all
that opening needs, however long the session. Such pieces merge in any order: two that touch are one,
with the smallest times of both. Each task first chains its own rows, so a dependency with
a third of the failures sends a few pieces per task, and the keyed state holds its open sessions only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import fixed_values as fv

PIECE = "dependency long, start_ms long, end_ms long, failures long, firsts array<long>"
SESSION = "dependency long, start_ms long, end_ms long, failures long, opened_ms long, is_episode boolean"

Piece = tuple[int, int, int, list[int]]


def merged(pieces: list[Piece], gap_ms: int, most: int) -> list[Piece]:
    """Pieces (start, end, failures, smallest times) less than ``gap_ms`` apart as one, in order."""
    out: list[Piece] = []
    for start, end, n, firsts in sorted(pieces, key=lambda p: p[:2]):
        if out and start - out[-1][1] < gap_ms:
            first, last, count, times = out[-1]
            out[-1] = (first, max(last, end), count + n, sorted([*times, *firsts])[:most])
        else:
            out.append((start, end, n, sorted(firsts)[:most]))
    return out


def _chained(gap_ms: int, most: int):
    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows = rows.sort_values(["dependency", "ms"])
            apart = rows["ms"].diff().ge(gap_ms) | rows["dependency"].ne(rows["dependency"].shift())
            grouped = rows.groupby(apart.cumsum())
            ends = grouped.agg(dependency=("dependency", "first"), start_ms=("ms", "min"), end_ms=("ms", "max"), failures=("ms", "size"))
            firsts = grouped["ms"].apply(lambda times: times.head(most).tolist())
            yield ends.assign(firsts=firsts)

    return chain


class SessionProcessor(StatefulProcessor):
    def __init__(self, gap_ms: int, threshold: int) -> None:
        self.gap_ms, self.threshold = gap_ms, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "start_ms long, end_ms long, failures long, firsts array<long>")

    def _given_out(self, key, pieces: list[Piece]) -> Iterator[pd.DataFrame]:
        if pieces:
            opened = [firsts[self.threshold - 1] if n >= self.threshold else None for _, _, n, firsts in pieces]
            yield pd.DataFrame({
                "dependency": key[0], "start_ms": [p[0] for p in pieces], "end_ms": [p[1] for p in pieces],
                "failures": [p[2] for p in pieces], "opened_ms": pd.array(opened, dtype="Int64"),
                "is_episode": [time is not None for time in opened],
            })

    def _kept(self, pieces: list[Piece], watermark: int) -> tuple[list[Piece], list[Piece]]:
        """(finished, still open); the open ones are stored."""
        finished = [p for p in pieces if p[1] + self.gap_ms <= watermark]
        left = [p for p in pieces if p[1] + self.gap_ms > watermark]
        if left:
            self.open.put(left)
        else:
            self.open.clear()
        return finished, left

    def _stored(self) -> list[Piece]:
        return [(start, end, n, list(firsts)) for start, end, n, firsts in self.open.get()]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pieces = self._stored()
        for part in rows:
            columns = ["start_ms", "end_ms", "failures", "firsts"]
            pieces += [(int(s), int(e), int(n), [int(t) for t in f]) for s, e, n, f in part[columns].itertuples(index=False)]
        # a late piece that touches no open session is a session of its own
        finished, left = self._kept(merged(pieces, self.gap_ms, self.threshold), timerValues.getCurrentWatermarkInMs())
        for piece in left:
            self.handle.registerTimer(piece[1] + self.gap_ms)
        yield from self._given_out(key, finished)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        finished, _ = self._kept(self._stored(), timerValues.getCurrentWatermarkInMs())
        yield from self._given_out(key, finished)

    def close(self) -> None:
        pass


def failure_sessions(
    failures: DataFrame, ts: str = "ts", delay: str = "10 minutes",
    gap_ms: int = fv.FAILURE_GAP_MS, threshold: int = fv.FAILURE_THRESHOLD,
) -> DataFrame:
    """``failures`` (dependency, ms and the event time ``ts``), a stream, to one row per session, as the batch operator
    gives it; final once the watermark has passed its end. Needs the RocksDB state store."""
    rows = failures.withWatermark(ts, delay).select(ts, "dependency", "ms")
    pieces = rows.mapInPandas(_chained(gap_ms, threshold), PIECE)
    return pieces.groupBy("dependency").transformWithStateInPandas(
        SessionProcessor(gap_ms, threshold), SESSION, outputMode="append", timeMode="eventTime"
    )
