"""Velocity from keyed state: windows put together from five-minute panes.

State is kept per group of cards and hour, never per card: in an hour's state, the rows of each pane
and what windows need of them, added up per card and millisecond. A row goes to its own hour and, without
its texts, to the next, which its windows reach; each key is then complete in itself. What arrives
together for a pane is one value of the state, a column batch, and a pane's windows are computed for
all cards of its group at once, so calls to the state store follow groups, panes and micro-batches, not cards or rows.

When the watermark passes the end of a pane, a timer puts its windows together, gives out its
rows and drops them; the last timer of an hour clears the rest. The order in which rows arrived does not matter, so long as they come before
the watermark; a row that comes after its pane was given out is given out as late.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import fixed_values as fv
from ..operators.velocity import LONG_COLUMNS, VELOCITY_COLUMNS

PANE_MS = fv.FIVE_MINUTES_MS
#: Panes that a window of an hour reaches back.
REACH = fv.HOUR_MS // PANE_MS
#: Time of one state, and groups of cards. A checkpoint holds state by both.
BLOCK_MS, GROUPS = fv.HOUR_MS, 128
#: Rows of one key gathered before they are put into its state.
GATHER = 100_000

_OWN, _FACTS = 0, 1
#: Block of rows without a time; a null in a batch would turn all its blocks into floats.
_NO_TIME = -(1 << 62)
_ROWS = pa.schema([(c, pa.string()) for c in ("card_hash", "txn_id", "merchant_id", "terminal_id")] + [("ms", pa.int64()), ("amount", pa.int64())])
RESULT = "card_hash string, txn_id string, ms long, " + ", ".join(
    f"{c} {'long' if c in LONG_COLUMNS else 'int'}" for c in VELOCITY_COLUMNS
) + ", is_late boolean"
_COLUMNS = [field.split()[0] for field in RESULT.split(", ")]
#: Slots of a card: the times that windows of one pane reach, and one before them.
_SPAN = (REACH + 1) * PANE_MS + 1


def _codes(values: pa.ChunkedArray) -> np.ndarray:
    """A number for each distinct value, null among them."""
    coded = values.combine_chunks().dictionary_encode(null_encoding="encode")
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _slots(cards: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Places on one line where each card has a stretch of its own; ``times`` from -1 (before all)."""
    return cards * _SPAN + 1 + times


def _distinct_so_far(cards: np.ndarray, times: np.ndarray, items: pa.ChunkedArray) -> np.ndarray:
    """For each row, the items of its card seen up to its time; null is none."""
    codes, known = _codes(items), items.is_valid().to_numpy()
    pair = cards * (codes.max() + 1) + codes
    order = np.lexsort((times, pair))
    order = order[known[order]]
    first = order[np.diff(pair[order], prepend=-1) != 0]
    seen = np.sort(_slots(cards[first], times[first]))
    before = np.searchsorted(seen, _slots(cards, np.full(len(cards), -1)), side="right")
    return np.searchsorted(seen, _slots(cards, times), side="right") - before


def windows(own: pa.Table, facts: pa.Table, pane: int) -> pd.DataFrame:
    """The velocity of a pane's rows ``own`` (card_hash, txn_id, ms, merchant_id, terminal_id), given the ``facts``
    (card_hash, ms, n, amount) of this pane and the ``REACH`` panes before."""
    start = (pane - REACH) * PANE_MS
    codes = _codes(pa.chunked_array([*own["card_hash"].chunks, *facts["card_hash"].chunks], pa.string()))
    cards, at = codes[: len(own)], own["ms"].to_numpy() - start
    times = _slots(codes[len(own) :], facts["ms"].to_numpy() - start)
    order = np.argsort(times, kind="stable")
    times = times[order]
    until = np.searchsorted(times, _slots(cards, at), side="right")
    since = {w: np.searchsorted(times, _slots(cards, at - w), side="right") for w in (fv.MINUTE_MS, PANE_MS, fv.HOUR_MS)}
    counts, amounts = (np.concatenate(([0], np.cumsum(facts[c].to_numpy()[order]))) for c in ("n", "amount"))
    return pd.DataFrame({
        "card_hash": own["card_hash"].to_pandas(), "txn_id": own["txn_id"].to_pandas(), "ms": own["ms"].to_numpy(),
        "txn_count_1min": counts[until] - counts[since[fv.MINUTE_MS]],
        "txn_count_5min": counts[until] - counts[since[PANE_MS]],
        "txn_count_1hr": counts[until] - counts[since[fv.HOUR_MS]],
        "amount_sum_1min": amounts[until] - amounts[since[fv.MINUTE_MS]],
        "amount_sum_1hr": amounts[until] - amounts[since[fv.HOUR_MS]],
        "unique_merchants_5min": _distinct_so_far(cards, at, own["merchant_id"]),
        "unique_terminals_5min": _distinct_so_far(cards, at, own["terminal_id"]),
    })


def _without_windows(rows: pd.DataFrame, is_late: bool) -> pd.DataFrame:
    out = rows[["card_hash", "txn_id", "ms"]].astype({"ms": "Int64"})
    return out.assign(**{c: 0 for c in VELOCITY_COLUMNS}, is_late=is_late)


def _by_pane(table: pa.Table) -> Iterator[tuple[int, pa.Table]]:
    panes = table["ms"].to_numpy() // PANE_MS
    order = np.argsort(panes, kind="stable")
    panes, table = panes[order], table.take(order)
    cuts = [0, *(np.flatnonzero(np.diff(panes)) + 1).tolist(), len(panes)]
    for low, high in zip(cuts, cuts[1:]):
        if high > low:
            yield int(panes[low]), table.slice(low, high - low)


class PaneProcessor(StatefulProcessor):
    """State of a group of cards in one block of time: parts, each the rows of a pane that came together (``_OWN``)
    or the sums per card and millisecond of a pane of this or the last block (``_FACTS``)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # ``since``: the watermark when the part came; panes that ended before do not see it
        self.parts = handle.getMapState("parts", "kind int, pane long, part int", "since long, data binary")
        self.count = handle.getValueState("count", "n int")

    def _put(self, kind: int, pane: int, since: int, table: pa.Table) -> None:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        self.parts.updateValue((kind, pane, self.n), (since, sink.getvalue().to_pybytes()))
        self.n += 1

    def _got(self, keys: list[tuple], end: int) -> pa.Table:
        """The parts ``keys`` that a pane until ``end`` sees."""
        found = [self.parts.getValue(key) for key in keys]
        return pa.concat_tables([pa.ipc.open_stream(bytes(data)).read_all() for since, data in found if since < end])

    def _gathered(self, rows: list[pd.DataFrame], block: int, watermark: int) -> Iterator[pd.DataFrame]:
        """Put ``rows`` into the state; those whose pane was given out before are late."""
        table = pa.Table.from_pandas(pd.concat(rows), _ROWS, preserve_index=False)
        ms = table["ms"].to_numpy()
        own = ms // BLOCK_MS == block
        late = own & ((ms // PANE_MS + 1) * PANE_MS <= watermark)
        if late.any():
            yield _without_windows(table.filter(pa.array(late)).to_pandas(), True)
        if (block + 1) * BLOCK_MS <= watermark:
            return
        for pane, part in _by_pane(table.filter(pa.array(own & ~late)).drop_columns("amount")):
            self._put(_OWN, pane, watermark, part)
            self.handle.registerTimer((pane + 1) * PANE_MS)
        facts = table.select(["card_hash", "ms", "amount"]).append_column("n", pa.array(np.ones(len(table), np.int64)))
        facts = facts.group_by(["card_hash", "ms"]).aggregate([("n", "sum"), ("amount", "sum")])
        for pane, part in _by_pane(facts.select(["card_hash", "ms", "n_sum", "amount_sum"]).rename_columns(["card_hash", "ms", "n", "amount"])):
            self._put(_FACTS, pane, watermark, part)
        self.handle.registerTimer((block + 1) * BLOCK_MS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[1] == _NO_TIME:  # in no window
            for part in rows:
                yield _without_windows(part, False)
            return
        block, watermark = key[1], timerValues.getCurrentWatermarkInMs()
        before = self.n = self.count.get()[0] if self.count.exists() else 0
        held: list[pd.DataFrame] = []
        for part in rows:
            held.append(part)
            if sum(map(len, held)) >= GATHER:
                yield from self._gathered(held, block, watermark)
                held = []
        if held:
            yield from self._gathered(held, block, watermark)
        if self.n > before:
            self.count.update((self.n,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        keys = [tuple(k) for k in self.parts.keys()]
        for pane in sorted({p for kind, p, _ in keys if kind == _OWN and (p + 1) * PANE_MS <= now}):
            end, mine = (pane + 1) * PANE_MS, [k for k in keys if k[0] == _OWN and k[1] == pane]
            facts = self._got([k for k in keys if k[0] == _FACTS and pane - REACH <= k[1] <= pane], end)
            yield windows(self._got(mine, end), facts, pane).assign(is_late=False)[_COLUMNS]
            for k in mine:
                self.parts.removeKey(k)
        if now >= (key[1] + 1) * BLOCK_MS:
            self.parts.clear()
            self.count.clear()

    def close(self) -> None:
        pass


def pane_velocity(txns: DataFrame, ts: str = "clock", lateness: str = "1 hour", groups: int = GROUPS) -> DataFrame:
    """``txns`` (card_hash, txn_id, ms, amount_minor, merchant_id, terminal_id and the event time ``ts``), a stream, as
    rows (card_hash, txn_id, ms, velocity columns, is_late), given out once the watermark has passed their pane.

    Late rows, and at once rows without ``ms``, have zeros for velocity. Late rows
    changed no row given out. Needs the RocksDB state store; a checkpoint keeps its number of ``groups``.
    """
    own = F.expr(f"ms div {BLOCK_MS}")
    last = F.expr(f"(ms + {fv.HOUR_MS - 1}) div {BLOCK_MS}")
    blocks = F.explode(F.coalesce(F.sequence(own, last), F.array(F.lit(_NO_TIME)))).alias("block")
    here = F.col("ms").isNull() | (F.col("block") == own)
    return (
        txns.withWatermark(ts, lateness)
        .select("card_hash", "txn_id", "ms", F.coalesce(F.col("amount_minor").cast("long"), F.lit(0)).alias("amount"), "merchant_id", "terminal_id", blocks)
        .withColumns({c: F.when(here, F.col(c)) for c in ("txn_id", "merchant_id", "terminal_id")})
        .withColumn("group", F.pmod(F.xxhash64("card_hash"), F.lit(groups)).cast("int"))
        .groupBy("group", "block")
        .transformWithStateInPandas(PaneProcessor(), RESULT, outputMode="append", timeMode="eventTime")
    )
