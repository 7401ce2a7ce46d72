"""Benchmark decontamination with an FM-index per training shard.

The windows of the benchmark (so many consecutive words of an item) are the patterns.
A shard's words become numbers; words in no window become a break, and only runs of
known words at least as long as a window can hold one, so these make the indexed text.
Its suffixes are sorted, the Burrows-Wheeler text goes into a wavelet matrix, all
windows are searched backwards together by its ranks, and occurrences are located by
walking to sampled suffix positions. Occurrences are merged to the spans to remove.

A document lies in one shard. The benchmark is searched in slices of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, written

WINDOW = 10
#: Benchmark words searched together; a larger benchmark is searched in several slices.
SLICE_WORDS = 2_000_000
#: Words of a shard: documents are added until it is full.
SHARD_WORDS = 1_000_000
#: Every so many words of a run, the place of its suffix is kept.
SAMPLED = 8
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
FOUND = "spans array<struct<start:int,end:int>>, items array<string>, n_words long"


def words(text: str | None) -> list[bytes]:
    """Words of the text with A-Z lower-cased: digits, letters and everything beyond ASCII."""
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


@dataclass(frozen=True)
class Patterns:
    """Distinct windows by length, the items each comes from, and the numbers of their words."""

    numbers: dict[bytes, int]
    windows: dict[int, np.ndarray]
    owners: dict[int, list[tuple[str, ...]]]

    @staticmethod
    def of(items: list[tuple[str | None, str | None]], width: int) -> Patterns:
        numbers: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], set]] = {}
        for item, text in items:
            ids = [numbers.setdefault(w, len(numbers) + 1) for w in words(text)]
            size = min(width, len(ids))
            for at in range(len(ids) - size + 1 if size else 0):
                found.setdefault(size, {}).setdefault(tuple(ids[at : at + size]), set()).add(item)
        windows = {n: np.array(list(w), dtype="int64") for n, w in found.items()}
        owners = {n: [tuple(sorted(i for i in o if i is not None)) for o in w.values()] for n, w in found.items()}
        return Patterns(numbers, windows, owners)


class FMIndex:
    """Full-text index of a sequence of word numbers; 0 is a break between runs and is never searched."""

    def __init__(self, text: np.ndarray) -> None:
        order = _suffixes(text)
        last = text[order - 1]
        self.depth = max(1, int(text.max()).bit_length())
        self.before = np.searchsorted(np.sort(text), np.arange(int(text.max()) + 2))
        self._build(last)
        breaks = np.flatnonzero(text == 0)
        run_start = np.zeros(len(text), dtype="int64")
        run_start[breaks[breaks + 1 < len(text)] + 1] = breaks[breaks + 1 < len(text)] + 1
        run_start = np.maximum.accumulate(run_start)
        sampled = ((np.arange(len(text)) - run_start) % SAMPLED == 0)[order]
        self.marked = sampled
        self.marks = np.concatenate([[0], np.cumsum(sampled)])
        self.places = order[sampled]

    def _build(self, symbols: np.ndarray) -> None:
        """Wavelet matrix: per bit, the number of ones before each place, and the number of zeros."""
        self.ones, self.zeros = [], []
        for bit in range(self.depth - 1, -1, -1):
            up = (symbols >> bit) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(up)]).astype("int32"))
            self.zeros.append(int(len(symbols) - up.sum()))
            symbols = np.concatenate([symbols[up == 0], symbols[up == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place of the Burrows-Wheeler text."""
        start = np.zeros_like(place)
        for level, bit in enumerate(range(self.depth - 1, -1, -1)):
            up = ((symbol >> bit) & 1).astype(bool)
            ones = self.ones[level]
            place = np.where(up, self.zeros[level] + ones[place], place - ones[place])
            start = np.where(up, self.zeros[level] + ones[start], start - ones[start])
        return place - start

    def symbol(self, place: np.ndarray) -> np.ndarray:
        out = np.zeros_like(place)
        for level in range(self.depth):
            ones = self.ones[level]
            up = ones[place + 1] - ones[place]
            place = np.where(up == 1, self.zeros[level] + ones[place], place - ones[place])
            out = out * 2 + up
        return out

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window number, place in the text) of every occurrence of equally long windows."""
        alive = np.flatnonzero((windows < len(self.before) - 1).all(axis=1))
        low = np.zeros(len(alive), dtype="int64")
        high = np.full(len(alive), int(self.ones[0].size - 1), dtype="int64")
        for column in range(windows.shape[1] - 1, -1, -1):
            symbols = windows[alive, column]
            low = self.before[symbols] + self.rank(symbols, low)
            high = self.before[symbols] + self.rank(symbols, high)
            some = low < high
            alive, low, high = alive[some], low[some], high[some]
        count = high - low
        which = np.repeat(alive, count)
        row = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        return which, self.locate(row)

    def locate(self, row: np.ndarray) -> np.ndarray:
        place = np.full(len(row), -1, dtype="int64")
        open_, steps = np.arange(len(row)), 0
        while len(open_):
            known = self.marked[row]
            place[open_[known]] = self.places[self.marks[row[known]]] + steps
            open_, row = open_[~known], row[~known]
            symbols = self.symbol(row)
            row = self.before[symbols] + self.rank(symbols, row)
            steps += 1
        return place


def _suffixes(text: np.ndarray) -> np.ndarray:
    """Suffix array by doubling. Each break is a symbol of its own, so comparisons end with the run."""
    n = len(text)
    breaks = np.cumsum(text == 0)
    rank = np.where(text == 0, breaks - 1, text + breaks[-1])
    width = 1
    while True:
        nxt = np.zeros(n, dtype="int64")
        nxt[:-width] = rank[width:] + 1
        key = rank * (int(rank.max()) + 2) + nxt
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], (np.diff(key[order]) != 0).cumsum()])
        rank = np.empty(n, dtype="int64")
        rank[order] = fresh
        width *= 2
        if fresh[-1] == n - 1 or width >= n:
            return order


def _shard(docs: list[np.ndarray], patterns: Patterns) -> list[tuple[list, list]]:
    """Per document: spans (start, end) of hit words, and the items found."""
    sizes = np.array([len(d) for d in docs])
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.zeros(int((sizes + 1).sum()), dtype="int64")
    for at, ids in zip(starts.tolist(), docs):
        text[at : at + len(ids)] = ids
    known = np.concatenate([[False], text > 0])
    edge = np.flatnonzero(known[1:] != known[:-1])
    begin, end = edge[::2], edge[1::2]
    long = end - begin >= min(patterns.windows)
    begin, end = begin[long], end[long]
    none = [([], []) for _ in docs]
    if not len(begin):
        return none
    depth = np.zeros(len(text) + 1, dtype="int32")
    depth[begin] += 1
    depth[end] -= 1
    keep = depth[:-1].cumsum() > 0
    keep[end] = True
    place_of = np.flatnonzero(keep)
    index = FMIndex(text[keep])
    cover = np.zeros(len(text) + 1, dtype="int32")
    items: list[set] = [set() for _ in docs]
    for size, windows in patterns.windows.items():
        which, place = index.search(windows)
        place = place_of[place]
        np.add.at(cover, place, 1)
        np.add.at(cover, place + size, -1)
        doc = np.searchsorted(starts, place, side="right") - 1
        pairs = np.unique(doc * len(windows) + which)
        for d, w in zip((pairs // len(windows)).tolist(), (pairs % len(windows)).tolist()):
            items[d].update(patterns.owners[size][w])
    hit = np.concatenate([[False], cover[:-1].cumsum() > 0])
    edge = np.flatnonzero(hit[1:] != hit[:-1])
    begin, end = edge[::2], edge[1::2]
    doc = np.searchsorted(starts, begin, side="right") - 1
    spans: list[list] = [[] for _ in docs]
    for d, b, e in zip(doc.tolist(), (begin - starts[doc]).tolist(), (end - starts[doc]).tolist()):
        spans[d].append((b, e))
    return [(s, sorted(i)) for s, i in zip(spans, items)]


def search_texts(texts, patterns: Patterns) -> list[tuple[list, list, int]]:
    """(spans, items, number of words) of each text, shard by shard."""
    out, shard, held, number = [], [], 0, patterns.numbers.get

    def flush():
        found = _shard(shard, patterns) if patterns.windows else [([], []) for _ in shard]
        out.extend((s, i, len(d)) for (s, i), d in zip(found, shard))
        shard.clear()

    for text in texts:
        shard.append(np.array([number(w, 0) for w in words(text)], dtype="int32"))
        held += len(shard[-1])
        if held >= SHARD_WORDS:
            flush()
            held = 0
    if shard:
        flush()
    return out


def _union(spans: list) -> list:
    out: list = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _search(patterns: Patterns):
    @F.pandas_udf(FOUND)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(search_texts(texts, patterns), columns=["spans", "items", "n_words"])

    return search


def _merge(one: Column, two: Column) -> Column:
    """Two results for the same texts, from two slices of the benchmark, as one."""

    @F.pandas_udf(FOUND)
    def merge(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        def pairs(spans) -> list:
            return [(s["start"], s["end"]) for s in spans]

        spans = [_union(pairs(a) + pairs(b)) for a, b in zip(one["spans"], two["spans"])]
        items = [sorted({*a, *b}) for a, b in zip(one["items"], two["items"])]
        return pd.DataFrame({"spans": spans, "items": items, "n_words": one["n_words"]})

    return merge(one, two)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slice_words: int = SLICE_WORDS) -> DataFrame:
    """``docs`` (text, ...) with ``found``: spans of hit words (start, end before), items, n_words.

    ``benchmark`` has item_id and text. An item shorter than ``window`` words is one window; an
    item without words, or a null or empty text, has none. Null item_ids hit words but are not
    listed. Null and empty documents have no words; every other text is searched whole, however
    long. Repeated rows are separate documents; a column ``found`` of the input is replaced.
    """
    size = F.coalesce(F.length("text"), F.lit(0))
    total = benchmark.agg(F.sum(F.ceil(size / 2))).first()[0] or 0
    slices = max(1, -(-total // slice_words))
    out = docs.drop("found")
    for n in range(slices):
        part = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == n)
        rows = part.select(F.col("item_id").cast("string"), "text").collect()
        search = _search(Patterns.of([tuple(r) for r in rows], window))
        if n == 0:
            out = out.withColumn("found", search(F.col("text")))
        else:
            out = written(out.withColumn("_next", search(F.col("text"))), "searched")
            out = out.withColumn("found", _merge(F.col("found"), F.col("_next"))).drop("_next")
    return out


def n_hit(found: Column) -> Column:
    return F.aggregate(found["spans"], F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark; all columns stay."""
    start_with, end_with = numbered(docs, docs.columns)
    found = find(docs.select(*start_with, "text"), benchmark, window)
    return found.filter(F.size("found.spans") == 0).select(*end_with)
