"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints are collapsed to distinct values first. Two that differ in at most two
bits agree in one of three blocks, so each value goes to three groups, one per block
and block value. Inside a task the values of its groups are sorted by Gray rank;
neighbours share most bits, so every eight of them get an upper node that keeps the
bits they have in common, and so on upwards. The index is joined with itself from the
top: a pair of nodes is dropped, with all below, when their common bits already differ
too often.

A task passes on a spanning forest of the links it found, not all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, in_tiles, numbered, written

SHINGLE, SEED = 3, 42
MOST_BITS = 2
#: Bit ranges (first from the top, length): one more than the differing bits allowed.
BLOCKS = ((0, 22), (22, 21), (43, 21))
FAN = 8
#: Members of one slice of a busy group, and pairs looked at together.
SLICE, PAIRS = 1024, 1 << 18
#: Rows gathered before an index is built; a group is never cut.
GATHER = 60_000


def fingerprint_of(text: str | None) -> int:
    """Signed 64-bit SimHash of one text; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(SHINGLE, len(words))
    starts, ends = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest, seed = xxhash.xxh64_intdigest, SEED
    votes = np.zeros(64, dtype="int64")
    for at in range(0, len(starts), 1 << 15):
        part = [digest(joined[s:e], seed) for s, e in zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)])]
        bits = np.unpackbits(np.array(part, dtype="<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype="int64")
    return int(np.packbits(votes * 2 > len(starts), bitorder="little").view("<i8")[0])


def fingerprint(text: Column) -> Column:
    """64-bit fingerprint of a text column, as a long."""

    @F.pandas_udf("long")
    def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint_of(t) for t in texts], dtype="int64")

    return fingerprints(text)


def _gray_rank(code: np.ndarray) -> np.ndarray:
    for shift in (1, 2, 4, 8, 16, 32):
        code = code ^ (code >> np.uint64(shift))
    return code


class GrayIndex:
    """Values in Gray order within their groups, under upper nodes of ``FAN`` each.

    A node keeps which bits all its values share and what they are, and its range of groups.
    """

    def __init__(self, values: np.ndarray, groups: np.ndarray, turn: np.ndarray) -> None:
        turned = (values << turn) | (values >> ((np.uint64(64) - turn) & np.uint64(63)))
        order = np.lexsort((_gray_rank(turned), groups))
        self.order = order
        ones, zeros, low, high = values[order], ~values[order], groups[order], groups[order]
        self.levels = [(ones, zeros, low, high)]
        while len(ones) > 1:
            at = np.arange(0, len(ones), FAN)
            ones, zeros = np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((ones, zeros, low, high))

    def pairs(self, most: int = MOST_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (in the input) of all pairs of one group that differ in ``most`` bits or fewer."""
        root = np.zeros(1, dtype="int64")
        todo = [(len(self.levels) - 1, root, root)]
        while todo:
            level, a, b = todo.pop()
            ones, zeros, low, high = self.levels[level]
            if level == 0:
                a, b = a[a != b], b[a != b]
            apart = np.bitwise_count((ones[a] & zeros[b]) | (zeros[a] & ones[b]))
            near = (apart <= most) & (low[a] <= high[b]) & (low[b] <= high[a])
            a, b = a[near], b[near]
            if level == 0:
                if len(a):
                    yield self.order[a], self.order[b]
                continue
            size = len(self.levels[level - 1][0])
            step = max(1, PAIRS // (FAN * FAN))
            child = np.arange(FAN)
            for at in range(0, len(a), step):
                left = (a[at : at + step, None] * FAN + child)[:, :, None] + np.zeros(FAN, dtype="int64")
                right = (b[at : at + step, None] * FAN + child)[:, None, :] + np.zeros((FAN, 1), dtype="int64")
                left, right = left.ravel(), right.ravel()
                real = (left < size) & (right < size) & (left <= right)
                todo.append((level - 1, left[real], right[real]))


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after uniting the sets of each ``a`` and ``b``: the smallest place in the set."""
    while True:
        left, right = label[a], label[b]
        apart = left != right
        if not apart.any():
            return label
        a, b, left, right = a[apart], b[apart], left[apart], right[apart]
        np.minimum.at(label, np.maximum(left, right), np.minimum(left, right))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further


def _group_links(rows: pd.DataFrame) -> pd.DataFrame:
    values = rows["fp"].to_numpy(dtype="int64").view("uint64")
    block = rows["block"].to_numpy(dtype="int64")
    _, groups = np.unique(rows["key"].to_numpy(), return_inverse=True)
    turn = np.array([start for start, _ in BLOCKS], dtype="uint64")[block]
    label = np.arange(len(values))
    for a, b in GrayIndex(values, groups, turn).pairs():
        label = join_labels(label, a, b)
    linked = label != np.arange(len(values))
    signed = values.view("int64")
    return pd.DataFrame({"a": signed[linked], "b": signed[label[linked]]})


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by key; what is gathered is cut before the last key, which may go on."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= GATHER:
            rows = pd.concat(held, ignore_index=True)
            whole = rows["key"] != rows["key"].iloc[-1]
            yield _group_links(rows[whole])
            held = [rows[~whole]]
    if held:
        yield _group_links(pd.concat(held, ignore_index=True))


def linked(values: DataFrame) -> DataFrame:
    """Links (a, b) that connect all values of column ``fp`` (distinct) with ``MOST_BITS`` or fewer differing bits."""

    def part(start: int, size: int) -> Column:
        return F.shiftrightunsigned(F.shiftleft("fp", start), 64 - size)

    keys = F.array(*[F.struct(F.lit(n).alias("block"), part(*b).alias("bits")) for n, b in enumerate(BLOCKS)])
    grouped = values.select("fp", F.inline(keys))
    tiled = in_tiles(grouped, ["block", "bits"], F.col("fp"), SLICE)
    key = F.concat_ws(":", "block", "bits", "tile_a", "tile_b")
    rows = tiled.select("fp", "block", key.alias("key")).repartition("key").sortWithinPartitions("key")
    return rows.mapInPandas(_links, "a long, b long")


def classes(values: DataFrame, links: Callable[[DataFrame], DataFrame] = linked) -> DataFrame:
    """(fp, component_id, _first) from ``values`` (doc_id, fp, tie): for every fingerprint the smallest
    doc_id reachable over links, and doc_id with ``tie`` of the document that stands for all."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("least")
    distinct = written(values.groupBy("fp").agg(least), "values")
    roots = components(links(distinct.select("fp")), "links").withColumnRenamed("node", "fp")
    placed = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = placed.groupBy("root").agg(F.min("least").alias("_first"))
    return placed.join(first, "root").select("fp", F.col("_first.doc_id").alias("component_id"), "_first")


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of ``docs`` (doc_id, text): 16 hex digits, and the smallest
    doc_id reachable over links, itself included; null ids do not count.

    Null and empty texts and texts without words have fingerprint zero and are linked like
    any other; texts shorter than a shingle hash whole. Copies share a fingerprint and meet
    as one value, however many there are. Repeated rows give a row each; other columns are
    not read.
    """
    narrow = written(docs.select("doc_id", fingerprint(F.col("text")).alias("fp"), F.lit(0).alias("tie")), "fingerprints")
    found = narrow.join(classes(narrow).drop("_first"), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id (null last);
    of repeated ids the one with the smallest text hash, of repeated rows any one.

    Keeps all columns; cases as in ``groups``.
    """
    narrow = docs.select("doc_id", F.xxhash64("text").alias("tie"), fingerprint(F.col("text")).alias("fp"))
    return firsts(docs, written(narrow, "fingerprints"), linked)


def firsts(docs: DataFrame, values: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``docs`` that stand for the classes of ``values`` (doc_id, fp, and as tie the text's hash)."""
    row = {"_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_hash": F.xxhash64("text")}
    kept = classes(values, links).select("_first").distinct()
    kept = kept.select(
        F.coalesce(F.col("_first.doc_id").cast("string"), F.lit("")).alias("_id"), F.col("_first.tie").alias("_hash")
    )
    start_with, end_with = numbered(docs, docs.columns)
    stays = docs.select(*start_with, *[c.alias(n) for n, c in row.items()]).join(kept, ["_id", "_hash"], "left_semi")
    return stays.dropDuplicates(["_id", "_hash"]).select(*end_with)
