"""Near copies of texts: by the fingerprints of ``simhash``, or by five-word shingles with a Jaccard
similarity of 0.8 or more, checked exactly. Each rule finds pairs that the other does not.

Texts with one set of shingles are one value. Candidates come from MinHash bands: two
values at a similarity of 0.8 share none of the bands with a chance of about one in ten
million. Values connected over shared bands are a group; inside a group the sets
themselves are compared. Large groups are cut into tiles that let every two values meet,
and a task passes on a spanning forest: pairs already connected need no comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import components, in_tiles, written
from .simhash import firsts, join_labels

SHINGLE, SEED = 5, 42
#: Least similarity, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 40, 5
#: Values of one slice of a large group, and shingles hashed together.
SLICE, CHUNK = 1024, 1 << 12

_draw = np.random.default_rng(SEED)
_TIMES = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype="uint64") * np.uint64(2) + np.uint64(1)
_PLUS = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype="uint64") * np.uint64(2)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles_of(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter text is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype="uint64")
    width, digest = min(SHINGLE, len(words)), xxhash.xxh64_intdigest
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    starts, ends = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    return np.unique(np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends)], dtype="uint64"))


def bands_of(shingles: np.ndarray) -> np.ndarray:
    """One number per band: equal where all ``ROWS`` minima are."""
    least = np.full(BANDS * ROWS, np.iinfo("uint64").max, dtype="uint64")
    for at in range(0, len(shingles), CHUNK):
        hashed = _TIMES[:, None] * shingles[None, at : at + CHUNK] + _PLUS[:, None]
        np.minimum(least, hashed.min(axis=1), out=least)
    out = np.arange(1, BANDS + 1, dtype="uint64") * _MIX
    for row in least.reshape(BANDS, ROWS).T:
        out = (out ^ row) * _MIX
        out ^= out >> np.uint64(29)
    return out.view("int64")


def signature(text: Column) -> Column:
    """(fp, bands, sim) of a text column: the number of its set of shingles, its bands (none without words) and its SimHash."""

    @F.pandas_udf("fp long, bands array<long>, sim long")
    def signatures(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            fps, bands, sims = [], [], []
            for t in texts:
                s = shingles_of(t)
                fps.append(xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63) if len(s) else 0)
                bands.append(bands_of(s) if len(s) else np.zeros(0, dtype="int64"))
                sims.append(simhash.fingerprint_of(t))
            yield pd.DataFrame({"fp": np.array(fps, dtype="int64"), "bands": bands, "sim": np.array(sims, dtype="int64")})

    return signatures(text)


def shingle_set(text: Column) -> Column:
    @F.pandas_udf("binary")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingles_of(t).tobytes() for t in texts], dtype=object)

    return sets(text)


def forest(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the smallest place of those connected with it by pairs at ``LEAST`` or more."""
    sizes = np.array([len(s) for s in sets], dtype="int64")
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    known, ids = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(len(known), dtype="uint8")
    part, whole = LEAST
    furthest = np.searchsorted(sizes * part, sizes * whole, side="right")  # larger sets cannot be near enough
    label = np.arange(len(sets))
    for k in range(len(sets) - 1):
        low, high = k + 1, int(furthest[k])
        if low >= high or (label[low:high] == label[k]).all():
            continue
        own = ids[starts[k] : starts[k + 1]]
        mark[own] = 1
        common = np.add.reduceat(mark[ids[starts[low] : starts[high]]], starts[low:high] - starts[low], dtype="int64")
        mark[own] = 0
        near = np.flatnonzero(common * (part + whole) >= part * (sizes[k] + sizes[low:high])) + low
        if len(near):
            label = join_labels(label, np.full(len(near), k), near)
    out = np.empty_like(label)
    out[order] = order[label]
    return out


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by key; the last key of a batch may go on."""
    held: list[pd.DataFrame] = []

    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, group in rows.groupby("key", sort=False):
            fps = group["fp"].to_numpy()
            label = forest([np.frombuffer(s, dtype="uint64") for s in group["set"]])
            apart = label != np.arange(len(fps))
            found.append(pd.DataFrame({"a": fps[apart], "b": fps[label[apart]]}))
        return pd.concat(found) if found else pd.DataFrame({"a": [], "b": []}, dtype="int64")

    for batch in batches:
        if not len(batch):
            continue
        last = batch["key"] == batch["key"].iloc[-1]
        if last.all() and held and held[-1]["key"].iloc[-1] == batch["key"].iloc[-1]:
            held.append(batch)
            continue
        yield linked(pd.concat([*held, batch[~last]]))
        held = [batch[last]]
    if held:
        yield linked(pd.concat(held))


def linked(values: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) that connect all near values of ``values`` (fp, tie, bands); ``docs`` has the texts."""
    one = written(values.groupBy("fp").agg(F.min(F.struct("tie", "bands")).alias("m")).select("fp", "m.*"), "bands")
    bands = one.select("fp", F.explode("bands").alias("band"))
    hubs = bands.groupBy("band").agg(F.min("fp").alias("hub"), F.count("*").alias("_n")).filter("_n > 1")
    met = bands.join(hubs, "band").filter("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()
    groups = components(met, "bands-met").withColumnRenamed("node", "fp")
    wanted = one.select("fp", "tie").join(groups, "fp")
    texts = docs.select(F.xxhash64("text").alias("tie"), "text").join(wanted, "tie").dropDuplicates(["fp"])
    sets = written(texts.select("fp", "root", shingle_set(F.col("text")).alias("set")), "sets")
    tiled = in_tiles(sets, ["root"], F.col("fp"), SLICE)
    rows = tiled.select("fp", "set", F.concat_ws(":", "root", "tile_a", "tile_b").alias("key"))
    return rows.repartition("key").sortWithinPartitions("key").mapInPandas(_links, "a long, b long")


def alike(values: DataFrame) -> DataFrame:
    """Links (a, b) that connect all values of ``values`` (fp, sim) whose fingerprints ``simhash`` links."""
    hubs = written(values.groupBy("sim").agg(F.min("fp").alias("hub")), "hubs")
    same = values.select("fp", "sim").distinct().join(hubs, "sim").filter("fp <> hub")
    near = written(simhash.linked(hubs.select(F.col("sim").alias("fp"))), "alike")
    for end in ("a", "b"):
        near = near.join(hubs.select(F.col("sim").alias(end), F.col("hub").alias(f"fp_{end}")), end)
    return same.select(F.col("fp").alias("a"), F.col("hub").alias("b")).union(near.select("fp_a", "fp_b"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies by either rule, chosen as in ``simhash.first_of_each``.

    Texts without words are copies of each other. Keeps all columns.
    """
    narrow = docs.select("doc_id", F.xxhash64("text").alias("tie"), signature(F.col("text")).alias("s"))
    values = written(narrow.select("doc_id", "tie", "s.*"), "signatures")
    return firsts(docs, values.drop("bands", "sim"), lambda _: linked(values, docs).union(alike(values)))
