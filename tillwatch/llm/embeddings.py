"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine c are at squared distance 2 - 2c. They are rotated at random
and split into blocks of eight dimensions; each block gets the share of the distance
budget that its dimensions have of all, and two near vectors must be within it in some
block. Per block, vectors meet in the cells of a grid over its first coordinates: every
vector stands in its home cell and in the cells its budget reaches. In a cell, pairs
within the block's budget are candidates; each is verified in double precision in the
first block that finds it, so the union of the blocks has every pair once.

Equal vectors are collapsed first, busy cells are cut into tiles, and a task passes on
link counts and a spanning forest, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, in_tiles, written
from .simhash import join_labels

LEAST_COSINE = 0.98
BLOCK = 8
#: Coordinates of a block that the grid divides.
GRID = 2
#: Members of one slice of a busy cell, and candidate pairs verified together.
SLICE, PAIRS = 2048, 1 << 15
#: Room for rounding, as a share of the budget; candidates are verified exactly.
SLACK = 1e-6


@lru_cache(maxsize=16)
def _rotation(size: int, seed: int = 17) -> np.ndarray:
    turned, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return turned


def _blocks(size: int) -> list[tuple[int, int]]:
    return [(at, min(at + BLOCK, size)) for at in range(0, size, BLOCK)]


def _rotated(vectors: np.ndarray) -> np.ndarray:
    """Rotated unit vectors. einsum adds in the same order for every row, so a vector gets
    the same numbers in every task."""
    unit = vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
    return np.einsum("ij,jk->ik", unit, _rotation(vectors.shape[1]))


def _budgets(size: int, least: float) -> np.ndarray:
    return np.array([(2 - 2 * least) * (1 + SLACK) * (end - at) / size for at, end in _blocks(size)])


def _cells(vectors: np.ndarray, least: float) -> list[list[str]]:
    """Cells of each vector, for every block: the home cell first, then the others its budget reaches."""
    size = vectors.shape[1]
    turned, keys = _rotated(vectors), [[] for _ in vectors]
    for block, ((at, end), budget) in enumerate(zip(_blocks(size), _budgets(size, least))):
        reach = np.sqrt(budget) * (1 + SLACK)
        part = turned[:, at : min(at + GRID, end)]
        home = np.floor(part / (2 * reach)).astype("int64")
        side = np.where(part - home * 2 * reach < reach, -1, 1)
        for mask in range(1 << part.shape[1]):
            moved = np.array([(mask >> k) & 1 for k in range(part.shape[1])])
            for mine, cell in zip(keys, (home + side * moved).tolist()):
                mine.append(f"{block}:{'' if mask else '*'}{','.join(map(str, cell))}")
    return keys


def _cells_of(vector: Column, least: float) -> Column:
    @F.pandas_udf("array<string>")
    def cells(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = pd.Series([None] * len(batch), dtype=object)
            sizes = batch.map(len)
            for size in sizes.unique():
                rows = np.flatnonzero(sizes == size)
                for row, keys in zip(rows, _cells(np.stack(batch.iloc[rows]).astype("float64"), least)):
                    out.iloc[row] = keys
            yield out

    return cells(vector)


def _links_in(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links of the home vectors of one tile: (a, b, links) with b the smallest class in a's local tree."""
    vectors = np.stack(rows["vector"]).astype("float64")
    home, part, weight = (rows[c].to_numpy() for c in ("home", "slice", "n"))
    block = int(rows["cell"].iloc[0].split(":")[0])
    crossed = rows["tile_a"].iloc[0] != rows["tile_b"].iloc[0]
    size = vectors.shape[1]
    turned, budgets = _rotated(vectors), _budgets(size, least)
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    at, end = _blocks(size)[block]
    mine = np.ascontiguousarray(turned[:, at:end])
    squares = np.einsum("ij,ij->i", mine, mine)
    starts = [s for s, _ in _blocks(size)][: block + 1]
    links, label = np.zeros(len(rows), dtype="int64"), np.arange(len(rows))
    homes = np.flatnonzero(home)
    for first in range(0, len(homes), 256):
        some = homes[first : first + 256]
        apart = squares[some, None] + squares[None, :] - 2 * mine[some] @ mine.T
        near = apart <= budgets[block] + 1e-9
        if crossed:
            near &= part[some, None] != part[None, :]
        a, b = np.nonzero(near)
        a = some[a]
        for at_pair in range(0, len(a), PAIRS):
            x, y = a[at_pair : at_pair + PAIRS], b[at_pair : at_pair + PAIRS]
            x, y = x[x != y], y[x != y]
            gaps = np.add.reduceat((turned[x, :end] - turned[y, :end]) ** 2, starts, axis=1)
            within = gaps <= budgets[: block + 1]
            found_first = within[:, block] & ~within[:, :block].any(axis=1)
            x, y = x[found_first], y[found_first]
            cosine = np.einsum("ij,ij->i", vectors[x], vectors[y]) / (norms[x] * norms[y])
            x, y = x[cosine >= least], y[cosine >= least]
            np.add.at(links, x, weight[y])
            label = join_labels(label, x, y)
    told = np.flatnonzero((links > 0) | (label != np.arange(len(rows))))
    ids = rows["class"].to_numpy()
    return pd.DataFrame({"a": ids[told], "b": ids[label[told]], "links": links[told]})


def links(rows: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``rows`` (vec_id, embedding, label).

    Vectors are compared when labels and lengths are equal. Null labels, null vectors, zero
    vectors and vectors with null, NaN or infinite parts link with nothing: no links, their own
    component. Repeated rows are vectors of their own and link with each other; null vec_ids
    do not become a component's id unless nothing else is in it. Other columns are not read.
    """
    usable = (
        F.col("label").isNotNull()
        & F.col("embedding").isNotNull()
        & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    vector = F.col("embedding").cast("array<double>")
    marked = rows.select(
        "vec_id",
        F.when(usable, F.col("label").cast("string")).alias("label"),
        F.when(usable, F.xxhash64(F.lit(1), "label", vector)).alias("key"),
        F.when(usable, F.xxhash64(F.lit(2), vector, "label")).alias("key2"),
        "embedding",
    )
    equal = marked.filter("key is not null").groupBy("label", "key", "key2").agg(
        F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("embedding").alias("vector")
    )
    classes = written(equal.withColumn("class", F.monotonically_increasing_id()), "classes")
    placed = classes.withColumn("_cells", _cells_of(F.col("vector"), least)).select(
        "label", "class", "n", "vector", F.explode("_cells").alias("_cell")
    )
    cells = placed.select(
        "class", "n", "vector", F.col("_cell").contains("*").alias("home"),
        F.concat_ws(":", F.translate("_cell", "*", ""), F.size("vector"), "label").alias("cell"),
    )
    tiled = in_tiles(cells, ["cell"], F.col("class"), SLICE)
    found = tiled.groupBy("cell", "tile_a", "tile_b").applyInPandas(
        lambda tile: _links_in(tile, least), "a long, b long, links long"
    )
    found = written(found, "found")
    roots = components(found.select("a", "b"), "links").withColumnRenamed("node", "class")
    sums = found.groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    joined = (
        classes.select("class", "key", "key2", "n", "least")
        .join(sums, "class", "left")
        .join(roots, "class", "left")
        .withColumn("root", F.coalesce("root", "class"))
    )
    first = joined.groupBy("root").agg(F.min("least").alias("component"))
    known = joined.join(first, "root").select(
        "key", "key2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component"
    )
    out = marked.select("vec_id", "key", "key2").join(known, ["key", "key2"], "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
