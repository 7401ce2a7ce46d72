"""Ranked search against plain sums, and the treap against a dense grid."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest_llm import empty_like

from tillwatch.llm import lexical
from tillwatch.llm.treap import Treap, build


@pytest.mark.parametrize("seed", range(8))
def test_treap_equals_dense_grid(seed):
    draw = np.random.default_rng(seed)
    for share in (0.0, 0.02, 0.3, 1.0):
        n_rows, n_columns = int(draw.integers(1, 50)), int(draw.integers(1, 70))
        grid = np.where(draw.random((n_rows, n_columns)) < share, draw.integers(1, 5, (n_rows, n_columns)), 0)
        rows, columns = np.nonzero(grid)
        treap = Treap(build(rows, columns, grid[rows, columns], n_rows, n_columns))
        for k in (1, 4):
            asked = [np.unique(draw.integers(0, n_rows, 6)) for _ in range(5)]
            weights = [draw.integers(0, 4, len(rows)) for rows in asked]
            query = np.repeat(np.arange(5), [len(rows) for rows in asked])
            got = treap.best(query, np.concatenate(asked), np.concatenate(weights), k)
            want = []
            for n in range(5):
                sums = (grid[asked[n]] * weights[n][:, None]).sum(axis=0)
                want += sorted(((n, int(s), c) for c, s in enumerate(sums) if s > 0), key=lambda sc: (-sc[1], sc[2]))[:k]
            assert list(zip(*(part.tolist() for part in got))) == want


def plain_search(docs, queries, k):
    """Sorted (item_id, rank, doc_id, score)."""
    lower = str.maketrans(lexical.UPPER, lexical.LOWER)
    split = lambda text: [t.translate(lower) for t in re.findall(lexical.TERM, text or "")]
    bags = [(doc_id, Counter(split(text))) for doc_id, text in docs]
    bags = [(d, b) for d, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in queries:
        terms = set(split(text)) & set(df)
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in terms}
        scored = []
        for doc_id, bag in bags:
            m = 100 - 90 + 90 * sum(bag.values()) * n // total
            score = sum(weight[t] * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m)) for t in terms if bag[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id, score))
        out += [(item, rank, s[2], s[3]) for rank, s in enumerate(sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def _found(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def test_search_equals_plain_sums(spark):
    """Many shards, ties over many copies, several slices of queries."""
    draw = random.Random(9)
    words = ["alpha", "Beta", "gamma-ray", "ünder", "ÜNDER", "x1", "delta", "e", "Zeta_eta"]
    docs = [(i, " ".join(draw.choice(words) for _ in range(draw.randint(0, 12)))) for i in range(120)]
    docs += [(1000 + i, "alpha alpha copy") for i in range(40)]
    queries = [(f"q{i}", " ".join(draw.choice(words) for _ in range(draw.randint(0, 4)))) for i in range(9)]
    queries += [("copies", "COPY"), ("none", "nowhere"), ("empty", ""), ("null", None), (None, "alpha")]
    got = lexical.search(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(queries, "item_id string, text string"),
        points=60, slice_terms=7,
    )
    assert _found(got) == plain_search(docs, queries, 10)


def test_odd_and_no_documents(spark, odd_docs, odd_rows):
    queries = [("a", "alpha license"), ("b", "mit"), ("c", "solo another"), ("a", "alpha license")]
    asked = spark.createDataFrame(queries, "item_id string, text string")
    got = _found(lexical.search(odd_docs, asked))
    assert got == plain_search([(d, t) for d, t, _ in odd_rows], queries, 10)
    assert lexical.search(empty_like(spark, odd_docs), asked).collect() == []
    assert lexical.search(odd_docs, empty_like(spark, asked)).collect() == []
