"""SimHash groups, embedding links, connected components and tiles."""

import random

import numpy as np
import pytest
import xxhash
from conftest_llm import empty_like
from pyspark.sql import functions as F

from tillwatch.llm import common, embeddings, simhash


def _plain_fingerprint(text):
    import re

    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def _plain_roots(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(x) for x in range(n)]


def test_fingerprints_and_groups_equal_brute_force(spark, odd_docs, odd_rows):
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.groups(odd_docs).collect()}
    prints = [_plain_fingerprint(t) for _, t, _ in odd_rows]
    assert set(got) == {(i, f"{p:016x}") for (i, _, _), p in zip(odd_rows, prints)}
    roots = _plain_roots(len(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    for (doc, _, _), p, root in zip(odd_rows, prints, roots):
        members = [odd_rows[k][0] for k, r in enumerate(roots) if r == root and odd_rows[k][0] is not None]
        assert got[doc, f"{p:016x}"] == min(members, default=None)
    assert simhash.groups(empty_like(spark, odd_docs)).count() == 0


@pytest.mark.parametrize("slice_", [8, 1024])
def test_gray_index_finds_all_links(spark, monkeypatch, slice_):
    monkeypatch.setattr(simhash, "SLICE", slice_)
    draw = random.Random(slice_)
    seeds = [draw.getrandbits(64) for _ in range(40)]
    values = {0}
    for s in seeds:
        for _ in range(25):
            flipped = s
            for _ in range(draw.randint(0, 6)):
                flipped ^= 1 << draw.randrange(64)
            values.add(flipped)
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    links = simhash.linked(spark.createDataFrame([(v,) for v in values], "fp long"))
    got = {r["node"]: r["root"] for r in common.components(links, "links").collect()}
    near = lambda a, b: ((values[a] ^ values[b]) & (1 << 64) - 1).bit_count() <= 2
    roots = _plain_roots(len(values), near)
    assert [got.get(v, v) for v in values] == [values[r] for r in roots]


def test_one_document_of_each_group_stays(spark, odd_docs, odd_rows):
    kept = simhash.first_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = kept.collect()
    prints = [_plain_fingerprint(r["text"]) for r in rows]
    assert all((a ^ b).bit_count() > 2 for k, a in enumerate(prints) for b in prints[:k])
    assert {r["doc_id"] for r in rows} == {r["component_id"] for r in simhash.groups(odd_docs).collect()}
    every = [_plain_fingerprint(t) for _, t, _ in odd_rows]
    assert len(rows) == len(set(_plain_roots(len(every), lambda a, b: (every[a] ^ every[b]).bit_count() <= 2)))


@pytest.mark.parametrize("seed", range(3))
def test_components_on_paths_and_hubs(spark, seed):
    draw = random.Random(seed)
    edges = [(n, n + 1) for n in range(100, 160)] + [(7, n) for n in range(200, 260)]
    edges += [(draw.randrange(300, 400), draw.randrange(300, 400)) for _ in range(60)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in common.components(frame, "edges").collect()}
    nodes = sorted({x for e in edges for x in e})
    linked = {frozenset(e) for e in edges}
    roots = _plain_roots(len(nodes), lambda a, b: frozenset((nodes[a], nodes[b])) in linked)
    assert [got.get(x, x) for x in nodes] == [nodes[r] for r in roots]
    assert common.components(frame.filter("false"), "none").count() == 0


def test_tiles_let_all_members_meet(spark):
    rows = spark.createDataFrame([(n % 3 == 0, n) for n in range(60)] + [(None, 99)], "g boolean, v long")
    tiles = common.in_tiles(rows, ["g"], F.col("v"), 7).collect()
    met = {}
    for r in tiles:
        met.setdefault((r["g"], r["tile_a"], r["tile_b"]), []).append(r["v"])
    pairs = {frozenset((a, b)) for m in met.values() for a in m for b in m if a != b}
    expected = {frozenset((a, b)) for a in range(60) for b in range(60) if a != b and (a % 3 == 0) == (b % 3 == 0)}
    assert pairs == expected and max(map(len, met.values())) < 40


def _plain_links(rows, least):
    def usable(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def near(a, b):
        (_, v, p), (_, w, q) = rows[a], rows[b]
        if not (usable(v, p) and usable(w, q)) or p != q or len(v) != len(w):
            return False
        v, w = np.array(v, dtype="float64"), np.array(w, dtype="float64")
        return v @ w / np.sqrt((v @ v) * (w @ w)) >= least

    n = len(rows)
    links = [sum(near(a, b) for b in range(n) if a != b) for a in range(n)]
    return links, _plain_roots(n, near)


@pytest.mark.parametrize("slice_", [5, 512])
def test_embedding_links_equal_brute_force(spark, monkeypatch, slice_):
    monkeypatch.setattr(embeddings, "SLICE", slice_)
    draw = np.random.default_rng(slice_)
    rows = []
    for size in (3, 20):
        for label in (1, 2):
            for centre in draw.normal(size=(4, size)):
                for _ in range(10):
                    near = centre + draw.normal(size=size) * 0.08 * np.linalg.norm(centre) / np.sqrt(size)
                    rows.append([float(np.float32(x)) for x in near * draw.uniform(0.1, 9)])
                    rows[-1] = (len(rows), rows[-1], label)
    vector = rows[0][1]
    rows += [(900, vector, 1), (901, vector, 1), (902, vector, None), (903, None, 1), (904, [0.0] * 3, 1), (905, [], 1)]
    rows += [(906, [float("nan"), 1.0, 2.0], 1), (907, [None, 1.0, 2.0], 1), (908, [float("inf"), 1.0, 2.0], 1), (900, vector, 1)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, n int, class int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.links(frame).collect())
    links, roots = _plain_links(rows, 0.98)
    ids = [r[0] for r in rows]
    least = {r: min(ids[k] for k, x in enumerate(roots) if x == r) for r in set(roots)}
    assert got == sorted((ids[k], links[k], least[roots[k]], ids[k] == least[roots[k]]) for k in range(len(rows)))
    assert embeddings.links(empty_like(spark, frame)).count() == 0
