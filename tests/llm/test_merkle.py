"""The manifest against plain lists, and its appender against random sizes."""

import random
from hashlib import sha256

import pytest
from conftest_llm import empty_like
from pyspark.sql import functions as F

from tillwatch.llm import merkle


def h(text):
    return sha256(text.encode()).hexdigest()


def plain_tree(leaves, height=None):
    """(root, siblings of each leaf as (left, right) by level) of whole levels in memory."""
    at, steps, nodes = list(range(len(leaves))), [[] for _ in leaves], list(leaves)
    level = 0
    while len(nodes) > 1 or (height is not None and level < height):
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for n, place in enumerate(at):
            run = runs[place // 16]
            steps[n].append(("".join(run[: place % 16]), "".join(run[place % 16 + 1 :])))
        at = [place // 16 for place in at]
        nodes, level = [h("".join(run)) for run in runs], level + 1
    return nodes[0], steps


@pytest.mark.parametrize("height", [None, 3])
@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 300])
def test_appended_equals_whole_levels(n, height):
    leaves = [h(str(i)) for i in range(n)]
    tree = merkle.Appender(height)
    for leaf in leaves:
        tree.append(leaf)
    root, steps = plain_tree(leaves, height)
    assert tree.seal() == root
    for i in {0, n // 2, n - 1}:
        assert tree.witness(i) == steps[i]
        assert merkle.fold(leaves[i], tree.witness(i)) == root
        assert merkle.unpacked(merkle.packed(steps[i])) == steps[i]


def test_a_later_sibling_extends_an_earlier_witness():
    tree = merkle.Appender(None)
    tree.append("a")
    run, place = tree.members[0]
    assert run.text[place + 1 :] == []
    tree.append("b")
    assert run.text[place + 1 :] == ["b"]


def plain_manifest(rows):
    """rows (doc_id, source, lang, n_chars, text, tampered) -> sorted results."""

    def leaf(values):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    lower = str.maketrans(merkle.UPPER, merkle.LOWER)
    by_source = {}
    for doc_id, source, lang, n_chars, text, tampered in rows:
        one = leaf([doc_id, source, lang, n_chars, text])
        changed = leaf([doc_id, source, lang, n_chars, text and text.translate(lower)]) if tampered else one
        by_source.setdefault(source, []).append(((doc_id is not None, doc_id), one, changed, doc_id))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: plain_tree([m[1] for m in sorted(by_source[s], key=lambda m: m[:2])]) for s in order}
    root, above = plain_tree([subs[s][0] for s in order])
    out = []
    for n, s in enumerate(order):
        for m, steps in zip(sorted(by_source[s], key=lambda m: m[:2]), subs[s][1]):
            path = steps + above[n]
            folded = m[2]
            for left, right in path:
                folded = h(left + folded + right)
            out.append((str(m[3]), m[1], subs[s][0], root, h("".join(a + b for a, b in path)), folded, folded == root))
    return sorted(out)


def _results(df):
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((str(r["doc_id"]), *[r[n] for n in names]) for r in df.collect())


def test_blocks_over_several_rounds(spark):
    """With small blocks, a source needs several rounds of block roots as further appends."""
    draw = random.Random(3)
    sizes = {"hot": 700, "b": 17, "one": 1, None: 33}
    rows = [(i, s, "en", i, f"Text {draw.random()}") for s, n in sizes.items() for i in range(n)]
    draw.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    got = merkle.manifest(docs, tampered=F.col("doc_id") % 5 == 0, levels=1)
    assert _results(got) == plain_manifest([(*r, r[0] % 5 == 0) for r in rows])


def test_odd_and_no_documents(spark, odd_docs):
    docs = odd_docs.withColumn("n_chars", F.length("text").cast("long"))
    got = _results(merkle.manifest(docs, tampered=F.col("doc_id") % 2 == 0))
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in docs.collect()]
    assert got == plain_manifest([(*r, r[0] is not None and r[0] % 2 == 0) for r in rows])
    assert merkle.manifest(empty_like(spark, docs)).collect() == []
    assert all(r["verified"] for r in merkle.manifest(docs).collect())
