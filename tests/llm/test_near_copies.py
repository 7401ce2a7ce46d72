"""Near copies of the pipeline's stage against brute force."""

import random

from conftest_llm import empty_like

import corpus_pipeline
from tillwatch.llm import near_copies, simhash


def _set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _groups(texts):
    sets, label = [_set(t) for t in texts], list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    return label


def test_stage_keeps_one_of_each_group(spark, tmp_path, monkeypatch):
    draw = random.Random(3)
    texts = [None, "", " \n", "two words", "Two  WORDS", "other words"]
    for size in (30, 100, 200, 500, 9000):
        words = [f"w{draw.randrange(5000)}" for _ in range(size)]
        for edits in (0, 0, 1, 1, 2, 3, 5, 9):
            other = list(words)
            for _ in range(edits):
                other[draw.randrange(size)] = "edit"
            texts.append(" ".join(other))
        texts.append(" ".join(words[: size // 2]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    label = _groups(texts)
    expected = sorted({x: k for k, x in reversed(list(enumerate(label)))}.values())
    for slice_ in (3, 1024):
        monkeypatch.setattr(near_copies, "SLICE", slice_)
        kept = corpus_pipeline.distinct_documents(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == expected
    assert near_copies.first_of_each(empty_like(spark, docs)).count() == 0


def test_odd_documents(spark, odd_docs, odd_rows):
    kept = near_copies.first_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == len(set(_groups([t for _, t, _ in odd_rows])))


def test_stage_keeps_one_of_those_that_simhash_links(spark, tmp_path):
    """Two texts two bits apart whose shared shingles are too few, a near copy of either, and a text alone."""
    draw = random.Random(2)
    words = [f"w{draw.randrange(5000)}" for _ in range(400)]
    edited = ["edit" if n % 32 == 10 else w for n, w in enumerate(words)]
    texts = [" ".join(t) for t in (words, edited, [*words, "more"], [*edited, "more"], words[::-1], words)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bits = simhash.fingerprint_of(texts[0]) ^ simhash.fingerprint_of(texts[1])
    assert (bits & (1 << 64) - 1).bit_count() == simhash.MOST_BITS
    assert _groups(texts) == [0, 1, 0, 1, 4, 0]
    kept = corpus_pipeline.distinct_documents(spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 4]
    assert {r["doc_id"] for r in simhash.first_of_each(docs).collect()} >= {0, 4}


def test_equal_fingerprints_link_different_texts(spark):
    """Texts of one fingerprint but other sets of shingles are one group, whatever comes between."""
    values = spark.createDataFrame([(5, 7), (3, 7), (5, 1 << 40), (9, 0b1100), (8, 0b1111), (2, -1)], "fp long, sim long")
    links = {frozenset(r) for r in near_copies.alike(values).collect() if r[0] != r[1]}
    label = {fp: fp for fp in (2, 3, 5, 8, 9)}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    # 7 and 1111 differ in one bit, 1100 and 1111 in two, bit 40 and 7 in four
    assert label == {2: 2, 3: 3, 5: 3, 8: 3, 9: 3}
