"""Mixing, license scans, token counts, decontamination and language-model scores."""

import collections
import math
import random
import re
import zlib

import public_tokenizers
import pytest
from conftest_llm import empty_like
from pyspark.sql import functions as F

from tillwatch.llm import decontamination, language_model, licenses, mixing, token_counts

LOWER = {c: c + 32 for c in range(65, 91)}
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets_reshare_what_is_above_the_limit(spark):
    sizes = {"a": 10, "b": 1000, "c": 30, None: 500}
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    got = {r["source"]: r["target"] for r in rows}
    assert got["a"] == 30 and got["c"] == 90
    # what is left, 1540 - 120, goes to b (weight 2) and null (weight 1)
    assert got["b"] == pytest.approx(1420 * 2 / 3) and got[None] == pytest.approx(1420 / 3)


def test_mix_takes_whole_steps_and_meets_targets(spark):
    draw = random.Random(3)
    rows = [(n, "w " * draw.randint(0, 60), "hot" if n % 3 else f"s{n % 7}") for n in range(3000)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    ratio = mixed["target"] / mixed["source_size"]
    assert (mixed["copies"] >= ratio.apply(math.floor)).all() and (mixed["copies"] <= ratio.apply(math.ceil)).all()
    taken = (mixed["copies"] * mixed["size"]).groupby(mixed["source"]).sum()
    target = mixed.groupby("source")["target"].first()
    assert ((taken - target).abs() <= 0.02 * target + 120).all()


def test_null_and_repeated_ids_spread_over_buckets(spark):
    """A third of the rows without an id, a third of one id, all of one size."""
    rows = [(None if n % 3 == 0 else 7 if n % 3 == 1 else n, f"w{n} a b", "s") for n in range(30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    bucket = mixing.bucket_of(mixing.hash_of(F.col("doc_id"), F.col("text")))
    assert docs.groupBy(bucket).count().agg(F.max("count")).first()[0] < 40
    mixed = mixing.mix(docs, weights=(1,))
    assert mixed.agg(F.sum("copies"), F.count("*")).first()[:] == (30_000, 30_000)


@pytest.mark.parametrize("bits", [1, 20])
def test_mix_does_not_depend_on_buckets(spark, odd_docs, monkeypatch, bits):
    columns = ["doc_id", "size", "source", "copies"]
    before = sorted(map(repr, mixing.mix(odd_docs).select(columns).collect()))
    monkeypatch.setattr(mixing, "BUCKET_BITS", bits)
    assert sorted(map(repr, mixing.mix(odd_docs).select(columns).collect())) == before


def test_mix_odd_documents(spark, odd_docs):
    mixed = mixing.mix(odd_docs)
    assert set(odd_docs.columns) <= set(mixed.columns)
    rows = mixed.collect()
    assert len(rows) == odd_docs.count()
    again = mixing.mix(odd_docs.repartition(3)).collect()
    key = lambda r: (str(r["doc_id"]), str(r["text"])[:40], r["copies"])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert mixing.repeated(mixed).count() == sum(r["copies"] for r in rows)
    assert mixing.mix(empty_like(spark, odd_docs)).count() == 0


def test_license_spans_over_an_edit(spark):
    text = "x y permission is hereby granted free of charge to EVERY any person obtaining a copy of this software and associated documentation files the software to deal in it"
    rows = [(1, text), (2, "Under the MIT license, under the mit License"), (3, "nothing here")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["labels"] == "mit" and got[1]["base_labels"] == "" and got[1]["n_base"] == 0
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"], got[2]["score"]) == (2, 0, 4, 1.0)
    assert got[3]["labels"] == "" and got[3]["score"] == 0


def test_license_odd_documents(spark, odd_docs, odd_rows):
    got = licenses.scan(odd_docs).collect()
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    expected = sorted((str(i), len(words.findall((t or "").translate(LOWER)))) for i, t, _ in odd_rows)
    assert sorted((str(r["doc_id"]), r["n_words"]) for r in got) == expected
    assert licenses.scan(empty_like(spark, odd_docs)).count() == 0


def test_token_counts_equal_the_library(spark, odd_docs, odd_rows, sf_dir):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = odd_docs.select("text", token_counts.token_count(F.col("text"), path).alias("n")).collect()
    more = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", token_counts.token_count(F.col("text"), path).alias("n"))
    for text, n in [*rows, *more.collect()]:
        assert n == len(library.encode(text or "", add_special_tokens=False).ids)
    count = token_counts.counter(path)
    for text in ("a<|endoftext|>b", "<|endoftext|><|endoftext|>  ", "\x1c \x85  x  y", "don't 12a\n\n \tz", "<|endoftext"):
        assert count(text) == len(library.encode(text, add_special_tokens=False).ids)


def _brute_hits(texts, items, width):
    owners = {}
    for item, text in items:
        words = decontamination.words(text)
        size = min(width, len(words))
        for at in range(len(words) - size + 1 if size else 0):
            owners.setdefault(tuple(words[at : at + size]), set()).add(item)
    for text in texts:
        words, hit, found = decontamination.words(text), set(), set()
        for size in {len(o) for o in owners}:
            for at in range(len(words) - size + 1):
                if tuple(words[at : at + size]) in owners:
                    hit.update(range(at, at + size))
                    found |= owners[tuple(words[at : at + size])]
        yield hit, found, len(words)


@pytest.mark.parametrize("seed", range(40))
def test_fm_index_finds_every_window(seed, monkeypatch):
    draw = random.Random(seed)
    letters = "abcdef"[: draw.choice([2, 3, 6])]
    items = [(str(n), " ".join(draw.choice(letters) for _ in range(draw.choice([0, 1, 2, 5, 8])))) for n in range(4)]
    texts = [" ".join(draw.choice([*letters, "zz"]) for _ in range(draw.choice([0, 4, 30, 100]))) for _ in range(9)] + ["", None]
    monkeypatch.setattr(decontamination, "SHARD_WORDS", draw.choice([5, 60, 10**6]))
    got = decontamination.search_texts(texts, decontamination.Patterns.of(items, 3))
    for (spans, found, size), expected in zip(got, _brute_hits(texts, items, 3), strict=True):
        assert ({x for a, b in spans for x in range(a, b)}, set(found), size) == expected


def test_decontamination_odd_documents_and_slices(spark, odd_docs, odd_rows):
    items = [(1, "Alpha beta gamma under"), (2, None), (3, ""), (None, "alpha delta"), (5, "solo"), (5, "solo"), (6, "under the mit license")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    one = decontamination.find(odd_docs, benchmark, window=3)
    several = decontamination.find(odd_docs, benchmark, window=3, slice_words=5)
    view = lambda df: sorted((str(r["doc_id"]), str(r["text"])[:50], r["found"]) for r in df.collect())
    assert view(one) == view(several)
    hits = {(r["doc_id"], r["text"]): r["found"] for r in one.collect()}
    for (_, text, _), (hit, found, n) in zip(odd_rows, _brute_hits([t for _, t, _ in odd_rows], [(i and str(i), t) for i, t in items], 3)):
        got = next(f for (_, t), f in hits.items() if t == text)
        assert {x for a, b in got["spans"] for x in range(a, b)} == hit
        assert set(got["items"]) == found - {None} and got["n_words"] == n
    kept = decontamination.clean(odd_docs, benchmark, 3)
    assert kept.columns == odd_docs.columns and kept.count() < odd_docs.count()
    assert decontamination.clean(odd_docs, benchmark.filter("false"), 3).count() == odd_docs.count()


def _plain_counts(rows):
    split = [(i, SPACED.findall((t or "").translate(LOWER)) + [None]) for i, t in rows]
    counts = collections.Counter(w for i, ws in split if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    return split, counts


def test_lm_base_counts_are_exact_and_mixture_is_better(spark, sf_dir):
    from tillwatch.llm.queries import op8_lm_scoring, table

    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    split, counts = _plain_counts(rows)
    size, types = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in op8_lm_scoring(spark, sf_dir).collect()}
    for doc, words in split:
        r = got[doc]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), size)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (size + types + 1)) for w in words))
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_odd_documents_and_small_blocks(spark, odd_docs, monkeypatch, order):
    def run(docs, training):
        scored = language_model.score(docs, training, F.col("doc_id") == 7, order)
        return sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 4)) for r in scored.collect())

    whole = run(odd_docs, F.col("doc_id") != 6)
    assert len(whole) == odd_docs.count() and all(r[4] < 0 for r in whole)
    monkeypatch.setattr(language_model, "CHUNK", 50)
    monkeypatch.setattr(language_model, "RANGE", 1000)
    assert run(odd_docs.repartition(4), F.col("doc_id") != 6) == whole
    untrained = run(odd_docs, F.lit(False))
    assert all(r[2] == 0 for r in untrained)
    assert run(empty_like(spark, odd_docs), F.lit(True)) == []


def test_em_prefers_the_order_that_explains_the_text():
    import pandas as pd

    cells = pd.DataFrame([(3, 100, 40, 8, 1000), (0, 100, 40, -1, 500)], columns=["bucket", "p0", "p1", "p2", "number"])
    mixture = language_model.weights(cells, 2)
    assert mixture[3, 2] > 0.9 and mixture[0, 1] > 0.9
    assert mixture.sum(axis=1) == pytest.approx(1)
