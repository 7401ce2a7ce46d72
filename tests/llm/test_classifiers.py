import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwatch.llm import quality, samples, toxicity


def _corpus(spark, seed, marks):
    draw = random.Random(seed)
    plain = ["table", "window", "river", "paper", "letter", "garden", "winter", "simple"]
    rows, labels = [], []
    for n in range(240):
        bad = n % 3 == 0
        words = [draw.choice(plain) for _ in range(40)]
        if bad:
            words = marks(draw, words)
        rows.append((n, " ".join(words)))
        labels.append((n, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, mark int")


def test_misspelled_words_share_grams_with_known_ones(spark):
    docs, labels = _corpus(spark, 1, lambda d, w: w[:20] + ["moronic", "idiotic"] + w[22:])
    model = toxicity.fit(docs, labels, "mark", sample=100)
    clean, seen, unseen = model.scores(["table window river paper", "table moronic river paper", "table moroniic river paper"])
    assert seen > 0.5 > clean
    assert unseen > clean + 0.2


def test_compression_tells_junk_from_text(spark):
    docs, labels = _corpus(spark, 2, lambda d, w: [x.upper() + "!!" for x in w])
    good = labels.withColumn("mark", 1 - F.col("mark"))
    model = quality.fit(docs, good, "mark", sample=100)
    text, junk = model.scores(["river paper letter garden " * 5, "RIVER!! PAPER!! LETTER!! GARDEN!! " * 5])
    assert text > 0.7 > junk


def test_held_out_accuracy(spark, sf_dir):
    from tillwatch.llm.queries import op2_quality, table

    labels = table(spark, sf_dir, "labels")
    scored = op2_quality(spark, sf_dir).join(labels, "doc_id").toPandas()
    assert ((scored["predicted"] == 1) == (scored["quality"] == 1)).mean() > 0.85
    assert scored["score"].between(0, 1).all()


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_documents(spark, odd_docs, module):
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, 1), (None, 0), (8, None), (9, 7)], "doc_id long, mark int")
    for known in (labels, labels.filter("false"), labels.filter("mark = 1")):
        model = module.fit(odd_docs, known, "mark")
        scores = [r[0] for r in odd_docs.select(module.score(F.col("text"), model)).collect()]
        assert len(scores) == odd_docs.count() and all(0 <= s <= 1 for s in scores)
        assert scores[0] == scores[1] and scores[2] == scores[3]
    assert module.fit(odd_docs.filter("false"), labels, "mark").scores([""])[0] == pytest.approx(samples.base_rate({1: 2, 0: 1}))


def test_sample_is_bounded_and_repeats(spark, sf_dir):
    from tillwatch.llm.queries import table

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    first, counts = samples.labelled_sample(docs.union(docs), labels, "quality", 7, 50)
    again, _ = samples.labelled_sample(docs.union(docs), labels, "quality", 7, 50)
    assert first.equals(again) and first.groupby("label").size().max() == 7 and first["text"].str.len().max() <= 50
    assert counts == {r["quality"]: r["count"] for r in labels.groupBy("quality").count().collect()}


def test_logistic_recovers_a_known_curve():
    draw = np.random.default_rng(0)
    x = draw.normal(size=20_000)
    y = (draw.random(20_000) < 1 / (1 + np.exp(-(2 * x + 0.5)))).astype(float)
    slope, base = quality._logistic(x, y, np.ones_like(x))
    assert slope == pytest.approx(2, abs=0.1) and base == pytest.approx(0.5, abs=0.1)


def test_bags_are_not_all_in_memory():
    """The driver holds the bags of one step, not those of the whole sample."""
    draw = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [" ".join("".join(draw.choice(letters) for _ in range(9)) for _ in range(150)) for _ in range(400)]
    whole = sum(8 * len(toxicity._bag(t)[0]) for t in texts)
    expected = [toxicity._bag(t) for t in texts[:3]]
    tracemalloc.start()
    bags = toxicity.Bags(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(bags) == 400 and peak < whole / 4
    for n, (ids, share) in enumerate(expected):
        assert (bags[n][0] == ids).all() and (bags[n][1] == share).all()
    bags.dropped[expected[0][0][:2]] = True
    assert (bags[0][0] == expected[0][0][2:]).all()
    bags.close()
