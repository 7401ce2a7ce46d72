"""Toxicity from subword bags.

A word is the mean of the vectors of its character n-grams, a text the mean of its
words and of a few empty ones, which keep one odd word from deciding a short text; a
linear softmax on top decides. Vectors and softmax are trained together in
numpy. A misspelled word never seen shares most n-grams with the word it came from.

The model is linear in the word vectors, so scoring needs one number per n-gram
bucket: the weight its vector adds to the toxic side.
"""

from __future__ import annotations

import re
import tempfile
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .samples import base_rate, labelled_sample

#: Bounds of the sample the model is fitted on: documents of each class, characters of each.
SAMPLE, CHARS = 2500, 5000
BUCKETS = 1 << 17
GRAMS = range(3, 7)
DIMENSIONS = 8
EPOCHS, BATCH, RATE, SCALE = 5, 32, 0.3, 10.0
#: Buckets in a larger share of the sampled clean documents than this tell nothing and stay zero.
COMMON = 0.3
#: Empty words that every text has besides its own.
EMPTY = 20
#: Words whose weight a worker remembers; emptied when full.
REMEMBERED = 300_000
_FACTOR = np.uint64(0xD1342543DE82EF95)
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def buckets(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, which word each belongs to) of the words themselves and of their n-grams, with marks at both ends.

    N-grams are of characters, whatever their script, hashed for all words together.
    """
    marked = [f"<{w}>" for w in names]
    sizes = np.array([len(m) for m in marked])
    letters = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype("uint64") + np.uint64(1)
    owner = np.repeat(np.arange(len(marked)), sizes)
    ends = np.cumsum(sizes)
    place = np.arange(len(letters)) - np.repeat(ends - sizes, sizes)
    powers = _FACTOR ** np.arange(int(sizes.max(initial=1)), dtype="uint64")
    found, owners = [np.add.reduceat(letters * powers[place], ends - sizes)], [np.arange(len(marked))]
    rolled = letters
    for n in range(2, max(GRAMS) + 1):
        rolled = rolled[:-1] * _FACTOR + letters[n - 1 :]
        if n in GRAMS:
            inside = owner[: len(rolled)] == owner[n - 1 :]
            found.append(rolled[inside] + np.uint64(n << 56))
            owners.append(owner[: len(rolled)][inside])
    mixed = np.concatenate(found)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype("int64"), np.concatenate(owners)


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and the weight of each in the text's mean vector."""
    counts = Counter(words(text))
    if not counts:
        return np.zeros(0, "int32"), np.zeros(0, "float32")
    ids, owner = buckets(list(counts))
    times = np.fromiter(counts.values(), dtype="float64")
    each = times / np.bincount(owner) / (times.sum() + EMPTY)
    used, inverse = np.unique(ids, return_inverse=True)
    return used.astype("int32"), np.bincount(inverse, each[owner]).astype("float32")


class Bags:
    """The bags of ``texts``, which is emptied on the way, in a temporary file of the driver: a bag holds some thousand
    buckets, and all of them would be the largest object there. Only the place of each is kept in memory."""

    def __init__(self, texts: list[str]) -> None:
        self._file = tempfile.TemporaryFile()
        self._cuts = [0]
        #: Buckets that are left out when bags are read.
        self.dropped = np.zeros(BUCKETS, dtype=bool)
        texts.reverse()
        while texts:
            for part in _bag(texts.pop()):
                self._file.write(part.tobytes())
            self._cuts.append(self._file.tell())

    def __len__(self) -> int:
        return len(self._cuts) - 1

    def __getitem__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        size = (self._cuts[n + 1] - self._cuts[n]) // 8
        self._file.seek(self._cuts[n])
        raw = self._file.read(8 * size)
        ids, share = np.frombuffer(raw, "int32", size), np.frombuffer(raw, "float32", size, 4 * size)
        kept = ~self.dropped[ids]
        return ids[kept], share[kept]

    def close(self) -> None:
        self._file.close()


@dataclass
class SubwordModel:
    """``weights``: what each bucket adds to the log-odds; ``base``: the log-odds of an empty text."""

    weights: np.ndarray
    base: float
    _known: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"weights": self.weights, "base": self.base, "_known": {}}

    def _learn(self, names: set[str]) -> None:
        """Remember the weights of new words: the mean over their buckets."""
        if len(self._known) + len(names) > REMEMBERED:
            self._known.clear()
        ids, owner = buckets(list(names))
        means = np.bincount(owner, self.weights[ids]) / np.bincount(owner)
        self._known.update(zip(names, means.tolist()))

    def log_odds(self, text: str | None) -> float:
        found = words(text)
        new = {w for w in found if w not in self._known}
        if new:
            self._learn(new if len(self._known) + len(new) <= REMEMBERED else set(found))
        return self.base + sum(map(self._known.__getitem__, found)) / (len(found) + EMPTY)

    def scores(self, texts) -> np.ndarray:
        odds = np.clip([self.log_odds(t) for t in texts], -60, 60)
        return 1.0 / (1.0 + np.exp(-odds.astype("float64")))


def _train(bags: Bags, y: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """Bucket weights and base after AdaGrad steps on the softmax loss, over vectors and softmax alike."""
    draw = np.random.default_rng(seed)
    vectors = ((draw.random((BUCKETS, DIMENSIONS)) - 0.5) / DIMENSIONS).astype("float32")
    top, shift = draw.normal(0, 0.5, (DIMENSIONS, 2)), np.zeros(2)
    squares = [np.full_like(vectors, 1e-6), np.full_like(top, 1e-6), np.full_like(shift, 1e-6)]
    one_hot = np.eye(2)[y]
    for _ in range(EPOCHS):
        order = draw.permutation(len(bags))
        for start in range(0, len(order), BATCH):
            rows = order[start : start + BATCH]
            read = [bags[i] for i in rows]
            ids = np.concatenate([bag[0] for bag in read])
            share = np.concatenate([bag[1] for bag in read]) * SCALE
            owner = np.repeat(np.arange(len(rows)), [len(bag[0]) for bag in read])
            near = vectors[ids] * share[:, None]
            mean = np.column_stack([np.bincount(owner, near[:, j], len(rows)) for j in range(DIMENSIONS)])
            odds = mean @ top + shift
            odds = np.exp(odds - odds.max(axis=1, keepdims=True))
            error = (odds / odds.sum(axis=1, keepdims=True) - one_hot[rows]) / len(rows)
            back = (error @ top.T)[owner] * share[:, None]
            used, place = np.unique(ids, return_inverse=True)
            slope = np.column_stack([np.bincount(place, back[:, j], len(used)) for j in range(DIMENSIONS)])
            top_slope, shift_slope = mean.T @ error, error.sum(axis=0)
            squares[0][used] += slope**2
            vectors[used] -= RATE * slope / np.sqrt(squares[0][used])
            squares[1] += top_slope**2
            top -= RATE * top_slope / np.sqrt(squares[1])
            squares[2] += shift_slope**2
            shift -= RATE * shift_slope / np.sqrt(squares[2])
    return vectors @ (top[:, 1] - top[:, 0]) * SCALE, float(shift[1] - shift[0])


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, chars: int = CHARS, seed: int = 3
) -> SubwordModel:
    """Model from a bounded sample of ``labels`` (doc_id, ``label`` 0 or 1) joined with ``docs``.

    The sample takes both classes alike; the base is then moved to their share among all
    labels. With one class or none, every score is that share.
    """
    rows, counts = labelled_sample(docs, labels, label, sample, chars)
    rate = base_rate(counts)
    odds = float(np.log(rate / (1 - rate)))
    y = rows["label"].to_numpy(dtype="int64")
    if len(set(y)) < 2:
        return SubwordModel(np.zeros(BUCKETS), odds)
    texts = rows.pop("text").tolist()
    del rows
    bags = Bags(texts)
    try:
        held = np.zeros(BUCKETS, dtype="int64")
        for n in np.flatnonzero(y == 0):
            held[bags[n][0]] += 1  # a bag holds a bucket once
        bags.dropped = held > COMMON * (y == 0).sum()
        weights, base = _train(bags, y, seed)
    finally:
        bags.close()
    weights = np.where(bags.dropped, 0.0, weights)
    return SubwordModel(weights, base + odds - float(np.log(y.mean() / (1 - y.mean()))))


def score(text: Column, model: SubwordModel) -> Column:
    """Probability that ``text`` is toxic, from its whole text alone. Null and empty texts get the
    base; rows are independent, so ties, repeats and other columns do not matter."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores(texts))

    return scores(text)
