"""Quality by compression.

Two zstandard dictionaries are built, from good and from bad labelled text. A text
is cut into pieces, each compressed with both; how much shorter the good dictionary
makes it, per byte of text, is the difference, and a logistic curve fitted on labelled
texts that went into neither dictionary turns it into a score. Short pieces keep the
text itself from becoming the better dictionary. A short text says little, so every
text counts some bytes of the usual difference besides its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .samples import base_rate, labelled_sample

#: Bounds of the sample the model is fitted on: documents of each class, characters of each.
SAMPLE, CHARS = 2000, 8000
PIECE = 512
DICTIONARY = 16_384
LEVEL = 3
#: Bytes of the usual difference that every text has besides its own.
USUAL = 100


def _pieces(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]


def _dictionary(texts: list[str]) -> bytes:
    pieces = [p for t in texts for p in _pieces(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to choose from: all of it
        return b"".join(pieces)[-DICTIONARY:]


@dataclass(frozen=True)
class CompressionModel:
    """``good`` and ``bad`` dictionaries; score = logistic(slope * difference + base)."""

    good: bytes
    bad: bytes
    slope: float = 0.0
    base: float = 0.0
    usual: float = 0.0

    def differences(self, texts) -> np.ndarray:
        """(bad size - good size) / text size of each text, drawn towards the usual one when short."""
        packers = [
            zstandard.ZstdCompressor(
                level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None,
                write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            for d in (self.bad, self.good)
        ]
        out = []
        for text in texts:
            pieces = _pieces(text)
            sizes = [sum([len(packer.compress(p)) for p in pieces]) for packer in packers]
            out.append((sizes[0] - sizes[1] + self.usual * USUAL) / (sum(map(len, pieces)) + USUAL))
        return np.asarray(out, dtype="float64")

    def scores(self, texts) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.differences(texts) + self.base, -60, 60)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and base by Newton steps, with a small penalty on the slope."""
    scale = x.std() or 1.0
    rows = np.column_stack([x / scale, np.ones_like(x)])
    at, penalty = np.zeros(2), np.diag([1e-2, 1e-6])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(rows @ at, -30, 30)))
        slope = rows.T @ (weight * (p - y)) + penalty @ at
        curve = rows.T @ (rows * (weight * p * (1 - p) + 1e-9)[:, None]) + penalty
        step = np.linalg.solve(curve, slope)
        at = at - np.clip(step, -2, 2)
    return at[0] / scale, at[1]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, chars: int = CHARS) -> CompressionModel:
    """Model from a bounded sample of ``labels`` (doc_id, ``label`` 0 or 1) joined with ``docs``.

    Every other sampled document makes the dictionaries, the rest the curve, weighted to the
    classes' share among all labels. With one class or none, every score is that share.
    """
    rows, counts = labelled_sample(docs, labels, label, sample, chars)
    rate = base_rate(counts)
    constant = float(np.log(rate / (1 - rate)))
    rows["fit"] = rows.groupby("label").cumcount() % 2 == 0
    part = {(c, f): rows[(rows["label"] == c) & (rows["fit"] == f)] for c in (0, 1) for f in (True, False)}
    if any(x.empty for x in part.values()):
        return CompressionModel(b"", b"", 0.0, constant)
    model = CompressionModel(_dictionary(list(part[1, True]["text"])), _dictionary(list(part[0, True]["text"])))
    rest = pd.concat([part[0, False], part[1, False]])
    y = rest["label"].to_numpy(dtype="float64")
    share = np.where(y == 1, rate / y.sum(), (1 - rate) / (1 - y).sum()) * len(y)
    usual = float(np.average(model.differences(rest["text"]), weights=share))
    model = CompressionModel(model.good, model.bad, usual=usual)
    slope, base = _logistic(model.differences(rest["text"]), y, share)
    return CompressionModel(model.good, model.bad, float(slope), float(base), usual)


def score(text: Column, model: CompressionModel) -> Column:
    """Probability that ``text`` is good: from its whole text alone. Null and empty texts get the
    score of the usual difference; rows are independent, so ties, repeats and other columns do not matter."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores(texts))

    return scores(text)
