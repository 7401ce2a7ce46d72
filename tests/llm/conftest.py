import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

CLASHING = ("score", "size", "copies", "_row", "fp", "found", "key", "_hash", "n_words", "label", "in:0", "target")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, columns with clashing names."""
    draw = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta", "MIT", "license", "ünder", "idiot", "x1"]
    long = " ".join(draw.choice(words) for _ in range(60_000))
    rows = [
        (1, "alpha beta Gamma under the MIT License.", "en", "a"), (1, "alpha beta Gamma under the MIT License.", "en", "a"),
        (2, None, "en", "b"), (3, "", None, None), (None, "alpha delta", "en", "a"), (None, None, None, None),
        (4, " \n\t ", "en", ""), (5, long, "en", "b"), (6, "solo", "en", "c"), (6, "another text of this id", "en", "c"),
        (7, long, "en", "b"), (8, "Licensed under CC BY-NC 4.0", "en", "a"), (9, "aKB \U0001f600 ok", "de", "a"),
    ]
    extra = tuple(range(len(CLASHING)))
    names = ", ".join(f"`{c}` int" for c in CLASHING)
    return spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string, lang string, source string, {names}")


@pytest.fixture(scope="session")
def odd_rows(odd_docs):
    return [(r["doc_id"], r["text"], r["source"]) for r in odd_docs.collect()]

