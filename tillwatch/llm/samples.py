"""A bounded sample of labelled texts for classifiers that are fitted on the driver."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, chars: int) -> tuple[pd.DataFrame, dict]:
    """(passages with text and label, number of labelled rows per class).

    At most ``per_class`` documents of label 0 and of label 1, those with the smallest hash
    of doc_id, and of each one passage of at most ``chars`` characters at a place the hash
    chooses. Rows whose label is neither 0 nor 1, or without doc_id or text, are not used.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    counts = {row["label"]: row["n"] for row in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id", "label")
    ids = reduce(
        DataFrame.union, [known.filter(F.col("label") == c).distinct().orderBy(order).limit(per_class) for c in (0, 1)]
    )
    room = F.greatest(F.length("text") - chars, F.lit(0)) + 1
    passage = F.substring(F.col("text"), F.pmod(F.xxhash64("doc_id", F.lit(1)), room).cast("int") + 1, F.lit(chars))
    found = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(ids), "doc_id")
    found = found.select("label", order.alias("at"), passage.alias("text"))
    # an id may occur in many documents, so the bound is set once more
    rows = reduce(
        DataFrame.union, [found.filter(F.col("label") == c).orderBy("at", "text").limit(per_class) for c in (0, 1)]
    )
    return rows.toPandas().sort_values(["at", "text"], kind="stable").reset_index(drop=True), counts


def base_rate(counts: dict) -> float:
    """Share of label 1, kept off 0 and 1; one half without labels."""
    return (counts.get(1, 0) + 1) / (counts.get(0, 0) + counts.get(1, 0) + 2)
