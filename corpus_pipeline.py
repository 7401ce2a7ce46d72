"""The corpus pipeline: documents through five stages, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir), works on every document its predecessor kept, and
returns the columns of ``documents``; the last adds the mix. No stage caps or samples
documents; the two classifiers are fitted on a bounded sample of labels (see there).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.llm import decontamination, mixing, near_copies, quality, toxicity
from tillwatch.llm.common import written

#: Documents stay with at least this quality and less than this toxicity.
LEAST_QUALITY, TOXIC = 0.7, 0.5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return docs.filter(quality.score(F.col("text"), model) >= LEAST_QUALITY)


def harmless_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score(F.col("text"), model) < TOXIC)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: by op6's SimHash, or five words at similarity 0.8 or more."""
    return near_copies.first_of_each(docs)


def unseen_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.clean(docs, _table(spark, sf_dir, "benchmark"))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document as often as its source's target takes it."""
    return mixing.repeated(mixing.mix(docs))


STAGES = [
    ("quality classifier", good_documents),
    ("toxicity", harmless_documents),
    ("near-dedup", distinct_documents),
    ("benchmark decontamination", unseen_documents),
    ("mixing sources to target weights", mixed_documents),
]

#: The classifiers have no SQL form; tests compare the pipeline with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{n}")
    return docs
