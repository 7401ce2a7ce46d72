"""Ranked lexical search over a K2-treap per shard of documents.

A shard is a number of neighbouring documents of one task, up to ``POINTS`` postings; its treap
holds the impact of every term in every document of the shard. The shards are a written table. Queries
go to it in slices of bounded size, every slice to all shards; a shard answers with its best
documents per query, and of those the best overall are ranked.

All numbers are whole: a term's weight, and its impact in a document by its count, the
document's length and the mean length. The score is their sum of products.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_path
from .treap import Treap, build

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same terms in UTF-8: every byte of a character beyond ASCII belongs to a term.
TERM_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A shard is full from this many postings on; a document is never split.
POINTS = 1_000_000
#: Shards of a file of the index, so that a reader holds few at once.
SHARDS_A_FILE = 8
#: Queries that a shard answers side by side.
SIDE_BY_SIDE = 32
#: A slice of queries has at most this many terms, or one query.
SLICE_TERMS = 200_000
#: A document's length counts for this many hundredths.
LENGTH_SHARE = 90

INDEX = (
    "doc_ids array<string>, terms string, counts array<int>, bits binary, lacks binary, point_rows binary, "
    "point_columns binary, height int"
)


def terms_of(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda t: F.translate(t, UPPER, LOWER))


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, all their terms)."""

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = [len(TERM_BYTES.findall(text)) for text in batch["text"] if text is not None]
            yield pd.DataFrame({"docs": [sum(size > 0 for size in n)], "terms": [sum(n)]})

    counted = docs.select(F.col("text").cast("binary").alias("text")).mapInPandas(sizes, "docs long, terms long")
    row = counted.agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    return row["docs"] or 0, row["terms"] or 0


class Shard:
    """The postings of a shard while its documents come in."""

    def __init__(self, docs: int, terms: int) -> None:
        self.docs, self.terms = docs, terms
        self.rows: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.seen: list[np.ndarray] = []
        self.impacts: list[np.ndarray] = []
        self.points = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        words = TERM_BYTES.findall(text.lower())  # of bytes, lower() changes A-Z only
        counts = Counter(words)
        length = 100 - LENGTH_SHARE + (LENGTH_SHARE * len(words) * self.docs) // self.terms
        tf = np.fromiter(counts.values(), np.int64, len(counts))
        rows = self.rows
        self.seen.append(np.fromiter((rows.setdefault(w, len(rows)) for w in counts), np.int32, len(counts)))
        self.impacts.append((1_000_000_000 * tf) // (1000 * tf + 8 * length))
        self.ids.append(doc_id)
        self.points += len(counts)

    def row(self) -> dict:
        """The shard as a row of the index: documents by id, nulls last, terms from the most frequent."""
        # columns in the order of ties
        order = sorted(range(len(self.ids)), key=lambda n: (self.ids[n] is None, self.ids[n] or 0))
        sizes = np.array([len(self.seen[n]) for n in order])
        seen = np.concatenate([self.seen[n] for n in order])
        impacts = np.concatenate([self.impacts[n] for n in order])
        columns = np.repeat(np.arange(len(order)), sizes)
        counts = np.bincount(seen, minlength=len(self.rows))
        frequent = np.argsort(-counts, kind="stable")
        place = np.empty_like(frequent)
        place[frequent] = np.arange(len(frequent))
        terms = list(self.rows)
        some = impacts > 0
        stored = build(place[seen[some]], columns[some], impacts[some], len(terms), len(order))
        return {
            "doc_ids": [None if self.ids[n] is None else str(self.ids[n]) for n in order], "terms": b" ".join([terms[n] for n in frequent]).decode(),
            "counts": counts[frequent].astype(np.int32), **stored,
        }


def index(docs: DataFrame, size: tuple[int, int], points: int = POINTS) -> DataFrame:
    """The shards of ``docs`` (doc_id, text); documents without terms are in none."""
    if not size[1]:
        return docs.sparkSession.createDataFrame([], INDEX)

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = Shard(*size)
        for batch in batches:
            # ids as Python numbers: with nulls, pandas would make them floats
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                if text is None or not TERM_BYTES.search(text):
                    continue
                shard.add(None if doc_id is None else int(doc_id), bytes(text))
                if shard.points >= points:
                    yield pd.DataFrame([shard.row()])
                    shard = Shard(*size)
        if shard.ids:
            yield pd.DataFrame([shard.row()])

    rows = docs.select(F.col("doc_id").cast("decimal(20,0)").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInPandas(shards, INDEX)


def weighted(queries: DataFrame, shards: DataFrame, docs: int) -> DataFrame:
    """(query, item_id, terms, weights): each query's different terms that occur, rarer ones weighing more.

    A query is a row of ``queries`` (item_id, text); without terms that occur it has no row here.
    """
    numbered = queries.select(F.monotonically_increasing_id().alias("query"), "item_id", "text")
    split = numbered.select("query", "item_id", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term"))
    found = shards.select(F.explode(F.arrays_zip(F.split("terms", " ").alias("terms"), "counts")).alias("t"))
    found = found.select(F.col("t.terms").alias("term"), F.col("t.counts").alias("n"))
    frequency = found.join(split.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    met = split.join(frequency, "term")
    weight = F.floor(1000 * F.log((2.0 * docs + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    return met.groupBy("query", "item_id").agg(
        F.collect_list("term").alias("terms"), F.collect_list(weight).alias("weights")
    )


def _slices(queries: DataFrame, most: int) -> Iterator[list]:
    """The queries in slices of at most ``most`` terms, or one query."""
    part, terms = [], 0
    for row in queries.toLocalIterator():
        if part and terms + len(row["terms"]) > most:
            yield part
            part, terms = [], 0
        part.append((row["query"], [t.encode() for t in row["terms"]], row["weights"]))
        terms += len(row["terms"])
    if part:
        yield part


def _searched(shards: DataFrame, queries: list, k: int) -> DataFrame:
    """(query, doc_id, score): each shard's ``k`` best documents per query of a slice."""
    wanted: dict[bytes, list] = {}
    for n, (_, terms, weights) in enumerate(queries):
        for term, weight in zip(terms, weights):
            wanted.setdefault(term, []).append((n, weight))
    sent = shards.sparkSession.sparkContext.broadcast((wanted, [q for q, _, _ in queries]))

    def answers(shard: dict, wanted: dict, numbers: list) -> pd.DataFrame:
        paths = [(n, row, weight) for row, term in enumerate(shard["terms"].encode().split(b" ")) for n, weight in wanted.get(term, ())]
        query, rows, weights = np.array(sorted(paths), np.int64).reshape(-1, 3).T
        treap, found = Treap(shard), []
        for first in range(0, len(numbers), SIDE_BY_SIDE):
            begin, end = np.searchsorted(query, [first, first + SIDE_BY_SIDE])
            asked = query[begin:end] - first
            who, score, column = treap.best(asked, rows[begin:end], weights[begin:end], k)
            found.append((who + first, column, score))
        who, column, score = (np.concatenate([f[i] for f in found]) for i in range(3))
        ids = np.array(shard["doc_ids"], dtype=object)[column]
        return pd.DataFrame({
            "query": np.array(numbers, np.int64)[who], "score": score,
            # kept as text: pandas would make numbers among nulls floats
            "doc_id": pd.array([None if i is None else int(i) for i in ids], dtype="Int64"),
        })

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, numbers = sent.value
        for batch in batches:
            for n in range(len(batch)):
                yield answers(batch.iloc[n].to_dict(), wanted, numbers)

    return shards.drop("counts").mapInPandas(search, "query long, score long, doc_id long")


def search(
    docs: DataFrame, queries: DataFrame, k: int = 10, points: int = POINTS, slice_terms: int = SLICE_TERMS
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of ``docs`` (doc_id, text) for each query
    (item_id, text), score above 0; equal scores by ascending doc_id, a null doc_id last.

    Null and empty texts have no terms: such documents are not counted, such queries have no
    result. Every row of ``queries`` is a query of its own, also with a null or repeated item_id;
    rows of ``docs`` with one doc_id are separate documents. A text is indexed whole, however
    long. Other columns are not used.
    """
    spark = docs.sparkSession
    size = corpus_size(docs)
    place = shared_path(spark, "index")
    index(docs, size, points).write.option("compression", "zstd").option("maxRecordsPerFile", SHARDS_A_FILE).parquet(place)
    shards = spark.read.schema(INDEX).parquet(place)
    asked = shared_path(spark, "queries")
    weighted(queries, shards, size[0]).write.parquet(asked)
    ready = spark.read.parquet(asked)

    answers = shared_path(spark, "answers")
    schema = "query long, score long, doc_id long"
    spark.createDataFrame([], schema).write.parquet(answers)
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    for part in _slices(ready, slice_terms):
        found = _searched(shards, part, k).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        found.drop("rank").write.mode("append").parquet(answers)
    ranked = spark.read.schema(schema).parquet(answers).withColumn("rank", F.row_number().over(best).cast("int"))
    return ranked.join(ready.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
