"""License scans by diagonal voting.

All rolling word triples of the texts are joined with the triples of license
templates. A hit votes for its diagonal: text position minus template position.
Diagonals inside a stronger one far from it come from triples that a template
repeats, and are dropped. Neighbouring diagonals close together are one span (words
put in or left out move a quotation to the next diagonal), and a span counts when it
holds enough of its template and, against each template of another label, a triple
that the other has not. A phrase is a template that must stand whole on one diagonal.

The templates are a fixed list, so their triples may always be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 3
#: Words of the lower-cased text: digits, a to z and everything beyond ASCII.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Diagonals this near are one span when its hits follow each other within the gap.
DRIFT, GAP = 4, 12
#: Share of a template's triples that a span must hold.
ENOUGH = 0.6

# fixed values: phrases and their labels
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# fixed values: customary license notices and their labels
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial "
            "portions of the software"),
    ("mit", "licensed under the mit license"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
                 "with the license you may obtain a copy of the license at"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is "
                 "distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
              "public license as published by the free software foundation either version 2 of the license"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
              "public license as published by the free software foundation either version 3 of the license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("bsd", "released under the bsd license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def words(text: Column) -> Column:
    """Words with A-Z lower-cased. Other letters may change case too, but never into ASCII:
    the Kelvin sign, the one that would, is replaced first."""
    kept = F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u212b"))
    return F.regexp_extract_all(F.lower(kept), F.lit(WORDS), F.lit(0))


def triples(spark: SparkSession, phrases: dict[str, str], templates: list[tuple[str, str]]) -> DataFrame:
    """(hash, words, template, place, label, phrase, size) of every rolling triple of the fixed lists."""
    rows = [(n, label, text, n < len(phrases)) for n, (text, label) in enumerate(
        [*phrases.items(), *((text, label) for label, text in templates)]
    )]
    table = spark.createDataFrame(rows, "template int, label string, text string, phrase boolean")
    split = table.withColumn("_w", words(F.col("text"))).withColumn("size", F.size("_w") - (K - 1)).filter("size > 0")
    rolled = split.select("template", "label", "phrase", "size", F.posexplode(_rolling(F.col("_w"))).alias("place", "gram"))
    return rolled.filter("place < size").select("template", "label", "phrase", "size", "place", "gram.hash", "gram.words")


def _rolling(ws: Column) -> Column:
    """(hash, words) of the triple at each word; the last places of a text hold what is left, which no template has."""
    def gram(w: Column, i: Column) -> Column:
        three = [w, F.get(ws, i + 1), F.get(ws, i + 2)]
        return F.struct(F.xxhash64(*three).alias("hash"), F.array(*three).alias("words"))

    return F.transform(ws, gram)


def tells(table: DataFrame) -> DataFrame:
    """(template, tells): for each template of another label that holds enough of this one to be taken
    for it, the places of this one's triples that the other has not. From the rows of ``triples``."""
    grouped = table.filter(~F.col("phrase")).groupBy("template", "label", "size").agg(
        F.collect_list(F.struct("place", "words")).alias("own"), F.collect_set("words").alias("has")
    )
    others = grouped.select(F.col("label").alias("_label"), F.col("has").alias("_has")).filter(F.col("label").isNotNull())
    apart = F.transform(F.filter("own", lambda x: ~F.array_contains("_has", x["words"])), lambda x: x["place"])
    pairs = grouped.crossJoin(F.broadcast(others)).filter("label <> _label").select("template", "size", apart.alias("apart"))
    alike = (F.size("apart") > 0) & (F.size("apart") <= F.col("size") * (1 - ENOUGH))
    return pairs.filter(alike).groupBy("template").agg(F.collect_list("apart").alias("tells"))


def spans(
    docs: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None
) -> DataFrame:
    """One row per span, and one with null ``label`` for each document: _row, doc_id, n_words, label,
    phrase, first_word, last_word, share. Needs doc_id and text; ``_row`` tells documents apart."""
    phrases = PHRASES if phrases is None else phrases
    table = triples(docs.sparkSession, phrases, TEMPLATES if templates is None else templates)
    # one more triple of its own brings every document through the join
    every = F.struct(F.xxhash64(F.lit("every document"), F.lit(0)).alias("hash"), F.array(F.lit("")).alias("words"))
    own = docs.sparkSession.range(1).select(
        F.lit(-1).alias("template"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("phrase"),
        F.lit(1).alias("size"), F.lit(0).alias("place"), every["hash"].alias("hash"), every["words"].alias("words"),
    )
    cut = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", words(F.col("text")).alias("_w"))
    # each row of the explode has its three words; the array of all would make long texts quadratic
    grams = cut.select(
        "_row", "doc_id", F.size("_w").cast("long").alias("n_words"), F.array_append(_rolling(F.col("_w")), every).alias("_grams")
    )
    rolled = grams.select("_row", "doc_id", "n_words", F.posexplode("_grams").alias("at", "gram")).select(
        "_row", "doc_id", "n_words", "at", F.col("gram.hash").alias("hash"), F.col("gram.words").alias("_three")
    )
    hits = rolled.join(F.broadcast(table.unionByName(own)), "hash").filter(F.col("_three") == F.col("words")).select(
        "_row", "doc_id", "n_words", "template", "label", "phrase", "size",
        F.col("at").cast("long"), (F.col("at") - F.col("place")).cast("long").alias("diagonal"), "place",
    )
    hits = hits.repartition("_row")
    diagonals = hits.groupBy("_row", "doc_id", "n_words", "template", "label", "phrase", "size", "diagonal").agg(
        F.count("*").alias("votes"), F.min("at").alias("low"), F.max("at").alias("high"), F.collect_set("place").alias("places"),
    )
    alone = F.col("phrase") | F.col("label").isNull()
    before = (
        Window.partitionBy("_row", "template").orderBy("low", F.desc("high"), "diagonal")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    outer = F.max(F.struct("high", "votes", "diagonal")).over(before)
    stray = (
        ~alone & (F.col("_outer.high") >= F.col("high")) & (F.col("_outer.votes") > F.col("votes"))
        & (F.abs(F.col("diagonal") - F.col("_outer.diagonal")) > DRIFT)
    )
    straight = diagonals.withColumn("_outer", outer).filter(~F.coalesce(stray, F.lit(False)))
    order = Window.partitionBy("_row", "template").orderBy("low", "diagonal")
    far = (F.col("low") - F.lag("high").over(order) > GAP) | (
        F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > DRIFT
    )
    merged = (
        straight.withColumn("_new", F.coalesce(alone | far, F.lit(True)).cast("int"))
        .withColumn("_span", F.sum("_new").over(order))
        .groupBy("_row", "doc_id", "n_words", "template", "label", "phrase", "size", "_span")
        .agg(
            F.sum("votes").alias("votes"), F.min("low").alias("first_word"), (F.max("high") + (K - 1)).alias("last_word"),
            F.flatten(F.collect_list("places")).alias("places"),
        )
    )
    told = merged.join(F.broadcast(tells(table)), "template", "left")
    verified = told.filter(F.col("tells").isNull() | F.forall("tells", lambda apart: F.arrays_overlap(apart, "places")))
    share = F.least(F.col("votes") / F.col("size"), F.lit(1.0))
    needed = F.when(F.col("phrase"), F.lit(1.0)).otherwise(F.lit(ENOUGH))
    return verified.withColumn("share", share).filter(F.col("label").isNull() | (F.col("share") >= needed)).select(
        "_row", "doc_id", "n_words", "label", "phrase", "first_word", "last_word", "share"
    )


def scan(
    docs: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None
) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` counts the places of phrases, first_word and last_word are the smallest and
    largest start of one. ``labels`` adds those of template spans; ``score`` is the largest
    share of a template that a span holds. Null and empty texts have no words, no labels
    and score 0. Repeated rows and repeated or null ids are separate documents; columns
    other than doc_id and text are not read.
    """
    base = F.col("phrase")
    found = spans(docs, phrases, templates).groupBy("_row", "doc_id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).alias("last_word"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(base, F.col("label"))))).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.collect_set("label"))).alias("labels"),
        F.max(F.when(F.col("label").isNotNull(), F.col("share")).otherwise(0.0)).alias("score"),
    )
    return found.drop("_row")
