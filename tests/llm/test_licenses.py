"""License templates against their siblings."""

import random
import time

import duckdb
from oracle import duck_rows, spark_rows

from tillwatch.llm import licenses
from tillwatch.llm.oracles import licenses_sql


def test_each_template_gets_its_own_label_only(spark):
    rows = [(n, f"some words before {text} and some after") for n, (_, text) in enumerate(licenses.TEMPLATES)]
    # one word put in, and one that tells the templates apart replaced
    rows += [(100, "this work is licensed under a creative EVERY commons attribution noncommercial 4 0 international license")]
    rows += [(101, "this work is licensed under a creative commons attribution noderivs 4 0 international license")]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[n] for n in range(len(licenses.TEMPLATES))] == [label for label, _ in licenses.TEMPLATES]
    assert got[100] == "cc-by-nc" and got[101] == ""


def test_repeated_triple_does_not_split_an_edited_quotation(spark):
    # "the license you" stands twice in this template; "every" moves the rest to the next diagonal
    long = next(text for label, text in licenses.TEMPLATES if label == "apache-2" and "may not use this file" in text)
    rows = [(1, long.replace("use this file", "use every this file"))]
    got = licenses.scan(
        spark.createDataFrame(rows, "doc_id long, text string"), phrases={}, templates=[("apache-2", long)]
    ).first()
    assert got["labels"] == "apache-2" and got["score"] == 27 / 29


def test_edited_notices_equal_sql(spark, tmp_path):
    draw = random.Random(3)
    filler = "alpha beta gamma delta".split()
    rows = [(0, None), (0, ""), (1, "under the mit license " * 40)]
    for n in range(400):
        text = []
        for _ in range(draw.randint(1, 3)):
            quoted = draw.choice(licenses.TEMPLATES)[1].split()
            for _ in range(draw.randint(0, 5)):
                at = draw.randrange(len(quoted))
                quoted[at:at + draw.randint(0, 1)] = draw.choice([[], ["EVERY"], quoted[:4], ["one", "two"]])
                quoted = quoted or ["none"]
            text += draw.choices(filler, k=draw.randint(0, 15)) + quoted
        rows.append((n, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    assert spark_rows(licenses.scan(docs)) == duck_rows(con, licenses_sql())


def test_long_text_is_linear(spark):
    """One text of eight times the words takes about eight times as long, not sixty-four times."""
    def seconds(n):
        docs = spark.createDataFrame([(1, "licensed under some words " * (n // 4))], "doc_id long, text string")
        start = time.time()
        assert licenses.scan(docs).first()["n_words"] == n
        return time.time() - start

    seconds(1_000)
    short, long = seconds(20_000), seconds(160_000)
    assert long < 16 * short
