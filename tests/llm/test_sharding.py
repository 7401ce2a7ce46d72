"""Slots, maps and places against their laws."""

import zlib
from collections import Counter, defaultdict

from conftest_llm import empty_like
from pyspark.sql import functions as F

from tillwatch.llm import sharding
from tillwatch.llm.common import shared_path


def _placed(spark, docs, shards=sharding.SHARDS):
    return sharding.manifest(docs, shared_path(spark, "map"), shards).collect()


def test_sizes_are_near_and_places_have_no_gaps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    load, places = Counter(), defaultdict(list)
    for row in _placed(spark, docs):
        raw = (texts[row["doc_id"]] or "").encode()
        assert (row["size"], row["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        load[row["shard"]] += row["size"]
        places[row["shard"]].append(row["slot"])
    assert set(load) == set(range(16))
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    largest = max(len((t or "").encode()) + 1 for t in texts.values())
    assert max(load.values()) - min(load.values()) <= largest


def test_one_more_shard_takes_rows_only_into_itself(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = _placed(spark, docs)
    assert all(r["next_shard"] in (r["shard"], 16) for r in rows)
    moved = sum(r["size"] for r in rows if r["next_shard"] == 16)
    assert 0.6 < moved * 17 / sum(r["size"] for r in rows) < 1.5


def test_map_is_versioned_and_edited_for_fewer_shards(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = shared_path(spark, "map")
    sharding.manifest(docs, folder, 4).count()
    assert sharding.newest_version(spark, folder) == 2
    sizes = sharding.slot_sizes(sharding.slotted(sharding.prepared(docs))).cache()
    now = sharding.stored_map(spark, folder, 1)
    fewer = {r["slot"]: r["shard"] for r in sharding.edited_map(now, sizes, 3).collect()}
    before = {r["slot"]: r["shard"] for r in now.collect()}
    assert len(fewer) == len(before) == sharding.SLOTS
    assert set(fewer.values()) == {0, 1, 2}
    stayed = sum(fewer[s] == before[s] for s in before)
    assert stayed > 0.6 * sharding.SLOTS


def test_a_record_repeated_often_spans_slots(spark):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    slots = sharding.slotted(sharding.prepared(docs), copies=100).groupBy("virtual_slot").count().collect()
    assert len(slots) > 15
    assert sum(r["count"] for r in slots) == 3000
    few = sharding.slotted(sharding.prepared(docs.limit(50)), copies=100).select("virtual_slot").distinct().count()
    assert few == 1


def test_odd_and_no_documents(spark, odd_docs, odd_rows):
    rows = _placed(spark, odd_docs)
    want = Counter((d, len((t or "").encode()) + 1) for d, t, _ in odd_rows)
    assert Counter((r["doc_id"], r["size"]) for r in rows) == want
    assert _placed(spark, empty_like(spark, odd_docs)) == []
    folder = shared_path(spark, "map")
    sharding.manifest(odd_docs, folder).count()
    kept = sharding.sharded(odd_docs, sharding.stored_map(spark, folder, 1))
    assert kept.count() == len(odd_rows)
    assert set(kept.columns) == set(odd_docs.columns) | {"size", "virtual_slot", "shard"}
    assert _placed(spark, odd_docs) and sorted(map(str, _placed(spark, odd_docs))) == sorted(map(str, rows))
