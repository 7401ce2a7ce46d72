"""Language-model scores by deleted interpolation.

The probability of a token mixes the maximum-likelihood estimates of all orders, from
n-gram down to uniform. The weights depend on how often the context was seen, in
buckets by powers of two, and are learned by expectation-maximisation on documents
held out of the counts. Final counts then take in the held-out documents too.

Counting moves blocks, not tokens. Documents are tokenised once into chunks; a chunk
sends the hashes of its distinct n-grams, cut into ranges, to the tasks that add up a
range over all chunks, and gets the totals back in the same order. A frequent n-gram
is one entry per chunk, whatever its number of occurrences. Tuning documents form
chunks of their own a second time, which only ask.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

ORDER = 2
#: Tokens of a chunk (a document is never cut) and n-grams of a range.
CHUNK, RANGE = 2_000_000, 1_000_000
#: Context frequencies by powers of two; the last bucket takes all above.
BUCKETS = 40
#: Steps per factor of two in which held-out probabilities are counted for the weights.
STEPS, ROUNDS = 8, 60
_START = np.uint64(0x9E3779B97F4A7C15)
_END = np.uint64(xxhash.xxh64_intdigest(b""))
OTHER, KEPT, TUNING = 0, 1, 2


def tokens(text: str | None) -> list[bytes]:
    """Words between white space, A-Z lower-cased; the end is added by the caller."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _packed(values: np.ndarray) -> bytes:
    """Unsigned numbers in the smallest width, byte planes apart, compressed."""
    top = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
    planes = values.astype(f"<u{width}").view("u1").reshape(-1, width).T.tobytes()
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes)


def _unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), dtype="u1")
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(f"<u{width}").ravel().astype("uint64")


def _steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=np.uint64(0))


def _mixed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit hash of an n-gram from the hash of its context and that of its last word."""
    x = context * np.uint64(0xD1342543DE82EF95) + word
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Chunk:
    """Documents as word numbers; n-gram hashes of every order per token."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> None:
        self.lengths = lengths
        self.first = np.cumsum(lengths) - lengths
        self.hashes, self.words = hashes, words

    def orders(self, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(sorted distinct hashes, place of each token's n-gram among them) of orders 1, 2, ..."""
        grams = self.hashes[self.words]
        for n in range(1, order + 1):
            if n > 1:
                context = np.concatenate([[_START], grams[:-1]])
                context[self.first] = _START
                grams = _mixed(context, self.hashes[self.words])
            yield np.unique(grams, return_inverse=True)


def _chunk_row(docs: list, asks: bool) -> dict:
    number: dict = defaultdict(count().__next__)
    place = number.__getitem__
    words, lengths = [], []
    for _, text, _ in docs:
        found = tokens(text)
        found.append(b"")
        words.append(np.array(list(map(place, found)), dtype="int32"))
        lengths.append(len(found))
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in number], dtype="uint64")
    return {
        "doc_ids": [d[0] for d in docs], "kinds": bytes(d[2] for d in docs), "lengths": _packed(np.array(lengths, "uint64")),
        "words": _packed(np.concatenate(words).astype("uint64")), "hashes": hashes.tobytes(), "asks": asks,
        "tokens": int(sum(lengths)),
    }


def _chunk_of(row) -> tuple[Chunk, np.ndarray]:
    lengths = _unpacked(row["lengths"]).astype("int64")
    hashes = np.frombuffer(row["hashes"], dtype="uint64")
    return Chunk(_unpacked(row["words"]).astype("int64"), lengths, hashes), np.frombuffer(row["kinds"], dtype="u1")


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[bool, list] = {False: [], True: []}
    size = {False: 0, True: 0}
    for batch in batches:
        for doc in zip(batch["doc_id"].tolist(), batch["text"], batch["kind"].tolist()):
            for asks in (False, True):
                if not asks or doc[2] == TUNING:
                    held[asks].append(doc)
                    size[asks] += len(doc[1] or "") // 5 + 1
                    if size[asks] >= CHUNK:
                        yield pd.DataFrame([_chunk_row(held[asks], asks)])
                        held[asks], size[asks] = [], 0
    for asks in (False, True):
        if held[asks]:
            yield pd.DataFrame([_chunk_row(held[asks], asks)])


def _requests(ranges: int, order: int):
    """Rows (chunk, n, range, hashes, kept, tuning) of a chunk's distinct n-grams."""
    edges = (np.arange(1, ranges, dtype="object") * (1 << 64) // ranges).astype("uint64")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                chunk, kinds = _chunk_of(row)
                kind = np.repeat(kinds, chunk.lengths)
                out = []
                for n, (distinct, place) in enumerate(chunk.orders(order), 1):
                    seen = [
                        np.zeros(len(distinct), "uint64") if row["asks"]
                        else np.bincount(place[kind == k], minlength=len(distinct)).astype("uint64")
                        for k in (KEPT, TUNING)
                    ]
                    cut = np.concatenate([[0], np.searchsorted(distinct, edges), [len(distinct)]])
                    for r in range(ranges):
                        a, b = cut[r], cut[r + 1]
                        if a < b:
                            part = [_packed(_steps(distinct[a:b])), _packed(seen[0][a:b]), _packed(seen[1][a:b])]
                            out.append((row["chunk"], n, r, *part))
                yield pd.DataFrame(out, columns=["chunk", "n", "range", "hashes", "kept", "tuning"])

    return ask


def _totals(rows: pd.DataFrame) -> pd.DataFrame:
    """Totals of one range, sent back to every chunk in its order; one more row counts the n-grams seen."""
    hashes = [np.cumsum(_unpacked(x), dtype="uint64") for x in rows["hashes"]]
    distinct, place = np.unique(np.concatenate(hashes), return_inverse=True)
    sums = []
    for name in ("kept", "tuning"):
        each = np.concatenate([_unpacked(x) for x in rows[name]])
        total = np.zeros(len(distinct), dtype="uint64")
        np.add.at(total, place, each)
        sums.append(total)
    ends = np.cumsum([len(h) for h in hashes])
    parts = [place[e - len(h) : e] for h, e in zip(hashes, ends)]
    out = rows[["chunk", "n", "range"]].copy()
    out["kept"], out["tuning"] = ([_packed(s[p]) for p in parts] for s in sums)
    out["types_kept"], out["types"] = 0, 0
    seen = pd.DataFrame(
        [(-1, rows["n"].iloc[0], rows["range"].iloc[0], b"", b"", int((sums[0] > 0).sum()), int(((sums[0] + sums[1]) > 0).sum()))],
        columns=out.columns,
    )
    return pd.concat([out, seen], ignore_index=True)


def _counts(row, answers: pd.DataFrame, order: int, tuning: bool) -> tuple[Chunk, list[np.ndarray]]:
    """Per order, every token's n-gram count among kept documents, or among all of training."""
    chunk, _ = _chunk_of(row)
    answers = answers.sort_values(["n", "range"])
    out = []
    for n, (_, place) in enumerate(chunk.orders(order), 1):
        mine = answers[answers["n"] == n]
        total = np.concatenate([_unpacked(x) for x in mine["kept"]])
        if not tuning:
            total = total + np.concatenate([_unpacked(x) for x in mine["tuning"]])
        out.append(total[place].astype("float64"))
    return chunk, out


def _components(chunk: Chunk, counts: list[np.ndarray], size: float, types: float, docs: float):
    """(bucket of the longest context, [p of order 0, 1, ...]) of every token."""
    p = [np.full(len(counts[0]), 1.0 / (types + 1.0)), counts[0] / max(size, 1.0)]
    context = np.full(len(counts[0]), docs)
    for n in range(1, len(counts)):
        context = np.concatenate([[docs], counts[n - 1][:-1]])
        context[chunk.first] = docs
        p.append(np.where(context > 0, counts[n] / np.maximum(context, 1.0), 0.0))
    bucket = np.minimum(np.floor(np.log2(context + 1.0)), BUCKETS - 1).astype("int64")
    return bucket, p


def _steps_of(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.floor(-np.log2(np.maximum(p, 1e-300)) * STEPS).astype("int64"), -1)


def weights(cells: pd.DataFrame, order: int) -> np.ndarray:
    """Mixture weights per bucket from held-out cells (bucket, steps of each order's p, number), by EM.

    A bucket with little held-out text is held near the weights of all buckets together.
    """
    steps = cells[[f"p{n}" for n in range(order + 1)]].to_numpy()
    p = np.where(steps < 0, 0.0, 2.0 ** (-(steps + 0.5) / STEPS))
    number, bucket = cells["number"].to_numpy(dtype="float64"), cells["bucket"].to_numpy()
    out = np.full((BUCKETS, order + 1), 1.0 / (order + 1))
    if not len(cells):
        return out
    common = out[0].copy()
    for _ in range(ROUNDS):
        share = p * common
        common = (share / share.sum(axis=1, keepdims=True) * number[:, None]).sum(axis=0) / number.sum()
    out[:] = common
    for b in np.unique(bucket):
        mine = bucket == b
        for _ in range(ROUNDS):
            share = p[mine] * out[b]
            held = (share / share.sum(axis=1, keepdims=True) * number[mine, None]).sum(axis=0)
            out[b] = (held + 10.0 * common) / (held.sum() + 10.0)
    return out


def score(docs: DataFrame, training: Column, tuning: Column, order: int = ORDER) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs`` (doc_id, text).

    ``training`` marks the documents to learn from; those of them that ``tuning`` marks too
    teach the weights. ``base_score`` is the add-one unigram log10 probability, ``score`` the
    interpolated one; the end of a document is a token, so a null or empty text has one.
    Without training documents all estimates are uniform. Repeated rows are documents of
    their own; other columns are not read.
    """
    kind = F.when(training & tuning, TUNING).when(training, KEPT).otherwise(OTHER)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    chunks = docs.select("doc_id", "text", F.coalesce(kind, F.lit(OTHER)).alias("kind")).mapInPandas(
        _chunks,
        f"doc_ids array<{id_type}>, kinds binary, lengths binary, words binary, hashes binary, asks boolean, tokens long",
    )
    chunks = written(chunks.withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    total = chunks.agg(F.sum("tokens")).first()[0] or 0
    ranges = max(1, -(-total // RANGE))
    binary = "hashes binary, kept binary, tuning binary"
    asked = chunks.select("chunk", "kinds", "lengths", "words", "hashes", "asks").mapInPandas(
        _requests(ranges, order), f"chunk long, n int, range int, {binary}"
    )
    answers = asked.groupBy("n", "range").applyInPandas(
        _totals, "chunk long, n int, range int, kept binary, tuning binary, types_kept long, types long"
    )
    answers = written(answers, "totals")
    seen = answers.filter("chunk = -1 and n = 1").agg(F.sum("types_kept"), F.sum("types")).first()
    types_kept, types = (float(x or 0) for x in seen)
    sizes = _sizes(chunks)
    kept_size, kept_docs = sizes[KEPT]
    size, number = (sizes[KEPT][i] + sizes[TUNING][i] for i in (0, 1))
    answers = answers.filter("chunk >= 0").drop("types_kept", "types")

    def held_out(row: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        names = ["bucket", *[f"p{n}" for n in range(order + 1)], "number"]
        if row.empty:
            return pd.DataFrame(columns=names)
        chunk, counts = _counts(row.iloc[0], mine, order, tuning=True)
        bucket, p = _components(chunk, counts, kept_size, types_kept, kept_docs)
        cells, times = np.unique(np.column_stack([bucket, *map(_steps_of, p)]), axis=0, return_counts=True)
        return pd.DataFrame(np.column_stack([cells, times]), columns=names)

    steps = ", ".join(f"p{n} long" for n in range(order + 1))
    askers = chunks.filter("asks")
    asked_answers = answers.join(F.broadcast(askers.select("chunk")), "chunk", "left_semi")
    cells = (
        askers.groupBy("chunk").cogroup(asked_answers.groupBy("chunk")).applyInPandas(held_out, f"bucket long, {steps}, number long")
    )
    keys = ["bucket", *[f"p{n}" for n in range(order + 1)]]
    cells = cells.groupBy(*keys).agg(F.sum("number").alias("number")).toPandas().sort_values(keys)
    mixture = weights(cells, order)

    def scored(row: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if row.empty:
            return pd.DataFrame(columns=names)
        chunk, counts = _counts(row.iloc[0], mine, order, tuning=False)
        bucket, p = _components(chunk, counts, size, types, number)
        chance = sum(mixture[bucket, n] * p[n] for n in range(order + 1))
        base = np.log10((counts[0] + 1.0) / (size + types + 1.0))
        sums = [np.add.reduceat(x, chunk.first) for x in ((counts[0] > 0).astype("int64"), base, np.log10(chance))]
        columns = [list(row.iloc[0]["doc_ids"]), chunk.lengths, sums[0], int(size), sums[1], sums[2]]
        return pd.DataFrame(dict(zip(names, columns)))

    schema = f"doc_id {id_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    mine = chunks.filter("not asks")
    return mine.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(scored, schema)


def _sizes(chunks: DataFrame) -> dict[int, tuple[float, float]]:
    """Tokens and documents of each kind, over all chunks."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                kinds, lengths = np.frombuffer(row["kinds"], dtype="u1"), _unpacked(row["lengths"]).astype("int64")
                yield pd.DataFrame(
                    [(k, int(lengths[kinds == k].sum()), int((kinds == k).sum())) for k in (KEPT, TUNING)],
                    columns=["kind", "tokens", "docs"],
                )

    rows = chunks.filter("not asks").select("kinds", "lengths").mapInPandas(each, "kind int, tokens long, docs long")
    sums = {r["kind"]: (float(r["t"]), float(r["d"])) for r in rows.groupBy("kind").agg(F.sum("tokens").alias("t"), F.sum("docs").alias("d")).collect()}
    return {k: sums.get(k, (0.0, 0.0)) for k in (KEPT, TUNING)}
