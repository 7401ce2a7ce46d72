"""Main text of web pages by template deduction.

A page is read as a row of tokens: tags with the path of elements around them, and,
outside articles, the words with theirs. Tokens of one host that occur equally often on
every page form an equivalence class. A class with enough tokens on enough of the host's
pages is part of the template when it is ordered (its tokens come in one sequence, repeated,
on every page) and nested (all its occurrences stand at one place of each class that holds
any of them, on every page; of two classes that are not, the one on more pages stays).

Nested classes make the host's template a tree, and what stands between two consecutive
tokens of a class, outside the classes inside it, is a slot. A slot is boilerplate when its
content repeats from page to page or is mostly links. Elements and classes of navigation,
forms, notices and the like, and articles, are the check on the slots: what they leave out
goes, and inside articles a slot goes only when it is links that repeat. The text of the
other slots is the main text; a page with an article has its text there.

Occurrence vectors are never gathered. Each token carries the sum of its pages' random
numbers, multiplied by its occurrences there; equal sums stand for equal vectors, and a
sum combines on the map side whatever the size of a host.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: A class needs this many tokens, pages, and share of its host's pages.
TOKENS, PAGES, SHARE = 3, 3, 0.5
#: The sums that stand for vectors are taken modulo this prime, so that a page of n copies can count as 1/n on each.
PRIME = (1 << 40) - 87
#: Template tokens of all hosts (or pages with copies) that may be broadcast; more are joined by shuffle.
BROADCAST_TOKENS = 500_000

# fixed values: how HTML elements behave
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var".split()
)
IMPLIED_END = frozenset("p li tr td th dt dd option".split())
CONTENT = frozenset("article main".split())
# fixed values: elements and classes that hold no main text
NOT_TEXT = frozenset(
    "head nav footer aside form button select template svg canvas object video audio dialog menu".split()
)
NOT_TEXT_CLASS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|cookies?|consent|notice|popup|modal|newsletter|promo\w*|sponsor\w*|sidebar|menu|"
    r"nav\w*|breadcrumbs?|footer|comments?|share|social|related|widget|toolbar|login|search)(?:$|[\s_-])",
    re.I,
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<(?![a-zA-Z/]))", re.S
)
#: A tag whose quotes do not close.
_BROKEN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)()>|</[^>]*>")
_WORDS = re.compile(r"\s+|\S+")
_CLASS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class Piece(NamedTuple):
    """Text between two tags."""

    block: int
    path: str
    text: str
    content: bool  # in an article
    out: bool  # in an element that holds no main text
    linked: bool


#: Of each token: its class, its place in the class's sequence, and the length of that.
Template = dict[int, tuple[int, int, int]]


class Place:
    """Where in the template's tree a page is read. ``slot`` numbers the innermost open class and its last token read."""

    def __init__(self) -> None:
        self.slot = 0
        self._open: list[list[int]] = []  # (class, place)

    def take(self, token: tuple[int, int, int] | None) -> bool:
        """Step over a token of the template; False where it is not the next one of its class."""
        if token is None:
            return False
        name, place, size = token
        depth = next((n for n in range(len(self._open) - 1, -1, -1) if self._open[n][0] == name), None)
        if place == 0:
            del self._open[len(self._open) if depth is None else depth :]
            self._open.append([name, 0])
        elif depth is None or self._open[depth][1] != place - 1:
            return False
        else:
            del self._open[depth + 1 :]
            self._open[depth][1] = place
            if place == size - 1:
                del self._open[depth]
        self.slot = _number("{} {}".format(*self._open[-1]) if self._open else f"after {name}")
        return True


class Reader:
    """One page. ``items`` are its tags, with their path, and pieces of text, in order."""

    def __init__(self, html: str | None) -> None:
        self.items: list[str | Piece] = []
        self._open: list[tuple[str, str, bool, bool]] = [("", "", False, False)]
        self._block = 0
        self._link = 0  # open elements around a link, 0 outside
        self._read(html or "")

    def _text(self, text: str) -> None:
        _, path, content, out = self._open[-1]
        self.items.append(Piece(self._block, path, text, content, out, 0 < self._link <= len(self._open)))

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            m = _TOKEN.match(html, at) or _BROKEN_TAG.match(html, at)
            if m is None:  # a tag that never ends
                return
            at = m.end()
            if m[4]:
                self._text(m[4])
            elif m[2]:  # comments and declarations have no name
                name = m[2].lower()
                if m[1]:
                    self._end(name)
                elif name in RAW:
                    close = re.compile(f"</{name}", re.I).search(html, at)
                    at = close.start() if close else size
                    if close:
                        at = html.find(">", at) + 1 or size
                else:
                    self._start(name, m[3])

    def _start(self, name: str, attributes: str) -> None:
        if name in VOID:
            if name == "br":
                self._text(" ")
            elif name == "hr":
                self._block += 1
            return
        marks = " ".join(a or b or c for a, b, c in _CLASS.findall(attributes)) if attributes else ""
        left_out = bool(marks and NOT_TEXT_CLASS.search(marks))
        if name == "a":
            self._link = len(self._open)
        if name in INLINE and not left_out:
            return
        if name not in INLINE:
            self._block += 1
            if name in IMPLIED_END and self._open[-1][0] == name:
                self._open.pop()
        _, path, content, out = self._open[-1]
        left_out = left_out or name in NOT_TEXT or (name == "header" and not content)
        label = name + (f".{re.sub(r'[0-9]+', '0', marks)}" if marks else "")
        self.items.append(f"{path}<{label}")
        self._open.append((name, f"{path}/{label}", content or name in CONTENT, out or left_out))

    def _end(self, name: str) -> None:
        if name not in INLINE:
            self._block += 1
        elif name == "a":
            self._link = 0
        for depth in range(len(self._open) - 1, 0, -1):
            if self._open[depth][0] == name:
                self.items.append(f"{self._open[depth][1]}>")
                del self._open[depth:]
                return
            if self._open[depth][0] in CONTENT and name not in ("body", "html"):
                return

    def roles(self) -> list[int]:
        """Numbers of the tokens that may be template, in page order: tags, and the words outside articles."""
        out = []
        for item in self.items:
            if isinstance(item, str):
                out.append(_number(item))
            elif not item.content:
                out.extend(_number(f"{item.path} {w}") for w in item.text.split())
        return out

    def slots(self, template: Template) -> Iterator[tuple[int, Piece, str]]:
        """(slot, piece, text) of what stands between the template's tokens. An article keeps all of its
        words: a word that happens to stand once on every page of a small host is not template."""
        place = Place()
        for item in self.items:
            if isinstance(item, str):
                if template:
                    place.take(template.get(_number(item)))
                continue
            if item.content or not template:
                yield place.slot, item, item.text
                continue
            text = ""
            for part in _WORDS.findall(item.text):
                slot = place.slot
                if part.isspace() or not place.take(template.get(_number(f"{item.path} {part}"))):
                    text += part
                elif text:
                    yield slot, item, text
                    text = ""
            if text:
                yield place.slot, item, text

    def text(self, template: Template, left_out: frozenset[int] = frozenset()) -> str:
        """Text of the slots but ``left_out``, block by block."""
        found = [
            (piece.block, text, piece.content)
            for slot, piece, text in self.slots(template)
            if not piece.out and slot not in left_out
        ]
        article = any(content and text.strip() for _, text, content in found)
        blocks: dict[int, list[str]] = defaultdict(list)
        for block, text, content in found:
            if content == article:
                blocks[block].append(text)
        joined = (" ".join(unescape("".join(parts)).split()) for parts in blocks.values())
        return "\n".join(b for b in joined if b)


def _number(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass")) - (1 << 63)


def _occurrences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per host and token of a batch: pages, occurrences, and the sum that stands for the vector."""
    for batch in batches:
        found: dict = defaultdict(lambda: [0.0, 0.0, 0])
        for host, key, copies, html in zip(batch["host"], batch["key"].tolist(), batch["copies"].tolist(), batch["html"]):
            share = key * pow(copies, -1, PRIME)
            for role, times in Counter(Reader(html).roles()).items():
                entry = found[host, role]
                entry[0] += 1 / copies
                entry[1] += times / copies
                entry[2] += times * share
        rows = [(h, r, n, t, s % PRIME) for (h, r), (n, t, s) in found.items()]
        yield pd.DataFrame(rows, columns=["host", "role", "pages", "times", "vector"])


def _relations(page: Reader, classes: dict[int, int]) -> tuple[dict[int, tuple[int, list[int]]], Counter]:
    """(occurrences, sequence of tokens) of the classes on a page, (0, []) where it is not one sequence, repeated; and how
    often an occurrence of a class starts at a place of another, (class, other, place), with place -1 where they overlap."""
    found = [role for role in page.roles() if role in classes]
    rows: dict[int, list[int]] = defaultdict(list)
    for role in found:
        rows[classes[role]].append(role)
    sizes = Counter(classes.values())
    orders, places = {}, {}
    for name, row in rows.items():
        base = row[: sizes[name]]
        whole = len(set(base)) == sizes[name] and row == base * (len(row) // sizes[name])
        orders[name] = (len(row) // sizes[name], base) if whole else (0, [])
        if whole:
            places.update((role, place) for place, role in enumerate(base))
    held: Counter = Counter()
    begun: Counter = Counter()
    at: dict[int, int] = {}  # open classes
    around: dict[int, dict[int, tuple[int, int]]] = {}  # and what was open when they began
    for role in found:
        if role not in places:
            continue
        name, place = classes[role], places[role]
        if place == 0:
            begun[name] += 1
            around[name] = {other: (begun[other], p) for other, p in at.items()}
            held.update((name, other, p) for other, p in at.items())
        at[name] = place
        if place == sizes[name] - 1:
            del at[name]
            for other, then in around.pop(name).items():
                if (begun[other], at.get(other)) != then:
                    held[name, other, -1] += 1
    return orders, held


def _nestings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per host and class of a batch: its sequences (``other`` is null), and its places in other classes."""
    for batch in batches:
        known: dict = {}
        orders: Counter = Counter()
        held: Counter = Counter()
        for host, html, roles, names in zip(batch["host"], batch["html"], batch["roles"], batch["names"]):
            if host not in known:
                known[host] = dict(zip(list(roles), list(names)))
            sequences, places = _relations(Reader(html), known[host])
            for name, (times, base) in sequences.items():
                orders[host, name, tuple(base)] += times
            for (name, other, place), times in places.items():
                held[host, name, other, place] += times
        rows = [(h, n, None, None, list(base), times) for (h, n, base), times in orders.items()]
        rows += [(h, n, other, place, None, times) for (h, n, other, place), times in held.items()]
        # object columns: with nulls, pandas would make whole numbers inexact
        yield pd.DataFrame(rows, columns=["host", "name", "other", "place", "base", "times"], dtype=object)


def _template(row: tuple | None) -> Template:
    """The template of a host from its arrays."""
    if row is None or row[0] is None:
        return {}
    roles, names, places, sizes = (list(map(int, column)) for column in row)
    return dict(zip(roles, zip(names, places, sizes)))


def _filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per host, slot and content of a batch: pages, and words: all, linked, left out by their elements, in an article."""
    for batch in batches:
        known: dict = {}
        found: dict = defaultdict(lambda: [0.0, 0, 0, 0, 0])
        columns = [batch[c] for c in ("host", "html", "copies", *TREE)]
        for host, html, copies, *row in zip(*columns):
            if host not in known:
                known[host] = _template(row)
            slots: dict = defaultdict(lambda: [[], 0, 0, 0])
            for slot, piece, text in Reader(html).slots(known[host]):
                words = text.split()
                entry = slots[slot]
                entry[0].extend(words)
                for n, mark in enumerate((piece.linked, piece.out, piece.content), 1):
                    entry[n] += len(words) if mark else 0
            for slot, (words, *marked) in slots.items():
                if words:
                    entry = found[host, slot, _number(" ".join(words))]
                    entry[0] += 1 / copies
                    for n, count in enumerate((len(words), *marked), 1):
                        entry[n] += count
        rows = [(*key, *entry) for key, entry in found.items()]
        yield pd.DataFrame(rows, columns=["host", "slot", "content", "pages", "words", "linked", "out", "article"])


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        known: dict = {}
        out = []
        for host, html, slots, *row in zip(*[batch[c] for c in ("host", "html", "left_out", *TREE)]):
            if host not in known:
                known[host] = _template(row), frozenset(() if slots is None else map(int, slots))
            out.append(Reader(html).text(*known[host]))
        yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": out})


#: Columns of a host's template: per token its number, its class, its place in that, and the class's length.
TREE = ["roles", "names", "places", "sizes"]


def templates(pages: DataFrame) -> DataFrame:
    """(host, roles, names, places, sizes) of ``pages`` (host, html): every host's template, from all of its pages, as its
    tokens with their class, their place in its sequence and that one's length. With a column ``copies`` (n), each of the n equal rows of a page counts as 1/n."""
    if "copies" not in pages.columns:
        pages = pages.withColumn("copies", F.lit(1).cast("long"))
    # copies of a page share its number
    each = F.when(F.col("copies") == 1, F.monotonically_increasing_id()).otherwise(F.lit(-1))
    keyed = pages.filter("host is not null").select(
        "host", "html", "copies", F.pmod(F.xxhash64("host", "html", each), F.lit(PRIME)).alias("key")
    )
    counted = keyed.mapInPandas(_occurrences, "host string, role long, pages double, times double, vector long")
    vector = F.pmod(F.sum(F.col("vector").cast("decimal(20,0)")), F.lit(PRIME).cast("decimal(20,0)")).cast("long")
    whole = [F.round(F.sum(c)).cast("long").alias(c) for c in ("pages", "times")]
    tokens = counted.groupBy("host", "role").agg(*whole, vector.alias("vector"))
    tokens = written(tokens.filter(F.col("pages") >= PAGES), "tokens")
    sizes = pages.groupBy("host").agg(F.round(F.sum(F.lit(1.0) / F.col("copies"))).alias("all_pages"))
    often = tokens.join(sizes, "host").filter(F.col("pages") >= F.col("all_pages") * SHARE)
    classes = often.groupBy("host", "pages", "times", "vector").agg(F.collect_list("role").alias("roles"))
    named = classes.filter(F.size("roles") >= TOKENS).withColumn("name", F.xxhash64("pages", "times", "vector"))
    named = written(named.select("host", "name", "pages", "roles"), "classes")
    flat = named.select("host", "name", F.explode("roles").alias("role"))
    by_host = flat.groupBy("host").agg(F.collect_list(F.struct("role", "name")).alias("m"))
    by_host = by_host.select("host", F.col("m.role").alias("roles"), F.col("m.name").alias("names"))
    met = pages.select("host", "html").join(_small(by_host), "host").select("host", "html", "roles", "names")
    kind = "host string, name long, other long, place long, base array<long>, times long"
    found = written(met.mapInPandas(_nestings, kind), "nestings")
    one = found.filter("other IS NULL").groupBy("host", "name").agg(
        F.min("base").alias("base"), F.max("base").alias("_last"), F.sum("times").alias("all_times")
    )
    one = one.filter((F.col("base") == F.col("_last")) & (F.size("base") > 0)).drop("_last")
    valid = written(one.join(named.select("host", "name", "pages"), ["host", "name"]), "ordered")
    kept = _nested(valid, found.filter("other IS NOT NULL"))
    rows = valid.join(kept, ["host", "name"], "left_semi").select(
        "host", "name", F.size("base").cast("long").alias("size"), F.posexplode("base").alias("place", "role")
    )
    token = F.struct("role", "name", F.col("place").cast("long").alias("place"), "size")
    rows = rows.groupBy("host").agg(F.collect_list(token).alias("m"))
    return rows.select("host", *[F.col(f"m.{c}").alias(n) for c, n in zip(("role", "name", "place", "size"), TREE)])


def _nested(valid: DataFrame, held: DataFrame) -> DataFrame:
    """(host, name) of the ordered classes that nest: by pages and length, each that nests with all kept before it."""
    places = held.groupBy("host", "name", "other").agg(
        F.min("place").alias("a"), F.max("place").alias("b"), F.sum("times").alias("times")
    )
    names = valid.select("host", "name", "all_times")
    places = places.join(names, ["host", "name"]).join(names.select("host", F.col("name").alias("other")), ["host", "other"])
    bad = places.filter("a <> b OR a < 0 OR times <> all_times").select("host", "name", "other")
    both = bad.unionByName(bad.select("host", F.col("other").alias("name"), F.col("name").alias("other")))
    foes = both.groupBy("host", "name").agg(F.collect_set("other").alias("foes"))
    ranked = valid.join(foes, ["host", "name"], "left").select(
        "host",
        F.struct(
            (-F.col("pages")).alias("pages"), (-F.size("base")).alias("size"), "name",
            F.coalesce("foes", F.array().cast("array<long>")).alias("foes"),
        ).alias("c"),
    )
    kept = F.aggregate(
        F.array_sort(F.collect_list("c")),
        F.array().cast("array<long>"),
        lambda kept, c: F.when(F.arrays_overlap(kept, c["foes"]), kept).otherwise(F.array_append(kept, c["name"])),
    )
    return ranked.groupBy("host").agg(kept.alias("kept")).select("host", F.explode("kept").alias("name"))


def boilerplate(pages: DataFrame, trees: DataFrame) -> DataFrame:
    """(host, left_out) of ``pages`` (host, html, copies): the slots of every host's template that are no main text."""
    met = pages.join(trees, "host").select("host", "html", "copies", *TREE)
    kind = "host string, slot long, content long, pages double, words long, linked long, out long, article long"
    counts = ["pages", "words", "linked", "out", "article"]
    contents = met.mapInPandas(_filled, kind).groupBy("host", "slot", "content").agg(*[F.sum(c).alias(c) for c in counts])
    # pages that hold what another one holds there
    contents = contents.withColumn("shared", F.when(F.round("pages") > 1, F.col("pages")).otherwise(0.0))
    slots = contents.groupBy("host", "slot").agg(*[F.sum(c).alias(c) for c in ("shared", *counts)])
    slots = slots.withColumn("own", F.col("words") - F.col("out"))
    # the slot that holds most of a host's words is its text, however much its pages are alike
    slots = slots.withColumn("largest", F.max("own").over(Window.partitionBy("host")) == F.col("own"))
    repeats = (F.round("pages") >= PAGES) & (F.col("shared") * 2 > F.col("pages")) & ~F.col("largest")
    links = F.col("linked") * 2 > F.col("words")
    inside = F.col("article") * 2 > F.col("words")
    left_out = F.when(F.col("out") * 2 > F.col("words"), False).when(inside, repeats & links).otherwise(repeats | links)
    return slots.filter(left_out).groupBy("host").agg(F.collect_list("slot").alias("left_out"))


def _contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        content = [_number(Reader(html).text(frozenset())) for html in batch["html"]]
        yield batch[["host", "hash"]].assign(content=content)


def distinct_contents(pages: DataFrame) -> DataFrame:
    """(host, html, copies) of ``pages`` (host, html): of the pages of a host that have one text, those equal
    to the first, with their number: copies do not make a template. The pages themselves are not dealt anew."""
    pages = pages.filter("host is not null").withColumn("hash", F.xxhash64("html"))
    read = pages.mapInPandas(_contents, "host string, hash long, content long")
    equal = written(read.groupBy("host", "content", "hash").agg(F.count("*").alias("copies")), "contents")
    texts = equal.groupBy("host", "content").agg(F.sum("copies").alias("_n"), F.min("hash").alias("_first")).filter("_n > 1")
    counted = F.when(F.col("hash") == F.col("_first"), F.col("copies")).otherwise(0)
    several = written(equal.join(texts, ["host", "content"]).select("host", "hash", counted.alias("copies")), "copies")
    if several.count() <= BROADCAST_TOKENS:
        several = F.broadcast(several)
    met = pages.join(several, ["host", "hash"], "left").withColumn("copies", F.coalesce("copies", F.lit(1).cast("long")))
    return met.filter("copies > 0").select("host", "html", "copies")


def _small(by_host: DataFrame) -> DataFrame:
    """Broadcast the hosts' tokens when they are few, else leave the join to the optimizer."""
    by_host = written(by_host, "by-host")
    tokens = by_host.agg(F.sum(F.size("roles"))).first()[0] or 0
    return F.broadcast(by_host) if tokens <= BROADCAST_TOKENS else by_host


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    Character references are decoded, white space inside a block becomes one space, blocks are
    joined by a line feed in page order. Null and empty pages have empty text. Pages without a
    host in their url share no template. Broken markup is read as far as it goes; a tag that
    never ends ends the page. Repeated rows are pages of their own, however many; other columns
    are not read.
    """
    host = F.lower(F.call_function("try_parse_url", F.col("url"), F.lit("HOST")))
    hosted = pages.select("page_id", "url", "html", host.alias("host"))
    distinct = distinct_contents(hosted.select("host", "html"))
    trees = _small(templates(distinct))
    found = _small(trees.join(boilerplate(distinct, trees), "host", "left"))
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    met = hosted.join(found, "host", "left").select("page_id", "url", "host", "html", "left_out", *TREE)
    out = met.mapInPandas(_texts, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
