"""Merkle manifest of a dataset with incremental witnesses.

Leaves are appended in order. A leaf's witness is, level by level, the run of nodes it belongs
to and its place in it. On appending, it takes the nodes already in the open run as a partial
witness; the run is shared by all its members, so each later sibling that completes extends the
witnesses of all of them at once. A full run closes into a node, which is appended one level up.

Appending is distributed by aligned blocks of ``FANOUT ** BLOCK_LEVELS`` leaves: a block is
appended by one task, and the roots of blocks are further appends of the next round, until one
node per source is left. Going down again, a block's members get the block's own witness as
the upper part of theirs.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FANOUT = 16
BLOCK_LEVELS = 3

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return sha256(text.encode("ascii")).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[field(values[name]) for name in FIELDS]), 256)


class Run:
    """Neighbouring nodes of one level under one parent; the witnesses of all members share it."""

    __slots__ = ("text", "size", "parent")

    def __init__(self) -> None:
        self.text, self.size, self.parent = [], 0, None

    def add(self, node: str) -> int:
        self.text.append(node)
        self.size += 1
        return self.size - 1


class Appender:
    """One subtree, fed node by node. ``height`` fixes its levels (a block among others of its
    tree); without it, runs close until one node is left."""

    def __init__(self, height: int | None) -> None:
        self.height = height
        self.open: list[Run] = [Run()]
        self.counts = [0]
        self.members: list[tuple[Run, int]] = []
        self.root: str | None = None

    def append(self, node: str) -> None:
        self.members.append((self.open[0], self._add(0, node)))

    def _add(self, level: int, node: str) -> int:
        self.counts[level] += 1
        run = self.open[level]
        place = run.add(node)
        if run.size == FANOUT:
            self._close(level)
        return place

    def _close(self, level: int) -> None:
        """The open run becomes a node of the next level; a fresh run takes its place."""
        if level + 1 == len(self.open):
            self.open.append(Run())
            self.counts.append(0)
        run, self.open[level] = self.open[level], Run()
        above = self.open[level + 1]
        run.parent = (above, above.size)
        self._add(level + 1, digest("".join(run.text)))

    def _is_top(self, level: int) -> bool:
        return level == self.height if self.height is not None else self.counts[level] == 1

    def seal(self) -> str:
        """Close what is open, from the leaves up, and return the root."""
        level = 0
        while not (self._is_top(level) and self.open[level].size):
            if self.open[level].size:
                self._close(level)
            level += 1
        self.root = self.open[level].text[0]
        self.top = self.open[level]
        return self.root

    def witness(self, member: int) -> list[tuple[str, str]]:
        """(left, right) siblings of a member, level by level up to the root of this subtree."""
        run, place = self.members[member]
        steps = []
        while run is not self.top:
            steps.append(("".join(run.text[:place]), "".join(run.text[place + 1 :])))
            run, place = run.parent
        return steps


def fold(node: str, steps: list[tuple[str, str]]) -> str:
    """The root that ``node`` leads to along its witness."""
    for left, right in steps:
        node = digest(f"{left}{node}{right}")
    return node


def packed(steps: list[tuple[str, str]]) -> str:
    return ";".join(f"{left},{right}" for left, right in steps)


def unpacked(text: str) -> list[tuple[str, str]]:
    return [tuple(step.split(",")) for step in text.split(";")] if text else []


def ordered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """``rows`` (grp, ...) with pos, the place from 0 in the order of ``by`` within grp, and total, the rows of grp.

    Rows are dealt by ranges of (grp, by), so a busy group spans many tasks; a range adds the rows
    of the group in the ranges before it. ``by`` leaves no ties but between rows that are alike.
    """
    ranged = rows.repartitionByRange("grp", *by).sortWithinPartitions("grp", *by)
    ranged = written(ranged.withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33)
    pieces = ranged.groupBy("grp", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    own = Window.partitionBy("grp")
    before = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(
        "grp", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(own).alias("total"),
    )
    met = ranged.withColumn("part", part).join(starts, ["grp", "part"])
    return met.withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def block_of(pos: Column, levels: int) -> Column:
    return F.floor(pos / FANOUT**levels).cast("long")


def _tree(members: pd.DataFrame, levels: int) -> Appender:
    """The subtree of one block's nodes. It has its full height where its group has other blocks."""
    tree = Appender(levels if members["total"].iloc[0] > FANOUT**levels else None)
    for node in members["node"]:
        tree.append(node)
    tree.seal()
    return tree


def rounds_of(nodes: DataFrame, levels: int, name: str) -> list[DataFrame]:
    """``nodes`` (grp, pos, total, node), the roots of its blocks as the nodes of the next round, and so on, until
    every group is one node; at least one round. A round has the rows of the one before divided by the size of a block."""
    block = FANOUT**levels

    def roots(members: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values("pos")
        first = members.iloc[0]
        return pd.DataFrame({
            "grp": [first["grp"]], "pos": [first["pos"] // block], "total": [-(-first["total"] // block)],
            "node": [_tree(members, levels).root],
        })

    rounds = [nodes]
    while len(rounds) == 1 or not rounds[-1].filter("total > 1").isEmpty():
        blocks = rounds[-1].select("grp", "pos", "total", "node").groupBy("grp", block_of(F.col("pos"), levels))
        rounds.append(written(blocks.applyInPandas(roots, "grp string, pos long, total long, node string"), name))
    return rounds


def _with_upper(nodes: DataFrame, heads: DataFrame, each, levels: int, schema: str) -> DataFrame:
    """``each`` (the members of a block, their witnesses up to the end) of every block; a task holds one block at once."""

    def block(members: pd.DataFrame, head: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values("pos").reset_index(drop=True)
        tree, upper = _tree(members, levels), unpacked(head["upper"].iloc[0])
        return each(members, (tree.witness(n) + upper for n in range(len(members))))

    blocks = nodes.groupBy("grp", block_of(F.col("pos"), levels))
    return blocks.cogroup(heads.groupBy("grp", "pos")).applyInPandas(block, schema)


def _handed(members: pd.DataFrame, witnesses: Iterator[list[tuple[str, str]]]) -> pd.DataFrame:
    return pd.DataFrame({"grp": members["grp"], "pos": members["pos"], "upper": [packed(steps) for steps in witnesses]})


def uppers(rounds: list[DataFrame], above: DataFrame, levels: int, name: str, down_to: int = 0) -> DataFrame:
    """(grp, pos, upper): the witness of every node of round ``down_to``, given ``above`` (grp, upper) for the last
    round's. Every round hands its members, the blocks of the round below, their steps and its own."""
    now = rounds[-1].join(above, "grp").select("grp", "pos", "upper")
    for nodes in reversed(rounds[down_to:-1]):
        members = nodes.select("grp", "pos", "total", "node")
        now = written(_with_upper(members, now, _handed, levels, "grp string, pos long, upper string"), name)
    return now


def _proved(members: pd.DataFrame, witnesses: Iterator[list[tuple[str, str]]]) -> pd.DataFrame:
    proofs, folded = [], []
    for node, changed, steps in zip(members["node"], members["changed"], witnesses):
        proofs.append(digest("".join(left + right for left, right in steps)))
        folded.append(fold(changed or node, steps))
    return members.drop(columns=["total"]).assign(proof_sha256=proofs, folded_root=folded)


def manifest(docs: DataFrame, tampered: Column | None = None, levels: int = BLOCK_LEVELS) -> DataFrame:
    """One row per document: doc_id, source, pos, leaf, changed, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of doc_id, source, lang, n_chars and text; a subtree takes the leaves of
    one source by doc_id, the root the subtrees by source, nulls first. ``tampered`` says whose
    text is replaced by itself in lower case (A-Z) before its proof is folded again; ``changed`` is
    its leaf then. A block spans ``levels`` levels. Every value may be null or empty and counts as such; rows of one doc_id follow
    each other by leaf, equal rows are leaves of their own, a null doc_id comes first in its
    source. No documents give no rows. Other columns of ``docs`` are not used.
    """
    values = {name: F.col(name) for name in FIELDS}
    altered = leaf_of({**values, "text": F.translate(F.col("text"), UPPER, LOWER)})
    chosen = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    source = F.col("source").cast("string")
    leaves = docs.select(
        # nulls first, then by code point
        F.coalesce(F.concat(F.lit("1"), source), F.lit("0")).alias("grp"), "doc_id", leaf_of(values).alias("node"),
        F.when(chosen, altered).alias("changed"), F.monotonically_increasing_id().alias("tie"),
    )
    leaves = written(ordered(written(leaves, "leaves"), ["doc_id", "node", "tie"], "ordered").drop("tie"), "placed")
    rounds = rounds_of(leaves, levels, "round")
    subroots = rounds[-1].select("grp", F.col("node").alias("subroot"))

    sources = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("by"), F.col("subroot").alias("node"))
    sources = written(ordered(sources, ["by"], "sources"), "subroots")
    top = rounds_of(sources, levels, "top")
    none_above = top[-1].select("grp", F.lit("").alias("upper"))
    above = uppers(top, none_above, levels, "over").join(sources.select("pos", "by"), "pos").select(F.col("by").alias("grp"), "upper")
    facts = subroots.join(F.broadcast(top[-1].select(F.col("node").alias("root"))), F.lit(True))

    heads = uppers(rounds, above, levels, "upper", down_to=1)
    schema = (
        f"grp string, pos long, node string, doc_id {leaves.schema['doc_id'].dataType.simpleString()}, changed string, "
        "proof_sha256 string, folded_root string"
    )
    members = leaves.select("grp", "pos", "total", "node", "doc_id", "changed")
    proved = _with_upper(members, heads, _proved, levels, schema).join(facts, "grp")
    return proved.select(
        "doc_id", F.when(F.col("grp") != "0", F.expr("substring(grp, 2)")).alias("source"), "pos", F.col("node").alias("leaf"), "changed",
        "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )
