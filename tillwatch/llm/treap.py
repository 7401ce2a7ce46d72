"""A K2-treap over a grid of terms (rows) and documents (columns).

The grid is a quadtree of halved squares. A node knows the largest impact in its square. A square
with one point is not divided further: it keeps the point itself. Nodes are laid out level
by level, so the children of a node start where the child bits before it end; only the child
bits, the maxima (as what they lack to the parent's) and the single points are stored.
"""

from __future__ import annotations

import numpy as np

#: Number of children, and number of children before a quadrant, by child bits.
ONES = np.array([bin(m).count("1") for m in range(16)], dtype=np.int64)
RANK = np.array([[bin(m & ((1 << q) - 1)).count("1") for q in range(4)] for m in range(16)], dtype=np.int64)


def _spread(values: np.ndarray) -> np.ndarray:
    """The bits of ``values`` at the even places."""
    out = values.astype(np.uint64)
    for shift, mask in (
        (16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
        (2, 0x3333333333333333), (1, 0x5555555555555555),
    ):
        out = (out | (out << np.uint64(shift))) & np.uint64(mask)
    return out


def _levels(rows: int, columns: int) -> int:
    return max(int(max(rows, columns) - 1).bit_length(), 1)


def build(rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray, n_rows: int, n_columns: int) -> dict[str, bytes]:
    """The stored treap of the points (row, column, impact), each cell at most once, impacts above 0."""
    height = _levels(n_rows, n_columns)
    code = (_spread(rows) << np.uint64(1)) | _spread(columns)
    order = np.argsort(code, kind="stable")
    code, impacts = code[order], impacts[order].astype(np.int32)
    rows, columns = rows[order].astype(np.int32), columns[order].astype(np.int32)
    bits, lacks, point_rows, point_columns = [], [], [], []
    # the points of squares that are divided at this level, and the square of each
    live = np.arange(len(code))
    starts = np.zeros(min(len(code), 1), dtype=np.int64)
    maxima = np.maximum.reduceat(impacts, starts) if len(code) else np.zeros(0, np.int32)
    if len(code):
        lacks.append(maxima)  # the root has no parent: it lacks nothing, so its maximum stands here
        if len(code) == 1:
            bits.append(np.zeros(1, np.uint8))
            point_rows.append(rows)
            point_columns.append(columns)
            live = live[:0]
    for level in range(height - 1, -1, -1):
        if not len(live):
            break
        prefix = code[live] >> np.uint64(2 * level)
        first = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1])))
        sizes = np.diff(np.concatenate((first, [len(live)])))
        largest = np.maximum.reduceat(impacts[live], first)
        parent = np.searchsorted(starts, first, side="right") - 1
        quadrant = (prefix[first] & np.uint64(3)).astype(np.int64)
        child_bits = np.bincount(parent, weights=1 << quadrant, minlength=len(starts)).astype(np.uint8)
        bits.append(child_bits)
        lacks.append(maxima[parent] - largest)
        single = sizes == 1
        alone = live[first[single]]
        bits.append(("leaves", single))
        point_rows.append(rows[alone])
        point_columns.append(columns[alone])
        stay = np.repeat(~single, sizes)
        live = live[stay]
        kept_sizes = sizes[~single]
        starts = np.concatenate(([0], np.cumsum(kept_sizes)[:-1])).astype(np.int64) if len(kept_sizes) else starts[:0]
        maxima = largest[~single]
    return _packed(bits, lacks, point_rows, point_columns, height, len(code))


def _packed(bits, lacks, point_rows, point_columns, height: int, points: int) -> dict[str, bytes]:
    """Child bits in the order of nodes: those of a level's undivided squares are 0, those of the others follow."""
    levels: list[np.ndarray] = []
    masks = iter(bits)
    now = None  # which nodes of the level before are divided
    for part in masks:
        if isinstance(part, tuple):
            now = ~part[1]
            continue
        if now is None:
            levels.append(part)
        else:
            whole = np.zeros(len(now), np.uint8)
            whole[now] = part
            levels.append(whole)
        now = None
    if now is not None:
        levels.append(np.zeros(len(now), np.uint8))
    join = lambda parts, kind: (np.concatenate(parts) if parts else np.zeros(0)).astype(kind).tobytes()
    return {
        "bits": join(levels, np.uint8), "lacks": join(lacks, np.int32),
        "point_rows": join(point_rows, np.int32), "point_columns": join(point_columns, np.int32), "height": height,
    }


class Treap:
    """A stored treap, ready for searches."""

    def __init__(self, stored: dict) -> None:
        self.bits = np.frombuffer(stored["bits"], np.uint8)
        lacks = np.frombuffer(stored["lacks"], np.int32)
        self.height = int(stored["height"])
        n = len(self.bits)
        ones = ONES[self.bits]
        self.children = 1 + np.cumsum(ones) - ones
        self.largest = lacks.copy()
        if n > 1:
            parent = np.repeat(np.arange(n), ones)
            begin = 1
            while begin < n:  # a level's maxima follow from the level above
                end = int(np.searchsorted(parent, begin, side="left")) + 1
                self.largest[begin:end] = self.largest[parent[begin - 1 : end - 1]] - lacks[begin:end]
                begin = end
        leaf = self.bits == 0
        point = np.cumsum(leaf) - 1
        self.row = np.full(n, -1, np.int32)
        self.column = np.full(n, -1, np.int32)
        self.row[leaf] = np.frombuffer(stored["point_rows"], np.int32)[point[leaf]]
        self.column[leaf] = np.frombuffer(stored["point_columns"], np.int32)[point[leaf]]

    def _halves(self, level: np.ndarray, column: np.ndarray, rows: np.ndarray, node: np.ndarray):
        """Both halves of document ranges along the paths of ``rows``: (which path, half, node) where there is one."""
        q = 2 * ((rows >> level) & 1)
        leaf = self.bits[node] == 0
        found = []
        for half in (0, 1):
            inner = ~leaf & ((self.bits[node] >> (q + half)) & 1 == 1)
            at = np.flatnonzero(inner)
            child = self.children[node[at]] + RANK[self.bits[node[at]], q[at] + half]
            fits = (self.row[child] < 0) | (self.row[child] == rows[at])
            same = np.flatnonzero(leaf & (self.column[node] >> level == 2 * column + half))
            found.append((np.concatenate((at[fits], same)), half, np.concatenate((child[fits], node[same]))))
        return found

    def best(self, query: np.ndarray, rows: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """(query, score, column) of the ``k`` columns per query with the largest sums of weight times impact
        over the query's rows, above 0, the largest first; equal sums by ascending column.

        ``query`` numbers from 0 say which query a row and its weight belong to. The paths of a query's
        rows descend together: a range of documents is open with one node per row that has
        points there, and its bound is the sum of their maxima. A query halves its ranges with the
        highest bounds first, a growing number at a time, and gives up a range whose bound does not
        reach its k-th best document so far. Queries take their steps side by side.
        """
        empty = np.zeros(0, np.int64)
        if not len(rows) or not len(self.bits):
            return empty, empty, empty
        n = int(query.max()) + 1
        weights = weights.astype(np.float64)  # sums stay below 2 ** 53
        path = np.flatnonzero((self.row[0] < 0) | (self.row[0] == rows))
        node = np.zeros(len(path), np.int64)
        bound = np.bincount(query[path], weights=weights[path] * float(self.largest[0]), minlength=n)
        asker = np.flatnonzero(bound > 0)
        number = np.cumsum(bound > 0) - 1
        some = bound[query[path]] > 0
        path, node = path[some], node[some]
        owner, bound = number[query[path]], bound[asker]
        level, column = np.full(len(asker), self.height), np.zeros(len(asker), np.int64)
        best = (empty, np.zeros(0), empty)
        floor, last = np.zeros(n), np.full(n, -1)
        batch = 32
        while len(bound):
            reach = floor[asker]
            useful = (bound > reach) | ((bound == reach) & (column << level < last[asker]))
            chosen = useful & (_rank(asker, -bound, useful) < batch)
            if not chosen.any():
                break
            batch *= 2
            rest = useful & ~chosen
            mine, left = chosen[owner], rest[owner]
            own, way, at = (np.cumsum(chosen) - 1)[owner[mine]], path[mine], node[mine]
            who, lev, col = asker[chosen], level[chosen] - 1, column[chosen]
            parts = [(bound[rest], asker[rest], level[rest], column[rest], (np.cumsum(rest) - 1)[owner[left]], path[left], node[left])]
            done = []
            for which, half, child in self._halves(lev[own], col[own], rows[way], at):
                total = np.bincount(own[which], weights=weights[way[which]] * self.largest[child], minlength=len(lev))
                now = 2 * col + half
                ended = (lev == 0) & (total > 0)
                done.append((who[ended], total[ended], now[ended]))
                goes_on = (lev > 0) & (total > 0)
                keep = goes_on[own[which]]
                owners = (np.cumsum(goes_on) - 1)[own[which][keep]]
                parts.append((total[goes_on], who[goes_on], lev[goes_on], now[goes_on], owners, way[which][keep], child[keep]))
            if any(len(d[0]) for d in done):
                best = tuple(np.concatenate([best[i], done[0][i], done[1][i]]) for i in range(3))
                order = np.lexsort((best[2], -best[1], best[0]))
                best = tuple(b[order] for b in best)
                place = _places(best[0])
                best = tuple(b[place < k] for b in best)
                full = place[place < k] == k - 1
                floor[best[0][full]], last[best[0][full]] = best[1][full], best[2][full]
            offsets = np.cumsum([0] + [len(p[0]) for p in parts])
            bound, asker, level, column = (np.concatenate([p[i] for p in parts]) for i in range(4))
            owner = np.concatenate([p[4] + offset for p, offset in zip(parts, offsets)])
            path, node = (np.concatenate([p[i] for p in parts]) for i in (5, 6))
        return best[0], best[1].astype(np.int64), best[2]


def _places(group: np.ndarray) -> np.ndarray:
    """Place of each element in its run of equal ``group`` values."""
    first = np.concatenate(([True], group[1:] != group[:-1]))[: len(group)]
    starts = np.flatnonzero(first)
    return np.arange(len(group)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(group)]))))


def _rank(group: np.ndarray, key: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Rank of each element by ``key`` in its group among the elements ``among``; others get a rank past all."""
    at = np.flatnonzero(among)
    order = at[np.lexsort((key[at], group[at]))]
    rank = np.full(len(group), len(group))
    rank[order] = _places(group[order])
    return rank
