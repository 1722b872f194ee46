"""A forest of p-stable hash functions: short shared buckets for vectors that are near each other.

A tree is a variable-length p-stable hash: each function is a Gaussian projection a.x + b cut at zero, and the function asked next
depends on the bits before. Its directions are drawn, and the one under which a bounded sample (``SAMPLE`` rows, the lowest hashes of
their ids) spreads widest is kept, with the offset b at the sample's median; so buckets are even however the vectors lie, and a bucket
that holds a third of all rows gets more functions than another. A vector visits its own bucket and then others in the order of their
estimated success: the sum of squared distances to the offsets it would have to cross, each over the spread of its projection.

How many buckets a vector has to visit is found from the sample itself: sample vectors are moved by the distance asked for, and the
least number of visits that brings enough of them together is taken. So recall holds at every size; what grows with it is the visits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 64
#: Rows the functions are fitted on at most, and directions drawn for each function.
SAMPLE, DRAWN, MIXED = 40_000, 12, 24
#: A vector travels as 16-bit steps of its largest component.
STEPS = 32_767


@dataclass
class Tree:
    """Nodes in one array: ``a`` projections, ``b`` offsets, ``child`` (two each; a leaf is -1 - number)."""

    a: np.ndarray
    b: np.ndarray
    child: np.ndarray
    leaves: int

    @classmethod
    def fit(cls, x: np.ndarray, depth: int, seed: int) -> Tree:
        r = np.random.default_rng(seed)
        a, b, child, leaves = [], [], [], 0

        def grow(rows: np.ndarray, d: int) -> int:
            nonlocal leaves
            if d == 0 or len(rows) < 4:
                leaves += 1
                return -leaves
            some = rows if len(rows) <= 2000 else rows[:: len(rows) // 2000 + 1]
            near = x[r.choice(some, min(len(some), MIXED), replace=False)]
            dirs = (near - near.mean(0)).T @ r.normal(size=(len(near), DRAWN))
            dirs /= np.maximum(np.linalg.norm(dirs, axis=0), 1e-12)
            y = x[some] @ dirs
            k = int(y.std(0).argmax())
            y = x[rows] @ dirs[:, k]
            cut = np.median(y)
            if not (y < cut).any():  # too many equal projections for the median to part
                cut = y.max()
            if not (y < cut).any():
                leaves += 1
                return -leaves
            scale = max(float(y.std()), 1e-9)
            at = len(a)
            a.append(dirs[:, k] / scale)
            b.append(-cut / scale)
            child.append([0, 0])
            child[at][0] = grow(rows[y < cut], d - 1)
            child[at][1] = grow(rows[y >= cut], d - 1)
            return at

        root = grow(np.arange(len(x)), depth)
        if root < 0:
            return cls(np.zeros((0, x.shape[1])), np.zeros(0), np.zeros((0, 2), np.int64), 1)
        return cls(np.stack(a), np.array(b), np.array(child, np.int64), leaves)

    def visits(self, x: np.ndarray, many: int) -> np.ndarray:
        """int32[n, many]: leaves in the order of estimated success, the own one first; -1 where there are no more."""
        n = len(x)
        if not len(self.a):
            out = np.full((n, many), -1, np.int32)
            out[:, 0] = 0
            return out
        row, node, cost = np.arange(n), np.zeros(n, np.int64), np.zeros(n)
        done_row, done_leaf, done_cost = [], [], []
        x = x.astype(np.float32)
        a = self.a.astype(np.float32)
        while len(row):
            y = np.einsum("ij,ij->i", x[row], a[node]) + self.b[node]
            side = (y >= 0).astype(np.int64)
            near, far = self.child[node, side], self.child[node, 1 - side]
            row, node, cost = np.concatenate([row, row]), np.concatenate([near, far]), np.concatenate([cost, cost + y * y])
            if many == 1:
                row, node, cost = row[: len(row) // 2], node[: len(node) // 2], cost[: len(cost) // 2]
            else:  # of each row only the cheapest can still be among the wanted
                order = np.lexsort((cost, row))
                row, node, cost = row[order], node[order], cost[order]
                first = np.searchsorted(row, row, "left")
                # finished leaves of the row compete too, but dropping fewer is only slower
                keep = np.arange(len(row)) - first < many
                row, node, cost = row[keep], node[keep], cost[keep]
            leaf = node < 0
            done_row.append(row[leaf]), done_leaf.append(-1 - node[leaf]), done_cost.append(cost[leaf])
            row, node, cost = row[~leaf], node[~leaf], cost[~leaf]
        row, leaf, cost = np.concatenate(done_row), np.concatenate(done_leaf), np.concatenate(done_cost)
        order = np.lexsort((cost, row))
        row, leaf = row[order], leaf[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, "left")
        out = np.full((n, many), -1, np.int32)
        keep = place < many
        out[row[keep], place[keep]] = leaf[keep]
        return out


@dataclass
class Forest:
    trees: list[Tree]
    visits: int

    def route(self, x: np.ndarray, many: int | None = None) -> np.ndarray:
        """int32[n, trees * many]: buckets of all trees, numbered through; the first of each tree is the own one."""
        out, base = [], 0
        for t in self.trees:
            v = t.visits(x, many or self.visits)
            out.append(np.where(v >= 0, v + base, -1))
            base += t.leaves
        return np.concatenate(out, 1)


def moved(x: np.ndarray, cosine: float, seed: int = 7) -> np.ndarray:
    """Each unit vector turned in a random direction, so that its cosine to the old one is as given."""
    y = np.random.default_rng(seed).normal(size=x.shape)
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    return cosine * x + np.sqrt(1 - cosine * cosine) * y


def recall_of(forest: Forest, x: np.ndarray, y: np.ndarray, most: int, one_way: bool) -> np.ndarray:
    """float[most]: share of pairs that 1, 2, ... visits in each tree bring together; ``one_way``: only x visits, y stays at home."""
    found = np.zeros((len(x), most), bool)
    for t in forest.trees:
        vx, vy = t.visits(x, most), t.visits(y, most)
        found |= np.logical_or.accumulate(vx == vy[:, :1], 1)
        if not one_way:
            found |= np.logical_or.accumulate(vy == vx[:, :1], 1)
    return found.mean(0)


def sample_of(units: DataFrame, n: int, most: int = SAMPLE) -> np.ndarray:
    """Unit vectors of about ``most`` rows at most, by the hash of their ids; the same rows however the table is cut."""
    some = units if n <= most else units.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < F.lit(int((1 << 40) * 0.98 * most / n)))
    rows = some.select("unit").toArrow().column(0)
    x = np.asarray(rows.combine_chunks().flatten()).reshape(-1, DIM).astype(np.float64) if len(rows) else np.zeros((0, DIM))
    return x[np.lexsort(x.T[:3])]


def fit(x: np.ndarray, n: int, leaf: int, trees: int, seed: int) -> Forest:
    """Buckets of about ``leaf`` of the ``n`` rows that the sample stands for."""
    depth = max(0, int(np.ceil(np.log2(max(1.0, n / leaf)))))
    return Forest([Tree.fit(x, depth, seed + i) for i in range(trees)], 1)


def with_recall(forest: Forest, x: np.ndarray, cosine: float, recall: float, one_way: bool = False, most: int = 64) -> Forest:
    """Visits raised until pairs at that cosine meet with the chance asked for."""
    some = x if len(x) <= 2000 else x[:: len(x) // 2000 + 1]
    if len(some):
        reached = recall_of(forest, some, moved(some, cosine), most, one_way) >= recall
        forest.visits = int(reached.argmax()) + 1 if reached.any() else most
    return forest


def pack_vectors(x: np.ndarray) -> pa.Array:
    """Unit vectors as fixed-size binaries of 16-bit steps."""
    top = np.maximum(np.abs(x).max(1, keepdims=True), 1e-12) if len(x) else np.ones((0, 1))
    q = np.rint(x / top * STEPS).astype(np.int16)
    return pa.Array.from_buffers(pa.binary(), len(q), [None, pa.py_buffer(np.arange(0, q.size * 2 + 1, DIM * 2, dtype=np.int32).tobytes()), pa.py_buffer(q.tobytes())])


def unpack_vectors(column: pa.Array) -> np.ndarray:
    """float32 unit vectors of such a column (without nulls)."""
    if not len(column):
        return np.zeros((0, DIM), np.float32)
    a = column.offset
    off = np.frombuffer(column.buffers()[1], np.int32)[a : a + len(column) + 1]
    q = np.frombuffer(column.buffers()[2], np.int16)[off[0] // 2 : off[-1] // 2].reshape(-1, DIM).astype(np.float32)
    return q / np.linalg.norm(q, axis=1, keepdims=True)


def by_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Batches sorted by their first column ``leaf`` -> (leaf, all its rows), one leaf in memory at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        leaf = np.asarray(b.column(0))
        cuts = [0, *(np.flatnonzero(np.diff(leaf)) + 1).tolist(), len(leaf)]
        for s, e in zip(cuts, cuts[1:]):
            if e == s:
                continue
            if held and leaf[s] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = int(leaf[s])
            held.append(b.slice(s, e - s))
    if held:
        yield now, pa.Table.from_batches(held)
