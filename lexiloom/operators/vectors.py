"""Exact and approximate vector search for tables of queries.

Query blocks of a checked size are broadcast as matrices; rows stay in place, and every partition returns only its best k of each
query. ``score`` is the cosine; ties go to the lower id; a zero vector scores 0. Vectors that aren't usable (null, wrong length, not
finite) are left out, on either side.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.vectors import list_column, matrix, unit_rows
from ..session import materialise

QUERY_BLOCK = 4096
_HITS = "query_id bigint, id bigint, score double"


def finite(df: DataFrame, vec: str, dim: int) -> DataFrame:
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.coalesce((F.size(vec) == dim) & ok, F.lit(False)))


class BestK:
    """Running best k of each query over batches: by score, ties to the lower id. Only scores that can still enter are sorted."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score, self.id = np.full((queries, k), -np.inf), np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, scores: np.ndarray, ids: np.ndarray, of: np.ndarray | None = None) -> None:
        """scores [queries, rows]; -inf marks a row that isn't a candidate. ``of``: the queries meant, where they aren't all."""
        k, least = self.k, (self.score if of is None else self.score[of])[:, -1]
        if scores.shape[1] > k and np.count_nonzero(scores >= least[:, None]) > 4 * k * len(scores):
            least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])  # ties with the k-th stay
        at, r = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        if not len(at):
            return
        q = at if of is None else of[at]
        touched = np.unique(q)
        q_all = np.concatenate([np.repeat(touched, k), q])
        s_all = np.concatenate([self.score[touched].ravel(), scores[at, r]])
        i_all = np.concatenate([self.id[touched].ravel(), ids[r]])
        o = np.lexsort((i_all, -s_all, q_all))
        q_all = q_all[o]
        first = np.searchsorted(q_all, touched)
        best = (first[:, None] + np.arange(k)).ravel()
        self.score[touched], self.id[touched] = s_all[o][best].reshape(-1, k), i_all[o][best].reshape(-1, k)

    def batch(self, query_ids: np.ndarray) -> pa.RecordBatch:
        some = np.isfinite(self.score)
        q = np.repeat(query_ids, self.k).reshape(self.score.shape)
        return pa.RecordBatch.from_arrays([pa.array(q[some]), pa.array(self.id[some]), pa.array(self.score[some])], ["query_id", "id", "score"])


def query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, unit vectors) of queries (query_id, vector), about ``QUERY_BLOCK`` at a time."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    for b in range(blocks):
        t = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).orderBy("query_id").toArrow()
        if t.num_rows:
            yield np.asarray(t.column(0).combine_chunks().cast(pa.int64())), unit_rows(matrix(t.column(1)))


def best_of(hits: DataFrame | None, k: int, spark) -> DataFrame:
    """The k best hits of each query, with ``rank``; ties go to the lower id."""
    if hits is None or k <= 0:
        return spark.createDataFrame([], _HITS + ", rank int")
    return hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))).where(F.col("rank") <= k)


def scan(rows: DataFrame, queries: DataFrame, k: int, scorer: Callable[[pa.RecordBatch, np.ndarray], np.ndarray], skip_self: bool) -> DataFrame:
    """Top k of every query over all rows. rows: id first; queries (query_id, vector); scorer: (batch, unit queries) -> [queries, rows]."""
    spark, out = rows.sparkSession, None
    for block in query_blocks(queries) if k > 0 else ():
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best = BestK(len(ids), k)
            for batch in batches:
                for s in range(0, batch.num_rows, 2048):
                    part = batch.slice(s, 2048)
                    row_ids = np.asarray(part.column(0))
                    score = scorer(part, q)
                    if skip_self:
                        score = np.where(ids[:, None] == row_ids[None, :], -np.inf, score)
                    best.add(score, row_ids)
            yield best.batch(ids)

        hits = rows.mapInArrow(run, _HITS)
        out = hits if out is None else out.unionByName(hits)
    return best_of(out, k, spark)


def _cosines(part: pa.RecordBatch, q: np.ndarray) -> np.ndarray:
    return q @ unit_rows(matrix(part.column(1))).T


def knn_exact(vectors: DataFrame, queries: DataFrame, k: int, dim: int, skip_self: bool = True) -> DataFrame:
    """vectors (id, vector), queries (query_id, vector)."""
    rows, qs = finite(vectors.toDF("id", "v"), "v", dim), finite(queries.toDF("query_id", "v"), "v", dim)
    return scan(rows.select(F.col("id").cast("bigint").alias("id"), "v"), qs, k, _cosines, skip_self)


# -- eight-bit codes ------------------------------------------------------------------------------------------------------


def sq8_encode(vectors: DataFrame, dim: int) -> DataFrame:
    """(id, codes array<tinyint>, inverse double): unit rows over max/127, rounded half to even, and one over the codes' length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unit_rows(matrix(b.column(1))) if b.num_rows else np.empty((0, dim))
            scale = np.abs(x).max(1, keepdims=True, initial=0) / 127
            codes = np.rint(np.divide(x, scale, out=np.zeros_like(x), where=scale != 0))
            length = np.linalg.norm(codes, axis=1)
            inverse = np.divide(1.0, length, out=np.zeros_like(length), where=length != 0)
            yield pa.RecordBatch.from_arrays([b.column(0), list_column(codes.astype(np.int8), pa.int8()), pa.array(inverse)], ["id", "codes", "inverse"])

    rows = finite(vectors.toDF("id", "v"), "v", dim).select(F.col("id").cast("bigint").alias("id"), "v")
    return rows.mapInArrow(run, "id bigint, codes array<tinyint>, inverse double")


def _sq8_scores(part: pa.RecordBatch, q: np.ndarray) -> np.ndarray:
    return np.clip((q @ matrix(part.column(1)).T) * np.asarray(part.column(2)), -1, 1)


def knn_sq8(codes: DataFrame, queries: DataFrame, k: int, dim: int, skip_self: bool = True) -> DataFrame:
    qs = finite(queries.toDF("query_id", "v"), "v", dim)
    return scan(codes.select("id", "codes", "inverse"), qs, k, _sq8_scores, skip_self)


# -- product quantisation ---------------------------------------------------------------------------------------------------


def pq_train(vectors: DataFrame, dim: int, subspaces: int = 8, clusters: int = 256, iterations: int = 12, most: int = 12_000, seed: int = 42) -> np.ndarray:
    """Codebooks [subspace, cluster, width] from at most ``most`` non-zero rows (the lowest hashes of the id); deterministic for a seed."""
    rows = finite(vectors.toDF("id", "v"), "v", dim).where(F.exists("v", lambda x: x != 0)).orderBy(F.xxhash64("id"), "id").limit(most)
    t = rows.select("v").toArrow()
    x = unit_rows(matrix(t.column(0)))
    rng = np.random.default_rng(seed)
    width = dim // subspaces
    books = []
    for s in range(subspaces):
        p = x[:, s * width : (s + 1) * width]
        c = p[rng.choice(len(p), min(clusters, len(p)), replace=False)].copy()
        for _ in range(iterations):
            to = (np.einsum("ij,ij->i", c, c) - 2 * p @ c.T).argmin(1)
            n = np.bincount(to, minlength=len(c))
            sums = np.zeros_like(c)
            np.add.at(sums, to, p)
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
            if np.array_equal(new, c):
                break
            c = new
        books.append(c)
    return np.stack(books)


def pq_encode(vectors: DataFrame, books: np.ndarray, dim: int) -> DataFrame:
    """(id, codes array<smallint>, inverse double): the nearest centre of every part; inverse 0 marks a zero vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        width = books.shape[2]
        for b in batches:
            x = unit_rows(matrix(b.column(1))) if b.num_rows else np.empty((0, dim))
            codes = np.stack([(np.einsum("ij,ij->i", c, c) - 2 * x[:, s * width : (s + 1) * width] @ c.T).argmin(1) for s, c in enumerate(books)], 1)
            length = np.sqrt(sum((books[s][codes[:, s]] ** 2).sum(1) for s in range(len(books))))
            zero = ~(x != 0).any(1)
            inverse = np.where(zero | (length == 0), 0.0, 1 / np.where(length == 0, 1, length))
            yield pa.RecordBatch.from_arrays([b.column(0), list_column(codes.astype(np.int16), pa.int16()), pa.array(inverse)], ["id", "codes", "inverse"])

    rows = finite(vectors.toDF("id", "v"), "v", dim).select(F.col("id").cast("bigint").alias("id"), "v")
    return rows.mapInArrow(run, "id bigint, codes array<smallint>, inverse double")


def knn_pq(codes: DataFrame, queries: DataFrame, books: np.ndarray, k: int, dim: int, skip_self: bool = True) -> DataFrame:
    """Asymmetric distances: a table of query parts against centres, summed over the codes."""
    shared = codes.sparkSession.sparkContext.broadcast(books)

    def score(part: pa.RecordBatch, q: np.ndarray) -> np.ndarray:
        books = shared.value
        width = books.shape[2]
        c = matrix(part.column(1)).astype(np.int64)
        s = sum((q[:, p * width : (p + 1) * width] @ books[p].T)[:, c[:, p]] for p in range(len(books)))
        return np.clip(s * np.asarray(part.column(2)), -1, 1)

    return scan(codes.select("id", "codes", "inverse"), finite(queries.toDF("query_id", "v"), "v", dim), k, score, skip_self)


def rerank(candidates: DataFrame, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact cosines of candidates (query_id, id), and their top k."""
    from ..functions.vectors import cosine
    from .retrieval import small

    v, q = vectors.toDF("id", "v"), queries.toDF("query_id", "q")
    both = candidates.select("query_id", "id").join(v, "id").join(small(q, QUERY_BLOCK), "query_id")
    s = both.select("query_id", "id", cosine(F.col("v"), F.col("q")).alias("score"))
    return s.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))).where(F.col("rank") <= k)


def storage_bytes(rows: int, dim: int, kind: str, subspaces: int = 8, clusters: int = 256) -> int:
    """Bytes a store of that kind takes, ids included."""
    if kind == "float32":
        return rows * (dim * 4 + 8)
    if kind == "sq8":
        return rows * (dim + 8 + 4)
    return rows * (subspaces + 8 + 4) + subspaces * clusters * (dim // subspaces) * 4


# -- cells: the approximate index as a table layout ---------------------------------------------------------------------------


def cell_centres(vectors: DataFrame, dim: int, cells: int, most: int = 20_000, seed: int = 7) -> np.ndarray:
    """Centres of an inverted-file layout, by k-means on at most ``most`` rows (the lowest hashes)."""
    from .projection import kmeans

    rows = finite(vectors.toDF("id", "v"), "v", dim).orderBy(F.xxhash64("id"), "id").limit(most).select("v").toArrow()
    x = unit_rows(matrix(rows.column(0)))
    return unit_rows(kmeans(x, min(cells, len(x)), seed=seed, n_init=1, max_iter=15)[1])


def cell_layout(vectors: DataFrame, centres: np.ndarray, dim: int) -> DataFrame:
    """(id, unit array<float>, cell): the rows as a table with a folder for each cell, built once; reads skip the folders not asked for."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = unit_rows(matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), list_column(x.astype(np.float32), pa.float32()), pa.array((x @ shared.value.T).argmax(1).astype(np.int32))], ["id", "unit", "cell"])

    rows = finite(vectors.toDF("id", "v"), "v", dim).select(F.col("id").cast("bigint").alias("id"), "v")
    return materialise(rows.mapInArrow(run, "id bigint, unit array<float>, cell int").repartition("cell"), "cells", by="cell")


def knn_cells(layout: DataFrame, queries: DataFrame, centres: np.ndarray, k: int, dim: int, probe: int, skip_self: bool = True) -> DataFrame:
    """A query is scored exactly against its ``probe`` nearest cells only; other cells are neither read for it nor multiplied with it."""
    spark, out = layout.sparkSession, None
    for ids, q in query_blocks(finite(queries.toDF("query_id", "v"), "v", dim)) if k > 0 else ():
        near = np.argpartition(-(q @ centres.T), min(probe, len(centres)) - 1, axis=1)[:, :probe]
        of_cell = {int(c): np.flatnonzero((near == c).any(1)) for c in np.unique(near)}
        shared = spark.sparkContext.broadcast((ids, q, of_cell))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q, of_cell = shared.value
            best = BestK(len(ids), k)
            for b in (b.slice(s, 4096) for b in batches for s in range(0, b.num_rows, 4096)):
                rows, x, cells = np.asarray(b.column(0)), matrix(b.column(1)), np.asarray(b.column(2))
                for c in np.unique(cells):
                    of, at = of_cell[int(c)], np.flatnonzero(cells == c)
                    score = q[of] @ x[at].T
                    if skip_self:
                        score[ids[of][:, None] == rows[at][None, :]] = -np.inf
                    best.add(score, rows[at], of)
            yield best.batch(ids)

        hits = layout.where(F.col("cell").isin([int(c) for c in of_cell])).select("id", "unit", "cell").mapInArrow(run, _HITS)
        out = hits if out is None else out.unionByName(hits)
    return best_of(out, k, spark)


# -- graph: a layered navigable graph over each part of the rows, kept as a table --------------------------------------------------

#: Levels a graph has at most.
TOP_LEVEL = 32


class LayeredGraph:
    """A hierarchical navigable graph. A row stands on the levels from 0 to one drawn with a geometric law of mean 1 / ln(m).

    A search goes down greedily to the level wanted, then widens to a beam. A new row links to neighbours that are nearer to it than to
    one another (the nearest of the others fill up), on level 0 up to 2 m, above up to m; a neighbour with too many links chooses anew.
    """

    def __init__(self, x: np.ndarray, m: int = 16, build: int = 100, seed: int = 42, links: list[list[list[int]]] | None = None):
        self.x, self.m = np.ascontiguousarray(x, np.float32), m
        self.links = links if links is not None else []
        self.entry = max(range(len(self.links)), key=lambda i: (len(self.links[i]), -i), default=0)
        if links is None:
            drawn = np.random.default_rng(seed).random(len(x))
            for level in np.minimum(-np.log(np.maximum(drawn, 1e-12)) / np.log(max(m, 2)), TOP_LEVEL).astype(int):
                self._add(int(level), build)

    def _beam(self, q: np.ndarray, start: list[int], level: int, beam: int) -> list[tuple[float, int]]:
        """The best ``beam`` rows that a best-first walk over a level meets, (similarity, row), best first."""
        seen = set(start)
        best = [(float(self.x[i] @ q), i) for i in start]
        todo = [(-s, i) for s, i in best]
        heapq.heapify(best), heapq.heapify(todo)
        while todo:
            s, i = heapq.heappop(todo)
            if len(best) >= beam and -s < best[0][0]:
                break
            new = [j for j in self.links[i][level] if j not in seen]
            seen.update(new)
            for s, j in zip((self.x[new] @ q).tolist() if new else (), new):
                if len(best) < beam or s > best[0][0]:
                    heapq.heappush(todo, (-s, j))
                    (heapq.heappushpop if len(best) >= beam else heapq.heappush)(best, (s, j))
        return sorted(best, key=lambda t: (-t[0], t[1]))

    def _down(self, q: np.ndarray, level: int) -> int:
        """The row that a greedy walk from the top arrives at, just above ``level``."""
        at = self.entry
        for above in range(len(self.links[at]) - 1, level, -1):
            at = self._beam(q, [at], above, 1)[0][1]
        return at

    def _choose(self, near: list[tuple[float, int]], most: int) -> list[int]:
        rows = [i for _, i in near]
        between = self.x[rows] @ self.x[rows].T
        kept: list[int] = []
        for k, (s, _) in enumerate(near):
            if len(kept) < most and all(between[k, c] < s for c in kept):
                kept.append(k)
        kept += [k for k in range(len(near)) if k not in kept][: most - len(kept)]
        return [rows[k] for k in kept]

    def _add(self, level: int, build: int) -> None:
        i = len(self.links)
        self.links.append([[] for _ in range(level + 1)])
        if not i:
            return
        q = self.x[i]
        top = len(self.links[self.entry]) - 1
        start = [self._down(q, level) if level < top else self.entry]
        for here in range(min(level, top), -1, -1):
            near = self._beam(q, start, here, build)
            most = self.m if here else 2 * self.m
            self.links[i][here] = self._choose(near, self.m)
            for j in self.links[i][here]:
                back = self.links[j][here]
                back.append(i)
                if len(back) > most:
                    s = self.x[back] @ self.x[j]
                    self.links[j][here] = self._choose(sorted(zip(s.tolist(), back), key=lambda t: (-t[0], t[1])), most)
            start = [j for _, j in near]
        if level > top:
            self.entry = i

    def search(self, q: np.ndarray, k: int, beam: int) -> list[tuple[int, float]]:
        """(row, similarity) of the k best found; a beam below k counts as k."""
        if not self.links or k <= 0:
            return []
        q = np.asarray(q, np.float32)
        return [(i, s) for s, i in self._beam(q, [self._down(q, 0)], 0, max(beam, k))[:k]]


_INDEX = "part int, size int, id bigint, unit array<float>, links array<array<bigint>>"


def graph_index(vectors: DataFrame, dim: int, m: int = 16, build: int = 100, rows_each: int = 20_000) -> DataFrame:
    """(part, size, id, unit, links): a graph over each part of about ``rows_each`` rows, built once and kept as a table.

    ``links`` holds the neighbours' ids by level. A part is one file of some 10 MB (20,000 rows of 64 elements), below what a reader cuts up.
    """
    rows = finite(vectors.toDF("id", "v"), "v", dim).select(F.col("id").cast("bigint").alias("id"), "v")
    parts = max(1, -(-rows.count() // rows_each))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if held:
            ids = np.concatenate([np.asarray(b.column(0)) for b in held])
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], unit_rows(np.concatenate([matrix(b.column(1)) for b in held])[order])
            graph = LayeredGraph(x, m, build)
            names = [[ids[level].tolist() for level in node] for node in graph.links]
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, TaskContext.get().partitionId(), np.int32)), pa.array(np.full(n, n, np.int32)), pa.array(ids), list_column(x.astype(np.float32), pa.float32()), pa.array(names, pa.list_(pa.list_(pa.int64())))], ["part", "size", "id", "unit", "links"])

    return materialise(rows.repartition(parts, F.xxhash64("id")).mapInArrow(run, _INDEX), "graph-index")


def knn_graph(index: DataFrame, queries: DataFrame, k: int, dim: int, beam: int = 150, skip_self: bool = True) -> DataFrame:
    """The best k over all parts of an index, each searched with a beam; nothing is built here."""
    spark, out = index.sparkSession, None
    for block in query_blocks(finite(queries.toDF("query_id", "v"), "v", dim)) if k > 0 else ():
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked, q = shared.value
            held: dict[int, list[pa.RecordBatch]] = {}
            for b in batches:
                part = np.asarray(b.column(0))
                for p in np.unique(part):
                    held.setdefault(int(p), []).append(b.filter(pa.array(part == p)))
                for p in [p for p, bs in held.items() if sum(x.num_rows for x in bs) == bs[0].column(1)[0].as_py()]:
                    t = pa.Table.from_batches(held.pop(p))
                    ids = np.asarray(t.column(2).combine_chunks())
                    at = {name: row for row, name in enumerate(ids.tolist())}
                    links = [[[at[j] for j in level] for level in node] for node in t.column(4).to_pylist()]
                    graph = LayeredGraph(matrix(t.column(3)), links=links)
                    found = [(int(a), int(ids[i]), s) for a, v in zip(asked, q) for i, s in [h for h in graph.search(v, k + skip_self, beam) if not (skip_self and ids[h[0]] == a)][:k]]
                    yield pa.RecordBatch.from_pylist([dict(zip(("query_id", "id", "score"), r)) for r in found], pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())]))
            if held:
                raise ValueError("a part of the graph index was cut up: raise spark.sql.files.maxPartitionBytes above its files")

        hits = index.select("part", "size", "id", "unit", "links").mapInArrow(run, _HITS)
        out = hits if out is None else out.unionByName(hits)
    return best_of(out, k, spark)


def save_graph(index: DataFrame, folder: str) -> None:
    """An index as a snapshot: one Parquet file for each part."""
    index.repartition("part").sortWithinPartitions("part", "id").write.mode("overwrite").parquet(folder)


def load_graph(spark, folder: str, m: int = 16) -> DataFrame:
    """An index from a snapshot; one that is incomplete or has broken links is refused."""
    index = spark.read.schema(_INDEX).parquet(folder)
    short = index.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.min("size").alias("least")).where("n <> size or size <> least").limit(1).count()
    if short or graph_faults(index, m).limit(1).count():
        raise ValueError(f"no complete graph index: {folder}")
    return index


def graph_edges(index: DataFrame) -> DataFrame:
    """(part, level, src, dst): the links of an index."""
    return index.select("part", F.col("id").alias("src"), F.posexplode("links").alias("level", "l")).select("part", "level", "src", F.explode("l").alias("dst"))


def graph_faults(index: DataFrame, m: int = 16) -> DataFrame:
    """(fault, src, dst): links to rows that aren't on that level of the part, links to oneself, and rows with too many links on a level."""
    edges = graph_edges(index)
    there = index.select("part", F.col("id").alias("dst"), F.explode(F.sequence(F.lit(0), F.size("links") - 1)).alias("level"))
    dangling = edges.join(there, ["part", "level", "dst"], "left_anti").select(F.lit("dangling").alias("fault"), "src", "dst")
    own = edges.where("src = dst").select(F.lit("self"), "src", "dst")
    many = edges.groupBy("part", "level", "src").count().where(F.col("count") > F.when(F.col("level") == 0, 2 * m).otherwise(m)).select(F.lit("degree"), "src", F.lit(None).cast("bigint"))
    return dangling.union(own).union(many)
