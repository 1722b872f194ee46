"""Problem 5: divide records into clusters of mutually similar ones, with true sizes and most typical members.

Method: Markov clustering, level by level. Flow on a similarity graph is squared, inflated and pruned until the nodes that still
receive flow (attractors) define the clusters. The graph of all rows is too large to be squared, so rows meet in small blocks of
near ones (buckets of the hash forest), the flow runs inside each block, and every row goes on to its attractor, which becomes a node
with the weight and the mean direction of the rows it received. Levels follow, over other blocks, until nothing merges any more; rows
that received nothing go on as nodes of weight one. Then the sparse graph of all nodes left (each with its ``EDGES`` strongest edges) is
clustered by sparse matrix squaring: a join on the shared index and a sum, or, where the matrix has at most ``LOCAL_EDGES`` entries, the
same steps in one Arrow call. A row belongs to the cluster its chain of attractors ends at.

A row stays a member if it is near enough to the direction its cluster has, by the cluster's own spread (``NEAR``); one that is not may
still be near enough to another cluster. A cluster counts if so many rows so alike aren't to be expected by chance among all rows
(``beyond_chance``): two rows must be far more alike than twenty. Rows of none go through the same again, until nothing more is found.

Defined results: unusable vectors take no part; copies of an id count once; members without a stored cluster get the group's; ties
between stored ids go to the lower; ``inflow`` is the number of rows whose chain passes a row, and tells the typical members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import materialise
from . import forest as fo
from .neighbours import DIM, matrix_of, unit_vectors

#: Rows whose flow is run together, rows of the bucket that is cut into such blocks, and nodes compared for the edges of the last graph.
BLOCK, LEAF, EDGE_LEAF = 160, 4000, 1024
#: Similarity below which there is no edge, edges a node keeps in the last graph, its tables, the exponent of inflation, and the least entry.
NO_EDGE, EDGES, TABLES, INFLATION, PRUNE = 0.3, 12, 4, 2.0, 0.01
ROUNDS = 12
#: Exponent of similarities as edges: flow to one heavy node of another group must not outweigh flow spread over the pieces of its own.
POWER = 4
#: Rows from which on a node draws flow no more strongly: in a graph that keeps each row's nearest, a large group doesn't outweigh a small one.
NEIGHBOURS = 32
#: Entries up to which the last graph is squared in one Arrow call.
LOCAL_EDGES = 300_000
#: A member's similarity to its centre is at least this share of the members' median.
NEAR = 0.6
#: Logarithm of the odds against chance that a cluster must pass.
ODDS = 7.0
#: Centres a block of rows is compared with at a time; centres and ids up to which they are broadcast (about 300 and 8 bytes each).
CENTRES, BROADCAST_CENTRES, BROADCAST_IDS = 2048, 50_000, 1_000_000


def attractors(to: np.ndarray) -> np.ndarray:
    """The node each chain of pointers ends at; of those that point at each other the first."""
    best, step = to.copy(), to.copy()
    for _ in range(max(1, int(np.ceil(np.log2(len(to) + 1))))):
        best, step = np.minimum(best, best[step]), step[step]
    # from the end of the chain, best is the least node of the circle there
    return best[step] if len(to) else to


def flow_clusters(x: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Markov clustering of a small dense set of unit vectors: the attractor of each."""
    s, weight = (x @ x.T).astype(np.float64), np.minimum(weight, NEIGHBOURS)
    m = np.where(s > NO_EDGE, s, 0.0) ** POWER * weight[:, None]
    np.fill_diagonal(m, np.maximum(weight, m.max(0)))
    m /= m.sum(0)
    for _ in range(rounds):
        before = m
        m = m @ m
        m **= INFLATION
        m /= m.sum(0)
        m[m < 1e-4] = 0
        m /= m.sum(0)
        if np.abs(m - before).max() < 1e-4:
            break
    return attractors(m.argmax(0))


_LEVEL = "child bigint, parent bigint, weight double, unit array<float>"


def _flow_in_blocks(ids: np.ndarray, w: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    """Rows of a bucket -> their parents; a parent's own row has the weight and the direction of its children."""
    ids, order = np.unique(ids, return_index=True)  # copies of an id lie in one bucket
    w, x = w[order], x[order]
    blocks = fo.Tree.fit(x, max(0, int(np.ceil(np.log2(len(x) / BLOCK)))), 17).visits(x, 1)[:, 0]
    to = np.zeros(len(x), np.int64)
    for b in np.unique(blocks):
        at = np.flatnonzero(blocks == b)
        to[at] = at[flow_clusters(x[at], w[at])]
    sums, total = np.zeros((len(x), DIM)), np.zeros(len(x))
    np.add.at(sums, to, x * w[:, None])
    np.add.at(total, to, w)
    norm = np.linalg.norm(sums, axis=1)
    parent = to == np.arange(len(x))
    c = np.where(norm[:, None] > 1e-9, sums / np.maximum(norm, 1e-9)[:, None], x)[parent].astype(np.float32)
    ends = np.concatenate([[0], np.cumsum(parent) * DIM])
    unit = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(c.ravel()), mask=pa.array(~parent)) if len(c) else pa.nulls(len(x), pa.list_(pa.float32()))
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[to]), pa.array(total, mask=~parent), unit], ["child", "parent", "weight", "unit"])


def _spread(nodes: DataFrame, n: int, leaf: int, trees: int, seed: int) -> DataFrame:
    """(leaf, id, weight, unit), sorted by leaf inside each partition: every node in its bucket of each table."""
    sample = fo.sample_of(nodes, n)
    forest = fo.fit(sample, n, leaf, trees, seed)
    if all(t.leaves == 1 for t in forest.trees):
        forest.trees = forest.trees[:1]
    shared = nodes.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in (b.slice(s, 4096) for b in batches for s in range(0, b.num_rows, 4096)):
            home = f.route(matrix_of(b.column(2)), 1)
            for t in range(home.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(home[:, t]), *b.columns], ["leaf", "id", "weight", "unit"])

    leaves = sum(t.leaves for t in forest.trees)
    parts = max(1, min(leaves, max(4 * nodes.sparkSession.sparkContext.defaultParallelism, n * len(forest.trees) // 200_000)))
    return nodes.select("id", "weight", "unit").mapInArrow(run, "leaf int, id bigint, weight double, unit array<float>").repartition(parts, "leaf").sortWithinPartitions("leaf")


def _level(nodes: DataFrame, n: int, seed: int, name: str) -> DataFrame:
    """(child, parent, weight, unit): one round of flow inside blocks of near nodes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in fo.by_leaf(batches):
            yield _flow_in_blocks(np.asarray(t.column(1).combine_chunks()), np.asarray(t.column(2).combine_chunks()), matrix_of(t.column(3).combine_chunks()))

    return materialise(_spread(nodes, n, LEAF, 1, seed).mapInArrow(run, _LEVEL), name)


def similarity_edges(nodes: DataFrame, n: int, seed: int) -> DataFrame:
    """(i, j, v): each node's strongest edges j -> i over several tables, weighted by what i stands for, and a loop at each node that has any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in fo.by_leaf(batches):
            ids, w, x = np.asarray(t.column(1).combine_chunks()), np.minimum(np.asarray(t.column(2).combine_chunks()), NEIGHBOURS), matrix_of(t.column(3).combine_chunks())
            for s in range(0, len(x), 1024):
                c = x[s : s + 1024] @ x.T
                c[np.arange(len(c)), s + np.arange(len(c))] = -1
                v = np.where(c > NO_EDGE, c, 0) ** POWER * w
                k = min(EDGES, v.shape[1])
                top = np.argpartition(-v, k - 1, axis=1)[:, :k]
                j, at = np.nonzero(np.take_along_axis(v, top, 1) > 0)
                i = top[j, at]
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[s + j]), pa.array(v[j, i]), pa.array(w[s + j])], ["i", "j", "v", "own"])

    found = _spread(nodes, n, EDGE_LEAF, TABLES, seed).mapInArrow(run, "i bigint, j bigint, v double, own double").groupBy("i", "j").agg(F.max("v").alias("v"), F.max("own").alias("own"))
    best = materialise(found.withColumn("r", F.row_number().over(W.partitionBy("j").orderBy(F.desc("v"), "i"))).where(F.col("r") <= EDGES).drop("r"), "edges")
    loops = best.groupBy("j").agg(F.greatest(F.max("v"), F.max("own")).alias("v")).select(F.col("j").alias("i"), "j", "v")
    # a node that only receives has a loop as well
    only = best.select("i").distinct().join(best.select(F.col("j").alias("i")).distinct(), "i", "left_anti").select("i", F.col("i").alias("j"), F.lit(1.0).alias("v"))
    return best.select("i", "j", "v").unionByName(loops).unionByName(only)


def _square_locally(i: np.ndarray, j: np.ndarray, v: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, attractor of each) of a sparse matrix, entry by entry as ``_square_by_joins`` does it."""
    names = np.unique(np.concatenate([i, j]))
    if not len(names):
        return names, names
    n, i, j = len(names), np.searchsorted(names, i), np.searchsorted(names, j)

    def tidy(code: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        code, at = np.unique(code, return_inverse=True)
        v = np.bincount(at, v)
        j, i = code // n, code % n
        return i, j, v / np.bincount(j, v, n)[j]

    i, j, v = tidy(j * n + i, v)
    for _ in range(rounds):
        start = np.searchsorted(j, np.arange(n + 1))
        many = (start[1:] - start[:-1])[i]  # entries of column i, which the entry (i, j) is multiplied by
        ends = np.cumsum(many)
        codes, values = [], []
        for s, e in _cuts(ends, j, 4_000_000):
            m = many[s:e]
            at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(start[i[s:e]], m)
            code, back = np.unique(np.repeat(j[s:e], m) * n + i[at], return_inverse=True)
            p = np.bincount(back, np.repeat(v[s:e], m) * v[at]) ** INFLATION
            col = code // n
            p /= np.bincount(col, p, n)[col]
            top = np.zeros(n)
            np.maximum.at(top, col, p)
            keep = (p >= PRUNE) | (p == top[col])
            codes.append(code[keep]), values.append(p[keep])
        i2, j2, v2 = tidy(np.concatenate(codes), np.concatenate(values))
        old, new = j * n + i, j2 * n + i2
        code, at = np.unique(np.concatenate([old, new]), return_inverse=True)
        moved = np.abs(np.bincount(at, np.concatenate([v, -v2]))).max()
        i, j, v = i2, j2, v2
        if moved < 1e-3:
            break
    order = np.lexsort((i, -np.round(v, 9), j))
    first = order[np.append(True, np.diff(j[order]) > 0)] if len(order) else order
    to = np.arange(n)
    to[j[first]] = i[first]
    return names, names[attractors(to)]


def _cuts(ends: np.ndarray, j: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of entries with about that many products, whole columns each."""
    s = 0
    while s < len(ends):
        base = ends[s - 1] if s else 0
        e = max(s + 1, int(np.searchsorted(ends, base + most)))
        e = int(np.searchsorted(j, j[min(e, len(j)) - 1], "right"))
        yield s, e
        s = e


def _square_by_joins(m: DataFrame, rounds: int) -> DataFrame:
    """(node, cluster) of a sparse matrix (i, j, v) of any size: squaring is a join on the shared index and a sum."""
    def normal(m: DataFrame) -> DataFrame:
        return m.withColumn("v", F.col("v") / F.sum("v").over(W.partitionBy("j")))

    m = materialise(normal(m), "flow-0")
    for r in range(rounds):
        a, b = m.alias("a"), m.alias("b")
        squared = a.join(b, F.col("a.j") == F.col("b.i")).groupBy(F.col("a.i").alias("i"), F.col("b.j").alias("j")).agg(F.sum(F.col("a.v") * F.col("b.v")).alias("v"))
        inflated = normal(squared.withColumn("v", F.pow("v", F.lit(INFLATION)))).withColumn("top", F.max("v").over(W.partitionBy("j"))).where((F.col("v") >= PRUNE) | (F.col("v") == F.col("top"))).drop("top")
        new = materialise(normal(inflated), f"flow-{r + 1}")
        moved = new.withColumnRenamed("v", "x").join(m.withColumnRenamed("v", "y"), ["i", "j"], "full").agg(F.max(F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))))).first()[0]
        m = new
        if moved is None or moved < 1e-3:
            break
    to = m.groupBy("j").agg(F.max_by("i", F.struct(F.round("v", 9), -F.col("i"))).alias("to")).select(F.col("j").alias("node"), "to")
    best, was = materialise(to.withColumn("best", F.col("to")), "flow-to"), None
    while True:  # pointer jumping, the least node of each path kept, until the least beyond the end of every path stays: then all are on their circles
        ends = best.select(F.col("node").alias("to"), F.col("best").alias("cluster"))
        now = materialise(best.join(ends, "to").select("node", "cluster"), "flow-ends")
        if was is not None and not now.join(was.withColumnRenamed("cluster", "was"), "node").where("cluster <> was").limit(1).count():
            return now
        was = now
        jump = best.select(F.col("node").alias("to"), F.col("to").alias("far"), F.col("best").alias("b2"))
        best = materialise(best.join(jump, "to").select("node", F.col("far").alias("to"), F.least("best", "b2").alias("best")), "flow-to")


def markov_clusters(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, cluster) of the nodes of a sparse similarity graph (i, j, v)."""
    edges = materialise(edges, "flow-edges")
    if edges.count() > LOCAL_EDGES:
        return _square_by_joins(edges, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches), pa.schema([("i", pa.int64()), ("j", pa.int64()), ("v", pa.float64())]))
        names, to = _square_locally(*(np.asarray(c.combine_chunks()) if len(c) else np.zeros(0, k) for c, k in zip(t.columns, (np.int64, np.int64, np.float64))), rounds)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(to)], ["node", "cluster"])

    return edges.coalesce(1).mapInArrow(run, "node bigint, cluster bigint")


def flow_chains(rows: DataFrame, n: int, round_: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((id, cluster) of every row that is not alone, (cluster, centre) by the nodes of the last graph, (id, inflow) of the attractors)."""
    nodes, maps, inflow, level = rows.select("id", F.lit(1.0).alias("weight"), "unit"), [], None, 0
    while True:
        out = _level(nodes, n, 100 * round_ + level, f"level-{round_}-{level}")
        maps.append(out.select("child", "parent"))
        nodes = out.where("weight is not null").select(F.col("parent").alias("id"), "weight", "unit")
        heavy = nodes.where("weight > 1").select("id", "weight")
        inflow = heavy if inflow is None else inflow.unionByName(heavy)
        before, n, level = n, nodes.count(), level + 1
        if n > 0.7 * before:
            break
    top = materialise(markov_clusters(similarity_edges(nodes, n, 100 * round_ + 50)), f"top-{round_}")
    cluster = materialise(nodes.join(top.withColumnRenamed("node", "id"), "id", "left").select("id", "weight", F.coalesce("cluster", "id").alias("cluster"), "unit"), f"ends-{round_}")
    sizes = cluster.groupBy("cluster").agg(F.sum("weight").alias("size")).where("size > 1.5")
    several = materialise(cluster.join(sizes, "cluster", "left_semi"), f"several-{round_}")
    chain = several.select(F.col("id").alias("parent"), "cluster")
    for m in reversed(maps):  # at most BLOCK children a parent, so no key is hot
        chain = m.join(chain, "parent").select(F.col("child").alias("parent"), "cluster")
    chain = materialise(chain.withColumnRenamed("parent", "id"), f"chains-{round_}")
    return chain, materialise(_centres(several), f"centres-{round_}"), inflow.groupBy("id").agg(F.max("weight").cast("bigint").alias("inflow"))


def beyond_chance(size: Column, closeness: Column, n: int) -> Column:
    """Whether ``size`` of ``n`` directions with that mean similarity to their centre are too alike for chance.

    The length of a sum of random directions has a chi-square law, whose tail is bounded by Chernoff; there are about (e n / size) ^ size choices.
    """
    q = F.greatest(size * closeness * closeness, F.lit(1.0))
    return F.lit(DIM / 2) * (q - 1 - F.log(q)) > size * (1 + F.log(F.lit(float(max(n, 1))) / size)) + ODDS


def _closeness(member: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, cluster, closeness) of rows (id, unit, cluster) to their own cluster's centre."""
    both = member.join(F.broadcast(centres) if centres.count() <= BROADCAST_CENTRES else centres, "cluster").select("id", "cluster", "unit", "centre")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.einsum("ij,ij->i", matrix_of(b.column(2)), matrix_of(b.column(3))))], ["id", "cluster", "closeness"])

    return both.mapInArrow(run, "id bigint, cluster bigint, closeness double")


def _centres(nodes: DataFrame) -> DataFrame:
    """(cluster, centre): directions of the weighted sums of the nodes' directions, added up per batch before anything is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, at = np.unique(np.asarray(b.column(0)), return_inverse=True)
            sums = np.zeros((len(c), DIM))
            np.add.at(sums, at, matrix_of(b.column(1)) * np.asarray(b.column(2))[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.ListArray.from_arrays(pa.array(np.arange(0, len(c) * DIM + 1, DIM), pa.int32()), pa.array(sums.ravel()))], ["cluster", "s"])

    sums = nodes.select("cluster", "unit", "weight").mapInArrow(run, "cluster bigint, s array<double>").groupBy("cluster").agg(*[F.sum(F.col("s")[k]).alias(f"c{k}") for k in range(DIM)])
    norm = F.sqrt(sum((F.col(f"c{k}") * F.col(f"c{k}") for k in range(1, DIM)), F.col("c0") * F.col("c0")))
    return sums.select("cluster", F.array(*[(F.col(f"c{k}") / F.greatest(norm, F.lit(1e-12))).cast("float") for k in range(DIM)]).alias("centre"))


def _nearest(rows: DataFrame, real: DataFrame, n: int) -> DataFrame:
    """(id, cluster, closeness, least) of the nearest cluster (cluster, centre, least) of each row, ``CENTRES`` of them at a time."""
    spark, found, blocks = rows.sparkSession, None, max(1, -(-n // CENTRES))
    for block in range(blocks):
        t = real.where(F.pmod(F.xxhash64("cluster"), F.lit(blocks)) == block).select("cluster", "centre", "least").orderBy("cluster").toArrow()
        if not t.num_rows:
            continue
        shared = spark.sparkContext.broadcast((np.asarray(t.column(0).combine_chunks()), matrix_of(t.column(1).combine_chunks()), np.asarray(t.column(2).combine_chunks())))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, c, least = shared.value
            for b in batches:
                s = matrix_of(b.column(1)) @ c.T
                g = s.argmax(1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[g]), pa.array(s[np.arange(len(g)), g]), pa.array(least[g])], ["id", "cluster", "closeness", "least"])

        here = rows.select("id", "unit").mapInArrow(run, "id bigint, cluster bigint, closeness double, least double")
        found = here if found is None else found.unionByName(here)
    if blocks > 1:
        found = found.groupBy("id").agg(F.max_by(F.struct("cluster", "closeness", "least"), F.struct("closeness", -F.col("cluster"))).alias("b")).select("id", "b.*")
    return found


def _rows_of(rows: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """Rows of the ids given; vectors are shuffled only where the ids are too many to be broadcast."""
    ids = materialise(ids, f"{name}-ids")
    return materialise(rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi"), name)


def group_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", stored_col: str = "cluster_id") -> DataFrame:
    """(id, stored, grp, closeness, inflow): the group of every usable vector (null for none), its similarity to the group's centre and the
    number of rows whose flow passes it. ``grp`` is the id of the group's attractor."""
    vectors = materialise(unit_vectors(df.withColumn(stored_col, F.col(stored_col).cast("int")), id_col, vec_col, keep=(stored_col,)).select("id", "unit", F.col(stored_col).alias("stored")), "vectors")
    ids = materialise(vectors.select("id", "stored").dropDuplicates(["id"]), "ids")
    every = n = ids.count()
    left, left_ids, placed, flows, round_ = vectors.select("id", "unit"), ids.select("id"), None, None, 0
    while n > 1:
        chains, centres, inflow = flow_chains(left, n, round_)
        near = materialise(_closeness(left.join(chains, "id"), centres).dropDuplicates(["id"]), f"near-{round_}")
        least = near.groupBy("cluster").agg((NEAR * F.percentile_approx("closeness", 0.5, 1000)).alias("least"))
        kept = near.join(least, "cluster").where((F.col("closeness") >= F.col("least")) | (F.col("id") == F.col("cluster")))
        sized = kept.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.avg("closeness").alias("mean"), F.first("least").alias("least"))
        real = materialise(sized.where(beyond_chance(F.col("size"), F.col("mean"), every)).select("cluster", "least").join(centres, "cluster"), f"real-{round_}")
        groups = real.count()
        if not groups:
            break
        own = materialise(kept.join(real.select("cluster"), "cluster", "left_semi").select("id", "cluster", "closeness"), f"own-{round_}")
        rest = _rows_of(left, left_ids.join(own.select("id"), "id", "left_anti"), f"rest-{round_}")
        late = _nearest(rest, real, groups).where(F.col("closeness") >= F.col("least")).drop("least").dropDuplicates(["id"])
        new = materialise(own.unionByName(late), f"placed-{round_}")
        placed = new if placed is None else placed.unionByName(new)
        flows = inflow if flows is None else flows.unionByName(inflow)
        left_ids = materialise(left_ids.join(new.select("id"), "id", "left_anti"), f"left-{round_}")
        n, round_ = left_ids.count(), round_ + 1
        left = _rows_of(rest, left_ids, f"again-{round_}")
    if placed is None:
        return ids.select("id", "stored", F.lit(None).cast("bigint").alias("grp"), F.lit(None).cast("double").alias("closeness"), F.lit(1).cast("bigint").alias("inflow"))
    flows = flows.groupBy("id").agg(F.max("inflow").alias("inflow"))
    out = ids.join(placed.withColumnRenamed("cluster", "grp"), "id", "left").join(flows, "id", "left")
    return materialise(out.select("id", "stored", "grp", "closeness", F.coalesce("inflow", F.lit(1)).alias("inflow")), "groups")


def group_ids(groups: DataFrame) -> DataFrame:
    """(grp, cluster_id): the stored id most members of a group carry."""
    votes = groups.where("grp is not null and stored is not null").groupBy("grp", "stored").count()
    return votes.groupBy("grp").agg(F.max_by("stored", F.struct("count", -F.col("stored"))).alias("cluster_id"))


def wrong_members(groups: DataFrame) -> DataFrame:
    """(vec_id, cluster_id): members that carry another id than their group, or none."""
    g = groups.where("grp is not null").join(group_ids(groups), "grp")
    return g.where(F.col("stored").isNull() | (F.col("stored") != F.col("cluster_id"))).select(F.col("id").alias("vec_id"), "cluster_id")


def describe_groups(groups: DataFrame, top: int = 5) -> DataFrame:
    """(grp, cluster_id, size, typical array<bigint>): sizes and the members with the strongest flow, then the nearest to the centre."""
    g = groups.where("grp is not null")
    size = g.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    best = g.withColumn("r", F.row_number().over(W.partitionBy("grp").orderBy(F.desc("inflow"), F.desc("closeness"), "id"))).where(F.col("r") <= top)
    typical = best.groupBy("grp").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "id"))), lambda s: s["id"]).alias("typical"))
    return size.join(typical, "grp").join(group_ids(groups), "grp", "left").select("grp", "cluster_id", "size", "typical")
