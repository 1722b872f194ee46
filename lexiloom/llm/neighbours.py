"""Problem 2: the k most similar vectors of every vector.

Method: multiprobe p-stable hashing. The tables are trees of p-stable functions (``forest``); a vector is at home in one bucket of each
table and visits further ones in the order of their estimated success; the candidates of all tables are merged and reranked by exact
distance. Buckets hold a few thousand rows at most by construction, also where a third of all rows lie in one dense heap, so a bucket is
compared as one bounded matrix and no bucket is left out.

``near_pairs`` joins a whole collection with itself: a row travels once for each bucket it visits, as 16-bit steps, and meets the rows at
home there. Inside a bucket each row keeps its k best of at least the cosine asked for; a pair of two mutual neighbours is among them
wherever both meet, so nothing is lost by it. Equal vectors (up to 4 decimals) are one class; only its lowest ``k + 1`` ids can be among
anyone's k nearest. ``query_neighbours`` sends a stated query set to the buckets it visits; rows stay at home.

Defined results: unusable vectors (null, of another length, all zero, not finite) take no part; copies of an id count once; ties go
to the lower id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import materialise
from . import forest as fo
from .forest import DIM

#: Rows at home in a bucket of ``near_pairs`` and of ``query_neighbours``, tables of each.
LEAF, TABLES = 4000, 2
QUERY_LEAF, QUERY_TABLES = 128, 4
#: Wanted chance to bring a pair of the least cosine asked for together; the same for the k nearest of a query.
RECALL, QUERY_RECALL = 0.96, 0.93
#: What the 16-bit steps may take from a cosine; the exact one decides later.
ROUNDING = 1e-3
#: Rows whose similarities to a bucket are held at a time.
ROWS = 1024


def to_matrix(column: pa.Array, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are usable, float64 matrix of them)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    ok = np.asarray(column.is_valid()) & (np.asarray(column.value_lengths().fill_null(-1)) == dim)
    flat = column.filter(pa.array(ok)).flatten()
    valid = flat.null_count == 0
    x = np.asarray(flat.cast(pa.float64()).fill_null(np.nan) if not valid else flat.cast(pa.float64())).reshape(-1, dim) if n else np.empty((0, dim))
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return np.flatnonzero(ok)[good], x[good]


def unit_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, unit array<float>, cls bigint, *keep) of usable vectors; cls is equal for equal directions."""
    fields = "".join(f", {k} {df.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (np.random.default_rng(13).integers(1, 2**62, DIM, dtype=np.int64) | 1).astype(np.int64)
        for b in batches:
            at, x = to_matrix(b.column(1))
            # a scale first: squares of huge or tiny numbers would not be finite
            x = x / np.abs(x).max(1, keepdims=True) if len(x) else x
            x /= np.linalg.norm(x, axis=1, keepdims=True) if len(x) else 1
            cls = (np.rint(x * 1e4).astype(np.int64) * weights).sum(1)
            unit = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * DIM + 1, DIM), pa.int32()), pa.array(x.astype(np.float32).ravel()))
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), unit, pa.array(cls), *[b.column(2 + i).take(take) for i in range(len(keep))]], ["id", "unit", "cls", *keep])

    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>"), *keep).mapInArrow(run, f"id bigint, unit array<float>, cls bigint{fields}")


def matrix_of(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, DIM).astype(np.float64)


def routed(units: DataFrame, forest: fo.Forest, visits: int | None = None) -> DataFrame:
    """(leaf, home, id, code): a row for each bucket a vector visits; home tells its own bucket of each table."""
    shared = units.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in (b.slice(s, 2048) for b in batches for s in range(0, b.num_rows, 2048)):
            x = matrix_of(b.column(1))
            leaf = f.route(x, visits)
            many = leaf.shape[1] // len(f.trees)
            row, at = np.nonzero(leaf >= 0)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(leaf[row, at]), pa.array(at % many == 0), b.column(0).take(take), fo.pack_vectors(x).take(take)], ["leaf", "home", "id", "code"])

    return units.select("id", "unit").mapInArrow(run, "leaf int, home boolean, id bigint, code binary")


def _parts(df: DataFrame, forest: fo.Forest, rows: int) -> int:
    """Partitions of about 50 MB, but enough of them for all cores."""
    leaves = sum(t.leaves for t in forest.trees)
    return max(1, min(leaves, max(4 * df.sparkSession.sparkContext.defaultParallelism, rows // 300_000)))


def best_in_leaf(ids: np.ndarray, x: np.ndarray, home_ids: np.ndarray, home: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of home, cosine): for each row of x its k best at home of at least that cosine, itself aside; ties at the end stay."""
    out = []
    for s in range(0, len(x), ROWS):
        c = x[s : s + ROWS] @ home.T
        q, r = np.nonzero(c >= least)
        v = c[q, r]
        other = ids[s + q] != home_ids[r]
        q, r, v = q[other], r[other], v[other]
        order = np.lexsort((-v, q))
        q, r, v = q[order], r[order], v[order]
        first = np.searchsorted(q, q, "left")
        kth = np.minimum(first + k - 1, np.searchsorted(q, q, "right") - 1)
        keep = v >= v[kth] - ROUNDING if len(v) else np.zeros(0, bool)
        out.append((s + q[keep], r[keep], v[keep]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _meet(sent: DataFrame, parts: int, k: int, least: float) -> DataFrame:
    """sent (leaf, home, asks, id, code) -> (a, b): rows that ask with the best of those at home in the bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in fo.by_leaf(batches):
            ids, first = np.unique(np.asarray(t.column("id").combine_chunks()), return_index=True)
            home, asks = (np.asarray(t.column(c).combine_chunks()) for c in ("home", "asks"))
            x = fo.unpack_vectors(t.column("code").combine_chunks())
            # an id may be there as a visitor and at home: what counts is whether any of its rows is
            every = np.asarray(t.column("id").combine_chunks())
            at_home, asking = np.isin(ids, every[home]), np.isin(ids, every[asks])
            x = x[first]
            q, r, _ = best_in_leaf(ids[asking], x[asking], ids[at_home], x[at_home], k, least)
            yield pa.RecordBatch.from_arrays([pa.array(ids[asking][q]), pa.array(ids[at_home][r])], ["a", "b"])

    return sent.repartition(parts, "leaf").sortWithinPartitions("leaf").mapInArrow(run, "a bigint, b bigint")


#: Ids up to which a filter on vectors is broadcast (8 bytes each); beyond, the vectors are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _exact(pairs: DataFrame, units: DataFrame, least: float) -> DataFrame:
    """(a, b, cosine) of the pairs with at least that cosine, by the vectors of the ids that are in a pair."""
    need = materialise(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "needed")
    few = need.count() <= BROADCAST_IDS
    v = materialise(units.select("id", "unit").join(F.broadcast(need) if few else need, "id", "left_semi").dropDuplicates(["id"]), "needed-vectors")
    both = pairs.join(v.withColumnsRenamed({"id": "a", "unit": "u"}), "a").join(v.withColumnsRenamed({"id": "b", "unit": "v"}), "b").select("a", "b", "u", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v = matrix_of(b.column(2)), matrix_of(b.column(3))
            c = np.einsum("ij,ij->i", u, v) / np.sqrt(np.einsum("ij,ij->i", u, u) * np.einsum("ij,ij->i", v, v))
            take = pa.array(np.flatnonzero(c >= least - 1e-9))
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(c).take(take)], ["a", "b", "cosine"])

    return both.mapInArrow(run, "a bigint, b bigint, cosine double")


def near_pairs(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.92, k: int = 10) -> DataFrame:
    """(a, b, cosine), a < b: pairs of at least that cosine, one among the k most similar of the other; of equal vectors only the k + 1 lowest ids."""
    light = materialise(unit_vectors(df, id_col, vec_col).select("id", "cls"), "classes-of-ids")
    ids = light.dropDuplicates(["id"])
    classes = materialise(ids.groupBy("cls").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1"), "equal-classes")
    shared = ids.join(classes, "cls").select("cls", "rep", "id")

    def lowest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = pd.DataFrame({"cls": [], "rep": [], "id": []}, dtype="int64")
        for p in batches:
            best = pd.concat([best, p]).sort_values(["cls", "id"]).groupby("cls", sort=False).head(k + 1)
        yield best

    few = shared.mapInPandas(lowest, "cls bigint, rep bigint, id bigint")
    few = materialise(few.withColumn("r", F.row_number().over(W.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1).select("rep", "id"), "equal-lowest")
    # one vector a class: equal vectors beside the lowest id leave
    rest = materialise(shared.where("id <> rep").select("id").distinct(), "equal-others")
    gone = rest.count()
    units = unit_vectors(df, id_col, vec_col).select("id", "unit")
    reps = units.join(F.broadcast(rest) if gone <= BROADCAST_IDS else rest, "id", "left_anti")
    n = light.count()
    sample = fo.sample_of(reps, n)
    forest = fo.with_recall(fo.fit(sample, n, LEAF, TABLES, 1000), sample, least, RECALL)
    sent = routed(reps, forest).withColumn("asks", F.lit(True))
    pairs = _meet(sent, _parts(df, forest, n * TABLES * forest.visits), k, least - ROUNDING)
    pairs = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    exact = materialise(_exact(pairs, units, least), "near-pairs")
    # classes back to their lowest members
    m = few.withColumnsRenamed({"rep": "x", "id": "m"})
    wide = exact.join(m.withColumnsRenamed({"x": "a", "m": "ma"}), "a", "left").join(m.withColumnsRenamed({"x": "b", "m": "mb"}), "b", "left")
    wide = wide.select(F.coalesce("ma", "a").alias("a"), F.coalesce("mb", "b").alias("b"), "cosine")
    inner = m.alias("p").join(m.alias("q"), F.expr("p.x = q.x and p.m < q.m")).select(F.col("p.m").alias("a"), F.col("q.m").alias("b"), F.lit(1.0).alias("cosine"))
    return wide.unionByName(inner).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine")


def mutual_pairs(pairs: DataFrame, k: int = 10) -> DataFrame:
    """(vec_a, vec_b): each among the k most similar of the other, as far as the pairs tell."""
    both = pairs.select("a", "b", "cosine").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    top = both.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy(F.desc(F.round("cosine", 9)), "b"))).where(F.col("r") <= k)
    return top.select(F.least("a", "b").alias("vec_a"), F.greatest("a", "b").alias("vec_b")).groupBy("vec_a", "vec_b").count().where("count = 2").select("vec_a", "vec_b")


def visits_for(forest: fo.Forest, x: np.ndarray, k: int, recall: float, most: int = 64, asked: int = 400) -> int:
    """Visits in each table that bring sample rows and their k nearest of the sample together. True neighbours are nearer still."""
    q = x[:: max(1, len(x) // asked)]
    if len(x) <= k + 1:
        return 1
    top = np.argpartition(-(q @ x.T), k, axis=1)[:, : k + 1]
    found = np.zeros((*top.shape, most), bool)
    for t in forest.trees:
        home, v = t.visits(x, 1)[:, 0], t.visits(q, most)
        found |= np.logical_or.accumulate(home[top][:, :, None] == v[:, None, :], 2)
    share = found.mean((0, 1))
    return int((share >= recall).argmax()) + 1 if (share >= recall).any() else most


def query_neighbours(df: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10) -> DataFrame:
    """(query_id, rank, id, cosine): the k most similar other vectors of every row for which ``is_query`` (a column on id) holds.

    Exact distances are computed only where a query visits the bucket a row is at home in.
    """
    unit = materialise(unit_vectors(df, id_col, vec_col).select("id", "unit").dropDuplicates(["id"]), "units")
    n = unit.count()
    sample = fo.sample_of(unit, n)
    forest = fo.fit(sample, n, QUERY_LEAF, QUERY_TABLES, 5000)
    visits = visits_for(forest, sample, k, QUERY_RECALL)
    rows = routed(unit, forest, 1).withColumn("asks", F.lit(False))
    asked = routed(unit.where(is_query(F.col("id"))), forest, visits).withColumn("home", F.lit(False)).withColumn("asks", F.lit(True))
    pairs = materialise(_meet(rows.unionByName(asked), _parts(df, forest, n * QUERY_TABLES), k, -1.1).distinct(), "query-candidates")
    exact = _exact(pairs, unit, -1.1)
    ranked = exact.withColumn("rank", F.row_number().over(W.partitionBy("a").orderBy(F.desc("cosine"), "b")))
    return ranked.where(F.col("rank") <= k).select(F.col("a").alias("query_id"), "rank", F.col("b").alias("id"), "cosine")
