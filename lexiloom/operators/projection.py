"""The map of a collection: PCA in the plane, k-means with a chosen number of clusters, silhouettes, cluster summaries and topics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..functions.vectors import matrix
from ..session import materialise


def covariance(vectors: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, covariance with n - 1, n) in one pass; a partition returns its sums of d + d*d numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0))
                n, s, ss = n + len(x), s + x.sum(0), ss + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1 + dim + dim * dim)), pa.array(np.concatenate([[n], s, ss.ravel()]))], ["k", "v"])

    rows = vectors.mapInArrow(run, "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(1 + dim + dim * dim)
    for k, v in rows:
        flat[k] = v
    n = int(flat[0])
    mean = flat[1 : 1 + dim] / max(n, 1)
    cov = (flat[1 + dim :].reshape(dim, dim) - n * np.outer(mean, mean)) / max(n - 1, 1)
    return mean, cov if n > 1 else np.zeros((dim, dim)), n


def principal_plane(mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, tuple[float, float]]:
    """Two orthonormal components, each with its largest loading positive, and their shares of the variance."""
    val, vec = np.linalg.eigh(cov)
    val, vec = np.clip(val[::-1], 0, None), vec[:, ::-1]
    comp = np.zeros((2, len(mean)))
    k = min(2, len(mean))
    comp[:k] = vec[:, :k].T
    for c in comp[:k]:
        if c[np.abs(c).argmax()] < 0:
            c *= -1
    total = val.sum()
    share = [float(v / total) if total > 0 else 0.0 for v in val[:2]] + [0.0, 0.0]
    return comp, (share[0], share[1])


def project(vectors: DataFrame, mean: np.ndarray, components: np.ndarray, scale: float, id_col: str = "id", vec_col: str = "v") -> DataFrame:
    """(id, x, y) of further vectors, questions for instance, on a map fitted before."""
    shared = vectors.sparkSession.sparkContext.broadcast((mean, components / (scale or 1.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, comp = shared.value
        for b in batches:
            p = (matrix(b.column(1)) - mean) @ comp.T if b.num_rows else np.zeros((0, 2))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p[:, 0]), pa.array(p[:, 1])], ["id", "x", "y"])

    kind = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(id_col, vec_col).mapInArrow(run, f"id {kind}, x double, y double")


def pca_map(vectors: DataFrame, dim: int, id_col: str = "id", vec_col: str = "v") -> DataFrame:
    """(id, x, y): coordinates scaled so that the fitted rows lie in [-1, 1], rounded to 4 places."""
    mean, cov, n = covariance(vectors.select(vec_col), dim)
    comp, _ = principal_plane(mean, cov)
    raw = project(vectors, mean, comp, 1.0, id_col, vec_col)
    top = raw.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()[0] or 0.0
    scale = top if top > 1e-12 else 1.0
    return raw.select("id", F.round(F.col("x") / scale, 4).alias("x"), F.round(F.col("y") / scale, 4).alias("y"))


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def kmeans(x: np.ndarray, k: int, seed: int = 0, n_init: int = 4, max_iter: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """(labels, centres, inertia) of a bounded sample: Lloyd's iterations from k-means++ seeds, the best of several starts."""
    k = max(1, min(k, len(x)))
    best = None
    for start in range(n_init):
        rng = np.random.default_rng(seed + start)
        picks = [int(rng.integers(len(x)))]
        near = _distances(x, x[picks])[:, 0]
        while len(picks) < k:
            total = near.sum()
            picks.append(int(rng.choice(len(x), p=near / total)) if total > 0 else int(rng.integers(len(x))))
            near = np.minimum(near, _distances(x, x[picks[-1:]])[:, 0])
        c, labels = x[picks].astype(float), None
        for _ in range(max_iter):
            new = _distances(x, c).argmin(1)
            if labels is not None and np.array_equal(new, labels):
                break
            labels = new
            n = np.bincount(labels, minlength=k)
            sums = np.zeros_like(c)
            np.add.at(sums, labels, x)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        inertia = float(_distances(x, c)[np.arange(len(x)), labels].sum())
        if best is None or inertia < best[2]:
            best = (labels, c, inertia)
    return best


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette of a bounded sample; single members score 0, and so does a labelling with one cluster or only single ones."""
    kinds, own = np.unique(labels, return_inverse=True)
    if len(kinds) < 2 or len(kinds) >= len(labels):
        return 0.0
    d = np.sqrt(_distances(x, x))
    sums = np.stack([d[:, own == c].sum(1) for c in range(len(kinds))], 1)
    size = np.bincount(own)
    rows = np.arange(len(x))
    a = sums[rows, own] / np.maximum(size[own] - 1, 1)
    other = sums / size
    other[rows, own] = np.inf
    b = other.min(1)
    top = np.maximum(a, b)
    s = np.where((size[own] > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0)
    return float(s.mean())


def silhouette_of(points: DataFrame, block: int = 2048) -> DataFrame:
    """points (id, v, label) -> (silhouette), over all rows: blocks of bounded size are broadcast, and every row adds up its distances
    to each label's members there. The work is quadratic by definition; take a sample where that is enough."""

    rows = materialise(points.select("id", "v", "label"), "silhouette")
    spark, n = rows.sparkSession, rows.count()
    blocks = max(1, -(-n // block))
    sums = None
    for b in range(blocks):
        t = rows.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select("v", "label").toArrow()
        if not t.num_rows:
            continue
        kinds, own = np.unique(np.asarray(t.column(1).combine_chunks()), return_inverse=True)
        shared = spark.sparkContext.broadcast((matrix(t.column(0)), kinds, np.eye(len(kinds))[own]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            x, kinds, member = shared.value
            for batch in batches:
                if batch.num_rows:
                    s = np.sqrt(_distances(matrix(batch.column(1)), x)) @ member
                    rep = lambda c: c.take(pa.array(np.repeat(np.arange(batch.num_rows), len(kinds))))
                    yield pa.RecordBatch.from_arrays([rep(batch.column(0)), rep(batch.column(2)), pa.array(np.tile(kinds, batch.num_rows)), pa.array(s.ravel())], ["id", "own", "label", "s"])

        kind = rows.schema["label"].dataType.simpleString()
        part = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, own {kind}, label {kind}, s double")
        sums = part if sums is None else sums.unionByName(part)
    if sums is None:
        return spark.createDataFrame([(0.0,)], "silhouette double")
    size = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    m = sums.groupBy("id", "own", "label").agg(F.sum("s").alias("s")).join(size, "label")
    mine = F.col("own") == F.col("label")
    ab = m.groupBy("id").agg(F.max(F.when(mine, F.col("n"))).alias("n"), F.max(F.when(mine, F.col("s") / F.greatest(F.col("n") - 1, F.lit(1)))).alias("a"), F.min(F.when(~mine, F.col("s") / F.col("n"))).alias("b"))
    top = F.greatest("a", "b")
    s = F.when((F.col("n") > 1) & F.col("b").isNotNull() & (top > 0), (F.col("b") - F.col("a")) / F.when(top > 0, top).otherwise(1.0)).otherwise(0.0)
    return ab.agg(F.coalesce(F.avg(s), F.lit(0.0)).alias("silhouette"))


def auto_kmeans(x: np.ndarray, k_min: int = 2, k_max: int = 8, seed: int = 0, sample: int = 800) -> tuple[np.ndarray, np.ndarray, float]:
    """(labels, centres, silhouette) of the number of clusters with the best silhouette; fewer than four rows are one cluster."""
    if len(x) < 4:
        labels, c, _ = kmeans(x, 1, seed, 1)
        return labels, c, 0.0
    pick = np.sort(np.random.default_rng(seed).choice(len(x), min(len(x), sample), replace=False))
    best = None
    for k in range(k_min, min(k_max, len(x) - 1) + 1):
        labels, c, _ = kmeans(x, k, seed)
        s = silhouette(x[pick], labels[pick])
        if best is None or s > best[2] + 1e-9:
            best = (labels, c, s)
    return best


def assign_nearest(vectors: DataFrame, centres: DataFrame, dim: int) -> DataFrame:
    """vectors (id, v), centres (label, c), a table no larger than the clusters -> (id, label, distance), ties to the lower label."""
    t = centres.toDF("label", "c").orderBy("label").toArrow()
    labels, c = np.asarray(t.column(0).combine_chunks()), matrix(t.column(1))
    shared = vectors.sparkSession.sparkContext.broadcast((labels, c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, c = shared.value
        for b in batches:
            d = _distances(matrix(b.column(1)), c) if b.num_rows else np.zeros((0, len(c)))
            to = d.argmin(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(labels[to].astype(np.int32)), pa.array(np.sqrt(d[np.arange(len(d)), to]))], ["id", "label", "distance"])

    return vectors.toDF("id", "v").select(F.col("id").cast("bigint").alias("id"), "v").mapInArrow(run, "id bigint, label int, distance double")


def centroids(vectors: DataFrame, label: str, vec: str) -> DataFrame:
    """(label, c array<double>): mean vector of each label, summed element by element with partial aggregation."""
    e = vectors.select(label, F.posexplode(vec).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return e.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))


def cluster_summary(points: DataFrame, label: str = "cluster_id", x: str = "map_x", y: str = "map_y") -> DataFrame:
    return points.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("size"), F.round(F.avg(x), 4).alias("x"), F.round(F.avg(y), 4).alias("y"))


def class_keywords(df: DataFrame, label: str, text: str, top: int = 3) -> DataFrame:
    """(label, rank, term, score): class-based tf-idf; terms of every class come last, overlapping Han or kana pairs only once.

    Counts are summed per (label, term) before they meet; a class needs only its ``candidates`` best for the last, ordered step.
    """
    candidates = 50 * top
    terms = df.where(F.col(label).isNotNull()).select(label, F.explode(X.content_tokens(F.col(text))).alias("term")).where(~F.col("term").rlike("^\\p{Nd}+$"))
    n = materialise(terms.groupBy(label, "term").agg(F.count(F.lit(1)).alias("n")), "class-terms")
    total = n.groupBy(label).agg(F.sum("n").alias("total"))
    overall = n.groupBy("term").agg(F.sum("n").alias("all_n"), F.count(F.lit(1)).alias("classes"))
    words, labels = total.agg(F.avg("total"), F.count(F.lit(1))).first()
    s = n.join(overall, "term").join(total, label)
    s = s.withColumn("score", F.col("n") / F.col("total") * F.log(1 + F.lit(words) / F.col("all_n"))).withColumn("common", (F.col("classes") == labels) & F.lit(labels > 1))
    order = [F.col("common").asc(), F.desc(F.round("score", 12)), F.col("term").asc()]
    s = s.withColumn("r", F.row_number().over(W.partitionBy(label).orderBy(*order))).where(F.col("r") <= candidates)

    def pick(p: pd.DataFrame) -> pd.DataFrame:
        from ..functions.pytext import is_cjk

        rows, used = [], set()
        for t, score in zip(*(p.sort_values("r")[c] for c in ("term", "score"))):
            if is_cjk(t):
                if used & set(t):
                    continue
                used |= set(t)
            rows.append((p[label].iloc[0], len(rows) + 1, t, score))
            if len(rows) == top:
                break
        return pd.DataFrame(rows, columns=[label, "rank", "term", "score"])

    kind = df.schema[label].dataType.simpleString()
    return s.select(label, "r", "term", "score").groupBy(label).applyInPandas(pick, f"{label} {kind}, rank int, term string, score double")
