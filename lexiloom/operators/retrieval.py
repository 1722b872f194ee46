"""Retrieval for tables of queries: BM25, vector search in the same plan, their fusion, gates and snippets.

Queries are a table (query_id, text). A query table may be broadcast only after its size was checked; it then meets the postings
without a shuffle of them. All results rank by score, ties by the lower id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import text as X

K1, B, FLOOR = 1.5, 0.75, 0.25
VECTOR_WEIGHT = 0.65
#: Query-term rows up to which they are broadcast.
BROADCAST_ROWS = 500_000
#: Hits that are broadcast at once to the texts they need, and how often the texts are read for that rather than shuffled.
PASS_ROWS, PASSES = 250_000, 12


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """With a broadcast hint if it has at most ``limit`` rows; else left to the planner."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed_terms(text: pd.Series) -> pd.Series:
    """Index terms: tokens with inflections removed. Null gives none."""
    from ..functions.pytext import index_terms

    return text.map(lambda t: index_terms(t) if t is not None else [])


def analysed(df: DataFrame, id_col: str, text_col: str, analyser: str = "tokens") -> DataFrame:
    """(id, terms) with the plain tokens ("tokens", on the JVM) or stemmed ones ("stems", Arrow)."""
    terms = X.tokens(F.coalesce(F.col(text_col), F.lit(""))) if analyser == "tokens" else stemmed_terms(text_col)
    return df.select(F.col(id_col).alias("id"), terms.alias("terms"))


def spread(df: DataFrame) -> DataFrame:
    """A table just read, over all cores where it has fewer partitions than there are; large inputs stay as they are.

    Not for frames with a shuffle: asking those for their partitions would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def postings(df: DataFrame, id_col: str, text_col: str, analyser: str = "tokens") -> DataFrame:
    """(id, term, tf, dl) of records with one row each, counted inside each row in one Arrow pass, so nothing is shuffled.

    Every record, even one without terms, has a further row with a null term and its length, from which the corpus is counted.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..functions.pytext import index_terms, tokens

        analyse = tokens if analyser == "tokens" else index_terms
        for b in batches:
            terms, tf, n, dl = [], [], [], []
            for t in b.column(1).to_pylist():
                words = analyse(t) if t else []
                counts = Counter(words)
                terms += [None, *counts.keys()]
                tf += [0, *counts.values()]
                n.append(len(counts) + 1)
                dl.append(len(words))
            ids = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), n)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(terms, pa.string()), pa.array(tf, pa.int64()), pa.array(np.repeat(dl, n), pa.int64())], ["id", "term", "tf", "dl"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, term string, tf bigint, dl bigint")


def inverse_frequencies(post: DataFrame, n: int) -> DataFrame:
    """(term, df, idf): log odds, with negative ones replaced by a quarter of the mean."""
    return floored(post.where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df")), n)


def floored(df: DataFrame, n: int) -> DataFrame:
    """The same of counted terms (term, df)."""
    raw = df.withColumn("raw", F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw")).first()[0] or 0.0
    return raw.select("term", "df", F.when(F.col("raw") < 0, FLOOR * mean).otherwise(F.col("raw")).alias("idf"))


def bm25_scores(corpus: DataFrame, queries: DataFrame, id_col: str, text_col: str, analyser: str = "tokens", query_id: str = "query_id", query_text: str = "query_text") -> DataFrame:
    """(query_id, id, raw): the raw score of every record that shares a term with the query; a repeated query term counts again."""
    from ..session import materialise

    post = materialise(postings(corpus, id_col, text_col, analyser), "postings")
    n, total = post.where("term is null").agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    avgdl = total / n if n else 1.0
    q = materialise(postings(queries, query_id, query_text, analyser).where("term is not null").select(F.col("id").alias("query_id"), "term", F.col("tf").alias("qtf")), "query-terms")
    # idf needs the frequencies of all terms (its floor is their mean); only the queries' terms go on
    idf = inverse_frequencies(post, n)
    asked = q.join(idf, "term")
    hit = post.join(F.broadcast(asked) if q.count() <= BROADCAST_ROWS else asked, "term")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(float(avgdl) or 1.0)))
    return hit.groupBy("query_id", "id").agg(F.sum(part).alias("raw"))


def top_k(scores: DataFrame, k: int, score: str = "score", by: str = "query_id", id_col: str = "id") -> DataFrame:
    """With ``rank``: the k best of each query; only partial winners are shuffled."""
    return scores.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc(score), F.col(id_col)))).where(F.col("rank") <= k)


def normalised(scores: DataFrame, n: int) -> DataFrame:
    """Adds ``lexical``: raw over the maximum of the query over all ``n`` records (those without a hit score 0), or over 1 where that is 0."""
    w = W.partitionBy("query_id")
    top = F.when(F.count(F.lit(1)).over(w) < n, F.greatest(F.max("raw").over(w), F.lit(0.0))).otherwise(F.max("raw").over(w))
    return scores.withColumn("lexical", F.col("raw") / F.when(top == 0, 1.0).otherwise(top))


def fuse(vector_hits: DataFrame, lexical: DataFrame, k: int, weight: float = VECTOR_WEIGHT) -> DataFrame:
    """Full outer union of (query_id, id, vector) and (query_id, id, lexical), the missing side 0, and its top k."""
    both = vector_hits.join(lexical, ["query_id", "id"], "full").select("query_id", "id", F.coalesce("vector", F.lit(0.0)).alias("vector_score"), F.coalesce("lexical", F.lit(0.0)).alias("lexical_score"))
    return top_k(both.withColumn("score", weight * F.col("vector_score") + (1 - weight) * F.col("lexical_score")), k)


def merge_queries(hits: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """hits (query_id, id, score) of several queries of one group (query_id, group_id): the best score of each record, and the top k."""
    best = hits.join(small(groups), "query_id").groupBy("group_id", "id").agg(F.max("score").alias("score"))
    return top_k(best, k, by="group_id")


def relative_cut(hits: DataFrame, share: float, score: str = "score") -> DataFrame:
    """Hits with at least that share of the query's best; the first hit stays in any case."""
    best = F.max(score).over(W.partitionBy("query_id"))
    return hits.withColumn("_best", best).where((F.col(score) >= share * F.col("_best")) | (F.col("rank") == 1)).drop("_best")


def confidence_gate(hits: DataFrame, confidence: DataFrame, threshold: float = 0.3) -> DataFrame:
    """No hits for queries whose (query_id, confidence) is below the threshold."""
    return hits.join(confidence.where(F.col("confidence") >= threshold).select("query_id"), "query_id", "left_semi")


def each_once(df: DataFrame, key: str) -> DataFrame:
    """The least row of each key, of a table just read: only rows whose key repeats are shuffled, where such keys are few and the table is in parts enough."""
    from ..session import materialise

    cores, rest = df.sparkSession.sparkContext.defaultParallelism, [c for c in df.columns if c != key]

    def least(rows: DataFrame) -> DataFrame:
        return rows.groupBy(key).agg(F.min(F.struct(*rest)).alias("_least")).select(key, "_least.*").select(*df.columns)

    if df.rdd.getNumPartitions() < cores:
        return least(df.repartition(cores, key))
    repeated = materialise(df.groupBy(F.col(key).alias("_key")).count().where("count > 1").select("_key"), "repeated")
    if repeated.count() > BROADCAST_ROWS:
        return least(df)
    same = F.col(key).eqNullSafe(F.col("_key"))
    return df.join(F.broadcast(repeated), same, "left_anti").unionByName(least(df.join(F.broadcast(repeated), same, "left_semi")))


def attach(hits: DataFrame, corpus: DataFrame, id_col: str, *cols: str) -> DataFrame:
    """Text and source of the few hits that are left (late materialisation)."""
    return hits.join(corpus.select(F.col(id_col).alias("id"), *cols), "id")


def in_passes(hits: DataFrame, wordings: DataFrame, corpus: DataFrame, id_col: str, found: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """``found`` of hits (group_id, id, ...) of a table just written, each with its wordings (group_id, wordings), text and source, as written tables.

    Groups of hits are broadcast part by part, with their wordings beside them, so no text is shuffled; too many hits are left to the planner.
    """
    from ..session import materialise

    cols = "text", F.col("source_name").alias("source")
    passes = max(1, -(-hits.count() // PASS_ROWS))
    if passes > PASSES:
        return materialise(found(attach(hits.join(wordings, "group_id"), corpus, id_col, *cols)), name)
    mine = [F.pmod(F.xxhash64("group_id"), F.lit(passes)) == p for p in range(passes)]
    return reduce(DataFrame.unionByName, [materialise(found(attach(F.broadcast(hits.where(m)), corpus, id_col, *cols).join(F.broadcast(wordings.where(m)), "group_id")), name) for m in mine])


@F.pandas_udf(T.StringType())
def snippets_of_300(text: pd.Series, query: pd.Series) -> pd.Series:
    """The best snippet of each text, of at most 300 characters; null counts as empty."""
    from ..functions.pytext import best_snippet

    return pd.Series([best_snippet(t or "", q or "", 300) for t, q in zip(text, query)], dtype=object)


def distinct_snippets(hits: DataFrame, limit: int = 300, k: int | None = None) -> DataFrame:
    """hits (query_id, rank, id, source, text, query_text) -> (query_id, place, id, source, snippet) without repeated passages.

    A query has at most its top k hits, so its group is bounded. Hits that have a ``snippet`` already need no texts.
    """
    made = "snippet" in hits.columns

    def run(p: pd.DataFrame) -> pd.DataFrame:
        from ..functions import pytext as P

        p = p.sort_values("rank")
        kept = P.distinct(p["snippet"].tolist(), k) if made else P.distinct_snippets(p["text"].fillna("").tolist(), p["query_text"].iloc[0] or "", limit, k)
        rows = p.iloc[[i for i, _ in kept]]
        return pd.DataFrame({"query_id": rows["query_id"].values, "place": range(1, len(kept) + 1), "id": rows["id"].values, "source": rows["source"].values, "snippet": [s for _, s in kept]})

    kind = hits.schema["query_id"].dataType.simpleString()
    needed = hits.select("query_id", "rank", "id", "source", *(["snippet"] if made else ["text", "query_text"]))
    return needed.groupBy("query_id").applyInPandas(run, f"query_id {kind}, place int, id bigint, source string, snippet string")


def formatted_hits(snippets: DataFrame) -> DataFrame:
    """(query_id, passages): ``[n] (source) snippet`` blocks in order."""
    block = F.struct("place", F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] ("), F.coalesce("source", F.lit("")), F.lit(") "), F.col("snippet")).alias("b"))
    return snippets.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(block)), lambda s: s["b"]), "\n\n").alias("passages"))


@F.pandas_udf(T.StringType())
def passages_of(sources: pd.Series, snippets: pd.Series, k: pd.Series) -> pd.Series:
    """Of each list of snippets in rank order: the blocks of ``formatted_hits``, without repeated passages."""
    from ..functions.pytext import distinct

    return pd.Series(["\n\n".join(f"[{n}] ({s[i] or ''}) {x}" for n, (i, x) in enumerate(distinct(t, m), 1)) for s, t, m in zip(sources, snippets, k)], dtype=object)


def gated_passages(hits: DataFrame, k: int, threshold: float = 0.3) -> DataFrame:
    """hits (query_id, rank, vector_score, coverage, source, snippet) -> (query_id, passages): what ``confidence_gate``, ``distinct_snippets`` and ``formatted_hits`` give, with one shuffle."""
    from .insight import confidence_of

    each = hits.repartition("query_id").groupBy("query_id").agg(confidence_of(F.col("coverage")).alias("confidence"), F.sort_array(F.collect_list(F.struct("rank", "source", "snippet"))).alias("h"))
    return each.where(F.col("confidence") >= threshold).select("query_id", passages_of("h.source", "h.snippet", F.lit(k)).alias("passages"))


def search_tool(hits: DataFrame, asked: DataFrame, corpus: DataFrame, id_col: str, k: int = 3, threshold: float = 0.3, wordings: DataFrame | None = None) -> DataFrame:
    """hits (query_id, id, score, vector_score) of several wordings asked(query_id, group_id, query_text) -> (query_id, passages) of each group.

    The best k + 2 records of all wordings go on, since records that repeat a passage are left out; nothing is shown below the threshold
    of the best confidence of any wording. ``wordings`` (group_id, wordings) has those of each group as a list, where they are at hand.
    """
    from ..session import materialise
    from .insight import best_coverage

    # a group is brought together once, for its records and their ranks
    best = hits.join(small(asked.select("query_id", "group_id")), "query_id").repartition("group_id").groupBy("group_id", "id").agg(F.max("score").alias("score"), F.max("vector_score").alias("vector_score"))
    if wordings is None:
        wordings = materialise(asked.groupBy("group_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("query_id", "query_text"))), lambda s: s["query_text"]).alias("wordings")), "tool-wordings")
    few = materialise(top_k(best, k + 2, by="group_id").drop("score"), "tool-hits")

    def found(full: DataFrame) -> DataFrame:
        """What is asked of a text is computed where it lies, so no text goes on with each of its hits."""
        return full.select(
            F.col("group_id").alias("query_id"), "id", "rank", "vector_score", "source", best_coverage("wordings", "text").alias("coverage"), snippets_of_300("text", F.array_join("wordings", " ")).alias("snippet"))

    return gated_passages(in_passes(few, wordings, corpus, id_col, found, "tool-snippets"), k, threshold)


def auto_context(question: Column, confidence: Column, passages: Column, threshold: float = 0.3) -> Column:
    """Passages where confident; an empty text for a knowledge question without an answer; else null."""
    return F.when(confidence >= threshold, passages).when(X.looks_like_knowledge_question(question), F.lit(""))


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): share of the exact ids found."""
    hit = exact.join(found.select("query_id", "id"), ["query_id", "id"], "left_semi").groupBy("query_id").count()
    return exact.select("query_id").distinct().join(hit, "query_id", "left").select("query_id", (F.coalesce("count", F.lit(0)) / k).alias("recall"))


def embedded(df: DataFrame, text_col: str, embedder) -> DataFrame:
    """Adds ``embedding`` by any embedder (dim, id, embed(texts) -> matrix); equal texts of a batch are embedded once."""
    @F.pandas_udf("array<float>")
    def embed(text: pd.Series) -> pd.Series:
        kinds, which = np.unique(text.fillna("").to_numpy(object).astype(str), return_inverse=True)
        if not len(kinds):
            return pd.Series([], dtype=object)
        v = np.asarray(embedder.embed(kinds.tolist()), np.float32)
        return pd.Series(list(v[which]))

    return df.withColumn("embedding", embed(text_col))


def hashing_embeddings(df: DataFrame, id_col: str, text_col: str, dim: int = 384) -> DataFrame:
    """(id, embedding array<float>) by the offline embedder; null text embeds as the empty one."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..functions.pytext import HashingEmbedder

        e = HashingEmbedder(dim)
        for p in batches:
            yield pd.DataFrame({"id": p["id"], "embedding": list(e.embed(p["t"].fillna("").tolist()))})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInPandas(run, f"id {kind}, embedding array<float>")
