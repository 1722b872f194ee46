"""What a retrieval result is worth: coverage, confidence, grounding of answers, and the record of unanswered questions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import text as X
from ..session import materialise

LEXICAL_WEIGHT = 0.6


@F.pandas_udf(T.DoubleType())
def query_coverage(query: pd.Series, passage: pd.Series) -> pd.Series:
    """Share of the question's content found in the passage; 0 for null or a question without content."""
    from ..functions.pytext import coverage

    return pd.Series([coverage(q or "", p or "") for q, p in zip(query, passage)], dtype=float)


@F.pandas_udf(T.DoubleType())
def best_coverage(wordings: pd.Series, passage: pd.Series) -> pd.Series:
    """The best coverage that any of several wordings has in the passage."""
    from ..functions.pytext import coverage

    return pd.Series([max((coverage(q or "", p or "") for q in qs), default=0.0) for qs, p in zip(wordings, passage)], dtype=float)


def confidence_of(covered: Column) -> Column:
    """Of a group of hits with their vector_score: the best of half similarity, half coverage."""
    semantic = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("vector_score", F.lit(0.0))))
    return F.round(F.max(0.5 * semantic + 0.5 * covered), 4)


def retrieval_confidence(hits: DataFrame) -> DataFrame:
    """hits (query_id, vector_score, and coverage or query_text and text) -> (query_id, confidence)."""
    covered = F.col("coverage") if "coverage" in hits.columns else query_coverage("query_text", "text")
    return hits.groupBy("query_id").agg(confidence_of(covered).alias("confidence"))


def lexical_support(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """answers (turn_id, answer), passages (turn_id, rank, text) -> (turn_id, sentence_no, words, support, source_rank), on the JVM.

    Support is the largest share of a sentence's different content words that one passage has; null rank where it is 0.
    """
    sent = answers.select("turn_id", F.posexplode(X.sentences(F.col("answer"))).alias("sentence_no", "s")).withColumn("w", X.content_tokens(F.col("s"))).where(F.size("w") > 0)
    sent = sent.select("turn_id", "sentence_no", F.size("w").alias("words"), F.array_distinct("w").alias("u"))
    # word by word: an equi-join and counts, so no sentence meets a passage it shares nothing with
    words = sent.select("turn_id", "sentence_no", F.explode("u").alias("term"))
    there = passages.select("turn_id", "rank", F.explode(F.array_distinct(X.content_tokens(F.col("text")))).alias("term"))
    shared = words.join(there, ["turn_id", "term"]).groupBy("turn_id", "sentence_no", "rank").count()
    best = shared.groupBy("turn_id", "sentence_no").agg(F.max("count").alias("n"), F.min_by("rank", F.struct(-F.col("count"), "rank")).alias("source_rank"))
    out = sent.join(best, ["turn_id", "sentence_no"], "left")
    return out.select("turn_id", "sentence_no", "words", (F.coalesce("n", F.lit(0)) / F.size("u")).alias("support"), "source_rank")


def grounding_score(support: DataFrame, score: str = "support") -> DataFrame:
    """(turn_id, score, level): supports weighted by the sentences' words."""
    total = F.sum(F.col(score) * F.col("words")) / F.sum("words")
    return support.groupBy("turn_id").agg(total.alias("raw")).select("turn_id", F.round("raw", 4).alias("score"), X.grounding_level(F.col("raw")).alias("level"))


_SENTENCES = "turn_id bigint, start int, end int, support double, source_rank int, citation boolean, words int"


def assess_grounding(turns: DataFrame, embedder=None) -> DataFrame:
    """turns (turn_id, answer, passages array<string>, sources array<string>) -> one row a sentence.

    0.6 lexical and 0.4 cosine by the embedder (hashing by default). A sentence that only names a source is a citation and counts
    nothing. No passages, or an answer without content words: no rows.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..functions import pytext as P

        e = embedder or P.HashingEmbedder()
        for p in batches:
            rows = []
            for turn, answer, passages, sources in zip(p["turn_id"], p["answer"], p["passages"], p["sources"]):
                passages = [x or "" for x in (passages if passages is not None else [])]
                sources = [x or "" for x in (sources if sources is not None else [])]
                spans = [(a, b, w) for a, b in P.sentence_spans(answer or "") if (w := P.content_tokens(answer[a:b]))]
                if not passages or not spans:
                    continue
                sets = [set(P.content_tokens(x)) for x in passages]
                norm = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                cos = np.clip(norm(e.embed([answer[a:b] for a, b, _ in spans]).astype(float)) @ norm(e.embed(passages).astype(float)).T, 0, 1)
                for (a, b, w), row in zip(spans, cos):
                    cited = cited_source(answer[a:b], set(w), sources)
                    if cited:
                        rows.append((turn, a, b, 1.0, cited, True, len(w)))
                        continue
                    u = set(w)
                    score = [LEXICAL_WEIGHT * len(u & s) / len(u) + (1 - LEXICAL_WEIGHT) * c for s, c in zip(sets, row)]
                    k = int(np.argmax(score))
                    rows.append((turn, a, b, round(score[k], 4), k + 1 if score[k] > 0 else None, False, len(w)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SENTENCES.split(", ")]).astype({"source_rank": "Int32"})

    return turns.select(F.col("turn_id").cast("bigint").alias("turn_id"), "answer", "passages", "sources").mapInPandas(run, _SENTENCES)


def cited_source(sentence: str, words: set[str], sources: list[str]) -> int | None:
    """Rank of the source a sentence merely names: it holds the source's name and at most five other content words."""
    import re

    from ..functions.pytext import content_tokens

    low = sentence.lower()
    for rank, label in enumerate(sources, 1):
        name = re.split(r"\s*\(|\s+demo\b|\s+knowledge\s+base\b", label, maxsplit=1, flags=re.I)[0].strip().rsplit("/", 1)[-1]
        if len(name) >= 4 and name.lower() in low and len(words - set(content_tokens(label))) <= 5:
            return rank
    return None


def grounding_reports(sentences: DataFrame) -> DataFrame:
    """(turn_id, score, level) of the rows of ``assess_grounding``; nothing but citations counts as fully grounded."""
    claim = ~F.col("citation")
    w = F.sum(F.when(claim, F.col("words")).otherwise(0))
    raw = F.when(w == 0, F.lit(1.0)).otherwise(F.sum(F.when(claim, F.col("support") * F.col("words")).otherwise(0.0)) / F.when(w == 0, 1).otherwise(w))
    return sentences.groupBy("turn_id").agg(raw.alias("raw")).select("turn_id", F.round("raw", 4).alias("score"), X.grounding_level(F.col("raw")).alias("level"))


# -- unanswered questions -------------------------------------------------------------------------------------------------


def gap_table(events: DataFrame, threshold: float = 0.3) -> DataFrame:
    """events (query, confidence, ts, language[, hits]) -> (query, confidence, count, last_seen, language): equal wordings, case aside, are one.

    The first wording and language stand for the group. Null or blank queries and null or sufficient confidence are no gaps.
    """
    e = events.withColumn("query", X.strip(F.col("query"))).where((F.col("query") != "") & (F.col("confidence") < threshold))
    return e.groupBy(F.lower("query").alias("key")).agg(
        F.min_by("query", F.struct("ts", "query")).alias("query"), F.round(F.min("confidence"), 4).alias("confidence"), F.sum(F.coalesce("hits", F.lit(1))).cast("bigint").alias("count"),
        F.max("ts").alias("last_seen"), F.min_by("language", F.struct("ts", "query")).alias("language"))


def merged_gaps(gaps: DataFrame, similarity: float = 0.6) -> DataFrame:
    """Adds ``canonical``: the wording that a gap of similar wording (Jaccard of content words) goes to, by way of others too.

    Candidates share one of the rarest words of either wording, as many as a Jaccard of ``similarity`` demands (prefix filter), so no
    group of wordings is paired off in full. A gap points at its most frequent neighbour, if that is more frequent than itself (ties: earlier
    in word order), and the canonical wording is the one at the end of that path.
    """
    g = gaps.select("key", F.array_distinct(X.content_tokens(F.col("query"))).alias("w"), "count").where(F.size("w") > 0)
    t = g.select("key", F.explode("w").alias("term"))
    df = t.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    ranked = t.join(df, "term").withColumn("r", F.row_number().over(W.partitionBy("key").orderBy("df", "term")))
    size = g.select("key", "w", F.size("w").alias("n"), "count")
    prefix = ranked.join(size, "key").where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * similarity) + 1).select("term", "key", "w", "count")
    a, b = prefix.alias("a"), prefix.alias("b")
    pair = a.join(b, (F.col("a.term") == F.col("b.term")) & (F.col("a.key") != F.col("b.key"))).select(F.col("a.key").alias("key"), F.col("b.key").alias("other"), F.col("b.count").alias("weight"), F.col("a.count").alias("own"), X.jaccard(F.col("a.w"), F.col("b.w")).alias("j")).where(F.col("j") >= similarity).distinct()
    up = pair.where((F.col("weight") > F.col("own")) | ((F.col("weight") == F.col("own")) & (F.col("other") < F.col("key"))))
    to = materialise(up.groupBy("key").agg(F.max_by("other", F.struct("weight", "j", "other")).alias("canonical")), "gap-neighbours")
    while True:  # a canonical wording may itself go on to another one: pointers are doubled until all end at a root
        far = to.select(F.col("key").alias("canonical"), F.col("canonical").alias("far"))
        moved = materialise(to.join(far, "canonical", "left").select("key", F.coalesce("far", "canonical").alias("canonical"), F.col("far").isNotNull().alias("moved")), "gap-roots")
        to = moved.drop("moved")
        if not moved.where("moved").limit(1).count():
            break
    return gaps.join(to, "key", "left").withColumn("canonical", F.coalesce("canonical", "key"))


def joined_gaps(gaps: DataFrame, similarity: float = 0.6) -> DataFrame:
    """The gaps as ``gap_table`` gives them, those of similar wording as one under the wording of their root."""
    m = materialise(merged_gaps(gaps, similarity), "gaps-with-roots")
    own = m.where("key = canonical").select(F.col("key").alias("canonical"), "query", "language")
    sums = m.groupBy("canonical").agg(F.min("confidence").alias("confidence"), F.sum("count").alias("count"), F.max("last_seen").alias("last_seen"))
    return sums.join(own, "canonical").select(F.col("canonical").alias("key"), "query", "confidence", "count", "last_seen", "language")


def ranked_gaps(gaps: DataFrame, limit: int = 20) -> DataFrame:
    """The most frequent, then latest, gaps."""
    return gaps.orderBy(F.desc("count"), F.desc("last_seen"), "query").limit(max(1, min(200, limit)))


def keep_most(gaps: DataFrame, most: int = 200) -> DataFrame:
    """The most frequent, then latest, gaps; the rest are forgotten, as the record is bounded by design."""
    return gaps.orderBy(F.desc("count"), F.desc("last_seen"), "query").limit(most)


def resolve(gaps: DataFrame, answered: DataFrame) -> DataFrame:
    """Gaps without those whose query has been answered (answered(query))."""
    return gaps.join(answered.select("query").distinct(), "query", "left_anti")


def turn_insight(questions: DataFrame, hits: DataFrame, threshold: float = 0.3, least_share: float = 0.1) -> DataFrame:
    """questions (query_id, query_text), hits (query_id, rank, id, source, score, vector_score, and coverage or text and query_text) -> one row a question.

    (query_id, language, confidence, level, gap, sources): hits far below the best aren't evidence; a gap shows no sources at all.
    """
    from .retrieval import relative_cut

    used = relative_cut(hits, least_share)
    conf = retrieval_confidence(used)
    listed = used.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "source"))), lambda s: s["source"]).alias("sources"))
    out = questions.join(conf, "query_id", "left").join(listed, "query_id", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    gap = F.col("confidence") < threshold
    none = F.array().cast("array<string>")
    return out.select("query_id", X.language(F.coalesce("query_text", F.lit(""))).alias("language"), "confidence", X.confidence_level(F.col("confidence")).alias("level"), gap.alias("gap"), F.when(gap, none).otherwise(F.coalesce("sources", none)).alias("sources"))
