"""The named queries: (spark, folder) -> DataFrame over whole tables. A search asks with every row whose id is divisible by 100; ``answer_path``, ``turn_insight`` and ``search_tool`` ask with all."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..functions import vectors as V
from ..operators import agent, insight, media, projection, retrieval, review, search
from ..operators import vectors as ann
from ..session import materialise, settled, shared_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
DIM = 64


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def _one(spark: SparkSession, d: str, name: str, key: str) -> DataFrame:
    """A table with each id once."""
    return table(spark, d, name).dropDuplicates([key])


def _chunks(spark, d):
    return _one(spark, d, "chunks", "chunk_id")


def _texts(spark, d):
    """Chunks with their texts, each id once, by the same choice at each read."""
    return retrieval.each_once(table(spark, d, "chunks").select("chunk_id", "text", "source_name"), "chunk_id")


def _questions(spark, d):
    return _one(spark, d, "gap_records", "gap_id").where("gap_id % 100 = 0").select(F.col("gap_id").alias("query_id"), F.col("query_text"))


def _vectors(spark, d):
    return _one(spark, d, "vectors", "vec_id").where(V.usable(F.col("embedding"), DIM)).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def _vector_queries(vectors):
    return vectors.where("id % 100 = 0").select(F.col("id").alias("query_id"), "v")


# -- store reads ------------------------------------------------------------------------------------------------------------


@query
def list_chunks(spark, d):
    return _chunks(spark, d).select("chunk_id", F.col("source_name").alias("source"), F.char_length("text").alias("characters"), F.lit(0.0).alias("score"))


@query
def chunk_lookup(spark, d):
    return table(spark, d, "chunks").where("chunk_id = 42").select("chunk_id", "source_name", "text").distinct()


@query
def distinct_sources(spark, d):
    return table(spark, d, "chunks").where("source_name is not null").select("source_name").distinct()


@query
def unseen_sources(spark, d):
    docs = table(spark, d, "documents").where("source is not null").select(F.col("source").alias("source_name")).distinct()
    return docs.join(table(spark, d, "chunks").select("source_name").distinct(), "source_name", "left_anti")


@query
def chunk_previews(spark, d):
    return _chunks(spark, d).where("text is not null").select("chunk_id", X.preview(F.col("text")).alias("preview"))


# -- text ---------------------------------------------------------------------------------------------------------------------


@query
def token_counts(spark, d):
    t = retrieval.spread(table(spark, d, "documents")).select("doc_id", X.tokens(F.coalesce("text", F.lit(""))).alias("t"))
    return t.select("doc_id", F.size("t").alias("tokens"), F.size(F.array_distinct("t")).alias("distinct_tokens"))


@query
def term_frequencies(spark, d):
    docs = retrieval.spread(table(spark, d, "documents"))
    return retrieval.inverse_frequencies(materialise(retrieval.postings(docs, "doc_id", "text"), "postings"), docs.count()).select("term", "df", F.round("idf", 6).alias("idf"))


@query
def sentence_counts(spark, d):
    s = table(spark, d, "documents").select("doc_id", X.sentences(F.coalesce("text", F.lit(""))).alias("s"))
    return s.select("doc_id", F.size("s").alias("sentences"), F.char_length(F.array_join("s", "")).alias("characters"))


@query
def detected_language(spark, d):
    g = _one(spark, d, "gap_records", "gap_id").where("query_text is not null")
    return g.select("gap_id", X.language_confident(F.col("query_text")).alias("confident"), X.language(F.col("query_text")).alias("language"))


@query
def dominant_script(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.script_of(F.col("text")).alias("script"))


@query
def question_intent(spark, d):
    g = _one(spark, d, "gap_records", "gap_id").where("query_text is not null")
    return g.select("gap_id", X.looks_like_question(F.col("query_text")).alias("question"), X.looks_like_knowledge_question(F.col("query_text")).alias("knowledge"))


@query
def document_chunks(spark, d):
    from ..operators.chunking import split_documents

    return split_documents(table(spark, d, "documents"))


@query
def hashed_embeddings(spark, d):
    return retrieval.hashing_embeddings(_chunks(spark, d), "chunk_id", "text")


@query
def cleaned_frames(spark, d):
    from ..functions.ocr import clean_ocr, close_cjk_gaps

    k = _one(spark, d, "keyframes", "keyframe_id").where("ocr_text is not null")
    return k.select("keyframe_id", close_cjk_gaps(clean_ocr("ocr_text")).alias("text"))


# -- retrieval ------------------------------------------------------------------------------------------------------------------


@query
def bm25_topk(spark, d):
    return answers(spark, d, _questions(spark, d))


@query
def bm25_relative_cut(spark, d):
    hits = retrieval.top_k(retrieval.bm25_scores(_chunks(spark, d), _questions(spark, d), "chunk_id", "text").withColumn("raw", F.round("raw", 6)), 10, "raw")
    return retrieval.relative_cut(hits, 0.5, "raw").select("query_id", F.col("id").alias("chunk_id"), "raw")


@query
def hybrid_topk(spark, d):
    chunks = _chunks(spark, d)
    vectors = _vectors(spark, d)
    asked = _vector_queries(vectors)
    texts = chunks.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("text").alias("query_text"))
    few = vectors.coalesce(spark.sparkContext.defaultParallelism)  # each task returns its own best
    found = materialise(ann.knn_exact(few, asked, 40, DIM, skip_self=False).select("query_id", "id", F.round("score", 6).alias("vector")), "near")
    corpus = search.Corpus(chunks, "chunk_id", "text")
    if corpus.floor_is_negative():
        lexical = retrieval.normalised(retrieval.bm25_scores(chunks, texts, "chunk_id", "text"), chunks.count()).select("query_id", "id", F.round("lexical", 6).alias("lexical"))
    else:
        lexical = corpus.lexical_beside(texts, found, 10)
    out = retrieval.fuse(found, lexical, 10)
    return out.select("query_id", "id", "rank", F.round("score", 5).alias("score"))


@query
def multi_query_merge(spark, d):
    t = _one(spark, d, "turn_insights", "turn_id").where("turn_id % 100 = 0").select("turn_id", F.posexplode("queries").alias("i", "query_text"))
    asked = t.where("query_text is not null and trim(query_text) <> ''").select((F.col("turn_id") * 1000 + F.col("i")).alias("query_id"), F.col("turn_id").alias("group_id"), "query_text")
    hits = search.Corpus(_chunks(spark, d), "chunk_id", "text").best(asked, 5)
    return retrieval.merge_queries(hits, asked.select("query_id", "group_id"), 5).select("group_id", F.col("id").alias("chunk_id"), "score", "rank")


def hybrid_hits(chunks, asked, k: int = 8):
    """The answer path: questions are embedded like the chunks and searched by vector and by stems; (query_id, id, rank, score, vector_score, ...)."""
    def found():
        corpus = search.Corpus(chunks, "chunk_id", "text", "stems", 384)
        if corpus.floor_is_negative():
            stored, vectors = (retrieval.hashing_embeddings(*x) for x in ((chunks, "chunk_id", "text"), (asked, "query_id", "query_text")))
            near = ann.knn_exact(stored, vectors, 4 * k, 384, skip_self=False).select("query_id", "id", F.col("score").alias("vector"))
            lexical = retrieval.normalised(retrieval.bm25_scores(chunks, asked, "chunk_id", "text", "stems"), corpus.n).select("query_id", "id", "lexical")
            hits = retrieval.fuse(near, lexical, k)
        else:
            hits = corpus.hybrid(asked, k, 4 * k)
        return hits.withColumn("score", F.round("score", 6))

    return settled(found, "hybrid-hits")


def _every_question(spark, d):
    return _one(spark, d, "gap_records", "gap_id").select(F.col("gap_id").alias("query_id"), F.coalesce("query_text", F.lit("")).alias("query_text"))


def _once(asked):
    """Each wording once, under the lowest id it is asked with."""
    return materialise(asked.groupBy("query_text").agg(F.min("query_id").alias("query_id")).select("query_id", "query_text"), "wordings")


def _for_every(found, asked, once):
    """What was found for each wording, for every id it is asked with."""
    ids = asked.join(once.withColumnRenamed("query_id", "first"), "query_text").select("first", "query_id")
    return found.withColumnRenamed("query_id", "first").join(ids, "first").select(*found.columns)


def _answered(spark, d, asked=None, *wanted):
    """Hits with their source and ``wanted`` of coverage and snippet, which are computed where the text lies: it doesn't go on with each hit."""
    asked, chunks = _questions(spark, d) if asked is None else asked, _texts(spark, d)
    hits = hybrid_hits(chunks, asked).join(retrieval.small(asked), "query_id")
    full = retrieval.attach(retrieval.small(hits), chunks, "chunk_id", "text", F.col("source_name").alias("source"))
    made = {"coverage": insight.query_coverage("query_text", "text"), "snippet": retrieval.snippets_of_300("text", "query_text")}
    return materialise(full.select("query_id", "id", "rank", "score", "vector_score", "source", *(made[c].alias(c) for c in wanted)), "answered")


@query
def retrieval_snippets(spark, d):
    return retrieval.distinct_snippets(_answered(spark, d, None, "snippet"), limit=300, k=5)


@query
def retrieval_passages(spark, d):
    return retrieval.formatted_hits(retrieval.distinct_snippets(_answered(spark, d, None, "snippet"), limit=300, k=5))


@query
def retrieval_confidence(spark, d):
    return insight.retrieval_confidence(_answered(spark, d, None, "coverage")).withColumn("level", X.confidence_level(F.col("confidence")))


@query
def answer_path(spark, d):
    """From question to what is shown, for all questions: hybrid search, the gate, distinct snippets of the hits that pass."""
    asked = _every_question(spark, d)
    once = _once(asked)
    a = _answered(spark, d, once, "coverage", "snippet")
    return _for_every(retrieval.distinct_snippets(retrieval.confidence_gate(a, insight.retrieval_confidence(a), 0.3), limit=300, k=5), asked, once)


@query
def search_tool(spark, d):
    """The queries of every turn searched together, two more than are shown, gated by their best confidence, as one text of passages a turn."""
    t = materialise(_one(spark, d, "turn_insights", "turn_id").select("turn_id", F.filter("queries", lambda x: x.isNotNull() & (F.trim(x) != "")).alias("queries")).where(F.size("queries") > 0), "turn-queries")
    once = materialise(t.groupBy("queries").agg(F.min("turn_id").alias("group_id")), "query-lists")  # turns with the same queries get the same text
    asked = once.select("group_id", F.posexplode("queries").alias("i", "query_text")).select((F.col("group_id") * 1000 + F.col("i")).alias("query_id"), "group_id", "query_text")
    texts, chunks = _once(asked), _texts(spark, d)
    hits = _for_every(hybrid_hits(chunks, texts, 5).select("query_id", "id", "score", "vector_score"), asked, texts)
    shown = retrieval.search_tool(hits, asked, chunks, "chunk_id", k=3, wordings=once.select("group_id", F.col("queries").alias("wordings")))
    turns = t.join(retrieval.small(once), "queries").select(F.col("turn_id").alias("query_id"), "group_id")
    return shown.withColumnRenamed("query_id", "group_id").join(retrieval.small(turns), "group_id").select("query_id", "passages")


@query
def grounded_answers(spark, d):
    """Transcripts held against the texts on their recording's screen, by words and by the embedder, citations aside."""
    answers = _one(spark, d, "transcripts", "transcript_id").where("text is not null and media_id is not null")
    frames = _one(spark, d, "keyframes", "keyframe_id").where("ocr_text is not null")
    one = frames.withColumn("r", F.row_number().over(W.partitionBy("media_id").orderBy("frame_index", "keyframe_id"))).where("r <= 5")  # an answer is given its five first passages
    lists = one.groupBy("media_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "ocr_text"))), lambda s: s["ocr_text"]).alias("passages"))
    turns = answers.join(lists, "media_id").select(F.col("transcript_id").alias("turn_id"), F.col("text").alias("answer"), "passages", F.transform("passages", lambda p: F.lit("screen")).alias("sources"))
    return insight.grounding_reports(insight.assess_grounding(turns))


@query
def remembered_turns(spark, d):
    """Memory: for every hundredth question the three earlier-stored questions it is most similar to."""
    g = _one(spark, d, "gap_records", "gap_id").where("query_text is not null")
    stored = materialise(retrieval.hashing_embeddings(g, "gap_id", "query_text").toDF("id", "v"), "memory")
    return ann.knn_exact(stored, stored.where("id % 100 = 0").withColumnRenamed("id", "query_id"), 3, 384).select("query_id", "id", "rank")


@query
def question_coverage(spark, d):
    """How far every hundredth question's content is found in its best chunk by BM25."""
    asked = _questions(spark, d)
    hits = retrieval.top_k(retrieval.bm25_scores(_chunks(spark, d), asked, "chunk_id", "text").withColumn("raw", F.round("raw", 6)), 1, "raw")
    full = retrieval.attach(hits, _chunks(spark, d), "chunk_id", "text").join(retrieval.small(asked), "query_id")
    return full.select("query_id", F.round(insight.query_coverage("query_text", "text"), 6).alias("coverage"))


@query
def gated_hits(spark, d):
    a = _answered(spark, d, None, "coverage")
    return retrieval.confidence_gate(a, insight.retrieval_confidence(a), 0.3).select("query_id", "id", "rank", "score")


@query
def turn_insight(spark, d):
    asked = _every_question(spark, d)
    once = _once(asked)
    return _for_every(insight.turn_insight(once, _answered(spark, d, once, "coverage")), asked, once)


# -- vectors ----------------------------------------------------------------------------------------------------------------------


@query
def knn_exact(spark, d):
    v = _vectors(spark, d)
    return ann.knn_exact(v, _vector_queries(v), 10, DIM).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query
def knn_sq8(spark, d):
    v = _vectors(spark, d)
    return ann.knn_sq8(ann.sq8_encode(v, DIM), _vector_queries(v), 10, DIM).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query
def sq8_recall(spark, d):
    v = _vectors(spark, d)
    q = _vector_queries(v)
    return retrieval.recall(ann.knn_sq8(ann.sq8_encode(v, DIM), q, 10, DIM), ann.knn_exact(v, q, 10, DIM), 10)


@query
def knn_pq(spark, d):
    v = _vectors(spark, d)
    books = ann.pq_train(v, DIM, subspaces=16)
    return ann.knn_pq(ann.pq_encode(v, books, DIM), _vector_queries(v), books, 10, DIM).select("query_id", "id", "rank", "score")


@query
def knn_pq_reranked(spark, d):
    v = _vectors(spark, d)
    books, q = ann.pq_train(v, DIM, subspaces=16), _vector_queries(v)
    return ann.rerank(ann.knn_pq(ann.pq_encode(v, books, DIM), q, books, 40, DIM), v, q, 10).select("query_id", "id", "rank", "score")


@query
def knn_cells(spark, d):
    v = _vectors(spark, d)
    centres = ann.cell_centres(v, DIM, 32)
    return ann.knn_cells(ann.cell_layout(v, centres, DIM), _vector_queries(v), centres, 10, DIM, probe=12).select("query_id", "id", "rank", "score")


@query
def knn_graph(spark, d):
    v = _vectors(spark, d)
    return ann.knn_graph(ann.graph_index(v, DIM, rows_each=4000), _vector_queries(v), 10, DIM).select("query_id", "id", "rank", "score")


@query
def graph_faults(spark, d):
    return ann.graph_faults(ann.graph_index(_vectors(spark, d), DIM, rows_each=4000))


def _contract(found: DataFrame, exact: DataFrame, least: float) -> DataFrame:
    """(queries, neighbours, reached): over all queries, whether the recall an approximate search owes is reached."""
    r = retrieval.recall(found, exact, 10).agg(F.count(F.lit(1)).alias("queries"), F.avg("recall").alias("r"))
    n = exact.agg(F.count(F.lit(1)).alias("neighbours"))
    return r.join(n, how="cross").select("queries", "neighbours", (F.col("r") >= least).alias("reached"))  # one row each


@query
def cells_recall(spark, d):
    """Twelve of 32 cells owe nine in ten of the true neighbours."""
    v = _vectors(spark, d)
    q, centres = _vector_queries(v), ann.cell_centres(v, DIM, 32)
    return _contract(ann.knn_cells(ann.cell_layout(v, centres, DIM), q, centres, 10, DIM, probe=12), ann.knn_exact(v, q, 10, DIM), 0.9)


@query
def graph_recall(spark, d):
    v = _vectors(spark, d)
    q = _vector_queries(v)
    return _contract(ann.knn_graph(ann.graph_index(v, DIM, rows_each=4000), q, 10, DIM), ann.knn_exact(v, q, 10, DIM), 0.95)


@query
def pq_recall(spark, d):
    """Codes alone owe half of the true neighbours."""
    v = _vectors(spark, d)
    books, q = ann.pq_train(v, DIM, subspaces=16), _vector_queries(v)
    return _contract(ann.knn_pq(ann.pq_encode(v, books, DIM), q, books, 10, DIM), ann.knn_exact(v, q, 10, DIM), 0.5)


@query
def pq_reranked_recall(spark, d):
    v = _vectors(spark, d)
    books, q = ann.pq_train(v, DIM, subspaces=16), _vector_queries(v)
    return _contract(ann.rerank(ann.knn_pq(ann.pq_encode(v, books, DIM), q, books, 40, DIM), v, q, 10), ann.knn_exact(v, q, 10, DIM), 0.9)


@query
def beam_sweep(spark, d):
    """Recall of one index under wider and wider beams: (beam, queries, no_worse), where no_worse tells that a wider beam finds as much."""
    v = _vectors(spark, d)
    q, index = _vector_queries(v), ann.graph_index(v, DIM, rows_each=4000)
    exact, out = materialise(ann.knn_exact(v, q, 10, DIM), "sweep-exact"), None
    for beam in (10, 50, 150, 400):
        r = retrieval.recall(ann.knn_graph(index, q, 10, DIM, beam=beam), exact, 10).agg(F.count(F.lit(1)).alias("queries"), F.avg("recall").alias("recall")).select(F.lit(beam).alias("beam"), "queries", "recall")
        out = r if out is None else out.unionByName(r)
    return out.select("beam", "queries", (F.col("recall") >= F.coalesce(F.lag("recall").over(W.orderBy("beam")), F.lit(0.0)) - 0.01).alias("no_worse"))


# -- map and topics -----------------------------------------------------------------------------------------------------------------


def _labelled(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


@query
def cluster_summary(spark, d):
    return projection.cluster_summary(_one(spark, d, "vectors", "vec_id"))


@query
def topic_chips(spark, d):
    """Clusters with their keywords, the largest first."""
    sizes = projection.cluster_summary(_one(spark, d, "vectors", "vec_id")).select("cluster_id", "size")
    words = table(spark, d, "map_clusters").select("cluster_id", F.array_join("keywords", " · ").alias("chip"))
    return sizes.join(words, "cluster_id", "left").orderBy(F.desc("size"), "cluster_id")


@query
def embedding_covariance(spark, d):
    _, cov, _ = projection.covariance(_labelled(spark, d).select("v"), DIM)
    rows = [(i, j, float(cov[i, j])) for i in range(DIM) for j in range(DIM)]
    return spark.createDataFrame(rows, "i int, j int, c double").withColumn("c", F.round("c", 6) + 0.0)


@query
def embedding_map(spark, d):
    return projection.pca_map(_labelled(spark, d), DIM)


@query
def nearest_label(spark, d):
    e = _labelled(spark, d)
    out = projection.assign_nearest(e.select("id", "v"), projection.centroids(e, "label", "v"), DIM)
    return out.select("id", "label", F.round("distance", 5).alias("distance"))


@query
def label_silhouette(spark, d):
    return projection.silhouette_of(_labelled(spark, d)).select(F.round("silhouette", 6).alias("silhouette"))


@query
def language_keywords(spark, d):
    docs = table(spark, d, "documents").where("lang is not null")
    return projection.class_keywords(docs, "lang", "text", 5).select("lang", "rank", "term", F.round("score", 6).alias("score"))


# -- answers --------------------------------------------------------------------------------------------------------------------------


@query
def lexical_grounding(spark, d):
    answers = _one(spark, d, "transcripts", "transcript_id").where("text is not null and media_id is not null").select(F.col("transcript_id").alias("turn_id"), "media_id", F.col("text").alias("answer"))
    frames = _one(spark, d, "keyframes", "keyframe_id").where("ocr_text is not null").select("media_id", F.col("frame_index").alias("rank"), F.col("ocr_text").alias("text"))
    passages = answers.select("turn_id", "media_id").join(frames, "media_id").select("turn_id", "rank", "text")
    g = insight.grounding_score(insight.lexical_support(answers.select("turn_id", "answer"), passages))
    return g.select("turn_id", "score", "level")


@query
def gap_ranking(spark, d):
    return insight.ranked_gaps(_gaps(spark, d), 200).select("query", "confidence", "count", "last_seen")


def _gap_events(spark, d):
    return _one(spark, d, "gap_records", "gap_id").select(F.col("query_text").alias("query"), "confidence", F.col("last_seen").alias("ts"), F.col("lang").alias("language"), F.col("hit_count").alias("hits"))


def answers(spark, d, questions=None):
    """The ten best chunks of each question; of all questions, unless some are given."""
    asked = questions if questions is not None else _one(spark, d, "gap_records", "gap_id").select(F.col("gap_id").alias("query_id"), "query_text")
    hits = retrieval.top_k(retrieval.bm25_scores(_chunks(spark, d), asked, "chunk_id", "text").withColumn("raw", F.round("raw", 6)), 10, "raw")
    return hits.select("query_id", F.col("id").alias("chunk_id"), "raw", "rank")


def _gaps(spark, d):
    return insight.gap_table(_gap_events(spark, d), 0.3)


@query
def merged_gaps(spark, d):
    return insight.merged_gaps(materialise(_gaps(spark, d), "gaps")).select("key", "canonical", "count")


@query
def joined_gaps(spark, d):
    return insight.joined_gaps(materialise(_gaps(spark, d), "gaps")).select("key", "confidence", "count", "last_seen")


def _gap_source(spark, d):
    """The gap records as a stream of files, each id once."""
    schema = table(spark, d, "gap_records").schema
    path = f"{d}/gap_records.parquet"
    # a single file is read through its folder, which is what a file stream watches
    src = spark.readStream.schema(schema).option("pathGlobFilter", "gap_records.parquet" if _is_file(spark, path) else "*.parquet").parquet(d if _is_file(spark, path) else path)
    return src.dropDuplicates(["gap_id"]).select(F.col("query_text").alias("query"), "confidence", F.col("last_seen").alias("ts"), F.col("lang").alias("language"), F.col("hit_count").alias("hits"))


@query
def gap_stream(spark, d):
    """The gaps as the stream leaves them: the last update of each wording."""
    from ..streaming.streams import gap_stream as stream
    from ..streaming.streams import run_to_end

    at = f"{shared_dir(spark)}/lexiloom/gap-stream-{uuid.uuid4().hex[:8]}"
    run_to_end(stream(_gap_source(spark, d)), f"{at}/checkpoint", lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{at}/out/b={i}"))
    out = spark.read.parquet(f"{at}/out")
    w = W.partitionBy("key").orderBy(F.desc("batch"), F.desc("count"))
    return out.withColumn("r", F.row_number().over(w)).where("r = 1").select("query", "confidence", "count", "last_seen")


@query
def gap_record(spark, d):
    """The bounded record a stream of unanswered questions leaves: similar wordings joined, the 200 most frequent kept."""
    from ..streaming.streams import gap_radar

    at = f"{shared_dir(spark)}/lexiloom/gap-record-{uuid.uuid4().hex[:8]}"
    return gap_radar(_gap_source(spark, d), f"{at}/record", f"{at}/checkpoint").select("key", "confidence", "count", "last_seen")


def _is_file(spark, path: str) -> bool:
    j = spark._jvm.org.apache.hadoop.fs.Path(path)
    return j.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(j).isFile()


@query
def question_routes(spark, d):
    g = _one(spark, d, "gap_records", "gap_id").where("query_text is not null")
    return agent.routed(g, "gap_id", "query_text").withColumnRenamed("id", "gap_id")


@query
def line_totals(spark, d):
    """The calculator over an expression for every order line."""
    from ..functions.calculator import calc

    e = F.concat(F.col("l_extendedprice").cast("string"), F.lit(" * "), F.col("l_quantity").cast("string"))
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.round(calc(e).cast("double"), 2).alias("total"))


@query
def conversation_window(spark, d):
    t = _one(spark, d, "turn_insights", "turn_id").where("session_id is not null")
    return agent.conversation_window(t, "session_id", ["asked_at", "turn_id"], turns=1).select("session_id", "turn_id")


# -- media ----------------------------------------------------------------------------------------------------------------------------


def _segments(spark, d):
    return _one(spark, d, "transcript_segments", "segment_id").where("media_id is not null")


def _scenes(spark, d):
    k = _one(spark, d, "keyframes", "keyframe_id").where("media_id is not null and ts_sec is not null")
    return k.withColumn("scene_end", F.col("end_sec"))


@query
def silence_turns(spark, d):
    s = _segments(spark, d).where("start_sec is not null and end_sec is not null")
    return media.turns_by_silence(s).select("media_id", "segment_id", "turn_speaker")


@query
def scene_ends(spark, d):
    return media.scene_ends(_scenes(spark, d).drop("scene_end")).select("media_id", "keyframe_id", "scene_end")


@query
def speech_in_scenes(spark, d):
    return media.speech_in_scenes(_segments(spark, d), _scenes(spark, d))


@query
def speech_sections(spark, d):
    return media.speech_sections(_segments(spark, d))


@query
def timeline_sections(spark, d):
    t = media.timeline(_segments(spark, d), _scenes(spark, d))
    return t.select("media_id", "start", "end", "on_screen", "speech")


@query
def media_timeline(spark, d):
    return media.section_passages(media.timeline(_segments(spark, d), _scenes(spark, d)))


@query
def merged_slides(spark, d):
    return media.merge_slides(table(spark, d, "keyframes"))


# -- review -----------------------------------------------------------------------------------------------------------------------------


@query
def page_review(spark, d):
    """Every page of a scan against the next one, as two revisions."""
    c = _one(spark, d, "citations", "citation_id").where("source_name is not null and text is not null")
    w = W.partitionBy("source_name").orderBy("line_no", "citation_id")
    p = c.select(F.col("citation_id").cast("string").alias("pair_id"), "source_name", "text", F.lead("text").over(w).alias("next")).where("next is not null")
    docs = p.select("pair_id", F.lit("before").alias("side"), F.col("source_name").alias("source"), "text").union(p.select("pair_id", F.lit("after"), "source_name", "next"))
    return review.review(docs)


# -- relational base ------------------------------------------------------------------------------------------------------------------------


@query
def pricing_summary(spark, d):
    li = table(spark, d, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(net), 2).alias("net"), F.round(F.sum(net * (1 + F.col("l_tax"))), 2).alias("gross"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count(F.lit(1)).alias("n"))


@query
def customer_orders(spark, d):
    """Customers with the number of their orders; those without any stay, as a left join has them."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    n = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return c.join(n, c.c_custkey == n.o_custkey, "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("spent", F.lit(0.0)).alias("spent"))


@query
def nation_revenue(spark, d):
    li, o, c, n = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query
def event_windows(spark, d):
    from ..streaming.streams import tumbling

    return tumbling(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query
def event_sessions(spark, d):
    from ..streaming.streams import sessions

    return sessions(table(spark, d, "events"))


@query
def event_properties(spark, d):
    e = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("total"), F.count("k").alias("n"))
