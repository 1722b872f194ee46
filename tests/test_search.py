import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import pytext
from lexiloom.functions.pytext import HashingEmbedder
from lexiloom import session
from lexiloom.operators import retrieval, search
from lexiloom.operators.insight import retrieval_confidence
from lexiloom.operators import vectors as ann
from lexiloom.plans import catalogue
from lexiloom.plans.catalogue import QUERIES

SMALL = "/root/testdata/sf0.001"


def texts(spark, seed, n, words):
    rng = np.random.default_rng(seed)
    made = [" ".join(f"w{min(int(w), 90)}" for w in rng.geometric(0.04, int(rng.integers(1, words)))) for _ in range(n)]
    return [(i, t) for i, t in enumerate([*made, made[0], made[1].upper(), None, "", "the", "unheard"])]


@pytest.fixture
def tables(spark):
    return spark.createDataFrame(texts(spark, 1, 150, 40), "id bigint, text string").repartition(5), spark.createDataFrame(texts(spark, 2, 40, 8), "query_id bigint, query_text string")


def rows(df, *cols):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("entries", [100, 2_000_000])
def test_passes_give_the_rows_of_the_joins(spark, tables, monkeypatch, entries):
    monkeypatch.setattr(search, "BLOCK_ENTRIES", entries)
    monkeypatch.setattr(search, "ROWS", 16)
    monkeypatch.setattr(search, "PART_QUERIES", 20)
    docs, asked = tables
    raw = retrieval.bm25_scores(docs, asked, "id", "text").withColumn("score", F.round("raw", 6))
    plain = search.Corpus(docs, "id", "text")
    assert rows(plain.best(asked, 4), "query_id", "id", "score", "rank") == rows(retrieval.top_k(raw, 4), "query_id", "id", "score", "rank")

    lexical = retrieval.normalised(raw, plain.n).select("query_id", "id", F.round("lexical", 6).alias("lexical"))
    near = raw.where("(query_id + id) % 7 = 0").select("query_id", "id", F.lit(0.25).alias("vector")).union(spark.createDataFrame([(1, 10_000, 0.5), (10_000, 1, 0.5)], "a bigint, b bigint, c double"))
    few = plain.lexical_beside(asked, near, 4)
    assert rows(retrieval.fuse(near, few, 4), "query_id", "id", "score", "rank") == rows(retrieval.fuse(near, lexical, 4), "query_id", "id", "score", "rank")

    both = search.Corpus(docs, "id", "text", "stems", 64)
    stems = retrieval.normalised(retrieval.bm25_scores(docs, asked, "id", "text", "stems"), both.n).select("query_id", "id", "lexical")
    e = [retrieval.hashing_embeddings(*x, 64) for x in ((docs, "id", "text"), (asked, "query_id", "query_text"))]
    vectors = ann.knn_exact(*e, 9, 64, skip_self=False).select("query_id", "id", F.col("score").alias("vector"))
    want = retrieval.fuse(vectors, stems, 3)
    assert np.allclose([r[0] for r in both.hybrid(asked, 3, 9).orderBy("query_id", "rank").select("score").collect()], [r[0] for r in want.orderBy("query_id", "rank").select("score").collect()], atol=1e-6)
    assert both.hybrid(asked, 3, 9).select("query_id").distinct().count() == asked.count()


def test_features_are_those_of_the_embedder(spark, tables):
    more = ["Планы компании на квартал", "怎样才能提高每日上限？", "The running refunds of the", "l'appendice étroit"]
    docs = tables[0].union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(more)], "id bigint, text string"))
    got = search.analysed(docs, "id", "text", "stems", 48).join(docs, "id").collect()
    for r, want in zip(got, HashingEmbedder(48).embed([r.text or "" for r in got])):
        v = np.zeros(48)
        v[r.dims] = r.counts
        assert np.allclose(v / (np.linalg.norm(v) or 1), want, atol=1e-6)


def test_a_term_that_weighs_nothing_is_a_hit(spark):
    docs = spark.createDataFrame([(0, "a"), (1, "a b"), (2, "c"), (3, "d")], "id bigint, text string")
    asked = spark.createDataFrame([(0, "a")], "query_id bigint, query_text string")
    assert rows(search.Corpus(docs, "id", "text").best(asked, 4), "id", "score") == [(0, 0.0), (1, 0.0)]


def test_no_records_and_no_queries(spark, tables):
    docs, asked = tables
    assert search.Corpus(docs.limit(0), "id", "text").best(asked, 3).count() == 0
    assert search.Corpus(docs, "id", "text").best(asked.limit(0), 3).count() == 0


LISTED = ["hybrid_topk", "multi_query_merge", "retrieval_passages", "gated_hits", "retrieval_confidence", "retrieval_snippets", "search_tool", "turn_insight", "answer_path"]


@pytest.mark.parametrize("name", LISTED)
def test_no_search_writes_every_pair(spark, monkeypatch, name):
    """The joins, which list each pair of a query and a record that share a term, serve tiny tables with negative floors only."""
    def never(*_, **__):
        raise AssertionError("all pairs are listed")

    monkeypatch.setattr(retrieval, "bm25_scores", never)
    assert QUERIES[name](spark, SMALL).count() >= 0


def questions(spark):
    return {r[0] for r in spark.read.parquet(f"{SMALL}/gap_records.parquet").select("gap_id").distinct().collect()}


def test_answer_path_answers_every_question(spark):
    got = {r[0] for r in QUERIES["answer_path"](spark, SMALL).select("query_id").collect()}
    sure = {r.query_id for r in QUERIES["turn_insight"](spark, SMALL).collect() if not r.gap}
    assert got <= questions(spark) and sure <= got and any(q % 100 for q in got)


def test_turn_insight_has_a_row_for_every_question(spark):
    got = [r[0] for r in QUERIES["turn_insight"](spark, SMALL).select("query_id").collect()]
    assert len(got) == len(set(got)) and set(got) == questions(spark)


def test_search_tool_serves_every_turn(spark):
    got = [r[0] for r in QUERIES["search_tool"](spark, SMALL).select("query_id").collect()]
    assert len(got) == len(set(got)) and sum(q % 100 != 0 for q in got) > 0.5 * len(got) > 10


def test_what_holds_for_a_wording_holds_for_every_id(spark):
    asked = spark.createDataFrame([(7, "a"), (3, "a"), (5, "b")], "query_id bigint, query_text string")
    once = catalogue._once(asked)
    assert rows(once, "query_id", "query_text") == [(3, "a"), (5, "b")]
    assert rows(catalogue._for_every(once.select("query_id", F.lit(1).alias("x")), asked, once), "query_id", "x") == [(3, 1), (5, 1), (7, 1)]


@pytest.mark.parametrize("name", ["retrieval_passages", "gated_hits", "retrieval_confidence", "retrieval_snippets", "search_tool", "turn_insight"])
def test_no_text_goes_on_with_its_hits(spark, monkeypatch, name):
    """Coverage and snippets are computed where the text lies, so that no table has a chunk's text once for each of its hits."""
    seen, real = [], session.materialise

    def watched(df, *more):
        seen.append(df.columns)
        return real(df, *more)

    for module in (catalogue, session):
        monkeypatch.setattr(module, "materialise", watched)
    QUERIES[name](spark, SMALL).count()
    assert seen and not any("text" in columns for columns in seen)


@pytest.mark.parametrize("parts, most", [(1, 500_000), (9, 500_000), (9, 0)])
def test_each_key_once_by_its_least_row(spark, monkeypatch, tmp_path, parts, most):
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", most)
    made = [(i, f"t{i}", None) for i in range(40)] + [(3, "a", "z"), (3, "t3", "y"), (None, "b", None), (None, "a", "x"), (7, None, None), (7, "t7", "c")]
    spark.createDataFrame(made, "id bigint, text string, source string").repartition(parts).write.parquet(str(tmp_path / "t"))
    once = retrieval.each_once(spark.read.parquet(str(tmp_path / "t")), "id")
    want = {i: (i, f"t{i}", None) for i in range(40)} | {3: (3, "a", "z"), None: (None, "a", "x"), 7: (7, None, None)}
    got = [tuple(r) for r in once.collect()]
    assert len(got) == len(want) and {r[0]: r for r in got} == want
    if parts > 4 and most:
        plan = once._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert plan.count("Exchange hashpartitioning") == 1  # of the rows whose key repeats


def test_words_are_the_same_by_the_quick_ways():
    """Latin-1 texts are split as bytes, others without Han and marks by a plainer pattern; both give what the full pattern gives."""
    rng = np.random.default_rng(5)
    letters = "abZ019_ é²½ß'\x1c\t\n-\xa0’०́あ漢кЁñ¿Ⅷ٣ſİ "
    made = ["".join(rng.choice(list(letters[: int(rng.integers(5, len(letters) + 1))]), int(rng.integers(0, 30)))) for _ in range(3000)]
    for t in [*made, "L'été, der Maß_stab 2½", "naïve\u0301 text", "Планы 2-го"]:
        want = []
        for x in pytext._TOKEN.findall(t.lower()):
            want += [x[i : i + 2] for i in range(len(x) - 1)] if len(x) > 1 and pytext.is_cjk(x) else [x]
        assert pytext.tokens(t) == want
        words = pytext._latin_words(t.lower(), pytext._LATIN_LETTERS)
        assert words is None or words == re.findall(r"[^\W\d_]+", t.lower())


def test_a_vector_is_one_value_of_bytes(spark, tables):
    """No list of positions and counts is written for each record, but a byte for each of its numbers, or four where one is large."""
    assert search.Corpus(tables[0], "id", "text", "stems", 48).rows.columns == ["id", "terms", "tf", "dl", "vector"]
    v = np.array([[0, -3, 127], [1, 70_000, -2], [-128, 0, 0], [0, 0, 0]], float)
    packed = search._packed(v)
    assert [len(x) for x in packed.to_pylist()] == [3, 12, 12, 3]
    assert (search._unpacked(packed, 3) == v).all() and (search._unpacked(packed.slice(2), 3) == v[2:]).all() and (search._unpacked(packed.slice(3), 3) == 0).all()
    docs = spark.createDataFrame([(0, "refund " * 300), (1, "refund limit")], "id bigint, text string")
    asked = spark.createDataFrame([(0, "refund limit")], "query_id bigint, query_text string")
    assert rows(search.Corpus(docs, "id", "text", "stems", 64).hybrid(asked, 2, 2), "id")


def test_many_queries_meet_all_rows_in_one_task_each(spark, tables, monkeypatch):
    """Then no task's losers are shuffled; ranks and scores are those of the tasks that share their queries."""
    docs, asked = tables
    corpus = search.Corpus(docs, "id", "text", "stems", 64)
    cols = ("query_id", "rank", "id", "score", "vector_score", "lexical_score")
    want = rows(corpus.hybrid(asked, 3, 9), *cols)
    sent, real = [], search._pass

    def watched(*a, **kw):
        out = real(*a, **kw)
        sent.append((out.count(), out.rdd.getNumPartitions()))
        return out

    monkeypatch.setattr(search, "_pass", watched)
    corpus.hybrid(asked, 3, 9)
    monkeypatch.setattr(search, "WHOLE_QUERIES", 1)
    assert rows(corpus.hybrid(asked, 3, 9), *cols) == want
    (shared, _), (whole, tasks) = sent
    assert tasks >= spark.sparkContext.defaultParallelism and len(want) <= whole < 0.5 * shared
    assert corpus.hybrid(asked.limit(0), 3, 9).count() == 0


@pytest.mark.parametrize("name", ["retrieval_confidence", "retrieval_snippets", "search_tool"])
def test_no_query_writes_lists_of_positions(spark, monkeypatch, name):
    """A record's vector is one value in the table each record is analysed into."""
    seen = {}
    monkeypatch.setattr(search, "materialise", lambda df, made: seen.update({made: df.columns}) or session.materialise(df, made))
    QUERIES[name](spark, SMALL).count()
    assert seen["analysed"] == ["id", "terms", "tf", "dl", "vector"]


def test_search_tool_keeps_no_analysed_texts_and_shuffles_none(spark, monkeypatch):
    """The analysed chunks are gone once their hits are found; parts of the hits are sent to the texts, and many more than that are shuffled with the same rows."""
    want, plans, real = rows(QUERIES["search_tool"](spark, SMALL), "query_id", "passages"), [], session.materialise
    folder = Path(session.shared_dir(spark).removeprefix("file://"), "lexiloom")

    def watched(df, name, *more):
        out = real(df, name, *more)
        if name == "tool-snippets":
            assert {x.name for x in folder.iterdir() if x.name.startswith(("analysed-", "asked-", "idf-"))} <= before
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(session, "materialise", watched)
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 10)
    conf = "spark.sql.autoBroadcastJoinThreshold"
    kept = spark.conf.get(conf)
    spark.conf.set(conf, "-1")
    try:
        for at_once in (20, 1):
            before = {x.name for x in folder.iterdir()}
            monkeypatch.setattr(retrieval, "PASS_ROWS", at_once, raising=False)
            monkeypatch.setattr(retrieval, "PASSES", 1_000 if at_once > 1 else 1, raising=False)
            plans.clear()
            assert rows(QUERIES["search_tool"](spark, SMALL), "query_id", "passages") == want
            joined = ["SortMergeJoin [id" in p for p in plans]
            assert len(plans) > 1 and not any(joined) if at_once > 1 else joined == [True]
    finally:
        spark.conf.set(conf, kept)


@pytest.mark.parametrize("k, threshold", [(3, 0.3), (1, 0.0), (9, 0.9)])
def test_gated_passages_are_those_of_the_steps(spark, k, threshold):
    """Gate, distinct snippets and blocks in one shuffle of snippets, and no Python call for each query."""
    rng = np.random.default_rng(3)
    words = ["Refunds take days", "refunds  TAKE days", "take", "", "Limits", "l'été"]
    made = [(q, r, q * 10 + r, [None, "a.md", ""][int(rng.integers(3))], words[int(rng.integers(6))], float(rng.random()), [None, 0.4, 1.5][int(rng.integers(3))]) for q in range(30) for r in range(1, 1 + int(rng.integers(1, 6)))]
    hits = spark.createDataFrame(made, "query_id bigint, rank int, id bigint, source string, snippet string, coverage double, vector_score double").repartition(5)
    want = retrieval.formatted_hits(retrieval.distinct_snippets(retrieval.confidence_gate(hits, retrieval_confidence(hits), threshold), limit=300, k=k))
    got = retrieval.gated_passages(hits, k, threshold)
    assert rows(got, "query_id", "passages") == rows(want, "query_id", "passages")
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "FlatMapGroups" not in plan and plan.count("Exchange hashpartitioning") == 1
