import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import agent, folds, insight, media, projection, retrieval, review
from lexiloom.operators import vectors as ann


def frame(spark, x, start=0, names="id bigint, v array<float>"):
    return spark.createDataFrame([(start + i, [float(a) for a in r]) for i, r in enumerate(x)], names)


def exact_ids(x, q, k):
    x, q = (a / np.linalg.norm(a, axis=1, keepdims=True) for a in (x, q))
    return np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :k]


# -- vectors ----------------------------------------------------------------------------------------------------------------


def test_exact_search(spark):
    x = np.random.default_rng(0).normal(size=(50, 8))
    hit = ann.knn_exact(frame(spark, x), frame(spark, x[7:8], 900, "query_id bigint, v array<float>"), 3, 8, skip_self=False).orderBy("rank").collect()
    assert hit[0].id == 7 and abs(hit[0].score - 1) < 1e-6 and [r.rank for r in hit] == [1, 2, 3]


def test_search_borders(spark):
    bad = spark.createDataFrame([(-3, [1.0, 0.0]), (2, [float("nan"), 1.0]), (3, [1.0]), (4, None), (5, [1.0, 0.0]), (6, [0.0, 0.0])], "id bigint, v array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, v array<float>")
    got = [(r.id, round(r.score, 6)) for r in ann.knn_exact(bad, q, 10, 2).orderBy("rank").collect()]
    assert got == [(-3, 1.0), (5, 1.0), (6, 0.0)]
    assert ann.knn_exact(bad, q, 0, 2).count() == 0
    assert ann.knn_exact(bad.limit(0), q, 5, 2).count() == 0


def test_eight_bit_codes_recover_the_exact_result(spark):
    rng = np.random.default_rng(7)
    x, q = rng.normal(size=(600, 32)), rng.normal(size=(12, 32))
    got = ann.knn_sq8(ann.sq8_encode(frame(spark, x, 100), 32), frame(spark, q, 0, "query_id bigint, v array<float>"), 10, 32, skip_self=False).toPandas()
    want = exact_ids(x, q, 10) + 100
    assert sum(len(set(g.id) & set(want[i])) for i, g in got.groupby("query_id")) >= 116
    assert ann.storage_bytes(600, 32, "sq8") == 600 * (32 + 8 + 4)


def test_product_codes(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 16))
    x[0] = 0
    v = frame(spark, x)
    books = ann.pq_train(v, 16, subspaces=8, clusters=64)
    assert np.array_equal(books, ann.pq_train(v, 16, subspaces=8, clusters=64))
    codes = ann.pq_encode(v, books, 16)
    q = frame(spark, x[1:2], 900, "query_id bigint, v array<float>")
    got = ann.knn_pq(codes, q, books, 200, 16, skip_self=False).orderBy("rank").collect()
    assert got[0].id == 1 and [r.score for r in got if r.id == 0] == [0.0]
    again = ann.rerank(ann.knn_pq(codes, q, books, 40, 16, False), v, q, 5).orderBy("rank").collect()
    assert [r.id for r in again][:1] == [1] and abs(again[0].score - 1) < 1e-6


@pytest.mark.parametrize(("n", "dim", "least"), [(800, 32, 0.8), (1200, 32, 0.95)])
def test_graph_recall(spark, n, dim, least):
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(n, dim)), rng.normal(size=(20, dim))
    index = ann.graph_index(frame(spark, x), dim, m=16, build=100, rows_each=n)
    got = ann.knn_graph(index, frame(spark, q, 0, "query_id bigint, v array<float>"), 10, dim, beam=90, skip_self=False).toPandas()
    want = exact_ids(x, q, 10)
    assert np.mean([len(set(g.id) & set(want[i])) / 10 for i, g in got.groupby("query_id")]) >= least


def test_a_graph_has_levels_and_takes_any_ids(spark):
    x = np.random.default_rng(4).normal(size=(600, 8))
    x[5] = 0
    v = frame(spark, x, -300)
    index = ann.graph_index(v, 8, m=4, build=30, rows_each=300)
    assert index.select(F.max(F.size("links"))).first()[0] >= 3 and index.select("part").distinct().count() > 1 and index.count() == 600
    q = frame(spark, x[:3], 900, "query_id bigint, v array<float>")
    assert ann.knn_graph(index, q, 0, 8).count() == 0
    got = ann.knn_graph(index, q, 40, 8, beam=1, skip_self=False)  # a beam below k counts as k
    assert {r.query_id: r.id for r in got.where("rank = 1").collect()} == {900: -300, 901: -299, 902: -298} and got.count() == 120


def test_more_queries_than_a_block(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(90, 8))
    v, q = frame(spark, x), frame(spark, x, 0, "query_id bigint, v array<float>")
    c = ann.cell_centres(v, 8, 4)
    index, layout = ann.graph_index(v, 8, rows_each=50), ann.cell_layout(v, c, 8)
    ask = lambda: [sorted(map(tuple, d.select("query_id", "id", "rank").collect())) for d in (ann.knn_exact(v, q, 5, 8), ann.knn_graph(index, q, 5, 8), ann.knn_cells(layout, q, c, 5, 8, 2))]
    one = ask()
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    assert ask() == one and len(one[0]) == 450


def test_cells_with_every_cell_are_exact(spark):
    rng = np.random.default_rng(5)
    x, q = rng.normal(size=(300, 16)), rng.normal(size=(5, 16))
    v, qs = frame(spark, x), frame(spark, q, 0, "query_id bigint, v array<float>")
    c = ann.cell_centres(v, 16, 8)
    layout = ann.cell_layout(v, c, 16)
    every = {(r.query_id, r.id) for r in ann.knn_cells(layout, qs, c, 5, 16, 8, False).collect()}
    assert every == {(i, int(j)) for i, js in enumerate(exact_ids(x, q, 5)) for j in js}
    assert ann.knn_cells(layout, qs, c, 5, 16, 2, False).count() <= 25
    plan = ann.knn_cells(layout, qs.limit(1), c, 5, 16, 1, False)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "cell#" in plan.split("PartitionFilters: [")[1][:60]


# -- retrieval ----------------------------------------------------------------------------------------------------------------


def corpus(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")


def ask(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id bigint, query_text string")


def test_bm25_finds_inflections(spark):
    docs = corpus(spark, ["Планы компании на следующий квартал", "Рецепт пирога с яблоками", "Other words", None, ""])
    s = retrieval.top_k(retrieval.bm25_scores(docs, ask(spark, ["Что в следующем квартале?", "zzz"]), "id", "text", "stems"), 5, "raw").collect()
    assert [(r.query_id, r.id) for r in s] == [(0, 0)]


def test_bm25_by_hand(spark):
    docs, q = ["a1 b1 c1", "a1 a1 d1", "e1 f1", "g1"], "a1 a1 e1"
    toks = [d.split() for d in docs]
    n, avg = len(docs), sum(map(len, toks)) / len(docs)
    df = {t: sum(t in d for d in toks) for d in toks for t in d}
    raw = {t: np.log(n - c + 0.5) - np.log(c + 0.5) for t, c in df.items()}
    idf = {t: v if v >= 0 else 0.25 * np.mean(list(raw.values())) for t, v in raw.items()}
    want = {i: sum(idf[t] * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in q.split()) for i, d in enumerate(toks)}
    got = {r.id: r.raw for r in retrieval.bm25_scores(corpus(spark, docs), ask(spark, [q]), "id", "text").collect()}
    assert got.keys() == {0, 1, 2} and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_one_document_keeps_the_sign_of_its_score(spark):
    docs = corpus(spark, ["alpha beta"])
    s = retrieval.normalised(retrieval.bm25_scores(docs, ask(spark, ["alpha"]), "id", "text"), 1).collect()
    assert s[0].raw < 0 and s[0].lexical == 1.0


def test_fusion_merging_and_gates(spark):
    v = spark.createDataFrame([(1, 10, 0.9), (1, 11, -0.2)], "query_id bigint, id bigint, vector double")
    lex = spark.createDataFrame([(1, 11, 1.0), (1, 12, 0.5)], "query_id bigint, id bigint, lexical double")
    f = [(r.id, round(r.score, 4)) for r in retrieval.fuse(v, lex, 3).orderBy("rank").collect()]
    assert f == [(10, 0.585), (11, 0.22), (12, 0.175)]
    hits = spark.createDataFrame([(1, 5, 1.0, 1), (1, 6, 0.4, 2), (2, 5, 0.7, 1), (2, 7, 0.7, 2)], "query_id bigint, id bigint, score double, rank int")
    g = spark.createDataFrame([(1, 0), (2, 0)], "query_id bigint, group_id bigint")
    assert [(r.id, r.score) for r in retrieval.merge_queries(hits, g, 2).orderBy("rank").collect()] == [(5, 1.0), (7, 0.7)]
    assert retrieval.relative_cut(hits, 0.5).count() == 3
    conf = spark.createDataFrame([(1, 0.29), (2, 0.3)], "query_id bigint, confidence double")
    assert {r.query_id for r in retrieval.confidence_gate(hits, conf).collect()} == {2}


def test_empty_corpus_and_empty_queries(spark):
    docs, q = corpus(spark, ["a b"]), ask(spark, ["a"])
    assert retrieval.bm25_scores(docs.limit(0), q, "id", "text").count() == 0
    assert retrieval.bm25_scores(docs, q.limit(0), "id", "text").count() == 0


# -- projection -----------------------------------------------------------------------------------------------------------------


def blobs():
    rng = np.random.default_rng(1)
    c = np.array([[0, 0, 0], [6, 6, 0], [0, 6, 6]])
    return np.concatenate([rng.normal(m, 0.4, (30, 3)) for m in c]), np.repeat([0, 1, 2], 30)


def test_map_fills_the_unit_box_and_ignores_row_order(spark):
    x, _ = blobs()
    a = projection.pca_map(frame(spark, x), 3).orderBy("id").collect()
    assert max(max(abs(r.x), abs(r.y)) for r in a) == 1.0
    b = projection.pca_map(frame(spark, x).orderBy(F.desc("id")), 3).orderBy("id").collect()
    assert a == b


def test_clusters_and_silhouettes(spark):
    x, truth = blobs()
    labels, _, s = projection.auto_kmeans(x)
    assert len(set(labels)) == 3 and s > 0.7 and all(len(set(labels[truth == t])) == 1 for t in range(3))
    assert projection.silhouette(x, np.random.default_rng(0).permutation(truth)) < 0.1
    assert projection.auto_kmeans(x[:3])[2] == 0.0
    df = spark.createDataFrame([(i, [float(a) for a in r], int(t)) for i, (r, t) in enumerate(zip(x, truth))], "id bigint, v array<float>, label int")
    assert abs(projection.silhouette_of(df, block=20).first()[0] - projection.silhouette(x, truth)) < 1e-6


def test_topics(spark):
    rows = [(0, "refund money back refund company"), (0, "refund of money company"), (1, "uptime sla monitoring company"), (1, "sla uptime guarantee company"), (2, "退款政策 退款 company")]
    k = {}
    for r in projection.class_keywords(spark.createDataFrame(rows, "label int, text string"), "label", "text", 3).orderBy("label", "rank").collect():
        k.setdefault(r.label, []).append(r.term)
    assert k[0][:2] == ["refund", "money"] and set(k[1][:2]) == {"sla", "uptime"} and "company" not in k[0][:2]
    assert not set(k[2][0]) & set("".join(t for t in k[2][1:] if t != "company"))


# -- insight -----------------------------------------------------------------------------------------------------------------------


def test_grounding(spark):
    rows = [
        (1, "The refund takes fourteen days. Unicorns dance on purple mountains.", ["Our refund takes fourteen days after payment."], ["handbook.md"]), (2, "Anything at all here.", [], []),
        (3, "This information is from Harbour Works.", ["Something else."], ["Harbour Works demo knowledge base (EN)"]), (4, None, ["x"], ["y"]),
    ]
    s = insight.assess_grounding(spark.createDataFrame(rows, "turn_id bigint, answer string, passages array<string>, sources array<string>"))
    got = {(r.turn_id, r.start): r for r in s.collect()}
    first, second = got[1, 0], got[1, 32]
    assert first.support > 0.6 and first.source_rank == 1 and second.support < 0.35
    assert got[3, 0].citation and {t for t, _ in got} == {1, 3}
    level = {r.turn_id: r.level for r in insight.grounding_reports(s).collect()}
    assert level[3] == "high" and level[1] in ("medium", "low")


def test_gaps(spark):
    e = spark.createDataFrame([("How do refunds work?", 0.1, 1, "en", 1), ("how do REFUNDS work?", 0.2, 2, "en", 2), ("Fine question", 0.9, 3, "en", 1), (None, 0.1, 4, "en", 1), ("  ", 0.1, 4, "en", 1), ("Unknown", None, 4, "en", 1), ("How do refunds actually work?", 0.05, 5, "en", 1)],
                              "query string, confidence double, t bigint, language string, hits int").withColumn("ts", F.timestamp_seconds("t"))
    g = insight.gap_table(e)
    got = {r.query: (r.confidence, r["count"]) for r in g.collect()}
    assert got == {"How do refunds work?": (0.1, 3), "How do refunds actually work?": (0.05, 1)}
    m = {r.key: r.canonical for r in insight.merged_gaps(g).collect()}
    assert m["how do refunds actually work?"] == "how do refunds work?"
    assert [r["count"] for r in insight.ranked_gaps(g, 1).collect()] == [3]


# -- media ---------------------------------------------------------------------------------------------------------------------------


def segments(spark, spans, media_id="m"):
    return spark.createDataFrame([(media_id, i, float(a), float(b), f"t{i}") for i, (a, b) in enumerate(spans)], "media_id string, segment_id bigint, start_sec double, end_sec double, text string")


@pytest.mark.parametrize(("spans", "speakers", "want"), [([(0, 1), (1.2, 2), (2.3, 3)], 2, [0, 0, 0]), ([(0, 1), (3, 4), (6, 7)], 2, [0, 1, 0]), ([(0, 1), (3, 4), (6, 7), (9, 10)], 3, [0, 1, 2, 0])])
def test_turns_by_silence(spark, spans, speakers, want):
    assert [r.turn_speaker for r in media.turns_by_silence(segments(spark, spans), speakers=speakers).orderBy("segment_id").collect()] == want


def test_timeline(spark):
    scenes = spark.createDataFrame([("m", 1, 0.0, 10.0, "Title"), ("m", 2, 10.0, 20.0, "Second"), ("n", 3, 0.0, 140.0, "")], "media_id string, keyframe_id bigint, ts_sec double, scene_end double, ocr_text string")
    seg = segments(spark, [(1, 3), (12, 14)]).union(segments(spark, [(t, t + 20) for t in range(0, 121, 30)], "n").withColumn("segment_id", F.col("segment_id") + 10))
    t = media.section_passages(media.timeline(seg, scenes)).orderBy("media_id", "start").collect()
    assert [(r.media_id, r.start, r.on_screen, r.speech) for r in t] == [("m", 0.0, "Title", "t0"), ("m", 10.0, "Second", "t1"), ("n", 0.0, "", "t0 t1"), ("n", 60.0, "", "t2 t3"), ("n", 120.0, "", "t4")]
    assert t[0].passage == "[00:00–00:10]\nOn screen: Title\nSpeech: t0"


def test_folds_are_stitched_over_partitions(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = []
    for m, n in (("hot", 900), ("a", 30), ("b", 1)):
        at = np.cumsum(rng.uniform(0, 9, n))
        rows += [(m, i, float(s), float(s + rng.uniform(0, 70)), f"t{i}") for i, s in enumerate(at)]
    df = spark.createDataFrame(rows, "media_id string, segment_id bigint, start_sec double, end_sec double, text string")
    want = {}
    for m, i, s, e, _ in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if m not in want:
            want[m] = [(i, 0)]
            first, k = s, 0
        else:
            if e - first > 60:
                first, k = s, k + 1
            want[m].append((i, k))
    monkeypatch.setattr(folds, "ROWS_EACH", 40)
    got = {(r.media_id, r.segment_id, r.section) for r in media.speech_sections(df).collect()}
    assert got == {(m, i, k) for m, v in want.items() for i, k in v}
    slides = [("hot", i, float(i), "x" * (40 + i // 100 % 3) + f" {i // 130}" + "\n- more" * (i % 130 > 60)) for i in range(900)]
    cut = media.merge_slides(spark.createDataFrame(slides, "media_id string, keyframe_id bigint, ts_sec double, ocr_text string"))
    monkeypatch.setattr(folds, "ROWS_EACH", 10**9)
    whole = media.merge_slides(spark.createDataFrame(slides, "media_id string, keyframe_id bigint, ts_sec double, ocr_text string").coalesce(1))
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect())) and 5 < cut.count() < 60


def test_slides_and_scenes(spark):
    rows = [("m", 1, 0.0, "Plan\n- one"), ("m", 2, 1.0, "Plan\n- one\n- two"), ("m", 3, 2.0, "Section 1"), ("m", 4, 3.0, "Section 2"), ("m", 5, 4.0, None)]
    got = media.merge_slides(spark.createDataFrame(rows, "media_id string, keyframe_id bigint, ts_sec double, ocr_text string")).orderBy("ts_sec").collect()
    assert [(r.keyframe_id, r.ocr_text) for r in got] == [(1, "Plan\n- one\n- two"), (3, "Section 1"), (4, "Section 2"), (5, "")]
    k = spark.createDataFrame([("m", 1, 0.0), ("m", 2, 5.0)], "media_id string, keyframe_id bigint, ts_sec double")
    d = spark.createDataFrame([("m", 9.0)], "media_id string, duration double")
    assert [r.scene_end for r in media.scene_ends(k, d).orderBy("ts_sec").collect()] == [5.0, 9.0]
    w = spark.createDataFrame([(1, 1, 1, 1, 2, "world", 90.0), (1, 1, 1, 1, 1, "hello", 80.0), (1, 1, 1, 1, 3, " ", 50.0), (1, 1, 1, 2, 1, "x", -1.0)], "page int, block int, par int, line int, pos int, word string, conf double")
    assert [(r.text, r.confidence) for r in media.recognised_lines(w).collect()] == [("hello world", 85.0)]


# -- review ------------------------------------------------------------------------------------------------------------------------------


def documents(spark, before, after):
    return review.citations(spark.createDataFrame([("p", "before", "a.md", before), ("p", "after", "b.md", after)], "pair_id string, side string, source string, text string"))


def test_review_of_two_revisions(spark):
    before = "# Storage\nREQ-1: Logs must be kept for 30 days.\nREQ-2: The door shall close when the alarm rings.\nBackups run every night.\nThe old fax line stays open.\nSame line.\nSame line."
    after = "# Storage\nBackups run every night.\nREQ-1: Logs must be kept for 20 days.\nREQ-2: The door may close.\nA new kiosk greets visitors in the hall.\nSame line."
    got = {(r.kind, r.before_line, r.after_line): r.signals for r in review.compare(documents(spark, before, after)).collect()}
    assert got == {("changed", 2, 3): ["number or unit"], ("changed", 3, 4): ["obligation", "condition or exception"], ("removed", 5, None): [], ("removed", 7, None): [], ("added", None, 5): []}


def test_near_rivals_are_ambiguous(spark):
    got = review.compare(documents(spark, "The pump starts in manual mode.", "The pump starts in manual mode slowly.\nThe pump starts in manual mode quickly.")).collect()
    assert [(r.kind, r.before_line, len(r.alternatives)) for r in got] == [("ambiguous", 1, 1)]


def test_documents_over_a_limit_are_rejected_with_a_reason(spark):
    rows = [("p", "before", "a", "x\n" * 251), ("p", "after", "b", "x"), ("q", "before", "a", "# h\n" * 300 + "x\n" * 250), ("q", "after", "b", "é" * 70_000), ("r", "before", "a", "One line.\n" * 250), ("r", "after", "b", "One line.\n" * 249), ("s", "before", "a", None), ("s", "after", "b", "")]
    docs = spark.createDataFrame(rows, "pair_id string, side string, source string, text string")
    assert {(r.pair_id, r.side) for r in review.rejected(docs).collect()} == {("p", "before"), ("q", "after")}
    got = sorted((r.pair_id, r.kind, tuple(r.signals)) for r in review.review(docs).collect())
    assert got == [("p", "rejected", ("Each document must have at most 250 non-heading lines.",)), ("q", "rejected", ("Each document must be at most 128 KiB.",)), ("r", "removed", ())]


def test_sections_help_where_lines_are_similar_by_themselves(spark):
    class Pointing:
        """An embedder that knows two directions and a third between them."""

        def embed(self, texts):
            way = {"a": (1.0, 0.0), "b": (0.6, 0.8)}
            return np.array([(1.0, 0.05) if "\n" in t else way.get(t.split()[0], (0.0, 1.0)) for t in texts])

    lines = documents(spark, "# Head\na one two", "# Head\nb three four")
    plain = documents(spark, "a one two", "b three four")
    assert {r.kind for r in review.compare(lines, Pointing()).collect()} == {"changed"}  # 0.45 * 0.6 + 0.3 * 1.0
    assert {r.kind for r in review.compare(plain, Pointing()).collect()} == {"removed", "added"}
    assert {r.kind for r in review.compare(lines).collect()} == {"removed", "added"}  # hashing takes no part in it


def test_states_of_a_review(spark):
    f = spark.createDataFrame([("r", 0), ("r", 1), ("d", 0)], "review_id string, finding_ix int")
    asked = spark.createDataFrame([("r", 0, "accepted"), ("r", 7, "accepted"), ("x", 0, "accepted"), ("r", 1, "maybe"), ("d", 0, "rejected")], "review_id string, finding_ix int, decision string")
    got = {(r.review_id, r.finding_ix): r.status for r in review.decision_status(asked, f, spark.createDataFrame([("d",)], "review_id string")).collect()}
    assert got == {("r", 0): 200, ("r", 7): 404, ("x", 0): 404, ("r", 1): 422, ("d", 0): 409}
    decided = spark.createDataFrame([("r", "pending"), ("d", "accepted")], "review_id string, decision string")
    assert {r.review_id: r.status for r in review.publish_status(spark.createDataFrame([("r",), ("d",), ("x",)], "review_id string"), decided).collect()} == {"r": 409, "d": 200, "x": 404}


def test_review_lifecycle(spark):
    f = spark.createDataFrame([("r", 0, "changed", "a", "b"), ("r", 1, "removed", "c", None)], "review_id string, finding_ix int, kind string, before_text string, after_text string")
    log = [("r", 1, 0, "rejected"), ("r", 2, 0, "accepted")]
    d = review.latest_decisions(f, spark.createDataFrame(log, "review_id string, seq bigint, finding_ix int, decision string"))
    assert review.publishable(d).first()["ready"] is False and review.reports(d).count() == 0
    d = review.latest_decisions(f, spark.createDataFrame([*log, ("r", 3, 1, "rejected")], "review_id string, seq bigint, finding_ix int, decision string"))
    assert review.reports(d).first()["report"] == "- **changed**: a → b"


# -- agent -------------------------------------------------------------------------------------------------------------------------------


def test_routes(spark):
    t = ["What is (12 + 8) * 3?", "15% of 200", "What is the refund policy?", "hello there", None]
    got = [(r.route, r.answer) for r in agent.routed(spark.createDataFrame(list(enumerate(t)), "i bigint, t string"), "i", "t").orderBy("id").collect()]
    assert got == [("calculator", "60"), ("calculator", "30"), ("search_knowledge_base", None), ("echo", "(offline demo mode) You said: hello there"), (None, None)]


def test_react_loop_and_revisions(spark):
    def model(messages):
        last = messages[-1][1]
        return f"Final Answer: {last[13:]}" if last.startswith("Observation:") else 'Thought: x\nAction: add\nAction Input: {"a": 1, "b": 2}'

    def add(a, b):
        return a + b

    got = agent.react(spark.createDataFrame([(1, "q")], "turn_id bigint, question string"), model, {"add": add}).first()
    assert (got.answer, got.steps) == ("3", 2)
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y")], "run_id string, revision bigint, s string")
    assert [r.s for r in agent.latest_revision(log).collect()] == ["y"]
    m = spark.createDataFrame([("c", i) for i in range(30)], "c string, turn bigint")
    assert agent.conversation_window(m, "c", ["turn"], 12).agg(F.min("turn")).first()[0] == 6
