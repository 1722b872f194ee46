import pytest
from pyspark.sql import functions as F

from lexiloom import session
from lexiloom.functions.register import register
from lexiloom.operators import agent, insight, projection, review
from lexiloom.operators import vectors as ann
from lexiloom.sources import files


def test_functions_by_name(spark):
    register(spark)
    r = spark.sql("SELECT calc('2 ** 5') AS a, query_coverage('refund', 'refunds') AS b, clean_ocr('» x1') AS c, index_terms('refunds') AS d").first()
    assert (r.a, r.b, r.c, r.d) == ("32", 1.0, "x1", ["refund"])
    got = spark.sql("SELECT s.* FROM VALUES ('a b c d') AS t(x), LATERAL split_text(t.x, 4, 1) AS s").collect()
    assert [x.text for x in got] == ["a b", "b c", "c d"]


def test_argument_errors(spark):
    check = agent.argument_errors({"properties": {"n": {"type": "integer"}, "q": {"type": "string"}}, "required": ["q"]})
    rows = ['{"q": "x", "n": 1}', '{"n": 1}', '{"q": "x", "n": true}', '{"q": 1}', "no", "[]", None]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(rows)), "i int, t string").orderBy("i").select(check("t")).collect()]
    assert got[0] is None and all(got[1:])


def test_revisions_follow_one_another(spark):
    log = spark.createDataFrame([("a", 1), ("a", 2)], "run_id string, revision bigint")
    new = spark.createDataFrame([("a", 2), ("a", 3), ("b", 1), ("b", 2)], "run_id string, revision bigint")
    assert sorted(map(tuple, agent.checked_append(log, new).collect())) == [("a", 3), ("b", 1)]


def test_turn_insight_and_gap_upkeep(spark):
    q = spark.createDataFrame([(1, "How long does the refund take?"), (2, "Where is the zebra crossing manual?"), (3, None)], "query_id bigint, query_text string")
    h = spark.createDataFrame([(1, 1, 5, "a.md", 1.0, 0.9, "The refund takes long.", "How long does the refund take?"), (1, 2, 6, "b.md", 0.01, 0.0, "x", "How long does the refund take?"), (2, 1, 7, "c.md", 1.0, 0.1, "y", "Where is the zebra crossing manual?")],
                              "query_id bigint, rank int, id bigint, source string, score double, vector_score double, text string, query_text string")
    got = {r.query_id: (r.gap, r.sources) for r in insight.turn_insight(q, h).collect()}
    assert got == {1: (False, ["a.md"]), 2: (True, []), 3: (True, [])}
    g = spark.createDataFrame([("a", 1), ("b", 3)], "query string, count bigint").withColumn("last_seen", F.timestamp_seconds(F.lit(1)))
    assert [r.query for r in insight.keep_most(g, 1).collect()] == ["b"]
    assert [r.query for r in insight.resolve(g, spark.createDataFrame([("b",)], "query string")).collect()] == ["a"]


def test_graph_table_and_projection(spark):
    import numpy as np

    x = np.random.default_rng(2).normal(size=(120, 8))
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id bigint, v array<float>")
    index = ann.graph_index(v, 8, m=4, build=20)
    assert ann.graph_edges(index).count() > 120 and ann.graph_faults(index, 4).count() == 0
    bad = index.withColumn("links", F.when(F.col("id") == 1, F.array(F.array(F.lit(999), F.lit(1)).cast("array<bigint>"))).when(F.col("id") == 2, F.array(F.sequence(F.lit(3), F.lit(20)).cast("array<bigint>"))).otherwise(F.col("links")))
    assert {r.fault for r in ann.graph_faults(bad, 4).collect()} == {"dangling", "self", "degree"}
    mean, cov, _ = projection.covariance(v.select("v"), 8)
    comp, share = projection.principal_plane(mean, cov)
    p = projection.project(v, mean, comp, 1.0).orderBy("id").collect()
    assert abs(p[0].x - float((x[0].astype(np.float32) - mean) @ comp[0])) < 1e-6 and 0 < share[1] <= share[0] < 1


def test_pdf_pages_by_any_parser(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one\ntwo\x0c\x0c")
    (tmp_path / "b.pdf").write_bytes(b"!")

    def parser(content):
        if content == b"!":
            raise ValueError
        return content.decode().split("\x0c")[:2]

    got = [(r.page, r.line, r.text, r.warning) for r in files.pdf_documents(spark, str(tmp_path), parser).orderBy("source", "page", "line").collect()]
    assert got == [(1, 1, "one", None), (1, 2, "two", None), (2, None, None, "page without text"), (None, None, None, "unreadable: ValueError")]


def test_a_cluster_must_name_its_shared_folder():
    class Fake:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = type("S", (), {"master": "yarn"})

    with pytest.raises(RuntimeError):
        session.shared_dir(Fake)


def test_greedy_baseline_and_its_quality(spark):
    s = spark.createDataFrame([("p", 1, 1, 0.9), ("p", 1, 2, 0.8), ("p", 2, 1, 0.85), ("p", 2, 2, 0.6), ("p", 3, 3, 0.4), ("p", 4, 4, None)], "pair_id string, before_line int, after_line int, score double")
    got = review.greedy_matches(s)
    assert sorted((r.before_line, r.after_line) for r in got.collect()) == [(1, 1), (2, 2)]
    want = spark.createDataFrame([("p", 1, 1), ("p", 3, 3)], "pair_id string, before_line int, after_line int")
    q = review.match_quality(got, want, ["pair_id", "before_line", "after_line"]).first()
    assert (q.correct, q.extra, q.missed, q.precision, q.recall) == (1, 1, 1, 0.5, 0.5)


def test_scratch_tables_go_with_their_block(spark):
    import os

    from lexiloom import session

    outer = session.materialise(spark.range(3), "outer")
    with session.scratch():
        inner = session.materialise(spark.range(4), "inner").inputFiles()[0]
        assert os.path.exists(inner.removeprefix("file://"))
    assert not os.path.exists(inner.removeprefix("file://")) and outer.count() == 3
    by = session.materialise(spark.range(6).selectExpr("id", "cast(id % 2 as int) as k"), "by", by="k")
    assert by.columns == ["id", "k"] and by.where("k = 1").count() == 3
