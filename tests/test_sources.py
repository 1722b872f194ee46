import zipfile

import pytest
from pyspark.sql import functions as F

from lexiloom.functions.pytext import HashingEmbedder
from lexiloom.operators import insight
from lexiloom.sources import files
from lexiloom.streaming import streams


def test_text_files_and_uploads(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_bytes("﻿Hallo".encode())
    (tmp_path / "sub" / "b.txt").write_bytes(b"ok \xff end")
    (tmp_path / "c.bin").write_bytes(b"x")
    got = {r.source.rsplit("/", 1)[1]: r.text for r in files.text_files(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "Hallo", "b.txt": "ok  end"}
    ok, bad = files.uploads(spark, str(tmp_path), most=6)
    assert {r.source.rsplit("/", 1)[1] for r in ok.collect()} == {"c.bin"}
    assert {(r.source.rsplit("/", 1)[1], r.reason) for r in bad.collect()} == {("a.md", "too large"), ("b.txt", "too large")}
    assert {r.reason for r in files.uploads(spark, str(tmp_path))[1].collect()} == {"not UTF-8"}


def test_word_documents(spark, tmp_path):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Scope</w:t></w:r></w:p><w:p><w:r><w:t>It  must</w:t></w:r><w:r><w:t> work.</w:t></w:r></w:p><w:tbl/>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    (tmp_path / "b.docx").write_bytes(b"no zip")
    rows = files.word_documents(spark, str(tmp_path)).orderBy("source", "paragraph").collect()
    assert (rows[0].section, rows[0].text, rows[0].paragraph) == ("Scope", "It must work.", 2)
    assert {r.warning for r in rows} == {None, "table left out", "unreadable: BadZipFile"}


def test_store_round_trip_and_new_embedder(spark, tmp_path):
    c = spark.createDataFrame([(1, "s", "refund policy", [1.0, 0.0])], "chunk_id bigint, source string, text string, embedding array<float>")
    files.save_store(c, str(tmp_path / "s"), "hashing-v5:16:1-2", 3)
    same, again = files.load_store(spark, str(tmp_path / "s"), HashingEmbedder(16))
    assert not again and same.first().embedding == [1.0, 0.0]
    new, again = files.load_store(spark, str(tmp_path / "s"), HashingEmbedder(32))
    assert again and len(new.first().embedding) == 32
    assert files.missing_sources(spark.createDataFrame([("s",), ("t",)], "source string"), c).first().source == "t"
    assert files.inline_texts(spark.createDataFrame([("s", " "), ("", "x"), ("s", "x"), (None, "x")], "source string, text string")).count() == 1


def test_reports_are_published_once(spark, tmp_path):
    p = str(tmp_path / "r")
    assert files.publish_once(spark, p, "text\nmore") and not files.publish_once(spark, p, "text\nmore")
    with pytest.raises(FileExistsError):
        files.publish_once(spark, p, "other")


def test_broken_gap_lines_are_dropped(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"query": "q", "confidence": 0.1, "count": 2, "last_seen": 1.0, "language": "en"}\nnot json\n')
    assert [(r.query, r["count"]) for r in files.gap_file(spark, str(tmp_path / "g.json")).collect()] == [("q", 2)]


def test_stream_and_batch_agree_on_gaps(spark, tmp_path):
    rows = [(f"Question {i % 5}" if i % 2 else f"question {i % 5} ", 0.1 + 0.01 * (i % 7), i, "en", 1) for i in range(60)]
    df = spark.createDataFrame(rows, "query string, confidence double, t bigint, language string, hits int").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    df.repartition(6).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    streams.run_to_end(streams.gap_stream(src), str(tmp_path / "cp"), lambda b, i: b.withColumn("b", F.lit(i)).write.mode("overwrite").parquet(f"{out}/b{i}"))
    last = spark.read.option("recursiveFileLookup", True).parquet(out).groupBy("key").agg(F.max_by(F.struct("query", "confidence", "count", "last_seen"), "b").alias("r")).select("r.*")
    want = insight.gap_table(df).select("query", "confidence", "count", "last_seen")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect())) and last.count() == 5


def test_incremental_ingestion(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id bigint, text string")
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    df.where("doc_id = 1").write.parquet(src)
    streams.ingest(spark, src, "doc_id bigint, text string", out, cp)
    df.where("doc_id = 2").write.mode("append").parquet(src)
    streams.ingest(spark, src, "doc_id bigint, text string", out, cp)
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["a b", "c d"]


def test_event_windows(spark):
    e = spark.createDataFrame([(1, "u", 0, 1.0), (1, "u", 600, 2.0), (1, "u", 7200, 4.0)], "user_id bigint, event_type string, t bigint, value double").withColumn("ts", F.timestamp_seconds("t"))
    assert sorted((r.n, r.total) for r in streams.tumbling(e).collect()) == [(1, 4.0), (2, 3.0)]
    assert sorted(r.n for r in streams.sessions(e).collect()) == [1, 2]
    assert streams.sliding(e).agg(F.sum("n")).first()[0] == 6
