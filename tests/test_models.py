"""Models passed in: a chat server, sound, recognisers; memory, prompts, snapshots and ingestion with vectors."""

import http.server
import io
import json
import threading
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import agent, insight
from lexiloom.operators import vectors as ann
from lexiloom.sources import files, models
from lexiloom.streaming import streams


@pytest.fixture
def server():
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append(body)
            words = ["Final", " Answer: ", body["messages"][-1]["content"]]
            self.send_response(200)
            self.end_headers()
            for w in words if body["stream"] else ["".join(words)]:
                self.wfile.write(json.dumps({"message": {"content": w}}).encode() + b"\n")

        def log_message(self, *args):
            pass

    s = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked
    s.shutdown()


def test_a_chat_server_answers_a_table_of_turns(spark, server):
    host, asked = server
    model = models.ChatModel(host, "m", most_tokens=7)
    assert "".join(model.pieces([("user", "x")])) == "Final Answer: x" and asked[0]["options"]["num_predict"] == 7
    turns = spark.createDataFrame([(1, "why"), (2, "how")], "turn_id bigint, question string")
    assert {r.turn_id: r.answer for r in agent.react(turns, model, {}).collect()} == {1: "why", 2: "how"}
    with pytest.raises(OSError):
        models.ChatModel("http://127.0.0.1:9", "m", tries=2)([("user", "x")])


def wav(x, rate, width=2, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels), w.setsampwidth(width), w.setframerate(rate)
        w.writeframes(x)
    return out.getvalue()


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_wave_files_of_any_width(width):
    x = np.sin(np.arange(8000) / 40)
    top = 2 ** (8 * width - 1) - 1
    raw = ((x * top * 0.9).astype(np.int64) + (128 if width == 1 else 0)).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    got = models.wave_samples(wav(raw, 16_000, width))
    assert got.dtype == np.float32 and np.abs(got - x * 0.9).max() < 0.02


def test_sound_is_mixed_resampled_and_cut(spark, tmp_path):
    t = np.arange(2 * 48_000) / 48_000
    left = (np.sin(t * 2 * np.pi * 100) * 20_000).astype("<i2")
    (tmp_path / "a.wav").write_bytes(wav(np.stack([left, np.zeros_like(left)], 1).tobytes(), 48_000, 2, 2))
    (tmp_path / "b.wav").write_bytes(b"nothing")
    (tmp_path / "c.wav").write_bytes(wav(b"", 16_000))
    rows = sorted(models.sound_files(spark, str(tmp_path), seconds_each=1).collect(), key=lambda r: (r.source, r.part or 0))
    assert [(r.source[-5], r.part, r.start_sec, len(r.samples or []), bool(r.warning)) for r in rows] == [("a", 0, 0.0, 16_000, False), ("a", 1, 1.0, 16_000, False), ("b", None, None, 0, True), ("c", 0, 0.0, 0, False)]
    want = np.sin(np.arange(16_000) / 16_000 * 2 * np.pi * 100) * 20_000 / 2**15 / 2
    assert np.abs(np.array(rows[0].samples) - want)[10:-10].max() < 0.02


def test_failed_and_silent_recordings_have_notes(spark):
    def transcriber(path, lang):
        if path == "bad":
            raise RuntimeError
        return [(0.0, 1.0, f" {lang} "), (1.0, 2.0, "  ")] if path == "good" else []

    r = spark.createDataFrame([("a", "good", "Der Hund ist nicht die Katze und das ist gut", "en"), ("b", "good", None, "fr"), ("c", "bad", None, None), ("d", "still", "", None)], "media_id string, path string, on_screen string, hint string")
    assert {(x.media_id, x.text, x.note) for x in models.transcribed(r, transcriber).collect()} == {("a", "de", None), ("b", "fr", None), ("c", None, "speech_failed"), ("d", None, "no_speech")}


def test_frames_are_read_with_the_packs_of_their_script(spark):
    def recogniser(image, packs):
        text = image.decode()
        if text == "broken":
            raise ValueError
        return (text, 90.0) if packs in ("rus+eng", "eng+deu") else (text.replace("П", "n"), 50.0)

    f = spark.createDataFrame([("m", i, float(i), bytearray(t.encode())) for i, t in enumerate(["Привет", "hello", "broken", ""])], "media_id string, keyframe_id bigint, ts_sec double, image binary")
    got = {r.keyframe_id: (r.text, r.packs) for r in models.read_frames(f, recogniser, ["eng", "deu", "rus"]).collect()}
    assert got == {0: ("Привет", "rus+eng"), 1: ("hello", "eng+deu"), 2: ("", "eng+deu+rus"), 3: ("", "eng+deu+rus")}


def test_pdfs_that_cannot_be_reviewed_say_why(spark, tmp_path):
    for name, content in {"a": b"x", "b": b"trailer << /Encrypt 5 0 R >>", "c": b"y" * 2000, "d": b"l\n" * 30, "e": b" ", "f": b"\x0c" * 9}.items():
        (tmp_path / f"{name}.pdf").write_bytes(content)
    rows = files.pdf_documents(spark, str(tmp_path), lambda b: b.decode().split("\x0c"), most_pages=5, most_bytes=1000, most_lines=20).collect()
    assert {r.source[-5]: (r.text, r.warning) for r in rows} == {"a": ("x", None), "b": (None, "protected by a password"), "c": (None, "too much text"), "d": (None, "too many lines"), "e": (None, "no text"), "f": (None, "too many pages")}


def test_memory_and_prompts(spark):
    t = spark.createDataFrame([(1, "the refund takes two weeks"), (2, "the weather is fine"), (3, None)], "id bigint, text string")
    m = agent.remember(agent.remember(None, t), spark.createDataFrame([(1, "changed"), (4, "refunds need a receipt")], "id bigint, text string"))
    q = spark.createDataFrame([(9, "refund receipt")], "query_id bigint, query_text string")
    assert m.count() == 3 and [r.id for r in agent.recall(m, q, 2).orderBy("rank").collect()] == [4, 1]
    turns = spark.createDataFrame([("c", 5, "and now?", "fact"), ("d", 6, "hi", None)], "conversation string, turn_id bigint, question string, context string")
    said = spark.createDataFrame([("c", i, "user" if i % 2 else "assistant", f"m{i}") for i in range(6)], "conversation string, seq bigint, role string, content string")
    got = {r.turn_id: [(p.role, p.content) for p in r.prompt] for r in agent.prompts(turns, said, "Be brief.", window=1).collect()}
    assert got == {5: [("system", "Be brief."), ("assistant", "m4"), ("user", "m5"), ("user", "Context:\nfact\n\nQuestion: and now?")], 6: [("system", "Be brief."), ("user", "hi")]}


def test_snapshots_of_a_graph(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=(150, 8))
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id bigint, v array<float>")
    index = ann.graph_index(v, 8, m=4, build=20, rows_each=60)
    ann.save_graph(index, str(tmp_path / "g"))
    q = v.where("id < 5").withColumnRenamed("id", "query_id")
    again = ann.load_graph(spark, str(tmp_path / "g"), 4)
    assert sorted(map(tuple, ann.knn_graph(again, q, 3, 8).collect())) == sorted(map(tuple, ann.knn_graph(index, q, 3, 8).collect()))
    again.where("id <> 7").write.parquet(str(tmp_path / "torn"))
    with pytest.raises(ValueError):
        ann.load_graph(spark, str(tmp_path / "torn"), 4)


def test_ingestion_with_vectors_and_versions(spark, tmp_path):
    from lexiloom.functions.pytext import HashingEmbedder

    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    df = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id bigint, text string")
    assert streams.store_version(spark, out) == 0
    for i in (1, 2):
        df.where(F.col("doc_id") == i).write.mode("append").parquet(src)
        streams.ingest(spark, src, "doc_id bigint, text string", out, cp, embedder=HashingEmbedder(16))
        assert streams.store_version(spark, out) == i
    rows = spark.read.parquet(out).collect()
    assert sorted(r.text for r in rows) == ["a b", "c d"] and all(abs(np.linalg.norm(r.embedding) - 1) < 1e-5 for r in rows)


def test_the_running_record_joins_similar_gaps_and_forgets(spark, tmp_path):
    rows = [("refund policy for late orders", 0.1, 1), ("late orders refund policy", 0.2, 2), ("weather today", 0.1, 3), ("other thing entirely", 0.25, 4), ("Refund policy for late orders", 0.05, 5), ("fine answer", 0.9, 6)]
    df = spark.createDataFrame(rows, "query string, confidence double, t bigint").select("query", "confidence", F.timestamp_seconds("t").alias("ts"), F.lit("en").alias("language"), F.lit(1).alias("hits"))
    for i in (0, 3):
        df.where((F.unix_seconds("ts") > i) & (F.unix_seconds("ts") <= i + 3)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = streams.gap_radar(src, str(tmp_path / "record"), str(tmp_path / "cp"), most=2)
    assert sorted((r.key, r["count"], r.confidence) for r in got.collect()) == [("late orders refund policy", 3, 0.05), ("other thing entirely", 1, 0.25)]
    assert insight.resolve(got, spark.createDataFrame([("other thing entirely",)], "query string")).count() == 1
