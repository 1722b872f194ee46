"""Streams: the running record of gaps, incremental ingestion, and windows over events.

State is kept per key by Spark (a gap per wording), so a stream and a batch over the same rows agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.insight import gap_table, joined_gaps, keep_most
from ..session import materialise


def _observe(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    first, query, language, confidence, count, last = state.get if state.exists else (None, None, None, 1.0, 0, None)
    for p in batches:
        for ts, q, lang, c, n in zip(p["ts"].astype("int64") // 1000, p["query"], p["language"], p["confidence"], p["hits"]):
            if first is None or (ts, q) < (first, query):
                first, query, language = int(ts), q, lang
            confidence, count = min(confidence, float(c)), count + int(n)
            last = int(ts) if last is None else max(last, int(ts))
    state.update((first, query, language, confidence, count, last))
    yield pd.DataFrame([(key[0], query, round(confidence, 4), count, pd.Timestamp(last, unit="us"), language)], columns=["key", "query", "confidence", "count", "last_seen", "language"])


def gap_stream(events: DataFrame, threshold: float = 0.3) -> DataFrame:
    """events (query, confidence, ts, language, hits) as a stream -> updates (key, query, confidence, count, last_seen, language)."""
    e = events.withColumn("query", X.strip(F.col("query"))).where((F.col("query") != "") & (F.col("confidence") < threshold)).withColumn("key", F.lower("query"))
    e = e.select("key", "query", "confidence", "ts", "language", F.coalesce("hits", F.lit(1)).cast("bigint").alias("hits"))
    return e.groupBy("key").applyInPandasWithState(
        _observe, "key string, query string, confidence double, count bigint, last_seen timestamp, language string",
        "first bigint, query string, language string, confidence double, count bigint, last bigint", "update", "NoTimeout")


def observe_gaps(record: DataFrame | None, events: DataFrame, threshold: float = 0.3, similarity: float = 0.6, most: int = 200) -> DataFrame:
    """The record of gaps after a batch of events (query, confidence, ts, language, hits): new wordings are joined with similar ones known
    or new, counts add up, and the most frequent, then latest, ``most`` stay."""
    new = gap_table(events, threshold)
    if record is not None:
        both = record.unionByName(new.select(*record.columns))
        new = both.groupBy("key").agg(F.min_by("query", "last_seen").alias("query"), F.min("confidence").alias("confidence"), F.sum("count").alias("count"), F.max("last_seen").alias("last_seen"), F.min_by("language", "last_seen").alias("language"))
    return keep_most(joined_gaps(materialise(new, "gaps-seen"), similarity), most)


def gap_radar(events: DataFrame, folder: str, checkpoint: str, threshold: float = 0.3, similarity: float = 0.6, most: int = 200) -> DataFrame:
    """Runs ``observe_gaps`` over all batches of a stream. Each batch writes a version of the record (at most ``most`` rows) from the one
    before, so a batch seen again gives the same version. Returns the last; drop answered ones with ``insight.resolve``."""
    spark = events.sparkSession
    shape = "key string, query string, confidence double, count bigint, last_seen timestamp_ntz, language string" if dict(events.dtypes)["ts"] == "timestamp_ntz" else "key string, query string, confidence double, count bigint, last_seen timestamp, language string"
    version = lambda i: spark.read.schema(shape).parquet(f"{folder}/version={i}")
    last = [-1]

    def write(batch: DataFrame, batch_id: int) -> None:
        observe_gaps(version(batch_id - 1) if batch_id else None, batch, threshold, similarity, most).write.mode("overwrite").parquet(f"{folder}/version={batch_id}")
        last[0] = batch_id

    run_to_end(events, checkpoint, write, "append")
    return version(last[0]) if last[0] >= 0 else spark.createDataFrame([], shape)


def run_to_end(stream: DataFrame, checkpoint: str, sink, mode: str = "update") -> None:
    """Processes all there is: ``sink(batch, batch_id)`` gets each micro-batch; a batch seen again must give the same."""
    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, size: int = 800, overlap: int = 120, embedder=None) -> None:
    """New document files (doc_id, text, ...) -> chunks (id, chunk_ix, text, start, end[, embedding]) in a folder for each batch.

    With an embedder (dim, id, embed) chunks are embedded as they come. A batch is written once, and its version, one more than the batch's
    number, is written after it; so ``store_version`` counts whole batches only.
    """
    from ..operators.chunking import split_documents
    from ..operators.retrieval import embedded

    docs = spark.readStream.schema(schema).parquet(folder)

    def write(batch: DataFrame, batch_id: int) -> None:
        chunks = split_documents(batch, size=size, overlap=overlap)
        (embedded(chunks, "text", embedder) if embedder else chunks).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        version = [(batch_id + 1, embedder.id if embedder else None)]
        spark.createDataFrame(version, "version bigint, embedder string").coalesce(1).write.mode("overwrite").json(f"{out}/_versions/v={batch_id + 1}")

    run_to_end(docs, checkpoint, write, "append")


def store_version(spark: SparkSession, out: str) -> int:
    """Version of a store that ``ingest`` writes; 0 before the first batch."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema("version bigint, embedder string").json(f"{out}/_versions/*").agg(F.max("version")).first()[0] or 0
    except AnalysisException:
        return 0


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """(window_start, event_type, n, total); on a stream ``late`` is the watermark."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "30 minutes", late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(user_id, session_start, n): events of a user no further apart than the gap."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("session_start"), "n")
