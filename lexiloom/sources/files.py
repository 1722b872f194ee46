"""Files as tables: text and Markdown, strict uploads, requirement documents, and the store's tables with their metadata."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUFFIXES = ("txt", "md", "markdown", "rst")
MAX_UPLOAD = 20 * 1024 * 1024
MAX_EXPANDED = 32 * 1024 * 1024


def text_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(source, text) of all text files below a folder; undecodable bytes are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(folder)
    return raw.select(F.col("path").alias("source"), F.regexp_replace(_lenient("content"), "^\\ufeff", "").alias("text"))


@F.pandas_udf(T.StringType())
def _lenient(content: pd.Series) -> pd.Series:
    return content.map(lambda b: bytes(b).decode("utf-8", "ignore"), na_action="ignore")


def uploads(spark: SparkSession, folder: str, most: int = MAX_UPLOAD) -> tuple[DataFrame, DataFrame]:
    """(accepted (source, text), rejected (source, reason)): strict UTF-8 and a size cap."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    ok = F.is_valid_utf8(F.col("content").cast("string"))
    reason = F.when(F.col("length") > most, "too large").when(~ok, "not UTF-8")
    marked = raw.withColumn("reason", reason)
    return marked.where("reason is null").select(F.col("path").alias("source"), F.col("content").cast("string").alias("text")), marked.where("reason is not null").select(F.col("path").alias("source"), "reason")


def inline_texts(df: DataFrame) -> DataFrame:
    """Records (source, text) fit for ingestion: a text that isn't blank and a source of 1 to 300 characters."""
    return df.where((F.trim("text") != "") & F.char_length("source").between(1, 300))


def word_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(source, paragraph, section, text, warning) of .docx files: heading styles set the section; damaged or swollen archives give a warning."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.docx").load(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xml.etree.ElementTree as ET

        ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        for p in batches:
            rows = []
            for path, content in zip(p["path"], p["content"]):
                try:
                    z = zipfile.ZipFile(io.BytesIO(bytes(content)))
                    if sum(i.file_size for i in z.infolist()) > MAX_EXPANDED:
                        rows.append((path, None, None, None, "expands too far"))
                        continue
                    body = ET.fromstring(z.read("word/document.xml")).find(f"{ns}body")
                except Exception as e:
                    rows.append((path, None, None, None, f"unreadable: {type(e).__name__}"))
                    continue
                section, n = "", 0
                for el in body:
                    if el.tag == f"{ns}tbl":
                        rows.append((path, n, section, None, "table left out"))
                    if el.tag != f"{ns}p":
                        continue
                    n += 1
                    text = " ".join("".join(t.text or "" for t in el.iter(f"{ns}t")).split())
                    style = el.find(f"{ns}pPr/{ns}pStyle")
                    if text and style is not None and str(style.get(f"{ns}val", "")).lower().startswith("heading"):
                        section = text
                    elif text:
                        rows.append((path, n, section, text, None))
            yield pd.DataFrame(rows, columns=["source", "paragraph", "section", "text", "warning"]).astype({"paragraph": "Int32"})

    return raw.select("path", "content").mapInPandas(run, "source string, paragraph int, section string, text string, warning string")


def save_store(chunks: DataFrame, folder: str, embedder_id: str, version: int) -> None:
    """The store as Parquet, with what its vectors were made by and its version as a one-row table."""
    spark = chunks.sparkSession
    chunks.write.mode("overwrite").parquet(f"{folder}/chunks")
    spark.createDataFrame([(3, embedder_id, version)], "format int, embedder string, version bigint").coalesce(1).write.mode("overwrite").json(f"{folder}/meta")


def load_store(spark: SparkSession, folder: str, embedder) -> tuple[DataFrame, bool]:
    """(chunks, whether they were embedded anew): vectors of another embedder are made again from the texts."""
    chunks = spark.read.parquet(f"{folder}/chunks")
    meta = spark.read.schema("format int, embedder string, version bigint").json(f"{folder}/meta").first()
    if meta is not None and meta["embedder"] == embedder.id:
        return chunks, False
    from ..operators.retrieval import hashing_embeddings

    fresh = hashing_embeddings(chunks, "chunk_id", "text", embedder.dim).withColumnRenamed("id", "chunk_id")
    return chunks.drop("embedding").join(fresh, "chunk_id"), True


def missing_sources(new: DataFrame, store: DataFrame, source: str = "source") -> DataFrame:
    """Records of sources the store doesn't have yet."""
    return new.join(store.select(source).where(F.col(source).isNotNull()).distinct(), source, "left_anti")


def gap_file(spark: SparkSession, path: str) -> DataFrame:
    """Stored gaps; unreadable lines are dropped."""
    schema = "query string, confidence double, count bigint, last_seen double, language string, _corrupt string"
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path).where("_corrupt is null and query is not null").drop("_corrupt")


def publish_once(spark: SparkSession, folder: str, report: str) -> bool:
    """Writes a report that isn't there yet. The same content again is no error and writes nothing; other content is one."""
    from pyspark.errors import AnalysisException

    one = spark.createDataFrame([(json.dumps(report),)], "value string").coalesce(1)
    try:
        one.write.mode("errorifexists").text(folder)
        return True
    except AnalysisException:
        if spark.read.text(folder).first()[0] != json.dumps(report):
            raise FileExistsError(folder) from None
        return False


_PROTECTED = re.compile(rb"/Encrypt\s+\d+\s+\d+\s+R|/Encrypt\s*<<")


def pdf_documents(spark: SparkSession, folder: str, parser=None, most_pages: int = 100, most_bytes: int = 128 * 1024, most_lines: int = 250) -> DataFrame:
    """(source, page, line, text, warning) of .pdf files. ``parser(bytes) -> list of page texts`` defaults to pypdf where that is installed.

    A file that is protected by a password, over a limit of pages, text or lines, unreadable or without any text has one row with the reason.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def default(content: bytes) -> list[str]:
            from pypdf import PdfReader

            return [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]

        for p in batches:
            rows = []
            for path, content in zip(p["path"], p["content"]):
                said, fault = [], None
                try:
                    pages = [] if _PROTECTED.search(content) else (parser or default)(bytes(content))
                except Exception as e:
                    pages, fault = [], f"unreadable: {type(e).__name__}"
                for n, text in enumerate(pages[: most_pages + 1], 1):
                    lines = [x.strip() for x in text.splitlines()]
                    said += [(path, n, i, x, None) for i, x in enumerate(lines, 1) if x] or [(path, n, None, None, "page without text")]
                told = [r for r in said if r[3] is not None]
                if _PROTECTED.search(content):
                    fault = "protected by a password"
                elif len(pages) > most_pages:
                    fault = "too many pages"
                elif sum(len(t.encode()) for t in pages) > most_bytes:
                    fault = "too much text"
                elif len(told) > most_lines:
                    fault = "too many lines"
                elif fault is None and not told:
                    fault = "no text"
                rows += [(path, None, None, None, fault)] if fault else said
            yield pd.DataFrame(rows, columns=["source", "page", "line", "text", "warning"]).astype({"page": "Int32", "line": "Int32"})

    return raw.select("path", "content").mapInPandas(run, "source string, page int, line int, text string, warning string")


def save_gaps(gaps: DataFrame, path: str) -> None:
    gaps.select("query", "confidence", "count", F.unix_micros("last_seen").cast("double").__truediv__(1e6).alias("last_seen"), "language").write.mode("overwrite").json(path)
