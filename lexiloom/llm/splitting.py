"""Problem 7: cut oversized items at natural boundaries.

Method: structure-tree packing. The text of an item over its limit is a tree: sections by heading depth,
paragraphs, lines and list items, sentences, clauses, words. Sibling subtrees are merged bottom-up while they
stay within the limit; only a node over the limit is opened. A leaf that is still too long (a stretch without any
boundary) is cut by length, never before a combining mark. A piece begins with the end of the piece before, from
the first word start that leaves at most the overlap wanted.

Defined results: null and empty texts and texts within the limit give no pieces; a limit below 1 or null counts as
the default row's; the overlap is cut to half the limit, and to nothing where a stretch leaves no room for it.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the characters that end a stretch.
BREAKS = " \t\n\r.!?;,:。！？；，、।"
_HEADING = re.compile(r"^[ ]{0,3}(#{1,6})[ \t]+\S", re.M)
#: Cut points after which a new sibling begins, from coarse to fine.
_LEVELS = (
    re.compile(r"\n[ \t\r]*\n\s*|\r[ \t]*\r\s*"),
    re.compile(r"\r\n|\n|\r"),
    re.compile(r"[.!?][\"'”’»)\]]*[ \t]+|[。！？।][”’」』）]*[ \t]*"),
    re.compile(r"[;,:][ \t]+|[；，、]"),
    re.compile(r"[ \t]+"),
    re.compile(r"[.!?;,:。！？；，、।]+"),
)


def _sections(text: str, a: int, b: int) -> list[tuple[int, int, int]]:
    """(start, end, depth) of the parts of [a, b) that begin at headings; depth 0 before the first."""
    marks = [(m.start(), len(m[1])) for m in _HEADING.finditer(text, a, b)]
    if not marks or marks[0][0] > a:
        marks.insert(0, (a, 0))
    return [(s, (marks[i + 1][0] if i + 1 < len(marks) else b), d) for i, (s, d) in enumerate(marks)]


def _merge(parts: list[tuple[int, int]], limit: int) -> list[tuple[int, int]]:
    """Joins neighbours, smallest sum first come first, while the sum stays within the limit."""
    out: list[tuple[int, int]] = []
    for a, b in parts:
        if out and b - out[-1][0] <= limit:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _hard(text: str, a: int, b: int, limit: int) -> list[tuple[int, int]]:
    out = []
    while b - a > limit:
        c = a + limit
        while c > a + 1 and (unicodedata.combining(text[c]) or unicodedata.category(text[c]) in ("Mn", "Mc", "Me") or text[c] == "‍"):
            c -= 1
        if c == a + 1:
            c = a + limit
        out.append((a, c))
        a = c
    return [*out, (a, b)]


def _open(text: str, a: int, b: int, limit: int, level: int, leaves: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pieces of [a, b), each within the limit; ``leaves`` receives the leaves that had to be cut by length."""
    if b - a <= limit:
        return [(a, b)]
    if level == len(_LEVELS):
        leaves.append((a, b))
        return _hard(text, a, b, limit)
    ends = [m.end() for m in _LEVELS[level].finditer(text, a, b) if m.end() < b]
    if not ends:
        return _open(text, a, b, limit, level + 1, leaves)
    marks = [a, *ends, b]
    parts: list[tuple[int, int]] = []
    for s, e in zip(marks, marks[1:]):
        parts += _open(text, s, e, limit, level + 1, leaves)
    return _merge(parts, limit)


def _tree(text: str, parts: list[tuple[int, int, int]], limit: int, leaves: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sections with their subsections as subtrees."""
    if parts[-1][1] - parts[0][0] <= limit:
        return [(parts[0][0], parts[-1][1])]
    if len(parts) == 1:
        return _open(text, parts[0][0], parts[0][1], limit, 0, leaves)
    top = min(d for _, _, d in parts[1:])
    groups: list[list[tuple[int, int, int]]] = []
    for i, p in enumerate(parts):
        if i == 0 or p[2] <= top:
            groups.append([p])
        else:
            groups[-1].append(p)
    if len(groups) == 1:
        head, rest = groups[0][:1], groups[0][1:]
        groups = [head, rest]
    out: list[tuple[int, int]] = []
    for g in groups:
        out += _tree(text, g, limit, leaves)
    return _merge(out, limit)


def split_item(text: str | None, limit: int, overlap: int) -> list[tuple[int, int]]:
    """[start, end) of each piece; they cover the text, are no longer than the limit, and overlap as wanted."""
    return split_with_leaves(text, limit, overlap)[0]


def split_with_leaves(text: str | None, limit: int, overlap: int) -> tuple[list[tuple[int, int]], list[int]]:
    """(pieces, starts of the unbreakable stretches over the limit): the stretches are what the tree had to cut by length."""
    if not text or len(text) <= limit:
        return [], []
    overlap = max(0, min(overlap, limit // 2))
    leaves: list[tuple[int, int]] = []
    cores = _tree(text, _sections(text, 0, len(text)), limit - overlap, leaves)
    hard = []
    for a, b in leaves:  # a leaf ends with the break after it, and may begin with one at the start of a text
        body = text[a:b].rstrip(BREAKS)
        if len(body.lstrip(BREAKS)) > limit:
            hard.append(a + len(body) - len(body.lstrip(BREAKS)))
    out = [cores[0]]
    starts = None
    for a, b in cores[1:]:
        want = max(a - overlap, out[-1][0] + 1, b - limit)
        if want < a:
            if starts is None:
                starts = [m.end() for m in re.finditer(rf"[{re.escape(BREAKS)}]+", text)]
            i = bisect_left(starts, want)
            if i < len(starts) and starts[i] < a:
                want = starts[i]
        out.append((want, b))
    return out, sorted(hard)


def with_limits(chunks: DataFrame, limits: DataFrame, source_col: str = "source_name") -> DataFrame:
    """Adds max_chars and overlap_chars by the source's ending; ``limits`` is small and doesn't grow."""
    rows = {r["suffix"]: (r["max_chars"], r["overlap_chars"]) for r in limits.collect()}
    m, o = rows.get("default") or (800, 120)
    ending = F.lower(F.regexp_extract(F.trim(F.coalesce(F.col(source_col), F.lit(""))), r"\.([^.\s/]+)$", 1))
    mx, ov = F.lit(m), F.lit(o)
    for k, (a, b) in rows.items():
        if k is not None and k != "default":
            mx = F.when(ending == k.lower().lstrip("."), F.lit(a if a and a > 0 else m)).otherwise(mx)
            ov = F.when(ending == k.lower().lstrip("."), F.lit(b if b is not None else o)).otherwise(ov)
    return chunks.withColumn("max_chars", mx.cast("int")).withColumn("overlap_chars", ov.cast("int"))


_PIECES = "chunk_id bigint, doc_id bigint, piece int, start_in_chunk int, end_in_chunk int, hard_start int, piece_text string, chunk_text string, start_char int"


def split_oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of every chunk over its limit, each with the start of the first unbreakable stretch it holds (or -1).

    A narrow pass without a shuffle: only rows over their limit reach Python. A stretch with its full extent is told once, at the piece
    where it begins. Repeated rows of a chunk give equal rows; the caller drops them.
    """
    big = with_limits(chunks, limits).where(F.char_length("text") > F.col("max_chars")).select("chunk_id", "doc_id", "text", "start_char", "max_chars", "overlap_chars")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                pieces, hard = split_with_leaves(r.text, int(r.max_chars), int(r.overlap_chars))
                ends = [0, *(b for _, b in pieces)]
                start = None if pd.isna(r.start_char) else int(r.start_char)
                for i, (a, b) in enumerate(pieces):
                    here = [h for h in hard if ends[i] <= h < b]
                    for h in here or [-1]:
                        out.append((r.chunk_id, None if pd.isna(r.doc_id) else int(r.doc_id), i, a, b, h, r.text[a:b], r.text if i == 0 else None, start))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _PIECES.split(", ")]).astype({"doc_id": "Int64", "start_char": "Int64"})

    return big.mapInPandas(run, _PIECES)


def place_in_documents(pieces: DataFrame, documents: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, piece, start, end, text): offsets in the document.

    The chunk's own offset counts only if the document has the chunk's text there; else the nearest place that has it
    (the first, where the chunk names none); start and end are null if no place has it or the document is missing.
    """
    heads = pieces.where("chunk_text is not null").dropDuplicates(["chunk_id"]).select("chunk_id", "doc_id", "chunk_text", "start_char")
    docs = documents.select(F.col("doc_id"), F.col("text").alias("doc_text"))

    @F.pandas_udf("int")
    def place(doc: pd.Series, text: pd.Series, at: pd.Series) -> pd.Series:
        def one(d, t, s):
            if d is None or not t:
                return None
            if s is not None and s == s and s >= 0 and d.startswith(t, int(s)):
                return int(s)
            s = 0 if s is None or s != s else max(0, int(s))
            right, left = d.find(t, s), d.rfind(t, 0, s + len(t))
            found = [x for x in (left, right) if x >= 0]
            return min(found, key=lambda x: abs(x - s)) if found else None
        return pd.Series([one(d, t, s) for d, t, s in zip(doc, text, at)], dtype="Int32")

    placed = heads.join(docs, "doc_id", "left").select("chunk_id", place("doc_text", "chunk_text", "start_char").alias("at"))
    return pieces.select("chunk_id", "doc_id", "piece", "start_in_chunk", "end_in_chunk", "piece_text").distinct().join(placed, "chunk_id", "left").select(
        "chunk_id", "doc_id", "piece", (F.col("at") + F.col("start_in_chunk")).alias("start"), (F.col("at") + F.col("end_in_chunk")).alias("end"), F.col("piece_text").alias("text")
    )
