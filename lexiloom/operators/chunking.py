"""Documents into overlapping chunks: split at the coarsest separator that works, packed up to the size.

A piece is a span of the text, so a chunk knows its place without being searched for. How many pieces fit and how many are repeated is
read off the running sum of their lengths.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Separators from coarse to fine; where none is left, a piece is sliced.
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ")


def piece_spans(text: str, size: int) -> list[tuple[int, int]]:
    """[start, end) of the pieces, in order; separators are in none of them."""
    done: list[tuple[int, int]] = []
    todo = [(0, len(text), 0)]
    while todo:
        a, b, level = todo.pop()
        if b - a <= size:
            if b > a:
                done.append((a, b))
        elif level == len(SEPARATORS):
            done += [(i, min(i + size, b)) for i in range(a, b, size)]
        else:
            sep, parts = SEPARATORS[level], []
            while (at := text.find(sep, a, b)) >= 0:
                parts.append((a, at, level + 1))
                a = at + len(sep)
            todo += reversed([*parts, (a, b, level + 1)])
    return done


def chunks_of(text: str, size: int = 800, overlap: int = 120) -> list[tuple[str, int, int]]:
    """(text, start, end): pieces joined by one space; a chunk repeats the last whole pieces of the one before, about ``overlap`` characters.

    ``start`` and ``end`` are where its first piece begins and its last one ends in the text.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    spans = piece_spans(text, size)
    words = [text[a:b].rstrip() for a, b in spans]
    # joined[k]: length of the first k pieces with a space after each that isn't blank; said[k]: the same of all as they stand
    joined, said = [0], [0]
    for w, (a, b) in zip(words, spans):
        joined.append(joined[-1] + (len(w) + 1 if w else 0))
        said.append(said[-1] + b - a + 1)
    out, i, n = [], 0, len(spans)
    while i < n:
        raw = text[slice(*spans[i])]
        lead, tail = len(raw) - len(raw.lstrip()), len(raw) - len(words[i])  # the space before goes where a piece follows, the space after stays
        tail = tail if words[i] and i + 1 < n and words[i + 1] else 0
        j = i + 1 if len(raw) >= size else max(i + 1, bisect_right(joined, joined[i] + lead - tail + size + 1, i + 1) - 1)
        body = raw if j == i + 1 else " ".join([words[i] + raw[len(words[i]) :][:tail], *filter(None, words[i + 1 : j])]).strip()
        start = spans[i][0] + (lead if j > i + 1 else 0)
        out.append((body, start, spans[j - 1][1]))
        if j == n:
            break
        # the latest piece from which the repeated ones reach the overlap; at least one piece must be new
        back = max(i, bisect_right(said, said[j] - overlap) - 1) if overlap > 0 else j
        i = back if i < back else j
    return out


def split_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 800, overlap: int = 120) -> DataFrame:
    """(id, chunk_ix, text, start, end): null and empty texts give no rows; no shuffle."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = [(i, k, *c) for i, t in zip(p["id"], p["t"]) if t for k, c in enumerate(chunks_of(t, size, overlap))]
            yield pd.DataFrame(rows, columns=["id", "chunk_ix", "text", "start", "end"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInPandas(run, f"id {kind}, chunk_ix int, text string, start int, end int")
