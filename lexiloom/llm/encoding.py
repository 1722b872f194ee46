"""Problem 8: ids of a public byte-level BPE tokenizer for a whole corpus.

Method: forced-boundary splitting. A pair of bytes that is never adjacent inside any
vocabulary token can never be merged, so a cut between the two is certain. A cut is used only
where the pre-tokenising pattern would have parted the text in the same way without it: the
character before is no white space, and an apostrophe after a symbol stays attached (it could
otherwise start a contraction). Fragments repeat endlessly in a corpus; each worker encodes a
fragment once, keeps its ids in a bounded table and assembles documents by array gathers.

Defined results: null text gives an empty list, as empty text does.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = os.environ.get("LEXILOOM_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenising pattern that belongs to this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fragments a worker remembers before it starts afresh; bounds its memory, not the result.
REMEMBERED = 150_000
#: Bytes worked on at a time.
BLOCK = 4_000_000

# White space of more than one byte in UTF-8.
_WIDE_SPACE = re.compile(rb"\xc2\x85|\xc2\xa0|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def forbidden_pairs(ranks: dict[bytes, int]) -> np.ndarray:
    """bool[65536]: the byte pairs a*256+b that no token contains."""
    seen = np.zeros(65536, bool)
    joined = np.frombuffer(b"".join(ranks), np.uint8).astype(np.int64)
    ends = np.cumsum([len(t) for t in ranks]) - 1
    inner = np.ones(len(joined) - 1, bool)
    inner[ends[:-1]] = False
    seen[(joined[:-1] * 256 + joined[1:])[inner]] = True
    return ~seen


class _Numbering(dict):
    """Gives each new fragment the next number and remembers it as new."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, fragment: bytes) -> int:
        self.new.append(fragment)
        self[fragment] = n = len(self)
        return n


class FragmentEncoder:
    """Encodes lists of texts into flat ids and lengths."""

    def __init__(self, vocabulary: str = VOCABULARY, remembered: int = REMEMBERED):
        import tiktoken

        ranks = read_ranks(vocabulary)
        self.forbidden = forbidden_pairs(ranks)
        self.bpe = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.remembered = remembered
        self.ascii_space = np.zeros(256, bool)
        self.ascii_space[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
        # ASCII symbols and every byte of a wide character count as "symbol": more cautious, never wrong.
        self.symbol = np.ones(256, bool)
        for lo, hi in ((48, 57), (65, 90), (97, 122)):
            self.symbol[lo : hi + 1] = False
        self._forget()

    def _forget(self) -> None:
        self.index = _Numbering()
        self.chunks: list[np.ndarray] = []
        self.sizes: list[int] = []

    def _cuts(self, raw: bytes, b: np.ndarray) -> np.ndarray:
        """Positions i such that the text may be cut before byte i."""
        left, right = b[:-1], b[1:]
        space = self.ascii_space[b]
        if _WIDE_SPACE.search(raw):
            for m in _WIDE_SPACE.finditer(raw):
                space[m.end() - 1] = True
        ok = self.forbidden[left.astype(np.int32) * 256 + right]
        ok &= ~space[:-1]
        ok &= (right & 0xC0) != 0x80
        ok &= ~((right == 39) & self.symbol[left])
        return np.flatnonzero(ok) + 1

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids int32, ids per text)."""
        parts = [t.encode("utf-8", "replace") for t in texts]
        sizes = np.array([len(p) for p in parts], np.int64)
        raw = b"".join(parts)
        if not raw:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        b = np.frombuffer(raw, np.uint8)
        ends = np.cumsum(sizes)
        starts = np.unique(np.concatenate(([0], self._cuts(raw, b), ends[:-1])))
        starts = starts[starts < len(raw)]
        bounds = np.append(starts, len(raw)).tolist()
        pieces = [raw[i:j] for i, j in zip(bounds, bounds[1:])]
        if len(self.index) > self.remembered:
            self._forget()
        which = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        for p in self.index.new:
            ids = self.bpe.encode_ordinary(p.decode("utf-8", "replace"))
            self.chunks.append(np.array(ids, np.int32))
            self.sizes.append(len(ids))
        self.index.new.clear()
        size = np.array(self.sizes, np.int64)
        first = np.cumsum(size) - size
        store = np.concatenate(self.chunks)
        n = size[which]
        total = np.cumsum(n)
        at = np.arange(total[-1]) - np.repeat(total - n, n) + np.repeat(first[which], n)
        # ids per text: running totals at each text's end
        before = np.concatenate(([0], total))
        upto = before[np.searchsorted(starts, ends, "left")]
        return store[at], np.diff(np.concatenate(([0], upto)))


_ENCODERS: dict[str, FragmentEncoder] = {}


def encoder(vocabulary: str = VOCABULARY) -> FragmentEncoder:
    """One encoder a worker and vocabulary."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = FragmentEncoder(vocabulary)
    return _ENCODERS[vocabulary]


def _blocks(texts: list[str | None]) -> Iterator[list[str]]:
    block, size = [], 0
    for t in texts:
        block.append(t or "")
        size += len(t or "")
        if size > BLOCK // 2:
            yield block
            block, size = [], 0
    if block:
        yield block


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids array<int>) for every row: no shuffle, one pass, Arrow in and out.

    Null and empty text give an empty list; repeated rows stay repeated; extra columns are dropped.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for batch in batches:
            at = 0
            for block in _blocks(batch.column(1).to_pylist()):
                flat, n = e.encode(block)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(block)), lists], ["id", "ids"])
                at += len(block)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col], df[text_col]).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, tokens bigint) by the same encoder; 0 for null and empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for batch in batches:
            n = [e.encode(block)[1] for block in _blocks(batch.column(1).to_pylist())]
            if n:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n), pa.int64())], ["id", "tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col], df[text_col]).mapInArrow(run, f"id {kind}, tokens bigint").withColumnRenamed("id", id_col)
