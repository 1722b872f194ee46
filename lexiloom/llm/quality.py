"""Problem 10: per-document text statistics, and prose told from lists, tables and junk.

Method: every line is reduced to one of a few kinds of look (``OBSERVED``); a hidden Markov model over the looks of a
document's lines, with the states prose, list, table and junk, labels each line. The model starts from broad guesses
and is fitted by Baum-Welch on the whole corpus: expected counts are summed per partition and added up by Spark. The
characters under each label give the document's shares and its kind.

Defined results: null, empty and blank texts have no lines, all statistics 0 and no kind; the order and the layout of
lines count as they stand; repeated rows give repeated rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

STATES = ("prose", "list", "table", "junk")
OBSERVED = ("sentence", "sentences", "item_sentence", "running", "medium", "short", "item", "cells", "symbols", "mash", "heading", "number", "short_end")
_O = {k: i for i, k in enumerate(OBSERVED)}

#: Frequent words of the nine languages.
COMMON = frozenset(
    """the of and to a in is that for it as on with be by this are from at or an was not your you can if our we has have when will which before no
    der die das und ist nicht ein eine zu den von mit für auf sich dem des im wird wenn sie es nach wer oder bei auch
    le la les de des et est un une pour que qui dans sur pas au aux avec par plus vous nous ce se il elle sont
    el los las y es en por con una del al no se su para más como cuando lo
    il lo gli di e che non per un una con del della dei si più dopo quando alla nel
    и в не на с что как по для это из от у за к но или вы мы если когда больше после
    है और के का की में को से पर नहीं यह तो भी एक हैं लिए आप इस कर ने हो""".split()
)
_CJK_COMMON = re.compile("[的了是在和不有您我们会后の はがをにでとものますです]")
_LINES = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_BULLET = re.compile(r"\s*(?:[-–—*•·▪◦‣●○■□➤►✓☐☑+~]+[ \t　]+|\[[ xX✓]?\][ \t]*|\(?\d{1,3}[.)）、][ \t　]*(?=\D)|\(?[a-zA-Zа-яА-Я][.)][ \t]+|[•·▪◦‣●○■□☐☑・])")
_ENDS = re.compile(r"[.!?。！？।॥…．][\"'”’»）)\]」』*_\s]*$")
_INSIDE = re.compile(r"[^\d\s.][.!?][\"'”’»)]*\s+\S|[。！？।]\s*\S|\S[,;:] \S|[，、；]")
_SENTENCE_BREAK = re.compile(r"[^\d\s.][.!?][\"'”’»)]*\s+\S|[。！？।]\s*\S")
_CJK = re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿]")
_CONSONANTS = re.compile(r"[bcdfghjklmnpqrstvwxzßçñ]{4,}", re.I)
_VOWEL = re.compile(r"[aeiouyáàâäãåæéèêëíìîïóòôöõøœúùûüýаеёиоуыэюяіїє]", re.I)
_MOJIBAKE = re.compile("[ÃÂÐÑâï][\u0080-¿‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ€]|�")
_SYMBOL = re.compile(r"[^\w\s\u0900-\u0963\u0970-\u097f]|_")
_GAPS = re.compile(r"\S(?: {2,}|　{2,})(?=\S)")
_TIGHT = re.compile(r"[^\s,;][,;](?=[^\s,;])|[,;](?=[,;]|$)")
_THOUSANDS = re.compile(r"\d,\d{3}(?!\d)")
_DIGIT_COMMA = re.compile(r"(?<=\d),(?=\d)")
_HEX = re.compile(r"(?:0x)?[0-9a-f]{2,}(?::\d+)?", re.I)
_QUOTED = re.compile(r'"[^"\n]*"')


def cells(s: str) -> int:
    """Most cells that one kind of separator makes of a line."""
    n = s.count("\t") + 1 if "\t" in s.strip("\t") else 1
    if "|" in s:
        n = max(n, s.strip().strip("|").count("|") + 1 + s.strip().startswith("|"))
    if "  " in s or "　" in s:
        n = max(n, len(_GAPS.findall(s.strip())) + 1)
    if ";" in s or "," in s:
        q = _QUOTED.sub("q", s.strip())
        if _ENDS.search(q) or "，" in q or "、" in q:
            q = _THOUSANDS.sub("1", q)
        if q[-1] in ";," and q.count(q[-1]) == 1:
            q = q[:-1]
        for c in ";,":
            k = q.count(c)
            if c == "," and k == len(_DIGIT_COMMA.findall(q)):
                continue
            if k and q.count(c + " ") <= k * 0.2:
                n = max(n, k + 1)
    return n


class Line:
    """One line that isn't blank: its kind of look and the counts the document's statistics need."""

    __slots__ = ("look", "size", "symbols", "words", "word_chars", "common", "ends")

    def __init__(self, line: str):
        s = line.strip()
        words = s.lower().split()
        ascii_ = s.isascii()
        self.size = n = len(s)
        self.word_chars = solid = sum(map(len, words))
        # marks of Indic scripts belong to letters, not to symbols
        self.symbols = len(_SYMBOL.findall(s))
        self.ends = bool(_ENDS.search(s, max(0, n - 12)))
        cjk = 0 if ascii_ else len(_CJK.findall(s))
        self.common = sum(map(COMMON.__contains__, words))
        self.words = len(words)
        if cjk:
            self.words = cjk // 2 + sum(1 for w in words if not _CJK.search(w))
            self.common = min(self.words, self.common + len(_CJK_COMMON.findall(s)))
        self.look = _O[self._kind(line, s, words, ascii_, n, solid, cjk)]

    def _kind(self, line: str, s: str, words: list[str], ascii_: bool, n: int, solid: int, cjk: int) -> str:
        letters = solid - self.symbols
        if letters < 0.5 * solid and not (n < 12 and letters):
            return "symbols" if "|" not in s or letters == 0 else "cells"
        if not ascii_ and len(_MOJIBAKE.findall(s)) >= max(2, 0.04 * n):
            return "mash"
        many = len(words)
        plain = self.common >= 2 and self.common >= 0.05 * many  # running language: no need to look for what isn't
        if not plain:
            if ascii_ and letters > 20 and not cjk:
                strange = [w for w in words if len(w) > 2 and w.isalpha() and (_CONSONANTS.search(w) or not _VOWEL.search(w)) or ";" in w[1:-1]]
                if len(strange) > 0.4 * many and "\t" not in s:
                    return "mash"
            if many == 1 and n >= 40 and ascii_:
                return "mash"
        if many > 2 and ascii_ and not (plain and words[0].isalpha()) and "\t" not in s and "|" not in s:
            codes = [w for w in words if _HEX.fullmatch(w)]
            if len(codes) >= 0.5 * many and sum(1 for w in codes if not w.isdigit()) >= max(2, 0.3 * len(codes)) and sum(map(len, codes)) > 0.5 * solid:
                return "mash"
        if many >= 8 and not self.ends and len(set(words)) <= max(3, 0.34 * many):
            return "mash"
        c = cells(line)
        if c >= 2 and not (c < 4 and (self.ends or _SENTENCE_BREAK.search(s))):
            return "cells"
        m = _BULLET.match(line)
        body = line[m.end() :].strip() if m else s
        units = max(many - bool(m), cjk / 2)
        if s[0] == "#":
            return "heading"
        if self.ends and units >= 4:
            return "item_sentence" if m else "sentences" if _SENTENCE_BREAK.search(body) else "sentence"
        if m:
            return "item_sentence" if units > 12 or _INSIDE.search(body.rstrip(";；,，")) else "item"
        if s[-1] in ":：" and units <= 6:
            return "heading"
        if not any(map(str.isalpha, s)):
            return "number"
        if _INSIDE.search(s.rstrip(";；,，")):
            return "sentences" if units > 6 else "running"
        if self.ends:
            return "short_end"
        return "running" if units >= 9 else "medium" if units >= 6 else "short"


_ROW = "id bigint, n_lines int, n_words bigint, word_chars bigint, n_chars bigint, symbols bigint, ended int, common bigint, looks array<tinyint>, sizes array<int>"


def line_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Counts and the looks and sizes of the lines of every text, in one narrow Arrow pass."""
    def one(t: str | None) -> tuple:
        t = t or ""
        if "\ufeff" in t:
            t = t.replace("\ufeff", "")
        lines = [Line(x) for x in _LINES.split(t) if x and not x.isspace()]
        total = lambda c: sum(getattr(x, c) for x in lines)
        return (len(lines), total("words"), total("word_chars"), len(t), total("symbols"), total("ends"), total("common"), [x.look for x in lines], [x.size for x in lines])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(t) for t in b.column(1).to_pylist()]
            cols = list(zip(*rows)) if rows else [()] * 9
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int8()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], [c.split()[0] for c in _ROW.split(", ")])

    return df.select(df[id_col].cast("bigint").alias("id"), df[text_col].alias("t")).mapInArrow(run, _ROW)


def starting_model() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Broad guesses: (start, moves, emissions)."""
    start = np.array([0.6, 0.16, 0.12, 0.12])
    moves = np.full((4, 4), 0.05) + np.eye(4) * 0.8
    weight = {
        "prose": dict(sentence=8, sentences=8, item_sentence=4, running=6, medium=2, short=0.5, item=0.2, cells=0.15, heading=1, number=0.1, short_end=1.5, mash=0.05, symbols=0.05),
        "list": dict(item=9, short=5, medium=2, item_sentence=0.3, running=0.2, heading=1, short_end=0.5, number=0.3, cells=0.15),
        "table": dict(cells=12, number=0.6, short=0.3, symbols=0.4, medium=0.1),
        "junk": dict(symbols=8, mash=9, number=0.5, short=0.3, running=0.1, cells=0.4, short_end=0.3, medium=0.1, item=0.2, heading=0.1),
    }
    emit = np.array([[weight[s].get(o, 0.02) for o in OBSERVED] for s in STATES])
    return start, moves, emit / emit.sum(1, keepdims=True)


def _padded(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(x) for x in seqs])
    out = np.zeros((len(seqs), n.max()), np.int8)
    for i, x in enumerate(seqs):
        out[i, : len(x)] = x
    return out, n


def _groups(seqs: list[np.ndarray], most: int = 400_000) -> Iterator[np.ndarray]:
    """Positions of sequences, longest first, in groups of bounded padded size."""
    n = np.array([len(x) for x in seqs])
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    at = 0
    while at < len(order):
        k = max(1, most // int(n[order[at]]))
        yield order[at : at + k]
        at += k


def expected_counts(seqs: list[np.ndarray], model: tuple) -> np.ndarray:
    """Forward-backward over all sequences: expected starts, moves and emissions, flat."""
    start, moves, emit = model
    first, trans, seen = np.zeros(4), np.zeros((4, 4)), np.zeros((4, len(OBSERVED)))
    for g in _groups(seqs):
        x, n = _padded([seqs[i] for i in g])
        e = emit.T[x]
        T = x.shape[1]
        alpha, scale = np.zeros((len(g), T, 4)), np.ones((len(g), T))
        for t in range(T):
            k = int(np.searchsorted(-n, -t, "left"))  # those longer than t come first
            a = (start if t == 0 else alpha[:k, t - 1] @ moves) * e[:k, t]
            scale[:k, t] = a.sum(1)
            alpha[:k, t] = a / scale[:k, t, None]
        beta = np.ones((len(g), 4))
        for t in range(T - 1, -1, -1):
            k = int(np.searchsorted(-n, -t, "left"))
            gamma = alpha[:k, t] * beta[:k]
            gamma /= gamma.sum(1, keepdims=True)
            np.add.at(seen.T, x[:k, t], gamma)
            if t == 0:
                first += gamma.sum(0)
            else:
                b = e[:k, t] * beta[:k] / scale[:k, t, None]
                trans += moves * (alpha[:k, t - 1].T @ b)
                beta[:k] = b @ moves.T
    return np.concatenate([first, trans.ravel(), seen.ravel()])


def refit(counts: np.ndarray, prior: tuple, weight: float = 50.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """New parameters from expected counts; the starting guesses count as ``weight`` lines a state, which keeps names and states together."""
    first, trans, seen = counts[:4], counts[4:20].reshape(4, 4), counts[20:].reshape(4, -1)
    start, moves, emit = prior
    first, trans, seen = first + weight * start, trans + weight * moves, seen + weight * emit
    return first / first.sum(), trans / trans.sum(1, keepdims=True), seen / seen.sum(1, keepdims=True)


def viterbi(seqs: list[np.ndarray], model: tuple) -> list[np.ndarray]:
    """The likeliest state of every line."""
    ls, lm, le = (np.log(x + 1e-12) for x in model)
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(seqs)
    for g in _groups(seqs):
        x, n = _padded([seqs[i] for i in g])
        T = x.shape[1]
        score = ls + le.T[x[:, 0]]
        back = np.zeros((len(g), T, 4), np.int8)
        for t in range(1, T):
            k = int(np.searchsorted(-n, -t, "left"))
            step = score[:k, :, None] + lm
            back[:k, t] = step.argmax(1)
            score[:k] = step.max(1) + le.T[x[:k, t]]
        state = score.argmax(1)
        path = np.zeros((len(g), T), np.int8)
        for t in range(T - 1, -1, -1):
            k = int(np.searchsorted(-n, -t, "left"))
            path[:k, t] = state[:k]
            state[:k] = back[np.arange(k), t, state[:k]] if t else state[:k]
        for j, i in enumerate(g):
            out[i] = path[j, : n[j]]
    return out


def fit_line_model(lines: DataFrame, rounds: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch over every sequence of the corpus; only 76 sums a partition reach the driver."""
    prior = model = starting_model()
    width = 20 + 4 * len(OBSERVED)

    for _ in range(rounds):
        def part(batches: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
            total = np.zeros(width)
            for pdf in batches:
                total += expected_counts(list(pdf["looks"]), model)
            yield pd.DataFrame({"k": np.arange(width), "v": total})

        sums = lines.select("looks").where("n_lines > 0").mapInPandas(part, "k int, v double").groupBy("k").agg({"v": "sum"}).collect()
        counts = np.zeros(width)
        for k, v in sums:
            counts[k] = v
        model = refit(counts, prior)
    return model


_STATS = (
    "id bigint, n_words bigint, mean_word_length double, symbol_ratio double, end_punct_share double, common_word_share double, n_lines int, "
    "prose_share double, list_share double, table_share double, junk_share double, kind string"
)


def quality_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2) -> DataFrame:
    """One row a document: statistics, the share of characters under each line label, and the kind (null without lines)."""
    lines = materialise(line_table(df, id_col, text_col), "line-looks")
    model = fit_line_model(lines, rounds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            paths = viterbi(list(p["looks"]), model)
            shares = np.zeros((len(p), 4))
            for i, (path, sizes) in enumerate(zip(paths, p["sizes"])):
                if len(path):
                    shares[i] = np.bincount(path, weights=sizes, minlength=4) / sizes.sum()
            words, lines_, solid = (np.maximum(1, p[c].to_numpy()) for c in ("n_words", "n_lines", "n_chars"))
            kind = [None if n == 0 else "prose" if s[0] >= 0.4 else STATES[1 + int(np.argmax(s[1:]))] for n, s in zip(p["n_lines"], shares)]
            yield pd.DataFrame({
                "id": p["id"], "n_words": p["n_words"], "mean_word_length": p["word_chars"] / words, "symbol_ratio": p["symbols"] / solid,
                "end_punct_share": p["ended"] / lines_, "common_word_share": p["common"] / words, "n_lines": p["n_lines"],
                **{f"{s}_share": shares[:, j] for j, s in enumerate(STATES)}, "kind": kind,
            })

    kind = df.schema[id_col].dataType.simpleString()
    return lines.mapInPandas(run, _STATS).withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
