"""Problem 4: noise in text from scanned pages.

Method: a frequency lexicon is counted over the whole corpus; a symmetric-delete index over it (keys of the folded word with at
most one character left out) yields the candidates for each rarer word; a weighted edit distance that makes known confusion pairs
cheap, the candidates' frequency and the word before pick the repair. Words broken over lines are joined first, and keep their
hyphen only where the lexicon knows the hyphenated form better. Running headers and footers are first or last lines (page numbers
aside) found in at least ``RUNNING`` records of a group, whatever their case, spacing and dashes.

Defined results: null and blank texts have no defects and stay as they are; copies of a record count once; records of a null group
are a group of their own; a hot group is no hot task, since line keys are counted as hashes with partial sums.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

RUNNING = 3
#: A candidate is this frequent at least, and so many times as frequent as the word taken for misread; a word that shows its misreading
#: by itself (not sound) needs no ratio where confusion pairs alone, at most to this cost, explain it.
RATIO, LEAST, EVIDENT = 8, 4, 0.75
#: The same for a word that looks sound, by its length: chance neighbours are common among short words.
SOUND_RATIO = {1: 400, 2: 200, 3: 80, 4: 40}
SOUND_RATIO_LONG = 25
#: Rows up to which running lines, facts about words and context counts are broadcast (8 to 60 bytes each); beyond, each record is joined
#: with its own. Both ways give the same rows.
BROADCAST_ROWS = 500_000
#: Frequent words without facts, which a record needn't ask for in the join; they change nothing but its size.
COMMON = 20_000

# Misread sequence -> what it may stand for. The first column is what is seen.
CONFUSIONS = [
    ("0", "o"), ("0", "о"), ("1", "l"), ("1", "i"), ("1", "í"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"), ("5", "s"), ("8", "b"), ("8", "в"), ("9", "g"), ("6", "é"), ("6", "è"), ("6", "б"), ("6", "b"), ("2", "z"), ("3", "з"), ("3", "э"), ("4", "ч"), ("4", "a"), ("7", "t"), ("$", "s"), ("@", "a"), ("†", "t"), ("€", "e"), ("¢", "c"), ("©", "c"),
    ("cl", "d"), ("d", "cl"), ("ri", "n"), ("n", "ri"), ("rn", "m"), ("m", "rn"), ("ii", "u"), ("ii", "ü"), ("li", "h"), ("vv", "w"), ("c", "e"), ("e", "c"), ("i", "l"), ("l", "i"), ("u", "и"), ("u", "v"), ("h", "b"), ("бl", "ы"), ("ь1", "ы"), ("бi", "ы"), ("iii", "ш"), ("o", "0"),
    ("а", "a"), ("е", "e"), ("о", "o"), ("р", "p"), ("с", "c"), ("у", "y"), ("х", "x"), ("к", "k"), ("м", "m"), ("т", "t"), ("в", "b"), ("н", "h"), ("і", "i"), ("ѕ", "s"), ("ј", "j"), ("г", "r"), ("и", "u"), ("п", "n"),
    ("a", "а"), ("e", "е"), ("o", "о"), ("p", "р"), ("c", "с"), ("y", "у"), ("x", "х"), ("k", "к"), ("m", "м"), ("t", "т"), ("b", "в"), ("h", "н"), ("b", "ь"), ("r", "г"), ("n", "п"), ("g", "д"), ("6", "ь"),
    ("ll", "п"), ("н", "п"), ("ц", "и"), ("ш", "щ"), ("е", "ё"), ("ъ", "ь"), ("ii", "и"),
    ("l<", "k"), ("l<", "к"), ("bl", "ы"), ("r!", "n"), ("r1", "n"), ("r|", "n"), ("c|", "d"), ("c1", "d"), ("c!", "d"), ("a:", "ä"), ("o:", "ö"), ("u:", "ü"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ß", "b"), ("b", "ß"),
]
#: Pairs within one script are weak evidence for a word that looks sound; the others show by themselves.
COST = 0.25

_CHEAP: dict[str, list[str]] = {}
for _a, _b in CONFUSIONS:
    _CHEAP.setdefault(_a, []).append(_b)

_LINES = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_PAGE_WORD = r"(?:p|pp|pg|page|seite|s|página|pagina|pág|pag|стр|страница|с|slide|folie|diapositiva|diapositive|слайд|blatt|sheet|第|पृष्ठ)"
_PAGE_LINE = re.compile(rf"[\s\[(<{{—–\-|·•*=~]*(?:{_PAGE_WORD}\.?\s*)?\d{{1,5}}(?:\s*(?:/|\||of|von|de|di|из|sur)\s*\d{{1,5}})?\s*(?:页|頁|ページ)?[\s\])>}}—–\-|·•*=~.]*", re.I)
_BESIDE = re.compile(rf"^\s*(?:{_PAGE_WORD}\.?\s*)?(\d{{1,5}})(?:\s*/\s*\d{{1,5}})?(?:\s*[|—–\-·•]+\s*|\s{{2,}}|\t+)(?=\S)|(?<=\S)(?:\s*[|·•]\s*|\s+[—–\-]+\s+|\s{{2,}}|\t+)(?:{_PAGE_WORD}\.?\s*)?(\d{{1,5}})(?:\s*/\s*\d{{1,5}})?\s*$", re.I)
_DIGIT = re.compile(r"\d")
_KEY_DROP = re.compile(r"[\s\-‐‑‒–—―_­¬|]+")
_BROKEN = re.compile(r"[^\W\d_][^\W_]?[\W\d]{0,1}$|[^\W_]$|[†|!]$")
_SIGN = "-‐‑­¬–—"
_EDGE = " \t.,;:?()[]{}«»“”„\"'’‘…。，"
_LETTER = re.compile(r"[^\W\d_]")
_SOUND_LATIN = re.compile(r"[a-zà-öø-ÿœßāēīōūčšž'’]+(?:-[a-zà-öø-ÿœß'’]+)*")
_SOUND_CYRILLIC = re.compile(r"[а-яёіїєґ]+(?:-[а-яё]+)*")


def sound(word: str) -> bool:
    """Letters of one script only, as a rightly read word has."""
    return bool(_SOUND_LATIN.fullmatch(word) or _SOUND_CYRILLIC.fullmatch(word))


@lru_cache(maxsize=300_000)
def bare(token: str) -> str:
    """The word of a token: lower case, without the punctuation around it ('!' at the end counts as such)."""
    return token.strip(_EDGE).rstrip("!").rstrip(_EDGE).lower()


_WIDE_FOLD = str.maketrans({"0": "o", "1": "i", "!": "i", "|": "i", "l": "i", "í": "i", "5": "s", "$": "s", "8": "b", "9": "g", "6": "e", "é": "e", "è": "e", "б": "e", "2": "z", "3": "з", "†": "t", "€": "e", "¢": "c", "©": "c", "7": "t", "@": "a", "4": "a",
    "а": "a", "е": "c", "e": "c", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "і": "i", "ѕ": "s", "ј": "j", "г": "r", "и": "u", "п": "n", "ь": "b", "é": "c", "ﬁ": "fi", "ﬂ": "fi", "ä": "a", "ö": "o"})


@lru_cache(maxsize=300_000)
def fold(word: str) -> str:
    """All confusable spellings of a word have one folded form."""
    s = word.translate(_WIDE_FOLD)
    for a, b in (("ы", "bi"), ("m", "rn"), ("w", "vv"), ("d", "ci"), ("h", "ii"), ("ü", "ii"), ("u", "ii"), ("n", "ri"), ("k", "i<")):
        s = s.replace(a, b)
    return s


def delete_keys(word: str) -> set[str]:
    f = fold(word)
    return {f, *(f[:i] + f[i + 1 :] for i in range(len(f)))}


def misread_distance(seen: str, meant: str, most: float = 1.3) -> float:
    """Edit distance from what was meant to what is seen; confusion pairs cost ``COST``, other edits 1."""
    n, m = len(seen), len(meant)
    if abs(n - m) > 4:
        return 9.0
    inf = 9.0
    d = [[inf] * (m + 1) for _ in range(n + 1)]
    d[0][0] = 0.0
    for i in range(n + 1):
        row = d[i]
        for j in range(m + 1):
            v = row[j]
            if v > most:
                continue
            if i < n and j < m:
                w = v + (seen[i] != meant[j])
                if w < d[i + 1][j + 1]:
                    d[i + 1][j + 1] = w
            if i < n and v + 1 < d[i + 1][j]:
                d[i + 1][j] = v + 1
            if j < m and v + 1 < row[j + 1]:
                row[j + 1] = v + 1
            for k in (1, 2, 3):
                for b in _CHEAP.get(seen[i : i + k], ()) if i + k <= n else ():
                    if meant.startswith(b, j) and v + COST < d[i + k][j + len(b)]:
                        d[i + k][j + len(b)] = v + COST
    return d[n][m]


class Page:
    """A text taken apart: page-number lines, the first and the last other line, and the body."""

    __slots__ = ("lines", "paged", "first", "last", "first_key", "last_key", "first_beside", "last_beside")

    def __init__(self, text: str):
        lines = [x for x in _LINES.split(text) if x.strip()]
        self.paged = False
        for end in (0, -1):
            while len(lines) > 1 and _PAGE_LINE.fullmatch(lines[end]):
                lines.pop(end)
                self.paged = True
        if len(lines) == 1 and _PAGE_LINE.fullmatch(lines[0]):
            lines, self.paged = [], True
        self.lines = lines
        self.first_key = self.last_key = None
        self.first_beside = self.last_beside = False
        if lines:
            self.first_key, self.first_beside = line_key(lines[0])
            self.last_key, self.last_beside = line_key(lines[-1])

    def body(self, running_first: bool, running_last: bool) -> list[str]:
        lines = self.lines
        if running_last and lines:
            lines = lines[:-1]
        if running_first and lines:
            lines = lines[1:]
        lines = list(lines)
        for end in (0, -1):  # a number beside the header on a line of its own
            if len(lines) > 1 and (running_first if end == 0 else running_last) and _PAGE_LINE.fullmatch(lines[end]):
                lines.pop(end)
                self.paged = True
        return lines


def line_key(line: str) -> tuple[str, bool]:
    """(key of a line whatever its case, spacing, dashes and page number, whether a number stands beside it)."""
    s = _BESIDE.sub("", line, count=1) if _DIGIT.search(line) else line
    return _KEY_DROP.sub("", s.lower()), s != line


def join_lines(lines: list[str], knows) -> tuple[list[str], bool]:
    """(tokens of the continuous text, whether a word was broken). ``knows(word)`` gives a word's frequency."""
    tokens: list[str] = []
    broken = False
    carry = None
    for line in lines:
        parts = line.split()
        if not parts:
            continue
        if carry is not None:
            head, sign = carry
            whole = head + parts[0]
            if sign in "-‐‑" and knows is not None:
                kept = head + "-" + parts[0]
                if knows(bare(kept)) > knows(bare(whole)):
                    whole = kept
                else:
                    broken = True
            else:
                broken = True
            parts[0] = whole
            carry = None
        last = parts[-1]
        if len(last) > 1 and last[-1] in _SIGN and _LETTER.search(last[-3:-1]):
            carry = (last[:-1].rstrip(_SIGN), last[-1])
            parts.pop()
        tokens += parts
    if carry is not None:
        tokens.append(carry[0] + carry[1])
    return tokens, broken


_COUNTED = "tbl string, record_id bigint, grp string, text string, first_key string, last_key string, word string, n bigint"


def _count(one: DataFrame) -> DataFrame:
    """The record's line keys, and per batch the counts of words (hyphenated over a line: joined, and with the hyphen too)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = {c: b.column(i).to_pylist() for i, c in enumerate(("tbl", "record_id", "grp", "text"))}
            words: Counter = Counter()
            first, last = [], []
            for text in p["text"]:
                page = Page(text or "")
                first.append(page.first_key)
                last.append(page.last_key)
                words.update(join_lines(page.lines, None)[0])
            low: Counter = Counter()
            for w, n in words.items():
                low[bare(w)] += n
            low.pop("", None)
            none = [None] * len(low)
            k = len(first)
            yield pa.RecordBatch.from_arrays([
                pa.array(p["tbl"] + none, pa.string()), pa.array(p["record_id"] + none, pa.int64()), pa.array(p["grp"] + none, pa.string()), pa.array(p["text"] + none, pa.string()),
                pa.array(first + none, pa.string()), pa.array(last + none, pa.string()), pa.array([None] * k + list(low), pa.string()), pa.array([0] * k + list(low.values()), pa.int64()),
            ], [c.split()[0] for c in _COUNTED.split(", ")])

    return one.select("tbl", F.col("record_id").cast("bigint"), "grp", "text").mapInArrow(run, _COUNTED)


def find_repairs(lexicon: DataFrame) -> DataFrame:
    """lexicon(word, n) -> (word, candidates array<struct<r, word, n, cost>>), the likeliest first; all that pass the bounds."""
    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = [(k, w, n) for w, n in zip(p["word"], p["n"]) for k in delete_keys(w)]
            yield pd.DataFrame(out, columns=["k", "word", "n"])

    letters = lexicon.where(F.char_length("word").between(2, 40) & F.col("word").rlike(r"\p{L}"))
    index = letters.mapInPandas(keys, "k string, word string, n bigint").select(F.xxhash64("k").alias("k"), "word", "n")
    is_sound = F.col("word").rlike(r"^(?:[a-zà-öø-ÿœß'’\-]+|[а-яёіїєґ\-]+)$")
    right = index.where((F.col("n") >= LEAST) & is_sound & (F.char_length("word") >= 2)).withColumnsRenamed({"word": "c", "n": "cn"})
    pairs = index.join(right, "k").where(((F.col("cn") >= RATIO * F.col("n")) | ~is_sound) & (F.col("c") != F.col("word"))).select("word", "n", "c", "cn").distinct()

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for w, n, c, cn in zip(p["word"], p["n"], p["c"], p["cn"]):
                whole = sound(w)
                if whole and (cn < SOUND_RATIO.get(len(w), SOUND_RATIO_LONG) * n or (w[0] < "\u0400") != (c[0] < "\u0400")):
                    continue
                cost = misread_distance(w, c)
                if cn < RATIO * n and cost > EVIDENT:
                    continue
                if cost <= (1.3 if not whole and len(w) > 3 else 0.8) and cost < 0.3 * len(c):
                    out.append((w, n, c, cn, cost))
            yield pd.DataFrame(out, columns=["word", "n", "c", "cn", "cost"])

    good = pairs.mapInPandas(judge, "word string, n bigint, c string, cn bigint, cost double")
    rank = F.col("cost") * 4 - F.log("cn")
    return good.groupBy("word").agg(F.sort_array(F.collect_list(F.struct(rank.alias("r"), F.col("c").alias("word"), F.col("cn").alias("n"), "cost"))).alias("candidates"))


def _match_case(token: str, seen: str, meant: str) -> str:
    at = token.lower().find(seen)
    if at < 0:
        return token
    old = token[at : at + len(seen)]
    letters = [c for c in old if c.isalpha()]
    new = meant.upper() if len(letters) > 2 and all(c.isupper() for c in letters) else meant[0].upper() + meant[1:] if old[0].isupper() or (not old[0].isalpha() and at == 0 and token[:1].isupper()) else meant
    return token[:at] + new + token[at + len(seen) :]


def word_facts(lexicon: DataFrame, repairs: DataFrame) -> DataFrame:
    """(word, n, candidates): what a record must know of its words. ``n`` is set for words with a hyphen and for their forms without it."""
    hyphened = lexicon.where(F.col("word").contains("-") & (F.col("n") >= 2))
    closed = hyphened.select(F.regexp_replace("word", "-", "").alias("word")).distinct().join(lexicon, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))
    known = hyphened.unionByName(closed).groupBy("word").agg(F.max("n").alias("n"))
    return known.join(repairs, "word", "full").select("word", "n", "candidates")


def _unsure(candidates: list[tuple]) -> bool:
    """Whether the second candidate is near enough to the first for the word before to decide."""
    rank = lambda c: c[2] * 4 - log(c[1])
    return len(candidates) > 1 and rank(candidates[1]) < rank(candidates[0]) + 4


class Facts:
    """Numbers and candidates of words, given for all records or, by ``own``, for one."""

    __slots__ = ("n", "candidates")

    def __init__(self, rows):
        self.n, self.candidates = {}, {}
        for r in rows:
            if r["n"] is not None:
                self.n[r["word"]] = r["n"]
            if r["candidates"] is not None:
                self.candidates[r["word"]] = [(c["word"], c["n"], c["cost"]) for c in r["candidates"]]

    def knows(self, word: str) -> int:
        return self.n.get(word, 0)


def _pages(p: pd.DataFrame, shared: Facts | None) -> Iterator[tuple]:
    """(row number, page, tokens, whether a word was broken, facts) of the records with a text."""
    own = p["own"] if shared is None else [None] * len(p)
    for k, (text, rf, rl, facts) in enumerate(zip(p["text"], p["rf"], p["rl"], own)):
        if text and text.strip():
            f = shared if shared is not None else Facts(facts if facts is not None else ())
            page = Page(text)
            tokens, broken = join_lines(page.body(rf, rl), f.knows)
            yield k, page, tokens, broken, f


def _with_own_facts(flags: DataFrame, lexicon: DataFrame, facts: DataFrame) -> DataFrame:
    """Adds ``own``: the facts about a record's own words, whichever way its broken words are read."""
    common = lexicon.join(facts, "word", "left_anti").orderBy(F.desc("n"), "word").limit(COMMON)
    shared = flags.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in common.select("word").collect()))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for tbl, rid, text, rf, rl in zip(p["tbl"], p["record_id"], p["text"], p["rf"], p["rl"]):
                if not text or not text.strip():
                    continue
                words: set[str] = set()
                tokens, _ = join_lines(Page(text).body(rf, rl), lambda w: words.add(w) or 0)
                words.update(map(bare, tokens))
                out += [(tbl, rid, w) for w in words - shared.value if w]
            yield pd.DataFrame(out, columns=["tbl", "record_id", "word"])

    asked = flags.mapInPandas(ask, "tbl string, record_id bigint, word string")
    own = asked.join(facts, "word").groupBy("tbl", "record_id").agg(F.collect_list(F.struct("word", "n", "candidates")).alias("own"))
    return materialise(flags.join(own, ["tbl", "record_id"], "left"), "scan-facts")


def _context(flags: DataFrame, shared, unsure: dict | None) -> DataFrame:
    """(tbl, record_id, a, b, n): how often words ``a`` that stand before an ambiguous misread word stand before its candidates ``b``,
    counted over all records. Where ``unsure`` holds all ambiguous words, tbl and record_id are null: the counts serve all records."""
    wanted = None if unsure is None else frozenset(c for cs in unsure.values() for c in cs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            pairs: Counter = Counter()
            asked = set()
            for k, _, tokens, _, f in _pages(p, shared.value if shared else None):
                before = ""
                for t in tokens:
                    w = bare(t)
                    if wanted is None or w in wanted:
                        pairs[before, w] += 1
                    cs = f.candidates.get(w)
                    if cs and _unsure(cs):
                        key = (p["tbl"].iat[k], p["record_id"].iat[k]) if wanted is None else (None, None)
                        asked.update((*key, before, c[0]) for c in cs)
                    before = w
            rows = [(None, None, a, b, n, False) for (a, b), n in pairs.items()] + [(*x, 0, True) for x in asked]
            yield pd.DataFrame(rows, columns=["tbl", "record_id", "a", "b", "n", "asked"])

    shape = "tbl string, record_id bigint, a string, b string, n bigint, asked boolean"
    found = materialise(flags.mapInPandas(run, shape), "scan-context")
    counts = found.where("not asked").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return found.where("asked").select("tbl", "record_id", "a", "b").distinct().join(counts, ["a", "b"]).select("tbl", "record_id", "a", "b", "n")


_FIXED = "tbl string, record_id bigint, hyphen boolean, glyph boolean, header boolean, page_no boolean, text string"


def repair_scans(records: DataFrame, with_text: bool = True) -> DataFrame:
    """records(tbl, record_id, grp, text) -> (tbl, record_id, hyphen, glyph, header, page_no, text)."""
    spark = records.sparkSession
    one = records.where("record_id is not null").dropDuplicates(["tbl", "record_id"])
    counted = materialise(_count(one), "scan-counts")
    pages = counted.where("tbl is not null")
    lexicon = materialise(counted.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "scan-lexicon")
    # running lines: hashes of (table, group, key), counted once a record
    line = lambda c: F.when(F.length(c) > 0, F.xxhash64("tbl", F.coalesce("grp", F.lit("\x00")), c))
    both = F.array_distinct(F.array_compact(F.array(line("first_key"), line("last_key"))))
    running = materialise(pages.select(F.explode(both).alias("h")).groupBy("h").count().where(F.col("count") >= RUNNING).select("h"), "running-lines")
    r = F.broadcast(running) if running.count() <= BROADCAST_ROWS else running
    flags = pages.withColumn("f", line("first_key")).withColumn("l", line("last_key"))
    flags = flags.join(r.withColumnRenamed("h", "f").withColumn("rf", F.lit(True)), "f", "left").join(r.withColumnRenamed("h", "l").withColumn("rl", F.lit(True)), "l", "left")
    flags = flags.select("tbl", "record_id", "text", F.coalesce("rf", F.lit(False)).alias("rf"), F.coalesce("rl", F.lit(False)).alias("rl"))
    facts = materialise(word_facts(lexicon, find_repairs(lexicon)), "scan-facts-of-words")
    shared, unsure = None, None
    if facts.count() <= BROADCAST_ROWS:
        table = Facts(facts.collect())
        shared = spark.sparkContext.broadcast(table)
        unsure = {w: [c[0] for c in cs] for w, cs in table.candidates.items() if _unsure(cs)}
    else:
        flags = _with_own_facts(flags, lexicon, facts)
    context = None
    if with_text and unsure != {}:  # which repair it is doesn't change whether there is one
        context = materialise(_context(flags, shared, unsure), "scan-context-counts")
        if shared and context.count() > BROADCAST_ROWS:  # too many for all: each record's own
            flags, shared, unsure = _with_own_facts(flags, lexicon, facts), None, None
            context = materialise(_context(flags, shared, unsure), "scan-context-counts")
    seen = spark.sparkContext.broadcast({(a, b): n for a, b, n in context.select("a", "b", "n").collect()} if context is not None and shared else {})
    if context is not None and not shared:
        pairs = context.groupBy("tbl", "record_id").agg(F.collect_list(F.struct("a", "b", "n")).alias("pairs"))
        flags = flags.join(pairs, ["tbl", "record_id"], "left")
    else:
        flags = flags.withColumn("pairs", F.lit(None).cast("array<struct<a:string,b:string,n:bigint>>"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = [(tbl, rid, False, False, False, False, text) for tbl, rid, text in zip(p["tbl"], p["record_id"], p["text"])]
            for k, page, tokens, broken, f in _pages(p, shared.value if shared else None):
                rf, rl, own = p["rf"].iat[k], p["rl"].iat[k], p["pairs"].iat[k]
                context = seen.value if own is None else {(c["a"], c["b"]): c["n"] for c in own}
                glyph, before = False, ""
                for i, t in enumerate(tokens):
                    w = bare(t)
                    cs = f.candidates.get(w)
                    if cs:
                        glyph = True
                        if not with_text:
                            break
                        best = max(cs, key=lambda c: (-4 * c[2] + log(c[1]) + 2 * log(1 + context.get((before, c[0]), 0)), c[0]))
                        tokens[i] = _match_case(t, w, best[0])
                    before = w
                beside = rf and page.first_beside or rl and page.last_beside
                out[k] = (*out[k][:2], broken, glyph, bool(rf or rl), bool(page.paged or beside), " ".join(tokens) if with_text else None)
            yield pd.DataFrame(out, columns=["tbl", "record_id", "hyphen", "glyph", "header", "page_no", "text"])

    return flags.mapInPandas(run, _FIXED)


def defects(fixed: DataFrame) -> DataFrame:
    """(tbl, record_id, defect): one row per record and defect."""
    names = F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in ("hyphen", "glyph", "header", "page_no")]))
    return fixed.select("tbl", "record_id", F.explode(names).alias("defect"))
