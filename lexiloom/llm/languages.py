"""Problem 6: a language with a confidence for every record and for every part in another language.

Method: Bayesian evidence fusion. For each record the logarithms of four kinds of evidence add up:
  text      likelihood of its letters: the script, and within the Latin script a naive Bayes model of letter trigrams;
  label     the declared language, in whatever notation, trusted as often as labels agree with firm texts over all records;
  suffix    the region that a declared tag carries as an address suffix does (``pt-BR``), trusted likewise by its own share;
  host      a prior of the recording or session it belongs to, smoothed towards its table's and that towards an even one,
            computed by grouped aggregation of the text posteriors.
Texts are first cut into sentences and, where the script changes for long, into runs; a part gets a language of its own only
by its text. The trigram model is fitted on a bounded sample (about ``SAMPLE`` rows, the lowest hashes) of the records whose declared
label names a language, by their whole texts; everything else covers all rows. Letters are counted by array arithmetic over a batch.

Defined results: null, empty and wordless texts get no language (null, confidence 0) and are never cases; copies of an id count
once; a null host stands alone under its table's prior; a quoted phrase inside other text is not a part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

CODES = ("en", "de", "fr", "es", "it", "ru", "zh", "ja", "hi")
LATIN = CODES[:5]
#: Rows the trigram model is fitted on at most.
SAMPLE = 20_000
#: Weight of the parent in the smoothing of host priors, in records.
SMOOTHING = 4.0
#: Trust in labels and suffixes before any record is seen, weighing as much as ``TRUST_WEIGHT`` records; a text is firm from this posterior on.
LABEL_TRUST, SUFFIX_TRUST, TRUST_WEIGHT, FIRM = 0.9, 0.6, 10.0, 0.99

# Notations of the nine languages, and frequent words that seed the model.
NAMES = {
    "en": "en eng english anglais englisch inglés inglese английский 英语 英語", "de": "de deu ger german deutsch allemand alemán tedesco немецкий 德语 ドイツ語",
    "fr": "fr fra fre french français francais französisch francés francese французский 法语 フランス語", "es": "es spa spanish español espanol castellano spanisch espagnol spagnolo испанский 西班牙语 スペイン語",
    "it": "it ita italian italiano italienisch italien итальянский 意大利语 イタリア語", "ru": "ru rus russian русский russisch russe ruso russo 俄语 ロシア語",
    "zh": "zh zho chi cmn chinese 中文 汉语 漢語 chinesisch chinois chino cinese китайский 中国語 mandarin", "ja": "ja jpn japanese 日本語 日语 japanisch japonais japonés giapponese японский jp",
    "hi": "hi hin hindi हिन्दी हिंदी хинди 印地语 ヒンディー語",
}
SEED = {
    "en": "the of and to in is that for it as with be by this are from at or an was not your you can if our we has have when will which before no how do what where who why does",
    "de": "der die das und ist nicht ein eine zu den von mit für auf sich dem des im wird wenn sie es nach wer oder bei auch wie kann ich was wo warum welche",
    "fr": "le la les de des et est un une pour que qui dans sur pas au aux avec par plus vous nous ce se il elle sont comment je quoi où pourquoi quelle",
    "es": "el la los las de y en es que por con un una del al no se su para más como cuando lo qué cómo dónde quién cuál puedo",
    "it": "il la lo le gli di e in è che non per un una con del della dei si più dopo quando alla nel come cosa dove chi perché quale posso",
}
_REGION = {"gb": "en", "us": "en", "uk": "en", "au": "en", "at": "de", "ch": "de", "de": "de", "fr": "fr", "ca": "fr", "mx": "es", "es": "es", "ar": "es", "it": "it", "ru": "ru", "cn": "zh", "tw": "zh", "hk": "zh", "jp": "ja", "in": "hi"}
_LABEL_OF = {n: c for c, ns in NAMES.items() for n in ns.split()}

_CYRILLIC, _HAN, _KANA, _DEVANAGARI = (re.compile(x) for x in ("[Ѐ-ԯ]", "[㐀-䶿一-鿿豈-﫿]", "[぀-ヿㇰ-ㇿｦ-ﾟ]", "[ऀ-ॿ]"))
_LATIN_WORD = re.compile(r"[A-Za-zÀ-ɏ]+(?:['’][A-Za-zÀ-ɏ]+)*")
_QUOTED = re.compile(r"“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|»[^«\n]*«|\"[^\"\n]*\"|「[^」\n]*」|『[^』\n]*』|‘[^’\n]{3,}’|(?<!\w)'[^'\n]{3,}'(?!\w)")
_QUOTE = re.compile("[“”„«»\"「『‘']")
_MAY_END = re.compile("[.!?…。！？।॥].|[\r\n/|·•—–]")
_END = re.compile(r"(?<=[.!?…])[\"”»’)]*\s+(?=\S)|(?<=[。！？।॥])[\"”»’」』）]*\s*(?=\S)|[\r\n]+|\s+[/|·•]\s+|\s+[—–]\s+(?=[¿¡A-ZÀ-ÝА-Я])")
_WIDE_SCRIPT, _LATIN_RUN = re.compile("[Ѐ-ԯऀ-ॿ぀-ヿ㐀-鿿]"), re.compile("[A-Za-zÀ-ɏ]")
_ANY_LETTER = re.compile(r"(?<![0-9A-Za-z])[A-Za-zÀ-ɏ]{2,}(?![0-9])|[^\W\d_A-Za-zÀ-ɏ]")


@lru_cache(maxsize=100_000)
def declared(label: str | None) -> tuple[str | None, str | None]:
    """(language a label names, language its region suffix suggests)."""
    if label is None:
        return None, None
    s = label.strip().lower()
    parts = re.split(r"[-_]", s)
    return _LABEL_OF.get(s) or _LABEL_OF.get(parts[0]), _REGION.get(parts[-1]) if len(parts) > 1 else None


def trigrams(text: str) -> list[str]:
    """Letter trigrams of the Latin words, with word edges; whole short words count as features too."""
    out = []
    for w in _LATIN_WORD.findall(text):
        w = w.lower().replace("’", "'")
        p = f" {w} "
        out += [p[i : i + 3] for i in range(len(p) - 2)]
        if len(w) <= 5:
            out.append("=" + w)
    return out


class TextModel:
    """Log likelihoods of texts under each language, up to a constant, a whole batch of texts at a time."""

    def __init__(self, counts: dict[str, Counter]):
        vocabulary = sorted(set().union(*counts.values()))
        totals = np.array([sum(counts[c].values()) for c in LATIN], float)
        seen = np.array([[0.0] * len(LATIN), *([counts[c][g] for c in LATIN] for g in vocabulary)])
        #: Row 0 stands for what was never seen; rows are in the order of the sorted vocabulary.
        self.logp = 0.5 * np.log((seen + 0.3) / (totals + 0.3 * (len(vocabulary) + 1)))  # half: neighbouring trigrams share letters
        letters = sorted(set("".join(g[g[0] == "=" :] for g in vocabulary)) - {" "})
        self.k = len(letters) + 2  # 0 another letter, 1 no letter
        self.letter = np.zeros(0x250, np.int64)
        self.letter[[ord(c) for c in letters if ord(c) < 0x250]] = [i for i, c in enumerate(letters, 2) if ord(c) < 0x250]
        self.table = np.zeros(self.k**3, np.int32)
        code = {c: i for i, c in enumerate(letters, 2)} | {" ": 1}
        words = []
        for row, g in enumerate(vocabulary, 1):
            if g[0] == "=":
                n = 0
                for c in g[1:]:
                    n = n * self.k + code[c]
                words.append((n, row))
            else:
                self.table[(code[g[0]] * self.k + code[g[1]]) * self.k + code[g[2]]] = row
        words.sort()
        self.words, self.word_rows = np.array([w for w, _ in words], np.int64), np.array([r for _, r in words], np.int64)

    @classmethod
    def fit(cls, counted: list[tuple[str, str, int]] = ()) -> TextModel:
        """From (code, feature, times) beside the seed words."""
        counts = {c: Counter() for c in LATIN}
        for c, words in SEED.items():
            for w in words.split():
                counts[c].update(trigrams(w) * 20)
        for code, g, n in counted:
            counts[code][g] += n
        return cls(counts)

    def loglik(self, text: str) -> np.ndarray:
        return self.logliks([text])[0][0]

    def logliks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(float[n, 9], Latin words, Han and kana signs, runs of Cyrillic or Devanagari); letters of a script weigh heavily, a Latin name
        or two inside another script hardly."""
        n = len(texts)
        joined = "\x00" + "\x00".join(t.replace("\x00", " ") for t in texts).lower() + "\x00"
        c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        which = np.minimum(np.cumsum(c == 0) - 1, n - 1)
        tally = lambda mask: np.bincount(which[mask], minlength=n)
        starts = lambda mask: mask & ~np.append(False, mask[:-1])
        latin = (c >= 97) & (c <= 122) | (c >= 65) & (c <= 90) | (c >= 0xC0) & (c < 0x250)
        quote = np.flatnonzero((c == 0x27) | (c == 0x2019))
        quote = quote[latin[quote - 1] & latin[quote + 1]]
        letters = tally(latin)
        latin[quote] = True
        cyr, dev = (c >= 0x400) & (c < 0x530), (c >= 0x900) & (c < 0x980)
        kana = (c >= 0x3040) & (c < 0x3100) | (c >= 0x31F0) & (c < 0x3200) | (c >= 0xFF66) & (c < 0xFFA0)
        han = (c >= 0x3400) & (c < 0x4DC0) | (c >= 0x4E00) & (c < 0xA000) | (c >= 0xF900) & (c < 0xFB00)
        n_cyr, n_dev, n_kana, n_han = map(tally, (cyr, dev, kana, han))
        begin = starts(latin)
        words = tally(begin)
        out = np.zeros((n, 9))
        out[:, 5], out[:, 8] = 2.0 * n_cyr, 2.0 * n_dev
        out[:, 6] = 2.0 * n_han - 2.5 * n_kana
        out[:, 7] = 2.0 * n_kana + np.where(n_kana > 0, 1.4, 1.0) * n_han
        other = n_cyr + n_dev + n_kana + n_han
        # trigrams: every letter with its neighbours; what is no Latin letter is an edge
        x = np.where(latin, self.letter[np.where(latin & (c < 0x250), c, 0)], 1)
        x[quote] = self.letter[0x27]
        at = np.flatnonzero(latin)
        rows, of = self.table[(x[at - 1] * self.k + x[at]) * self.k + x[at + 1]].astype(np.int64), which[at]
        # short words
        first = np.flatnonzero(begin)
        size = np.flatnonzero(latin & ~np.append(latin[1:], False)) - first + 1
        first, size = first[size <= 5], size[size <= 5]
        code = np.zeros(len(first), np.int64)
        for i in range(5):
            code = np.where(i < size, code * self.k + x[np.minimum(first + i, len(x) - 1)], code)
        if len(self.words):
            near = np.minimum(np.searchsorted(self.words, code), len(self.words) - 1)
            known = np.where(self.words[near] == code, self.word_rows[near], 0)
        else:
            known = np.zeros(len(code), np.int64)
        rows, of = np.concatenate([rows, known]), np.concatenate([of, which[first]])
        s = np.stack([np.bincount(of, self.logp[rows, k], n) for k in range(5)], 1)
        weigh = (words > 0) & ((other == 0) | (words > 3) | (other < 3))
        out[:, :5] = np.where(weigh[:, None], s - s.max(1, keepdims=True) + 1.2 * (letters + np.bincount(which[quote], minlength=n))[:, None], 0.0)
        return out, words, n_han + n_kana, tally(starts(cyr)) + tally(starts(dev))


def parts_of(text: str) -> list[tuple[int, int]]:
    """[start, end) of the sentences, cut further where a long run of Latin words meets another script."""
    masked = _QUOTED.sub(lambda m: "\x00" * len(m[0]), text) if _QUOTE.search(text) else text
    out, a = [], 0
    for m in [*(_END.finditer(masked) if _MAY_END.search(masked) else ()), None]:
        b = m.start() if m else len(text)
        if text[a:b].strip():
            out.append((a, b))
        a = m.end() if m else b
    cut = []
    for a, b in out:
        s = masked[a:b]
        if s.isascii() or not _WIDE_SCRIPT.search(s) or not _LATIN_RUN.search(s):
            cut.append((a, b))
            continue
        runs = [(m.start(), m.end()) for m in re.finditer(r"[^Ѐ-ԯऀ-ॿ぀-ヿ㐀-鿿]*[A-Za-zÀ-ɏ][^Ѐ-ԯऀ-ॿ぀-ヿ㐀-鿿]*", s) if len(_LATIN_WORD.findall(m[0])) >= 4]
        at = 0
        for i, j in runs:
            if s[at:i].strip():
                cut.append((a + at, a + i))
            cut.append((a + i, a + j))
            at = j
        if s[at:].strip():
            cut.append((a + at, b))
    return cut


_PARTS = "tbl string, record_id bigint, host string, named string, region string, wordless boolean, mixed boolean, loglik array<double>, post array<double>, starts array<int>, ends array<int>, langs array<string>, sure array<double>"


_ENDS = frozenset(".!?…")


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Read:
    """What a batch of texts tells: arrays by text, and its parts one after the other (``offsets`` says which are whose)."""

    def __init__(self, texts: list[str | None], model: TextModel):
        n = len(texts)
        owner: list[int] = []
        spans: list[tuple[int, int]] = []
        bares: list[str] = []
        for k, text in enumerate(texts):
            if not text or not _ANY_LETTER.search(text):
                continue
            some, quoted = len(spans), _QUOTE.search(text)
            for a, b in parts_of(text):
                s = text[a:b]
                bare = _QUOTED.sub(" ", s) if quoted else s
                if not _ANY_LETTER.search(bare):
                    bare = s
                    if not quoted or not _ANY_LETTER.search(s):
                        continue
                owner.append(k)
                spans.append((a, b))
                bares.append(bare)
            if len(spans) == some:
                owner.append(k)
                spans.append((0, len(text)))
                bares.append(text)
        self.loglik = np.zeros((n, 9))
        merged: list[list] = []  # text, start, end, language, scores, whole
        if spans:
            scores, words, wide, others = model.logliks(bares)
            post = _softmax(scores)
            best = post.argmax(1)
            sure = post[np.arange(len(post)), best]
            ended = np.array([b.rstrip(" \t\"'”’»)")[-1:] in _ENDS for b in bares])
            # a sentence of two words counts where its text leaves no doubt
            enough = np.where(best < 5, (words >= 3) | (words == 2) & ended & (sure >= FIRM), np.where((best == 6) | (best == 7), wide >= 4, others >= 2)) & (sure >= 0.9)
            np.add.at(self.loglik, owner, scores)
            for k, (a, b), lang, whole, v in zip(owner, spans, best.tolist(), enough.tolist(), scores):
                last = merged[-1] if merged and merged[-1][0] == k else None
                if last and (last[3] == lang or not whole):
                    last[2], last[4] = b, last[4] + v
                elif last and not last[5]:
                    last[2:] = [b, lang, last[4] + v, whole]
                else:
                    merged.append([k, a, b, lang, v, whole])
        who = np.array([m[0] for m in merged], np.int64)
        lang = np.array([m[3] for m in merged], np.int64)
        self.post = _softmax(self.loglik) if n else np.zeros((0, 9))
        self.offsets = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=n))]).astype(np.int32)
        self.starts, self.ends = (np.array([m[i] for m in merged], np.int32) for i in (1, 2))
        self.langs = np.array(CODES, object)[lang] if len(lang) else np.zeros(0, object)
        self.sure = _softmax(np.stack([m[4] for m in merged]))[np.arange(len(merged)), lang] if merged else np.zeros(0)
        self.wordless = np.diff(self.offsets) == 0
        low, high = np.full(n, 9), np.full(n, -1)
        np.minimum.at(low, who, lang), np.maximum.at(high, who, lang)
        self.mixed = high > low


def _names_language(label):
    """The column counterpart of ``declared``: whether a label names one of the languages."""
    low = F.lower(F.trim(label))
    return F.coalesce(low.isin(sorted(_LABEL_OF)) | F.element_at(F.split(low, "[-_]"), 1).isin(sorted(_LABEL_OF)), F.lit(False))


def _fit(one: DataFrame) -> TextModel:
    """Trigram counts of about ``SAMPLE`` labelled rows; only counts of features reach the driver."""
    latin = ~F.col("text").rlike("[\u0400-\u052f\u0900-\u097f\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]")
    labelled = one.where(_names_language(F.col("label")) & F.col("text").isNotNull())
    n = labelled.count()  # texts are looked at only where they are in the sample
    if n > SAMPLE:
        labelled = labelled.where(F.pmod(F.xxhash64("tbl", "record_id"), F.lit(1 << 40)) < F.lit(int((1 << 40) * SAMPLE / n)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            counts: Counter = Counter()
            for text, label in zip(p["text"], p["label"]):
                code = declared(label)[0]
                if code in LATIN:
                    counts.update((code, g) for g in trigrams(text))
            yield pd.DataFrame([(c, g, k) for (c, g), k in counts.items()], columns=["code", "g", "n"])

    counted = labelled.where(latin).select("text", "label").mapInPandas(run, "code string, g string, n bigint").groupBy("code", "g").agg(F.sum("n").alias("n"))
    return TextModel.fit([tuple(r) for r in counted.collect()])


def language_parts(records: DataFrame) -> DataFrame:
    """records(tbl, record_id, host, label, text) -> one row a record with its parts and the fused language.

    (tbl, record_id, lang, confidence, named, mixed, parts array<struct<start,end,lang,confidence>>)
    """
    one = materialise(records.select("tbl", "record_id", "host", "label", "text").dropDuplicates(["tbl", "record_id"]), "language-records")
    shared = one.sparkSession.sparkContext.broadcast(_fit(one))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            n, r = b.num_rows, Read(b.column(4).to_pylist(), m)
            told = [declared(x) for x in b.column(3).to_pylist()]
            nine = pa.array(np.arange(0, 9 * n + 1, 9), pa.int32())
            ragged = lambda x, kind: pa.ListArray.from_arrays(pa.array(r.offsets), pa.array(x, kind))
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), b.column(2), pa.array([x for x, _ in told], pa.string()), pa.array([x for _, x in told], pa.string()), pa.array(r.wordless), pa.array(r.mixed),
                pa.ListArray.from_arrays(nine, pa.array(r.loglik.ravel())), pa.ListArray.from_arrays(nine, pa.array(r.post.ravel())),
                ragged(r.starts, pa.int32()), ragged(r.ends, pa.int32()), ragged(r.langs, pa.string()), ragged(r.sure, pa.float64()),
            ], [c.split()[0] for c in _PARTS.split(", ")])

    parts = materialise(one.select(F.col("tbl").cast("string"), F.col("record_id").cast("bigint").alias("record_id"), F.col("host").cast("string").alias("host"), "label", "text").mapInArrow(read, _PARTS), "language-parts")
    # host priors: sums of text posteriors by host, smoothed towards the table's, and that towards an even one
    sums = [F.sum(F.col("post")[i]).alias(f"s{i}") for i in range(9)]
    words = parts.where("not wordless")
    firm = F.array_max("post") >= FIRM
    text = F.element_at(F.array(*map(F.lit, CODES)), F.array_position("post", F.array_max("post")).cast("int"))
    agree = [F.count_if(firm & F.col(c).isNotNull()).alias(f"{c}_n") for c in ("named", "region")] + [F.count_if(firm & (F.col(c) == text)).alias(f"{c}_yes") for c in ("named", "region")]
    by_table = words.groupBy("tbl").agg(*sums, F.count(F.lit(1)).alias("n"), *agree).collect()  # a row for each table
    priors = {r["tbl"]: (np.array([r[f"s{i}"] for i in range(9)]) + SMOOTHING / 9) / (r["n"] + SMOOTHING) for r in by_table}
    trust = {c: (sum(r[f"{c}_yes"] for r in by_table) + TRUST_WEIGHT * t) / (sum(r[f"{c}_n"] for r in by_table) + TRUST_WEIGHT) for c, t in (("named", LABEL_TRUST), ("region", SUFFIX_TRUST))}
    by_host = words.where("host is not null").groupBy("tbl", "host").agg(*sums, F.count(F.lit(1)).alias("hn"))
    host_sum = by_host.select("tbl", "host", F.array(*[F.col(f"s{i}") for i in range(9)]).alias("hs"), "hn")
    # records without a host stay out of the join, where they would all meet in one task
    alone = parts.where("host is null").withColumn("hs", F.array(*[F.lit(0.0)] * 9)).withColumn("hn", F.lit(0).cast("bigint"))
    hosted = parts.where("host is not null").join(host_sum, ["tbl", "host"], "left").withColumn("hs", F.coalesce("hs", F.array(*[F.lit(0.0)] * 9))).withColumn("hn", F.coalesce("hn", F.lit(0)))
    cols = ("tbl", "record_id", "named", "region", "wordless", "loglik", "post", "hs", "hn", "mixed", "starts", "ends", "langs", "sure")
    joined = alone.select(*cols).unionByName(hosted.select(*cols))
    index = pa.array(CODES)

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = dict(zip(cols, b.columns))
            nine = {k: np.asarray(c[k].flatten()).reshape(-1, 9) for k in ("loglik", "post", "hs")}
            table = np.stack([priors.get(t, np.full(9, 1 / 9)) for t in c["tbl"].to_pylist()]) if b.num_rows else np.zeros((0, 9))
            n = np.asarray(c["hn"])[:, None]
            # without the record's own share
            prior = np.where(n > 1, (np.maximum(nine["hs"] - nine["post"], 0) + SMOOTHING * table) / (np.maximum(n, 1) - 1 + SMOOTHING), table)
            z = nine["loglik"] + np.log(prior + 1e-6)
            for k in ("named", "region"):
                at = np.asarray(pa.compute.index_in(c[k], index).fill_null(-1))
                t = min(trust[k], 1 - 1e-6)
                e = np.full(z.shape, np.log((1 - t) / 8))
                e[np.arange(len(z)), at] = np.log(max(t, 1e-6))
                z += np.where(at[:, None] >= 0, e, 0.0)
            fused = _softmax(z) if len(z) else z
            top = fused.argmax(1) if len(z) else np.zeros(0, int)
            silent = np.asarray(c["wordless"])
            lang = pa.array(np.array(CODES, object)[top], pa.string(), mask=silent)
            sure = pa.array(np.where(silent, 0.0, fused[np.arange(len(top)), top]))
            yield pa.RecordBatch.from_arrays([c["tbl"], c["record_id"], lang, sure, *(c[k] for k in ("named", "mixed", "wordless", "starts", "ends", "langs", "sure"))], ["tbl", "record_id", "lang", "confidence", "named", "mixed", "wordless", "starts", "ends", "langs", "sure"])

    shape = "tbl string, record_id bigint, lang string, confidence double, named string, mixed boolean, wordless boolean, starts array<int>, ends array<int>, langs array<string>, sure array<double>"
    told = joined.mapInArrow(fuse, shape)
    pieces = F.transform(F.arrays_zip("starts", "ends", "langs", "sure"), lambda p: F.struct(p["starts"].alias("start"), p["ends"].alias("end"), p["langs"].alias("lang"), p["sure"].alias("confidence")))
    # one language: all evidence decides
    whole = F.array(F.struct(F.element_at("starts", 1).alias("start"), F.element_at("ends", -1).alias("end"), F.col("lang").alias("lang"), F.col("confidence").alias("confidence")))
    return told.select("tbl", "record_id", "lang", "confidence", "named", "mixed", F.when(F.col("mixed") | F.col("wordless"), pieces).otherwise(whole).alias("parts"))


def found_cases(parts: DataFrame) -> DataFrame:
    """(tbl, record_id, lang): one row per language of each record whose label is missing, wrong or not enough."""
    cases = parts.where(F.col("lang").isNotNull() & (F.col("mixed") | F.col("named").isNull() | (F.col("named") != F.col("lang"))))
    return cases.select("tbl", "record_id", F.explode(F.array_distinct(F.col("parts.lang"))).alias("lang"))
