"""Problem 1: speech transcripts into clean, ordered speaker turns.

Method: labels are normalised (case, digits, brackets), and the forms that occur in a recording are clustered with union-find: two forms
are one speaker if they name the same number or letter, or if their words, roles read in any language, agree in their initials and nearly
in their spelling. Turns are then collapsed under the canonical speaker.

Order and runs never gather a recording in one task: cleaned segments are range-partitioned by (recording, time, id), every
partition finds its own runs, and only the outermost runs of each partition (at most three) meet on the driver to be stitched,
however large a recording is.

Defined results: segments without an id are dropped; a null recording is a recording of its own; a null start is read from the
time mark in the text (then from the end, then last); equal starts go by id; repeated rows count once; unlabelled segments
before any label form a turn of a null speaker; extra columns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: Rows a range partition should hold.
PARTITION_ROWS = 250_000

# Words for a speaker, roles and their spellings, sounds, fillers.
SPEAKER_WORDS = "speaker spk sprecher sprecherin locuteur locutrice intervenant hablante orador interlocutor voce parlante relatore спикер говорящий голос диктор 说话人 发言人 说话者 話者 発言者 スピーカー वक्ता voice person participant".split()
ROLES = {
    "host": "host gastgeber gastgeberin hôte anfitrión anfitriona conduttore conduttrice ведущий ведущая 主持人 司会 司会者 मेज़बान",
    "guest": "guest gast invité invitée invitado invitada ospite гость гостья 嘉宾 ゲスト अतिथि मेहमान",
    "moderator": "moderator moderatorin modérateur modératrice moderador moderadora moderatore moderatrice модератор モデレーター मॉडरेटर",
    "caller": "caller anrufer anruferin appelant appelante llamante chiamante звонящий 来电者 電話の人 कॉलर",
    "trainer": "trainer trainerin formateur formatrice instructor instructora formador formadora formatore formatrice тренер инструктор 讲师 講師 प्रशिक्षक",
    "interviewer": "interviewer interviewerin intervieweur entrevistador entrevistadora intervistatore интервьюер 采访者 聞き手",
    "narrator": "narrator erzähler narrateur narrador narratore рассказчик 旁白 ナレーター",
    "agent": "agent operator agente operatore оператор",
    "customer": "customer kunde client cliente клиент 客户 顧客 ग्राहक",
    "teacher": "teacher lehrer professeur profesor insegnante учитель 老师 先生",
    "student": "student schüler étudiant estudiante studente студент 学生",
}
SOUNDS = """crosstalk silence coughs cough music applause background noise laughter laughs inaudible phone rings door closes noise pause sighs unintelligible
    rires rire musique applaudissements risas risa música aplausos gelächter musik beifall lachen applausi musica risate смех музыка аплодисменты шум тишина
    音乐 笑声 掌声 音楽 笑い 拍手 हँसी संगीत तालियाँ""".replace("\n", " ").split("  ")
SOUND_WORDS = frozenset(" ".join(SOUNDS).split())
FILLERS = frozenset("uh uhm um er erm hm hmm hmmm mm mmm mhm ah äh ähm öh öhm euh heu hum bah eh ehm em эм э-э э ээ эээ ммм мм хм 呃 嗯 额 啊 唔 うーん えーと えっと ええと あの あのー えー अं उम हम्म हं".split())
#: Fillers that are also words of one of the languages: they go only where a pause sets them off.
ALSO_WORDS = frozenset("er um em hum ah eh bah あの 啊 э".split())

_DIGITS = str.maketrans({**{0xFF10 + i: str(i) for i in range(10)}, **{0x0966 + i: str(i) for i in range(10)}, 0x3000: " ", 0xFF1A: ":", 0xFF03: "#"})
_TIME = r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
_TIME_HEAD = re.compile(rf"\s*(?:[\[(<【{{]\s*({_TIME})\s*[\])>】}}]|({_TIME})(?!\d))\s*(?:[-–—](?=\s|$))?\s*")
_TIME_ANY = re.compile(rf"[\[(<【{{]\s*{_TIME}\s*[\])>】}}]")
_ARROWS = re.compile(r"\s*(?:>+|[-–—•])(?:\s+|$)")
_WORDS = "|".join(sorted(map(re.escape, SPEAKER_WORDS), key=len, reverse=True))
_ROLE_OF = {w: r for r, ws in ROLES.items() for w in ws.split()}
_ROLE_WORDS = "|".join(sorted(map(re.escape, _ROLE_OF), key=len, reverse=True))
_LABEL = rf"(?:(?:{_WORDS})[\s_#.\-№]*(?:\d{{1,4}}|[a-zа-я](?![^\W\d_]))|s[\s_#.\-]*\d{{1,4}}|(?:{_ROLE_WORDS})(?:[\s_#.\-]*\d{{1,4}})?)"
_LABEL_HEAD = re.compile(rf"\s*(?:[\[(<【{{]\s*({_LABEL})\s*[:.\-]?\s*[\])>】}}]\s*[:\-–—]?\s*|({_LABEL})\s*(?::|[-–—](?=\s|$))\s*)", re.I)
_NUMBERED = re.compile(rf"(?:{_WORDS}|s)?[\s_#.\-№:]*0*(\d{{1,6}})", re.I)
_LETTERED = re.compile(rf"(?:(?:{_WORDS})[\s_#.\-:]*)?([a-zа-я])", re.I)
_MARKED = re.compile(r"\[([^\[\]]*)\]|【([^【】]*)】|\{([^{}]*)\}|<([^<>]*)>|♪([^♪]*)♪|\*([^*]*)\*|[(（]([^()（）]*)[)）]")
_LETTERS = re.compile(r"[^\W\d_]")
_SPEECH = re.compile(r"[^\W_]")
_WORD = re.compile(r"[^\W_](?:[\w'’\-ऀ-ॿー]*[\wऀ-ॿー])?")
_SPOKEN = {f for f in FILLERS if f not in ALSO_WORDS}
_LATIN_FILLER = "|".join(sorted((re.escape(f) for f in _SPOKEN if f[0] < "⺀"), key=len, reverse=True))
_WIDE_FILLER = "|".join(sorted((re.escape(f) for f in FILLERS if f[0] >= "⺀"), key=len, reverse=True))
_ANY_FILLER = "|".join(sorted(map(re.escape, FILLERS), key=len, reverse=True))
_DROP_PAUSED = re.compile(rf"(?:^|(?<=[.!?…]\s))\s*(?:{_ANY_FILLER})(?:\s*(?:\.\.\.|…|[,、，]))+\s*|(?:\s*[,–—]\s*|\s+)(?:{_ANY_FILLER})(?:\s*(?:\.\.\.|…)|\s*[,–—](?=\s))", re.I)
_DROP_PLAIN = re.compile(rf"(?<![\w'’\-])(?:{_LATIN_FILLER})(?![\w'’\-ऀ-ॿ])[,…]*|(?:{_WIDE_FILLER})(?:\.\.\.|[、，,…])+", re.I)

_DROP_FIRST = re.compile(r"^(?:[Ee]r|[Ee]m|[Hh]um|[Aa]h|[Ee]h)\s+(?=[A-ZÀ-ÝЀ-Я¿¡])")


@lru_cache(maxsize=200_000)
def label_form(label: str | None) -> str | None:
    """A label in lower case and plain digits, without brackets and the signs after it; None for an empty one."""
    if label is None:
        return None
    s = re.sub(r"\s+", " ", label.translate(_DIGITS)).strip().strip("[](){}<>【】").strip().rstrip(":：-–—. ").lower()
    return s if _SPEECH.search(s) else None


@lru_cache(maxsize=200_000)
def label_key(label: str | None) -> str | None:
    """What a label names: n:<number>, l:<letter>, r:<role>, or x:<name> for what none of these fits; None for an empty label."""
    s = label_form(label)
    if s is None:
        return None
    if m := _NUMBERED.fullmatch(s):
        return f"n:{int(m[1])}"
    if m := _LETTERED.fullmatch(s):
        return f"l:{m[1]}"
    role = re.fullmatch(rf"({_ROLE_WORDS})[\s_#.\-]*0*(\d*)", s)
    if role:
        return f"r:{_ROLE_OF[role[1]]}{role[2]}"
    return "x:" + re.sub(r"[^\w ]+", " ", s).strip()


def seconds(mark: str) -> float:
    t = 0.0
    for p in mark.replace(",", ".").split(":"):
        t = t * 60 + float(p)
    return t


def _is_sound(inner: str, square: bool) -> bool:
    s = re.sub(_TIME, " ", inner).strip().lower()
    if not s:
        return True
    words = re.findall(r"[^\W\d_][\wऀ-ॿ]*", s)
    if words and all(w in SOUND_WORDS for w in words):
        return True
    return square and len(words) <= 3 and not label_key_is_speaker(s)


def label_key_is_speaker(s: str) -> bool:
    k = label_key(s)
    return k is not None and k[0] != "x"


def read_segment(text: str | None, with_text: bool = True) -> tuple[str, str | None, float | None]:
    """(spoken words, what the label in the text names, seconds of the first time mark); without fillers only ``with_text``."""
    words, label, at = _read_segment(text, with_text)
    return words, label_key(label), at


def _read_segment(text: str | None, with_text: bool = True) -> tuple[str, str | None, float | None]:
    if not text:
        return "", None, None
    t, key, at = text.translate(_DIGITS) if not text.isascii() else text, None, None
    if not t.isascii() or t[:1] in "[(<{*->0123456789 " or ":" in t or " -" in t or "*" in t or "[" in t or "<" in t or "{" in t or "(" in t:
        def drop(m: re.Match) -> str:
            inner = next((g for g in m.groups() if g is not None), "")
            return " " if _is_sound(inner, m[0][0] not in "(（") and not re.fullmatch(rf"\s*{_TIME}\s*", inner) else m[0]

        if "♪" in t or any(c in t for c in "[(<{*【（"):
            t = _MARKED.sub(drop, t)
            t = t.replace("♪", " ")
        while True:
            if m := _TIME_HEAD.match(t):
                at = seconds(m[1] or m[2]) if at is None else at
            elif m := _ARROWS.match(t):
                pass
            elif key is None and (m := _LABEL_HEAD.match(t)):
                key = m[1] or m[2]
            else:
                break
            t = t[m.end():]
        if ":" in t:
            if at is None and (m := _TIME_ANY.search(t)):
                at = seconds(re.search(_TIME, m[0])[0])
            t = _TIME_ANY.sub(" ", t)
    if all(m[0].lower() in FILLERS for m in _WORD.finditer(t)):
        return "", key, at
    if not with_text:
        return t, key, at
    spoken = _DROP_PLAIN.sub("", _DROP_PAUSED.sub(" ", t))
    spoken = re.sub(r"\s+([,.;!?…])", r"\1", re.sub(r"\s+", " ", spoken)).strip(" –—-…").lstrip(",、，")
    spoken = _DROP_FIRST.sub("", spoken).strip()
    return spoken or t.strip(), key, at


def _initials(name: str) -> str:
    return "".join(w[0] for w in name.split())


class UnionFind:
    def __init__(self, items):
        self.parent = {i: i for i in items}

    def find(self, a):
        while self.parent[a] != a:
            self.parent[a] = self.parent[self.parent[a]]
            a = self.parent[a]
        return a

    def union(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _alike(a: str, b: str, similar: float) -> bool:
    """Nearly the same spelling, or one abbreviates the other by initials ('a schmidt', 'anna schmidt'); numbers in them must be equal."""
    wa, wb = a.split(), b.split()
    if len(wa) == len(wb) > 1 and wa[-1] == wb[-1] and all(x == y or (1 in (len(x), len(y)) and x[0] == y[0] and x.isalpha()) for x, y in zip(wa, wb)):
        return True
    return _initials(a) == _initials(b) and re.findall(r"\d+", a) == re.findall(r"\d+", b) and SequenceMatcher(None, a, b).ratio() >= similar


def cluster_labels(forms: list[str], similar: float = 0.84) -> dict[str, str]:
    """Canonical key of every label form of a recording, by union-find over the forms."""
    forms = sorted(set(forms))
    keys = {f: label_key(f) or "x:" for f in forms}
    uf = UnionFind(forms)
    first: dict[str, str] = {}
    for f in forms:  # spellings that name the same number, letter, role or name
        uf.union(first.setdefault(keys[f], f), f)
    blocks: dict[tuple[str, str], list[str]] = {}
    for k, f in first.items():
        words = k[2:].split()
        if k[0] in "rx" and words:
            blocks.setdefault((words[0][0], words[-1][0]), []).append(f)
    for block in blocks.values():
        for i, a in enumerate(block):
            for b in block[:i]:
                if not keys[a][0] == keys[b][0] == "r" and _alike(keys[a][2:], keys[b][2:], similar):
                    uf.union(a, b)
    best: dict[str, str] = {}
    for f in forms:
        r, k = uf.find(f), keys[f]
        best[r] = max(best.get(r, k), k, key=lambda x: (x[0] != "x", len(x), x))
    return {f: best[uf.find(f)] for f in forms}


def cluster_names(names: list[str], similar: float = 0.84) -> dict[str, str]:
    """Canonical name of each: joined if very similar, or if one abbreviates the other."""
    return {n: k[2:] for n, k in cluster_labels(names, similar).items()}


_CLEAN = "media_id string, segment_id bigint, pos double, end_sec double, speaker string, words string"


def clean_segments(segments: DataFrame, with_text: bool = True) -> DataFrame:
    """Segments with speech: place in time, form of the label (null if unlabelled) and spoken words. A narrow pass."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for media, sid, start, end, text, label in zip(p["media_id"], p["segment_id"], p["start_sec"].tolist(), p["end_sec"].tolist(), p["text"], p["speaker"]):
                words, key, at = _read_segment(text, with_text)
                if not words:
                    continue
                pos = start
                if pos != pos or pos is None:
                    known = end == end and end is not None
                    if at is None:
                        pos = end if known else float("inf")
                    else:
                        # the mark is a whole second: the segment lies within it, and before its own end
                        pos = min(at + 0.9995, end - 0.0005) if known else at + 0.5
                out.append((media, sid, pos, end, label_form(label) or label_form(key), words if with_text else None))
            yield pd.DataFrame(out, columns=["media_id", "segment_id", "pos", "end_sec", "speaker", "words"])

    cols = [F.col("media_id").cast("string"), F.col("segment_id").cast("bigint"), F.col("start_sec").cast("double"), F.col("end_sec").cast("double"), "text", "speaker"]
    return segments.where("segment_id is not null").select(*cols).mapInPandas(run, _CLEAN)


#: Label forms of all recordings up to which they are broadcast (about 300 bytes each); beyond, segments are joined with them by a shuffle.
BROADCAST_FORMS = 100_000


def canonical_speakers(clean: DataFrame) -> DataFrame:
    """Label forms replaced by the canonical speaker of their cluster within the recording.

    Only the distinct forms of a recording meet in one task, never its segments.
    """
    forms = clean.where("speaker is not null").select("media_id", "speaker").distinct()
    lists = forms.groupBy("media_id").agg(F.collect_list("speaker").alias("forms"))

    @F.pandas_udf("array<struct<form:string,canonical:string>>")
    def cluster(forms: pd.Series) -> pd.Series:
        return pd.Series([[{"form": a, "canonical": b} for a, b in cluster_labels(list(f)).items()] for f in forms])

    pairs = materialise(lists.select(F.col("media_id").alias("m"), F.explode(cluster("forms")).alias("p")).select("m", F.col("p.form").alias("s"), "p.canonical"), "speakers")
    small = F.broadcast(pairs) if pairs.count() <= BROADCAST_FORMS else pairs
    named = clean.join(small, clean["media_id"].eqNullSafe(small["m"]) & (clean["speaker"] == small["s"]), "left")
    return named.select("media_id", "segment_id", "pos", "end_sec", F.col("canonical").alias("speaker"), "words")


_RUN = "pid int, seq int, media_id string, speaker string, first_segment_id bigint, last_segment_id bigint, segments int, start_sec double, end_sec double, text string, edge boolean, last boolean"


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    cols = [c.split()[0] for c in _RUN.split(", ")]
    done: list[list] = []
    run: list | None = None
    seq, previous = 0, None
    for p in batches:
        for media, sid, pos, end, speaker, words in zip(p["media_id"], p["segment_id"].tolist(), p["pos"].tolist(), p["end_sec"].tolist(), p["speaker"], p["words"]):
            if sid == previous and run is not None and media == run[2]:
                continue
            previous = sid
            if run is not None and media == run[2] and (speaker is None or speaker == run[3]):
                run[5], run[6], run[8] = sid, run[6] + 1, end
                if words is not None:
                    run[9].append(words)
                continue
            if run is not None:
                done.append(run)
            run = [pid, seq, media, speaker, sid, sid, 1, pos, end, [words] if words is not None else [], seq == 0 or seq == 1 and done[-1][3] is None, False]
            seq += 1
        if len(done) > 5000:
            yield pd.DataFrame([[*r[:9], " ".join(r[9]), *r[10:]] for r in done[:-1]], columns=cols)
            done = done[-1:]
    if run is not None:
        run[10] = run[11] = True
        done.append(run)
    if done:
        yield pd.DataFrame([[*r[:9], " ".join(r[9]), *r[10:]] for r in done], columns=cols)


def stitch(edges: list[tuple]) -> list[tuple]:
    """(pid, seq, speaker, turn, part, last_segment_id of the turn) for the outermost runs, given as
    (pid, seq, media, speaker, first, last, is_last) of every partition."""
    out, cur = [], None
    for pid, seq, media, speaker, first, last, is_last in sorted(edges, key=lambda e: e[:2]):
        touches = cur is not None and cur["media"] == media and (pid == cur["pid"] and seq == cur["seq"] + 1 or pid > cur["pid"] and seq == 0 and cur["ends"])
        if touches and (speaker is None or speaker == cur["speaker"]):
            cur["rows"].append([pid, seq])
            cur |= {"pid": pid, "seq": seq, "ends": is_last, "last": last}
            continue
        if cur:
            out.append(cur)
        cur = {"media": media, "speaker": speaker, "turn": first, "last": last, "pid": pid, "seq": seq, "ends": is_last, "rows": [[pid, seq]]}
    if cur:
        out.append(cur)
    return [(p, s, c["speaker"], c["turn"], i, c["last"]) for c in out for i, (p, s) in enumerate(c["rows"])]


def speaker_turns(segments: DataFrame, with_text: bool = True) -> DataFrame:
    """(media_id, turn_id, part, speaker, first_segment_id, last_segment_id, segments, start_sec, end_sec, text).

    turn_id is the turn's first segment. first_ and last_segment_id are the turn's; a turn that reaches over several
    partitions has a row for each part of its text.
    """
    spark = segments.sparkSession
    clean = canonical_speakers(materialise(clean_segments(segments, with_text), "segments"))
    parts = max(spark.sparkContext.defaultParallelism, clean.count() // PARTITION_ROWS)
    ordered = clean.repartitionByRange(parts, "media_id", "pos", "segment_id").sortWithinPartitions("media_id", "pos", "segment_id")
    runs = materialise(ordered.mapInPandas(_runs, _RUN), "runs")
    edges = [tuple(r) for r in runs.where("edge").select("pid", "seq", "media_id", "speaker", "first_segment_id", "last_segment_id", "last").collect()]
    joined = spark.createDataFrame(stitch(edges), "pid int, seq int, s string, turn_id bigint, part int, l bigint")
    shape = ("media_id", "turn_id", "part", "speaker", "first_segment_id", "last_segment_id", "segments", "start_sec", "end_sec", "text")
    inner = runs.where("not edge").withColumn("turn_id", F.col("first_segment_id")).withColumn("part", F.lit(0))
    outer = runs.where("edge").drop("speaker", "first_segment_id", "last_segment_id").join(joined, ["pid", "seq"])
    outer = outer.withColumnsRenamed({"s": "speaker", "l": "last_segment_id"}).withColumn("first_segment_id", F.col("turn_id"))
    return inner.select(*shape).unionByName(outer.select(*shape))
