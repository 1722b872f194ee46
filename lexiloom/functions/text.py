"""Text functions as column expressions, so that they stay on the JVM and in the plan.

All take and give null where the text is null, and an empty array or text where it is empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import LANGUAGE_LETTERS, LANGUAGE_MARKERS, QUESTION_MARKERS, QUESTION_STARTS, SECTION_LABELS, STOPWORDS

#: Han and kana; marks that belong inside a word.
CJK = "\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\uf900-\\ufaff"
MARKS = "\\u0300-\\u036f\\u0900-\\u0963\\u0966-\\u0dff"
TOKEN = rf"[{CJK}]+|(?:[\p{{L}}\p{{N}}&&[^{CJK}]]|[{MARKS}])+"
SPACE = "[\\t-\\r\\x1c-\\x20\\x85\\p{Z}]"
SENTENCE = "(?m)[^.!?\\u0964\\u0965\\u3002\\uff01\\uff1f\\n]+(?:[.!?\\u0964\\u0965\\u3002\\uff01\\uff1f]+|$)"


def is_cjk(token: Column) -> Column:
    return token.rlike(f"^[{CJK}]+$")


def tokens(text: Column) -> Column:
    """Lower-case words; runs of Han or kana become overlapping pairs (a single character stays)."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    pairs = lambda t: F.when(is_cjk(t) & (F.char_length(t) > 1), F.transform(F.sequence(F.lit(1), F.char_length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))).otherwise(F.array(t))
    return F.flatten(F.transform(found, pairs))


def stopword_array() -> Column:
    return F.array(*[F.lit(w) for w in sorted(STOPWORDS)])


def content_tokens(text: Column) -> Column:
    """Tokens without function words and single letters."""
    words = sorted(STOPWORDS)
    return F.filter(tokens(text), lambda t: ~t.isin(words) & ((F.char_length(t) > 1) | is_cjk(t)))


def sentences(text: Column) -> Column:
    """Trimmed sentences; a line break ends one too."""
    found = F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), strip)
    return F.filter(found, lambda s: s != "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def preview(text: Column, limit: int = 160) -> Column:
    """Markdown signs and runs of space as one space, cut to the limit with an ellipsis."""
    clean = strip(F.regexp_replace(F.regexp_replace(text, "[#*_`>|]+", " "), f"{SPACE}+", " "))
    return F.when(F.char_length(clean) <= limit, clean).otherwise(F.concat(F.regexp_replace(F.substring(clean, 1, limit - 1), f"{SPACE}+$", ""), F.lit("…")))


def _letters(text: Column, cls: str) -> Column:
    return F.regexp_count(text, F.lit(cls))


def script_counts(text: Column) -> dict[str, Column]:
    return {
        "devanagari": _letters(text, "[\\u0900-\\u097f]"),
        "kana": _letters(text, "[\\u3040-\\u30ff]"),
        "han": _letters(text, "[\\u3400-\\u4dbf\\u4e00-\\u9fff\\uf900-\\ufaff]"),
        "cyrillic": _letters(text, "[\\u0400-\\u04ff]"),
        "latin": _letters(text, "[\\p{L}&&[\\u0000-\\u024f]]"),
    }


def _one_of(values: list[str]):
    # not a lambda with a default: a second parameter would be taken for the index
    return lambda w: w.isin(values)


def language_scores(text: Column) -> dict[str, Column]:
    """Marker words, and twice the letters only one language has."""
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit("\\p{L}+"), F.lit(0))
    out = {}
    for lang, marks in LANGUAGE_MARKERS.items():
        s = F.size(F.filter(words, _one_of(marks.split())))
        if lang in LANGUAGE_LETTERS:
            s = s + 2 * _letters(low, f"[{LANGUAGE_LETTERS[lang]}]")
        out[lang] = s
    return out


def language_confident(text: Column, min_evidence: int = 1) -> Column:
    """Language code, or null where the text tells too little. Ties between Latin-script languages tell nothing."""
    c, s = script_counts(text), language_scores(text)
    best = F.greatest(*s.values())
    second = F.element_at(F.sort_array(F.array(*s.values()), asc=False), 2)
    latin = F.when(best >= max(1, min_evidence), F.when(best > second, F.coalesce(*[F.when(v == best, F.lit(k)) for k, v in s.items()])))
    return (
        F.when(c["kana"] > 0, "ja").when((c["han"] > 0) & (c["han"] * 5 >= F.greatest(c["cyrillic"], c["latin"])), "zh")
        .when((c["devanagari"] > 0) & (c["devanagari"] > c["latin"]), "hi").when((c["cyrillic"] > 0) & (c["cyrillic"] > c["latin"]), "ru").when(c["latin"] > 0, latin)
    )


def language(text: Column) -> Column:
    return F.coalesce(language_confident(text), F.lit("en"))


def script_of(text: Column) -> Column:
    """The script most letters belong to, in a fixed order of precedence; two kana letters make it Japanese; null without letters."""
    n = {
        "latin": _letters(text, "[\\p{L}&&[\\u0000-\\u024f]]"), "cyrillic": _letters(text, "[\\p{L}&&[\\u0400-\\u04ff]]"), "han": _letters(text, "[\\p{L}&&[\\u3400-\\u4dbf\\u4e00-\\u9fff]]"),
        "devanagari": _letters(text, "[\\p{L}&&[\\u0900-\\u097f]]"),
    }
    best = F.greatest(*n.values())
    return F.when(_letters(text, "[\\p{L}&&[\\u3040-\\u30ff]]") >= 2, "japanese").when(best > 0, F.coalesce(*[F.when(v == best, F.lit(k)) for k, v in n.items()]))


def looks_like_question(text: Column) -> Column:
    s = F.lower(strip(text))
    starts = F.lit(False)
    for q in QUESTION_STARTS:
        starts = starts | s.startswith(q)
    return s.rlike("[?？]$") | starts | s.rlike("|".join(QUESTION_MARKERS))


ARITHMETIC = "\\d\\s*(?:[-+*/×÷^]|%)\\s*\\S|\\d+(?:[.,]\\d+)?\\s*%"


def looks_like_knowledge_question(text: Column) -> Column:
    """A question without arithmetic and with at least two different content words."""
    return looks_like_question(text) & ~text.rlike(ARITHMETIC) & (F.size(F.array_distinct(content_tokens(text))) >= 2)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def clock(seconds: Column) -> Column:
    """mm:ss, or h:mm:ss from an hour on."""
    s = F.floor(seconds).cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def section_label(lang: Column, which: int) -> Column:
    pairs = [x for k, v in SECTION_LABELS.items() for x in (F.lit(k), F.lit(v[which]))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), lang), F.lit(SECTION_LABELS["en"][which]))


def crude_stems(text: Column) -> Column:
    """Set of the first five letters of the words that aren't function words."""
    words = sorted(STOPWORDS)
    return F.array_distinct(F.transform(F.filter(tokens(text), lambda t: ~t.isin(words)), lambda t: F.when(is_cjk(t), t).otherwise(F.substring(t, 1, 5))))


def source_name(label: Column) -> Column:
    """The distinctive part of a source label: without what follows a bracket or a standing phrase, and without folders."""
    head = F.element_at(F.split(label, "(?i)\\s*\\(|\\s+demo\\b|\\s+knowledge\\s+base\\b", 2), 1)
    return F.element_at(F.split(F.trim(head), "/"), -1)


def grounding_level(score: Column) -> Column:
    return F.when(score >= 0.6, "high").when(score >= 0.35, "medium").otherwise("low")


def confidence_level(score: Column) -> Column:
    return F.when(score >= 0.5, "high").when(score >= 0.3, "medium").otherwise("low")
