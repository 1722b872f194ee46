"""Two revisions of a requirements document, line by line: what changed, moved, came and went, and the review of the findings.

All steps are joins and windows on pair_id, so a table of pairs is reviewed in one plan; a document has at most ``MAX_LINES`` lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import text as X
from ..session import materialise

MAX_LINES, MAX_BYTES = 250, 128 * 1024
LEAST, ACCEPT, MARGIN = 0.35, 0.50, 0.08

# Patterns of a requirement's id, numbers with units, obligations and conditions; words taken for one another.
ID = "^\\s*(?:[-*]\\s+)?\\[?([A-Z][A-Z0-9]*-\\d+)\\]?[:.\\s]"
NUMBER = (
    "(?iu)(?<![\\p{L}\\p{N}_])[+-]?\\d+(?:[.,]\\d+)?(?:\\s*(?:%|ms|s|sec(?:onds?)?|min(?:utes?)?|h(?:ours?)?|days?|minuten?|sekunden?|tage[n]?|мин(?:ут[уы]?)?|сек(?:унд[уы]?)?|дн(?:ей|я)|"
    "v|kv|kw|w|mb|gb)(?![\\p{L}\\p{N}_]))?"
)
MODAL = "(?iu)(?U)\\b(?:must not|shall not|may not|should not|must|shall|may|should|required|optional|darf nicht|soll nicht|muss|müssen|darf|soll|не должен|не должна|не допускается|должен|должна|должно|может|обязательно)\\b"
CONDITION = "(?iu)(?U)\\b(?:unless|except(?: when| if)?|only if|when|if|provided that|during|after|before|nur wenn|wenn|falls|sofern|außer|während|nach|vor|только если|если|когда|кроме|при условии|после|перед)\\b.*"
ALIASES = {"retain": "keep", "preserve": "keep", "backup": "reserve", "minimum": "least", "maximum": "most", "records": "logs", "shall": "must"}
PLAIN = ["a", "an", "and", "for", "of", "the", "to", "is", "must", "may", "should"]


def citations(documents: DataFrame) -> DataFrame:
    """documents (pair_id, side, source, text) -> (pair_id, side, source, line, text, section): non-blank lines under the last heading above.

    Documents over a limit have no rows here; ``rejected`` names them.
    """
    lines = documents.where(_fault(F.col("text")).isNull()).select("pair_id", "side", "source", F.posexplode(_lines(F.col("text"))).alias("i", "text"))
    s = X.strip(F.col("text"))
    head = s.startswith("#")
    w = W.partitionBy("pair_id", "side").orderBy("i")
    marked = lines.withColumn("_h", F.when(head, F.trim(F.regexp_replace(s, "^[# ]+|[# ]+$", "")))).withColumn("section", F.coalesce(F.last("_h", ignorenulls=True).over(w), F.lit("")))
    return marked.where(~head & (s != "")).select("pair_id", "side", "source", (F.col("i") + 1).alias("line"), "text", "section")


def _lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "^\\ufeff", ""), "\\R")


def _fault(text: Column) -> Column:
    """Why a document can't be reviewed, or null."""
    said = F.filter(_lines(text), lambda x: (X.strip(x) != "") & ~X.strip(x).startswith("#"))
    return (
        F.when(F.octet_length(text) > MAX_BYTES, f"Each document must be at most {MAX_BYTES // 1024} KiB.")
        .when(F.size(said) > MAX_LINES, f"Each document must have at most {MAX_LINES} non-heading lines.")
    )


def rejected(documents: DataFrame) -> DataFrame:
    """(pair_id, side, source, reason) of documents over 128 KiB or 250 lines: a table of pairs goes on without them, but not silently."""
    return documents.select("pair_id", "side", "source", _fault(F.col("text")).alias("reason")).where("reason is not null")


def review(documents: DataFrame, embedder=None) -> DataFrame:
    """Findings of all pairs; a pair with a rejected side has one finding of kind ``rejected`` with the reasons as its signals."""
    bad = materialise(rejected(documents), "review-rejected")
    found = compare(citations(documents.join(bad.select("pair_id"), "pair_id", "left_anti")), embedder)
    none = F.lit(None).cast("int")
    return found.unionByName(bad.groupBy("pair_id").agg(F.sort_array(F.collect_set("reason")).alias("signals")).select("pair_id", F.lit("rejected").alias("kind"), none.alias("before_line"), none.alias("after_line"), "signals", F.array().cast("array<int>").alias("alternatives")))


def requirement_id(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, ID, 1), F.lit(""))


def signals(before: Column, after: Column) -> Column:
    """Which kinds of parts differ: numbers, obligations, conditions; else it is the wording."""
    a, b = F.regexp_replace(before, ID, ""), F.regexp_replace(after, ID, "")
    found = lambda t, p: F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(0)), F.lower)
    kinds = F.array_compact(F.array(*[F.when(found(a, p) != found(b, p), F.lit(k)) for k, p in (("number or unit", NUMBER), ("obligation", MODAL), ("condition or exception", CONDITION))]))
    return F.when(F.size(kinds) > 0, kinds).otherwise(F.array(F.lit("wording")))


def _terms(text: Column) -> Column:
    same = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    kept = F.filter(X.tokens(text), lambda t: ~t.isin(PLAIN))
    return F.array_distinct(F.transform(kept, lambda t: F.coalesce(F.try_element_at(same, t), t)))


#: From this cosine on, two lines under headings may gain by their sections, if the lines with their sections are this similar.
NEAR, NEAR_IN_SECTION = 0.55, 0.70
_SCORES = "pair_id string, before_line int, after_line int, renumbered boolean, score double"


def pair_scores(rid: tuple[list, list], text: tuple[list, list], terms: tuple[list, list], cosine: np.ndarray, section: tuple[list, list] | None = None, in_section: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(score, renumbered) of every line before with every line after: 0.55 of the shared terms and 0.45 of the cosine.

    Lines of different ids score nothing, or 1 if only the id differs. With ``in_section`` (cosines of the lines together with their
    headings) a pair that is similar by itself may count its sections: 0.25, 0.45 and 0.30; headings alone never make a match.
    """
    size = np.array([len(t) for t in terms[0]])[:, None] + np.array([len(t) for t in terms[1]])[None, :]
    index: dict[str, list[int]] = {}
    for j, ts in enumerate(terms[1]):
        for t in ts:
            index.setdefault(t, []).append(j)
    common = np.zeros(cosine.shape)
    for i, ts in enumerate(terms[0]):
        for t in ts:
            common[i, index.get(t, [])] += 1
    overlap, similar = common / np.maximum(1, size - common), np.maximum(cosine, 0)
    score = 0.55 * overlap + 0.45 * similar
    if in_section is not None:
        under = np.array([bool(x) for x in section[0]])[:, None] & np.array([bool(x) for x in section[1]])[None, :]
        gain = under & (similar >= NEAR) & (in_section >= NEAR_IN_SECTION)
        score = np.where(gain, np.maximum(score, 0.25 * overlap + 0.45 * similar + 0.30 * in_section), score)
    a, b = (np.array([x or "" for x in side], object) for side in rid)
    other = (a[:, None] != b[None, :]) & (a != "")[:, None] & (b != "")[None, :]
    same = np.array(text[0], object)[:, None] == np.array(text[1], object)[None, :]
    renumbered = other & same & np.array([len(t) > 0 for t in terms[0]])[:, None]
    return np.where(other, renumbered.astype(float), score), renumbered


def _scored(lines: DataFrame, embedder=None) -> DataFrame:
    """lines (pair_id, side, line, rid, m, terms, section) -> the scores above 0 of each pair's lines.

    A pair has at most ``MAX_LINES`` lines a side, so its scores are one small matrix; pairs stream through in order, and no line is joined
    with another. Another embedder than hashing turns on the gain by sections.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..functions.pytext import HashingEmbedder

        e = embedder or HashingEmbedder()
        sections = not isinstance(e, HashingEmbedder)
        held: pd.DataFrame | None = None

        def unit(texts: list[str]) -> np.ndarray:
            v = np.asarray(e.embed(texts), float)
            return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-8)

        def scores(p: pd.DataFrame) -> list[tuple]:
            v = unit(p["m"].tolist())
            w = unit([f"{s}\n{m}" if s else m for s, m in zip(p["section"], p["m"])]) if sections else None
            cols = {c: p[c].tolist() for c in ("pair_id", "side", "line", "rid", "m", "terms", "section")}
            out, n, at = [], len(p), 0
            while at < n:  # rows lie by pair, then the lines after, then the lines before
                pair, end = cols["pair_id"][at], at
                while end < n and cols["pair_id"][end] == pair:
                    end += 1
                mid = next((k for k in range(at, end) if cols["side"][k] == "before"), end)
                before, after, at = slice(mid, end), slice(at, mid), end
                if before.start == before.stop or after.start == after.stop:
                    continue
                both = lambda c: (cols[c][before], cols[c][after])  # noqa: B023, E731
                inside = w[before] @ w[after].T if sections and any(cols["section"][before]) and any(cols["section"][after]) else None
                s, renumbered = pair_scores(both("rid"), both("m"), both("terms"), v[before] @ v[after].T, both("section"), inside)
                i, j = np.nonzero(s > 0)
                x, y = both("line")
                out += [(pair, x[a], y[b], r, z) for a, b, r, z in zip(i.tolist(), j.tolist(), renumbered[i, j].tolist(), s[i, j].tolist())]
            return out

        for p in batches:
            p = p if held is None else pd.concat([held, p])
            last = p["pair_id"] == p["pair_id"].iloc[-1] if len(p) else pd.Series([], dtype=bool)
            held = p[last]
            yield pd.DataFrame(scores(p[~last]) if not last.all() else [], columns=[c.split()[0] for c in _SCORES.split(", ")])
        if held is not None and len(held):
            yield pd.DataFrame(scores(held), columns=[c.split()[0] for c in _SCORES.split(", ")])

    return lines.select(F.col("pair_id").cast("string").alias("pair_id"), "side", "line", "rid", "m", "terms", "section").repartition("pair_id").sortWithinPartitions("pair_id", "side", "line").mapInPandas(run, _SCORES)


def compare(lines: DataFrame, embedder=None) -> DataFrame:
    """lines (pair_id, side 'before' or 'after', line, text, section) -> findings (pair_id, kind, before_line, after_line, signals, alternatives).

    Equal lines pair off one by one in order; then ids found once on either side; then the best scored pair, if it is good enough and
    leads every rival of either line by a margin. A line with near rivals is ambiguous; the rest is removed or added.
    """
    base = lines.select(F.col("pair_id").cast("string").alias("pair_id"), "side", "line", "text", "section", X.strip(F.col("text")).alias("t"), requirement_id(F.col("text")).alias("rid"))
    n = base.withColumn("rn", F.row_number().over(W.partitionBy("pair_id", "side", "t").orderBy("line")))
    n = n.withColumn("ids", F.when(F.col("rid").isNotNull(), F.count(F.lit(1)).over(W.partitionBy("pair_id", "side", "rid"))))
    n = materialise(n, "review-lines")
    side = lambda s: n.where(F.col("side") == s).drop("side")
    b, a = side("before"), side("after")
    exact = b.join(a.select("pair_id", "t", "rn", F.col("line").alias("after_line")), ["pair_id", "t", "rn"]).select("pair_id", F.col("line").alias("before_line"), "after_line")
    b1 = b.join(exact.select("pair_id", F.col("before_line").alias("line")), ["pair_id", "line"], "left_anti")
    a1 = a.join(exact.select("pair_id", F.col("after_line").alias("line")), ["pair_id", "line"], "left_anti")
    by_id = b1.where("ids = 1").join(a1.where("ids = 1").select("pair_id", "rid", F.col("line").alias("after_line")), ["pair_id", "rid"]).select("pair_id", F.col("line").alias("before_line"), "after_line")
    by_id = materialise(by_id, "review-ids")
    b2 = b1.join(by_id.select("pair_id", F.col("before_line").alias("line")), ["pair_id", "line"], "left_anti")
    a2 = a1.join(by_id.select("pair_id", F.col("after_line").alias("line")), ["pair_id", "line"], "left_anti")
    rest = b2.select(F.lit("before").alias("side"), *b2.columns).unionByName(a2.select(F.lit("after").alias("side"), *a2.columns))
    plain = F.regexp_replace(F.regexp_replace("text", ID, ""), NUMBER, "")
    scored = _scored(rest.select("pair_id", "side", "line", "rid", F.trim(plain).alias("m"), _terms(plain).alias("terms"), "section"), embedder)
    row, col = W.partitionBy("pair_id", "before_line"), W.partitionBy("pair_id", "after_line")
    ranked = scored.withColumn("r", F.row_number().over(row.orderBy(F.desc("score"), "after_line"))).withColumn("c", F.row_number().over(col.orderBy(F.desc("score"), "before_line")))
    two = lambda w, k: F.max(F.when(F.col(k) == 2, F.col("score"))).over(w)
    one = lambda w, k: F.max(F.when(F.col(k) == 1, F.col("score"))).over(w)
    ranked = materialise(ranked, "review-scores")
    rival_col = F.when(F.col("c") == 1, F.coalesce(two(col, "c"), F.lit(0.0))).otherwise(one(col, "c"))
    ranked = ranked.withColumn("rival", F.greatest(F.coalesce(two(row, "r"), F.lit(0.0)), rival_col)).withColumn("best", one(row, "r"))
    first = ranked.where((F.col("r") == 1) & (F.col("score") >= LEAST))
    first = materialise(first, "review-first")
    accepted = first.where(~F.col("renumbered") & (F.col("score") >= ACCEPT) & (F.col("score") - F.col("rival") >= MARGIN)).select("pair_id", "before_line", "after_line")
    unsure_rows = first.select("pair_id", "before_line").join(accepted.select("pair_id", "before_line"), ["pair_id", "before_line"], "left_anti")
    options = ranked.join(unsure_rows, ["pair_id", "before_line"]).where(F.col("score") >= F.greatest(F.lit(LEAST), F.col("best") - MARGIN))
    options = options.join(accepted.select("pair_id", "after_line"), ["pair_id", "after_line"], "left_anti").select("pair_id", "before_line", "after_line", "r")
    unsure = options.groupBy("pair_id", "before_line").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "after_line"))), lambda s: s["after_line"]).alias("o"))
    paired = by_id.unionByName(accepted)
    text = lambda p: n.where(F.col("side") == p).select("pair_id", F.col("line").alias(f"{p}_line"), F.col("text").alias(f"{p}_text"), F.col("t").alias(f"{p}_key"))
    none = F.array().cast("array<int>")
    changed = paired.join(text("before"), ["pair_id", "before_line"]).join(text("after"), ["pair_id", "after_line"]).where("before_key <> after_key")
    changed = changed.select("pair_id", F.lit("changed").alias("kind"), "before_line", "after_line", signals(F.col("before_text"), F.col("after_text")).alias("signals"), none.alias("alternatives"))
    empty = F.array().cast("array<string>")
    ambiguous = unsure.select("pair_id", F.lit("ambiguous").alias("kind"), "before_line", F.element_at("o", 1).alias("after_line"), empty.alias("signals"), F.slice("o", 2, MAX_LINES).alias("alternatives"))
    gone = b2.select("pair_id", F.col("line").alias("before_line")).join(accepted.unionByName(ambiguous.select("pair_id", "before_line", "after_line")).select("pair_id", "before_line"), ["pair_id", "before_line"], "left_anti")
    removed = gone.select("pair_id", F.lit("removed").alias("kind"), "before_line", F.lit(None).cast("int").alias("after_line"), empty.alias("signals"), none.alias("alternatives"))
    taken = accepted.select("pair_id", "after_line").unionByName(options.select("pair_id", "after_line")).distinct()
    new = a2.select("pair_id", F.col("line").alias("after_line")).join(taken, ["pair_id", "after_line"], "left_anti")
    added = new.select("pair_id", F.lit("added").alias("kind"), F.lit(None).cast("int").alias("before_line"), "after_line", empty.alias("signals"), none.alias("alternatives"))
    return changed.unionByName(ambiguous).unionByName(removed).unionByName(added)


def latest_decisions(findings: DataFrame, log: DataFrame) -> DataFrame:
    """findings (review_id, finding_ix, ...), log (review_id, seq, finding_ix, decision): the last decision of each finding, else pending."""
    last = log.groupBy("review_id", "finding_ix").agg(F.max_by("decision", "seq").alias("decision"))
    return findings.join(last, ["review_id", "finding_ix"], "left").withColumn("decision", F.coalesce("decision", F.lit("pending")))


def decision_status(requests: DataFrame, findings: DataFrame, published: DataFrame) -> DataFrame:
    """requests (review_id, finding_ix, decision) with ``status``: 404 where there is no such review or finding, 422 for an unknown decision,
    409 once the review is published (published(review_id)), else 200. Only those with 200 belong into the log."""
    there = findings.select("review_id", "finding_ix").distinct().withColumn("_f", F.lit(True))
    out = published.select("review_id").distinct().withColumn("_p", F.lit(True))
    j = requests.join(there, ["review_id", "finding_ix"], "left").join(out, "review_id", "left")
    status = F.when(F.col("_f").isNull(), 404).when(~F.coalesce(F.col("decision").isin("accepted", "rejected"), F.lit(False)), 422).when(F.col("_p"), 409).otherwise(200)
    return j.withColumn("status", status).drop("_f", "_p")


def publish_status(requests: DataFrame, decided: DataFrame) -> DataFrame:
    """requests (review_id) with ``status``: 404 for an unknown review, 409 while a finding is pending, else 200, as often as it is asked."""
    ready = publishable(decided)
    return requests.join(ready, "review_id", "left").select("review_id", F.when(F.col("ready").isNull(), 404).when(~F.col("ready"), 409).otherwise(200).alias("status"))


def publishable(decided: DataFrame) -> DataFrame:
    """(review_id, pending, ready): a review is ready once nothing is pending."""
    p = F.sum(F.when(F.col("decision") == "pending", 1).otherwise(0))
    return decided.groupBy("review_id").agg(p.alias("pending"), (p == 0).alias("ready"))


def reports(decided: DataFrame) -> DataFrame:
    """(review_id, report): accepted findings of ready reviews as a Markdown list, in order."""
    ready = publishable(decided).where("ready").select("review_id")
    line = F.concat(F.lit("- **"), "kind", F.lit("**: "), F.coalesce("before_text", F.lit("")), F.when(F.col("before_text").isNotNull() & F.col("after_text").isNotNull(), " → ").otherwise(""), F.coalesce("after_text", F.lit("")))
    acc = decided.where("decision = 'accepted'").join(ready, "review_id")
    return acc.groupBy("review_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("finding_ix", line.alias("l")))), lambda s: s["l"]), "\n").alias("report"))


@F.pandas_udf(T.StringType())
def line_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    """Unified line diff of two texts; null counts as empty."""
    from difflib import unified_diff

    return pd.Series(["\n".join(unified_diff((a or "").splitlines(), (b or "").splitlines(), "before", "after", lineterm="")) for a, b in zip(before, after)])


def greedy_matches(scored: DataFrame, least: float = 0.5) -> DataFrame:
    """scored (pair_id, before_line, after_line, score) -> the baseline that takes the best free pair again and again.

    Each step depends on the ones before, so a pair of documents (at most ``MAX_LINES`` lines a side) is matched in one group.
    """
    def run(p: pd.DataFrame) -> pd.DataFrame:
        rows, a, b = [], set(), set()
        for r in p.sort_values(["score", "before_line", "after_line"], ascending=[False, True, True]).itertuples(index=False):
            if r.score < least:
                break
            if r.before_line not in a and r.after_line not in b:
                a.add(r.before_line)
                b.add(r.after_line)
                rows.append((r.pair_id, r.before_line, r.after_line, r.score))
        return pd.DataFrame(rows, columns=["pair_id", "before_line", "after_line", "score"])

    s = scored.select("pair_id", "before_line", "after_line", "score").where("score is not null")
    return s.groupBy("pair_id").applyInPandas(run, s.schema)


def match_quality(found: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """(correct, extra, missed, precision, recall) of two sets of rows."""
    f, e = found.select(*keys).distinct().withColumn("f", F.lit(1)), expected.select(*keys).distinct().withColumn("e", F.lit(1))
    cond = None
    for k in keys:
        c = f[k].eqNullSafe(e[k])
        cond = c if cond is None else cond & c
    j = f.join(e, cond, "full")
    ok = F.sum(F.when(F.col("f").isNotNull() & F.col("e").isNotNull(), 1).otherwise(0))
    ext, mis = F.sum(F.when(F.col("e").isNull(), 1).otherwise(0)), F.sum(F.when(F.col("f").isNull(), 1).otherwise(0))
    return j.agg(ok.alias("correct"), ext.alias("extra"), mis.alias("missed")).withColumn("precision", F.try_divide(F.col("correct"), F.col("correct") + F.col("extra"))).withColumn("recall", F.try_divide(F.col("correct"), F.col("correct") + F.col("missed")))
