"""Problem 3: how distinctive a term is for a record.

Method: a two-Poisson mixture per term. The term's histogram (how many records hold it 0, 1, 2, ... times) is made of
records that merely mention it and "elite" records that are about it; expectation-maximisation on the histogram fits
both rates and the share of the elite, and the posterior probability of the elite component scores each count.

A single pass over the records yields both the partial histograms, already summed per Arrow batch, and the record-term
counts wanted, so common terms never travel row by row. Terms meet their parameters by broadcast only while the
vocabulary is below ``BROADCAST_TERMS``; beyond it by a shuffled join, where AQE splits hot terms.

Defined results: null, empty and blank texts have no terms but count as records; copies of an id count once; with a single
kind of count (every record alike) the elite can't be told apart and the score is the share 0.5 of the prior.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import materialise

#: Parameter rows up to which the vocabulary is broadcast (about 60 bytes each).
BROADCAST_TERMS = 300_000
ROUNDS = 25


@lru_cache(maxsize=8)
def term_pattern(min_letters: int, wide: bool) -> re.Pattern:
    """Runs of Latin or Cyrillic letters; ``wide`` adds Devanagari words and pairs of Han or kana characters."""
    import regex

    letter = regex.compile(r"[\p{Script=Latin}\p{Script=Cyrillic}]")
    spans, last = [], None
    for c in range(0x41, 0x1E000):
        ch = chr(c)
        if letter.match(ch) and unicodedata.category(ch)[0] == "L":
            if last == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
            last = c
    run = "[" + "".join(f"{chr(a)}-{chr(b)}" if b > a else chr(a) for a, b in spans) + f"]{{{min_letters},}}"
    return re.compile(run + (r"|[ऀ-ॣॱ-ॿ]{2,}|(?=([぀-ヿ㐀-䶿一-鿿]{2}))." if wide else ""))


def terms_of(text: str, pattern: re.Pattern) -> list[str]:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    found = pattern.finditer(text.lower()) if pattern.groups else pattern.findall(text.lower())
    return [m[1] or m[0] for m in found] if pattern.groups else found


_COUNTED = "id bigint, term string, tf int, n bigint"


def count_terms(df: DataFrame, id_col: str, text_col: str, min_letters: int, wide: bool, min_tf: int) -> DataFrame:
    """Rows with an id: counts of at least min_tf of a record; rows without: partial histogram entries."""
    one = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t")).where("id is not null").dropDuplicates(["id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = term_pattern(min_letters, wide)
        for b in batches:
            hist: Counter = Counter()
            ids, terms, tfs = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not t:
                    continue
                counts = Counter(terms_of(t, pattern))
                hist.update(counts.items())
                for term, n in counts.items():
                    if n >= min_tf:
                        ids.append(i)
                        terms.append(term)
                        tfs.append(n)
            k = len(ids)
            ids += [None] * len(hist)
            terms += [t for t, _ in hist]
            tfs += [n for _, n in hist]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.string()), pa.array(tfs, pa.int32()), pa.array([1] * k + list(hist.values()), pa.int64())], ["id", "term", "tf", "n"])

    return one.mapInArrow(run, _COUNTED)


def fit_two_poisson(tf: np.ndarray, n: np.ndarray, total: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(plain rate, elite rate, elite share) per row. ``tf``, ``n``: padded histograms (n = 0 pads), zeros left out; ``total`` records."""
    df = n.sum(1)
    zero = np.maximum(total - df, 0.0)
    mass = (tf * n).sum(1)
    mean_in = mass / np.maximum(df, 1)
    low = np.maximum(mass / max(total, 1) * 0.3, 1e-9)
    high = np.maximum(mean_in, 2 * low)
    share = np.clip(df / max(total, 1) * 0.5, 1e-9, 0.5)
    for _ in range(rounds):
        e, e0 = _posterior(tf, low, high, share), _posterior(np.zeros((len(tf), 1)), low, high, share)[:, 0]
        en = e * n
        elite = en.sum(1) + e0 * zero
        plain = np.maximum(df + zero - elite, 1e-12)
        high = np.maximum((en * tf).sum(1) / np.maximum(elite, 1e-12), 1e-9)
        low = np.maximum(((n - en) * tf).sum(1) / plain, 1e-9)
        share = np.clip(elite / max(total, 1), 1e-9, 1 - 1e-9)
    swap = low > high
    low, high, share = np.where(swap, high, low), np.where(swap, low, high), np.where(swap, 1 - share, share)
    return low, high, share


def _posterior(tf: np.ndarray, low: np.ndarray, high: np.ndarray, share: np.ndarray) -> np.ndarray:
    """P(elite | count) in logs; factorials cancel."""
    z = np.log(share / (1 - share))[:, None] + tf * np.log(high / low)[:, None] - (high - low)[:, None]
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def term_parameters(counted: DataFrame, total: int) -> DataFrame:
    """(term, df, low, high, share): one row a term."""
    hist = counted.where("id is null").groupBy("term", "tf").agg(F.sum("n").alias("n"))
    lists = hist.groupBy("term").agg(F.sum("n").alias("df"), F.collect_list("tf").alias("tfs"), F.collect_list("n").alias("ns"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if not len(p):
                continue
            width = max(map(len, p["tfs"]))
            tf, n = np.zeros((len(p), width)), np.zeros((len(p), width))
            for i, (a, b) in enumerate(zip(p["tfs"], p["ns"])):
                tf[i, : len(a)], n[i, : len(b)] = a, b
            low, high, share = fit_two_poisson(tf, n, total)
            yield pd.DataFrame({"term": p["term"], "df": p["df"], "low": low, "high": high, "share": share})

    return lists.mapInPandas(run, "term string, df bigint, low double, high double, share double")


def score_terms(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", min_letters: int = 3, wide: bool = True, min_tf: int = 1) -> DataFrame:
    """(id, term, tf, df, score) for every term of every record that has it at least min_tf times."""
    total = df.agg(F.count_distinct(id_col)).first()[0]
    counted = materialise(count_terms(df, id_col, text_col, min_letters, wide, min_tf), "term-counts")
    params = term_parameters(counted, total)
    if min_tf == 1:
        params = materialise(params, "term-params")
        if params.count() <= BROADCAST_TERMS:
            params = F.broadcast(params)
    z = F.log(F.col("share") / (1 - F.col("share"))) + F.col("tf") * F.log(F.col("high") / F.col("low")) - (F.col("high") - F.col("low"))
    kind = df.schema[id_col].dataType.simpleString()
    return counted.where("id is not null").join(params, "term").select(F.col("id").cast(kind).alias(id_col), "term", "tf", "df", (1 / (1 + F.exp(-z))).alias("score"))


def group_keywords(scores: DataFrame, groups: DataFrame, id_col: str, group_col: str, top: int = 5) -> DataFrame:
    """(group, keywords): the terms whose mean elite probability in the group most exceeds that in all records.

    ``groups`` gives each id its group; ids without scores count in the means. Sums are taken before any row meets another.
    """
    g = groups.select(id_col, group_col).where(F.col(group_col).isNotNull()).dropDuplicates([id_col])
    sizes = g.groupBy(group_col).agg(F.count(F.lit(1)).alias("size"))
    total = g.count()
    each = scores.join(g, id_col).groupBy(group_col, "term").agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("k"))
    every = each.groupBy("term").agg(F.sum("s").alias("all_s"))
    lift = F.col("s") / F.col("size") - (F.col("all_s") - F.col("s")) / F.greatest(F.lit(1), F.lit(total) - F.col("size"))
    ranked = each.where("k >= 2").join(sizes, group_col).join(every, "term").withColumn("lift", lift).where("lift > 0")
    best = ranked.withColumn("r", F.row_number().over(W.partitionBy(group_col).orderBy(F.desc("lift"), "term"))).where(F.col("r") <= top)
    return best.groupBy(group_col).agg(F.sort_array(F.collect_list(F.struct("r", "term"))).alias("k")).select(group_col, F.col("k.term").alias("keywords"))
