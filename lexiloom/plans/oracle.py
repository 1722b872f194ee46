"""DuckDB SQL for the queries of the catalogue that SQL can state."""

from __future__ import annotations

from ..functions.words import LANGUAGE_LETTERS, LANGUAGE_MARKERS, QUESTION_MARKERS, QUESTION_STARTS, STOPWORDS

CJK = "\\x{3040}-\\x{30ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}"
MARKS = "\\x{0300}-\\x{036f}\\x{0900}-\\x{0963}\\x{0966}-\\x{0dff}"
SPACE = "[\\t-\\r\\x1c-\\x20\\x{85}\\p{Z}]"


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def tokens(t: str) -> str:
    """Words and pairs of Han or kana, as in functions.text: runs of the latter are set apart first."""
    apart = f"regexp_replace(lower({t}), '([{CJK}]+)', ' \\1 ', 'g')"
    found = f"regexp_extract_all({apart}, '[{CJK}]+|[\\p{{L}}\\p{{N}}{MARKS}]+')"
    pairs = f"CASE WHEN regexp_full_match(w, '[{CJK}]{{2,}}') THEN list_transform(range(1, length(w)), lambda i: substr(w, i, 2)) ELSE [w] END"
    return f"flatten(list_transform({found}, lambda w: {pairs}))"


def content(t: str) -> str:
    return f"list_filter({tokens(t)}, lambda w: w NOT IN ({_quoted(sorted(STOPWORDS))}) AND (length(w) > 1 OR regexp_full_match(w, '[{CJK}]+')))"


def sentences(t: str) -> str:
    found = f"regexp_extract_all({t}, '(?m)[^.!?\\x{{0964}}\\x{{0965}}\\x{{3002}}\\x{{ff01}}\\x{{ff1f}}\\n]+(?:[.!?\\x{{0964}}\\x{{0965}}\\x{{3002}}\\x{{ff01}}\\x{{ff1f}}]+|$)')"
    return f"list_filter(list_transform({found}, lambda s: regexp_replace(s, '^{SPACE}+|{SPACE}+$', '', 'g')), lambda s: s <> '')"


def count(t: str, cls: str) -> str:
    return f"len(regexp_extract_all({t}, '{cls}'))"


CHUNKS = "one AS (SELECT chunk_id AS id, any_value(text) AS text FROM chunks GROUP BY chunk_id)"
QUESTIONS = "q0 AS (SELECT gap_id AS query_id, any_value(query_text) AS qt FROM gap_records WHERE gap_id % 100 = 0 GROUP BY gap_id)"
ASK = f"ask AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens('qt')}) AS term FROM q0) GROUP BY ALL)"
BM25 = f"""
terms AS (SELECT id, unnest({tokens("coalesce(text, '')")}) AS term FROM one),
post AS (SELECT id, term, count(*) AS tf FROM terms GROUP BY ALL),
dl AS (SELECT id, sum(tf) AS dl FROM post GROUP BY id),
n AS (SELECT (SELECT count(*) FROM one) AS n, (SELECT sum(tf) FROM post) AS total),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
rawidf AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df, n),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM rawidf) ELSE r END AS idf FROM rawidf)"""
SCORES = """
raw AS (SELECT query_id, id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (total / n)))) AS raw
  FROM ask JOIN idf USING (term) JOIN post USING (term) JOIN dl USING (id), n GROUP BY ALL)"""
TOP = "top AS (SELECT query_id, id AS chunk_id, round(raw, 6) AS raw, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 6) DESC, id) AS rank FROM raw)"

VECTORS = """
v0 AS (SELECT vec_id AS id, any_value(embedding)::DOUBLE[] AS v FROM vectors GROUP BY vec_id),
v AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS len FROM v0
  WHERE len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0)"""

_LETTERS = {k: v for k, v in LANGUAGE_LETTERS.items()}


def _lang() -> str:
    t = "qt"
    low = f"lower({t})"
    words = f"regexp_extract_all({low}, '\\p{{L}}+')"
    score = []
    for lang, marks in LANGUAGE_MARKERS.items():
        extra = f" + 2 * {count(low, '[' + _LETTERS[lang] + ']')}" if lang in _LETTERS else ""
        score.append(f"len(list_filter({words}, lambda w: w IN ({_quoted(marks.split())}))){extra} AS s_{lang}")
    cols = [f"s_{k}" for k in LANGUAGE_MARKERS]
    best = f"greatest({', '.join(cols)})"
    second = f"list_reverse_sort([{', '.join(cols)}])[2]"
    pick = "CASE " + " ".join(f"WHEN s_{k} = {best} THEN '{k}'" for k in LANGUAGE_MARKERS) + " END"
    latin = f"CASE WHEN {best} >= 1 AND {best} > {second} THEN {pick} END"
    return f"""
WITH g AS (SELECT gap_id, any_value(query_text) AS qt FROM gap_records WHERE query_text IS NOT NULL GROUP BY gap_id),
c AS (SELECT gap_id, {', '.join(score)},
  {count(t, '[\\x{0900}-\\x{097f}]')} AS deva, {count(t, '[\\x{3040}-\\x{30ff}]')} AS kana, {count(t, '[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}]')} AS han,
  {count(t, '[\\x{0400}-\\x{04ff}]')} AS cyr, len(list_filter(regexp_extract_all({t}, '\\p{{L}}'), lambda x: unicode(x) < 592)) AS latin FROM g),
r AS (SELECT gap_id, CASE WHEN kana > 0 THEN 'ja' WHEN han > 0 AND han * 5 >= greatest(cyr, latin) THEN 'zh' WHEN deva > 0 AND deva > latin THEN 'hi'
  WHEN cyr > 0 AND cyr > latin THEN 'ru' WHEN latin > 0 THEN {latin} END AS confident FROM c)
SELECT gap_id, confident, coalesce(confident, 'en') AS language FROM r"""


def _script() -> str:
    letters = "list_transform(regexp_extract_all(text, '\\p{L}'), lambda x: unicode(x))"
    n = lambda cond: f"len(list_filter(l, lambda x: {cond}))"
    return f"""
WITH d AS (SELECT doc_id, {letters} AS l FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, {n('x < 592')} AS latin, {n('x BETWEEN 1024 AND 1279')} AS cyrillic, {n('x BETWEEN 13312 AND 19903 OR x BETWEEN 19968 AND 40959')} AS han,
  {n('x BETWEEN 2304 AND 2431')} AS devanagari, {n('x BETWEEN 12352 AND 12543')} AS kana FROM d)
SELECT doc_id, CASE WHEN kana >= 2 THEN 'japanese' WHEN greatest(latin, cyrillic, han, devanagari) = 0 THEN NULL
  WHEN latin = greatest(latin, cyrillic, han, devanagari) THEN 'latin' WHEN cyrillic = greatest(latin, cyrillic, han, devanagari) THEN 'cyrillic'
  WHEN han = greatest(latin, cyrillic, han, devanagari) THEN 'han' ELSE 'devanagari' END AS script FROM c"""


def _intent() -> str:
    s = f"lower(regexp_replace(qt, '^{SPACE}+|{SPACE}+$', '', 'g'))"
    starts = " OR ".join(f"starts_with({s}, '{q}')" for q in QUESTION_STARTS)
    return f"""
WITH g AS (SELECT gap_id, any_value(query_text) AS qt FROM gap_records WHERE query_text IS NOT NULL GROUP BY gap_id),
i AS (SELECT gap_id, qt, (regexp_matches({s}, '[?？]$') OR {starts} OR regexp_matches({s}, '{'|'.join(QUESTION_MARKERS)}')) AS question FROM g)
SELECT gap_id, question, question AND NOT regexp_matches(qt, '\\d\\s*(?:[-+*/×÷^]|%)\\s*\\S|\\d+(?:[.,]\\d+)?\\s*%') AND len(list_distinct({content('qt')})) >= 2 AS knowledge FROM i"""


SEGMENTS = "s AS (SELECT DISTINCT ON (segment_id) * FROM transcript_segments WHERE media_id IS NOT NULL ORDER BY segment_id)"
FRAMES = "k AS (SELECT DISTINCT ON (keyframe_id) * FROM keyframes WHERE media_id IS NOT NULL AND ts_sec IS NOT NULL ORDER BY keyframe_id)"
GAPS = f"""
e AS (SELECT gap_id, any_value(regexp_replace(query_text, '^{SPACE}+|{SPACE}+$', '', 'g')) AS query, any_value(confidence) AS confidence, any_value(last_seen) AS ts, any_value(coalesce(hit_count, 1)) AS hits FROM gap_records GROUP BY gap_id),
g AS (SELECT arg_min(query, struct_pack(a := ts, b := query)) AS query, round(min(confidence), 4) AS confidence, CAST(sum(hits) AS BIGINT) AS count, max(ts) AS last_seen FROM e WHERE query <> '' AND confidence < 0.3 GROUP BY lower(query))"""

ORACLE: dict[str, str] = {
    "list_chunks": "SELECT DISTINCT chunk_id, source_name AS source, CAST(length(text) AS INTEGER) AS characters, CAST(0 AS DOUBLE) AS score FROM chunks",
    "chunk_lookup": "SELECT DISTINCT chunk_id, source_name, text FROM chunks WHERE chunk_id = 42",
    "distinct_sources": "SELECT DISTINCT source_name FROM chunks WHERE source_name IS NOT NULL",
    "unseen_sources": "SELECT DISTINCT source AS source_name FROM documents WHERE source IS NOT NULL AND source NOT IN (SELECT source_name FROM chunks WHERE source_name IS NOT NULL)",
    "chunk_previews": f"""
WITH {CHUNKS}, p AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(text, '[#*_`>|]+', ' ', 'g'), '{SPACE}+', ' ', 'g'), '^{SPACE}+|{SPACE}+$', '', 'g') AS c FROM one WHERE text IS NOT NULL)
SELECT id AS chunk_id, CASE WHEN length(c) <= 160 THEN c ELSE regexp_replace(substr(c, 1, 159), '{SPACE}+$', '') || '…' END AS preview FROM p""",
    "token_counts": f"WITH t AS (SELECT doc_id, {tokens(chr(34) + 'text' + chr(34))} AS t FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)) SELECT doc_id, CAST(len(t) AS INTEGER) AS tokens, CAST(len(list_distinct(t)) AS INTEGER) AS distinct_tokens FROM t",
    "term_frequencies": f"WITH one AS (SELECT doc_id AS id, text FROM documents), {BM25} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "sentence_counts": f"WITH s AS (SELECT doc_id, {sentences(chr(34) + 'text' + chr(34))} AS s FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)) SELECT doc_id, CAST(len(s) AS INTEGER) AS sentences, CAST(coalesce(length(array_to_string(s, '')), 0) AS INTEGER) AS characters FROM s",
    "detected_language": _lang(),
    "dominant_script": _script(),
    "question_intent": _intent(),
    "bm25_topk": f"WITH {CHUNKS}, {QUESTIONS}, {ASK}, {BM25}, {SCORES}, {TOP} SELECT query_id, chunk_id, raw, CAST(rank AS INTEGER) AS rank FROM top WHERE rank <= 10",
    "bm25_relative_cut": f"""WITH {CHUNKS}, {QUESTIONS}, {ASK}, {BM25}, {SCORES}, {TOP}, ten AS (SELECT *, max(raw) OVER (PARTITION BY query_id) AS best FROM top WHERE rank <= 10)
SELECT query_id, chunk_id, raw FROM ten WHERE raw >= 0.5 * best OR rank = 1""",
    "multi_query_merge": f"""
WITH {CHUNKS}, t AS (SELECT turn_id, any_value(queries) AS qs FROM turn_insights WHERE turn_id % 100 = 0 GROUP BY turn_id),
q0 AS (SELECT turn_id * 1000 + i - 1 AS query_id, turn_id AS group_id, qs[i] AS qt FROM (SELECT turn_id, qs, unnest(range(1, len(qs) + 1)) AS i FROM t) WHERE qs[i] IS NOT NULL AND trim(qs[i]) <> ''),
{ASK}, {BM25}, {SCORES}, {TOP}, best AS (SELECT group_id, chunk_id, max(raw) AS score FROM top JOIN q0 USING (query_id) WHERE rank <= 5 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, chunk_id) AS rank FROM best)
SELECT group_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""",
    "hybrid_topk": f"""
WITH {CHUNKS}, q0 AS (SELECT id AS query_id, text AS qt FROM one WHERE id % 100 = 0), {ASK}, {BM25}, {SCORES}, {VECTORS},
cos AS (SELECT a.id AS query_id, b.id, round(list_sum(list_transform(range(1, 65), lambda i: a.v[i] * b.v[i])) / (a.len * b.len), 9) AS s FROM v a, v b WHERE a.id % 100 = 0),
near AS (SELECT query_id, id, round(s, 6) AS vector FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM cos) WHERE r <= 40),
top0 AS (SELECT query_id, CASE WHEN count(*) < (SELECT n FROM n) THEN greatest(max(raw), 0) ELSE max(raw) END AS m FROM raw GROUP BY query_id),
lex AS (SELECT query_id, id, round(raw / CASE WHEN m = 0 THEN 1 ELSE m END, 6) AS lexical FROM raw JOIN top0 USING (query_id)),
f AS (SELECT query_id, id, 0.65 * coalesce(vector, 0) + 0.35 * coalesce(lexical, 0) AS score FROM near FULL JOIN lex USING (query_id, id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f)
SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(score, 5) AS score FROM r WHERE rank <= 10""",
    "knn_exact": f"""
WITH {VECTORS}, cos AS (SELECT a.id AS query_id, b.id, list_sum(list_transform(range(1, 65), lambda i: a.v[i] * b.v[i])) / (a.len * b.len) AS s FROM v a, v b WHERE a.id % 100 = 0 AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS rank FROM cos)
SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(s, 6) AS score FROM r WHERE rank <= 10""",
    "cluster_summary": """
WITH o AS (SELECT vec_id, any_value(cluster_id) AS cluster_id, any_value(map_x) AS x, any_value(map_y) AS y FROM vectors GROUP BY vec_id)
SELECT cluster_id, count(*) AS size, round(avg(x), 4) AS x, round(avg(y), 4) AS y FROM o WHERE cluster_id IS NOT NULL GROUP BY cluster_id""",
    "topic_chips": """
WITH o AS (SELECT vec_id, any_value(cluster_id) AS cluster_id FROM vectors GROUP BY vec_id), n AS (SELECT cluster_id, count(*) AS size FROM o WHERE cluster_id IS NOT NULL GROUP BY cluster_id)
SELECT n.cluster_id, size, array_to_string(keywords, ' · ') AS chip FROM n LEFT JOIN map_clusters USING (cluster_id)""",
    "embedding_covariance": """
WITH x AS (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings), p AS (SELECT a.i - 1 AS i, b.i - 1 AS j, covar_samp(a.x, b.x) AS c FROM x a JOIN x b USING (vec_id) GROUP BY ALL)
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(c, 6) + 0.0 AS c FROM p""",
    "nearest_label": """
WITH x AS (SELECT vec_id, label, unnest(range(1, 65)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings), c AS (SELECT label, i, avg(x) AS c FROM x GROUP BY ALL),
d AS (SELECT vec_id, c.label, sqrt(sum((x - c) * (x - c))) AS d FROM x JOIN c USING (i) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, label) AS r FROM d)
SELECT vec_id AS id, CAST(label AS INTEGER) AS label, round(d, 5) AS distance FROM r WHERE r = 1""",
    "label_silhouette": """
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT a.vec_id, a.label AS own, b.label, b.vec_id AS other, sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))) AS d FROM e a, e b),
m AS (SELECT vec_id, own, label, sum(d) AS s, count(*) AS n FROM d GROUP BY ALL),
ab AS (SELECT vec_id, max(CASE WHEN own = label THEN n END) AS n, max(CASE WHEN own = label THEN s / greatest(n - 1, 1) END) AS a, min(CASE WHEN own <> label THEN s / n END) AS b FROM m GROUP BY vec_id)
SELECT round(avg(CASE WHEN n > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette FROM ab""",
    "language_keywords": f"""
WITH RECURSIVE d AS (SELECT lang, unnest({content('text')}) AS term FROM documents WHERE lang IS NOT NULL),
n AS (SELECT lang, term, count(*) AS n FROM d WHERE NOT regexp_full_match(term, '\\p{{Nd}}+') GROUP BY ALL), total AS (SELECT lang, sum(n) AS total FROM n GROUP BY lang),
o AS (SELECT term, sum(n) AS all_n, count(*) AS classes FROM n GROUP BY term), c AS (SELECT avg(total) AS words, count(*) AS labels FROM total),
s AS (SELECT lang, term, n / total * ln(1 + words / all_n) AS score, classes = labels AND labels > 1 AS common FROM n JOIN total USING (lang) JOIN o USING (term), c),
r AS (SELECT lang, term, score, CASE WHEN regexp_full_match(term, '[{CJK}]+') THEN string_split(term, '') ELSE [] END AS signs, row_number() OVER (PARTITION BY lang ORDER BY common, round(score, 12) DESC, term) AS r FROM s QUALIFY r <= 250),
p AS (SELECT lang, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS rank, CAST('' AS VARCHAR) AS term, CAST(0 AS DOUBLE) AS score, CAST([] AS VARCHAR[]) AS used FROM total
  UNION ALL SELECT p.lang, r.r, CASE WHEN NOT list_has_any(r.signs, p.used) THEN p.rank + 1 ELSE p.rank END, CASE WHEN NOT list_has_any(r.signs, p.used) THEN r.term END, r.score, CASE WHEN NOT list_has_any(r.signs, p.used) THEN list_concat(p.used, r.signs) ELSE p.used END
  FROM p JOIN r ON p.lang = r.lang AND r.r = p.r + 1 WHERE p.rank < 5)
SELECT lang, CAST(rank AS INTEGER) AS rank, term, round(score, 6) AS score FROM p WHERE term IS NOT NULL AND rank > 0""",
    "lexical_grounding": f"""
WITH a AS (SELECT transcript_id, any_value(media_id) AS media_id, any_value(text) AS t FROM transcripts WHERE text IS NOT NULL AND media_id IS NOT NULL GROUP BY transcript_id),
st AS (SELECT transcript_id, media_id, {sentences('t')} AS l FROM a),
s0 AS (SELECT transcript_id, media_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS s FROM st), s1 AS (SELECT *, {content('s')} AS w FROM s0), s AS (SELECT *, list_distinct(w) AS u FROM s1 WHERE len(w) > 0),
k AS (SELECT keyframe_id, any_value(media_id) AS media_id, any_value(frame_index) AS rank, any_value(ocr_text) AS t FROM keyframes WHERE ocr_text IS NOT NULL GROUP BY keyframe_id), p AS (SELECT media_id, rank, list_distinct({content('t')}) AS u FROM k),
x AS (SELECT transcript_id, i, max(len(list_intersect(s.u, p.u))) AS n FROM s JOIN p USING (media_id) GROUP BY ALL),
g AS (SELECT s.transcript_id, sum(coalesce(n, 0) / len(u) * len(w)) / sum(len(w)) AS raw FROM s LEFT JOIN x ON s.transcript_id = x.transcript_id AND s.i = x.i GROUP BY s.transcript_id)
SELECT transcript_id AS turn_id, round(raw, 4) AS score, CASE WHEN raw >= 0.6 THEN 'high' WHEN raw >= 0.35 THEN 'medium' ELSE 'low' END AS level FROM g""",
    "gap_ranking": f"WITH {GAPS} SELECT query, confidence, count, last_seen FROM g ORDER BY count DESC, last_seen DESC, query LIMIT 200",
    "gap_stream": f"WITH {GAPS} SELECT query, confidence, count, last_seen FROM g",
    "line_totals": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * l_quantity, 2) AS total FROM lineitem",
    "conversation_window": """
WITH t AS (SELECT turn_id, any_value(session_id) AS session_id, any_value(asked_at) AS asked_at FROM turn_insights WHERE session_id IS NOT NULL GROUP BY turn_id)
SELECT session_id, turn_id FROM t QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY asked_at DESC, turn_id DESC) <= 2""",
    "silence_turns": f"""
WITH {SEGMENTS}, f AS (SELECT media_id, segment_id, start_sec, CASE WHEN start_sec - lag(end_sec) OVER w > 1.2 THEN 1 ELSE 0 END AS f FROM s WHERE start_sec IS NOT NULL AND end_sec IS NOT NULL WINDOW w AS (PARTITION BY media_id ORDER BY start_sec, segment_id))
SELECT media_id, segment_id, CAST(sum(f) OVER (PARTITION BY media_id ORDER BY start_sec, segment_id ROWS UNBOUNDED PRECEDING) % 2 AS INTEGER) AS turn_speaker FROM f""",
    "scene_ends": f"WITH {FRAMES} SELECT media_id, keyframe_id, coalesce(lead(ts_sec) OVER (PARTITION BY media_id ORDER BY ts_sec, keyframe_id), ts_sec) AS scene_end FROM k",
    "speech_in_scenes": f"""
WITH {SEGMENTS}, {FRAMES}, m AS (SELECT media_id, segment_id, (start_sec + end_sec) / 2 AS mid FROM s WHERE start_sec IS NOT NULL AND end_sec IS NOT NULL),
j AS (SELECT m.media_id, segment_id, keyframe_id, ts_sec FROM m JOIN k ON m.media_id = k.media_id AND ts_sec <= mid AND mid < greatest(coalesce(k.end_sec, ts_sec), ts_sec + 1e-6) WHERE ocr_text <> '')
SELECT media_id, segment_id, keyframe_id FROM j QUALIFY row_number() OVER (PARTITION BY media_id, segment_id ORDER BY ts_sec, keyframe_id) = 1""",
    "pricing_summary": """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS gross, round(avg(l_discount), 6) AS discount, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
    "customer_orders": "SELECT c_custkey, count(o_orderkey) AS orders, coalesce(round(sum(o_totalprice), 2), 0) AS spent FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "nation_revenue": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "event_windows": "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "event_sessions": """
WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS f FROM events), g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM g GROUP BY user_id, k""",
    "event_properties": "SELECT event_type, CAST(sum(k) AS BIGINT) AS total, count(k) AS n FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type",
}

_SQ8 = f"""
WITH {VECTORS}, u AS (SELECT id, list_transform(v, lambda x: x / len) AS u FROM v), sc AS (SELECT id, u, list_max(list_transform(u, lambda x: abs(x))) / 127 AS s FROM u),
c AS (SELECT id, list_transform(u, lambda x: round_even(x / s, 0)) AS c FROM sc), cl AS (SELECT id, c, 1 / sqrt(list_sum(list_transform(c, lambda x: x * x))) AS inv FROM c),
sq AS (SELECT q.id AS query_id, b.id, least(1, greatest(-1, list_sum(list_transform(range(1, 65), lambda i: q.u[i] * b.c[i])) * inv)) AS s FROM u q, cl b WHERE q.id % 100 = 0 AND q.id <> b.id),
sr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS rank FROM sq)"""
ORACLE["knn_sq8"] = _SQ8 + " SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(s, 6) AS score FROM sr WHERE rank <= 10"
ORACLE["sq8_recall"] = _SQ8 + """,
cos AS (SELECT a.id AS query_id, b.id, list_sum(list_transform(range(1, 65), lambda i: a.v[i] * b.v[i])) / (a.len * b.len) AS s FROM v a, v b WHERE a.id % 100 = 0 AND a.id <> b.id),
er AS (SELECT query_id, id FROM cos QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) <= 10)
SELECT er.query_id, count(sr.id) / 10 AS recall FROM er LEFT JOIN sr ON er.query_id = sr.query_id AND er.id = sr.id AND rank <= 10 GROUP BY er.query_id"""

_EXACT = f"""
WITH {VECTORS}, cos AS (SELECT a.id AS query_id, b.id, list_sum(list_transform(range(1, 65), lambda i: a.v[i] * b.v[i])) / (a.len * b.len) AS s FROM v a, v b WHERE a.id % 100 = 0 AND a.id <> b.id),
ten AS (SELECT query_id, id FROM cos QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) <= 10)"""
# an approximate search owes a share of the neighbours that SQL counts
for _q in ("cells_recall", "graph_recall", "pq_recall", "pq_reranked_recall"):
    ORACLE[_q] = _EXACT + " SELECT count(DISTINCT query_id) AS queries, count(*) AS neighbours, TRUE AS reached FROM ten"
ORACLE["beam_sweep"] = _EXACT + " SELECT CAST(beam AS INTEGER) AS beam, count(DISTINCT query_id) AS queries, TRUE AS no_worse FROM ten, (SELECT unnest([10, 50, 150, 400]) AS beam) GROUP BY beam"

_PAIRS = f"""
w AS (SELECT key, list_distinct({content('query')}) AS w, count FROM (SELECT lower(query) AS key, query, count FROM g)), ws AS (SELECT * FROM w WHERE len(w) > 0),
up AS (SELECT a.key, b.key AS other, b.count AS weight, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS j FROM ws a JOIN ws b ON a.key <> b.key AND (b.count > a.count OR b.count = a.count AND b.key < a.key) WHERE list_has_any(a.w, b.w)),
near AS (SELECT key, other FROM up WHERE j >= 0.6 QUALIFY row_number() OVER (PARTITION BY key ORDER BY weight DESC, j DESC, other DESC) = 1),
walk AS (SELECT key, other AS canonical FROM near UNION ALL SELECT walk.key, near.other FROM walk JOIN near ON walk.canonical = near.key),
root AS (SELECT key, canonical FROM walk WHERE canonical NOT IN (SELECT key FROM near)),
m AS (SELECT w.key, coalesce(root.canonical, w.key) AS canonical FROM w LEFT JOIN root USING (key))"""
ORACLE["merged_gaps"] = f"WITH RECURSIVE {GAPS}, {_PAIRS} SELECT m.key, canonical, w.count FROM m JOIN w USING (key)"
ORACLE["joined_gaps"] = f"WITH RECURSIVE {GAPS}, {_PAIRS} SELECT canonical AS key, min(confidence) AS confidence, CAST(sum(g.count) AS BIGINT) AS count, max(last_seen) AS last_seen FROM m JOIN g ON m.key = lower(g.query) GROUP BY canonical"
ORACLE["gap_record"] = f"""
WITH RECURSIVE {GAPS}, {_PAIRS}, j AS (SELECT canonical AS key, min(confidence) AS confidence, CAST(sum(g.count) AS BIGINT) AS count, max(last_seen) AS last_seen FROM m JOIN g ON m.key = lower(g.query) GROUP BY canonical)
SELECT j.key, j.confidence, j.count, j.last_seen FROM j JOIN g ON j.key = lower(g.query) ORDER BY j.count DESC, j.last_seen DESC, g.query LIMIT 200"""

# sections: each begins before the first segment that would end later than a minute after the section's start
_SECTIONS = """
o AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_sec, segment_id) AS k FROM said),
st AS (SELECT media_id, k, start_sec AS first, CAST(0 AS BIGINT) AS section FROM o WHERE k = 1
  UNION ALL SELECT o.media_id, o.k, CASE WHEN o.end_sec - st.first > 60 THEN o.start_sec ELSE st.first END, CASE WHEN o.end_sec - st.first > 60 THEN st.section + 1 ELSE st.section END FROM st JOIN o ON o.media_id = st.media_id AND o.k = st.k + 1),
sec AS (SELECT o.*, st.section FROM o JOIN st USING (media_id, k))"""
_SAID = "said AS (SELECT media_id, segment_id, start_sec, end_sec, coalesce(text, '') AS text FROM s WHERE start_sec IS NOT NULL AND end_sec IS NOT NULL"
ORACLE["speech_sections"] = f"WITH RECURSIVE {SEGMENTS}, {_SAID}), {_SECTIONS} SELECT media_id, CAST(section AS INTEGER) AS section, segment_id FROM sec"
_INSIDE = """inside AS (SELECT s.media_id, segment_id, keyframe_id FROM s JOIN k ON s.media_id = k.media_id AND ts_sec <= (start_sec + s.end_sec) / 2 AND (start_sec + s.end_sec) / 2 < greatest(coalesce(k.end_sec, ts_sec), ts_sec + 1e-6)
  WHERE ocr_text <> '' AND start_sec IS NOT NULL AND s.end_sec IS NOT NULL QUALIFY row_number() OVER (PARTITION BY s.media_id, segment_id ORDER BY ts_sec, keyframe_id) = 1)"""
ORACLE["timeline_sections"] = f"""
WITH RECURSIVE {SEGMENTS}, {FRAMES}, {_INSIDE}, {_SAID} AND segment_id NOT IN (SELECT segment_id FROM inside)), {_SECTIONS},
shown AS (SELECT i.keyframe_id, string_agg(coalesce(s.text, ''), ' ' ORDER BY start_sec, s.segment_id) AS speech FROM inside i JOIN s ON s.segment_id = i.segment_id GROUP BY i.keyframe_id)
SELECT media_id, ts_sec AS start, coalesce(end_sec, ts_sec) AS "end", ocr_text AS on_screen, coalesce(speech, '') AS speech FROM k LEFT JOIN shown USING (keyframe_id) WHERE ocr_text <> ''
UNION ALL SELECT media_id, min(start_sec), arg_max(end_sec, struct_pack(a := start_sec, b := segment_id)), '', string_agg(text, ' ' ORDER BY start_sec, segment_id) FROM sec GROUP BY media_id, section"""

# coverage of a question by a passage: words in any inflection, Han and kana sign by sign
_STOP = _quoted(sorted(STOPWORDS))
_COVER = f"""
qp AS (SELECT top.query_id, lower(qt) AS q, one.text AS p FROM top JOIN q0 USING (query_id) JOIN one ON one.id = top.chunk_id WHERE top.rank = 1),
t AS (SELECT query_id, list_distinct({tokens('p')}) AS there, {content('q')} AS words, regexp_extract_all(q, '[{CJK}]+') AS runs FROM qp),
w AS (SELECT query_id, unnest(list_filter(words, lambda w: NOT regexp_full_match(w, '[{CJK}]+'))) AS w, there FROM t),
wm AS (SELECT query_id, list_contains(there, w) OR (length(w) >= 4 AND regexp_full_match(w, '\\p{{L}}+') AND len(list_filter(there, lambda o: length(o) >= 4 AND o[1:4] = w[1:4] AND len(list_filter(range(1, least(length(o), length(w)) + 1), lambda i: o[1:i] = w[1:i])) >= 0.75 * least(length(o), length(w)))) > 0) AS hit FROM w),
ru AS (SELECT query_id, there, unnest(runs) AS run FROM t), ch AS (SELECT query_id, there, run, unnest(range(1, length(run) + 1)) AS i FROM ru),
cp AS (SELECT query_id, there, run, i, list_filter([CASE WHEN i > 1 THEN run[i - 1:i] END, CASE WHEN i < length(run) THEN run[i:i + 1] END], lambda x: x IS NOT NULL) AS pairs FROM ch),
cm AS (SELECT query_id, CASE WHEN length(run) = 1 THEN list_contains(there, run[i:i]) ELSE list_has_any(there, pairs) END AS hit FROM cp WHERE run[i:i] NOT IN ({_STOP}) AND len(list_filter(pairs, lambda x: x IN ({_STOP}))) = 0),
hits AS (SELECT query_id, hit FROM wm UNION ALL SELECT query_id, hit FROM cm), cov AS (SELECT query_id, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS c FROM hits GROUP BY query_id)"""
ORACLE["question_coverage"] = f"WITH {CHUNKS}, {QUESTIONS}, {ASK}, {BM25}, {SCORES}, {TOP}, {_COVER} SELECT qp.query_id, round(coalesce(c, 0), 6) AS coverage FROM qp LEFT JOIN cov USING (query_id)"
