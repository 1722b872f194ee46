"""DuckDB SQL for those pN_ queries that SQL can state on whole tables."""

from __future__ import annotations

_P7 = r"""
WITH one AS (SELECT DISTINCT chunk_id, source_name, text FROM chunks WHERE text IS NOT NULL),
lim AS (
  SELECT o.*, coalesce(l.max_chars, (SELECT max_chars FROM chunk_limits WHERE suffix = 'default')) AS m
  FROM one o LEFT JOIN chunk_limits l ON l.suffix <> 'default' AND l.suffix = lower(regexp_extract(trim(coalesce(o.source_name, '')), '\.([^.\s/]+)$', 1))),
big AS (SELECT * FROM lim WHERE length(text) > m),
runs AS (SELECT chunk_id, m, regexp_split_to_array(text, '[ \t\n\r.!?;,:。！？；，、।]') AS parts FROM big),
flat AS (
  SELECT chunk_id, m, parts, unnest(range(1, len(parts) + 1)) AS i FROM runs),
hard AS (
  SELECT chunk_id, i - 1 + coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x))), 0) AS hard_start
  FROM flat WHERE length(parts[i]) > m)
SELECT chunk_id, CAST(hard_start AS INTEGER) AS hard_start FROM hard
UNION ALL
SELECT DISTINCT chunk_id, CAST(-1 AS INTEGER) FROM big WHERE chunk_id NOT IN (SELECT chunk_id FROM hard)
"""


_P3 = r"""
WITH one AS (SELECT DISTINCT chunk_id, nfc_normalize(text) AS t FROM chunks WHERE text IS NOT NULL),
words AS (SELECT chunk_id, unnest(regexp_extract_all(lower(t), '[\p{Latin}\p{Cyrillic}]{5,}')) AS term FROM one),
tf AS (SELECT chunk_id, term, count(*) AS n FROM words GROUP BY ALL),
df AS (SELECT term, count(*) AS d FROM tf GROUP BY ALL)
SELECT chunk_id, term FROM tf JOIN df USING (term) WHERE n >= 3 AND d <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"p3_found": _P3, "p7_found": _P7}
