"""DuckDB SQL that gives the rows of registered queries, written from their contracts."""

from __future__ import annotations

from .secret_scan import RULES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_DEDUP = f"""
WITH t AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS norm FROM documents),
     g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""

JACCARD_JOIN = f"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS node FROM documents UNION SELECT r.doc_id, ways.y FROM r JOIN ways ON r.node = ways.x),
k AS (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id)
SELECT k.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, k.component_id FROM k LEFT JOIN n ON k.doc_id = n.doc_id
"""

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 100)) AS k
      FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS s FROM d)),
f AS (SELECT k, min(doc_id) AS least FROM w GROUP BY k),
g AS (SELECT w.doc_id, w.s FROM w JOIN f ON w.k = f.k WHERE f.least < w.doc_id),
o AS (SELECT doc_id, s, coalesce(s > lag(s + 50) OVER (PARTITION BY doc_id ORDER BY s), TRUE) AS first FROM g),
r AS (SELECT doc_id, s, sum(CAST(first AS INT)) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM o),
spans AS (SELECT doc_id, run, min(s) AS a, max(s) + 50 AS b FROM r GROUP BY doc_id, run),
kept AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN starts IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(starts) + 1), lambda i:
           substr(h, CAST(2 * (CASE WHEN i = 0 THEN 0 ELSE ends[i] END) + 1 AS BIGINT), CAST(2 * ((CASE WHEN i = len(starts) THEN len(h) // 2 ELSE starts[i + 1] END) - (CASE WHEN i = 0 THEN 0 ELSE ends[i] END)) AS BIGINT))), '') END)) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secret_scan() -> str:
    found = "\nUNION ALL\n".join(
        f"SELECT doc_id, '{r.kind}' AS kind, {i} AS rank, {r.least} AS least, string_split_regex(text, {_quoted(r.pattern)}) AS gaps, "
        f"regexp_extract_all(text, {_quoted(r.pattern)}, 0) AS whole, regexp_extract_all(text, {_quoted(r.pattern)}, {r.group}) AS val FROM d"
        for i, r in enumerate(RULES)
    )
    base = ", ".join(f"'{r.kind}'" for r in RULES if r.base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({found}),
p AS (SELECT doc_id, kind, rank, least, unnest(range(1, len(whole) + 1)) AS i, gaps, whole, val FROM m),
s AS (SELECT doc_id, kind, rank,
        CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a,
        length(whole[i]) AS n FROM p WHERE length(val[i]) >= least),
t AS (SELECT doc_id, kind, rank, a, kind || ':' || a || ':' || (a + n) AS tag FROM s),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(tag, ',' ORDER BY a, rank) FILTER (kind IN ({base})) AS base, string_agg(tag, ',' ORDER BY a, rank) AS spans FROM t GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""


SECRET_SCAN = _secret_scan()

POISSON_MIXING = """
WITH RECURSIVE n AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
rates AS (SELECT s, CAST(1 AS DOUBLE) / (SELECT CAST(count(*) AS DOUBLE) FROM n) * (SELECT CAST(sum(n) AS DOUBLE) FROM n) / n AS rate FROM n),
steps AS (SELECT s, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf FROM rates
    UNION ALL SELECT s, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM steps WHERE k < ceil(rate + 12 * sqrt(rate) + 40)),
u AS (SELECT *, (CAST(CAST('0x' || substr(md5('17:count:' || doc_id), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496 AS draw FROM documents),
c AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, any_value(steps.rate) AS rate, count(*) FILTER (u.draw > steps.cdf) AS times
      FROM u JOIN steps ON coalesce(u.source, '') = steps.s GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, rate, CAST(unnest(range(0, times)) AS INTEGER) AS copy FROM c WHERE times > 0
"""
