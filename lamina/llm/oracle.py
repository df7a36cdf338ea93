"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .licenses import DRIFT, GRAM, LEAST_SCORE, PHRASES, STRETCH, TEMPLATES
from .quality import HOST_LIMIT, MIN_WORDS, REPEAT_PERCENT

_QUALITY = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
win AS (
  SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(0, 8)) AS j) GROUP BY rid),
lines AS (SELECT rid, l FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d)
          WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY rid),
m AS (
  SELECT d.rid, doc_id, source, len(ws)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid)),
f AS (
  SELECT *, (n_words < {MIN_WORDS})::INT AS f1, (100 * n_repeat_words > {REPEAT_PERCENT} * n_words)::INT AS f2,
         (n_words > 0 AND 10 * n_symbols > n_words)::INT AS f3
  FROM m),
host AS (SELECT source, count(*)::DOUBLE AS n, r, sum(f) AS k FROM (
    SELECT source, unnest([1, 2, 3]) AS r, unnest([f1, f2, f3]) AS f FROM f) GROUP BY source, r),
moments AS (SELECT r, sum(k) / sum(n) AS mean, greatest(sum(k * k / n) / sum(n) - (sum(k) / sum(n)) ** 2, 0) AS v FROM host GROUP BY r),
prior AS (SELECT r, mean, CASE WHEN v > 1e-12 THEN least(greatest(mean * (1 - mean) / v - 1, 1), 10000) ELSE 10000 END AS w FROM moments),
bad AS (SELECT DISTINCT source FROM host JOIN prior USING (r) WHERE (k + w * mean) / (n + w) >= {HOST_LIMIT})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (f1 = 1 OR f2 = 1) AS base_failed,
       NOT (f1 = 1 OR f2 = 1) AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM f.source) AS kept
FROM f
"""

_URLS = r"""
WITH rules(verdict, rh, rp) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'),
  ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
p AS (
  SELECT row_number() OVER () AS rid, page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
best AS (
  SELECT rid, max({'n': length(rh || rp), 'k': rh || rp, 'v': verdict}) AS b
  FROM p, rules WHERE (host = rh OR host LIKE '%.' || rh) AND path LIKE rp || '%' GROUP BY rid)
SELECT page_id, host, path, b.k AS rule, coalesce(b.v, 'allow') AS verdict FROM p LEFT JOIN best USING (rid)
"""

_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS b FROM pages),
g AS (SELECT page_id, strlen(b)::BIGINT AS payload_bytes, sha1(b) AS h,
             min(page_id) OVER (PARTITION BY b) AS first FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                ((('0x' || substr(h, (i // 4 * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM g
"""

_DECONTAMINATION = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
w AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM w),
g AS (
  SELECT rid, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT rid, ws, n, unnest(range(1, (len(ws) - n + 2)::BIGINT)) AS i FROM d, sizes WHERE len(ws) >= n)),
hit AS (SELECT rid, i, g.n, item_id FROM g JOIN w USING (n, g)),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) AS n, string_agg(x, ',' ORDER BY x) AS l FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM hit) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items.l, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)
"""

_JACCARD = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT rid, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
c AS (SELECT x.rid AS a, y.rid AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.rid < y.rid GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON p.rid = a JOIN n q ON q.rid = b WHERE 100 * m >= 80 * (p.n + q.n - m)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, min(o.doc_id)) AS component_id
FROM d LEFT JOIN n USING (rid) LEFT JOIN reach ON reach.a = d.rid LEFT JOIN d o ON o.rid = reach.b
GROUP BY d.rid, d.doc_id, n.n
"""

_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_KNOWN = ", ".join(f"({i}, '{label}', {phrase}, '{text}')" for i, (label, text, phrase) in enumerate([*((a, b, True) for a, b in PHRASES), *((a, b, False) for a, b in TEMPLATES)]))
_LICENSES = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
g AS (SELECT rid, i, array_to_string(ws[i + 1:i + {GRAM}], ' ') AS g FROM (SELECT rid, ws, unnest(range(0, len(ws) - {GRAM - 1})) AS i FROM d WHERE len(ws) >= {GRAM})),
t AS (SELECT t, label, phrase, {_WORDS.format("x")} AS ws FROM (VALUES {_KNOWN}) AS v(t, label, phrase, x)),
tg AS (SELECT t, label, phrase, len(ws) - {GRAM - 1} AS total, o, array_to_string(ws[o + 1:o + {GRAM}], ' ') AS g FROM (SELECT *, unnest(range(0, len(ws) - {GRAM - 1})) AS o FROM t)),
v AS (SELECT rid, t, label, phrase, total, i - o AS dg, count(*) AS n, min(i) AS low, max(i) AS high, list(o) AS offs FROM g JOIN tg USING (g) GROUP BY ALL),
base AS (SELECT rid, count(*) AS n, min(dg) AS a, max(dg) AS b, list_distinct(list(label)) AS l FROM v WHERE phrase AND n = total GROUP BY rid),
f AS (SELECT *, coalesce((dg - lag(dg) OVER (PARTITION BY rid, t ORDER BY dg) > {DRIFT})::INT, 1) AS far FROM v WHERE NOT phrase),
s AS (SELECT *, sum(far) OVER (PARTITION BY rid, t ORDER BY dg) AS span FROM f),
m AS (SELECT rid, label, total, len(list_distinct(flatten(list(offs)))) / total AS score, max(high) + {GRAM} - min(low) AS size FROM s GROUP BY rid, t, label, total, span),
more AS (SELECT rid, list_distinct(list(label)) AS l, max(score) AS score FROM m WHERE score >= {LEAST_SCORE} AND size <= {STRETCH} * (total + {GRAM - 1}) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, base.a::BIGINT AS first_word, base.b::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(base.l), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.l, []), coalesce(more.l, [])))), ','), '') AS labels,
       greatest(CASE WHEN base.n > 0 THEN 1.0 ELSE 0.0 END, coalesce(more.score, 0.0))::DOUBLE AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN more USING (rid)
"""

QUERIES: dict[str, str] = {
    "op3_license_diagonals": _LICENSES,
    "op6_parity_jaccard": _JACCARD,
    "op9_prefix_decontamination": _DECONTAMINATION,
    "op8_warc_roundtrip": _WARC,
    "op2_url_cascade": _URLS,
    "op7_host_quality": _QUALITY,
}
