"""DuckDB SQL that checks the queries of ``catalog``: a chain of common table expressions from the tables to each result.

The chain is written anew in SQL, set by set; it shares only the fixed patterns and word
lists with the library.  On the minutes tables are read as runs of lines with the same number
of cells, which is what those pages hold; ``table_blocks`` has a recursion over lines.
"""

from __future__ import annotations

from lamina.functions.classify import CLAUSE_WORDS, SMALL_WORDS
from lamina.functions.text import CONTROL, INVISIBLE, SPACES
from lamina.sources.pages import _BLOCK_TAGS

_WORD = r"[\p{L}\p{N}_]+(?:[-/''’][\p{L}\p{N}_]+)*"
_ODD = f"translate({{}}, '{SPACES}' || chr(11) || chr(12) || '{INVISIBLE}{CONTROL[1:]}', '{' ' * len(SPACES)}' || chr(10) || chr(10))"
_CLEAN = r"regexp_replace(regexp_replace(" + _ODD.format(r"regexp_replace({}, '\r\n?', chr(10), 'g')") + r", '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
_CHUNKS = f"""
WITH d AS (SELECT doc_id::VARCHAR AS document_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
s AS (SELECT document_id, t, n, i * 900 AS a, least(i * 900 + 1000, n) AS b
      FROM (SELECT *, unnest(range(0, greatest(0, ceil((n - 1000) / 900.0))::BIGINT + 1)) AS i FROM d WHERE n > 0)),
c AS (SELECT document_id, a, b, substr(t, a + 1, b - a) AS text FROM s WHERE regexp_matches(substr(t, a + 1, b - a), '[^\\s]')),
k AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY a) - 1 AS i FROM c)
"""

_SQL = {
    "page_stats": f"SELECT conv_id::VARCHAR AS document_id, (turn + 1)::INT AS page_number, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::INT AS word_count, length(coalesce(text, ''))::INT AS char_count FROM conversations",
    "document_stats": f"SELECT conv_id::VARCHAR AS document_id, count(*)::BIGINT AS page_count, sum(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')))::BIGINT AS word_count, (sum(length(coalesce(text, ''))) + 2 * (count(*) - 1))::BIGINT AS char_count FROM conversations GROUP BY conv_id",
    "preprocess_text": f"SELECT doc_id::VARCHAR AS document_id, {_CLEAN.format('coalesce(text, chr(39) || chr(39))')} AS text FROM documents".replace("chr(39) || chr(39)", "''"),
    "inline_normalize": r"""
SELECT document_id, line_no, regexp_replace(regexp_replace(regexp_replace(trim(raw, ' ' || chr(9) || chr(13)), '[ \t]+', ' ', 'g'), '[ \t]+([.,;:!?)\]}])', '\1', 'g'), '([(\[{])[ \t]+', '\1', 'g') AS text,
       length(replace(regexp_extract(raw, '^[ \t]*', 0), chr(9), '    '))::INT AS indent
FROM (SELECT doc_id::VARCHAR AS document_id, unnest(range(len(l)))::INT AS line_no, unnest(l) AS raw FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))""",
    "line_classes": r"""
WITH l AS (SELECT doc_id::VARCHAR AS document_id, unnest(range(len(l)))::INT AS line_no, trim(unnest(l), ' ' || chr(9) || chr(13)) AS c FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
w AS (SELECT *, list_filter(regexp_split_to_array(c, '\s+'), lambda x: x <> '') AS w, regexp_matches(c, '^(?:[●•\-→]|\d+[.)])\s+') AS li,
      list_filter(list_transform(CASE WHEN contains(c, '|') THEN regexp_split_to_array(c, '\s*\|\s*') ELSE regexp_split_to_array(c, '\s{2,}') END, lambda x: trim(x)), lambda x: x <> '') AS cells FROM l),
m AS (SELECT *, regexp_matches(c, '^(?:[•⁃■●→–*\-]|\d+[.)]|\([A-Za-z0-9]+\)|[A-Za-z][.)]|\[\d+\])\s+') AS marked,
      regexp_replace(c, '^(?:[•⁃■●→–*\-]|\d+[.)]|\([A-Za-z0-9]+\)|[A-Za-z][.)]|\[\d+\])\s+', '') AS rest,
      regexp_matches(c, '[:.;!?]') AS dots FROM w)
SELECT document_id, line_no, CASE WHEN marked AND rest <> '' THEN rest END AS item,
  (CASE WHEN c = '' OR length(c) > 90 OR li THEN NULL
        WHEN regexp_matches(c, '^[A-Z][A-Za-z]*\s+\d+(?:\.\d+)*[A-Za-z]?(?:\s*[:—–-]\s*.*)?$') THEN len(string_split(regexp_extract(c, '\d+(?:\.\d+)*', 0), '.'))
        WHEN NOT dots AND regexp_matches(c, '^[A-Z0-9/&()''’.,\-–—\s]+$') AND len(w) BETWEEN 2 AND CASE WHEN regexp_matches(c, '\d') THEN 8 ELSE 4 END AND regexp_matches(c, '\p{L}') THEN 2
        WHEN NOT dots AND NOT contains(c, '  ') AND len(w) BETWEEN 2 AND 5 AND len(list_filter(w, lambda x: NOT regexp_matches(x, '^[A-Z][a-z'']*$'))) = 0 THEN 2 END)::INT AS level,
  regexp_matches(c, '(?i)^(?:page\s+)?\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?$') OR regexp_matches(c, '^[-–—]\s*\d{1,4}\s*[-–—]$') OR regexp_matches(c, '(?i)^[ivxlcdm]{1,6}$') AS page_number,
  c <> '' AND NOT li AND len(cells) >= 2 AND len(list_filter(cells, lambda x: len(regexp_split_to_array(x, '\s+')) <= 4 OR regexp_matches(x, '^[\d$€£¥(),.%+\-/: ]+$'))) > 0 AS table_row, li AS list_item
FROM m""",
    "char_chunks_v1": f"{_CHUNKS} SELECT document_id, document_id || '_chunk_' || i AS chunk_id, i::INT AS chunk_index, a::INT AS start_char, b::INT AS end_char, text, len(regexp_extract_all(text, '{_WORD}'))::INT AS word_count, length(text)::INT AS char_count FROM k",
    "char_chunk_stats": f"{_CHUNKS} SELECT document_id, count(*)::BIGINT AS chunk_count, sum(len(regexp_extract_all(text, '{_WORD}')))::BIGINT AS total_word_count, sum(length(text))::BIGINT AS total_char_count FROM k GROUP BY document_id",
    "sentence_spans": r"""
WITH s AS (SELECT doc_id::VARCHAR AS document_id, list_filter(string_split(regexp_replace(text, '([.!?])(\s+)', '\1\2' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL),
e AS (SELECT document_id, unnest(range(len(l))) AS i, unnest(l) AS x FROM s)
SELECT document_id, i::INT AS sentence_no, (sum(length(x)) OVER w - length(x))::INT AS start_char, (sum(length(x)) OVER w)::INT AS end_char FROM e WINDOW w AS (PARTITION BY document_id ORDER BY i)""",
    "token_counts": r"SELECT conv_id::VARCHAR AS document_id, token, count(*)::BIGINT AS n FROM (SELECT conv_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS token FROM conversations) GROUP BY ALL",
    "page_numbers_in_order": r"""
WITH p AS (SELECT conv_id::VARCHAR AS document_id, (turn + 1)::INT AS page_number, coalesce(text, '') AS t, lead(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT document_id, page_number, CASE WHEN t = '' OR n = '' THEN chr(10) || chr(10) WHEN regexp_matches(t, '[.!?:]["'')\]]*\s*$') THEN chr(10) || chr(10) WHEN regexp_matches(n, '^\s*\p{Ll}') THEN ' ' ELSE chr(10) || chr(10) END AS delimiter
FROM p WHERE n IS NOT NULL""",
}

_LIST = ", ".join(f"'{w}'" for w in CLAUSE_WORDS)
_SMALL = ", ".join(f"'{w}'" for w in SMALL_WORDS)
_PAGE_NUMBER = r"(regexp_matches({0}, '(?i)^(?:page\s+)?\d{{1,4}}(?:\s*(?:of|/)\s*\d{{1,4}})?$') OR regexp_matches({0}, '^[-–—]\s*\d{{1,4}}\s*[-–—]$') OR regexp_matches({0}, '(?i)^[ivxlcdm]{{1,6}}$'))"
_MARK = r"^(?:[•⁃■●→–*\-]|\d+[.)]|\([A-Za-z0-9]+\)|[A-Za-z][.)]|\[\d+\])\s+"
_TERMINAL = r"[.!?][\"'')\]]?$"
_NUMERIC = r"^[\d$€£¥(),.%+\-/: ]+$"
_ENDS = r"regexp_matches({}, '[.!?:][\"'')\]]*\s*$')"
_LOWER = r"regexp_matches({}, '^\s*\p{{Ll}}')"


def _words(c: str) -> str:
    return rf"list_filter(regexp_split_to_array({c}, '\s+'), lambda w: w <> '')"


def _heading_like(c: str) -> str:
    letters, upper = rf"len(regexp_extract_all({c}, '\p{{L}}'))", rf"len(regexp_extract_all({c}, '\p{{Lu}}'))"
    capitals = f"(len({_words(c)}) <= 14 AND {letters} > 0 AND {upper} >= {letters} * 0.8::DOUBLE AND (len({_words(c)}) >= 2 OR length({c}) >= 8))"
    label = rf"(length({c}) <= 90 AND regexp_matches({c}, '^[A-Z][A-Za-z]*\s+[0-9]+[A-Za-z]*\s*:\s+\S') AND NOT regexp_matches({c}, '{_TERMINAL}'))"
    return f"({c} <> '' AND NOT regexp_matches({c}, '^(?:[●•\\-→]|\\d+[.)])\\s+') AND ((length({c}) <= 90 AND ends_with({c}, ':')) OR {label} OR {capitals}))"


def _title_cased(c: str) -> str:
    w = rf"regexp_extract_all({c}, '[A-Za-z][A-Za-z''/-]*')"
    title = f"len(list_filter({w}, lambda x: lower(x) IN ({_SMALL}) OR (regexp_matches(x, '^[A-Z]') AND substr(x, 2) = lower(substr(x, 2)))))"
    return f"(len({w}) BETWEEN 2 AND 12 AND length({c}) <= 90 AND len(list_filter({w}, lambda x: lower(x) IN ({_LIST}))) = 0 AND {title} >= greatest(2, len({w}) - 1))"


def _inline(c: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(trim({c}, ' ' || chr(9)), '[ \t]+', ' ', 'g'), '[ \t]+([.,;:!?)\]}}])', '\1', 'g'), '([(\[{{])[ \t]+', '\1', 'g')"


_CELLS = r"list_transform(list_filter(CASE WHEN contains({0}, '|') THEN regexp_split_to_array({0}, '\s*\|\s*') ELSE regexp_split_to_array({0}, '\s{{2,}}') END, lambda x: trim(x) <> ''), lambda x: {1})"
_CELLS_OF = lambda c: _CELLS.format(c, _inline("x"))

_PAGES = r"""
pages AS (
  SELECT conv_id::VARCHAR AS d, (turn + 1)::INT AS p, 'Minutes of meeting' || chr(10) || chr(10)
    || CASE WHEN turn % 3 = 0 THEN 'Section ' || (turn // 3 + 1) || '.' || (turn + 1) || chr(10) ELSE '' END
    || CASE WHEN role = 'user' THEN '• ' || replace(t, '. ', '.' || chr(10) || '• ') ELSE t END
    || CASE WHEN turn % 3 = 2 THEN chr(10) || chr(10) || 'Item | Turn | Length' || chr(10) || 'first | ' || (turn + 1) || ' | ' || length(t) || chr(10) || 'other | ' || (turn + 2) || ' | ' || length(t) * 2 ELSE '' END
    || chr(10) || chr(10) || 'Page ' || (turn + 1) AS text
  FROM (SELECT *, coalesce(text, '') AS t FROM conversations))"""

#: Lines of the pages with everything that is known of one line by itself.
_LINES = rf"""
raw AS (SELECT d, p, unnest(range(len(l)))::INT AS n, unnest(l) AS raw FROM (SELECT d, p, string_split({_CLEAN.format("text")}, chr(10)) AS l FROM pages)),
known AS (SELECT *, trim(raw, ' ' || chr(9)) AS c, length(replace(regexp_extract(raw, '^[ \t]*', 0), chr(9), '    ')) AS indent FROM raw),
worded AS (SELECT *, {_words("c")} AS w, {_CELLS_OF("c")} AS cells, regexp_matches(c, '^(?:[●•\-→]|\d+[.)])\s+') AS li, regexp_matches(c, '[:.;!?]') AS dots,
           CASE WHEN regexp_matches(c, '{_MARK}') AND regexp_replace(c, '{_MARK}', '') <> '' THEN regexp_replace(c, '{_MARK}', '') END AS item FROM known),
told AS (SELECT *, c <> '' AND NOT li AND len(cells) >= 2 AND len(list_filter(cells, lambda x: len({_words("x")}) <= 4 OR regexp_matches(x, '{_NUMERIC}'))) > 0 AS candidate,
  CASE WHEN c = '' OR length(c) > 90 OR li THEN NULL
       WHEN regexp_matches(c, '^[A-Z][A-Za-z]*\s+\d+(?:\.\d+)*[A-Za-z]?(?:\s*[:—–-]\s*.*)?$') THEN len(string_split(regexp_extract(c, '\d+(?:\.\d+)*', 0), '.'))
       WHEN NOT dots AND regexp_matches(c, '^[A-Z0-9/&()''’.,\-–—\s]+$') AND len(w) BETWEEN 2 AND CASE WHEN regexp_matches(c, '\d') THEN 8 ELSE 4 END AND regexp_matches(c, '\p{{L}}') THEN 2
       WHEN NOT dots AND NOT contains(c, '  ') AND len(w) BETWEEN 2 AND 5 AND len(list_filter(w, lambda x: NOT regexp_matches(x, '^[A-Z][a-z'']*$'))) = 0 THEN 2 END AS level FROM worded),
typed AS (SELECT *, CASE WHEN c = '' THEN 'blank' WHEN li THEN 'list_item' WHEN candidate THEN 'table_row' WHEN {_heading_like("c")} OR {_title_cased("c")} THEN 'heading' ELSE 'text' END AS kind FROM told)"""

_NOISE = rf"""
zoned AS (SELECT *, row_number() OVER (PARTITION BY d, p ORDER BY n) AS up, row_number() OVER (PARTITION BY d, p ORDER BY n DESC) AS down,
          regexp_replace(regexp_replace(lower(c), '\d+', '#', 'g'), '\s+', ' ', 'g') AS key FROM known WHERE c <> ''),
zones AS (SELECT d, p, n, c, key, 'page_header' AS zone FROM zoned WHERE up <= 2 UNION ALL SELECT d, p, n, c, key, 'page_footer' FROM zoned WHERE down <= 2),
noise AS (SELECT d, p, n, min(zone) AS noise FROM (SELECT *, count(*) OVER (PARTITION BY d, zone, key) AS seen FROM zones) JOIN (SELECT d, count(DISTINCT p) AS pages FROM known GROUP BY d) USING (d)
          WHERE seen >= greatest(3, ceil(pages * 0.4::DOUBLE)) OR {_PAGE_NUMBER.format("c")} GROUP BY ALL)"""


def _reading(stop: str, start: str, role: str, level: str, keeps: str, joins: str, glue: str, text: str) -> str:
    """Blocks of one reading.  keeps: whether a line goes on with the open item; joins: with the paragraph before."""
    return f"""
fenced AS (SELECT *, coalesce({stop}, false) AS stop, coalesce({start}, false) AS opens FROM reading),
ran AS (SELECT *, opens AND NOT coalesce(lag(opens AND len(cells) >= 2 AND NOT stop) OVER wd, false) AS begins_run,
        sum((stop OR NOT candidate)::INT) OVER wd AS fence FROM fenced WINDOW wd AS (PARTITION BY d, p ORDER BY n)),
run AS (SELECT d, p, fence, min(n) AS first, max(n) AS last, count(*) AS size, list(cells ORDER BY n) AS cells FROM ran WHERE candidate AND NOT stop GROUP BY ALL HAVING count(*) >= 2),
grid AS (SELECT d, p, fence, first, last, CASE WHEN named THEN cells[1] ELSE [] END AS columns, CASE WHEN named THEN cells[2:] ELSE cells END AS rows
         FROM (SELECT *, len(list_filter(cells[1], lambda x: regexp_matches(x, '\\d'))) = 0 AND len(list_filter(cells[1], lambda x: len({_words("x")}) > 6)) = 0
               AND len(list_filter(cells[2:], lambda r: abs(len(r) - len(cells[1])) <= 1 AND len(list_filter(r, lambda x: regexp_matches(x, '\\d'))) > 0)) > 0 AS named FROM run)),
roled AS (SELECT r.*, g.columns, g.rows, g.first AS region, {role} AS role FROM ran r LEFT JOIN grid g ON r.d = g.d AND r.p = g.p AND r.n BETWEEN g.first AND g.last),
seen AS (SELECT *, max(CASE WHEN role = 'item' THEN n END) OVER wd AS item_at, max(CASE WHEN role NOT IN ('item', 'plain') THEN n END) OVER wd AS break_at,
         last_value(CASE WHEN role = 'item' THEN indent END IGNORE NULLS) OVER wd AS depth FROM roled WINDOW wd AS (PARTITION BY d, p ORDER BY n)),
held AS (SELECT *, coalesce(role = 'plain' AND item_at > coalesce(break_at, -1), false) AS held FROM seen),
parts AS (SELECT *, CASE WHEN held AND max((held AND NOT ({keeps}))::INT) OVER (PARTITION BY d, p, item_at ORDER BY n) = 0 THEN 'more' ELSE role END AS part FROM held),
near AS (SELECT *, lag(part) OVER wd AS part_before, lag(line_text) OVER wd AS text_before, lag(indent) OVER wd AS indent_before, lag(kind) OVER wd AS kind_before FROM parts WINDOW wd AS (PARTITION BY d, p ORDER BY n)),
marked AS (SELECT *, CASE WHEN part IN ('blank', 'more') THEN 0 WHEN part = 'table' THEN (n = region)::INT WHEN part = 'item' THEN (coalesce(part_before, '') NOT IN ('item', 'more'))::INT
                     WHEN part = 'plain' THEN (NOT (coalesce(part_before, '') = 'plain' AND coalesce({joins}, false)))::INT ELSE 1 END AS begins FROM near),
numbered AS (SELECT *, sum(begins) OVER wd AS block, sum((part = 'item')::INT) OVER wd AS item_no FROM marked WINDOW wd AS (PARTITION BY d, p ORDER BY n)),
entries AS (SELECT d, p, block, item_no, min(n) AS n, {glue} AS entry FROM numbered WHERE part <> 'blank' GROUP BY d, p, block, item_no),
heads AS (SELECT d, p, block, arg_min(part, n) AS part, arg_min({level}, n) AS level, arg_min(columns, n) AS columns, arg_min(rows, n) AS rows, arg_min(coalesce(part_before = 'blank', false), n) AS after_blank
          FROM numbered WHERE part <> 'blank' GROUP BY ALL),
bodies AS (SELECT d, p, block, list(entry ORDER BY n) FILTER (entry <> '') AS items FROM entries GROUP BY ALL),
built AS (SELECT d, p, block, CASE WHEN part IN ('item', 'more') THEN 'list' WHEN part = 'plain' THEN 'paragraph' ELSE part END AS type, level, after_blank, coalesce(items, []) AS items, columns, rows FROM heads JOIN bodies USING (d, p, block)),
texted AS (SELECT *, CASE WHEN type = 'table' THEN array_to_string(list_transform(CASE WHEN len(columns) > 0 THEN list_concat([columns], rows) ELSE rows END, lambda r: array_to_string(r, ' | ')), chr(10))
                          ELSE array_to_string(items, chr(10)) END AS text FROM built),
blocks AS (SELECT d, p, (row_number() OVER (PARTITION BY d, p ORDER BY block) - 1)::INT AS seq, type, text, CASE WHEN type = 'heading' THEN level END AS level, CASE WHEN type = 'list' THEN items ELSE [] END AS items,
           CASE WHEN type = 'table' THEN columns ELSE [] END AS columns, CASE WHEN type = 'table' THEN rows ELSE [] END AS rows, after_blank FROM texted WHERE text <> '')"""


_JOINED = r"trim(regexp_replace(string_agg(trim(piece, ' ' || chr(9)), ' ' ORDER BY n) FILTER (trim(piece, ' ' || chr(9)) <> ''), '[ \t]+', ' ', 'g'))"
_SECTION = lambda c: rf"({c} <> '' AND NOT regexp_matches({c}, '[:,;\-–—&/]$') AND NOT regexp_matches({c}, '^\d') AND len({_words(c)}) BETWEEN 2 AND 6 AND len(list_filter({_words(c)}, lambda x: regexp_matches(x, '^[\p{{L}}\p{{N}}]') AND NOT regexp_matches(x, '^\p{{Lu}}'))) = 0)"
_JOINS = rf"""(kind = 'text' AND kind_before = 'text' AND NOT (regexp_matches(text_before, '{_TERMINAL}') OR regexp_matches(line_text, '^\d') OR {_heading_like("line_text")} OR {_title_cased("line_text")} OR {_SECTION("line_text")})
  AND regexp_matches(line_text, '^[\p{{L}}\p{{N}}("'']') AND (regexp_matches(text_before, '(?i)(?:,|[&/\-–—]|\b(?:and|or|but|nor|yet|so|for)\b)$') OR (len({_words("text_before")}) BETWEEN 1 AND 2 AND regexp_matches(text_before, '^\p{{Ll}}'))
    OR regexp_matches(line_text, '^\p{{Ll}}') OR indent > indent_before OR length(text_before) >= 55 OR len({_words("text_before")}) >= 9
    OR (len({_words("text_before")}) <= 2 AND len({_words("line_text")}) <= 3 AND NOT {_SECTION("text_before")} AND NOT {_SECTION("line_text")}
        AND (regexp_matches(line_text, '(?s)^..*\p{{Ll}}') OR (regexp_matches(text_before, '\p{{Lu}}') AND NOT regexp_matches(text_before, '\p{{Ll}}'))))))"""

_STRUCTURED = f"{_PAGES}, {_LINES}, {_NOISE}," + rf"""
reading AS (SELECT t.*, noise, raw AS line_text FROM typed t LEFT JOIN noise USING (d, p, n)), """ + _reading(
    "kind = 'blank' OR noise IS NOT NULL OR item IS NOT NULL", "NOT (kind = 'blank' OR noise IS NOT NULL OR item IS NOT NULL) AND level IS NULL AND candidate",
    "CASE WHEN g.first IS NOT NULL THEN 'table' WHEN kind = 'blank' THEN 'blank' WHEN noise IS NOT NULL THEN noise WHEN item IS NOT NULL THEN 'item' WHEN level IS NOT NULL THEN 'heading' ELSE 'plain' END",
    "level", "indent >= depth", "true", "coalesce(" + _JOINED.replace("piece", "CASE WHEN part = 'item' THEN item WHEN part IN ('heading', 'page_header', 'page_footer') THEN c ELSE raw END") + ", '')", "text",
) + rf""",
glued AS (SELECT *, row_number() OVER wd AS no, CASE WHEN lag(p) OVER wd IS NULL THEN '' WHEN lag(type) OVER wd = 'paragraph' AND type = 'paragraph' AND p = lag(p) OVER wd + 1 AND NOT {_ENDS.format("lag(text) OVER wd")} AND {_LOWER.format("text")} THEN ' ' ELSE chr(10) || chr(10) END AS glue
          FROM blocks WINDOW wd AS (PARTITION BY d ORDER BY p, seq)),
spanned AS (SELECT *, sum(length(glue) + length(text)) OVER (PARTITION BY d ORDER BY p, seq) AS stop FROM glued)"""

_LINE = f"{_PAGES}, {_LINES}," + r"""
reading AS (SELECT *, CASE WHEN kind = 'table_row' THEN c ELSE """ + _inline("raw") + r""" END AS line_text FROM typed), """ + _reading(
    "kind IN ('blank', 'list_item')", "kind = 'table_row'",
    "CASE WHEN g.first IS NOT NULL THEN 'table' WHEN kind = 'blank' THEN 'blank' WHEN kind = 'list_item' THEN 'item' WHEN kind = 'heading' THEN 'heading' ELSE 'plain' END",
    "NULL::INT", "indent > depth AND kind = 'text'", _JOINS, "trim(string_agg(line_text, ' ' ORDER BY n))", "text",
)


def _documents(structured: bool) -> str:
    """Page texts, the documents' full texts and the blocks' places in their pages."""
    glue = f"CASE WHEN row_number() OVER wd = 1 THEN '' WHEN lag(t) OVER wd = '' OR t = '' OR {_ENDS.format('lag(t) OVER wd')} THEN chr(10) || chr(10) WHEN {_LOWER.format('t')} THEN ' ' ELSE chr(10) || chr(10) END" if structured else "CASE WHEN row_number() OVER wd = 1 THEN '' ELSE chr(10) || chr(10) END"
    blank = "" if structured else "WHEN after_blank THEN chr(10) || chr(10) "
    return rf"""
placed AS (SELECT *, CASE WHEN lag(type) OVER wd IS NULL THEN '' {blank}WHEN lag(type) OVER wd = 'heading' THEN chr(10) ELSE chr(10) || chr(10) END AS sep FROM blocks WHERE type NOT IN ('page_header', 'page_footer') WINDOW wd AS (PARTITION BY d, p ORDER BY seq)),
local AS (SELECT *, sum(length(sep) + length(text)) OVER (PARTITION BY d, p ORDER BY seq) AS stop FROM placed),
page_texts AS (SELECT d, p, coalesce(string_agg(sep || text, '' ORDER BY seq), '') AS t FROM (SELECT DISTINCT d, p FROM pages) LEFT JOIN placed USING (d, p) GROUP BY d, p),
page_glue AS (SELECT *, {glue} AS glue FROM page_texts WINDOW wd AS (PARTITION BY d ORDER BY p)),
page_before AS (SELECT *, length(regexp_replace(coalesce(string_agg(glue || t, '') OVER (PARTITION BY d ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || glue, '\n{{3,}}', chr(10) || chr(10), 'g')) AS a FROM page_glue),
page_at AS (SELECT d, p, t, CASE WHEN t <> '' THEN a ELSE coalesce(max(CASE WHEN t <> '' THEN a + length(t) END) OVER (PARTITION BY d ORDER BY p), 0) END AS a FROM page_before),
docs AS (SELECT d, regexp_replace(string_agg(glue || t, '' ORDER BY p), '\n{{3,}}', chr(10) || chr(10), 'g') AS full_text, count(*) AS page_count FROM page_glue GROUP BY d)"""


_UNITS = r"""
unit_texts AS (SELECT d, p, seq, type, a + stop - length(l.text) AS base, CASE WHEN type = 'table' AND len(columns) > 0 THEN array_to_string(columns, ' | ') END AS own,
   CASE WHEN type = 'list' THEN items WHEN type = 'table' THEN list_transform(CASE WHEN len(columns) > 0 THEN list_concat([columns], rows) ELSE rows END, lambda r: array_to_string(r, ' | ')) ELSE [l.text] END AS texts
   FROM local l JOIN page_at USING (d, p)),
unit_list AS (SELECT d, p, seq, type, base, own, unnest(range(len(texts))) AS i, unnest(texts) AS text FROM unit_texts),
unit_at AS (SELECT *, base + sum(length(text) + 1) OVER (PARTITION BY d, p, seq ORDER BY i) - 1 AS e FROM unit_list),
unit_seen AS (SELECT *, last_value(CASE WHEN type = 'heading' THEN text END IGNORE NULLS) OVER wd AS heading, row_number() OVER wd - 1 AS k, sum((type <> 'table')::INT) OVER wd AS run
   FROM unit_at WHERE type NOT IN ('heading', 'paragraph') OR text <> '' WINDOW wd AS (PARTITION BY d ORDER BY p, seq, i)),
units AS (SELECT d, k, e - length(text) AS s, e, type, CASE WHEN type <> 'heading' THEN heading END AS heading, CASE WHEN type = 'table' THEN last_value(own IGNORE NULLS) OVER (PARTITION BY d, run ORDER BY k) END AS table_header,
   type = 'table' AND own IS NOT NULL AND i = 0 AS is_header, text FROM unit_seen)"""


def _pieces(size: int, name: str = "pieces") -> str:
    return rf"""
{name}_cut AS (SELECT *, CASE WHEN e - s > {size} THEN list_filter(string_split(regexp_replace(text, '([.!?])(\s+)', '\1\2' || chr(1), 'g'), chr(1)), lambda x: x <> '') ELSE [text] END AS cut FROM units),
{name}_list AS (SELECT * EXCLUDE (cut), unnest(range(len(cut))) AS j, unnest(cut) AS piece FROM {name}_cut),
{name} AS (SELECT d, k, j, s + sum(length(piece)) OVER wd - length(piece) AS s, s + sum(length(piece)) OVER wd AS e, type, heading, table_header, is_header, piece, row_number() OVER (PARTITION BY d ORDER BY k, j) AS i FROM {name}_list WINDOW wd AS (PARTITION BY d, k ORDER BY j))"""


def _chunks(size: int, context: bool, name: str) -> str:
    """Greedy packing as a recursion over a document's pieces, one step for each; then the chunks as rows of ``name``."""
    prefix = """concat_ws(chr(10), nullif(heading, ''), CASE WHEN type = 'table' AND NOT is_header THEN nullif(table_header, '') END)""" if context else "''"
    return _pieces(size, f"{name}_p") + f""",
{name}_w AS (SELECT *, {prefix} AS own, lag(piece) OVER (PARTITION BY d ORDER BY i) AS before FROM {name}_p),
{name}_x AS (SELECT *, CASE WHEN {str(not context).lower()} OR type = 'heading' THEN '' WHEN own <> '' THEN own ELSE coalesce(before, '') END AS prefix FROM {name}_w),
{name}_y AS (SELECT *, greatest({size} - CASE WHEN prefix <> '' THEN length(prefix) + 1 ELSE 0 END, e - s) AS budget, {str(context).lower()} AND type = 'table' AS rows_only, {str(context).lower()} AND is_header AS header FROM {name}_x),
{name}_r(d, i, s, e, budget, rows_only, header, done, no, prefix) AS (
  SELECT d, i, s, e, budget, rows_only, header, false, 0, prefix FROM {name}_y WHERE i = 1
  UNION ALL
  SELECT y.d, y.i, CASE WHEN takes THEN r.s ELSE y.s END, y.e, CASE WHEN takes THEN r.budget ELSE y.budget END, CASE WHEN takes THEN r.rows_only ELSE y.rows_only END, NOT takes AND y.header,
         takes AND r.header AND y.e - r.s > r.budget, r.no + (NOT takes)::INT, CASE WHEN takes THEN r.prefix ELSE y.prefix END
  FROM {name}_r r JOIN (SELECT d AS yd, * FROM {name}_y) y ON y.yd = r.d AND y.i = r.i + 1,
       LATERAL (SELECT NOT r.done AND (NOT r.rows_only OR y.type = 'table') AND (y.e - r.s <= r.budget OR (r.header AND y.type = 'table')) AS takes)),
{name}_s AS (SELECT d, no, min(s) AS s, max(e) AS e, min(prefix) AS prefix FROM {name}_r GROUP BY d, no)""" + _as_rows(name)


def _as_rows(name: str) -> str:
    return f""",
{name}_t AS (SELECT c.*, substr(full_text, s::BIGINT + 1, (e - s)::BIGINT) AS text FROM {name}_s c JOIN docs USING (d)),
{name} AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY s, e) - 1 AS i FROM {name}_t WHERE regexp_matches(text, '\\S'))"""


def _windows(name: str) -> str:
    return f"""
{name}_s AS (SELECT d, (i * 900) AS s, least(i * 900 + 1000, n) AS e, '' AS prefix FROM (SELECT d, length(full_text) AS n, unnest(range(0, greatest(0, ceil((length(full_text) - 1000) / 900.0))::BIGINT + 1)) AS i FROM docs WHERE full_text <> ''))""" + _as_rows(name)


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(p.strip() for p in parts)


_ROWS = f"""SELECT d AS document_id, d || '_chunk_' || i AS chunk_id, i::INT AS chunk_index, s::INT AS start_char, e::INT AS end_char, text, (SELECT list(p ORDER BY p) FROM page_at WHERE page_at.d = c.d AND page_at.a < c.e AND page_at.a + length(t) > c.s) AS page_numbers,
  len(regexp_extract_all(text, '{_WORD}'))::INT AS word_count, length(text)::INT AS char_count, prefix AS context_prefix, CASE WHEN prefix <> '' THEN prefix || chr(10) || text ELSE text END AS contextualized_text FROM c"""
_BLOCK = "d AS document_id, p AS page_number, seq AS block_seq, type, text, level::INT AS level, items, columns, rows"
_BASE = [_STRUCTURED, _documents(True), _UNITS]


def _issue_rows(c: str, size: int) -> str:
    """(d, invariant) of the structural chunks ``c`` (d, i, s, e, text), a row for each issue."""
    return f"""
SELECT d, 'max_size' AS invariant FROM {c} WHERE e - s > {size} AND NOT EXISTS (SELECT 1 FROM chunks_p q WHERE q.d = {c}.d AND q.s = {c}.s AND q.e = {c}.e)
  AND NOT EXISTS (SELECT 1 FROM (SELECT d, s, is_header, lead(e) OVER wd AS e, lead(type) OVER wd AS next FROM units WINDOW wd AS (PARTITION BY d ORDER BY k)) h WHERE h.is_header AND h.next = 'table' AND h.d = {c}.d AND h.s = {c}.s AND h.e = {c}.e)
UNION ALL SELECT d, 'overlap' FROM (SELECT *, lag(s) OVER wd AS ps, lag(e) OVER wd AS pe FROM {c} WINDOW wd AS (PARTITION BY d ORDER BY i)) WHERE pe - ps = {size} AND s <= pe AND s <> pe
UNION ALL SELECT g.d, 'non_whitespace_coverage' FROM (SELECT d, s, coalesce(max(e) OVER (PARTITION BY d ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach
    FROM (SELECT d, s, e FROM {c} UNION ALL SELECT d, length(full_text), NULL FROM docs)) g JOIN docs USING (d) WHERE s > reach AND regexp_matches(substr(full_text, reach::BIGINT + 1, (s - reach)::BIGINT), '\\S')
UNION ALL SELECT d, 'traceability' FROM {c} JOIN docs USING (d) WHERE substr(full_text, s::BIGINT + 1, (e - s)::BIGINT) <> text
UNION ALL SELECT d, 'offsets' FROM {c} JOIN docs USING (d) WHERE s < 0 OR s >= e OR e > length(full_text) OR e - s <> length(text)
UNION ALL SELECT d, 'element_order' FROM (SELECT d, s, lag(e) OVER (PARTITION BY d ORDER BY k) AS pe FROM units) WHERE s < pe
UNION ALL SELECT d, 'atomic_element_coverage' FROM units u WHERE e > s AND e - s <= {size} AND (SELECT count(*) FROM {c} x WHERE x.d = u.d AND x.s <= u.s AND x.e >= u.e) <> 1
UNION ALL SELECT DISTINCT d, 'structural_integrity' || '' FROM (SELECT d, i, unnest([s, e]) AS edge FROM {c}) x WHERE false
UNION ALL SELECT d, 'structural_integrity' FROM (SELECT DISTINCT d, i FROM (SELECT d, i, unnest([s, e]) AS edge FROM {c}) x WHERE NOT EXISTS (SELECT 1 FROM chunks_p q WHERE q.d = x.d AND (q.s = x.edge OR q.e = x.edge)))"""


def _quality(c: str, label: str, strategy: str, context: bool, structural: bool) -> str:
    overhead = "injected / delivered" if context else "redundant / chars" if not structural else "0.0"
    source = "context_prefix" if context else "overlap" if not structural else "none"
    return f"""
SELECT docs.d, '{label}' AS label, '{strategy}' AS strategy, {str(context).lower()} AS context, coalesce(n, 0) AS n, coalesce(chars / (1000 * n), 0.0) AS utilization, coalesce(tiny, 0) AS tiny, coalesce(tiny / n, 0.0) AS tiny_ratio,
  coalesce(words, 0) AS words, coalesce(bullets, 0) AS bullets, coalesce(trows, 0) AS trows, coalesce({overhead}, 0.0) AS overhead, '{source}' AS source, {"CASE WHEN coalesce(needing, 0) > 0 THEN satisfied / needing ELSE 1.0 END" if context else "NULL::DOUBLE"} AS coverage
FROM docs LEFT JOIN (
  SELECT d, count(*) AS n, sum(length(text))::DOUBLE AS chars, sum((length(text) < 100)::INT) AS tiny, sum(redundant)::DOUBLE AS redundant, sum(length(text) + CASE WHEN prefix <> '' THEN length(prefix) + 1 ELSE 0 END)::DOUBLE AS delivered,
         sum(CASE WHEN prefix <> '' THEN length(prefix) + 1 ELSE 0 END)::DOUBLE AS injected, sum(needs::INT)::DOUBLE AS needing, sum((needs AND prefix <> '')::INT)::DOUBLE AS satisfied
  FROM (SELECT {c}.*, greatest(0, e - lead(s) OVER (PARTITION BY d ORDER BY i)) AS redundant, s IS DISTINCT FROM (SELECT min(s) FROM units u WHERE u.d = {c}.d AND k = 0) AND NOT EXISTS (SELECT 1 FROM units u WHERE u.d = {c}.d AND u.type = 'heading' AND u.s = {c}.s) AS needs FROM {c}) GROUP BY d) m USING (d)
LEFT JOIN (
  SELECT b.d, sum((type IN ('heading', 'paragraph') AND regexp_matches(substr(full_text, b::BIGINT, 2), '^\\S\\S$'))::INT) AS words, sum((type = 'list')::INT) AS bullets, sum((type = 'table')::INT) AS trows
  FROM (SELECT DISTINCT d, unnest([s, e]) AS b FROM {c}) b JOIN docs USING (d) JOIN units u ON u.d = b.d AND u.s < b AND b < u.e WHERE b > 0 AND b < length(full_text) GROUP BY b.d) k USING (d)"""


_CELL = {
    "Valid": "'✓'", "Chunks": "n::VARCHAR", "Avg utilization": "pct(utilization)", "Tiny chunks": "pct(tiny_ratio)", "Word splits": "words::VARCHAR", "Bullet splits": "bullets::VARCHAR", "Table-row splits": "trows::VARCHAR",
    "Context overhead": "pct(overhead) || CASE WHEN source = 'overlap' THEN '*' ELSE '' END", "Context coverage": "coalesce(pct(coverage), 'N/A')",
}


def _cells() -> str:
    import re

    each = [f"SELECT d, label, {i} AS line, '{name}' AS metric, {re.sub(r'pct\((\w+)\)', r'(round_even(\1 * 100, 0)::INT || ' + chr(39) + '%' + chr(39) + ')', cell)} AS cell FROM q" for i, (name, cell) in enumerate(_CELL.items())]
    return " UNION ALL ".join(each)


def _nearest(offset: str, grid: str, low: str = "0") -> str:
    """The first of the columns from ``low`` that begin closest to ``offset``."""
    return f"(list_min(list_transform(range({low}, len({grid})), lambda k: abs({grid}[k + 1] - {offset}) * 10000 + k)) % 10000)"


_TEXT_PAGES = "pages AS (SELECT doc_id::VARCHAR AS d, 1 AS p, coalesce(text, '') AS text FROM documents)"
_WRAPS = r"regexp_matches({}, '(?i)(?:,|[&/\-–—]|\b(?:and|or|but|nor|yet|so|for)\b)$')"
#: Of every line its segments (place and text), and the cells of its text; the token form counts only for an expected width.
_SEGMENTS = rf"""
split AS (SELECT *, CASE WHEN contains(raw, '|') THEN string_split(raw, '|') ELSE regexp_split_to_array(raw, '\s{{2,}}') END AS parts,
          CASE WHEN contains(raw, '|') THEN list_transform(string_split(raw, '|'), lambda x: 1) ELSE list_transform(regexp_extract_all(raw, '\s{{2,}}'), lambda x: length(x)) END AS gaps FROM reading),
segments AS (SELECT *, list_filter(list_transform(range(1, len(parts) + 1), lambda i: {{'o': coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x))), 0)::INT + coalesce(list_sum(gaps[1:i - 1]), 0)::INT + length(parts[i]) - length(ltrim(parts[i])), 't': {_inline("parts[i]")}}}), lambda x: x.t <> '') AS seg,
             {_CELLS_OF("line_text")} AS row_cells, list_filter(list_transform(regexp_split_to_array(line_text, '\s+'), lambda x: {_inline("x")}), lambda x: x <> '') AS tokens FROM split),
fences AS (SELECT *, sum(stop::INT) OVER (PARTITION BY d, p ORDER BY n) AS fence FROM (SELECT *, (kind = 'blank' OR noise IS NOT NULL OR item IS NOT NULL) AS stop FROM segments)),
runs AS (SELECT *, level IS NULL AND candidate AS opens, CASE WHEN len(row_cells) >= 2 OR kind = 'text' THEN row_cells WHEN len(tokens) >= 2 THEN NULL ELSE row_cells END AS sure FROM fences WHERE NOT stop)"""
_AS_ROW = "CASE WHEN len({0}.row_cells) < 2 AND {0}.kind <> 'text' AND len({0}.tokens) = r.width AND r.width >= 2 AND len({0}.row_cells) <> r.width THEN {0}.tokens ELSE {0}.row_cells END"
_COLUMNS = "CASE WHEN len(x.seg) > 1 AND len(r.grid) > 1 THEN list_reduce(list_transform(x.seg, lambda g: [g.o]), lambda acc, g: list_append(acc, " + _nearest("g[1]", "r.grid", "CASE WHEN len(acc) > 0 THEN least(acc[-1] + 1, len(r.grid) - 1) ELSE 0 END").replace("::INT", "") + "::INT), []::INT[]) ELSE [1] END"
_ROW_SET = lambda row, column, text: f"list_transform(range(1, len({row}) + 1), lambda q: CASE WHEN q = {column} + 1 THEN trim({row}[q] || ' ' || {text}) ELSE {row}[q] END)"
_TABLES = f"""
grown(d, p, first, i, width, grid, rows, pipes, kind, second) AS (
  SELECT d, p, n, n, len(row_cells), CASE WHEN len(seg) > 0 THEN list_transform(seg, lambda g: g.o) ELSE [indent::INT] END, [row_cells], [contains(raw, '|')], 'row', 0 FROM runs WHERE opens AND len(row_cells) >= 2
  UNION ALL
  SELECT d, p, first, n, width, CASE WHEN label = 'row' AND len(seg) = len(as_row) THEN list_transform(seg, lambda g: g.o) ELSE grid END,
         CASE label WHEN 'row' THEN list_append(rows, as_row)
           WHEN 'wrap' THEN list_append(rows[1:len(rows) - 1], list_reduce(list_concat([rows[-1]], list_transform(pieces, lambda g: [least({_nearest('g.o', 'grid')}, len(rows[-1]) - 1)::VARCHAR, g.t])), lambda a, g: {_ROW_SET('a', 'g[1]::INT', 'g[2]')}))
           ELSE list_append(rows[1:len(rows) - 1], {_ROW_SET('rows[-1]', 'tail', 'pieces[1].t')}) END,
         CASE WHEN label = 'row' THEN list_append(pipes, contains(raw, '|')) ELSE pipes END, label, CASE WHEN n = first + 1 THEN len(seg) ELSE second END
  FROM (SELECT *, CASE WHEN begins AND len(as_row) >= 2 THEN 'row' WHEN len(rows) < 2 THEN 'end' WHEN NOT begins THEN 'wrap'
                       WHEN line_kind <> 'table_row' AND NOT regexp_matches(line_text, '{_TERMINAL}') AND (coalesce(len(next_row) >= 2, false) OR len(list_filter(rows[-1], lambda x: {_WRAPS.format('x')})) > 0) THEN 'lone' ELSE 'end' END AS label,
          coalesce(list_max(list_filter(range(0, len(rows[-1])), lambda q: {_WRAPS.format('rows[-1][q + 1]')})), list_max(list_filter(range(0, len(rows[-1])), lambda q: NOT regexp_matches(rows[-1][q + 1], '{_NUMERIC}'))), len(rows[-1]) - 1) AS tail
        FROM (SELECT r.*, x.n, x.raw, x.seg, x.line_text, x.kind AS line_kind, CASE WHEN len(x.seg) > 0 THEN x.seg ELSE [{{'o': x.indent::INT, 't': {_inline('x.line_text')}}}] END AS pieces,
                CASE WHEN len(x.seg) > 1 THEN list_transform(x.seg, lambda g: g.t) ELSE {_AS_ROW.format('x')} END AS as_row, CASE WHEN y.n IS NOT NULL THEN {_AS_ROW.format('y')} END AS next_row,
                {_nearest('x.indent', 'r.grid')} = 0 AND list_contains({_COLUMNS}, 1) AS begins
              FROM grown r JOIN runs x ON x.d = r.d AND x.p = r.p AND x.n = r.i + 1 JOIN runs z ON z.d = r.d AND z.p = r.p AND z.n = r.first AND z.fence = x.fence
              LEFT JOIN runs y ON y.d = x.d AND y.p = x.p AND y.n = x.n + 1 AND y.fence = x.fence)) WHERE label <> 'end'),
whole AS (SELECT * FROM (SELECT *, max(i) OVER (PARTITION BY d, p, first) AS last FROM grown) WHERE i = last AND len(rows) >= 2),
sound AS (SELECT * FROM whole JOIN (SELECT d, p, n AS first, x2 FROM (SELECT d, p, n, lead(len(seg)) OVER (PARTITION BY d, p ORDER BY n) AS x2 FROM segments)) USING (d, p, first) WHERE len(rows) > 2 OR x2 = len(rows[1])),
chosen(d, p, first, last) AS (
  SELECT d, p, min(first), arg_min(last, first) FROM sound GROUP BY d, p
  UNION ALL SELECT c.d, c.p, min(s.first), arg_min(s.last, s.first) FROM chosen c JOIN sound s ON s.d = c.d AND s.p = c.p AND s.first > c.last GROUP BY c.d, c.p),
tables AS (SELECT d, p, first, last, columns, list_transform(range(1, len(body) + 1), lambda k: CASE WHEN len(columns) = 0 THEN body[k] WHEN len(body[k]) > len(columns)
             THEN list_append(body[k][1:len(columns) - 1], CASE WHEN flags[k] THEN array_to_string(body[k][len(columns):], ' | ') ELSE array_to_string(body[k][len(columns):], ' ') END)
             ELSE list_concat(body[k], list_transform(range(0, len(columns) - len(body[k])), lambda z: '')) END) AS rows
           FROM (SELECT d, p, first, last, CASE WHEN named THEN rows[1] ELSE [] END AS columns, CASE WHEN named THEN rows[2:] ELSE rows END AS body, CASE WHEN named THEN pipes[2:] ELSE pipes END AS flags
                 FROM (SELECT *, len(list_filter(rows[1], lambda x: regexp_matches(x, '\\d'))) = 0 AND len(list_filter(rows[1], lambda x: len({_words('x')}) > 6)) = 0
                       AND len(list_filter(rows[2:], lambda r: abs(len(r) - len(rows[1])) <= 1 AND len(list_filter(r, lambda x: regexp_matches(x, '\\d'))) > 0)) > 0 AS named FROM sound JOIN chosen USING (d, p, first, last))))"""


def _tables() -> str:
    """Blocks of free text: the structured chain with its tables replaced by those of the recursion."""
    chain = _STRUCTURED.replace(_PAGES.strip(), _TEXT_PAGES.strip())
    before, _, after = chain.partition("fenced AS (")
    roled = after[after.index("roled AS ("):]
    roled = roled.replace("FROM ran r LEFT JOIN grid g", "FROM (SELECT * FROM reading) r LEFT JOIN (SELECT * FROM tables) g").replace("r.n BETWEEN g.first AND g.last)", "r.n BETWEEN g.first AND g.last)", 1)
    return _with(before.rstrip().rstrip(","), _SEGMENTS, _TABLES, roled)


def sql() -> dict[str, str]:
    found = dict(_SQL)
    v22, v21 = _chunks(1000, True, "c"), _chunks(1000, False, "c")
    edges = lambda rows: _with(*_BASE, *rows)
    lines = r"known AS (SELECT doc_id::VARCHAR AS d, 1 AS p, unnest(range(len(l)))::INT AS n, trim(unnest(l), ' ' || chr(9) || chr(13)) AS c, 0 AS indent FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)), "
    found |= {
        "html_page_lines": rf"""
WITH x AS (SELECT page_id::VARCHAR AS document_id, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g'),
  '(?i)</?(?:{_BLOCK_TAGS})\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'), '[ \t]*\n\s*', chr(10), 'g'), chr(10)) AS l FROM pages)
SELECT document_id, unnest(range(len(l)))::INT AS line_no, unnest(l) AS line FROM x""",
        "line_types": "WITH " + lines + _LINES[_LINES.index("worded AS"):] + " SELECT d AS document_id, n AS line_no, kind AS line_type FROM typed",
        "noise": _with(_PAGES, _LINES.split("worded AS")[0].rstrip().rstrip(","), _NOISE) + " SELECT d AS document_id, p AS page_number, n AS line_no, noise FROM noise",
        "structured_blocks": _with(_STRUCTURED) + f" SELECT {_BLOCK}, after_blank, glue AS delimiter, (stop - length(text))::INT AS start_char, stop::INT AS end_char, format('block_{{:03d}}', no) AS block_id, type IN ('page_header', 'page_footer') AS is_noise FROM spanned",
        "json_documents": _with(_STRUCTURED) + " SELECT d AS document_id, format('block_{:03d}', no) AS block_id, type, text, p AS page, (stop - length(text))::INT AS start, stop::INT AS end, type IN ('page_header', 'page_footer') AS is_noise, level::INT AS level, items, columns, rows FROM spanned",
        "line_blocks": _with(_LINE) + f" SELECT {_BLOCK}, after_blank FROM blocks",
        "table_blocks": _tables() + " SELECT d AS document_id, format('block_{:03d}', no) AS block_id, columns, rows, (stop - length(text))::INT AS start_char, stop::INT AS end_char FROM spanned WHERE type = 'table'",
        "line_documents": _with(_LINE, _documents(False)) + " SELECT d AS document_id, full_text, page_count::INT AS page_count FROM docs",
        "normalized_pages": _with(_STRUCTURED, _documents(True)) + " SELECT d AS document_id, p AS page_number, a::INT AS start_char, (a + length(t))::INT AS end_char, t AS text FROM page_at",
        "structural_units": edges([]) + " SELECT d AS document_id, k::INT AS unit_no, s::INT AS start, e::INT AS end, type, heading, table_header, is_header FROM units",
        "structural_pieces": edges([_pieces(200)]) + " SELECT d AS document_id, k::INT AS unit_no, j::INT AS piece_no, s::INT AS start, e::INT AS end, type, heading, table_header, is_header FROM pieces",
        "forced_header_pairs": edges([]) + " SELECT d AS document_id, s::INT AS start, t::INT AS end FROM (SELECT *, lead(e) OVER wd AS t, lead(type) OVER wd AS next FROM units WINDOW wd AS (PARTITION BY d ORDER BY k)) WHERE is_header AND next = 'table' AND t - s > 30",
        "structural_chunks_v21": edges([v21]) + " " + _ROWS,
        "context_chunks_v22": edges([v22]) + " " + _ROWS,
        "small_context_chunks": edges([_chunks(30, True, "c")]) + " SELECT d AS document_id, i::INT AS chunk_index, s::INT AS start_char, e::INT AS end_char, prefix AS context_prefix FROM c",
        "page_attribution": edges([v21]) + " SELECT d || '_chunk_' || i AS chunk_id, p AS page_number FROM c JOIN page_at USING (d) WHERE page_at.a < c.e AND page_at.a + length(t) > c.s",
        "chunk_issues": f"""{_CHUNKS}, b AS (SELECT document_id AS d, i AS pos, CASE WHEN i % 5 = 4 THEN i + 1 ELSE i END AS idx, CASE WHEN i % 3 = 2 THEN a + 1 ELSE a END AS s, b AS e, text FROM k),
docs AS (SELECT document_id AS d, t AS full_text FROM d), o AS (SELECT *, lag(s) OVER wd AS ps, lag(e) OVER wd AS pe FROM b WINDOW wd AS (PARTITION BY d ORDER BY pos)),
x AS (SELECT 'order_preservation' AS invariant FROM b WHERE pos <> idx
UNION ALL SELECT 'max_size' FROM b WHERE length(text) > 1000
UNION ALL SELECT 'overlap' FROM o WHERE pe - ps = 1000 AND s <= pe AND s <> pe - 100
UNION ALL SELECT 'non_whitespace_coverage' FROM (SELECT d, s, coalesce(max(e) OVER (PARTITION BY d ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM (SELECT d, s, e FROM b UNION ALL SELECT d, length(full_text), NULL FROM docs)) JOIN docs USING (d) WHERE s > reach AND regexp_matches(substr(full_text, reach + 1, s - reach), '\\S')
UNION ALL SELECT 'traceability' FROM b JOIN docs USING (d) WHERE substr(full_text, greatest(s, 0) + 1, greatest(e - greatest(s, 0), 0)) <> text
UNION ALL SELECT 'offsets' FROM b JOIN docs USING (d) WHERE NOT (s >= 0 AND s < e AND e <= length(full_text)) OR e - s <> length(text)
UNION ALL SELECT 'offsets' FROM o WHERE s < ps)
SELECT invariant, count(*)::BIGINT AS n FROM x GROUP BY invariant""",
        "chunk_validation": edges([v22.replace("c_", "chunks_").replace("\nc AS", "\nchunks AS")]) + ", c AS (SELECT d, i, s, CASE WHEN i % 3 = 2 THEN e - 2 ELSE e END AS e, CASE WHEN i % 3 = 2 THEN substr(text, 1, length(text) - 2) ELSE text END AS text FROM chunks), issues AS (" + _issue_rows("c", 1000) + ") SELECT d AS document_id, invariant, count(*)::BIGINT AS issues FROM issues GROUP BY ALL",
        "block_issues": _with(_STRUCTURED) + r""",
b AS (SELECT d, p, seq, CASE WHEN seq = 1 AND p % 4 = 1 THEN ' ' ELSE text END AS t, text, stop - length(text) AS s, stop, CASE WHEN seq = 2 THEN 'block_002' ELSE format('block_{:03d}', no) END AS id, type, columns,
      CASE WHEN len(rows) > 0 THEN list_concat([rows[1][1:2]], rows[2:]) ELSE rows END AS rows, CASE WHEN p % 5 = 2 AND len(items) > 0 THEN list_concat([''], items[2:]) ELSE items END AS items FROM spanned),
x AS (SELECT d, 'non_empty_content' AS invariant FROM b WHERE NOT regexp_matches(t, '\S')
UNION ALL SELECT d, 'span_equality' FROM b WHERE t <> text
UNION ALL SELECT d, 'table_rectangularity' FROM b WHERE type = 'table' AND len(columns) > 0 AND len(list_filter(rows, lambda r: len(r) <> len(columns))) > 0
UNION ALL SELECT d, 'list_non_emptiness' FROM b WHERE type = 'list' AND (len(items) = 0 OR len(list_filter(items, lambda x: NOT regexp_matches(x, '\S'))) > 0)
UNION ALL SELECT d, 'unique_block_id' FROM b GROUP BY d, id HAVING count(*) > 1)
SELECT d AS document_id, invariant, count(*)::BIGINT AS n FROM x GROUP BY ALL""",
        "lossless_tokens": _with(_STRUCTURED) + rf""",
source AS (SELECT d, p, n, unnest(range(len(w))) AS i, unnest(w) AS token FROM (SELECT d, p, n, {_words("coalesce(item, c)")} AS w FROM typed)),
want AS (SELECT d, token, count(*) AS n, min((p, n, i)) AS spot FROM source GROUP BY ALL),
have AS (SELECT d, token, count(*) AS m FROM (SELECT d, unnest(regexp_extract_all(CASE WHEN type = 'table' THEN array_to_string(flatten(list_concat(CASE WHEN len(columns) > 0 THEN [columns] ELSE [] END, rows)), ' ') ELSE text END, '\S+')) AS token FROM blocks WHERE seq % 3 <> 2) GROUP BY ALL),
lost AS (SELECT d, token, spot, n - coalesce(m, 0) AS short FROM want LEFT JOIN have USING (d, token) WHERE n > coalesce(m, 0))
SELECT d AS document_id, sum(short)::BIGINT AS missing, (list(token ORDER BY spot))[1:10] AS first FROM lost GROUP BY d""",
        "quality_report": edges([v22]) + ", chunks_p AS (SELECT * FROM c_p), issues AS (" + _issue_rows("c", 1000) + "), q AS (" + _quality("c", "V2.2", "structural", True, True) + """)
SELECT d AS document_id, strategy AS chunking_strategy, context AS propagate_context, NOT EXISTS (SELECT 1 FROM issues WHERE issues.d = q.d) AS is_valid, n::INT AS chunk_count, utilization AS avg_utilization, tiny::INT AS tiny_chunk_count, tiny_ratio AS tiny_chunk_ratio,
  words::INT AS word_splits, bullets::INT AS bullet_splits, trows::INT AS table_row_splits, overhead AS context_overhead, source AS overhead_source, coverage AS context_coverage FROM q""",
        "strategy_comparison": edges([_windows("a"), _chunks(1000, False, "b"), v22]) + ", q AS (" + " UNION ALL ".join([_quality("a", "V1", "characters", False, False), _quality("b", "V2.1", "structural", False, True), _quality("c", "V2.2", "structural", True, True)]) + "), cells AS (" + _cells() + """)
SELECT d AS document_id, line::INT AS line, metric, max(cell) FILTER (label = 'V1') AS "V1", max(cell) FILTER (label = 'V2.1') AS "V2.1", max(cell) FILTER (label = 'V2.2') AS "V2.2" FROM cells GROUP BY ALL""",
    }
    return found
