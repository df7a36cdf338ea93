"""Line classifiers as Spark expressions.  Each takes one physical line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_inline, split_columns, strip

# Markers, patterns and word lists of the classifiers.
LIST_ITEM = r"^(?:[●•\-→]|\d+[.)])\s+"
LIST_MARKER = r"(?U)^(?:[•⁃■●→–*\-]|\d+[.)]|\([A-Za-z0-9]+\)|[A-Za-z][.)]|\[\d+\])\s+"
NUMERIC_CELL = r"(?U)^[\d$€£¥(),.%+\-/: ]+$"
SENTENCE_TERMINAL = r"[.!?][\"')\]]?$"
WRAP_END = r"(?i)(?:,|[&/\-–—]|\b(?:and|or|but|nor|yet|so|for)\b)$"
NUMBERED_LABEL = r"^[A-Z][A-Za-z]*\s+[0-9]+[A-Za-z]*\s*:\s+\S"
NUMBERED_HEADING = r"^[A-Z][A-Za-z]*\s+\d+(?:\.\d+)*[A-Za-z]?(?:\s*[:—–-]\s*.*)?$"
ALL_CAPS = r"^[A-Z0-9/&()'’.,\-–—\s]+$"
PAGE_NUMBER = r"(?i)^(?:page\s+)?\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?$"
DASHED_NUMBER = r"^[-–—]\s*\d{1,4}\s*[-–—]$"
ROMAN = r"(?i)^[ivxlcdm]{1,6}$"
SMALL_WORDS = "a an and as at by for in of on or the to with".split()
CLAUSE_WORDS = (
    "am are be been being can could did do does had has have how is it its should that their there these "
    "they this those was were what when where which who why will would you your"
).split()
MAX_HEADING = 90


def words(c: Column) -> Column:
    return F.filter(F.split(strip(c), r"(?U)\s+"), lambda w: w != "")


def is_list_item(c: Column) -> Column:
    return c.rlike(LIST_ITEM)


def list_item_text(c: Column) -> Column:
    """What follows the marker of a list item; null for other lines and for bare markers."""
    rest = strip(F.regexp_replace(c, LIST_MARKER, ""))
    return F.when(c.rlike(LIST_MARKER) & (rest != ""), rest)


def is_page_number(c: Column) -> Column:
    return c.rlike(PAGE_NUMBER) | c.rlike(DASHED_NUMBER) | c.rlike(ROMAN)


def is_caps_heading(c: Column) -> Column:
    n = F.size(words(c))
    most = F.when(c.rlike(r"\d"), 8).otherwise(4)
    return ~c.rlike("[:.;!?]") & c.rlike(ALL_CAPS) & n.between(2, most) & c.rlike(r"\p{L}")


def is_title_heading(c: Column) -> Column:
    w = words(c)
    return ~c.rlike("[:.;!?]") & ~F.contains(c, F.lit("  ")) & F.size(w).between(2, 5) & F.forall(w, lambda x: x.rlike("^[A-Z][a-z']*$"))


def heading_level(line: Column) -> Column:
    """1 and more for numbered headings by their dots, 2 for short capital or title lines, else null."""
    c = strip(line)
    number = F.regexp_extract(c, r"\d+(?:\.\d+)*", 0)
    fits = (c != "") & (F.char_length(c) <= MAX_HEADING) & ~is_list_item(c)
    level = F.when(c.rlike(NUMBERED_HEADING), F.when(number == "", 1).otherwise(F.size(F.split(number, r"\."))))
    return F.when(fits, level.when(is_caps_heading(c) | is_title_heading(c), 2)).cast("int")


def is_heading_like(line: Column) -> Column:
    c = strip(line)
    short = F.char_length(c) <= MAX_HEADING
    n, letters, upper = F.size(words(c)), F.regexp_count(c, F.lit(r"\p{L}")), F.regexp_count(c, F.lit(r"\p{Lu}"))
    capitals = (n <= 14) & (letters > 0) & (upper >= letters * F.lit(0.8).cast("double")) & ((n >= 2) | (F.char_length(c) >= 8))
    label = short & c.rlike(NUMBERED_LABEL) & ~c.rlike(SENTENCE_TERMINAL)
    return (c != "") & ~is_list_item(c) & ((short & c.endswith(":")) | label | capitals)


def is_title_cased(c: Column) -> Column:
    w = F.regexp_extract_all(c, F.lit(r"[A-Za-z][A-Za-z'/-]*"), 0)
    n = F.size(w)
    clause = F.exists(w, lambda x: F.lower(x).isin(CLAUSE_WORDS))
    title = F.filter(w, lambda x: F.lower(x).isin(SMALL_WORDS) | (x.rlike("^[A-Z]") & (F.substr(x, F.lit(2)) == F.lower(F.substr(x, F.lit(2))))))
    return n.between(2, 12) & (F.char_length(c) <= MAX_HEADING) & ~clause & (F.size(title) >= F.greatest(F.lit(2), n - 1))


def is_table_candidate(c: Column) -> Column:
    cells = split_columns(c)
    compact = F.exists(cells, lambda x: (F.size(words(x)) <= 4) | x.rlike(NUMERIC_CELL))
    return (c != "") & ~is_list_item(c) & (F.size(cells) >= 2) & compact


def line_type(line: Column) -> Column:
    c = strip(line)
    return F.when(c == "", "blank").when(is_list_item(c), "list_item").when(is_table_candidate(c), "table_row").when(is_heading_like(c) | is_title_cased(c), "heading").otherwise("text")


def line_text(line: Column, kind: Column) -> Column:
    """The line's text: table rows keep their gaps, the rest is normalized."""
    return F.when(kind == "table_row", strip(line)).otherwise(normalize_inline(line))


def is_section_label(c: Column) -> Column:
    w = words(c)
    named = F.forall(w, lambda x: ~x.rlike(r"^[\p{L}\p{N}]") | x.rlike(r"^\p{Lu}"))
    return (c != "") & ~c.rlike(r"[:,;\-–—&/]$") & ~c.rlike(r"^\p{Nd}") & F.size(w).between(2, 6) & named


def joins_next(text: Column, depth: Column, following: Column, following_depth: Column) -> Column:
    """Whether a paragraph line goes on in the next line (both plain text)."""
    stop = text.rlike(SENTENCE_TERMINAL) | following.rlike(r"^\p{Nd}") | is_heading_like(following) | is_title_cased(following) | is_section_label(following)
    n, m = F.size(words(text)), F.size(words(following))
    fragment = (n <= 2) & (m <= 3) & ~is_section_label(text) & ~is_section_label(following) & (following.rlike(r"^.[\s\S]*\p{Ll}") | (text.rlike(r"\p{Lu}") & ~text.rlike(r"\p{Ll}")))
    signal = text.rlike(WRAP_END) | (n.between(1, 2) & text.rlike(r"^\p{Ll}")) | following.rlike(r"^\p{Ll}") | (following_depth > depth) | (F.char_length(text) >= 55) | (n >= 9) | fragment
    return ~stop & following.rlike("^[\\p{L}\\p{N}(\"']") & signal


def splits_word(text: Column, at: Column) -> Column:
    return F.substr(text, at, F.lit(2)).rlike(r"(?U)^\S\S$")
