"""Text functions as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word tokens, and the characters that preprocessing replaces or removes.
WORD = r"[\p{L}\p{N}_]+(?:[-/'’][\p{L}\p{N}_]+)*"
SPACES = "              　"
INVISIBLE = "​‌‍‎‏﻿­"
CONTROL = "".join(map(chr, [*range(0x00, 0x09), *range(0x0E, 0x20), 0x7F]))
SENTENCE_END = r"([.!?])((?U)\s+)"


def count_words(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0))


def count_chars(c: Column) -> Column:
    return F.coalesce(F.char_length(c), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space, in Unicode's sense, at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def preprocess(c: Column) -> Column:
    """Line ends to LF, odd spaces to spaces, invisible and control characters out, blank runs down to one line."""
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.translate(c, SPACES + "\x0b\x0c" + INVISIBLE + CONTROL, " " * len(SPACES) + "\n\n")
    return F.regexp_replace(F.regexp_replace(c, "[ \t]+\n", "\n"), "\n{3,}", "\n\n")


def normalize_inline(c: Column) -> Column:
    c = F.regexp_replace(strip(c), "[ \t]+", " ")
    c = F.regexp_replace(c, r"[ \t]+([.,;:!?)\]}])", "$1")
    return F.regexp_replace(c, r"([(\[{])[ \t]+", "$1")


def indent(c: Column) -> Column:
    """Width of the leading blanks; a tab is four."""
    return F.char_length(F.regexp_replace(F.regexp_extract(c, "^[ \t]*", 0), "\t", "    "))


def join_wrapped(lines: Column) -> Column:
    """The lines of an array stripped, blank ones left out, joined by single spaces."""
    full = F.filter(F.transform(lines, strip), lambda x: x != "")
    return strip(F.regexp_replace(F.array_join(full, " "), "[ \t]+", " "))


def repetition_key(c: Column) -> Column:
    """Lower case with digit runs and white-space runs collapsed: what repeats from page to page."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"(?U)\d+", "#"), r"(?U)\s+", " ")


def split_columns(c: Column) -> Column:
    """Cells by pipes if there are any, else by gaps of two and more blanks; empty ones left out."""
    parts = F.when(F.contains(c, F.lit("|")), F.split(c, r"(?U)\s*\|\s*")).otherwise(F.split(c, r"(?U)\s{2,}"))
    return F.transform(F.filter(parts, lambda x: strip(x) != ""), normalize_inline)


def render_table(header: Column, rows: Column) -> Column:
    lines = F.transform(rows, lambda r: F.array_join(r, " | "))
    head = F.array_join(header, " | ")
    return F.array_join(F.when(F.size(header) > 0, F.concat(F.array(head), lines)).otherwise(lines), "\n")


def rectangularize(rows: Column, width: Column, joiners: Column) -> Column:
    """Rows padded with empty cells, or folded into their last cell, to ``width`` cells; unchanged without a width."""
    def fit(r: Column, i: Column) -> Column:
        padded = F.concat(r, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0))))
        rest = F.array_join(F.slice(r, width, F.greatest(F.size(r) - width + 1, F.lit(1))), " ")
        piped = F.array_join(F.slice(r, width, F.greatest(F.size(r) - width + 1, F.lit(1))), " | ")
        folded = F.concat(F.slice(r, 1, F.greatest(width - 1, F.lit(0))), F.array(F.when(F.get(joiners, i), piped).otherwise(rest)))
        return F.when(width <= 0, r).when(F.size(r) > width, folded).otherwise(padded)

    return F.transform(rows, fit)


def sentences(c: Column) -> Column:
    """Pieces without gaps, cut after the white space that follows ``. ! ?``."""
    return F.filter(F.split(F.regexp_replace(c, r"(?U)([.!?])(\s+)", "$1$2\u0001"), "\u0001"), lambda x: x != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def running_ends(lengths: Column, start: Column, gap: int = 0) -> Column:
    """The end of each of texts of these lengths that follow each other from ``start``, ``gap`` characters apart."""
    zero = F.struct((start - gap).cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda s, n: let((s["at"] + n + gap).cast("int"), lambda e: F.struct(e.alias("at"), F.concat(s["out"], F.array(e)).alias("out")))
    return F.aggregate(lengths, zero, step, lambda s: s["out"])


def spans(pieces: Column, start: Column, gap: int = 0) -> Column:
    """(start, end) of pieces that follow each other from ``start``, ``gap`` characters apart."""
    each = lambda n: F.transform(running_ends(n, start, gap), lambda e, i: F.struct((e - F.get(n, i)).cast("int").alias("start"), e.alias("end")))
    return let(F.transform(pieces, F.char_length), each)


def contextualized(prefix: Column, text: Column) -> Column:
    return F.when(F.coalesce(prefix, F.lit("")) != "", F.concat_ws("\n", prefix, text)).otherwise(text)


def starts_lowercase(c: Column) -> Column:
    return c.rlike(r"(?U)^\s*\p{Ll}")


def ends_statement(c: Column) -> Column:
    return c.rlike(r"(?U)[.!?:][\"')\]]*\s*$")


def page_delimiter(current: Column, following: Column) -> Column:
    """Between two pages of a normalized document: a space inside a sentence, else a blank line."""
    empty = (current == "") | (following == "")
    return F.when(empty | ends_statement(current), "\n\n").when(starts_lowercase(following), " ").otherwise("\n\n")


def percent(c: Column) -> Column:
    """Whole per cent, halves to even."""
    return F.bround(c * 100).cast("int")
