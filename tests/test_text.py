"""Text functions and line classifiers on literals."""

import pytest
from pyspark.sql import functions as F

from lamina.functions import classify as C
from lamina.functions import text as T
from lamina.schemas import ChunkingConfig, get_chunking_strategy


def each(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string").select("i", expression(F.col("s")).alias("x")).orderBy("i").collect()
    return [r["x"] for r in rows]


def test_counts_and_cleanup(spark):
    assert each(spark, ["It's well-known: 3/4 naïve | café", "", None], T.count_words) == [5, 0, 0]
    assert each(spark, ["a\r\nb\rc", "x​y z\x07", "a \t\nb\n\n\n\nc", "p\x0bq\x0cr"], T.preprocess) == ["a\nb\nc", "xy z", "a\nb\n\nc", "p\nq\nr"]
    assert each(spark, ["  a \t b , c ( d ) ", " x "], T.normalize_inline) == ["a b, c (d)", "x"]
    assert each(spark, ["\t x", "   x", "x"], T.indent) == [5, 3, 0]
    assert each(spark, ["Page  12 of 40", " A\tB "], T.repetition_key) == ["page # of #", "a b"]
    assert each(spark, ["a | b |", "a  b c", "one"], T.split_columns) == [["a", "b"], ["a", "b c"], ["one"]]
    assert each(spark, ["One. Two!  Three", "x"], T.sentences) == [["One. ", "Two!  ", "Three"], ["x"]]


def test_classifiers(spark):
    assert each(spark, ["- x", "(a) y", "[1] z", "A. w", "-", "ab. x", "● item"], C.list_item_text) == ["x", "y", "z", "w", None, None, "item"]
    assert each(spark, ["CHAPTER 01", "Section 4.1: Scope", "KEY FACTS", "Key Market Facts", "KEY FACTS: NOW", "AI AGENT IDEAS BY DOMAIN", "REPORT FOR THE YEAR 2024", "plain text", "1. Item One", "Name  Role  Score"], C.heading_level) == [1, 2, 2, 2, None, None, 2, None, None, None]
    assert each(spark, ["3", "Page 1 of 42", "- 3 -", "iv", "12345", "hello"], C.is_page_number) == [True, True, True, True, False, False]
    assert each(spark, ["", "- x y", "a | b", "Notes:", "Week 4: Git and more", "INTRODUCTION HERE", "The Art of War", "this is just text"], C.line_type) == ["blank", "list_item", "table_row", "heading", "heading", "heading", "heading", "text"]


def test_rectangularize_and_percent(spark):
    df = spark.createDataFrame([([["a"], ["a", "b", "c"], ["d", "e", "f"]], [False, False, True])], "r array<array<string>>, p array<boolean>")
    assert df.select(T.rectangularize(F.col("r"), F.lit(2), F.col("p")).alias("x")).first()["x"] == [["a", ""], ["a", "b c"], ["d", "e | f"]]
    assert spark.range(1).select(T.percent(F.lit(0.025)).alias("x")).first()["x"] == 2


def test_configurations():
    assert get_chunking_strategy("v2.2")[1] == ChunkingConfig(1000, 0, "structural", True)
    for bad in (lambda: get_chunking_strategy("v9"), lambda: ChunkingConfig(0), lambda: ChunkingConfig(chunking_strategy="x")):
        with pytest.raises(ValueError):
            bad()
