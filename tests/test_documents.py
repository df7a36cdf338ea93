"""Structure, chunks, validation and quality on literal documents."""

import pytest
from pyspark.sql import functions as F

from lamina.operators import chunk as K
from lamina.operators import quality as Q
from lamina.operators import structure as S
from lamina.operators import validate as V
from lamina.operators.noise import noise_lines
from lamina.operators.tables import scan
from lamina.schemas import ChunkingConfig
from lamina.sources.durable import durable
from lamina.sources.sinks import from_json, to_json

FIRST = """CHAPTER 01

Key Market Facts
This is the first paragraph that goes on
and on to the next line.
• First bullet is here
  wrapped part of it
• Second bullet
Name  Role  Score
Ann  Lead  10
Bob  Dev  20

ACME Corp 2024"""
SECOND = """continues in lower case here.
1. one
2. two
(a) three

ACME Corp 2025"""
PAGES = [("d", 1, FIRST), ("d", 2, SECOND), ("d", 3, "Something else.\n\nACME Corp 2026"), ("e", 1, "   "), ("e", 2, "Only text here")]


@pytest.fixture(scope="module")
def made(spark):
    pages = spark.createDataFrame(PAGES, "document_id string, page_number int, text string")
    blocks = durable(S.structured_blocks(pages))
    documents, placed = S.normalized_documents(pages, blocks, True)
    return pages, blocks, durable(documents), durable(placed)


def test_structured_blocks(made):
    _, blocks, _, _ = made
    got = [(r["type"], r["text"], r["level"]) for r in blocks.where("document_id = 'd'").orderBy("block_id").collect()]
    assert got == [
        ("heading", "CHAPTER 01", 1), ("heading", "Key Market Facts", 2), ("paragraph", "This is the first paragraph that goes on and on to the next line.", None),
        ("list", "First bullet is here wrapped part of it\nSecond bullet", None), ("table", "Name | Role | Score\nAnn | Lead | 10\nBob | Dev | 20", None), ("page_footer", "ACME Corp 2024", None),
        ("paragraph", "continues in lower case here.", None), ("list", "one\ntwo\nthree", None), ("page_footer", "ACME Corp 2025", None), ("paragraph", "Something else.", None), ("page_footer", "ACME Corp 2026", None)]


def test_blocks_are_valid_and_survive_json(made):
    pages, blocks, _, _ = made
    text = S.structured_text(blocks)
    assert V.validate_blocks(blocks, text, pages).count() == 0
    assert from_json(to_json(blocks, text)).select("document_id", "block_id", "text", "items", "rows").exceptAll(blocks.select("document_id", "block_id", "text", "items", "rows")).count() == 0


def test_line_blocks_keep_markers(made):
    got = [(r["type"], r["text"]) for r in S.line_blocks(made[0]).where("document_id = 'd' and page_number = 2").orderBy("block_seq").collect()]
    assert got == [("paragraph", "continues in lower case here."), ("list", "1. one\n2. two"), ("paragraph", "(a) three"), ("paragraph", "ACME Corp 2025")]


def test_documents_join_pages(made):
    docs = {r["document_id"]: r for r in made[2].collect()}
    assert "Dev | 20 continues in lower" in docs["d"]["full_text"] and docs["e"]["full_text"] == "\n\nOnly text here"
    for r in docs.values():
        assert all(r["full_text"][p["start"] : p["end"]] == p["text"] for p in r["pages"])


def test_noise_needs_repetition(spark):
    rows = [("d", p, i, x) for p in range(1, 4) for i, x in enumerate(["Title page", f"body {chr(96 + p)}", "more body", "x" * p + "y", f"Brand {' ' * p} Page {p}"])]
    rows += [("e", 1, 0, "text"), ("e", 1, 1, "- 3 -"), ("f", 1, 0, "same"), ("f", 2, 0, "same")]
    got = {(r["document_id"], r["page_number"], r["line_no"]): r["noise"] for r in noise_lines(spark.createDataFrame(rows, "document_id string, page_number int, line_no int, raw string")).collect()}
    assert got == {**{("d", p, 0): "page_header" for p in (1, 2, 3)}, **{("d", p, 4): "page_footer" for p in (1, 2, 3)}, ("e", 1, 1): "page_footer"}


def table_lines(text):
    out = []
    for raw in text.split("\n"):
        kind = "table_row" if "  " in raw.strip() or "|" in raw else "text"
        out.append({"raw": raw, "text": raw.strip(), "kind": kind, "indent": len(raw) - len(raw.lstrip()), "start": kind == "table_row"})
    return out


def tables_of(text):
    return list(scan(table_lines(text)))


def test_tables():
    wrapped = tables_of("Name      Role        Score\nAnn       Lead of     10\n          the team\nBob       Dev         20")
    assert wrapped == [{"first": 0, "stop": 4, "columns": ["Name", "Role", "Score"], "rows": [["Ann", "Lead of the team", "10"], ["Bob", "Dev", "20"]], "pipes": [False, False]}]
    assert tables_of("a | b\nc | d | e") == []
    assert tables_of("x | y\np | q\nr | s")[0]["columns"] == []
    assert tables_of("one line | only") == []


def test_a_lone_piece_goes_to_the_cell_that_trails_off():
    lone = tables_of("Name      Place       Age\nAnn       Rome,       10\nParis\nBob       Ulm         20")
    assert lone[0]["rows"] == [["Ann", "Rome, Paris", "10"], ["Bob", "Ulm", "20"]]
    ended = tables_of("Name      Place       Age\nAnn       Rome        10\nBob       Ulm         20\nThe end.")
    assert ended[0]["stop"] == 3


def test_wraps_of_several_columns_share_a_line():
    both = tables_of("Grade           Note                     Pay\nMiddle (3-5     Sweet spot, most of      90\nyrs)                                     openings\nSenior          Rare                     120")
    assert both[0]["rows"][0] == ["Middle (3-5 yrs)", "Sweet spot, most of", "90 openings"]


def test_rows_are_made_rectangular(spark):
    from pyspark.sql import functions as F

    from lamina.functions.text import rectangularize

    df = spark.createDataFrame([([["a"], ["a", "b", "c"], ["d", "e", "f"]], [False, False, True])], "r array<array<string>>, p array<boolean>")
    assert df.select(rectangularize(F.col("r"), F.lit(2), F.col("p")).alias("x")).first()["x"] == [["a", ""], ["a", "b c"], ["d", "e | f"]]


def test_character_windows(spark):
    df = spark.createDataFrame([("abcdefghijkl",), ("",), ("abcd",)], "t string").selectExpr("length(t) as n")
    got = [[(s["start"], s["end"]) for s in r["x"]] for r in df.select(K.char_spans(df["n"], 5, 2).alias("x")).collect()]
    assert got == [[(0, 5), (3, 8), (6, 11), (9, 12)], [], [(0, 4)]]
    with pytest.raises(ValueError):
        K.char_spans(df["n"], 5, 5)


def plain(spark, text):
    return spark.createDataFrame([("p", text, [(1, text, 0, len(text))])], "document_id string, full_text string, pages array<struct<page_number:int,text:string,start:int,end:int>>")


def test_blank_windows_are_skipped(spark):
    rows = K.chunk_documents(plain(spark, "aaaaa" + " " * 10 + "bbbbb"), ChunkingConfig(5, 0)).orderBy("chunk_index").collect()
    assert [(r["chunk_index"], r["start_char"], r["end_char"]) for r in rows] == [(0, 0, 5), (1, 15, 20)]


def test_context_chunks(made):
    _, _, documents, blocks = made
    rows = K.chunk_documents(documents, ChunkingConfig(60, 0, "structural", True), blocks).where("document_id = 'd'").orderBy("chunk_index").collect()
    assert [(r["text"][:12], r["context_prefix"]) for r in rows][2:6] == [
        ("First bullet", "Key Market Facts"), ("Second bulle", "Key Market Facts"), ("Ann | Lead |", "Key Market Facts\nName | Role | Score"), ("Bob | Dev | ", "Key Market Facts\nName | Role | Score")]
    assert rows[-1]["page_numbers"] == [2, 3] and rows[4]["contextualized_text"].endswith("Score\nAnn | Lead | 10")


@pytest.mark.parametrize("config", [ChunkingConfig(60, 10), ChunkingConfig(60, 0, "structural"), ChunkingConfig(60, 0, "structural", True)])
def test_own_chunks_are_valid(made, config):
    _, _, documents, blocks = made
    assert V.validate_chunks(documents, durable(K.chunk_documents(documents, config, blocks)), config, blocks).collect() == []


def test_broken_chunks_are_reported(spark):
    docs, config = plain(spark, "abcdefghij klmnop"), ChunkingConfig(5, 0)
    rows = [("p", 0, 0, 5, "abcde"), ("p", 5, 6, 11, "fghij "), ("p", 2, 20, 30, "zz"), ("p", 3, 2, 4, "cd")]
    bad = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "document_id string, chunk_index int, start_char int, end_char int, text string, pos int")
    found = {r["invariant"] for r in V.validate_chunks(docs, bad, config).collect()}
    assert found == {"order_preservation", "max_size", "non_whitespace_coverage", "traceability", "offsets"}


def issues(spark, text, spans, config):
    """(invariant, chunk_index) of chunks given as spans of one text."""
    rows = [("p", i, a, b, text[a:b], i) for i, (a, b) in enumerate(spans)]
    chunks = spark.createDataFrame(rows, "document_id string, chunk_index int, start_char int, end_char int, text string, pos int")
    return sorted((r["invariant"], r["chunk_index"]) for r in V.validate_chunks(plain(spark, text), chunks, config).collect())


def test_each_invariant_of_character_chunks(spark):
    text, config = "abcdefghijklmnop", ChunkingConfig(8, 2)
    assert issues(spark, text, [(0, 8), (6, 14), (12, 16)], config) == []
    assert issues(spark, text, [(0, 8), (7, 15), (13, 16)], config) == [("overlap", 1)]
    assert issues(spark, text, [(0, 9), (9, 16)], config) == [("max_size", 0)]
    assert issues(spark, text, [(0, 7), (8, 16)], config) == [("non_whitespace_coverage", None)]
    assert issues(spark, text, [(8, 16), (0, 8)], config) == [("offsets", 1), ("overlap", 1)]
    assert ("offsets", 1) in issues(spark, text, [(0, 8), (6, 20)], config)


def test_invalid_blocks_raise(made):
    _, blocks, _, _ = made
    text = durable(S.structured_text(blocks))
    V.require_spans(blocks, text)
    broken = blocks.selectExpr(*[c if c != "text" else "case when block_id = 'block_002' then 'other' else text end as text" for c in blocks.columns])
    with pytest.raises(ValueError, match="span_equality"):
        V.require_spans(durable(broken), text)


def test_unknown_block_types_raise(made):
    pages, blocks, _, _ = made
    documents, _ = S.normalized_documents(pages, blocks.withColumn("type", F.lit("sidebar")), True)
    with pytest.raises(Exception, match="unexpected block type"):
        documents.collect()


def test_both_readings_by_one_call(made):
    for structured in (True, False):
        documents, placed = S.normalize_documents(made[0], structured)
        assert documents.count() == 2 and placed.count() > 0


def test_json_problems(spark, made):
    from lamina.sources.sinks import json_problems

    good = to_json(made[1], S.structured_text(made[1])).select("json")
    bad = spark.createDataFrame([("{",), ('{"document_id":"x","full_text":"","blocks":[{"block_id":"b","type":"heading","text":"t","page":1,"start":0,"end":1},{"block_id":"b","type":"list","text":"t","page":1,"start":0,"end":1}]}',)], "json string")
    assert json_problems(good).count() == 0
    assert sorted((r["block_id"], r["problem"]) for r in json_problems(bad).collect() if r["block_id"]) == [("b", "heading without level"), ("b", "id used twice"), ("b", "list without items")]
    assert json_problems(bad).where("problem = 'malformed document'").count() == 1


def test_quality(spark):
    docs = plain(spark, "hello world")
    blocks = spark.createDataFrame([("p", 1, 0, "paragraph", "hello world", [], [], [], 0, 11)], "document_id string, page_number int, block_seq int, type string, text string, items array<string>, columns array<string>, rows array<array<string>>, start_char int, end_char int")
    config = ChunkingConfig(4, 0)
    row = Q.evaluate_quality(docs, durable(K.chunk_documents(docs, config)), config, blocks).first()
    assert (row["chunk_count"], row["word_splits"], row["is_valid"], row["context_coverage"]) == (3, 2, True, None)
    assert abs(row["avg_utilization"] - 11 / 12) < 1e-9 and row["overhead_source"] == "none"


def test_stream(spark, tmp_path):
    from lamina.streaming.chunks import chunk_stream

    spark.createDataFrame(PAGES, "document_id string, page_number int, text string").coalesce(1).write.parquet(f"{tmp_path}/in")
    chunk_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", ChunkingConfig(60, 0, "structural")).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").where("document_id = 'd'").count() == 6


def test_entry_point_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
