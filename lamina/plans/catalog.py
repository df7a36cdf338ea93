"""Registry of the structuring and chunking queries; the SQL that checks them is in ``oracle``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.functions import classify as C
from lamina.functions import text as T
from lamina.operators import structure as S
from lamina.operators.chunk import chunk_documents, header_pairs, pieces, units
from lamina.operators.noise import noise_lines
from lamina.operators.quality import comparison_cells, compare_strategies, evaluate_quality
from lamina.operators.validate import lost_tokens, validate_blocks, validate_chunks
from lamina.schemas import STRATEGIES, ChunkingConfig
from lamina.sources.durable import durable
from lamina.sources.pages import conversation_pages, document_pages, extracted_documents, html_pages
from lamina.sources.sinks import from_json, to_json

from . import oracle

V1, V21, V22 = (STRATEGIES[k][1] for k in ("v1.0", "v2.1", "v2.2"))


def minutes_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations laid out as minutes: running lines on every page, numbered headings, lists of what users say, tables.

    Each turn is a page with all of its text, so the structuring queries meet every kind of block.
    """
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("t", F.coalesce("text", F.lit("")))
    n, size = (F.col("turn") + 1).cast("string"), F.char_length("t")
    body = F.when(F.col("role") == "user", F.concat(F.lit("• "), F.regexp_replace("t", r"\. ", ".\n• "))).otherwise(F.col("t"))
    heading = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Section "), F.floor(F.col("turn") / 3 + 1).cast("string"), F.lit("."), n, F.lit("\n"))).otherwise("")
    table = F.when(F.col("turn") % 3 == 2, F.concat(F.lit("\n\nItem | Turn | Length\nfirst | "), n, F.lit(" | "), size.cast("string"), F.lit("\nother | "), (F.col("turn") + 2).cast("string"), F.lit(" | "), (size * 2).cast("string"))).otherwise("")
    text = F.concat(F.lit("Minutes of meeting\n\n"), heading, body, table, F.lit("\n\nPage "), n)
    return rows.select(F.col("conv_id").cast("string").alias("document_id"), (F.col("turn") + 1).cast("int").alias("page_number"), text.alias("text"))


def _structured(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    pages = minutes_pages(spark, sf_dir)
    blocks = durable(S.structured_blocks(pages), "blocks")
    documents, placed = S.normalized_documents(pages, blocks, True)
    return pages, blocks, durable(documents, "documents"), durable(placed, "placed")


def _plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = extracted_documents(document_pages(spark, sf_dir), reject_blank=False)
    whole = F.struct(F.lit(1).alias("page_number"), F.col("full_text").alias("text"), F.lit(0).alias("start"), F.char_length("full_text").alias("end"))
    return docs.select("document_id", "full_text", F.array(whole).alias("pages"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_pages(spark, sf_dir).select("document_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))


def page_stats(spark, sf_dir):
    return conversation_pages(spark, sf_dir).select("document_id", "page_number", T.count_words(F.col("text")).cast("int").alias("word_count"), T.count_chars(F.col("text")).cast("int").alias("char_count"))


def html_page_lines(spark, sf_dir):
    return html_pages(spark, sf_dir).select("document_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def document_stats(spark, sf_dir):
    pages = conversation_pages(spark, sf_dir)
    words = pages.groupBy("document_id").agg(F.sum(T.count_words(F.col("text"))).cast("long").alias("word_count"))
    docs = extracted_documents(pages, reject_blank=False)
    return docs.join(words, "document_id").select("document_id", F.col("page_count").cast("long").alias("page_count"), "word_count", F.char_length("full_text").cast("long").alias("char_count"))


def preprocess_text(spark, sf_dir):
    return document_pages(spark, sf_dir).select("document_id", T.preprocess(F.col("text")).alias("text"))


def inline_normalize(spark, sf_dir):
    return _lines(spark, sf_dir).select("document_id", "line_no", T.normalize_inline(F.col("raw")).alias("text"), T.indent(F.col("raw")).alias("indent"))


def line_classes(spark, sf_dir):
    line = T.strip(F.col("raw"))
    return _lines(spark, sf_dir).select("document_id", "line_no", C.list_item_text(line).alias("item"), C.heading_level(line).alias("level"), C.is_page_number(line).alias("page_number"), C.is_table_candidate(line).alias("table_row"), C.is_list_item(line).alias("list_item"))


def line_types(spark, sf_dir):
    return _lines(spark, sf_dir).select("document_id", "line_no", C.line_type(F.col("raw")).alias("line_type"))


def noise(spark, sf_dir):
    lines = minutes_pages(spark, sf_dir).select("document_id", "page_number", F.posexplode(F.split(T.preprocess(F.col("text")), "\n", -1)).alias("line_no", "raw"))
    return noise_lines(lines)


def char_chunks_v1(spark, sf_dir):
    return chunk_documents(_plain(spark, sf_dir), V1).select("document_id", "chunk_id", "chunk_index", "start_char", "end_char", "text", "word_count", "char_count")


def char_chunk_stats(spark, sf_dir):
    return char_chunks_v1(spark, sf_dir).groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.sum("word_count").alias("total_word_count"), F.sum("char_count").alias("total_char_count"))


def sentence_spans(spark, sf_dir):
    return document_pages(spark, sf_dir).select("document_id", F.posexplode(T.spans(T.sentences(F.col("text")), F.lit(0))).alias("sentence_no", "s")).select("document_id", "sentence_no", F.col("s.start").alias("start_char"), F.col("s.end").alias("end_char"))


def structured_blocks(spark, sf_dir):
    return S.structured_blocks(minutes_pages(spark, sf_dir))


def line_blocks(spark, sf_dir):
    return S.line_blocks(minutes_pages(spark, sf_dir))


def table_blocks(spark, sf_dir):
    return S.structured_blocks(document_pages(spark, sf_dir)).where("type = 'table'").select("document_id", "block_id", "columns", "rows", "start_char", "end_char")


def normalized_pages(spark, sf_dir):
    _, _, documents, _ = _structured(spark, sf_dir)
    page = F.transform("pages", lambda p: F.struct(p["page_number"].alias("page_number"), p["start"].alias("start_char"), p["end"].alias("end_char"), F.substr("full_text", p["start"] + 1, p["end"] - p["start"]).alias("text")))
    return documents.select("document_id", F.explode(page).alias("p")).select("document_id", "p.*")


def line_documents(spark, sf_dir):
    """The ``line`` reading of whole documents, as one call gives it."""
    documents, _ = S.normalize_documents(minutes_pages(spark, sf_dir), structured=False)
    return documents.select("document_id", "full_text", F.size("pages").alias("page_count"))


def structural_units(spark, sf_dir):
    _, _, documents, blocks = _structured(spark, sf_dir)
    return units(documents, blocks).drop("text")


def structural_pieces(spark, sf_dir):
    _, _, documents, blocks = _structured(spark, sf_dir)
    return pieces(units(documents, blocks), 200)


def forced_header_pairs(spark, sf_dir):
    _, _, documents, blocks = _structured(spark, sf_dir)
    return header_pairs(units(documents, blocks), 30)


def structural_chunks_v21(spark, sf_dir):
    _, _, documents, blocks = _structured(spark, sf_dir)
    return chunk_documents(documents, V21, blocks)


def context_chunks_v22(spark, sf_dir):
    _, _, documents, blocks = _structured(spark, sf_dir)
    return chunk_documents(documents, V22, blocks)


def small_context_chunks(spark, sf_dir):
    """Chunks too small for a table's header and row, for long sentences and for many prefixes."""
    _, _, documents, blocks = _structured(spark, sf_dir)
    return chunk_documents(documents, ChunkingConfig(30, 0, "structural", True), blocks).select("document_id", "chunk_index", "start_char", "end_char", "context_prefix")


def page_attribution(spark, sf_dir):
    return structural_chunks_v21(spark, sf_dir).select("chunk_id", F.explode("page_numbers").alias("page_number"))


def chunk_issues(spark, sf_dir):
    """Issues of chunks broken on purpose: every third is shifted by one and every fifth loses its index."""
    docs = durable(_plain(spark, sf_dir), "documents")
    broken = chunk_documents(docs, V1).withColumn("pos", F.col("chunk_index"))
    broken = broken.withColumn("start_char", F.when(F.col("chunk_index") % 3 == 2, F.col("start_char") + 1).otherwise(F.col("start_char")))
    broken = broken.withColumn("chunk_index", F.when(F.col("pos") % 5 == 4, F.col("pos") + 1).otherwise(F.col("pos")))
    return validate_chunks(docs, durable(broken, "chunks"), V1).groupBy("invariant").agg(F.count(F.lit(1)).alias("n"))


def chunk_validation(spark, sf_dir):
    """Issues of structural chunks of which every third lost its last two characters; the others are valid."""
    _, _, documents, blocks = _structured(spark, sf_dir)
    elements = durable(units(documents, blocks), "units")
    lost = F.col("chunk_index") % 3 == 2
    chunks = chunk_documents(documents, V22, elements=elements).withColumns({
        "end_char": F.when(lost, F.col("end_char") - 2).otherwise(F.col("end_char")),
        "text": F.when(lost, F.substr("text", F.lit(1), F.char_length("text") - 2)).otherwise(F.col("text")),
    })
    issues = validate_chunks(documents, durable(chunks, "chunks"), V22, elements=elements)
    return issues.groupBy("document_id", "invariant").agg(F.count(F.lit(1)).alias("issues"))


def _damaged(blocks: DataFrame) -> DataFrame:
    """Blocks broken on purpose, by their place in the page: texts, ids, table rows and list items."""
    at = F.col("block_seq")
    return blocks.withColumns({
        "text": F.when((at == 1) & (F.col("page_number") % 4 == 1), F.lit(" ")).otherwise(F.col("text")),
        "block_id": F.when(at == 2, F.lit("block_002")).otherwise(F.col("block_id")),
        "rows": F.transform("rows", lambda r, i: F.when(i == 0, F.slice(r, 1, 2)).otherwise(r)),
        "items": F.when(F.col("page_number") % 5 == 2, F.transform("items", lambda x, i: F.when(i == 0, F.lit("")).otherwise(x))).otherwise(F.col("items")),
    })


def block_issues(spark, sf_dir):
    pages = minutes_pages(spark, sf_dir)
    blocks = durable(S.structured_blocks(pages), "blocks")
    broken = durable(_damaged(blocks), "broken")
    return validate_blocks(broken, S.structured_text(blocks)).groupBy("document_id", "invariant").agg(F.count(F.lit(1)).alias("n"))


def lossless_tokens(spark, sf_dir):
    """What is lost if every third block of a page is left out."""
    pages = minutes_pages(spark, sf_dir)
    blocks = durable(S.structured_blocks(pages), "blocks")
    return lost_tokens(pages, blocks.where("block_seq % 3 <> 2"))


def quality_report(spark, sf_dir):
    _, _, documents, blocks = _structured(spark, sf_dir)
    elements = durable(units(documents, blocks), "units")
    return evaluate_quality(documents, durable(chunk_documents(documents, V22, elements=elements), "chunks"), V22, elements=elements)


def strategy_comparison(spark, sf_dir):
    _, _, documents, blocks = _structured(spark, sf_dir)
    return comparison_cells(compare_strategies(documents, blocks))


def json_documents(spark, sf_dir):
    blocks = durable(S.structured_blocks(minutes_pages(spark, sf_dir)), "blocks")
    return from_json(to_json(blocks, S.structured_text(blocks)))


def token_counts(spark, sf_dir):
    tokens = F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)).alias("token")
    return conversation_pages(spark, sf_dir).select("document_id", tokens).groupBy("document_id", "token").agg(F.count(F.lit(1)).alias("n"))


def page_numbers_in_order(spark, sf_dir):
    at = Window.partitionBy("document_id").orderBy("page_number")
    pages = conversation_pages(spark, sf_dir)
    following = pages.withColumn("next", F.lead("text").over(at)).where("next is not null")
    return following.select("document_id", "page_number", T.page_delimiter(F.col("text"), F.col("next")).alias("delimiter"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_chunks_v22(spark, sf_dir)


_QUERIES = [
    page_stats, html_page_lines, document_stats, preprocess_text, inline_normalize, line_classes, line_types, noise, char_chunks_v1, char_chunk_stats, sentence_spans, structured_blocks, line_blocks, table_blocks,
    normalized_pages, line_documents, structural_units, structural_pieces, forced_header_pairs, structural_chunks_v21, context_chunks_v22, small_context_chunks, page_attribution, chunk_issues, chunk_validation, block_issues,
    lossless_tokens, quality_report, strategy_comparison, json_documents, token_counts, page_numbers_in_order,
]


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict:
    return oracle.sql()
