"""Invariants of chunks and of structured blocks, each a set of issue rows.

Issues: document_id, invariant, chunk_index (null where none), message.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.functions import text as T
from lamina.functions.classify import list_item_text
from lamina.schemas import ChunkingConfig

from .chunk import header_pairs, pieces, units


def _issues(rows: DataFrame, invariant: str, message: Column, index: str | None = "chunk_index") -> DataFrame:
    return rows.select("document_id", F.lit(invariant).alias("invariant"), (F.col(index) if index else F.lit(None)).cast("int").alias("chunk_index"), message.alias("message"))


def with_pos(chunks: DataFrame) -> DataFrame:
    """``pos``, the place in the list; chunks made here are listed by index."""
    if "pos" in chunks.columns:
        return chunks
    return chunks.withColumn("pos", (F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index")) - 1).cast("int"))


def check_order(chunks: DataFrame) -> DataFrame:
    return _issues(with_pos(chunks).where("chunk_index <> pos"), "order_preservation", F.format_string("chunk at place %d has index %d", "pos", "chunk_index"))


def check_max_size(chunks: DataFrame, config: ChunkingConfig, allowed: DataFrame | None = None) -> DataFrame:
    """Chunks longer than allowed; a structural one may be a single oversized piece or a forced header pair."""
    if not config.is_structural:
        return _issues(chunks.where(F.char_length("text") > config.max_chunk_size), "max_size", F.lit("the text is longer than max_chunk_size"))
    big = chunks.where(F.col("end_char") - F.col("start_char") > config.max_chunk_size)
    big = big.join(allowed.select("document_id", F.col("start").alias("start_char"), F.col("end").alias("end_char")).distinct(), ["document_id", "start_char", "end_char"], "left_anti")
    return _issues(big, "max_size", F.lit("the span is longer than max_chunk_size and no single oversized element"))


def check_overlap(chunks: DataFrame, config: ChunkingConfig) -> DataFrame:
    at = Window.partitionBy("document_id").orderBy("pos")
    pairs = with_pos(chunks).withColumn("ps", F.lag("start_char").over(at)).withColumn("pe", F.lag("end_char").over(at))
    bad = pairs.where((F.col("pe") - F.col("ps") == config.max_chunk_size) & (F.col("start_char") <= F.col("pe")) & (F.col("start_char") != F.col("pe") - config.overlap_size))
    return _issues(bad, "overlap", F.format_string("starts at %d, not %d", "start_char", F.col("pe") - config.overlap_size))


def check_coverage(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Text outside all chunks must be blank, the tail and documents without chunks included."""
    before = Window.partitionBy("document_id").orderBy("start_char", "end_char").rowsBetween(Window.unboundedPreceding, -1)
    ends = documents.select("document_id", F.char_length("full_text").alias("start_char"), F.lit(None).cast("int").alias("end_char"))
    edges = chunks.select("document_id", "start_char", "end_char").unionByName(ends).withColumn("reach", F.coalesce(F.max("end_char").over(before), F.lit(0)))
    gaps = edges.where("start_char > reach").join(documents.select("document_id", "full_text"), "document_id")
    bad = gaps.where(T.strip(F.substr("full_text", F.col("reach") + 1, F.col("start_char") - F.col("reach"))) != "")
    return _issues(bad, "non_whitespace_coverage", F.format_string("text between %d and %d is in no chunk", "reach", "start_char"), None)


def check_traceability(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """A chunk's text must be what its span holds; compared in the row of its document."""
    listed = chunks.groupBy("document_id").agg(F.collect_list(F.struct("chunk_index", "start_char", "end_char", "text")).alias("c"))
    first = lambda c: F.greatest(c["start_char"], F.lit(0))
    held = lambda c: F.substr("full_text", first(c) + 1, F.greatest(c["end_char"] - first(c), F.lit(0)))
    bad = documents.join(listed, "document_id").select("document_id", F.explode(F.filter("c", lambda c: held(c) != c["text"])).alias("c"))
    return _issues(bad.select("document_id", "c.chunk_index"), "traceability", F.lit("the text is not what its span holds"))


def check_offsets(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    at = Window.partitionBy("document_id").orderBy("pos")
    rows = with_pos(chunks).withColumn("ps", F.lag("start_char").over(at)).join(documents.select("document_id", F.char_length("full_text").alias("size")), "document_id")
    inside = (F.col("start_char") >= 0) & (F.col("start_char") < F.col("end_char")) & (F.col("end_char") <= F.col("size"))
    bounds = _issues(rows.where(~inside), "offsets", F.lit("the span is out of bounds"))
    length = _issues(rows.where(inside & (F.col("end_char") - F.col("start_char") != F.char_length("text"))), "offsets", F.lit("the span's length is not the text's"))
    order = _issues(rows.where("start_char < ps"), "offsets", F.lit("it starts before the chunk before it"))
    return bounds.unionByName(length).unionByName(order)


def check_element_order(elements: DataFrame) -> DataFrame:
    at = Window.partitionBy("document_id").orderBy("unit_no")
    return _issues(elements.withColumn("pe", F.lag("end").over(at)).where("start < pe"), "element_order", F.lit("an element starts before the one before it ends"), None)


def check_atomic_coverage(elements: DataFrame, chunks: DataFrame, size: int) -> DataFrame:
    """Every unit that fits a chunk must lie in exactly one; compared in the row of its document, so no row is made for a pair."""
    small = elements.where((F.col("end") > F.col("start")) & (F.col("end") - F.col("start") <= size)).select("document_id", "unit_no", "start", "end")
    spans = chunks.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("start_char", "end_char"))).alias("c"))
    listed = small.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "unit_no"))).alias("u"))
    met = lambda u: F.size(F.filter("c", lambda c: (c["start_char"] <= u["start"]) & (c["end_char"] >= u["end"])))
    counted = F.transform("u", lambda u: F.struct(u["start"].alias("start"), u["end"].alias("end"), met(u).alias("n")))
    both = listed.join(spans, "document_id", "left").withColumn("c", F.coalesce("c", F.array().cast("array<struct<start_char:int,end_char:int>>")))
    bad = both.select("document_id", F.explode(F.filter(counted, lambda u: u["n"] != 1)).alias("u")).select("document_id", "u.*")
    return _issues(bad, "atomic_element_coverage", F.format_string("element %d-%d is in %d chunks", "start", "end", "n"), None)


def check_structural_integrity(cut: DataFrame, chunks: DataFrame) -> DataFrame:
    edges = cut.select("document_id", F.explode(F.array("start", "end")).alias("edge")).distinct()
    sides = chunks.select("document_id", "chunk_index", F.explode(F.array("start_char", "end_char")).alias("edge"))
    return _issues(sides.join(edges, ["document_id", "edge"], "left_anti").dropDuplicates(["document_id", "chunk_index"]), "structural_integrity", F.lit("an edge is no boundary of a piece"))


def validate_chunks(documents: DataFrame, chunks: DataFrame, config: ChunkingConfig, blocks: DataFrame | None = None, elements: DataFrame | None = None) -> DataFrame:
    """All issues of the chunks of ``documents``; none if they are valid.

    ``elements``: the units, if they are made already.
    """
    found = [check_order(chunks)]
    if config.is_structural:
        elements = units(documents, blocks) if elements is None else elements
        cut = pieces(elements, config.max_chunk_size)
        allowed = cut.where(F.col("end") - F.col("start") > config.max_chunk_size).select("document_id", "start", "end")
        if config.propagate_context:
            allowed = allowed.unionByName(header_pairs(elements, config.max_chunk_size))
        found.append(check_max_size(chunks, config, allowed))
    else:
        found.append(check_max_size(chunks, config))
    found += [check_overlap(chunks, config), check_coverage(documents, chunks), check_traceability(documents, chunks), check_offsets(documents, chunks)]
    if config.is_structural:
        found += [check_element_order(elements), check_atomic_coverage(elements, chunks, config.max_chunk_size), check_structural_integrity(cut, chunks)]
    return reduce(DataFrame.unionByName, found)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?U)\S+"), 0)


def lost_tokens(pages: DataFrame, blocks: DataFrame, most: int = 10) -> DataFrame:
    """(document_id, missing, first): how many source tokens the blocks lack, and the first of them.

    Tokens are compared as multisets; list markers of the source don't count, extra tokens of the blocks are fine.
    """
    lines = pages.select("document_id", "page_number", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r\n|\r|\n", -1)).alias("line_no", "line"))
    line = T.strip(F.col("line"))
    want = lines.select("document_id", "page_number", "line_no", F.posexplode(tokens(F.coalesce(list_item_text(line), line))).alias("i", "token"))
    want = want.groupBy("document_id", "token").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("page_number", "line_no", "i")).alias("at"))
    cells = F.when(F.size("columns") > 0, F.concat(F.array(F.col("columns")), F.col("rows"))).otherwise(F.col("rows"))
    body = F.when(F.col("type") == "table", F.array_join(F.flatten(cells), " ")).otherwise(F.col("text"))
    have = blocks.select("document_id", F.explode(tokens(body)).alias("token")).groupBy("document_id", "token").agg(F.count(F.lit(1)).alias("m"))
    lost = want.join(have, ["document_id", "token"], "left").withColumn("short", F.col("n") - F.coalesce("m", F.lit(0))).where("short > 0")
    listed = F.array_sort(F.collect_list(F.struct("at", "token")))
    return lost.groupBy("document_id").agg(F.sum("short").alias("missing"), F.transform(F.slice(listed, 1, most), lambda x: x["token"]).alias("first"))


def validate_blocks(blocks: DataFrame, full_text: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Issues of structured blocks: content, order, spans, ids, tables, lists, JSON and lost tokens."""
    at = Window.partitionBy("document_id").orderBy("page_number", "block_seq")
    ordered = blocks.withColumn("pe", F.lag("end_char").over(at))
    sliced = blocks.join(full_text, "document_id").where(F.substr("full_text", F.col("start_char") + 1, F.col("end_char") - F.col("start_char")) != F.col("text"))
    ragged = blocks.where((F.col("type") == "table") & (F.size("columns") > 0) & ~F.forall("rows", lambda r: F.size(r) == F.size("columns")))
    lists = blocks.where((F.col("type") == "list") & ((F.size("items") == 0) | F.exists("items", lambda x: T.strip(x) == "")))
    twice = blocks.groupBy("document_id", "block_id").count().where("count > 1")
    shape = F.struct("block_id", "type", "text", "page_number", "start_char", "end_char", "is_noise", "level", "items", "columns", "rows")
    kind = "struct<block_id:string,type:string,text:string,page_number:int,start_char:int,end_char:int,is_noise:boolean,level:int,items:array<string>,columns:array<string>,rows:array<array<string>>>"
    trip = blocks.where(F.to_json(F.from_json(F.to_json(shape), kind)) != F.to_json(shape))
    named = lambda rows, invariant, message: _issues(rows, invariant, F.concat(F.col("block_id"), F.lit(f": {message}")), None)
    found = [
        named(blocks.where(T.strip(F.col("text")) == ""), "non_empty_content", "is empty"), named(ordered.where("start_char < pe"), "monotonic_order", "starts before the block before it ends"),
        named(sliced, "span_equality", "the span does not hold the text"), named(ragged, "table_rectangularity", "rows differ in width"), named(lists, "list_non_emptiness", "an item is empty"),
        named(twice, "unique_block_id", "is used twice"), named(trip, "json_serializable", "does not survive JSON"),
    ]
    if pages is not None:
        lost = lost_tokens(pages, blocks)
        found.append(_issues(lost, "lossless_content", F.concat(F.col("missing").cast("string"), F.lit(" tokens lost: "), F.array_join("first", " ")), None))
    return reduce(DataFrame.unionByName, found)


def require_valid(issues: DataFrame, most: int = 1000) -> None:
    """Raise ValueError with the messages of ``issues`` if there are any: all of them up to ``most``, and how many more."""
    found = issues.orderBy("document_id", "invariant", "chunk_index", "message").limit(most + 1).collect()
    if found:
        lines = [f"{r['document_id']} [{r['invariant']}]" + (f" chunk {r['chunk_index']}" if r["chunk_index"] is not None else "") + f": {r['message']}" for r in found[:most]]
        rest = [f"and {issues.count() - most} more"] if len(found) > most else []
        raise ValueError("validation failed:\n" + "\n".join(lines + rest))


def require_spans(blocks: DataFrame, full_text: DataFrame) -> None:
    """Raise ValueError if a block's span doesn't hold its text."""
    require_valid(validate_blocks(blocks, full_text).where("invariant = 'span_equality'"))
