"""Chunks: character windows in closed form, structural packing as a fold over a document's units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.functions import text as T
from lamina.schemas import ChunkingConfig

def char_spans(length: Column, size: int, overlap: int) -> Column:
    """(start, end) of windows of ``size`` that overlap by ``overlap``; the last one reaches the end."""
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap_size must be smaller than max_chunk_size")
    last = F.greatest(F.lit(0), F.ceil((length - size) / F.lit(step)).cast("int"))
    every = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * step).cast("int").alias("start"), F.least(i * step + size, length).cast("int").alias("end")))
    return F.when(length > 0, every).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def units(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """Atomic pieces of a document, in order, with document-wide spans and their context.

    A heading or paragraph is one unit, a list one for each item, a table one for each row,
    its header row first.  heading: the last heading before; table_header: the header of the
    table, inherited over an unbroken run of table units.  Columns: document_id, unit_no,
    start, end, type, heading, table_header, is_header, text.
    """
    starts = documents.select("document_id", F.explode("pages").alias("p")).select("document_id", F.col("p.page_number").alias("page_number"), F.col("p.start").alias("page_start"))
    rows = F.transform(F.col("rows"), lambda r: F.array_join(r, " | "))
    head = F.array_join("columns", " | ")
    named = F.size("columns") > 0
    texts = F.when(F.col("type") == "list", F.col("items")).when(F.col("type") == "table", F.when(named, F.concat(F.array(head), rows)).otherwise(rows)).otherwise(F.array("text"))
    placed = blocks.join(starts, ["document_id", "page_number"]).withColumn("base", F.col("page_start") + F.col("start_char"))
    each = T.let(texts, lambda t: F.transform(T.spans(t, F.col("base"), 1), lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(t, i).alias("text"))))
    found = placed.select("document_id", "page_number", "block_seq", "type", F.when((F.col("type") == "table") & named, head).alias("own"), F.posexplode(each).alias("i", "s")).select("*", "s.*").drop("s")
    found = found.where(~F.col("type").isin("heading", "paragraph") | (F.col("end") > F.col("start")))
    at = Window.partitionBy("document_id").orderBy("page_number", "block_seq", "i")
    heading = F.when(F.col("type") != "heading", F.last(F.when(F.col("type") == "heading", F.col("text")), True).over(at))
    found = found.withColumn("heading", heading).withColumn("run", F.sum((F.col("type") != "table").cast("int")).over(at))
    inherited = F.last("own", True).over(Window.partitionBy("document_id", "run").orderBy("page_number", "block_seq", "i"))
    found = found.withColumn("table_header", F.when(F.col("type") == "table", inherited))
    return found.select("document_id", (F.row_number().over(at) - 1).alias("unit_no"), "start", "end", "type", "heading", "table_header", ((F.col("type") == "table") & F.col("own").isNotNull() & (F.col("i") == 0)).alias("is_header"), "text")


def pieces(found: DataFrame, size: int) -> DataFrame:
    """The units, those longer than ``size`` cut into sentences that keep all else."""
    whole = F.array(F.struct("start", "end"))
    cut = F.when(F.col("end") - F.col("start") > size, T.spans(T.sentences(F.col("text")), F.col("start"))).otherwise(whole)
    out = found.select("document_id", "unit_no", "type", "heading", "table_header", "is_header", F.posexplode(cut).alias("piece_no", "s"))
    return out.select("document_id", "unit_no", "piece_no", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "type", "heading", "table_header", "is_header")


def pack(u: Column, size: int, context: bool) -> Column:
    """Chunk spans of ordered units, with what their context prefix is made of.

    A chunk takes units while its span fits its budget.  With context the budget leaves room
    for the prefix (but never less than the first unit), a chunk opened by a table row takes
    only table rows, and one that is a header row alone takes the next row even if too long.
    What a unit would cost as the first of a chunk is known before packing: the unit before
    it is then always the last of the chunk before.  The fold keeps only where chunks open.
    """
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    inner = lambda x: (x["type"] == "table") & filled(x["table_header"]) & ~x["is_header"]
    width = lambda c, there: F.when(there, F.char_length(c) + 1).otherwise(F.lit(0))
    own = lambda x: width(x["heading"], filled(x["heading"])) + width(x["table_header"], inner(x))

    def priced(x: Column, i: Column) -> Column:
        before = F.get(u, i - 1)
        fallback = F.when((own(x) == 0) & (before["end"] > before["start"]), before["end"] - before["start"] + 1).otherwise(F.lit(0))
        cost = F.when(x["type"] == "heading", F.lit(0)).otherwise(own(x) + fallback) if context else F.lit(0)
        return F.struct(x["start"].alias("s"), x["end"].alias("e"), F.greatest(size - cost, x["end"] - x["start"]).cast("int").alias("budget"), (x["type"] == "table").alias("table"), x["is_header"].alias("header"))

    state = "struct<at:int,s:int,budget:int,rows_only:boolean,header_only:boolean,full:boolean,out:array<int>>"

    def step(o: Column, x: Column) -> Column:
        fits = x["e"] - o["s"] <= o["budget"]
        forced = o["header_only"] & x["table"] & ~fits
        takes = F.coalesce((F.size(o["out"]) > 0) & ~o["full"] & (~o["rows_only"] | x["table"]) & (fits | forced), F.lit(False))
        at = (o["at"] + 1).alias("at")
        more = F.struct(at, o["s"].alias("s"), o["budget"].alias("budget"), o["rows_only"].alias("rows_only"), F.lit(False).alias("header_only"), forced.alias("full"), o["out"].alias("out"))
        fresh = F.struct(at, x["s"].alias("s"), x["budget"].alias("budget"), (x["table"] & context).alias("rows_only"), (x["header"] & context).alias("header_only"), F.lit(False).alias("full"), F.concat(o["out"], F.array(o["at"])).alias("out"))
        return F.when(takes, more).otherwise(fresh).cast(state)

    none, no = F.lit(None).cast("int"), F.lit(False)
    zero = F.struct(F.lit(0).alias("at"), none.alias("s"), none.alias("budget"), no.alias("rows_only"), no.alias("header_only"), no.alias("full"), F.array().cast("array<int>").alias("out")).cast(state)

    def span(opens: Column):
        def one(b: Column, j: Column) -> Column:
            x, before, last = F.get(u, b), F.get(u, b - 1), F.get(u, F.coalesce(F.get(opens, j + 1), F.size(u)) - 1)
            bare = F.lit(not context) | (x["type"] == "heading")
            return F.struct(
                x["start"].alias("start"), last["end"].alias("end"), F.when(~bare, x["heading"]).alias("heading"), F.when(~bare & inner(x), x["table_header"]).alias("table_header"),
                F.when(~bare & (own(x) == 0), before["start"]).alias("prev_start"), F.when(~bare & (own(x) == 0), before["end"]).alias("prev_end"))

        return F.transform(opens, one)

    return T.let(F.aggregate(F.transform(u, priced), zero, step, lambda o: o["out"]), span)


def packed_spans(found: DataFrame, config: ChunkingConfig) -> DataFrame:
    """(document_id, spans): one row for each document with units."""
    cut = pieces(found, config.max_chunk_size)
    ordered = cut.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("unit_no", "piece_no", "start", "end", "type", "heading", "table_header", "is_header"))).alias("u"))
    return ordered.select("document_id", pack(F.col("u"), config.max_chunk_size, config.propagate_context).alias("spans"))


def chunk_documents(documents: DataFrame, config: ChunkingConfig | None = None, blocks: DataFrame | None = None, elements: DataFrame | None = None) -> DataFrame:
    """The chunks of normalized documents: ids, spans, text, pages, counts and context.

    ``documents``: document_id, full_text, pages (with start and end); ``blocks`` (or their
    ``units`` as ``elements``) are needed for structural packing.  Blank chunks are left out
    and indices stay gapless.  A document is cut in its own row, so its text is neither
    joined to its chunks nor shuffled with them.
    """
    config = config or ChunkingConfig()
    if config.is_structural:
        rows = documents.join(packed_spans(units(documents, blocks) if elements is None else elements, config), "document_id")
    else:
        rows = documents.withColumn("spans", char_spans(F.char_length("full_text"), config.max_chunk_size, config.overlap_size))
    body = lambda s, e: F.substr("full_text", s + 1, e - s)
    places = F.transform("pages", lambda p: F.struct(p["page_number"].alias("n"), p["start"].alias("start"), p["end"].alias("end")))

    def cut(s: Column, pages: Column) -> Column:
        prefix = F.lit("")
        if config.is_structural:
            blank = lambda c: F.when(c != "", c)
            prefix = F.concat_ws("\n", blank(s["heading"]), blank(s["table_header"]), blank(body(s["prev_start"], s["prev_end"])))
        met = F.transform(F.filter(pages, lambda p: (p["start"] < s["end"]) & (p["end"] > s["start"])), lambda p: p["n"])
        return F.struct(s["start"].alias("start_char"), s["end"].alias("end_char"), body(s["start"], s["end"]).alias("text"), met.alias("page_numbers"), prefix.alias("context_prefix"))

    made = T.let(places, lambda pages: F.filter(F.transform("spans", lambda s: cut(s, pages)), lambda c: T.strip(c["text"]) != ""))
    out = rows.select("document_id", F.posexplode(made).alias("chunk_index", "c")).select("document_id", "chunk_index", "c.*")
    return out.select(
        "document_id", F.concat_ws("_", "document_id", F.lit("chunk"), F.col("chunk_index").cast("string")).alias("chunk_id"), "chunk_index", "start_char", "end_char", "text",
        "page_numbers", T.count_words(F.col("text")).alias("word_count"), T.count_chars(F.col("text")).alias("char_count"),
        "context_prefix", T.contextualized(F.col("context_prefix"), F.col("text")).alias("contextualized_text"),
    )


def header_pairs(found: DataFrame, size: int) -> DataFrame:
    """(document_id, start, end) of header rows that had to take their first row past ``size``."""
    at = Window.partitionBy("document_id").orderBy("unit_no")
    pairs = found.withColumn("to", F.lead("end").over(at)).withColumn("next", F.lead("type").over(at))
    return pairs.where(F.col("is_header") & (F.col("next") == "table") & (F.col("to") - F.col("start") > size)).select("document_id", "start", F.col("to").alias("end"))
