"""From pages to typed blocks and canonical text, by islands over classified lines.

Two readings share the machinery: ``line`` keeps list markers and joins paragraph lines only
on evidence; ``structured`` takes running headers and footers out, strips markers and joins
every adjacent plain line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.functions import classify as C
from lamina.functions import text as T

from .noise import noise_lines
from .tables import table_regions

PAGE = ["document_id", "page_number"]


def page_lines(pages: DataFrame) -> DataFrame:
    """document_id, page_number, line_no, raw and the classification of every preprocessed line.

    Pages are dealt by document before their lines are told apart: all windows, groups and
    joins that follow are within a document and need no exchange of lines.
    """
    raw = pages.repartition("document_id").select(*PAGE, F.posexplode(F.split(T.preprocess(F.coalesce("text", F.lit(""))), "\n", -1)).alias("line_no", "raw"))
    line = F.col("raw")
    out = raw.withColumns({"line": T.strip(line), "indent": T.indent(line), "kind": C.line_type(line)})
    return out.withColumn("text", C.line_text(line, F.col("kind")))


def _islands(lines: DataFrame, role: Column, same_or_deeper: bool, joins: Column | None) -> DataFrame:
    """block_no and item_no for every line that belongs to a block."""
    at = Window.partitionBy(*PAGE).orderBy("line_no")
    item, breaks = F.col("role") == "item", ~F.col("role").isin("item", "plain")
    out = lines.withColumn("role", role)
    out = out.withColumn("_item", F.last(F.when(item, F.col("line_no")), True).over(at)).withColumn("_break", F.last(F.when(breaks, F.col("line_no")), True).over(at))
    out = out.withColumn("_depth", F.last(F.when(item, F.col("indent")), True).over(at))
    held = (F.col("role") == "plain") & (F.col("_item") > F.coalesce("_break", F.lit(-1)))
    out = out.withColumn("_held", F.coalesce(held, F.lit(False)))
    shallow = F.col("indent") < F.col("_depth") if same_or_deeper else F.col("indent") <= F.col("_depth")
    if not same_or_deeper:
        shallow = shallow | (F.col("kind") != "text")
    run = Window.partitionBy(*PAGE, "_item").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("_broken", F.max(F.coalesce(F.col("_held") & shallow, F.lit(False)).cast("int")).over(run) == 1)
    out = out.withColumn("part", F.when(F.col("_held") & ~F.col("_broken"), "more").otherwise(F.col("role")))
    out = out.withColumn("_before", F.lag("part").over(at))
    goes_on = F.col("_before") == "plain"
    if joins is not None:
        goes_on = goes_on & F.coalesce(joins, F.lit(False))
    begins = (
        F.when(F.col("part") == "blank", False).when(F.col("part") == "more", False).when(F.col("part") == "table", F.col("line_no") == F.col("region_start"))
        .when(F.col("part") == "item", ~F.coalesce(F.col("_before").isin("item", "more"), F.lit(False)))
        .when(F.col("part") == "plain", ~F.coalesce(goes_on, F.lit(False))).otherwise(True)
    )
    out = out.withColumn("begins", begins).withColumn("block_no", F.sum(F.col("begins").cast("int")).over(at)).withColumn("item_no", F.sum((F.col("part") == "item").cast("int")).over(at))
    return out.where("part <> 'blank'")


def _collected(rows: DataFrame, piece: Column, join) -> DataFrame:
    """One row for each block: its parts' texts in order, with what its first line knows."""
    first = F.min_by(F.struct("part", "level", "columns", "rows", "pipes", F.coalesce(F.col("_before") == "blank", F.lit(False)).alias("after_blank")), "line_no")
    items = rows.groupBy(*PAGE, "block_no", "item_no").agg(F.min("line_no").alias("line_no"), first.alias("first"), F.array_sort(F.collect_list(F.struct("line_no", piece.alias("piece")))).alias("pieces"))
    items = items.withColumn("piece", join(F.transform("pieces", lambda x: x["piece"])))
    blocks = items.groupBy(*PAGE, "block_no").agg(F.min_by("first", "line_no").alias("first"), F.array_sort(F.collect_list(F.struct("line_no", "piece"))).alias("items"))
    return blocks.select(*PAGE, "block_no", "first.*", F.filter(F.transform("items", lambda x: x["piece"]), lambda x: x != "").alias("items"))


def _finished(blocks: DataFrame) -> DataFrame:
    kind = F.when(F.col("part").isin("item", "more"), "list").when(F.col("part") == "plain", "paragraph").otherwise(F.col("part"))
    out = blocks.withColumn("type", kind)
    rows = F.when(F.col("type") == "table", F.col("rows"))
    text = F.when(F.col("type") == "table", T.render_table(F.col("columns"), rows)).otherwise(F.array_join("items", "\n"))
    out = out.withColumn("text", text).where("text <> ''")
    seq = Window.partitionBy(*PAGE).orderBy("block_no")
    none, nothing = F.array().cast("array<string>"), F.array().cast("array<array<string>>")
    return out.select(
        *PAGE, (F.row_number().over(seq) - 1).alias("block_seq"), "type", "text", F.when(F.col("type") == "heading", F.col("level")).alias("level"),
        F.when(F.col("type") == "list", F.col("items")).otherwise(none).alias("items"), F.coalesce(F.when(F.col("type") == "table", F.col("columns")), none).alias("columns"), F.coalesce(rows, nothing).alias("rows"), "after_blank",
    )


def _with_regions(lines: DataFrame, stop: Column, start: Column) -> DataFrame:
    """``lines`` with region_start, columns, rows and pipes where a table holds them; each table tells its lines, so it is an equi-join."""
    found = table_regions(lines, stop, start)
    held = found.select(*PAGE, "region_start", "columns", "rows", "pipes", F.explode(F.sequence("region_start", F.col("region_stop") - 1)).alias("line_no"))
    return lines.join(held, [*PAGE, "line_no"], "left")


def line_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of the ``line`` reading: document_id, page_number, block_seq, type, text, items, columns, rows, after_blank."""
    none = F.lit(None)
    lines = page_lines(pages).withColumn("item", none.cast("string")).withColumn("level", none.cast("int")).withColumn("noise", none.cast("string"))
    lines = _with_regions(lines, F.col("kind").isin("blank", "list_item"), F.col("kind") == "table_row")
    at = Window.partitionBy(*PAGE).orderBy("line_no")
    lines = lines.withColumn("_text", F.lag("text").over(at)).withColumn("_indent", F.lag("indent").over(at)).withColumn("_kind", F.lag("kind").over(at))
    role = F.when(F.col("region_start").isNotNull(), "table").when(F.col("kind") == "blank", "blank").when(F.col("kind") == "list_item", "item").when(F.col("kind") == "heading", "heading").otherwise("plain")
    joins = (F.col("kind") == "text") & (F.col("_kind") == "text") & C.joins_next(F.col("_text"), F.col("_indent"), F.col("text"), F.col("indent"))
    return _finished(_collected(_islands(lines, role, False, joins), F.col("text"), lambda x: T.strip(F.array_join(x, " "))))


def structured_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of the ``structured`` reading with ids and document-wide spans, noise blocks included.

    Adds block_id, is_noise, start_char, end_char; the text they index is ``structured_text``.
    """
    lines = page_lines(pages)
    lines = lines.join(noise_lines(lines), [*PAGE, "line_no"], "left")
    lines = lines.withColumn("item", C.list_item_text(F.col("line"))).withColumn("level", C.heading_level(F.col("line")))
    stop = (F.col("kind") == "blank") | F.col("noise").isNotNull() | F.col("item").isNotNull()
    lines = _with_regions(lines, stop, ~stop & F.col("level").isNull() & C.is_table_candidate(F.col("line")))
    role = (
        F.when(F.col("region_start").isNotNull(), "table").when(F.col("kind") == "blank", "blank").when(F.col("noise").isNotNull(), F.col("noise"))
        .when(F.col("item").isNotNull(), "item").when(F.col("level").isNotNull(), "heading").otherwise("plain")
    )
    # cells of tables with a header are made rectangular
    fitted = T.rectangularize(F.col("rows"), F.size("columns"), F.col("pipes"))
    lines = lines.withColumn("rows", F.when(F.size("columns") > 0, fitted).otherwise(F.col("rows")))
    piece = F.when(F.col("part") == "item", F.col("item")).when(F.col("part").isin("heading", "page_header", "page_footer"), F.col("line")).otherwise(F.col("raw"))
    one = lambda x: F.when(F.size(x) == 1, T.strip(F.regexp_replace(x[0], "[ \t]+", " "))).otherwise(T.join_wrapped(x))
    rows = _islands(lines, role, True, None)
    blocks = _finished(_collected(rows, piece, one))
    return with_spans(blocks)


def with_spans(blocks: DataFrame) -> DataFrame:
    order = Window.partitionBy("document_id").orderBy("page_number", "block_seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    follows, page = F.lag("text").over(order), F.lag("page_number").over(order)
    spaced = (F.lag("type").over(order) == "paragraph") & (F.col("type") == "paragraph") & (F.col("page_number") == page + 1) & ~T.ends_statement(follows) & T.starts_lowercase(F.col("text"))
    out = blocks.withColumn("delimiter", F.when(page.isNull(), "").when(spaced, " ").otherwise("\n\n"))
    out = out.withColumn("start_char", (F.coalesce(F.sum(F.char_length("delimiter") + F.char_length("text")).over(before), F.lit(0)) + F.char_length("delimiter")).cast("int"))
    out = out.withColumn("end_char", (F.col("start_char") + F.char_length("text")).cast("int"))
    return out.withColumn("block_id", F.format_string("block_%03d", F.row_number().over(order))).withColumn("is_noise", F.col("type").isin("page_header", "page_footer"))


def structured_text(blocks: DataFrame) -> DataFrame:
    """(document_id, full_text) that the spans of ``structured_blocks`` index."""
    parts = F.array_sort(F.collect_list(F.struct("page_number", "block_seq", F.concat("delimiter", "text").alias("s"))))
    return blocks.groupBy("document_id").agg(F.array_join(F.transform(parts, lambda x: x["s"]), "").alias("full_text"))


def normalized_documents(pages: DataFrame, blocks: DataFrame, structured: bool) -> tuple[DataFrame, DataFrame]:
    """(documents, page blocks): canonical text of each document, and its content blocks with page-local spans.

    documents: document_id, full_text, pages (array of page_number, text, start, end).
    Pages without blocks stay, empty.  Running lines are left out; a block of a type that is
    none of the four kinds of content is an error.
    """
    kind = F.when(F.col("type").isin("heading", "paragraph", "list", "table"), F.col("type")).otherwise(F.raise_error(F.concat(F.lit("unexpected block type: "), F.coalesce("type", F.lit("null")))))
    content = blocks.where("type is null or type not in ('page_header', 'page_footer')").withColumn("type", kind)
    at = Window.partitionBy(*PAGE).orderBy("block_seq")
    follows = F.lag("type").over(at)
    blank = F.lit(False) if structured else F.col("after_blank")
    sep = F.when(follows.isNull(), "").when(blank, "\n\n").when(follows == "heading", "\n").otherwise("\n\n")
    placed = content.withColumn("sep", sep)
    before = at.rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("start_char", (F.coalesce(F.sum(F.char_length("sep") + F.char_length("text")).over(before), F.lit(0)) + F.char_length("sep")).cast("int"))
    placed = placed.withColumn("end_char", (F.col("start_char") + F.char_length("text")).cast("int"))
    texts = placed.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_seq", F.concat("sep", "text").alias("s")))), lambda x: x["s"]), "").alias("page_text"))
    every = pages.select(*PAGE).distinct().join(texts, PAGE, "left").select(*PAGE, T.strip(F.coalesce("page_text", F.lit(""))).alias("text"))
    # the first block begins its page, so only trailing blanks can go
    ordered = Window.partitionBy("document_id").orderBy("page_number")
    glue = T.page_delimiter(F.lag("text").over(ordered), F.col("text")) if structured else F.lit("\n\n")
    every = every.withColumn("glue", F.when(F.row_number().over(ordered) == 1, "").otherwise(glue))
    docs = every.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "text", "glue"))).alias("p"))
    full = F.regexp_replace(F.array_join(F.transform("p", lambda x: F.concat(x["glue"], x["text"])), ""), "\n{3,}", "\n\n")
    docs = docs.withColumn("full_text", full)
    return docs.select("document_id", "full_text", page_spans(F.col("p"), F.col("full_text")).alias("pages")), placed.drop("sep")


def normalize_documents(pages: DataFrame, structured: bool = True) -> tuple[DataFrame, DataFrame]:
    """(documents, page blocks) straight from pages (document_id, page_number, text), by either reading."""
    blocks = structured_blocks(pages) if structured else line_blocks(pages)
    return normalized_documents(pages, blocks, structured)


def page_spans(pages: Column, full_text: Column) -> Column:
    """page_number, text, start, end for each page, searched from the end of the one before; empty ones have no width."""
    def step(s: Column, p: Column) -> Column:
        found = F.position(p["text"], full_text, s["at"] + 1) - 1
        ok = (p["text"] != "") & (found >= 0)
        start = F.when(ok, found).otherwise(s["at"]).cast("int")
        return T.let(start, lambda x: F.struct((x + F.when(ok, F.char_length(p["text"])).otherwise(0)).cast("int").alias("at"), F.concat(s["out"], F.array(x)).alias("out"), F.concat(s["wide"], F.array(ok)).alias("wide")))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"), F.array().cast("array<boolean>").alias("wide"))

    def placed(s: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            start = F.get(s["out"], i)
            end = start + F.when(F.get(s["wide"], i), F.char_length(p["text"])).otherwise(0)
            return F.struct(p["page_number"].cast("int").alias("page_number"), p["text"].alias("text"), start.alias("start"), end.cast("int").alias("end"))

        return F.transform(pages, one)

    return T.let(F.aggregate(pages, zero, step, lambda s: F.struct(s["out"].alias("out"), s["wide"].alias("wide"))), placed)
