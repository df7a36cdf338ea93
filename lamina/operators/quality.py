"""Chunk quality and the comparison of strategies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.functions.classify import splits_word
from lamina.functions.text import percent
from lamina.schemas import STRATEGIES, ChunkingConfig
from lamina.sources.durable import durable

from .chunk import chunk_documents, units
from .validate import validate_chunks, with_pos

TINY = 0.1


def split_counts(documents: DataFrame, chunks: DataFrame, elements: DataFrame) -> DataFrame:
    """(document_id, word_splits, bullet_splits, table_row_splits): chunk edges inside units, by the unit's type.

    Units don't overlap, so an edge can only be inside the last one that starts before it:
    an as-of join, done by one window over edges and units in order of place.
    """
    edges = chunks.groupBy("document_id").agg(F.array_distinct(F.flatten(F.collect_list(F.array("start_char", "end_char")))).alias("b"))
    inside = F.filter("b", lambda b: (b > 0) & (b < F.char_length("full_text")))
    told = F.transform(inside, lambda b: F.struct(b.alias("at"), splits_word(F.col("full_text"), b).alias("word")))
    edges = edges.join(documents.select("document_id", "full_text"), "document_id").select("document_id", F.explode(told).alias("e")).select("document_id", "e.at", F.lit(0).alias("kind"), "e.word", F.lit(None).cast("struct<end:int,type:string>").alias("unit"))
    starts = elements.select("document_id", F.col("start").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("boolean").alias("word"), F.struct("end", "type").alias("unit"))
    at = Window.partitionBy("document_id").orderBy("at", "kind", "unit.end")
    met = edges.unionByName(starts).withColumn("unit", F.last("unit", True).over(at)).where("kind = 0 and at < unit.end")
    prose = F.col("unit.type").isin("heading", "paragraph")
    count = lambda c: F.sum(c.cast("int")).cast("int")
    return met.groupBy("document_id").agg(
        count(prose & F.col("word")).alias("word_splits"), count(F.col("unit.type") == "list").alias("bullet_splits"), count(F.col("unit.type") == "table").alias("table_row_splits"))


def evaluate_quality(documents: DataFrame, chunks: DataFrame, config: ChunkingConfig, blocks: DataFrame | None = None, elements: DataFrame | None = None) -> DataFrame:
    """One row for each document with the metrics that tell strategies apart; ``elements``: the units, if they are made already."""
    elements = durable(units(documents, blocks), "units") if elements is None else elements
    at = Window.partitionBy("document_id").orderBy("pos")
    rows = with_pos(chunks).withColumn("redundant", F.greatest(F.lit(0), F.col("end_char") - F.lead("start_char").over(at)))
    opening = elements.groupBy("document_id").agg(F.min_by("start", "unit_no").alias("opening"))
    headings = elements.where("type = 'heading'").select("document_id", F.col("start").alias("start_char"), F.lit(True).alias("on_heading")).distinct()
    rows = rows.join(opening, "document_id", "left").join(headings, ["document_id", "start_char"], "left")
    needs = ~F.col("start_char").eqNullSafe(F.col("opening")) & F.col("on_heading").isNull()
    prefixed = F.coalesce("context_prefix", F.lit("")) != ""
    total = lambda c: F.sum(c.cast("long"))
    agg = rows.groupBy("document_id").agg(
        F.count(F.lit(1)).cast("int").alias("chunk_count"), total(F.col("char_count") < config.max_chunk_size * TINY).cast("int").alias("tiny_chunk_count"), total(F.col("char_count")).alias("chars"), total(F.col("redundant")).alias("redundant"),
        total(F.char_length("contextualized_text")).alias("delivered"), total(F.when(prefixed, F.char_length("context_prefix") + 1).otherwise(0)).alias("injected"),
        total(needs).alias("needing"), total(needs & prefixed).alias("satisfied"))
    broken = validate_chunks(documents, chunks, config, blocks, elements).select("document_id").distinct().withColumn("broken", F.lit(True))
    out = documents.select("document_id").join(agg, "document_id", "left").join(split_counts(documents, chunks, elements), "document_id", "left").join(broken, "document_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    ratio = lambda a, b: F.when(zero(b) > 0, zero(a) / zero(b)).otherwise(F.lit(0.0))
    if not config.is_structural and config.overlap_size > 0:
        overhead, source = ratio("redundant", "chars"), "overlap"
    elif config.is_structural and config.propagate_context:
        overhead, source = ratio("injected", "delivered"), "context_prefix"
    else:
        overhead, source = F.lit(0.0), "none"
    covered = F.when(zero("needing") > 0, zero("satisfied") / zero("needing")).otherwise(F.lit(1.0))
    in_context = config.is_structural and config.propagate_context
    return out.select(
        "document_id", F.lit(config.chunking_strategy).alias("chunking_strategy"), F.lit(config.propagate_context).alias("propagate_context"), F.col("broken").isNull().alias("is_valid"),
        zero("chunk_count").alias("chunk_count"), F.coalesce(F.col("chars") / (F.col("chunk_count") * config.max_chunk_size), F.lit(0.0)).alias("avg_utilization"), zero("tiny_chunk_count").alias("tiny_chunk_count"), ratio("tiny_chunk_count", "chunk_count").alias("tiny_chunk_ratio"),
        zero("word_splits").alias("word_splits"), zero("bullet_splits").alias("bullet_splits"), zero("table_row_splits").alias("table_row_splits"),
        overhead.alias("context_overhead"), F.lit(source).alias("overhead_source"), (covered if in_context else F.lit(None).cast("double")).alias("context_coverage"))


def compare_strategies(documents: DataFrame, blocks: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The quality rows of several registered strategies, with a ``label``."""
    elements, rows = durable(units(documents, blocks), "units"), []
    for name in names or list(STRATEGIES):
        label, config = STRATEGIES[name]
        chunks = durable(chunk_documents(documents, config, elements=elements), "chunks")
        rows.append(evaluate_quality(documents, chunks, config, elements=elements).withColumn("label", F.lit(label)))
    return reduce(DataFrame.unionByName, rows)


def comparison_cells(quality: DataFrame) -> DataFrame:
    """(document_id, metric, one column for each label): the comparison table's cells as text."""
    p = lambda c: F.concat(percent(c).cast("string"), F.lit("%"))
    cells = {
        "Valid": F.when(F.col("is_valid"), "✓").otherwise("✗"), "Chunks": F.col("chunk_count").cast("string"), "Avg utilization": p(F.col("avg_utilization")), "Tiny chunks": p(F.col("tiny_chunk_ratio")),
        "Word splits": F.col("word_splits").cast("string"), "Bullet splits": F.col("bullet_splits").cast("string"), "Table-row splits": F.col("table_row_splits").cast("string"),
        "Context overhead": F.concat(p(F.col("context_overhead")), F.when(F.col("overhead_source") == "overlap", "*").otherwise("")),
        "Context coverage": F.coalesce(p(F.col("context_coverage")), F.lit("N/A")),
    }
    long = quality.select("document_id", "label", F.posexplode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("cell")) for k, v in cells.items()])).alias("line", "m"))
    labels = [label for label, _ in STRATEGIES.values()]
    return long.groupBy("document_id", "line", F.col("m.metric").alias("metric")).pivot("label", labels).agg(F.first("m.cell"))


def format_quality_comparison(quality: DataFrame) -> str:
    """The comparison of one document as text; empty without rows, ValueError for more than one document."""
    rows = comparison_cells(quality).orderBy("document_id", "line").limit(10).collect()  # nine rows a document
    if not rows:
        return ""
    if len({r["document_id"] for r in rows}) > 1:
        raise ValueError("quality holds more than one document")
    labels = [c for c in rows[0].asDict() if c not in ("document_id", "line", "metric") and any(r[c] for r in rows)]
    table = [["Metric", *labels], *([r["metric"], *(r[c] or "" for c in labels)] for r in rows)]
    widths = [max(len(r[i]) for r in table) for i in range(len(table[0]))]
    lines = ["  ".join([r[0].ljust(widths[0]), *(c.center(w) for c, w in zip(r[1:], widths[1:], strict=True))]) for r in table]
    if any("*" in c for r in table[1:] for c in r[1:]):
        lines.append("* overlap between neighbouring chunks")
    return "\n".join(lines)


