"""Two commands on one document: ``report`` chunks it and prints what came out, ``compare`` sets the strategies side by side.

    python -m lamina.cli report PATH [--strategy v2.2] [--password P]
    python -m lamina.cli compare PATH [--password P]

PATH is a .pdf file or a .txt file, whose pages are parted by form feeds.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators.chunk import chunk_documents, units
from lamina.operators.quality import compare_strategies, format_quality_comparison
from lamina.operators.structure import normalized_documents, structured_blocks, structured_text
from lamina.operators.validate import validate_blocks, validate_chunks
from lamina.schemas import STRATEGIES, describe_chunking, get_chunking_strategy
from lamina.sources.durable import durable
from lamina.sources.pages import check_input, pdf_pages

#: Chunks printed in full.
SHOWN = 6


def document_of(spark: SparkSession, path: str, password: str = "", open_pdf=None) -> DataFrame:
    """The pages of one file; ValueError says why it can't be read."""
    if path.lower().endswith(".txt"):
        check_input(spark, path, ".txt")
        text = spark.read.text(path, wholetext=True)
        name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\\.[^.]*$", "")
        pages = text.select(name.alias("document_id"), F.posexplode(F.split("value", "\f", -1)).alias("i", "text"))
        return pages.select("document_id", (F.col("i") + 1).alias("page_number"), "text")
    check_input(spark, path, ".pdf")
    pages = durable(pdf_pages(spark, path, password, open_pdf=open_pdf), "pages")
    failed = pages.where("problem is not null").first()
    if failed:
        raise ValueError(f"{failed['problem']}: {path}")
    return pages.drop("problem")


def report(spark: SparkSession, pages: DataFrame, strategy: str = "v2.2", out=print) -> bool:
    """Print the chunks of one document and whether they are valid; returns that."""
    label, config = get_chunking_strategy(strategy)
    blocks = durable(structured_blocks(pages), "blocks")
    for r in validate_blocks(blocks, structured_text(blocks), pages).orderBy("invariant", "message").toLocalIterator():
        out(f"warning [{r['invariant']}] {r['message']}")
    documents, placed = (durable(x, "table") for x in normalized_documents(pages, blocks, True))
    elements = durable(units(documents, placed), "units")
    chunks = durable(chunk_documents(documents, config, elements=elements), "chunks")
    out(f"Strategy {strategy} ({label}): {describe_chunking(config)}, max_chunk_size={config.max_chunk_size}, overlap_size={config.overlap_size}, propagate_context={config.propagate_context}")
    out(f"Chunks: {chunks.count()}")
    for r in chunks.orderBy("chunk_index").toLocalIterator():
        out(f"Chunk {r['chunk_index']}: {r['start_char']}-{r['end_char']}, {r['char_count']} chars, {r['word_count']} words")
    for r in chunks.where(F.col("chunk_index") < SHOWN).orderBy("chunk_index").collect():
        out(f"--- Chunk {r['chunk_index']} ---")
        if r["context_prefix"]:
            out(f"[context]\n{r['context_prefix']}")
        out(f"[content]\n{r['text']}\n")
    issues = durable(validate_chunks(documents, chunks, config, elements=elements), "issues")
    n = issues.count()
    out("Chunks are valid." if not n else f"Chunks are not valid: {n} issues.")
    for r in issues.orderBy("invariant", "chunk_index").toLocalIterator():
        out(f"  [{r['invariant']}] chunk {r['chunk_index']}: {r['message']}")
    return n == 0


def compare(spark: SparkSession, pages: DataFrame, out=print) -> None:
    """Print the quality of the document's chunks by each strategy."""
    blocks = durable(structured_blocks(pages), "blocks")
    documents, placed = (durable(x, "table") for x in normalized_documents(pages, blocks, True))
    out(format_quality_comparison(compare_strategies(documents, placed)))


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lamina", description=__doc__.split("\n")[0])
    parser.add_argument("command", choices=["report", "compare"])
    parser.add_argument("path")
    parser.add_argument("--password", default="")
    parser.add_argument("--strategy", default="v2.2", choices=sorted(STRATEGIES))
    asked = parser.parse_args(args)
    spark = SparkSession.builder.appName("lamina").getOrCreate()
    try:
        pages = document_of(spark, asked.path, asked.password)
    except ValueError as e:
        print(f"Can't read the document: {e}", file=sys.stderr)
        return 1
    if asked.command == "compare":
        compare(spark, pages)
        return 0
    return 0 if report(spark, pages, asked.strategy) else 1


if __name__ == "__main__":
    sys.exit(main())
