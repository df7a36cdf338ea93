"""Structured documents as JSON, there and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = "struct<block_id:string,type:string,text:string,page:int,start:int,end:int,is_noise:boolean,level:int,items:array<string>,columns:array<string>,rows:array<array<string>>>"
DOCUMENT = f"struct<document_id:string,full_text:string,blocks:array<{BLOCK}>>"


def to_json(blocks: DataFrame, full_text: DataFrame) -> DataFrame:
    """(document_id, json) of the blocks of each document in order."""
    block = F.struct("block_id", "type", "text", F.col("page_number").alias("page"), F.col("start_char").alias("start"), F.col("end_char").alias("end"), "is_noise", "level", "items", "columns", "rows")
    grouped = blocks.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "block_seq", block.alias("b")))), lambda x: x["b"]).alias("blocks"))
    return grouped.join(full_text, "document_id").select("document_id", F.to_json(F.struct("document_id", "full_text", "blocks")).alias("json"))


def from_json(documents: DataFrame) -> DataFrame:
    """The blocks of JSON documents, one row each."""
    return documents.select(F.from_json("json", DOCUMENT).alias("d")).select("d.document_id", F.explode("d.blocks").alias("b")).select("document_id", "b.*")


def json_problems(documents: DataFrame) -> DataFrame:
    """(document_no, block_id, problem) of JSON documents that ``from_json`` can't give whole; ``documents``: json.

    Malformed JSON, blocks of unknown type, and blocks without what their type needs: any
    block an id, text, page and span, a heading its level, a list its items, a table its rows.
    """
    read = documents.select(F.monotonically_increasing_id().alias("document_no"), F.from_json("json", DOCUMENT).alias("d"))
    broken = read.where("d.document_id is null or d.blocks is null").select("document_no", F.lit(None).cast("string").alias("block_id"), F.lit("malformed document").alias("problem"))
    each = read.select("document_no", F.explode("d.blocks").alias("b")).select("document_no", "b.*")
    missing = F.col("block_id").isNull() | F.col("text").isNull() | F.col("page").isNull() | F.col("start").isNull() | F.col("end").isNull()
    known = F.col("type").isin("heading", "paragraph", "list", "table", "page_header", "page_footer")
    problem = (
        F.when(~F.coalesce(known, F.lit(False)), "unknown type").when(missing, "a field is missing").when((F.col("type") == "heading") & F.col("level").isNull(), "heading without level")
        .when((F.col("type") == "list") & F.col("items").isNull(), "list without items").when((F.col("type") == "table") & F.col("rows").isNull(), "table without rows")
    )
    twice = each.groupBy("document_no", "block_id").count().where("count > 1 and block_id is not null").select("document_no", "block_id", F.lit("id used twice").alias("problem"))
    return broken.unionByName(each.select("document_no", "block_id", problem.alias("problem")).where("problem is not null")).unionByName(twice)
