"""The corpus pipeline: quality rules, line dedup, near duplicates, decontamination, packing.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next one's ``docs``.  All but
the last return the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamina.llm.common import cut
from lamina.llm.decontamination import decontamination_stage
from lamina.llm.jaccard import jaccard_stage
from lamina.llm.lines import line_stage
from lamina.llm.packing import packing_stage
from lamina.llm.quality import quality_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can't express the fuzzy line dedup nor the packing; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next.

    Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns have
    the results that each stage states; an empty table gives no pieces.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
