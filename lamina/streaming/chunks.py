"""Chunking of page files as they arrive: every micro-batch is whole documents, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lamina.operators.chunk import chunk_documents
from lamina.operators.structure import normalized_documents, structured_blocks
from lamina.schemas import ChunkingConfig


def chunk_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, config: ChunkingConfig, schema: str = "document_id string, page_number int, text string") -> StreamingQuery:
    """Read Parquet files of pages from ``source`` and append their chunks to ``sink``.

    A file must hold all pages of its documents.  Chunks of a batch go to a folder of the
    batch's own, overwritten if the batch is run again, so each is there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        blocks = structured_blocks(batch)
        documents, placed = normalized_documents(batch, blocks, True)
        chunk_documents(documents, config, placed).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
