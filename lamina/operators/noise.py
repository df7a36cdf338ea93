"""Running headers and footers: page numbers and lines that recur in the same zone of many pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.functions.classify import is_page_number
from lamina.functions.text import repetition_key, strip

ZONE, MIN_REPEAT, MIN_RATIO = 2, 3, 0.4


def noise_lines(lines: DataFrame, zone_size: int = ZONE, min_repeat_count: int = MIN_REPEAT, min_repeat_ratio: float = MIN_RATIO) -> DataFrame:
    """(document_id, page_number, line_no, noise): noise is page_header or page_footer, footer where both fit.

    ``lines``: document_id, page_number, line_no, raw, with a row for every page, blank ones too.
    """
    page = Window.partitionBy("document_id", "page_number")
    rows = lines.select("document_id", "page_number", "line_no", strip(F.col("raw")).alias("line"))
    sizes = rows.groupBy("document_id").agg(F.count_distinct("page_number").alias("pages"))
    zones = rows.where("line <> ''").withColumns({"up": F.row_number().over(page.orderBy("line_no")), "down": F.row_number().over(page.orderBy(F.desc("line_no")))})
    near = zones.where(F.least("up", "down") <= zone_size)
    near = near.withColumns({"zone": F.explode(F.array_compact(F.array(F.when(F.col("up") <= zone_size, "page_header"), F.when(F.col("down") <= zone_size, "page_footer")))), "key": repetition_key(F.col("line"))})
    near = near.withColumn("seen", F.count(F.lit(1)).over(Window.partitionBy("document_id", "zone", "key")))
    needed = F.greatest(F.lit(min_repeat_count), F.ceil(F.col("pages") * F.lit(min_repeat_ratio).cast("double")).cast("int"))
    hit = near.join(sizes, "document_id").where(is_page_number(F.col("line")) | (F.col("seen") >= needed))
    return hit.groupBy("document_id", "page_number", "line_no").agg(F.min("zone").alias("noise"))
