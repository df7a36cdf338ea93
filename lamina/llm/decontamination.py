"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A window is a run of 10 consecutive words of an item (a shorter item is one window); it is
contained in a document where the document holds all of the window's shingles in place.
One pass joins the documents' word shingles to the benchmark's; a shingle's frequency over
all documents orders shingles by rarity.  Containment of all shingles makes the rarest one
of a window its necessary prefix: only where a document holds it is the window a candidate.
Length and position bounds drop candidates that would begin before or end after the
document, and a candidate stands if every shingle of the window lies at its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, keyed, let, sent, unkeyed
from .grams import exploded, grams_of, words

WINDOW = 10
SHINGLE = 3


def windows_of(items: DataFrame, window: int, shingle: int, text: str, item: str) -> DataFrame:
    """(row, item, at, length, k, off, gram): every shingle of every window of every item with words; ``row`` numbers the rows of ``items``."""
    plan = let(words(F.col(text)), lambda w: F.struct(F.size(w).alias("n"), w.alias("w")))
    rows = items.select(F.monotonically_increasing_id().alias("row"), F.col(item).alias("item"), plan.alias("p")).where("p.n > 0")
    rows = rows.select("row", "item", F.least(F.lit(window), F.col("p.n")).alias("length"), F.col("p.n").alias("n"), F.col("p.w").alias("w"))
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("length"))))
    rows = rows.withColumn("part", F.slice("w", F.col("at") + 1, F.col("length"))).drop("w", "n")
    sizes = range(1, shingle + 1)
    grams = F.when(F.lit(False), F.array().cast("array<string>"))
    for k in sizes:
        grams = grams.when((F.col("length") == k) if k < shingle else (F.col("length") >= k), grams_of(F.col("part"), k))
    rows = rows.withColumn("k", F.least(F.lit(shingle), F.col("length"))).withColumn("g", grams)
    return rows.select("row", "item", "at", "length", "k", F.posexplode("g").alias("off", "gram"))


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``.

    Null and empty texts have no words and are clean; repeated rows are judged each; repeated
    and tied items count once by id, each text of a tied id is looked for, a null id counts as
    one item without a name; items without words have no window; without items or
    documents nothing is hit.  Very long texts are read whole.  Other columns are not read.
    """
    shingles = cut(windows_of(items, window, shingle, item_text, item), "windows")
    # windows with equal words are looked for once; their items follow
    texts = shingles.groupBy("row", "at", "length", "k").agg(F.first("item").alias("item"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("off", "gram"))), lambda x: x["gram"]), "\n").alias("same"))
    ids = cut(texts.withColumn("window", F.xxhash64("same", F.lit(7)).bitwiseXOR(F.xxhash64("length", "same"))), "ids")
    owners = ids.select("window", "item").distinct()
    shingles = cut(shingles.join(ids.drop("item"), ["row", "at", "length", "k"]).select("window", "length", "k", "off", "gram").distinct(), "shingles")
    vocabulary = cut(shingles.select("k", "gram").distinct().withColumn("g", F.xxhash64("k", "gram")), "vocabulary")
    sizes = sorted(r["k"] for r in shingles.select("k").distinct().collect())  # at most `shingle` rows
    every = exploded(docs, sizes, text, key)
    found = every.join(sent(vocabulary), ["k", "gram"], "left").where("g is not null or k is null")
    found = cut(found.select("_row", "_id", "n_words", F.col("k").isNull().alias("itself"), "pos", "g"), "matches")
    held = found.where("not itself").select("_row", "n_words", "pos", "g")

    frequency = held.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    keyed = shingles.withColumn("g", F.xxhash64("k", "gram"))
    rarest = Window.partitionBy("window").orderBy("n", "g", "off")
    prefix = keyed.join(frequency, "g", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("r", F.row_number().over(rarest)).where("r = 1 and n > 0")
    prefix = cut(prefix.select("window", "length", F.col("off").alias("first"), "g"), "prefixes")
    candidates = held.join(sent(prefix), "g").withColumn("start", F.col("pos") - F.col("first"))
    candidates = candidates.where("start >= 0 and start + length <= n_words").select("_row", "window", "start", "length")
    # every shingle of the window must lie at its place; its number of shingles is known
    need = keyed.select("window", F.col("off"), F.col("g").alias("g"))
    wanted = candidates.join(sent(need), "window").select("_row", "window", "start", "length", (F.col("start") + F.col("off")).alias("pos"), "g")
    proven = wanted.join(held.select("_row", "pos", "g"), ["_row", "pos", "g"], "left_semi").groupBy("_row", "window", "start", "length").agg(F.count(F.lit(1)).alias("n"))
    proven = cut(proven.where(f"n = greatest(length - {shingle} + 1, 1)").select("_row", "window", "start", "length"), "hits")

    # words covered: the union of [start, start + length) by row, in order of start
    before = Window.partitionBy("_row").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    spans = proven.select("_row", "start", "length").distinct().withColumn("reach", F.coalesce(F.max(F.col("start") + F.col("length")).over(before), F.lit(0)))
    hit = spans.groupBy("_row").agg(F.sum(F.greatest(F.lit(0), F.col("start") + F.col("length") - F.greatest("start", "reach"))).cast("long").alias("n_hit"))
    names = proven.select("_row", "window").distinct().join(owners, "window").select("_row", F.col("item").cast("string").alias("item")).distinct()
    joined = F.concat_ws(",", F.array_sort(F.collect_list("item")))
    listed = names.groupBy("_row").agg(F.count(F.lit(1)).alias("n_items"), F.sha2(joined, 256).alias("sha"))
    rows = found.where("itself").select("_row", "_id", "n_words")
    out = rows.join(hit, "_row", "left").join(listed, "_row", "left")
    return out.select(
        F.col("_id").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without any window of a benchmark item; repeated rows stay or go together.

    Null, empty and very long texts, ties and empty tables: as in ``contaminated``.  Rows are
    told apart by id and text; no column name clashes.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = keyed(docs)
    bad = cut(contaminated(rows, items, key="_key").where("contaminated").select("_key").distinct(), "contaminated")
    return unkeyed(rows.join(sent(bad), "_key", "left_anti"), docs.columns)


def op9_prefix_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
