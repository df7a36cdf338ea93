"""What the operators share: durable cuts, bounded broadcasts, ranks and connected components."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes, as zstd Parquet, up to which a written table is sent to every executor; larger ones are joined by a shuffle.
BROADCAST_BYTES = 8 << 20
#: Bytes of a batch for a Python worker.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_own_dir: list[str] = []
_scratch: list[list[tuple[SparkSession, str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where it names none, in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="lamina-"))
    return _own_dir[0]


@contextmanager
def scratch():
    """Delete the tables that are cut inside when the block is left, but those cut with ``keep``."""
    made: list[tuple[SparkSession, str]] = []
    _scratch.append(made)
    try:
        yield
    finally:
        _scratch.pop()
        for spark, path in made:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame, name: str = "cut", keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The written table replaces the lineage: a lost executor costs a re-read, not a
    recomputation of all that came before.  Inside ``scratch`` the table lives as long as
    the block, or with ``keep`` as long as the block around that one, if there is any.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    scopes = _scratch[:-1] if keep else _scratch
    if scopes:
        scopes[-1].append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Let Spark send a Python worker at most BATCH_BYTES of a table at once, unless the session has set a size of its own.

    Spark's default is 64 MB; buffers of that size stay with the executor for good.
    """
    if spark.conf.get(_BATCH) == "67108864b":
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def sent(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` bytes; else as it is, for a shuffled join.

    ``df``: a cut or a table, perhaps filtered.  Its size is that of its files, read from the
    plan's statistics without running a job, so wide rows and arrays count as what they weigh.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= limit else df


def with_rank(df: DataFrame, group: list[str], key: list[str], out: str, buckets: int = 256) -> DataFrame:
    """A gapless rank from 0 within ``group`` in no set order, without bringing a group into one task.

    Rows are dealt into ``buckets`` by the hash of ``key``; a bucket's rows are numbered
    locally and shifted by the sizes of the buckets before it.  ``df`` is read twice:
    pass a cut.  Ties on ``key`` are numbered in any order.
    """
    b = "_bucket"
    rows = df.withColumn(b, F.pmod(F.xxhash64(*key), F.lit(buckets)))
    sizes = rows.groupBy(*group, b).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*group, b, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    local = rows.withColumn("_local", F.row_number().over(Window.partitionBy(*group, b).orderBy(*key)) - 1)
    return local.join(shift, [*group, b]).withColumn(out, F.col("_shift") + F.col("_local")).drop(b, "_local", "_shift")




def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Distributed union-find by contraction: each node points to its smallest neighbour
    (or itself), edges are rewritten to the nodes pointed at and loops and repeats go,
    until no edge is left.  A star around its smallest node is done in one round.  From
    the third round on neighbours are compared by a hash of the node, salted by the
    round, so that long chains shrink by a constant factor.  Nodes and edges never reach
    the driver; only the number of edges left does.
    """
    left = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    maps: list[DataFrame] = []
    while True:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        n = len(maps)
        order = (lambda c: F.struct(c.alias("v"))) if n < 2 else (lambda c, n=n: F.struct(F.xxhash64(c, F.lit(n)).alias("h"), c.alias("v")))
        best = both.groupBy("a").agg(F.min(order(F.col("b"))).alias("m"))
        hook = cut(best.select(F.col("a").alias("node"), F.least(order(F.col("a")), F.col("m"))["v"].alias("parent")), "hooks")
        maps.append(hook)
        ends = lambda end: hook.select(F.col("node").alias(end), F.col("parent").alias(f"p{end}"))
        left = cut(left.join(ends("a"), "a").join(ends("b"), "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")).where("a <> b").distinct(), "edges")
        if left.isEmpty():
            break
    labels = maps[0].select("node", F.col("parent").alias("top"))
    for hook in maps[1:]:
        step = hook.select(F.col("node").alias("top"), F.col("parent").alias("next"))
        labels = labels.join(step, "top", "left").select("node", F.coalesce("next", "top").alias("top"))
    if len(maps) > 1:
        labels = cut(labels, "labels")
        least = labels.groupBy("top").agg(F.min("node").alias("component"))
        return labels.join(least, "top").select("node", "component")
    return labels.select("node", F.col("top").alias("component"))


def identity(key: str = "doc_id", text: str = "text") -> Column:
    """What tells a document apart from all but full repeats: key and text hash; null keys sort last."""
    return F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.xxhash64(text).alias("h"))


def keyed(docs: DataFrame) -> DataFrame:
    """_doc, the whole row packed so that no name can clash; _key, its identity; text."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), identity().alias("_key"), "text")


def unkeyed(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col(f"_doc.`{c}`").alias(c) for c in columns])


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, upper, upper.lower())


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]
