"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (rows with equal texts) are sorted by size and each enters the bin with the
tightest remaining capacity that still holds it, found in a balanced tree of remaining
capacities.  The packing runs on the driver over a histogram, not over groups: all m
groups of one size class that fit the tightest bin go there together, which is what
best fit does with equal items one by one.  A size class is a size rounded up to
``precision`` significant bits, so the histogram has at most 2**precision entries for
each power of two, whatever the corpus.  Groups learn their bin by their rank within
the class, computed without gathering a class in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, with_rank

PRECISION = 11


@dataclass
class _Node:
    key: tuple[int, int]
    height: int = 1
    left: _Node | None = None
    right: _Node | None = None


class CapacityTree:
    """AVL tree of (remaining capacity, bin)."""

    def __init__(self) -> None:
        self.root: _Node | None = None

    @staticmethod
    def _height(n: _Node | None) -> int:
        return n.height if n else 0

    def _turn(self, n: _Node, up: str, other: str) -> _Node:
        child = getattr(n, up)
        setattr(n, up, getattr(child, other))
        setattr(child, other, n)
        for x in (n, child):
            x.height = 1 + max(self._height(x.left), self._height(x.right))
        return child

    def _balance(self, n: _Node) -> _Node:
        n.height = 1 + max(self._height(n.left), self._height(n.right))
        lean = self._height(n.left) - self._height(n.right)
        if abs(lean) < 2:
            return n
        up, other = ("left", "right") if lean > 1 else ("right", "left")
        child = getattr(n, up)
        if self._height(getattr(child, other)) > self._height(getattr(child, up)):
            setattr(n, up, self._turn(child, other, up))
        return self._turn(n, up, other)

    def add(self, key: tuple[int, int]) -> None:
        def put(n: _Node | None) -> _Node:
            if n is None:
                return _Node(key)
            side = "left" if key < n.key else "right"
            setattr(n, side, put(getattr(n, side)))
            return self._balance(n)

        self.root = put(self.root)

    def remove(self, key: tuple[int, int]) -> None:
        def take(n: _Node | None, key: tuple[int, int]) -> _Node | None:
            if n is None:
                return None
            if key != n.key:
                side = "left" if key < n.key else "right"
                setattr(n, side, take(getattr(n, side), key))
            elif n.left is None or n.right is None:
                return n.left or n.right
            else:
                low = n.right
                while low.left:
                    low = low.left
                n.key, n.right = low.key, take(n.right, low.key)
            return self._balance(n)

        self.root = take(self.root, key)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The least entry whose remaining capacity is ``size`` or more."""
        n, best = self.root, None
        while n:
            if n.key[0] >= size:
                n, best = n.left, n.key
            else:
                n = n.right
        return best


def best_fit_decreasing(histogram: list[tuple[int, int]], capacity: int, limit: int | None = None) -> list[tuple[int, int, int]] | None:
    """[(size, groups, bin)] for bins of ``capacity``; None if more than ``limit`` bins are needed."""
    tree, bins, out = CapacityTree(), 0, []
    for size, count in sorted(histogram, reverse=True):
        while count:
            room = tree.tightest(size)
            if room is None:
                if size > capacity or bins == limit:
                    return None
                room, bins = (capacity, bins), bins + 1
            else:
                tree.remove(room)
            n = min(count, room[0] // size)
            tree.add((room[0] - n * size, room[1]))
            out.append((size, n, room[1]))
            count -= n
    return out


def plan_shards(histogram: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """[(size, groups, shard)] with the least capacity for which best fit needs at most ``shards`` bins.

    A group larger than an even share of what is left gets a shard of its own first;
    nothing smaller could make it fit, and the other shards stay even.
    """
    left, out, first = {s: n for s, n in histogram if n}, [], 0
    while left and shards - first > 1:
        largest, total = max(left), sum(s * n for s, n in left.items())
        if largest * (shards - first) <= total:
            break
        out.append((largest, 1, first))
        left[largest] -= 1
        if not left[largest]:
            del left[largest]
        first += 1
    if not left:
        return out
    items = sorted(left.items())
    total, bins = sum(s * n for s, n in items), shards - first
    low, high = max(-(-total // bins), items[-1][0]), total
    found = best_fit_decreasing(items, high, bins)
    while low < high:
        middle = (low + high) // 2
        fit = best_fit_decreasing(items, middle, bins)
        if fit is None:
            low = middle + 1
        else:
            found, high = fit, middle
    return out + [(s, n, first + b) for s, n, b in found or []]


def shard(docs: DataFrame, shards: int = 16, text: str = "text", key: str = "doc_id", precision: int = PRECISION) -> DataFrame:
    """Every row's shard and its gapless slot there; rows with equal texts share a shard.

    Returns key, size, text_crc32, shard, slot.  Size: UTF-8 bytes plus 1; null counts as
    an empty text and shares its group.  Rows repeated in full are rows of their own and
    get slots of their own.  An empty table gives an empty result.  Columns of ``docs``
    other than the two named are not read.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = cut(docs.select(F.col(key).alias("_id"), (F.octet_length(body) + F.lit(1)).cast("long").alias("_size"), F.crc32(body.cast("binary")).alias("_crc"), F.unhex(F.md5(body)).alias("_text")), "sizes")
    extra = F.greatest(F.length(F.bin("_bytes")) - F.lit(precision), F.lit(0))
    groups = rows.groupBy("_text", "_size").agg((F.count(F.lit(1)) * F.col("_size")).alias("_bytes"))
    groups = cut(groups.withColumn("_extra", extra.cast("int")).withColumn("_class", F.expr("shiftleft(shiftright(_bytes + shiftleft(1L, _extra) - 1, _extra), _extra)")).select("_text", "_size", "_class"), "groups")
    histogram = [(r["_class"], r["count"]) for r in groups.groupBy("_class").count().collect()]  # bounded by `precision`
    plan, reached = [], {}
    for size, n, at in plan_shards(histogram, shards):
        low = reached.get(size, 0)
        plan.append((size, low, low + n, at))
        reached[size] = low + n
    spark = docs.sparkSession
    bins = spark.createDataFrame(plan, "_class long, _low long, _high long, shard int")
    ranked = with_rank(groups, ["_class"], ["_text", "_size"], "_rank")
    placed = ranked.join(F.broadcast(bins), (ranked["_class"] == bins["_class"]) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high"))).select("_text", "_size", "shard")
    found = cut(rows.join(placed, ["_text", "_size"]).select("_id", "_size", "_crc", "shard"), "placed")
    return with_rank(found, ["shard"], ["_id", "_crc", "_size"], "slot", buckets=1024).select(F.col("_id").alias(key), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), "shard", "slot")


def op1_best_fit_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard(docs, 16).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
