"""URL filters by a Bloom filter cascade.

The keys of a URL are (host suffix, path prefix) for every suffix of its labels and every
prefix length in use.  A cascade answers membership of a listed key exactly for every key
of the corpus it was built over: level 0 holds the listed keys, level 1 those keys of the
corpus's complete key universe that level 0 takes for listed, level 2 the listed keys that
level 1 takes for false positives, and so on until a level makes no mistake.  A lookup walks
the levels and needs no join.  Level 0's rate is set from the sizes of list and universe
(rate ~ list / universe), the others' is one half, so all levels together take about
1.44 * log2(universe / list) + 4 bits a listed key, whatever the corpus; level 1 receives
about as many keys as the list has.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, cut
from .kernels import mix

HASH_SEEDS = (0x51, 0xA7)


@dataclass
class Level:
    bits: int
    hashes: int
    words: np.ndarray  # uint64

    def has(self, h1: np.ndarray, h2: np.ndarray, depth: int) -> np.ndarray:
        found = np.ones(len(h1), bool)
        for at in probes(h1, h2, self.bits, self.hashes, depth):
            found &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


@dataclass
class Cascade:
    """Levels of one list; ``holds`` is exact for the keys of the universe it was built over."""

    levels: list[Level] = field(default_factory=list)

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        result, open_ = np.zeros(len(h1), bool), np.ones(len(h1), bool)
        for depth, level in enumerate(self.levels):
            inside = level.has(h1, h2, depth)
            result[open_ & ~inside] = depth % 2 == 1
            open_ &= inside
        result[open_] = len(self.levels) % 2 == 1
        return result

    @property
    def bytes(self) -> int:
        return sum(len(x.words) * 8 for x in self.levels)


def probes(h1: np.ndarray, h2: np.ndarray, bits: int, hashes: int, depth: int):
    """Bit positions of keys by double hashing, independent from level to level."""
    salt = np.uint64((depth + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    base, step = mix(h1 + salt), mix(h2 ^ salt) | np.uint64(1)
    for i in range(hashes):
        yield (base + np.uint64(i) * step) % np.uint64(bits)


def _level(keys: DataFrame, count: int, rate: float, depth: int) -> Level:
    """A Bloom filter of ``keys`` (h1, h2): bits set in the executors, gathered as 64-bit words."""
    hashes = max(1, round(math.log2(1 / rate)))
    bits = max(64, math.ceil(count * math.log(1 / rate) / math.log(2) ** 2))

    def words(batches):
        for b in batches:
            h1, h2 = (np.asarray(c).view(np.uint64) for c in b.columns)
            at = np.unique(np.concatenate([*probes(h1, h2, bits, hashes, depth)]))
            slot, first = np.unique(at >> np.uint64(6), return_index=True)
            masks = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(masks.view(np.int64))], ["slot", "mask"])

    merged = keys.select("h1", "h2").mapInArrow(words, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask"))
    filled = np.zeros(-(-bits // 64), np.uint64)
    for r in merged.toLocalIterator():  # as many rows as the filter has words: bounded by the list
        filled[r["slot"]] = np.int64(r["mask"]).view(np.uint64)
    return Level(bits, hashes, filled)


def build_cascade(listed: DataFrame, universe: DataFrame, key: str = "key") -> Cascade:
    """A cascade for the keys ``listed`` over all keys of ``universe`` (both: one string column ``key``).

    Keys listed but absent from the universe are held too.  Null keys are ignored.
    """
    hashed = lambda df: cut(df.where(F.col(key).isNotNull()).select(key).distinct().select(key, *[F.xxhash64(F.col(key), F.lit(s)).alias(f"h{i + 1}") for i, s in enumerate(HASH_SEEDS)]), "keys")
    ours = hashed(listed)
    n = ours.count()
    if not n:
        return Cascade()
    others = universe.where(F.col(key).isNotNull()).select(key).distinct()
    total = max(others.agg(F.count(F.lit(1))).first()[0] - n, 1)
    cascade, inside = Cascade(), ours
    rate = min(0.5, max(n * math.sqrt(0.5) / total, 1e-12))
    cascade.levels.append(_level(inside, n, rate, 0))
    wrong = cut(members(others.select(key, *[F.xxhash64(F.col(key), F.lit(s)).alias(f"h{i + 1}") for i, s in enumerate(HASH_SEEDS)]), cascade.levels[0], 0, key).join(ours.select(key), key, "left_anti"), "wrong")
    while (m := wrong.count()):
        depth = len(cascade.levels)
        cascade.levels.append(_level(wrong, m, 0.5, depth))
        inside, wrong = wrong, cut(members(inside, cascade.levels[-1], depth, key), "wrong")
    return cascade


def members(keys: DataFrame, level: Level, depth: int, key: str) -> DataFrame:
    """The keys that ``level`` takes for its own."""
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches):
        for b in batches:
            h1, h2 = (np.asarray(b.column(i)).view(np.uint64) for i in (1, 2))
            yield b.filter(pa.array(shared.value.has(h1, h2, depth)))

    return keys.select(key, "h1", "h2").mapInArrow(run, f"`{key}` string, h1 long, h2 long")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys ``suffix + path prefix`` for all label suffixes of ``host`` and prefixes of the lengths given."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    return F.when(host != "", pairs).otherwise(F.array().cast("array<string>"))


def _split(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})), slash + path


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow", url: str = "url", out: tuple[str, str, str, str] = ("host", "path", "rule", "verdict")) -> DataFrame:
    """All columns of ``pages`` and host, path, rule and verdict for every row.

    ``rules``: (verdict, ``host/path``), one list of keys for each verdict, each with its
    cascade.  A rule fits its host and all subdomains if the path starts with the rule's;
    of those that fit, the longest wins.  Null and malformed urls fit no rule and get
    ``default``, as does a url without a fitting rule.  Rules of one length can't both fit a
    url unless they are equal, and then the later verdict in order of names holds.  Repeated
    rows are judged alike; very long urls are read whole; an empty table gives no rows.
    Columns of ``pages`` with the names in ``out`` are replaced; no other name clashes.
    """
    split = [(verdict, *_split(rule)) for verdict, rule in rules]
    lengths = sorted({len(path) for _, _, path in split})
    spark = pages.sparkSession
    same = [c for c in pages.columns if c not in out]
    parsed = pages.select(F.struct(*[F.col(f"`{c}`") for c in same], F.lit(0).alias("_row")).alias("_doc"), host_of(F.col(url)).alias("_h"), path_of(F.col(url)).alias("_p"))
    kept = [F.col(f"_doc.`{c}`").alias(c) for c in same]
    if not split:
        return parsed.select(*kept, F.col("_h").alias(out[0]), F.col("_p").alias(out[1]), F.lit(None).cast("string").alias(out[2]), F.lit(default).alias(out[3]))
    keys = url_keys(F.col("_h"), F.col("_p"), lengths)
    hosts = parsed.select("_h", *[F.substring("_p", 1, max(lengths)).alias("_p")]).distinct()
    universe = hosts.select(F.explode(keys).alias("key"))
    verdicts = sorted({v for v, _, _ in split})
    built = [build_cascade(spark.createDataFrame([(h + p,) for v, h, p in split if v == verdict], "key string"), universe) for verdict in verdicts]
    shared = spark.sparkContext.broadcast(built)

    def held(h1: pa.Array, h2: pa.Array) -> pa.Array:
        """For each row and key the number of the list that holds the key, or -1."""
        a, b = (np.asarray(h.flatten()).view(np.uint64) for h in (h1, h2))
        found = np.full(len(a), -1, np.int32)
        for i, cascade in enumerate(shared.value):
            found[cascade.holds(a, b)] = i
        sizes = np.asarray(h1.value_lengths().fill_null(0))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(found))

    lookup = F.arrow_udf(held, T.ArrayType(T.IntegerType()))
    hashed = lambda seed: F.transform("_k", lambda k: F.xxhash64(k, F.lit(seed)))
    hashes = [hashed(s) for s in HASH_SEEDS]
    looked = parsed.withColumn("_k", keys).withColumn("_in", lookup(*hashes))
    fits = F.filter(F.zip_with("_k", "_in", lambda k, i: F.struct(F.char_length(k).alias("n"), k.alias("k"), i.alias("i"))), lambda x: x["i"] >= 0)
    best = looked.withColumn("_best", F.array_max(fits))
    names = F.array(*[F.lit(v) for v in verdicts])
    verdict = F.when(F.col("_best").isNull(), F.lit(default)).otherwise(F.get(names, F.col("_best.i")))
    return best.select(*kept, F.col("_h").alias(out[0]), F.col("_p").alias(out[1]), F.col("_best.k").alias(out[2]), verdict.alias(out[3]))


RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op2_url_cascade(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")
