"""From shared keys to components without making all pairs of a key.

Keys that the same nodes share are one key from the start, with their number as its weight.
Every node is first verified against one hub of its keys, then against one drawn leader; the
links found are closed to components.  Only then are pairs of a key made, of nodes still in
different components whose sizes and parity sketches don't rule them out, each at the first
key that it shares, and verified on whole sets.  All pairs of a key are so in one component,
ruled out by a proven bound, or compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut
from .kernels import mix

#: Columns of the short parity sketch, 64 positions each; sets of more than WIDE elements have a wide one too.
FOLDS = [f"f{i}" for i in range(8)]
WIDE = 256
#: Pairs of key and node packed at once by a task that makes them, and held at once by one that sorts them out.
PACKED, HELD = 1 << 18, 1 << 22
#: Keys of a node kept to tell the first one a pair shares.
FIRST_KEYS = 16


def _met(sig: np.ndarray, node: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, ...]:
    """(told, waits, found, sig, node) of pairs of key and node, returned by key and without repeats.

    told: places of pairs whose key is in ``known`` or has two nodes and more; waits: of the
    others; found: the keys told.
    """
    order = np.argsort(sig, kind="stable")
    sig, node = sig[order], node[order]
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    size = np.diff(np.append(first, len(sig)))
    crowd = np.flatnonzero(np.repeat(size > 1, size))
    crowd = crowd[np.lexsort((node[crowd], sig[crowd]))]
    again = np.zeros(len(sig), bool)
    if len(crowd) > 1:
        x, y = crowd[1:], crowd[:-1]
        again[x] = (sig[x] == sig[y]) & (node[x] == node[y])
    sig, node = sig[~again], node[~again]
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    size = np.diff(np.append(first, len(sig)))
    keys = sig[first]
    at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
    met = (size > 1) | (known[at] == keys if len(known) else False)
    told = np.repeat(met, size)
    return np.flatnonzero(told), np.flatnonzero(~told), keys[met], sig, node


def _set_names(sig: np.ndarray, node: np.ndarray) -> np.ndarray:
    """A name for the set of nodes of each key, at each of its pairs; pairs come key by key, without repeats."""
    if not len(sig):
        return sig
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    size = np.diff(np.append(first, len(sig)))
    total = np.add.reduceat(mix(node.view(np.uint64) ^ np.uint64(0x6B)), first)
    return np.repeat(mix(total + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), size)


def meetings(source: DataFrame, keys: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]], by_set: bool = False) -> DataFrame:
    """(sig, node) of the keys that two or more nodes share; ``keys`` gives (key, node) arrays for a batch of ``source``.

    With ``by_set`` a key goes by a name of its set of nodes, unless it is told in pieces.

    Keys are dealt into buckets in the tasks that make them and shuffled as packed blobs, so
    that Spark moves some thousand rows instead of a row for each key.  A task takes its
    buckets one by one, HELD pairs at a time: keys with two nodes are told at once and only
    their values remembered, so a key of any size takes no more memory than another.  A pair
    may be told twice if its bucket is larger than HELD.
    """
    spark = source.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * parts

    def pack(batches):
        held, n = [], 0

        def packed():
            sig, node = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = (mix(sig ^ np.uint64(0x1D)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            both = np.stack([sig[order].view(np.int64), node[order].view(np.int64)], axis=1)
            there, first = np.unique(bucket[order], return_index=True)
            raw, ends = both.tobytes(), np.append(first[1:], len(order)) * 16
            return pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array([raw[x:y] for x, y in zip((first * 16).tolist(), ends.tolist(), strict=True)], pa.binary())], ["bucket", "pairs"])

        for b in batches:
            for sig, node in keys(b):
                held.append((sig.view(np.uint64), node))
                n += len(sig)
                if n >= PACKED:
                    yield packed()
                    held, n = [], 0
        if n:
            yield packed()

    def rows(sig, node):
        for at in range(0, len(sig), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(sig[at : at + (1 << 16)].view(np.int64)), pa.array(node[at : at + (1 << 16)])], ["sig", "node"])

    def meet(batches):
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        current, held, n, known = None, [none], 0, none[0]

        def settle(last: bool):
            nonlocal held, n, known
            sig, node = (np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [none], 0
            if len(sig):
                told, waits, found, sig, node = _met(sig, node, known)
                name = sig[told]
                if by_set and last and not len(known):
                    name = _set_names(name, node[told])
                if not last:
                    held, known = [(sig[waits], node[waits])], np.union1d(known, found)
                yield from rows(name, node[told])

        for b in batches:
            for bucket, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if bucket != current:
                    yield from settle(True)
                    current, known = bucket, none[0]
                both = np.frombuffer(raw.as_buffer(), np.int64).reshape(-1, 2)
                held.append((both[:, 0].view(np.uint64), both[:, 1]))
                n += len(both)
                if n >= HELD:
                    yield from settle(False)
        yield from settle(True)

    dealt = source.mapInArrow(pack, "bucket int, pairs binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(meet, "sig long, node long")


def meeting_sets(source: DataFrame, keys: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """(sig, node, w): as ``meetings``, but keys that the same nodes share are one, and w their number.

    A passage that two texts share gives them dozens of keys, which say the same.  Sets whose
    64-bit names collide are compared as one, so no pair is lost.
    """
    return meetings(source, keys, by_set=True).groupBy("sig", "node").agg(F.count(F.lit(1)).alias("w"))


def parity_folds(owner: np.ndarray, h: np.ndarray, n: int) -> list[pa.Array]:
    """A 512-bit parity sketch of each of n sets, as the FOLDS columns of longs; ``h``: distinct hashes of set ``owner``."""
    size = 64 * len(FOLDS)
    flips = np.bincount(owner * size + (mix(h ^ np.uint64(0x33)) & np.uint64(size - 1)).astype(np.int64), minlength=n * size)
    words = np.packbits((flips & 1).astype(np.uint8), bitorder="little").view(np.int64).reshape(n, len(FOLDS))
    return [pa.array(words[:, i].copy()) for i in range(len(FOLDS))]


def wide_sketches(owner: np.ndarray, h: np.ndarray, n: np.ndarray) -> pa.Array:
    """Parity sketches of 2 to 4 positions an element, a power of two in all, as arrays of longs; null up to WIDE elements.

    A position is the low bits of a hash, so the halves of a sketch XORed are the sketch of
    half its size.
    """
    size = np.where(n > WIDE, 1 << np.ceil(np.log2(np.maximum(n, 1) * 2)).astype(np.int64), 0)
    begins = np.concatenate([[0], np.cumsum(size)])
    big = size[owner] > 0
    at = begins[owner[big]] + (mix(h[big] ^ np.uint64(0x77)) & (size[owner[big]] - 1).astype(np.uint64)).astype(np.int64)
    words = np.packbits((np.bincount(at, minlength=begins[-1]) & 1).astype(np.uint8), bitorder="little").view(np.int64)
    return pa.ListArray.from_arrays(pa.array((begins // 64).astype(np.int32)), pa.array(words), mask=pa.array(size == 0))


#: Columns (name, type) of a sketched set besides its node.
SKETCH = [("n", "long"), *((f, "long") for f in FOLDS), ("wide", "array<long>")]


def sketched(begins: np.ndarray, h: np.ndarray) -> list[pa.Array]:
    """The SKETCH columns of sets given as sorted distinct hashes one after another."""
    n = np.diff(begins)
    owner = np.repeat(np.arange(len(n)), n)
    return [pa.array(n), *parity_folds(owner, h, len(n)), wide_sketches(owner, h, n)]


def _side(x: str) -> list:
    return [F.col(c).alias(f"{x}{c}") for c, _ in SKETCH]


def _may_link(num: int, den: int) -> str:
    """SQL: whether sizes and sketches of sides a and b leave a similarity of num / den.

    Sketches differ in no more positions than sets in elements, and those of similar sets
    are at most (size a + size b) (den - num) / (den + num).
    """
    most = f"(an + bn) * {den - num}"
    short = " + ".join(f"bit_count(a{f} ^ b{f})" for f in FOLDS)
    folded = lambda x, y: f"if(size({x}) > size({y}), transform(sequence(1, size({y})), i -> get({x}, i - 1) ^ get({x}, i - 1 + size({y}))), {x})"
    wide = f"aggregate(zip_with({folded('awide', 'bwide')}, {folded('bwide', 'awide')}, (x, y) -> bit_count(x ^ y)), 0, (s, v) -> s + v)"
    return f"least(an, bn) * {den} >= greatest(an, bn) * {num} and ({short}) * {den + num} <= {most} and if(awide is null or bwide is null, true, {wide} * {den + num} <= {most})"


def _closest(rows: DataFrame, lead: DataFrame) -> DataFrame:
    """(a, b): each node with the leader of most of its keys."""
    shared = rows.select("sig", "node", "w").join(lead, "sig").where("node <> leader").groupBy("node", "leader").agg(F.sum("w").alias("k"))
    closest = shared.groupBy("node").agg(F.max(F.struct("k", "leader"))["leader"].alias("leader"))
    x, y = F.col("node"), F.col("leader")
    return cut(closest.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct(), "pairs")


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(sig, node, w, c) of the keys whose nodes are in two components or more."""
    placed = members.join(labels, "node", "left").select("sig", "node", "w", F.coalesce("component", "node").alias("c"))
    mixed = placed.groupBy("sig").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("sig")
    return cut(placed.join(mixed, "sig", "left_semi"), "open")


def closed_components(members: DataFrame, verify: Callable[[DataFrame], DataFrame], sides: DataFrame, num: int, den: int) -> DataFrame:
    """(node, component) of all nodes with a link, from the cut table ``members`` of ``meeting_sets``.

    ``verify`` keeps the pairs (a, b) that are linked; ``sides``: a cut of node and SKETCH.
    First each node is verified against a hub: of each key the node that meets most others,
    of a node's hubs the one it shares most keys with.  A near copy meets its original in
    more keys than it meets other copies, so groups of copies close here.  Then, among keys
    still mixed, against a leader drawn by hash.  Last come the pairs of a key whose ends
    are still in different components.
    """
    sizes = members.groupBy("sig").agg(F.count(F.lit(1)).alias("m"))
    fame = members.join(sizes, "sig").groupBy("node").agg(F.sum(F.col("m") * F.col("w")).alias("fame"))
    hubs = members.join(fame, "node").groupBy("sig").agg(F.max(F.struct("fame", "node"))["node"].alias("leader"))
    check = lambda pairs: cut(verify(cut(possible(pairs, sides, num, den), "possible")), "links")
    tried = _closest(members, hubs)
    links = check(tried)
    labels = _labels(links)
    rest = _mixed(members, labels)
    drawn = rest.groupBy("sig").agg(F.max(F.struct(F.xxhash64("node", F.lit(5)), F.col("node").alias("node")))["node"].alias("leader"))
    second = cut(_closest(rest, drawn).join(tried, ["a", "b"], "left_anti"), "pairs")
    more = check(second)
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = _labels(links)
        rest = _mixed(rest.drop("c"), labels)
    tried = tried.unionByName(second)
    across = cut(_pairs(rest, sides, num, den).join(tried, ["a", "b"], "left_anti"), "across")
    if not across.isEmpty():
        more = cut(verify(across), "links")
        if not more.isEmpty():
            labels = _labels(links.unionByName(more))
    return labels


def _pairs(rest: DataFrame, sides: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): the pairs of nodes of one key in different components that sizes and sketches leave possible, each at the first key it shares."""
    firsts = rest.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("sig")), 1, FIRST_KEYS).alias("keys"))
    about = rest.join(cut(firsts.join(sides, "node"), "sides"), "node")
    left = about.select("sig", F.col("node").alias("a"), F.col("c").alias("ca"), F.col("keys").alias("ka"), *_side("a"))
    right = about.select("sig", F.col("node").alias("b"), F.col("c").alias("cb"), F.col("keys").alias("kb"), *_side("b"))
    fits = f"a < b and ca <> cb and {_may_link(num, den)} and coalesce(array_min(array_intersect(ka, kb)), sig) >= sig"
    return left.join(right, "sig").where(fits).select("a", "b").distinct()


def _labels(links: DataFrame) -> DataFrame:
    if links.isEmpty():
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return cut(connected_components(links), "components")


def possible(pairs: DataFrame, sides: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches leave a similarity of num / den; ``sides``: node and SKETCH."""
    side = lambda x: sides.select(F.col("node").alias(x), *_side(x))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_may_link(num, den)).select("a", "b")


def hashes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def similar_sets(pairs: DataFrame, sets: DataFrame, num: int, den: int, read: Callable[[bytes], np.ndarray] = hashes) -> DataFrame:
    """The pairs (a, b) whose sets have Jaccard similarity num / den or more.

    ``sets``: node and a binary column that ``read`` turns into sorted distinct hashes.
    """
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")

    def judge(batches):
        for batch in batches:
            a, b = (np.asarray(x) for x in batch.columns[:2])
            good = np.zeros(len(a), bool)
            for i in range(len(a)):
                x, y = (read(batch.column(j)[i].as_py()) for j in (2, 3))
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                common = int((y[at] == x).sum()) if len(y) else 0
                good[i] = common * den >= (len(x) + len(y) - common) * num
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], ["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(judge, "a long, b long").distinct()
