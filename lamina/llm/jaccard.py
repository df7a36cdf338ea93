"""N-gram Jaccard join by parity sketches.

A document's set of distinct word 5-grams is hashed into a parity sketch: each shingle flips
one position, so two sketches differ in at most |A xor B| positions.  Sets with Jaccard
similarity t or more and sizes a <= b differ by at most (a + b) (1 - t) / (1 + t), so if the
sketch is divided into more blocks than that, some block is equal in both: documents are
joined on equal blocks, within bands of sizes that can match at all.  A block is kept as the
XOR of the 64-bit hashes of its shingles (the parity of a 2**64-position block), so empty
blocks, which say nothing, are left out; a document of size n sends its d(n) + 1 rarest
filled blocks, d(n) being the most by which a partner can differ.  Rarity is the same total
order for all documents, led by the count of the block's rarest shingle among shingles found
frequent anywhere, so a passage that a third of all documents share is not joined on while
there is anything else.  Candidates are verified on their whole shingle sets.

Not all pairs of a block are made: see ``buckets``.  Equal sets are one node throughout.  So
no link between different texts is lost, and a group of near copies costs as many pairs as
it has members.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import SKETCH, closed_components, meeting_sets, similar_sets, sketched
from .common import cut, keyed, scratch, sent, small_batches, unkeyed
from .kernels import LOWER, distinct, mix, run_hash, slices, span_hash

SHINGLE = 5
#: Similarity as a ratio of whole numbers: intersection * DEN >= union * NUM.
NUM, DEN = 80, 100
#: Sizes of a band: from s to BAND * s.  Blocks: BLOCKS for each that a document has to send.
BAND, BLOCKS = 2, 3
#: Counters for frequent shingles, and the share of a task's documents from which one is told.
SLOTS, FREQUENT = 1 << 22, 1 / 1024


def shingle_sets(texts: pa.Array, k: int = SHINGLE):
    """(first row, offsets, shingles): the sorted distinct shingle hashes of each text, slice by slice.

    A text of fewer than k words, but not none, has its whole sequence as its one shingle.
    """
    for s in slices(texts):
        low = LOWER[s.data]
        starts, ends = s.words()
        word, owner = span_hash(s.prefix(low), starts, ends), s.owner(starts)
        grams = run_hash(word, k)
        whole = np.flatnonzero(owner[: len(grams)] == owner[k - 1 :]) if len(grams) else np.zeros(0, np.int64)
        h, of = grams[whole], owner[whole]
        counts = np.bincount(owner, minlength=s.n)
        begins = np.concatenate([[0], np.cumsum(counts)])
        extra = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for m in range(1, k):
            few = np.flatnonzero(counts == m)
            if len(few):
                total = np.zeros(len(few), np.uint64)
                for j in range(m):
                    total = mix(total + word[begins[few] + j] + np.uint64(m))
                extra.append((total, few))
        h, of = np.concatenate([h, *(x[0] for x in extra)]), np.concatenate([of, *(x[1] for x in extra)])
        if len(extra) > 1:
            order = np.argsort(of, kind="stable")
            h, of = h[order], of[order]
        h, begins = distinct(h, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=s.n))]))
        yield s.first, begins, h


def nodes_of(offsets: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A 64-bit name for each set, equal for equal sets; 0 for the empty one."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=sums[1:])
    n = np.diff(offsets).astype(np.uint64)
    names = mix(sums[offsets[1:]] - sums[offsets[:-1]] + n * np.uint64(0x9E3779B97F4A7C15))
    return np.where(n > 0, names, np.uint64(0)).view(np.int64)


def most_differing(n: np.ndarray) -> np.ndarray:
    """d(n): the largest symmetric difference between a set of n and a similar one of n or more."""
    largest = n * DEN // NUM
    return (n + largest) * (DEN - NUM) // (DEN + NUM)


def blocks(offsets: np.ndarray, h: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, block hash): the d(n) + 1 rarest filled blocks of each set, in each of its bands."""
    sizes = np.diff(offsets)
    band = np.zeros(len(sizes), np.int64)
    big = sizes > 0
    band[big] = np.floor(np.log(sizes[big]) / np.log(BAND) + 1e-9).astype(np.int64)
    # a set also meets smaller ones of the band below
    below = big & (np.ceil(sizes * NUM / DEN) < BAND**band) & (band > 0)
    differing = most_differing(sizes)
    rows = np.concatenate([np.flatnonzero(big & (differing > 0)), np.flatnonzero(below & (differing > 0))])
    group = np.concatenate([band[big & (differing > 0)], band[below & (differing > 0)] - 1])
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    top = BAND ** (group + 1) * DEN // NUM + 1
    parts = np.where(top <= 128, 1 << 16, BLOCKS * (most_differing(top) + 1))
    n = sizes[rows]
    unit = np.repeat(np.arange(len(rows)), n)
    at = np.arange(len(unit)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[rows], n)
    token = h[at]
    part = (mix(token + np.uint64(0x51)) % parts[unit].astype(np.uint64)).astype(np.int64)
    width = int(parts.max()).bit_length()
    key = (unit << width) | part
    order = np.argsort(key, kind="stable")
    key, token = key[order], token[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    parity = np.bitwise_xor.reduceat(mix(token), first)
    rare = np.minimum.reduceat(weights[(token % np.uint64(SLOTS)).astype(np.int64)], first)
    unit, part = key[first] >> width, key[first] & ((1 << width) - 1)
    sig = mix(parity ^ mix((group[unit].astype(np.uint64) << np.uint64(32)) + part.astype(np.uint64)))
    order = np.lexsort((sig, rare, unit))
    unit, sig = unit[order], sig[order]
    begins = np.searchsorted(unit, np.arange(len(rows)))
    rank = np.arange(len(unit)) - begins[unit]
    sent_ = rank <= differing[rows[unit]]
    return rows[unit[sent_]], sig[sent_]


def _survey(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(_id, node, SKETCH) for every row, and (slot, count) for shingles frequent in a task."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["_id", "node", "slot", "count", *(c for c, _ in SKETCH)]

    def run(batches):
        counts, seen, id_type = np.zeros(SLOTS, np.int32), 0, None
        for b in batches:
            id_type = b.column(0).type
            for first, offsets, h in shingle_sets(b.column(1)):
                size = len(offsets) - 1
                np.add.at(counts, (h % np.uint64(SLOTS)).astype(np.int64), 1)
                seen += size
                none = pa.nulls(size, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, size), pa.array(nodes_of(offsets, h)), none, none, *sketched(offsets, h)], names)
        if seen:
            slot = np.flatnonzero(counts >= max(3, seen * FREQUENT))
            none = pa.nulls(len(slot), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(slot), id_type), none, pa.array(slot), pa.array(counts[slot].astype(np.int64)), *[none] * (len(SKETCH) - 1), pa.nulls(len(slot), pa.list_(pa.int64()))], names)

    return docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).mapInArrow(run, f"_id {kind}, node long, slot long, count long, " + ", ".join(f"{c} {t}" for c, t in SKETCH))


def _weights(survey: DataFrame) -> np.ndarray:
    """log2 of the count of each counter; at most SLOTS rows come to the driver."""
    weights = np.zeros(SLOTS, np.int8)
    for r in survey.where("slot is not null").groupBy("slot").agg(F.sum("count").alias("n")).toLocalIterator():
        weights[r["slot"]] = int(r["n"]).bit_length()
    return weights


def _bucketed(docs: DataFrame, weights: np.ndarray, text: str) -> DataFrame:
    """(sig, node, w): the members of blocks that two or more sets share, and how many blocks the same sets share."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def keys(batch: pa.RecordBatch):
        done = np.zeros(0, np.int64)
        for _, offsets, h in shingle_sets(batch.column(0)):
            node = nodes_of(offsets, h)
            fresh = np.zeros(len(node), bool)
            fresh[np.unique(node, return_index=True)[1]] = True
            fresh &= ~np.isin(node, done)
            done = np.union1d(done, node)
            row, sig = blocks(offsets, h, shared.value)
            keep = fresh[row]
            yield sig[keep], node[row[keep]]

    return meeting_sets(docs.select(F.col(text).alias("_text")), keys)


def _sets(docs: DataFrame, homes: DataFrame, nodes: DataFrame, text: str, key: str) -> DataFrame:
    """(node, set): the whole shingle sets of ``nodes``, each read from one document that has it."""
    wanted = cut(homes.select("node", F.col("home").alias("_want")).join(nodes.distinct(), "node", "left_semi"), "wanted")

    def read(batches):
        for b in batches:
            asked = np.asarray(b.column(1))
            for first, offsets, h in shingle_sets(b.column(0)):
                node = nodes_of(offsets, h)
                hit = np.flatnonzero(node == asked[first : first + len(node)])
                yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array([h[offsets[i] : offsets[i + 1]].tobytes() for i in hit], pa.binary())], ["node", "set"])

    chosen = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(sent(wanted), F.col("_id").eqNullSafe(F.col("_want")))
    # rows of one id and one set are one
    return cut(chosen.select("_text", "node").mapInArrow(read, "node long, set binary").dropDuplicates(["node"]), "sets")


def _verified(docs: DataFrame, homes: DataFrame, pairs: DataFrame, text: str, key: str) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    return similar_sets(pairs, _sets(docs, homes, ends, text, key), NUM, DEN)


def near_components(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_shingles, component_id (the smallest key reachable by links) for every row.

    Rows without words, null texts included, link to nothing and are their own component.
    Repeated rows are returned each; rows with tied keys are told apart by their texts, and
    share the smallest key of what either links to.  Very long texts are read whole.  An empty
    table gives no rows; other columns are not read, so their names can't clash.
    """
    small_batches(docs.sparkSession)
    with scratch():
        survey = cut(_survey(docs, text, key), "survey")
        members = cut(_bucketed(docs, _weights(survey), text), "members")
        once = survey.where("slot is null and n > 0").groupBy("node").agg(F.min("_id").alias("home"), *[F.first(c).alias(c) for c, _ in SKETCH])
        sides = cut(once.join(members.select("node").distinct(), "node", "left_semi"), "sides")
        labels = closed_components(members, lambda pairs: _verified(docs, sides, pairs, text, key), sides.drop("home"), NUM, DEN)
        rows = survey.where("slot is null").select("_id", "n", "node")
        grouped = cut(rows.join(labels, "node", "left").select("_id", "n", F.when(F.col("n") > 0, F.coalesce("component", "node")).alias("c")), "grouped", keep=True)
        least = grouped.where("c is not null").groupBy("c").agg(F.min("_id").alias("component_id"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
        least = cut(least, "least", keep=True)
    return grouped.join(sent(least), "c", "left").select(F.col("_id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "_id").alias("component_id"))


def jaccard_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component one row stays, that of the smallest id.

    A null id is larger than all others; of one id the smallest text hash stays, and of rows
    with equal id and text one.  Rows without words, null and empty texts among them, all
    stay.  Very long texts are read whole; an empty table stays empty; no column name clashes.
    """
    rows = keyed(docs)
    found = cut(near_components(rows, key="_key").where("n_shingles > 0"), "identities")
    gone = cut(found.where("component_id <> _key").select("_key").distinct(), "near")
    twice = cut(found.where("component_id = _key").groupBy("_key").count().where("count > 1").select("_key"), "repeats")
    kept = rows.join(sent(gone), "_key", "left_anti")
    if not twice.isEmpty():
        once = kept.join(sent(twice), "_key", "left_semi").dropDuplicates(["_key"])
        kept = kept.join(sent(twice), "_key", "left_anti").unionByName(once)
    return unkeyed(kept, docs.columns)


def op6_parity_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
