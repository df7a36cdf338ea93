"""Line deduplication by MinHash.

Lines are sets of 5-character shingles.  Each distinct line gets 65 MinHash values in X: lines of similarity 0.8 share a band with probability 0.994, of 0.85 with
0.9992, and lines that have little in common next to never, so bands stay small.  Lines
that share a band are verified by the exact Jaccard similarity of their shingle sets,
links are closed by a distributed union-find, and of each component the first line in
order of document and place stays.  Lines too short for a shingle are repeats where they
are equal; of these, blank ones separate paragraphs and stay.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import SKETCH, closed_components, meeting_sets, similar_sets, sketched
from .common import cut, let, scratch, sent, small_batches
from .kernels import Slice, distinct, mix, slices, span_hash

SHINGLE = 5
BANDS, ROWS = 16, 6
#: Bytes of text signed at once: the 32-bit hashes of its shingles stay within a core's cache.
SIGNED = 1 << 16
NUM, DEN = 80, 100
#: Shorter lines, in characters, have no shingle: only equal ones are repeats.
MIN_CHARS = SHINGLE
_rng = np.random.default_rng(96)
_SCALE = _rng.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_STEP = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of the texts of a slice, one after another, and where each text's begin (one more at the end)."""
    chars = np.flatnonzero((s.data & 0xC0) != 0x80)
    edges = np.searchsorted(chars, s.offsets)
    windows = span_hash(s.prefix(), chars[: len(chars) - SHINGLE + 1], np.append(chars, len(s.data))[SHINGLE:])
    whole = np.ones(len(windows), bool)
    for k in range(1, SHINGLE):  # those that run over the end of their text
        over = edges[1:] - k
        whole[over[(over >= edges[:-1]) & (over < len(windows))]] = False
    return windows[whole], np.concatenate([[0], np.cumsum(np.maximum(np.diff(edges) - SHINGLE + 1, 0))])


def bands(h: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """BANDS band keys for each line, as an array of lines by bands.

    A MinHash value is the least product, modulo 2**32, of a random odd number and the hash
    of a shingle, which is random already.
    """
    low = (h >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(begins) - 1, BANDS), np.uint64)
    hashed = np.empty_like(low)
    for band in range(BANDS):
        key = np.full(len(begins) - 1, band + 1, np.uint64)
        for j in range(band * ROWS, band * ROWS + ROWS):
            np.multiply(low, _SCALE[j], out=hashed)
            key += np.minimum.reduceat(hashed, begins[:-1]) * _STEP[j]
        out[:, band] = key
    return mix(out)


def _lines(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(_id, _h, line, node, _line): every line but short blank ones; node names its text, _h that of the document."""
    parts = F.posexplode(F.split(F.col(text), "\n", -1)).alias("line", "_line")
    rows = docs.select(F.col(key).alias("_id"), F.xxhash64(text).alias("_h"), parts)
    return rows.where((F.char_length("_line") >= MIN_CHARS) | F.col("_line").rlike(r"[^\x20\x09-\x0D]")).withColumn("node", F.xxhash64("_line"))


def _shingled(lines: pa.Array, limit: int = SIGNED):
    """(first row, shingle hashes, where each line's begin) of lines that all have a shingle, slice by slice."""
    for s in slices(lines, limit):
        yield s.first, *shingles(s)


def _signed(batch: pa.RecordBatch):
    """(band keys, nodes) of a batch of (node, line), once for each line, a slice at a time."""
    _, once = np.unique(np.asarray(batch.column(0)), return_index=True)
    once.sort()
    names, texts = np.asarray(batch.column(0))[once], batch.column(1).take(pa.array(once))
    for first, h, begins in _shingled(texts):
        yield bands(h, begins).ravel(), np.repeat(names[first : first + len(begins) - 1], BANDS)


@lru_cache(maxsize=2048)
def line_set(raw: bytes) -> np.ndarray:
    """The sorted distinct shingle hashes of one line."""
    return np.unique(shingles(Slice(0, np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))[0])


def _texts(docs: DataFrame, places: DataFrame, nodes: DataFrame, text: str, key: str) -> DataFrame:
    """(node, set, SKETCH): the line behind each node, as bytes, and the sketch of its shingles; read at its first place."""
    homes = places.join(nodes, "node", "left_semi").select(F.col("first._id").alias("_i"), F.col("first._h").alias("_g"), F.struct(F.col("first.line").alias("line"), "node").alias("at"))
    homes = cut(homes.groupBy("_i", "_g").agg(F.collect_list("at").alias("at")), "homes")
    rows = docs.select(F.col(key).alias("_id"), F.xxhash64(text).alias("_h"), F.col(text).alias("_text"))
    chosen = rows.join(sent(homes), rows["_id"].eqNullSafe(homes["_i"]) & (rows["_h"] == homes["_g"]))
    found = let(F.split("_text", "\n", -1), lambda parts: F.transform("at", lambda x: F.struct(x["node"].alias("node"), F.get(parts, x["line"]).cast("binary").alias("set"))))

    def run(batches):
        for b in batches:
            for first, h, begins in _shingled(b.column(1)):
                n = len(begins) - 1
                h, begins = distinct(h, begins)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n), b.column(1).slice(first, n), *sketched(begins, h)], ["node", "set", *(c for c, _ in SKETCH)])

    schema = "node long, set binary, " + ", ".join(f"{c} {kind}" for c, kind in SKETCH)
    # rows repeated in full give a line once each
    each = chosen.select(F.explode(found).alias("l")).select("l.node", "l.set").dropDuplicates(["node"])
    return cut(each.mapInArrow(run, schema), "texts")


def dropped_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(_id, _h, dropped): for the documents that lose lines, the numbers (from 0) of those lines.

    ``_h`` is xxhash64 of the text: rows with equal key and text are one document and lose
    the same lines.  The line that stays is the first by key, text hash and number; a null
    key comes first.
    """
    every = _lines(docs, text, key)
    place = F.struct("_id", "_h", "line")
    lines = cut(every.drop("_line"), "lines")
    places = cut(lines.groupBy("node").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("m")), "places")
    members = cut(meeting_sets(every.where(F.char_length("_line") >= MIN_CHARS).select("node", "_line"), _signed), "members")
    nodes = cut(members.select("node").distinct(), "nodes")
    texts = _texts(docs, places, nodes, text, key)
    labels = closed_components(members, lambda pairs: similar_sets(pairs, texts, NUM, DEN, line_set), texts.drop("set"), NUM, DEN)
    # lines that repeat: equal ones by their node, similar ones by their component
    placed = places.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("c"), F.col("component").isNotNull().alias("linked"), "first", "m").where("linked or m > 1")
    firsts = placed.where("linked").groupBy("c").agg(F.min("first").alias("keep"))
    keeps = placed.where("linked").select("node", "c").join(firsts, "c").select("node", "keep").unionByName(placed.where("not linked").select("node", F.col("first").alias("keep")))
    keeps = cut(keeps, "keeps")
    gone = lines.join(keeps, "node").where(place != F.col("keep"))
    return gone.groupBy("_id", "_h").agg(F.array_sort(F.collect_set("line")).alias("dropped"))


def _with_dropped(docs: DataFrame, text: str, key: str) -> DataFrame:
    """_doc (the row of ``docs``, packed so that no name can clash), _text, n_lines, and the sorted numbers of the lines it loses."""
    small_batches(docs.sparkSession)
    with scratch():
        gone = cut(dropped_lines(docs, text, key), "dropped", keep=True)
    gone = gone.select(F.col("_id").alias("_i"), F.col("_h").alias("_g"), F.col("dropped").alias("_dropped"))
    count = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(F.split(F.col(text), "\n", -1))).cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(key).alias("_id"), F.xxhash64(text).alias("_h"), F.col(text).alias("_text"), count.alias("_lines"))
    joined = rows.join(sent(gone), rows["_id"].eqNullSafe(gone["_i"]) & (rows["_h"] == gone["_g"]), "left")
    return joined.select("_doc", "_text", "_lines", F.coalesce("_dropped", F.array().cast("array<int>")).alias("_dropped"))


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All columns of ``docs`` with the text freed of fuzzy repeats of lines, and n_lines, n_dropped.

    Null texts stay null and have no lines; a text without \\n is one line; an empty text is
    one blank line, which stays.  Rows repeated in full are one document and lose the same
    lines; of ties the first line by key, text hash and number stays, a null key first.  A very
    long text or line is read whole; only signing holds it at once.  An empty table gives no
    rows.  Columns n_lines and n_dropped of ``docs`` are replaced; no other name clashes.
    """
    rows = _with_dropped(docs, text, key)
    parts = F.split("_text", "\n", -1)
    kept = let(parts, lambda p: F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("_dropped")), lambda i: F.get(p, i)))
    cleaned = F.when(F.size("_dropped") > 0, F.array_join(kept, "\n")).otherwise(F.col("_text"))
    same = [F.col(f"_doc.`{c}`").alias(c) if c != text else cleaned.alias(text) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return rows.select(*same, F.col("_lines").alias("n_lines"), F.size("_dropped").cast("long").alias("n_dropped"))


def line_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without repeated lines, n_chars to match; a document that lost all its lines goes.

    Nulls, empty and very long texts, ties, repeated rows, empty tables: as in dedup_lines.
    A null text keeps a null n_chars.  Columns n_lines and n_dropped of ``docs``, which the
    table documents has not, hold the stage's counts.
    """
    out = dedup_lines(docs).where("n_dropped = 0 or n_dropped < n_lines")
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def op4_minhash_lines(spark, sf_dir: str) -> DataFrame:
    rows = _with_dropped(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", "doc_id")
    return rows.select("_doc.doc_id", F.col("_lines").alias("n_lines"), F.size("_dropped").cast("long").alias("n_dropped"), F.col("_dropped").alias("dropped_lines"))
