"""Best-fit packing of documents into fixed-length sequences by fitted patterns.

Piece lengths are at most the sequence length, so their histogram is small whatever the
corpus.  Patterns of few lengths that fill a sequence exactly are enumerated from the
histogram, their repeat counts fitted to it by non-negative least squares, rounded down,
and the pieces left over packed best fit decreasing, again on the histogram.  A piece
finds its sequence from its rank among the pieces of its length.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, with_rank

SEQUENCE = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k"
#: The added token that the vocabulary file declares.
SPECIAL = {"<|endoftext|>": 50256}
#: Triples enumerated for each length; more make the fit slower, its plan seldom shorter.
TRIPLES_PER_LENGTH = 6
#: The fit ends after so many sweeps, or with one whose largest step is under a quarter of a sequence.
SWEEPS, LEAST_STEP = 60, 0.25
_encoders: dict[str, object] = {}


def encoder(name: str = TOKENIZER):
    """The byte-level BPE of a public vocabulary file; ``encode(text, allowed_special="all")`` gives the ids of its declared tokenizer."""
    if name not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[name] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _encoders[name]


def cut_points(n: int, limit: int = SEQUENCE) -> list[int]:
    """Starts of the pieces of a document of n ids: whole pieces at the end, the shorter one first."""
    first = n % limit or min(n, limit)
    return [0, *range(first, n, limit)]


def pieces(docs: DataFrame, limit: int = SEQUENCE, text: str = "text", key: str = "doc_id", tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32 (and ids): the tokenised documents, cut only where longer than ``limit``.

    A null text is an empty one and gives the end id alone.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches):
        bpe = encoder(tokenizer)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows, texts = [], part.column(1).to_pylist()
                for i, t in enumerate(texts):
                    ids = np.asarray([*bpe.encode(t or "", allowed_special="all"), END_ID], "<u4")
                    starts = cut_points(len(ids), limit)
                    for p, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                        rows.append((i, p, s, e - s, zlib.crc32(ids[s:e].tobytes()), ids[s:e]))
                columns = [part.column(0).take(pa.array([r[0] for r in rows], pa.int32())), pa.array([r[1] for r in rows], pa.int32())]
                columns += [pa.array([r[j] for r in rows], pa.int64()) for j in (2, 3, 4)]
                if with_ids:
                    columns.append(pa.array([r[5].astype(np.int32) for r in rows], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).mapInArrow(run, schema)


def enumerate_patterns(histogram: dict[int, int], limit: int, triples: int = TRIPLES_PER_LENGTH) -> list[tuple[int, ...]]:
    """Patterns of one to three lengths of the histogram that sum to ``limit`` exactly (one: just the full length)."""
    lengths = sorted(histogram)
    have, out = set(lengths), set()
    if limit in have:
        out.add((limit,))
    for a in lengths:
        if a >= limit:
            continue
        if limit - a in have and a <= limit - a:
            out.add((limit - a, a))
        # triples whose other two are as near the halves of the rest as may be, and spread from there
        rest, found = limit - a, 0
        at = bisect_left(lengths, rest / 2)
        for b in lengths[at:]:
            c = rest - b
            if c < 1 or found >= triples:
                break
            if c in have and b < limit:
                out.add(tuple(sorted((a, b, c), reverse=True)))
                found += 1
    return sorted(out, reverse=True)


def fit_counts(patterns: list[tuple[int, ...]], histogram: dict[int, int], limit: int, sweeps: int = SWEEPS, least: float = LEAST_STEP) -> np.ndarray:
    """Non-negative least squares of pattern counts to the histogram, by cyclic coordinate descent.

    Each pattern touches at most three lengths, so a sweep costs a few operations a pattern.
    It ends with a sweep whose largest step is under ``least``, or after ``sweeps``; counts are
    rounded down afterwards and what they leave is packed best fit, so no piece depends on it.
    """
    target = np.zeros(limit + 1)
    for n, c in histogram.items():
        target[n] = c
    columns = [np.unique(p, return_counts=True) for p in patterns]
    x, residual = np.zeros(len(patterns)), target.copy()
    norms = [float((w * w).sum()) for _, w in columns]
    for _ in range(sweeps):
        moved = 0.0
        for j, (at, w) in enumerate(columns):
            step = max(-x[j], float(residual[at] @ w) / norms[j])
            if step:
                x[j] += step
                residual[at] -= step * w
                moved = max(moved, abs(step))
        if moved < least:
            break
    return x


def plan_sequences(histogram: dict[int, int], limit: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """[(pattern, repeats)] that uses every piece of the histogram exactly once.

    Fitted twice, to pairs alone and to pairs and triples; the plan of fewer sequences holds.
    """
    plans = [_fitted(histogram, limit, triples) for triples in (TRIPLES_PER_LENGTH, 0)]
    return min(plans, key=lambda plan: sum(n for _, n in plan))


def _fitted(histogram: dict[int, int], limit: int, triples: int) -> list[tuple[tuple[int, ...], int]]:
    left = {n: c for n, c in histogram.items() if c}
    plan: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...], n: int) -> None:
        plan.append((pattern, n))
        for v, k in zip(*np.unique(pattern, return_counts=True), strict=True):
            left[int(v)] -= int(k) * n
            if not left[int(v)]:
                del left[int(v)]

    patterns = enumerate_patterns(left, limit, triples)
    if patterns:
        counts = np.floor(fit_counts(patterns, left, limit) + 1e-9).astype(np.int64)
        for j in np.argsort(-counts, kind="stable"):
            lengths, w = np.unique(patterns[j], return_counts=True)
            n = min([int(counts[j]), *(left.get(int(v), 0) // int(k) for v, k in zip(lengths, w, strict=True))])
            if n > 0:
                take(patterns[j], n)
    # what rounding and the fit leave: the longest first, each sequence filled with the longest that fits
    keys = sorted(left)
    while left:
        pattern, room = [], limit
        used: dict[int, int] = {}
        while room:
            at = bisect_left(keys, room + 1) - 1
            while at >= 0 and left.get(keys[at], 0) - used.get(keys[at], 0) <= 0:
                at -= 1
            if at < 0:
                break
            pattern.append(keys[at])
            used[keys[at]] = used.get(keys[at], 0) + 1
            room -= keys[at]
        take(tuple(pattern), min(left[v] // k for v, k in used.items()))
        keys = [k for k in keys if k in left]
    return plan


def placements(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """[(length, low rank, high rank, first sequence, offset)]: where the pieces of a length go, by rank."""
    reached: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, n in plan:
        offset = 0
        for length in pattern:
            low = reached.get(length, 0)
            out.append((length, low, low + n, sequence, offset))
            reached[length] = low + n
            offset += length
        sequence += n
    return out


def pack(docs: DataFrame, limit: int = SEQUENCE, text: str = "text", key: str = "doc_id", tokenizer: str = TOKENIZER) -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row.

    Sequences hold at most ``limit`` ids; only longer documents are cut.  Null and empty
    texts are documents of one id; very long ones are tokenised whole.  Repeated rows are packed
    each, ties in any order; an empty table gives no rows; other columns are not read.  The plan has at most a few rows for each length, so
    it is sent to every executor.
    """
    small_batches(docs.sparkSession)
    found = cut(pieces(docs, limit, text, key, tokenizer), "pieces")
    histogram = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # at most `limit` rows
    placed = np.array(sorted(placements(plan_sequences(histogram, limit))), np.int64).reshape(-1, 5)
    span = int(placed[:, 2].max()) + 1 if len(placed) else 1
    starts = placed[:, 0] * span + placed[:, 1]
    shared = docs.sparkSession.sparkContext.broadcast((starts, placed, span))
    ranked = with_rank(found, ["length"], ["_id", "piece", "start", "ids_crc32"], "_rank")
    names = ["_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        starts, placed, span = shared.value
        for b in batches:
            length, rank = (np.asarray(b.column(i)) for i in (3, 5))
            at = np.searchsorted(starts, length * span + rank, "right") - 1
            sequence = placed[at, 3] + rank - placed[at, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(placed[at, 4])], [*names, "sequence_id", "offset"])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select(*names, "_rank").mapInArrow(run, schema).withColumnRenamed("_id", key)


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents packed into sequences of 1024 ids; all cases as in ``pack``."""
    return pack(docs)


def op5_pattern_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
