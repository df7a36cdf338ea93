"""Vectorised text kernels over Arrow buffers.

Texts stay in the UTF-8 buffer that Arrow hands over; words, lines and shingles are
spans of that buffer, hashed together by one prefix sum.  Work goes through the buffer
in slices of 256 KB, so memory follows the slice (or the longest single text), never
the Arrow batch or the partition.

Span hash: with random 64-bit values T per byte and an odd base B, the prefix sums
S[i] = sum(T[b_k] * B**k, k < i) modulo 2**64 give (S[e] - S[s]) * B**-s, a value that
depends only on the bytes of the span; a finaliser spreads it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Workers live on between tasks: freed buffers go back to the system, not to a pool.
pa.set_memory_pool(pa.system_memory_pool())

#: Bytes of a slice: its 64-bit arrays stay within a core's cache.
SLICE_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: White space of the word patterns: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


@dataclass
class Slice:
    """Texts ``first .. first + n - 1`` of an array: their bytes and where each begins."""

    first: int
    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, n + 1 entries, from 0

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def prefix(self, data: np.ndarray | None = None) -> np.ndarray:
        data = self.data if data is None else data
        up, _ = _grown(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * up[: len(data)], out=sums[1:])
        return sums

    def owner(self, at: np.ndarray) -> np.ndarray:
        """Of which text (from 0 within the slice) each byte position is part."""
        return np.searchsorted(self.offsets, at, "right") - 1

    def words(self, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each run of bytes outside ``space``, cut at text borders."""
        if not len(self.data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        inside = ~space[self.data]
        border = np.zeros(len(self.data) + 1, bool)
        border[self.offsets] = True
        before, after = np.empty_like(inside), np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        return np.flatnonzero(inside & (border[:-1] | ~before)), np.flatnonzero(inside & (border[1:] | ~after)) + 1

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r"""Start, end and owner of each \n-split line; a text without \n is one line."""
        breaks = np.flatnonzero(self.data == 10)
        starts = np.concatenate([self.offsets[:-1], breaks + 1])
        owners = np.concatenate([np.arange(self.n), self.owner(breaks)])
        order = np.lexsort((np.arange(len(starts)), starts, owners))
        starts, owners = starts[order], owners[order]
        last = np.ones(len(starts), bool)
        last[:-1] = owners[1:] != owners[:-1]
        ends = np.empty_like(starts)
        ends[:-1] = starts[1:] - 1
        ends[last] = self.offsets[owners[last] + 1]
        return starts, ends, owners


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = _grown(len(sums) - 1)
    return mix((sums[ends] - sums[starts]) * down[starts])


def run_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive entries of ``h`` (empty with fewer)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        total += h[j : len(h) - k + 1 + j] * _STEPS[j]
    return mix(total)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Whole texts in runs of about ``limit`` bytes; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, raw = texts.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        stop = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield Slice(first, data[offsets[first] : offsets[stop]], offsets[first : stop + 1] - offsets[first])
        first = stop


def text_hash(texts: pa.Array) -> np.ndarray:
    """One 64-bit hash for each whole text; null and empty are 0."""
    out = [span_hash(s.prefix(), s.offsets[:-1], s.offsets[1:]) for s in slices(texts)]
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def distinct(h: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each segment of ``h``, and where each begins (one more at the end); sorts ``h`` in place."""
    for x, y in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        h[x:y].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[begins[:-1][begins[:-1] < begins[1:]]] = True
    return h[new], np.concatenate([[0], np.cumsum(new)])[begins]
