"""Vectorised byte, word and shingle kernels over Arrow string columns.

All of them work on slices of a quarter MB of text at a time, so memory follows the slice
(or the longest single text), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
U64 = np.uint64

_rng = np.random.default_rng(20240607)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
BASE = U64(0x9E3779B97F4A7C15)
BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
SHINGLE_MUL = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
            have[0] = 1
            have = np.cumprod(have, dtype=np.uint64)
        if n <= 8 * SLICE_BYTES:
            _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, offs


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about ``limit`` bytes; a row is never cut."""
    if len(column) == 0:
        return
    buf, offs = text_bytes(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a slice, A-Z lower-cased: byte spans, hashes and the words' range in each row."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        n = len(buf)
        self.low = LOWER[buf]
        solid = np.zeros(n + 2, bool)
        solid[1:-1] = ~IS_SPACE[buf]
        cut = np.zeros(n + 1, bool)
        cut[offs] = True
        inner = solid[1:-1]
        self.start = np.flatnonzero(inner & (~solid[:-2] | cut[:-1]))
        self.end = np.flatnonzero(inner & (~solid[2:] | cut[1:])) + 1
        with np.errstate(over="ignore"):
            code = BYTE_CODE[self.low]
            code *= powers(BASE, n)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(code, out=total[1:])
        self.total = total
        self.hash = self.spans(self.start, self.end)
        bounds = np.searchsorted(self.start, offs)
        self.first, self.last = bounds[:-1], bounds[1:]

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the byte spans [start, end) of the lower-cased slice."""
        with np.errstate(over="ignore"):
            h = (self.total[end] - self.total[start]) * powers(BASE_INV, len(self.low) + 1)[start]
            return mix(h + (end - start).astype(np.uint64) * U64(0xD6E8FEB86659FD93))

    def shingles(self, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, first, last): the k-word shingle hashes of each row; a row of fewer words has one of its whole sequence."""
        h, n = self.hash, len(self.hash)
        count = self.last - self.first
        with np.errstate(over="ignore"):
            if n >= k:
                full = h[: n - k + 1] * SHINGLE_MUL[0]
                for j in range(1, k):
                    full += h[j : n - k + 1 + j] * SHINGLE_MUL[j]
                full = mix(full)
            else:
                full = np.zeros(0, np.uint64)
            each = np.where(count >= k, count - k + 1, np.minimum(count, 1))
            last = np.cumsum(each)
            first = last - each
            out = np.empty(int(last[-1]) if len(last) else 0, np.uint64)
            row = np.repeat(np.arange(len(each)), each)
            at = np.arange(len(out)) - first[row] + self.first[row]
            long = (count >= k)[row]
            out[long] = full[at[long]]
            for r in np.flatnonzero((count > 0) & (count < k)):
                part = h[self.first[r] : self.last[r]]
                whole = (part * SHINGLE_MUL[: len(part)]).sum(dtype=np.uint64) + U64(len(part))
                out[first[r]] = mix(np.array([whole], np.uint64))[0]
        return out, first, last

    def sequence_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of each row's word sequence (0 where a row has no words)."""
        a = np.zeros(len(self.first), np.uint64)
        b = np.zeros(len(self.first), np.uint64)
        has = np.flatnonzero(self.last > self.first)
        if len(has):
            with np.errstate(over="ignore"):
                pos = np.arange(len(self.hash)) - np.repeat(self.first[has], (self.last - self.first)[has])
                m = int(pos.max()) + 1
                a[has] = mix(np.add.reduceat(self.hash * powers(BASE, m)[pos], self.first[has]))
                b[has] = mix(np.add.reduceat(mix(self.hash) * powers(BASE_INV, m)[pos], self.first[has]))
        return a.view(np.int64), b.view(np.int64)
