"""Array work on the UTF-8 bytes of many documents at once, for use inside Arrow tasks.

Documents of an Arrow batch already lie one after another in one buffer. The helpers here
cut a batch into slices of bounded bytes and compute substring hashes from prefix sums, so
the cost per byte is a few vectorised passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 1 << 20
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def _byte_table(seed: int, lower: bool = False) -> np.ndarray:
    with np.errstate(over="ignore"):
        codes = mix((np.arange(1, 257, dtype=U) + U(seed) * U(1 << 20)) * U(0x9E3779B97F4A7C15))
    if lower:
        codes[65:91] = codes[97:123]
    return codes


_TABLES = {(s, low): _byte_table(s, low) for s in (1, 2) for low in (False, True)}
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse modulo 2^64."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        base = _BASES[which]
        size = max(n, SLICE_BYTES + 4096)
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            up, down = (np.concatenate([[U(1)], np.full(size - 1, U(b))]).cumprod(dtype=U) for b in (base, inverse))
        have = _POWERS[which] = (up, down)
    return have[0][:n], have[1][:n]


class Hasher:
    """Hashes of substrings of ``buf`` by position, from one prefix sum."""

    def __init__(self, buf: np.ndarray, which: int = 0, lower: bool = False):
        n = len(buf)
        up, self.down = powers(n + 1, which)
        self.sums = np.zeros(n + 1, dtype=U)
        np.cumsum(_TABLES[which + 1, lower][buf] * up[:n], out=self.sums[1:])

    def span(self, start, end) -> np.ndarray:
        """Hashes of ``buf[start:end]``; equal strings of equal length hash equally."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all ``k``-byte strings, by start."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, dtype=U)
        return mix((self.sums[k:] - self.sums[:-k]) * self.down[:n])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.binary() if "binary" in str(column.type) else pa.string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    n, at = len(column), column.offset
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int32, count=at + n + 1)[at:].astype(np.int64) if n else np.zeros(1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off


def slices(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Consecutive rows of ``batch`` whose texts hold at most ``limit`` bytes (one row at least),
    with their bytes and offsets, so that temporary arrays stay small whatever the batch holds."""
    buf, off = text_buffer(batch.column(batch.schema.get_field_index(name)))
    start, rows = 0, batch.num_rows
    while start < rows:
        end = int(np.searchsorted(off, off[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), rows)
        yield batch.slice(start, end - start), buf[off[start] : off[end]], off[start : end + 1] - off[start]
        start = end


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def words(buf: np.ndarray, off: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of other bytes than those marked in ``space`` (space and
    0x09-0x0D), and for each document the index of its first word (one entry more than documents)."""
    n = len(buf)
    solid = ~space[buf]
    fresh = np.zeros(n + 1, dtype=bool)
    fresh[off] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | fresh[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | fresh[1:n]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, off)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``range(start, start + length)``."""
    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, dtype=np.int64) - first, lengths)


def window_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the rightmost smallest entry of each window of ``w`` entries, by start."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    # The low bits give way to the position, counted down, so that later ties are smaller.
    bits = max(int(len(h)).bit_length(), 1)
    low = U((1 << bits) - 1)
    v = (h & ~low) | (low - np.arange(len(h), dtype=U))
    span = 1
    while span * 2 <= w:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    if span < w:
        v = np.minimum(v[:n], v[w - span : w - span + n])
    return (low - (v[:n] & low)).astype(np.int64)
