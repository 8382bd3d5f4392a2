"""Hashed character n-grams of many texts at once, and small sparse models over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import Hasher, mix

BITS = 18
_U = np.uint64

# Shapes of characters: capitals A, small letters a, digits 0, the rest as it is.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58] = 48
_SHAPE[65:91] = 65
_SHAPE[97:123] = 97


def _char_starts(buf: np.ndarray) -> np.ndarray:
    return np.flatnonzero((buf & 0xC0) != 0x80)


def grams(buf: np.ndarray, off: np.ndarray, sizes: tuple[int, ...], shape: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket) of every n-gram of code points, one pair of arrays for each size, in
    order of document. ASCII case is ignored; with ``shape``, only shapes count."""
    starts = _char_starts(buf)
    owner = np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(starts, off)))
    stop = off[1:][owner]
    h = Hasher(_SHAPE[buf], 0) if shape else Hasher(buf, 0, lower=True)
    ends = np.append(starts, len(buf))
    for n in sizes:
        if len(starts) < n:
            continue
        a, b = starts[: len(starts) - n + 1], ends[n:]
        inside = b <= stop[: len(a)]
        a, b, doc = a[inside], b[inside], owner[: len(a)][inside]
        code = mix(h.span(a, b) + _U(n + (1 << 10) * shape))
        yield doc, (code >> _U(64 - BITS)).astype(np.int64)


def counted(parts: Iterator[tuple[np.ndarray, np.ndarray]], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, bucket) with their counts, by document; ``keep`` marks the buckets
    that matter."""
    keys = []
    for doc, bucket in parts:
        if keep is not None:
            chosen = keep[bucket]
            doc, bucket = doc[chosen], bucket[chosen]
        keys.append((doc << BITS) | bucket)
    every = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    key, n = np.unique(every, return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), n


def bounded_sample(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """At most ``2 * bound`` rows (about ``bound``, or all if there are fewer), drawn by the hash
    of ``key``, so that the same rows are drawn at every run."""
    n = rows.count()
    share = min(1.0, bound / max(n, 1))
    return rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 24)) < F.lit(int(share * (1 << 24)) + 1)).limit(2 * bound)


def one_text_each(docs: DataFrame, sample: DataFrame, label: str) -> DataFrame:
    """(label, key, text): for every id of the sample one text, the smallest of those that stand under
    it, so that a repeated id cannot widen the sample. ``key`` orders the rows alike at every run."""
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select("doc_id", text).join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min(label).alias(label), F.min("text").alias("text"))
    return rows.select(label, F.xxhash64("text").alias("key"), "text")


def gathered(rows: DataFrame, label: str, lists: tuple[str, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labels, row lengths and the flat lists of a bounded table, ordered by label and key. Rows equal in
    both have equal lists, so sums of floats do not depend on the order in which rows arrive. The arrays
    are NumPy's own: Arrow's copies, one list at a time, go back to the system."""
    t = rows.toArrow()
    order = pa.array(np.lexsort((t["key"].to_numpy(), t[label].to_numpy())))
    labels, flat = t[label].to_numpy()[order.to_numpy()], []
    t = t.select(lists)
    for name in lists:
        one = t[name].combine_chunks()
        t = t.drop_columns(name)
        one = one.take(order)
        lengths = np.array(one.value_lengths().to_numpy(zero_copy_only=False))
        flat.append(np.array(one.flatten().to_numpy(zero_copy_only=False)))
        del one
    del t, order
    pa.default_memory_pool().release_unused()
    return labels, lengths, *flat


class Sparse:
    """Rows of (feature, value), for products in both directions: flat arrays and the rows' lengths. Products
    are summed in order, a block of entries at a time, so that they need little memory besides."""

    BLOCK = 1 << 18

    def __init__(self, lengths: np.ndarray, features: np.ndarray, values: np.ndarray, width: int):
        self.width = width
        self.height = len(lengths)
        self.rows = np.repeat(np.arange(self.height, dtype=np.int32), lengths)
        self.cols = features
        self.vals = values

    def _summed(self, to: np.ndarray, at: np.ndarray, factor: np.ndarray, height: int) -> np.ndarray:
        out = np.zeros(height)
        for a in range(0, len(to), self.BLOCK):
            b = slice(a, a + self.BLOCK)
            np.add.at(out, to[b].astype(np.intp), self.vals[b] * factor[at[b]])
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self._summed(self.rows, self.cols, w, self.height)

    def back(self, g: np.ndarray) -> np.ndarray:
        return self._summed(self.cols, self.rows, g, self.width)


def descend(gradient, start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Minimise by gradient steps with running moments (deterministic, full batch)."""
    w, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(w)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def sums(doc: np.ndarray, weights: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(doc, weights=weights, minlength=rows) if len(doc) else np.zeros(rows)
