"""Near-duplicate vectors by blocked cosine products, with spherical k-means cells inside the blocks.

Vectors with equal labels link when their cosine is at least ``threshold`` in double precision.
Equal vectors of a label form a class and are compared through one representative.

* The vectors of a label and length are cut into blocks by hash, of ``BLOCK`` rows (fewer of long ones), and
  any two blocks meet in a task. A task never holds more than two blocks, however many rows a label has.
* Blocks meet in rounds: in one, a vector is sent about once, and the shuffle files of a round go when its
  links are written. So disk is bounded by a few copies of the vectors, not by the number of meetings.
* In a task, vectors are put into the cells of centroids fitted on a sample of at most ``2 * SAMPLE`` vectors
  drawn by hash, at most ``MAX_CELLS``. A vector is compared with a cell when it is its own or the cell's
  bisecting plane is closer than the largest distance of two linked vectors: a linked vector of
  that cell cannot lie further beyond the plane. Then only pairs are left whose parts in ``AXES``
  directions are that close. So no link is lost, whatever the centroids are (recall 1 against brute force).

A task returns link counts per vector and a spanning forest of its links, not the pairs;
components are joined in distributed rounds. One vector per component, that of the smallest
id, is kept. The work is quadratic in the vectors of a label: cells and directions make a pair cheap, they don't
make pairs few.

A vector that is null, zero, or holds null or non-finite components, and a vector with a null
label, links with nothing. Vectors of different lengths never link. Repeated rows, and different
vectors of one id, are vectors of their own. A null id takes part but names a component only if there is no other. An empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import components, discard, materialize, release

SAMPLE = 8192
CELL_ROWS = 128
MAX_CELLS = 512
MAX_LENGTHS = 4
BLOCK = 1 << 17  # vectors of 64 components
AXES = 16
ROUNDS = 8
_BLOCK_KEY = ["label", "dim", "low", "high"]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """``k`` unit centroids of unit vectors; a cell that runs empty takes a random vector."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        near = np.concatenate([np.argmax(part @ c.T, axis=1) for part in np.array_split(x, -(-len(x) // 4096))])
        order = np.argsort(near, kind="stable")
        begin = np.searchsorted(near[order], np.arange(len(c)))
        total = np.add.reduceat(np.vstack([x[order], np.zeros((1, x.shape[1]))]), begin, axis=0)
        empty = np.bincount(near, minlength=len(c)) == 0
        total[empty] = x[rng.integers(0, len(x), int(empty.sum()))]
        size = np.sqrt((total * total).sum(axis=1, keepdims=True))
        c = np.where(size > 1e-12, total / np.maximum(size, 1e-12), c)
    return c


def fit(reps: DataFrame, rows: int) -> dict[int, np.ndarray]:
    """Centroids by vector length. Only the sample reaches the driver."""
    share = min(1.0, SAMPLE / max(rows, 1))
    drawn = reps.where(F.pmod(F.xxhash64("embedding", "label"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))
    drawn = drawn.select("dim", "embedding").limit(2 * SAMPLE)
    by_length: dict[int, list] = {}
    for dim, vector in drawn.collect():
        by_length.setdefault(dim, []).append(vector)
    most = sorted(by_length, key=lambda d: (-len(by_length[d]), d))[:MAX_LENGTHS]
    total = sum(len(by_length[d]) for d in most)
    book = {}
    for dim in sorted(most):
        x = _unit(np.array(by_length[dim], dtype=np.float64))
        k = max(1, min(MAX_CELLS, len(x) // 4 or 1, int(rows * len(x) / total) // CELL_ROWS))
        book[dim] = spherical_kmeans(x, k)
    return book


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


class _Cells:
    """The cells of some unit vectors, their parts in a few directions, and which cells each may have links in."""

    def __init__(self, x: np.ndarray, c: np.ndarray, axes: np.ndarray, reach: float):
        self.x = x
        near = x.astype(np.float32) @ c.astype(np.float32).T
        self.home = near.argmax(axis=1)
        apart = np.sqrt(np.maximum(2.0 - 2.0 * (c @ c.T), 0.0)).astype(np.float32) * np.float32(reach)
        np.subtract(near[np.arange(len(x)), self.home][:, None], near, out=near)
        self.visits = np.ascontiguousarray((near <= apart[self.home] + np.float32(1e-4)).T)
        part = (x @ axes).astype(np.float32)
        half = (part * part).sum(axis=1, keepdims=True) / 2
        one = np.ones_like(half)
        self.left, self.right = np.hstack([part, -half, one]), np.hstack([part, one, -half])


def _links(a: _Cells, b: _Cells, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of linked vectors of two sets, each once and both ways if they are the ``same``; some at a time."""
    least = np.float32(threshold - 1.0 - 1e-4)  # minus half the square of the largest distance
    order = np.argsort(a.home, kind="stable")
    ends = np.searchsorted(a.home[order], np.arange(len(a.visits) + 1))
    for cell in range(len(a.visits)):
        inside = order[ends[cell] : ends[cell + 1]]
        others = np.flatnonzero(b.visits[cell]) if len(inside) else inside
        for p in range(0, len(others), 4096):
            some = others[p : p + 4096]
            right = b.right[some].T
            for q in range(0, len(inside), 256):
                rows = inside[q : q + 256]
                close = (a.left[rows] @ right).ravel()
                if close.max() < least:
                    continue
                i, j = np.divmod(np.flatnonzero(close >= least), len(some))
                if 8 * len(i) > len(rows) * len(some):
                    i, j = np.nonzero(a.x[rows] @ b.x[some].T >= threshold)
                elif len(i):
                    good = np.einsum("ij,ij->i", a.x[rows[i]], b.x[some[j]]) >= threshold
                    i, j = i[good], j[good]
                i, j = rows[i], some[j]
                if same:
                    i, j = i[i != j], j[i != j]
                if len(i):
                    yield i, j


def _join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Put linked places under one root. ``root`` holds a place that is its own root, or one on the way to it."""

    def top(p: np.ndarray) -> np.ndarray:
        while (root[p] != p).any():
            p = root[p]
        return p

    i, j = top(i), top(j)
    while (i != j).any():
        pairs = np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)])[:, i != j], axis=1)
        np.minimum.at(root, pairs[1], pairs[0])
        i, j = top(pairs[0]), top(pairs[1])
        # A place takes the smallest of its links; the others are looked at again.


def _compare(book: dict[int, np.ndarray], threshold: float):
    """Links of the pairs of blocks of a partition sorted by them; a pair may go on in the next batch."""
    reach = float(np.sqrt(2.0 - 2.0 * threshold)) + 1e-9

    def scan(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        dim, same = t["dim"][0].as_py(), t["low"][0].as_py() == t["high"][0].as_py()
        x = _unit(_matrix(t["embedding"].combine_chunks() if t["embedding"].num_chunks != 1 else t["embedding"].chunk(0), dim))
        rep, m, side = (t[c].to_numpy() for c in ("rep", "m", "side"))
        c = book.get(dim)
        c = x[:1] if c is None else c
        axes = np.linalg.qr(np.random.default_rng(0).normal(size=(dim, min(AXES, dim))))[0]
        first = np.arange(len(x)) if same else np.flatnonzero(side == t["low"][0].as_py())
        second = first if same else np.flatnonzero(side != t["low"][0].as_py())
        counts, root = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        if len(first) and len(second):
            a = _Cells(x[first], c, axes, reach)
            b = a if same else _Cells(x[second], c, axes, reach)
            for i, j in _links(a, b, threshold, same):
                i, j = first[i], second[j]
                counts += np.bincount(i, weights=m[j], minlength=len(x)).astype(np.int64)
                if not same:
                    counts += np.bincount(j, weights=m[i], minlength=len(x)).astype(np.int64)
                _join(root, i, j)
        while (root[root] != root).any():
            root = root[root]
        rows, under = np.flatnonzero(counts), np.flatnonzero(root != np.arange(len(x)))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([rep[rows], rep[under]]), pa.int64()),
                pa.array(np.concatenate([counts[rows], np.zeros(len(under), np.int64)])),
                pa.array(np.concatenate([rep[rows], rep[root[under]]]), pa.int64()),
            ],
            names=["rep", "links", "other"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in _BLOCK_KEY]
            new = np.zeros(batch.num_rows, dtype=bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            cuts = np.concatenate([[0], np.flatnonzero(new), [batch.num_rows]])
            for begin, end in zip(cuts[:-1], cuts[1:]):
                here = tuple(k[begin] for k in keys)
                if parts and here != last:
                    yield scan(parts)
                    parts = []
                last = here
                parts.append(batch.slice(begin, end - begin))
        if parts:
            yield scan(parts)

    return run


def _numbered(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows, and the classes of equal vectors of a label with their size and smallest id."""
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    some = F.exists("embedding", lambda v: v != 0)
    usable = F.col("embedding").isNotNull() & F.col("label").isNotNull()
    usable = F.coalesce(usable & ~F.coalesce(bad, F.lit(True)) & F.coalesce(some, F.lit(False)), F.lit(False))
    rows = vectors.select("vec_id", "label", F.when(usable, F.col("embedding")).alias("embedding"))
    fine = rows.where("embedding is not null")
    reps = fine.groupBy("label", "embedding").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("m"))
    return rows, reps.withColumns({"dim": F.size("embedding"), "rep": F.monotonically_increasing_id()})


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """One row per vector: number of vectors linked to it, its component, whether it is kept."""
    rows, reps = _numbered(vectors)
    reps = materialize(reps)  # classes are known by their number from here on
    release(vectors.sparkSession)
    n = reps.count()
    book = fit(reps, n)

    group = ["label", "dim"]
    held = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(64 * BLOCK) / F.col("dim"))))
    sizes = reps.groupBy(*group).agg(F.count(F.lit(1)).alias("rows")).select(*group, F.ceil(F.col("rows") / held).cast("int").alias("blocks"))
    sizes = materialize(sizes)
    most = sizes.agg(F.max("blocks")).first()[0] or 0
    cut = reps.drop("low").join(sizes, group).withColumn("side", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))

    def turn(k: Column) -> Column:
        """The round in which a row's block meets block ``k``: half as many pairs of blocks as blocks in each."""
        low, high = F.least("side", k), F.greatest("side", k)
        number = F.floor(high * (high + 1) / 2) + low
        return F.floor(number / F.ceil(F.col("blocks") / 2))

    found = []
    for r in range(most + (most + 1) % 2 if most else 0):
        # A row goes to the pair of its block with each block of this round, itself included.
        here = cut.withColumn("with", F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: turn(k) == r)))
        here = here.select("label", "dim", F.least("side", "with").alias("low"), F.greatest("side", "with").alias("high"), "side", "rep", "m", "embedding")
        here = here.repartition(*_BLOCK_KEY).sortWithinPartitions(*_BLOCK_KEY)
        found.append(materialize(here.mapInArrow(_compare(book, threshold), "rep long, links long, other long")))
        release(vectors.sparkSession)
    none = vectors.sparkSession.createDataFrame([], "rep long, links long, other long")
    links = reduce(DataFrame.unionAll, found, none)

    counts = materialize(links.groupBy("rep").agg(F.sum("links").alias("links")))
    joined = components(links.where("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    joined = materialize(joined.join(reps.select(F.col("rep").alias("node"), "low"), "node"))
    names = joined.groupBy("component").agg(F.min("low").alias("name"))
    joined = joined.join(names, "component").select("node", "name")
    classes = reps.select("rep", "low", "m").join(counts, "rep", "left").join(joined, F.col("rep") == F.col("node"), "left")
    # Vectors meet their class by one shuffle of each; all that is known of a class comes after it, by its number.
    classes = materialize(
        classes.select(
            F.col("rep").alias("_rep"),
            (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"),
            F.when(F.col("node").isNull(), F.col("low")).otherwise(F.col("name")).alias("component"),
        )
    )
    discard(*found, counts)
    own = reps.select(F.col("label").alias("_l"), F.col("embedding").alias("_e"), "rep")
    out = rows.join(own, (F.col("label") == F.col("_l")) & (F.col("embedding") == F.col("_e")), "left").select("vec_id", "rep")
    out = out.join(classes, F.col("rep") == F.col("_rep"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )


def query(vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors)
