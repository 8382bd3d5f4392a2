"""Nearest neighbours (Euclidean) by vantage-point trees, one per shard.

Every usable vector is dealt to a shard by a hash of its row number; a shard holds about
``SHARD_VALUES`` components, so the number of shards grows with the table and a task's tree is
bounded. In a tree each inner node has a vantage point; its rows are cut in halves by their
distance to it, and a half keeps the interval of these distances. Query vectors pass each shard
in blocks of ``QUERY_BLOCK``: first down to the leaf on their side, for a radius, then through
every node whose interval may hold something nearer. The triangle inequality gives a lower bound
of the distance to a half; it is skipped if ``factor`` times the bound exceeds the distance of
the k-th neighbour so far. Factor one is exact; a larger one skips more.

A shard returns at most k rows per query, found by distances in double precision; the best k of
all shards are the result, nearest first, ties to the smaller id.

Vectors that are null, empty, zero or hold null or non-finite components take no part. Vectors of
different lengths are no neighbours. Rows with one id are rows of their own, and each is a query
if its id is one. A row with a null id is no query but a candidate, after all others on a tie.
Fewer candidates than k: all of them. An empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import materialize

K = 10
FACTOR = 2.0
EVERY = 100
SHARD_VALUES = 1 << 19
QUERY_BLOCK = 512
LEAF = 64
_CELL = ["dim", "shard", "seeks"]
_LAST = np.iinfo(np.int64).max
_SLACK = 1e-9  # of the sizes involved: rounding of a bound never skips a neighbour


@dataclass
class Node:
    """Rows ``begin:end`` of the tree's order; an inner node has a vantage point and two halves, each with
    the interval of its rows' distances to it."""

    begin: int
    end: int
    point: np.ndarray | None = None
    halves: tuple[tuple[float, float, "Node"], ...] = ()


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows, scaled by a power of two where squares could overflow."""
    apart = q - x
    top = np.abs(apart).max(axis=-1, initial=0.0)
    scale = np.where((top > 1e150) | ((top < 1e-150) & (top > 0)), np.exp2(np.floor(np.log2(np.where(top > 0, top, 1.0)))), 1.0)
    apart = apart / scale[..., None]
    return np.sqrt((apart * apart).sum(axis=-1)) * scale


class Tree:
    """A vantage-point tree over the rows of ``x``; ``rank`` orders rows at equal distance."""

    def __init__(self, x: np.ndarray, seed: int = 0):
        self.order = np.arange(len(x))
        self.x = x
        self._rng = np.random.default_rng(seed)
        self.root = self._build(0, len(x))
        self.x = x[self.order]
        self.square = (self.x * self.x).sum(axis=1)

    def _build(self, begin: int, end: int) -> Node:
        node = Node(begin, end)
        if end - begin <= LEAF:
            return node
        here = self.order[begin:end]
        point = self.x[here[self._rng.integers(len(here))]]
        far = distances(point[None, :], self.x[here])
        half = len(here) // 2
        by = np.argpartition(far, half)
        self.order[begin:end], far = here[by], far[by]
        node.point = point
        middle = begin + half
        node.halves = (
            (far[:half].min(), far[:half].max(), self._build(begin, middle)),
            (far[half:].min(), far[half:].max(), self._build(middle, end)),
        )
        return node

    def search(self, q: np.ndarray, own: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Per query the distances and rows of the k nearest (infinite and -1 where there are fewer), nearest
        first, ties to the smaller row; ``own`` is the query's own row or -1. Also the number of
        (query, row) pairs whose distances were computed."""
        best = np.full((len(q), k), np.inf)
        rows = np.full((len(q), k), -1, dtype=np.int64)
        q_square = (q * q).sum(axis=1)
        home = np.full(len(q), -1, dtype=np.int64)
        seen = 0

        def scan(node: Node, some: np.ndarray) -> None:
            nonlocal seen
            seen += len(some) * (node.end - node.begin)
            x, square = self.x[node.begin : node.end], self.square[node.begin : node.end]
            sizes = q_square[some][:, None] + square[None, :]
            with np.errstate(over="ignore", invalid="ignore"):
                rough = sizes - 2.0 * (q[some] @ x.T)
                hit = ~(rough > best[some, -1][:, None] ** 2 + _SLACK * sizes)  # also where a square overflows
            i, j = np.nonzero(hit)
            row = self.order[node.begin + j]
            keep = row != own[some[i]]
            i, j, row = i[keep], j[keep], row[keep]
            if not len(i):
                return
            near, name = np.full(hit.shape, np.inf), np.full(hit.shape, _LAST)
            near[i, j], name[i, j] = distances(q[some[i]], x[j]), row
            hits = np.unique(i)
            near = np.concatenate([best[some[hits]], near[hits]], axis=1)
            name = np.concatenate([np.where(rows[some[hits]] < 0, _LAST, rows[some[hits]]), name[hits]], axis=1)
            first = np.lexsort((name, near), axis=-1)[:, :k]
            near, name = np.take_along_axis(near, first, 1), np.take_along_axis(name, first, 1)
            best[some[hits]], rows[some[hits]] = near, np.where(np.isinf(near), -1, name)

        def descend(node: Node, some: np.ndarray) -> None:
            if not node.halves:
                home[some] = node.begin
                scan(node, some)
                return
            (_, a, inner), (b, _, outer) = node.halves
            inside = distances(q[some], node.point[None, :]) <= (a + b) / 2
            for child, part in ((inner, some[inside]), (outer, some[~inside])):
                if len(part):
                    descend(child, part)

        def visit(node: Node, some: np.ndarray) -> None:
            if not node.halves:
                some = some[home[some] != node.begin]
                if len(some):
                    scan(node, some)
                return
            d = distances(q[some], node.point[None, :])
            for low, high, child in node.halves:
                bound = np.maximum(low - d, d - high) - _SLACK * (d + high)
                part = some[~(factor * bound > best[some, -1])]
                if len(part):
                    visit(child, part)

        if len(self.x) and len(q):
            everyone = np.arange(len(q))
            descend(self.root, everyone)
            visit(self.root, everyone)
        return best, rows, seen


def usable(vector: Column) -> Column:
    """Not null, not empty, not all zero, and all components there and finite."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    some = F.exists(vector, lambda v: v != 0)
    return F.coalesce(~F.coalesce(bad, F.lit(True)) & F.coalesce(some, F.lit(False)), F.lit(False))


def _matrix(t: pa.Table) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in t["embedding"].chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(t), -1)


def _searched(k: int, factor: float):
    """Reads a partition sorted by cell: a shard's rows, then the query rows that pass it."""

    def answer(tree: Tree, held: pa.Table, t: pa.Table) -> pa.RecordBatch:
        number, asked = held["row"].to_numpy(), t["row"].to_numpy()
        sorter = np.argsort(number)
        at = np.minimum(np.searchsorted(number, asked, sorter=sorter), len(number) - 1)
        own = np.where(number[sorter[at]] == asked, sorter[at], -1)
        near, rows, _ = tree.search(_matrix(t), own, k, factor)
        q, place = np.nonzero(rows >= 0)
        found = rows[q, place]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(asked[q]),
                t["vec_id"].combine_chunks().take(pa.array(q)),
                pa.array(number[found]),
                held["vec_id"].combine_chunks().take(pa.array(found)),
                pa.array(near[q, place]),
            ],
            names=["query", "query_id", "row", "vec_id", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: tuple | None = None
        parts: list[pa.Table] = []
        tree: Tree | None = None
        for batch in batches:
            keys = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in _CELL]
            new = np.zeros(batch.num_rows, dtype=bool)
            for key in keys:
                new[1:] |= key[1:] != key[:-1]
            cuts = np.concatenate([[0], np.flatnonzero(new), [batch.num_rows]]) if batch.num_rows else []
            for begin, end in zip(cuts[:-1], cuts[1:]):
                here, seeks = tuple(key[begin] for key in keys[:2]), keys[2][begin]
                if here != cell:
                    cell, parts, tree = here, [], None
                part = pa.Table.from_batches([batch.slice(begin, end - begin)])
                if not seeks:
                    parts.append(part)
                    continue
                if tree is None:
                    if not parts:
                        continue
                    # Rows in the order of ties: by id, null last, then by number.
                    held, parts = pa.concat_tables(parts).sort_by([("vec_id", "ascending"), ("row", "ascending")]), []
                    tree = Tree(_matrix(held))
                for at in range(0, len(part), QUERY_BLOCK):
                    yield answer(tree, held, part.slice(at, QUERY_BLOCK))

    return run


def neighbours(vectors: DataFrame, is_query: Column, k: int = K, factor: float = FACTOR) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row that ``is_query``, and the row
    numbers ``query`` and ``row``, which tell rows of one id apart."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(usable(F.col("embedding")))
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding", F.size("embedding").alias("dim"), "asks"))
    shards = max(1, -(-int(rows.agg(F.sum(F.col("dim").cast("long"))).first()[0] or 0) // SHARD_VALUES))
    columns = ["row", "vec_id", "embedding", "dim"]
    dealt = rows.select(*columns, F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("seeks"))
    asked = rows.where("asks").select(*columns, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("seeks"))
    laid = dealt.unionAll(asked).repartition("dim", "shard").sortWithinPartitions(*_CELL)
    found = laid.mapInArrow(_searched(k, factor), "query long, query_id long, row long, vec_id long, score double")
    nearest = Window.partitionBy("query").orderBy("score", F.col("vec_id").asc_nulls_last(), "row")
    found = found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "query", "row")


def query(vectors: DataFrame) -> DataFrame:
    """The nearest rows of every row whose id is divisible by ``EVERY``."""
    asks = F.pmod(F.col("vec_id"), F.lit(EVERY)) == 0
    return neighbours(vectors, asks).select("query_id", "rank", "vec_id", "score")
