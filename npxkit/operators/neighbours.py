"""Nearest samples (Q57): the table behind a neighbour graph, as an exact k-nearest-neighbour join.

Samples are compared by the Euclidean distance of their imputed NPX vectors. ``PIVOTS`` samples, drawn
by hash, divide the others into cells of the nearest pivot. Of a cell only its number of samples, its
radius and the k smallest distances to its pivot are summarised, a table bounded by pivots and k. From
it follows, for each cell of queries, a distance within which all their neighbours lie; the triangle
inequality through the pivots then tells how far from its pivot a sample of another cell must be to
matter at all. Only such samples visit the cell.

A cell's queries are cut into blocks of at most ``BLOCK`` (and ``BLOCK_VALUES`` numbers), so the rows that
visit grow with the samples times the cells as long as a cell fits a block. A block's candidates stream
past it, those of its own cell first, and it keeps the k best of each query (a bounded heap). Inside it queries
are ordered by their distance to the cell's pivot and compared ``TILE`` at a time with ``TILE`` candidates by one
matrix product. A candidate whose distance to the pivot differs by more than the k-th best from all of a
tile's is passed over; exact distances are computed for pairs that the product leaves in reach, and only
these are ordered. The join's only output is k rows per sample: no table of pairs exists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import count_rows
from ..session import materialize
from .matrix import drop_constant_assays, imputed_vectors

PIVOTS = 64
BLOCK = 1 << 14
BLOCK_VALUES = 1 << 22
TILE = 512
_CELL = ["cell", "block", "turn"]
_SLACK = 1e-9


def _matrix(batch: pa.RecordBatch | pa.Table, name: str = "features") -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    apart = a - b
    return np.sqrt((apart * apart).sum(axis=-1))


def _placed(pivots: np.ndarray):
    """Rows with their distances to all pivots; the nearest one's cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch)
            far = np.column_stack([_distances(x, p) for p in pivots]) if len(x) else np.zeros((0, len(pivots)))
            cell = far.argmin(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell), pa.array(far[np.arange(len(x)), cell]), pa.array(list(far), pa.list_(pa.float64()))],
                names=[*batch.schema.names, "cell", "away", "far"],
            )

    return run


def _limits(pivots: np.ndarray, summary: list, k: int) -> tuple[np.ndarray, dict[int, float]]:
    """``least[i][j]``: a sample of cell j nearer to its pivot than this cannot be among the k nearest of any
    sample of cell i; and the distance that bounds the neighbours of cell i."""
    between = np.array([_distances(pivots, p) for p in pivots])
    least = np.full(between.shape, np.inf)
    within: dict[int, float] = {}
    for i, _, radius, _ in summary:
        # A sample of cell i and the m-th nearest of pivot j are at most this far apart; itself is one of them.
        bounds = sorted(radius + between[i, j] + d for j, _, _, near in summary for d in near)
        theta = bounds[k] if len(bounds) > k else np.inf
        within[i] = theta
        for j, *_ in summary:
            least[i, j] = between[i, j] - radius - theta - _SLACK * (between[i, j] + radius)
    return least, within


def _nearest(k: int):
    """Per block: its queries (turn 0), then the candidates that visit it."""

    def flush(names: np.ndarray, best: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
        q, rank = np.nonzero(np.isfinite(best))
        return pa.RecordBatch.from_arrays(
            [pa.array(names[q].tolist(), pa.string()), pa.array((rank + 1).astype(np.int32)), pa.array(other[q, rank].tolist(), pa.string()), pa.array(best[q, rank])],
            names=[S.SAMPLE_ID, "rank", "neighbour_id", "distance"],
        )

    def closest(near: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of many distances those that may be among a row's k least, ties included."""
        if len(i) <= 4 * k * (i[-1] + 1):
            return near, i, j
        begin = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        wide = np.full((i[-1] + 1, np.diff(np.append(begin, len(i))).max()), np.inf)
        wide[i, np.arange(len(i)) - np.repeat(begin, np.diff(np.append(begin, len(i))))] = near
        if wide.shape[1] <= k:
            return near, i, j
        some = ~(near > np.partition(wide, k - 1, axis=1)[i, k - 1])
        return near[some], i[some], j[some]

    def scan(y: np.ndarray, side: np.ndarray, label: np.ndarray, reach: np.ndarray, names: np.ndarray, x: np.ndarray, own: np.ndarray, away: np.ndarray, best: np.ndarray, other: np.ndarray) -> None:
        """A tile of queries, whose ``best`` and ``other`` are brought up to date, and one of candidates."""
        bound = best[:, -1]
        # By the triangle inequality through the cell's pivot.
        low, high = away.min(), away.max()
        keep = ~(np.maximum(low - reach, reach - high) - _SLACK * (high + reach) > bound.max())
        if not keep.any():
            return
        if not keep.all():
            y, side, label = y[keep], side[keep], label[keep]
        # One product: squared distances, less their rounding and the squared bound.
        own[:, -2] = (1.0 - _SLACK) * own[:, -1] - bound**2
        within = ~((own[:, :-1] @ side.T) > 0.0)
        if not within.any():
            return
        i, j = np.nonzero(within)
        unlike = names[i] != label[j]
        i, j = i[unlike], j[unlike]
        if not len(i):
            return
        near = np.concatenate([_distances(x[i[at : at + 4096]], y[j[at : at + 4096]]) for at in range(0, len(i), 4096)])
        some = ~(near > bound[i])
        near, i, j = near[some], i[some], j[some]
        if not len(i):
            return
        near, i, j = closest(near, i, j)
        rows, first = np.unique(i, return_index=True)
        row = np.concatenate([np.repeat(rows, k), i])
        near, label = np.concatenate([best[rows].ravel(), near]), np.concatenate([other[rows].ravel(), label[j]])
        order = np.lexsort((label, near, row))
        # Each row has k older entries and those from ``first`` on.
        begin = np.arange(len(rows)) * k + first
        order = order[begin[:, None] + np.arange(k)]
        best[rows], other[rows] = near[order], label[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: tuple | None = None
        held: list[pa.Table] = []
        state: tuple | None = None
        best = other = np.zeros((0, k))
        for batch in batches:
            keys = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in _CELL]
            new = np.zeros(batch.num_rows, dtype=bool)
            for key in keys:
                new[1:] |= key[1:] != key[:-1]
            cuts = np.concatenate([[0], np.flatnonzero(new), [batch.num_rows]]) if batch.num_rows else []
            for begin, end in zip(cuts[:-1], cuts[1:]):
                block, turn = (keys[0][begin], keys[1][begin]), keys[2][begin]
                if block != here:
                    if state is not None:
                        yield flush(state[0], best, other)
                    here, held, state = block, [], None
                t = pa.Table.from_batches([batch.slice(begin, end - begin)])
                if turn == 0:
                    held.append(t)
                    continue
                if state is None:
                    if not held:
                        continue
                    q, held = pa.concat_tables(held), []
                    order = np.argsort(q["reach"].to_numpy(), kind="stable")
                    x = _matrix(q)[order]
                    # The column before the last is each tile's to set.
                    own = np.column_stack([-2.0 * x, np.ones(len(x)), np.zeros(len(x)), (x * x).sum(axis=1)])
                    state = (np.array(q["sample_id"].to_pylist(), dtype=str)[order], x, own, q["reach"].to_numpy()[order])
                    best = np.full((len(q), k), np.inf)
                    other = np.full((len(q), k), "", dtype="U1")
                y, label, reach = _matrix(t), np.array(t["sample_id"].to_pylist(), dtype=str), t["reach"].to_numpy()
                side = np.column_stack([y, (1.0 - _SLACK) * (y * y).sum(axis=1), np.ones(len(y))])
                if label.dtype.itemsize > other.dtype.itemsize:
                    other = other.astype(label.dtype)
                for at in range(0, len(t), TILE):
                    some = slice(at, at + TILE)
                    for tile in (slice(b, b + TILE) for b in range(0, len(best), TILE)):
                        scan(y[some], side[some], label[some], reach[some], *(c[tile] for c in state), best[tile], other[tile])
        if state is not None:
            yield flush(state[0], best, other)

    return run


def nearest_vectors(vectors: DataFrame, k: int = 10, pivots: int = PIVOTS) -> DataFrame:
    """(sample_id, rank, neighbour_id, distance): the k nearest other samples of each of ``vectors``
    (sample_id, features), by distance, ties by id. Fewer than k others: all of them."""
    vectors = materialize(vectors.select(S.SAMPLE_ID, "features"))
    drawn = vectors.orderBy(F.xxhash64(S.SAMPLE_ID), S.SAMPLE_ID).limit(pivots).select("features").collect()
    if not drawn:
        return vectors.select(S.SAMPLE_ID, F.lit(1).alias("rank"), F.col(S.SAMPLE_ID).alias("neighbour_id"), F.lit(0.0).alias("distance")).limit(0)
    centre = np.unique(np.array([r["features"] for r in drawn], dtype=float), axis=0)
    placed = materialize(vectors.mapInArrow(_placed(centre), "sample_id string, features array<double>, cell int, away double, far array<double>"))
    nearest = Window.partitionBy("cell").orderBy("away")
    near = placed.select("cell", "away").withColumn("_r", F.row_number().over(nearest)).where(F.col("_r") <= k + 1)
    near = near.groupBy("cell").agg(F.sort_array(F.collect_list("away")).alias("near"))
    cells = placed.groupBy("cell").agg(count_rows().alias("n"), F.max("away").alias("radius"))
    summary = cells.join(near, "cell").select("cell", "n", "radius", "near").collect()  # a row per pivot
    least, _ = _limits(centre, summary, k)

    spark = vectors.sparkSession
    routes = [(int(i), int(j), float(least[i, j])) for i, *_ in summary for j, *_ in summary]
    routes = F.broadcast(spark.createDataFrame(routes, "to int, cell int, least double"))  # pivots squared, at most
    held = max(1, min(BLOCK, BLOCK_VALUES // max(centre.shape[1], 1)))
    blocks = F.broadcast(cells.select(F.col("cell").alias("to"), F.ceil(F.col("n") / F.lit(held)).cast("int").alias("blocks")))
    own = placed.join(blocks, F.col("cell") == F.col("to"))
    asked = own.select("cell", F.pmod(F.xxhash64(S.SAMPLE_ID), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("turn"), F.col("away").alias("reach"), S.SAMPLE_ID, "features")
    visits = placed.join(routes, "cell").where(F.col("away") >= F.col("least")).join(blocks, "to")
    visits = visits.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    turn = F.when(F.col("cell") == F.col("to"), F.lit(1)).otherwise(F.lit(2))
    visits = visits.select(F.col("to").alias("cell"), "block", turn.alias("turn"), F.element_at("far", F.col("to") + 1).alias("reach"), S.SAMPLE_ID, "features")
    laid = asked.unionAll(visits).repartition("cell", "block").sortWithinPartitions(*_CELL)
    return laid.mapInArrow(_nearest(k), "sample_id string, rank int, neighbour_id string, distance double")


def sample_neighbours(df: DataFrame, k: int = 10, npx: str = S.NPX, drop_constant: bool = True, check: bool = True) -> DataFrame:
    """The k nearest samples of each sample, by the NPX of all assays (constant plate x assay groups dropped,
    missing cells at the assay's median, as for the PCA). A sample without any value has no vector:
    it is in no row. Duplicate (sample, assay) pairs raise ``IntegrityError``."""
    data = drop_constant_assays(df, npx) if drop_constant else df
    return nearest_vectors(imputed_vectors(data, npx, check), k)
