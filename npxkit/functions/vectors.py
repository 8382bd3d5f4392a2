"""Element-wise sums of arrays by group, streamed: Spark's aggregates have no such sum."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def _added(keys: Sequence[str], column: str):
    """Sums of the arrays of each key, of a partition sorted by key; one array is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        total = np.zeros(0)
        schema: pa.Schema | None = None

        def out() -> pa.RecordBatch:
            cells = [pa.array([v], schema.field(k).type) for k, v in zip(keys, last)]
            return pa.RecordBatch.from_arrays([*cells, pa.array([total], pa.list_(pa.float64()))], names=[*keys, column])

        for batch in batches:
            schema = batch.schema
            names = [batch.column(schema.get_field_index(k)).to_pylist() for k in keys]
            for *here, row in zip(*names, batch.column(schema.get_field_index(column))):
                row = row.values.to_numpy(zero_copy_only=False)
                if tuple(here) != last:
                    if last is not None:
                        yield out()
                    last, total = tuple(here), row.copy()
                else:
                    total += row
        if last is not None:
            yield out()

    return run


def sum_vectors(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """One row per key with the element-wise sum of its arrays (of equal length, none null). NULL keys are
    a group. Only the arrays given are shuffled, so sum them per task first."""
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", `{column}` array<double>"
    laid = df.select(*keys, column).repartition(*keys).sortWithinPartitions(*keys)
    return laid.mapInArrow(_added(keys, column), schema)
