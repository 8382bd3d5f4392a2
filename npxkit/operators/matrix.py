"""Sample x assay matrices and median imputation (Q50-Q53).

No wide table is built for the large path: a sample's values travel as one array (one
entry per assay of the panel, so bounded by the panel), the form in which PCA and nearest samples read it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.columns import count_rows
from ..functions.stats import group_quantiles
from ..session import materialize
from .qc import IntegrityError, duplicate_samples

def drop_constant_assays(df: DataFrame, npx: str = S.NPX) -> DataFrame:
    """Rows whose (assay, plate) has a positive NPX variance; zero or undefined (one value)
    variance drops the plate x assay. Partial aggregate + left-semi join."""
    var = df.groupBy(S.ASSAY_ID, S.PLATE_ID).agg(F.var_samp(npx).alias("_var")).where(F.col("_var") > 0)
    return df.join(var.select(S.ASSAY_ID, S.PLATE_ID), [S.ASSAY_ID, S.PLATE_ID], "left_semi")


def _values(df: DataFrame, npx: str) -> DataFrame:
    return df.select(S.SAMPLE_ID, S.ASSAY_ID, F.col(npx).alias("_v")).where(F.col("_v").isNotNull())


def _check_unique(vals: DataFrame) -> None:
    dup = duplicate_samples(vals).limit(1).count()
    if dup:
        raise IntegrityError("duplicate (sample, assay) pairs: a matrix cell would hold several values")


def _matrix_checks(vals: DataFrame, check_unique: bool) -> int:
    """One job over the (sample, assay) pairs: duplicate cells, and the largest number of samples
    of an assay (the group size of the assay medians)."""
    pairs = vals.groupBy(S.SAMPLE_ID, S.ASSAY_ID).agg(count_rows().alias("_n"))
    per_assay = pairs.groupBy(S.ASSAY_ID).agg(count_rows().alias("_samples"), F.max("_n").alias("_dup"))
    r = per_assay.agg(F.max("_samples").alias("samples"), F.max("_dup").alias("dup")).first()
    if check_unique and (r["dup"] or 0) > 1:
        raise IntegrityError("duplicate (sample, assay) pairs: a matrix cell would hold several values")
    return int(r["samples"] or 0)


def assay_list(vals: DataFrame) -> list[str]:
    """Sorted distinct assay ids: the names of the columns of a matrix."""
    return [r[0] for r in vals.select(S.ASSAY_ID).distinct().orderBy(S.ASSAY_ID).toLocalIterator()]


def wide_matrix(df: DataFrame, assays: list[str] | None = None, npx: str = S.NPX, check: bool = True) -> DataFrame:
    """Sample rows, one column per assay (sorted ids), from the non-missing values.

    A sample's values are gathered once, with their places in the panel, and a task lays them out as
    columns of whole batches: the plan has no expression per assay, so a panel of thousands is as
    good as one of ten. Values of assays outside a given list are left out, as a pivot does.
    Duplicate (sample, assay) pairs raise ``IntegrityError``.
    """
    vals = _values(df, npx)
    if check:
        _check_unique(vals)
    assays = assays if assays is not None else assay_list(vals)
    kind = vals.schema["_v"].dataType
    place = df.sparkSession.createDataFrame([(a, i) for i, a in enumerate(assays)], f"{S.ASSAY_ID} string, _place int")
    # The panel's list is bounded by the panel; the left side keeps samples without a listed assay.
    cells = vals.join(F.broadcast(place), S.ASSAY_ID, "left").groupBy(S.SAMPLE_ID)
    cells = cells.agg(F.collect_list(F.when(F.col("_place").isNotNull(), F.struct("_place", F.col("_v").cast("double").alias("_v")))).alias("_cells"))
    fields = [T.StructField(S.SAMPLE_ID, T.StringType()), *(T.StructField(a, T.DoubleType()) for a in assays)]
    wide = cells.mapInArrow(_laid_out(assays), T.StructType(fields))
    return wide if kind == T.DoubleType() else wide.select(S.SAMPLE_ID, *[F.col(f"`{a}`").cast(kind).alias(a) for a in assays])


def _laid_out(assays: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 22) // max(len(assays), 1))
        for batch in batches:
            for begin in range(0, batch.num_rows, step):
                some = batch.slice(begin, step)
                lists = some.column(1)
                flat = lists.flatten()
                row = np.repeat(np.arange(some.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                at = flat.field("_place").to_numpy(zero_copy_only=False)
                # An assay's largest value, where an unchecked cell holds several.
                dense = np.full((len(assays), some.num_rows), -np.inf)
                seen = np.zeros(dense.shape, dtype=bool)
                np.maximum.at(dense, (at, row), flat.field("_v").to_numpy(zero_copy_only=False))
                seen[at, row] = True
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), *(pa.array(v, mask=~s) for v, s in zip(dense, seen))], names=[S.SAMPLE_ID, *assays]
                )

    return run


def assay_medians(df: DataFrame, npx: str = S.NPX, known_max_group: int | None = None) -> DataFrame:
    """Median of each assay over all samples with a value. The group grows with the samples,
    so the size-checked ``group_quantiles`` switches to the distributed exact route."""
    return group_quantiles(
        _values(df, npx), [S.ASSAY_ID], [("_v", [0.5], ["median"])], known_max_group=known_max_group
    ).select(S.ASSAY_ID, "median")


def impute_median(df: DataFrame, npx: str = S.NPX, check: bool = True) -> DataFrame:
    """Long form of the imputed matrix: (sample_id, assay_id, npx_imputed) for every sample
    with a value and every assay with a value; a missing cell holds the assay's median.

    A sample's missing assays are the panel's list (a scalar subquery over the medians) less its
    own, a hash difference that is linear in the panel; they are joined with the medians by
    assay, and the observed rows are added. Nothing of the panel passes through the driver.
    """
    vals = _values(df, npx)
    med = materialize(assay_medians(df, npx, known_max_group=_matrix_checks(vals, check)))
    panel = med.agg(F.collect_list(S.ASSAY_ID).alias("ids"))
    own = vals.groupBy(S.SAMPLE_ID).agg(F.collect_list(S.ASSAY_ID).alias("_own"))
    missing = own.select(S.SAMPLE_ID, F.explode(F.array_except(panel.scalar(), "_own")).alias(S.ASSAY_ID))
    filled = missing.join(med, S.ASSAY_ID).select(S.SAMPLE_ID, S.ASSAY_ID, F.col("median").cast("double").alias("npx_imputed"))
    return vals.select(S.SAMPLE_ID, S.ASSAY_ID, F.col("_v").alias("npx_imputed")).unionByName(filled)


def imputed_vectors(df: DataFrame, npx: str = S.NPX, check: bool = True) -> DataFrame:
    """(sample_id, features) with one entry per assay in sorted id order; a missing cell
    holds the assay's median. Samples without any value are absent. A sample's values are
    gathered into one array (bounded by the panel)."""
    cells = F.sort_array(F.collect_list(F.struct(S.ASSAY_ID, "npx_imputed")))
    rows = impute_median(df, npx, check).groupBy(S.SAMPLE_ID).agg(cells.alias("_cells"))
    return rows.select(S.SAMPLE_ID, F.transform("_cells", lambda c: c["npx_imputed"]).alias("features"))


def align_metadata(samples: DataFrame, meta: DataFrame, check: bool = True) -> DataFrame:
    """Metadata for each matrix sample (a left join: unknown samples get NULLs).

    A sample id repeated in ``meta`` raises ``IntegrityError``.
    """
    if check:
        dup = meta.groupBy(S.SAMPLE_ID).agg(count_rows().alias("_n")).where(F.col("_n") > 1).limit(1).count()
        if dup:
            raise IntegrityError("sample ids repeat in the metadata")
    return samples.select(S.SAMPLE_ID).join(meta, S.SAMPLE_ID, "left")
