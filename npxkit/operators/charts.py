"""The numbers behind the reference's charts (Q43-Q48); no drawing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import count_rows
from ..functions.stats import GAUSS_NORM, attach_quantiles, group_quantiles, nrd0_bandwidth
from ..functions.vectors import sum_vectors
from ..session import materialize


def cv_histogram(df: DataFrame, cv: str = "intra_cv", width: float = 0.5, npx: str = S.NPX, lod: str = S.LOD) -> DataFrame:
    """Counts of non-missing CVs per block x (NPX > LOD) x bin.

    Bins are centred on multiples of ``width`` and closed on the right: a value x falls in
    the bin centred at ceil((x - width/2) / width) * width. Every measurement row counts.
    """
    k = F.ceil((F.col(cv) - F.lit(width / 2.0)) / F.lit(width)).cast("bigint")
    return (
        df.where(F.col(cv).isNotNull())
        .select(S.BLOCK, (F.col(npx) > F.col(lod)).alias("above_lod"), (k.cast("double") * F.lit(width)).alias("bin_center"))
        .groupBy(S.BLOCK, "above_lod", "bin_center")
        .agg(count_rows().alias("n"))
    )


def cv_density(med: DataFrame, cap: float = 50.0, points: int = 512, value: str = "intra_cv_median") -> DataFrame:
    """Gaussian kernel density of median CVs (capped at ``cap``) per (sample type, plate).

    One grid of ``points`` values from the global minimum to the global maximum is shared
    by all groups; the bandwidth is R's bw.nrd0 per group; groups with fewer than two
    values are left out. The density is the exact kernel sum: a task adds its values' kernels at
    every grid point to one array per group, and only these arrays are shuffled and added, one
    row per group and task. The grid size is a fixed parameter, so the work is values x points.
    """
    keys = [S.SAMPLE_TYPE, S.PLATE_ID]
    # The capped values (one per assay x plate x type) feed three jobs -- grid bounds,
    # bandwidths and kernel sums -- so they are written once to the checkpoint folder.
    x = materialize(med.select(*keys, F.least(F.col(value), F.lit(cap)).alias("_x")).where(F.col("_x").isNotNull()))
    stats = (
        group_quantiles(
            x,
            keys,
            [("_x", [0.25, 0.75], ["_q1", "_q3"])],
            extra_aggs=[count_rows().alias("_n"), F.stddev_samp("_x").alias("_sd"), F.abs(F.min("_x")).alias("_first_abs")],
        )
        .where(F.col("_n") >= 2)
        .withColumn("_bw", nrd0_bandwidth(F.col("_n"), F.col("_sd"), F.col("_q3") - F.col("_q1"), F.col("_first_abs")))
    )
    # The shared grid needs two scalars (global min and max): one small aggregate.
    lo, hi = x.agg(F.min("_x"), F.max("_x")).first()
    if lo is None:
        return stats.select(*keys, F.lit(None).cast("bigint").alias("grid_index"), F.lit(None).cast("double").alias("x"),
                            F.lit(None).cast("double").alias("density")).limit(0)
    step = (hi - lo) / float(points - 1)
    # Each value joins its group's n and bandwidth (one row per group).
    terms = x.join(stats.select(*keys, "_n", "_bw"), keys).select(*keys, "_n", "_bw", "_x")
    kinds = dict(terms.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*keys, "_n", "_bw")) + ", _sum array<double>"
    sums = sum_vectors(terms.mapInArrow(_kernel_sums([*keys, "_n", "_bw"], lo + step * np.arange(points)), schema), [*keys, "_n", "_bw"], "_sum")
    return sums.select(*keys, "_n", "_bw", F.posexplode("_sum").alias("_i", "_k")).select(
        *keys,
        F.col("_i").cast("bigint").alias("grid_index"),
        (F.lit(lo) + F.col("_i").cast("double") * F.lit(step)).alias("x"),
        (F.col("_k") * F.lit(GAUSS_NORM) / (F.col("_n").cast("double") * F.col("_bw"))).alias("density"),
    )


_HELD_GROUPS = 4096


def _kernel_sums(keys: list[str], grid: np.ndarray):
    """Per task and group the kernels of its values, summed at every point of the grid."""

    def out(held: dict[tuple, np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
        cells = [pa.array([k[i] for k in held], schema.field(name).type) for i, name in enumerate(keys)]
        return pa.RecordBatch.from_arrays([*cells, pa.array(list(held.values()), pa.list_(pa.float64()))], names=[*keys, "_sum"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        schema: pa.Schema | None = None
        for batch in batches:
            schema = batch.schema
            x = batch.column(schema.get_field_index("_x")).to_numpy(zero_copy_only=False)
            width = batch.column(schema.get_field_index("_bw")).to_numpy(zero_copy_only=False)
            own: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(batch.column(schema.get_field_index(k)).to_pylist() for k in keys))):
                own.setdefault(key, []).append(i)
            for key, rows in own.items():
                total = held.setdefault(key, np.zeros(len(grid)))
                for begin in range(0, len(rows), 1024):
                    at = rows[begin : begin + 1024]
                    total += np.exp(-0.5 * ((grid[None, :] - x[at, None]) / width[at, None]) ** 2).sum(axis=0)
            if len(held) > _HELD_GROUPS:
                yield out(held, schema)
                held = {}
        if held:
            yield out(held, schema)

    return run


def cv_vs_detectability(pct: DataFrame, med: DataFrame) -> DataFrame:
    """Share above LOD per (assay, plate) joined with the SAMPLE median CVs on (assay, plate)."""
    return pct.join(med.where(F.col(S.SAMPLE_TYPE) == S.SAMPLE), [S.ASSAY_ID, S.PLATE_ID], "inner")


def cv_detectability_fit(points: DataFrame) -> DataFrame:
    """Per plate: least-squares line of log10(median CV) on the share above LOD (points with
    a positive CV and a share), its R^2, and Pearson r of the CV with the share."""
    y = F.log10(F.col("intra_cv_median"))
    fit = points.where((F.col("intra_cv_median") > 0) & F.col("perc_gt_lod").isNotNull())
    return fit.groupBy(S.PLATE_ID).agg(
        count_rows().alias("n_points"),
        F.regr_slope(y, F.col("perc_gt_lod")).alias("slope"),
        F.regr_intercept(y, F.col("perc_gt_lod")).alias("intercept"),
        F.regr_r2(y, F.col("perc_gt_lod")).alias("r2"),
        F.corr("intra_cv_median", "perc_gt_lod").alias("pearson_r"),
    )


def npx_boxplot(df: DataFrame, npx: str = S.NPX, colour: str = S.SAMPLE_QC) -> DataFrame:
    """Box statistics per (sample, block, plate, colour): quartiles, whiskers at the most
    extreme values within 1.5 IQR of the box, number of outliers. Missing values are left
    out; boxes without values are dropped.

    The quartiles of each box are attached to its values (a window over the box when the
    boxes are within the size bound), and whiskers and outliers are an aggregation by the
    same keys, so the rows are shuffled once.
    """
    keys = [S.SAMPLE_ID, S.BLOCK, S.PLATE_ID, colour]
    rows = df.select(*keys, F.col(npx).alias("_v")).where(F.col("_v").isNotNull())
    rows = attach_quantiles(rows, keys, [("_v", [0.25, 0.5, 0.75], ["_q1", "_q2", "_q3"])])
    q1, q3 = F.col("_q1"), F.col("_q3")
    lo_fence, hi_fence = q1 - F.lit(1.5) * (q3 - q1), q3 + F.lit(1.5) * (q3 - q1)
    v = F.col("_v")
    return rows.groupBy(*keys).agg(
        count_rows().alias("n"),
        F.max(q1).alias("q1"),
        F.max("_q2").alias("median"),
        F.max(q3).alias("q3"),
        F.min(F.when(v >= lo_fence, v)).alias("whisker_low"),
        F.max(F.when(v <= hi_fence, v)).alias("whisker_high"),
        F.count_if((v < lo_fence) | (v > hi_fence)).alias("n_outliers"),
    )


def heatmap_matrix(df: DataFrame, npx: str = S.NPX) -> DataFrame:
    """Long z-scores per assay (centre and scale over all samples) for the heat map.

    Assays excluded by AssayQC ("NA") are removed; failed samples already carry NULL NPX.
    Row label: sample type; column label: block. The per-assay mean/sd come from a partial
    aggregate with one row per assay (bounded by the panel) joined back.
    """
    keep = df.where(F.coalesce(F.col(S.ASSAY_QC), F.lit("")) != S.QC_NA)
    stats = keep.groupBy(S.ASSAY_ID).agg(F.avg(npx).alias("_mean"), F.stddev_samp(npx).alias("_sd"))
    return keep.join(stats, S.ASSAY_ID).select(
        S.SAMPLE_ID,
        S.ASSAY_ID,
        S.SAMPLE_TYPE,
        S.BLOCK,
        F.try_divide(F.col(npx) - F.col("_mean"), F.col("_sd")).alias("z"),
    )
