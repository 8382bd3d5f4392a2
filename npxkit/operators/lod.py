"""Limit of detection: appending, estimating, recoding and summarising (Q24-Q31)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import count_rows, keep_at_or_above, share_true
from ..functions.stats import group_quantiles
from .normalize import PLATE_ASSAY, one_row_per_key, with_plate_medians


class NotEnoughControls(ValueError):
    """Fewer negative controls pass SampleQC than the LOD estimate needs."""


def append_fixed_lod(df: DataFrame, fixed: DataFrame, value: str = S.EXT_NPX, check: bool = True) -> DataFrame:
    """Add ``pc_lod`` (the fixed value, on the plate-control scale) and ``lod`` (intensity scale).

    ``fixed`` holds (assay_id, data_analysis_ref_id, pc_lod). On the intensity scale the
    same ExtNPX threshold sits at pc_lod + pc_median - sample_median of the plate x assay.
    Rows without a fixed value get NULL in both. The fixed table has one row per assay and
    reference id (a repeated one fails the job that reads it), so the planner broadcasts it.
    """
    fixed = one_row_per_key(fixed, [S.ASSAY_ID, S.DAR_ID], S.PC_LOD, "the fixed-LOD table") if check else fixed
    base = with_plate_medians(df.drop(S.LOD, S.PC_LOD), value)
    shifted = base.join(fixed.select(S.ASSAY_ID, S.DAR_ID, S.PC_LOD), [S.ASSAY_ID, S.DAR_ID], "left")
    return shifted.withColumn(S.LOD, F.col(S.PC_LOD) + F.col("pc_median") - F.col("sample_median")).drop(
        "pc_median", "sample_median"
    )


def nc_lod(
    df: DataFrame,
    min_controls: int = 10,
    npx: str = S.NPX,
    check: bool = True,
    low_count: float | None = None,
    count_margin: float = 2.0,
) -> DataFrame:
    """LOD per assay from the negative controls that pass SampleQC: median + max(3 sd, 0.2).

    With ``low_count``, assays whose negative controls' median count is below it get a LOD from
    counts instead: ``count_margin`` times the larger of that median and one count, brought to the
    NPX scale by the median count of the extension controls of the negative controls' blocks
    (log2 of the ratio). Neither number is published, so both are parameters, and the branch is
    off by default.

    Raises ``NotEnoughControls`` when fewer than ``min_controls`` distinct such controls
    exist (one small aggregate is run for the check). The median runs over every control
    of the study, a group that grows with the data, so it goes through the size-checked
    ``group_quantiles``. An assay with a single value has no sd and gets NULL.
    """
    nc = df.where((F.col(S.SAMPLE_TYPE) == S.NEGATIVE_CONTROL) & (F.col(S.SAMPLE_QC) == S.QC_PASS))
    if check:
        n = nc.agg(F.countDistinct(S.SAMPLE_ID)).first()[0]
        if n < min_controls:
            raise NotEnoughControls(f"{n} negative controls pass SampleQC; at least {min_controls} are needed")
    stats = group_quantiles(
        nc.select(S.ASSAY_ID, npx),
        [S.ASSAY_ID],
        [(npx, [0.5], ["nc_median"])],
        extra_aggs=[count_rows().alias("n_rows"), F.count(npx).alias("n_values"), F.stddev_samp(npx).alias("nc_sd")],
    )
    sd = F.col("nc_sd")
    stats = stats.withColumn(
        S.LOD, F.when(sd.isNotNull(), F.col("nc_median") + F.greatest(F.lit(3.0) * sd, F.lit(0.2)))
    )
    if low_count is None:
        return stats
    from .normalize import extension_counts

    counts = nc.select(S.ASSAY_ID, S.SAMPLE_ID, S.BLOCK, F.col(S.COUNT).cast("double").alias("_c"))
    counts = counts.join(extension_counts(nc), [S.SAMPLE_ID, S.BLOCK], "left")
    medians = group_quantiles(
        counts.select(S.ASSAY_ID, "_c", F.col("_ext_count").cast("double").alias("_e")),
        [S.ASSAY_ID],
        [("_c", [0.5], ["nc_median_count"]), ("_e", [0.5], ["_ext"])],
    )
    margin = F.lit(float(count_margin)) * F.greatest(F.col("nc_median_count"), F.lit(1.0))
    by_count = F.log2(F.try_divide(margin, F.col("_ext")))
    few = F.col("nc_median_count") < F.lit(float(low_count))
    out = stats.join(medians.select(S.ASSAY_ID, "nc_median_count", "_ext"), S.ASSAY_ID, "left")
    return out.withColumn(S.LOD, F.when(few, by_count).otherwise(F.col(S.LOD))).drop("_ext")


def below_lod_to_null(df: DataFrame, npx: str = S.NPX, lod: str = S.LOD) -> DataFrame:
    """NPX below its LOD, or without a LOD, becomes NULL."""
    return df.withColumn(npx, keep_at_or_above(npx, lod))


def below_lod_to_half(df: DataFrame, npx: str = S.NPX, lod: str = S.LOD) -> DataFrame:
    """NPX below its LOD becomes LOD/2; values without a LOD stay as they are."""
    return df.withColumn(npx, F.when(F.col(npx) < F.col(lod), F.col(lod) / F.lit(2.0)).otherwise(F.col(npx)))


def recode_low_quality(df: DataFrame, npx: str = S.NPX, lod: str = S.LOD) -> DataFrame:
    """Missingness recode: (1) NPX < LOD (or no LOD) -> NULL; (2) a plate x assay with more
    than half of its rows NULL -> all NULL; (3) an assay with more than half of its rows
    NULL after (2) -> all NULL; (4) assays with no value left are dropped.

    Shares count every row, controls included, and compare exact counts (2 * nulls > rows).
    Step (3) needs only the per-(plate, assay) counts of step (2), so the data is aggregated
    once (partial aggregation: two counters per group), summed by a window over that small table
    (one row per plate of an assay), and joined back once: two scans.
    """
    x1 = keep_at_or_above(npx, lod)
    pa = df.groupBy(*PLATE_ASSAY).agg(count_rows().alias("_rows"), F.count(x1).alias("_vals"))
    pa = pa.withColumn("_plate_bad", F.lit(2) * (F.col("_rows") - F.col("_vals")) > F.col("_rows"))
    nulls2 = F.when(F.col("_plate_bad"), F.col("_rows")).otherwise(F.col("_rows") - F.col("_vals"))
    by_assay = Window.partitionBy(S.ASSAY_ID)
    assay_bad = F.lit(2) * F.sum(nulls2).over(by_assay) > F.sum("_rows").over(by_assay)
    flags = pa.select(*PLATE_ASSAY, "_plate_bad", assay_bad.alias("_assay_bad"))
    return (
        df.join(flags, PLATE_ASSAY, "inner")
        .where(~F.col("_assay_bad"))
        .withColumn(npx, F.when(~F.col("_plate_bad"), x1))
        .drop("_plate_bad", "_assay_bad")
    )


def below_lod_per_sample(df: DataFrame, npx: str = S.NPX, lod: str = S.LOD) -> DataFrame:
    """Per (sample, type, plate), assays of type 'assay': rows below LOD, rows, non-missing values."""
    return (
        df.where(F.col(S.ASSAY_TYPE) == S.ASSAY_TYPE_ASSAY)
        .groupBy(S.SAMPLE_ID, S.SAMPLE_TYPE, S.PLATE_ID)
        .agg(
            F.count_if(F.col(npx) < F.col(lod)).alias("n_below_lod"),
            count_rows().alias("total_assays"),
            F.count(npx).alias("non_nas"),
        )
    )


def below_lod_per_plate(per_sample: DataFrame) -> DataFrame:
    """Per plate: totals of the first sample (by sample id, then type) and the quartiles of
    the below-LOD counts over the plate's samples (size-checked quantiles)."""
    first_key = F.struct(S.SAMPLE_ID, S.SAMPLE_TYPE)
    return group_quantiles(
        per_sample,
        [S.PLATE_ID],
        [("n_below_lod", [0.25, 0.5, 0.75], ["q1", "median_below_lod", "q3"])],
        extra_aggs=[
            F.min_by("total_assays", first_key).alias("total"),
            F.min_by("non_nas", first_key).alias("non_na"),
        ],
        checkpoint_input=True,
    ).select(S.PLATE_ID, "total", "non_na", "q1", "median_below_lod", "q3")


def percent_above_lod(df: DataFrame, by: list[str] | None = None, npx: str = S.NPX, lod: str = S.LOD) -> DataFrame:
    """Share of SAMPLE rows with NPX > LOD per ``by`` (default assay x plate); comparisons
    with a missing side are left out; NULL when none is left."""
    by = by or [S.ASSAY_ID, S.PLATE_ID]
    return (
        df.where(F.col(S.SAMPLE_TYPE) == S.SAMPLE)
        .groupBy(*by)
        .agg(share_true(F.col(npx) > F.col(lod)).alias("perc_gt_lod"))
    )
