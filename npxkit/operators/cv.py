"""Coefficients of variation (Q32-Q42).

Every CV is the log-normal CV of log2-scale values, 100 * sqrt(exp((ln 2 * sd)^2) - 1),
with the n-1 standard deviation. ``stddev_samp``/``avg``/``count`` are algebraic, so each
grouping runs with map-side partial aggregation: only one small buffer per group and task
crosses the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import count_rows, keep_at_or_above, lognormal_cv, with_key
from ..functions.stats import group_quantiles

REPLICATE_KEYS = [S.ASSAY_ID, S.BLOCK, S.ASSAY_TYPE, S.PLATE_ID, S.SUBSAMPLE_ID]


# ---------------------------------------------------------------------------
# Sample-control CVs (vendor style)
# ---------------------------------------------------------------------------
def control_intra_cv(df: DataFrame, npx: str = S.NPX) -> DataFrame:
    """Per (assay, plate) over SAMPLE_CONTROL rows: mean NPX and intra-plate CV."""
    return (
        df.where(F.col(S.SAMPLE_TYPE) == S.SAMPLE_CONTROL)
        .groupBy(S.ASSAY_ID, S.PLATE_ID)
        .agg(F.avg(npx).alias("npx_mean"), lognormal_cv(F.stddev_samp(npx)).alias("intra_cv"))
    )


def control_inter_cv(intra: DataFrame) -> DataFrame:
    """Per assay over the plate means of ``control_intra_cv``: inter-plate CV and mean/sd.

    ``mean_over_sd`` is the reciprocal of a plain CV; a zero sd gives NULL (not Inf).
    """
    sd = F.stddev_samp("npx_mean")
    return intra.groupBy(S.ASSAY_ID).agg(
        lognormal_cv(sd).alias("inter_cv"),
        F.try_divide(F.avg("npx_mean"), sd).alias("mean_over_sd"),
    )


def attach_control_cv(df: DataFrame, npx: str = S.NPX) -> DataFrame:
    """All rows with their assay's intra-plate CV (by assay + plate) and inter-plate CV (by assay).

    Inner join: assays without sample controls leave. The CV table has one row per (assay,
    plate), and the inter-plate values are a window over it, so the measurements are scanned
    twice and joined once. The planner broadcasts the table while it is small and AQE switches
    to a shuffled join (with skew splitting) when it is not.
    """
    by_assay = Window.partitionBy(S.ASSAY_ID)
    sd = F.stddev_samp("npx_mean").over(by_assay)
    both = control_intra_cv(df, npx).withColumns(
        {"inter_cv": lognormal_cv(sd), "mean_over_sd": F.try_divide(F.avg("npx_mean").over(by_assay), sd)}
    )
    return df.join(both.drop("npx_mean"), [S.ASSAY_ID, S.PLATE_ID], "inner")


# ---------------------------------------------------------------------------
# Replicate CVs
# ---------------------------------------------------------------------------
def replicate_map(samples: DataFrame, sheet: DataFrame) -> DataFrame:
    """(sample_id -> subsample_id) of biological samples, plus every control sample mapped to its type.

    ``samples`` carries (sample_id, subsample_id) -- the full sample sheet; ``sheet`` carries
    (sample_id, sample_type). Union all, then distinct.
    """
    bio = samples.select(S.SAMPLE_ID, S.SUBSAMPLE_ID)
    controls = sheet.where(F.col(S.SAMPLE_TYPE).contains(S.CONTROL_MARKER)).select(
        S.SAMPLE_ID, F.col(S.SAMPLE_TYPE).alias(S.SUBSAMPLE_ID)
    )
    return bio.unionByName(controls).distinct()


def replicate_intra_cv(
    df: DataFrame,
    mapping: DataFrame,
    npx: str = S.NPX,
    lod: str = S.LOD,
    drop_below_lod: bool = False,
) -> DataFrame:
    """CV of the replicates of each (assay, block, assay type, plate, subsample).

    With ``drop_below_lod`` a value under its LOD, or without a LOD, is left out first.
    A sample mapped to several subsamples counts in each. Groups need at least two
    non-missing values; ``n_replicates`` counts all rows of the group.
    """
    value = keep_at_or_above(npx, lod) if drop_below_lod else F.col(npx)
    keys_in = [S.SAMPLE_ID, S.ASSAY_ID, S.BLOCK, S.ASSAY_TYPE, S.PLATE_ID]
    rows = df.select(*keys_in, value.alias("_x"))
    m = with_key(mapping.select(S.SAMPLE_ID, S.SUBSAMPLE_ID), S.SAMPLE_ID)
    return (
        rows.join(m, S.SAMPLE_ID, "inner")
        .groupBy(*REPLICATE_KEYS)
        .agg(
            F.count("_x").alias("_n_values"),
            lognormal_cv(F.stddev_samp("_x")).alias("intra_cv"),
            count_rows().alias("n_replicates"),
        )
        .where(F.col("_n_values") > 1)
        .drop("_n_values")
    )


def replicate_intra_cv_both(df: DataFrame, mapping: DataFrame, npx: str = S.NPX, lod: str = S.LOD) -> DataFrame:
    """``replicate_intra_cv`` of all values (``intra_cv``) and of the values not below their LOD
    (``intra_cv_lod``, NULL where fewer than two are left), as two aggregates of one grouping."""
    keys_in = [S.SAMPLE_ID, S.ASSAY_ID, S.BLOCK, S.ASSAY_TYPE, S.PLATE_ID]
    rows = df.select(*keys_in, F.col(npx).alias("_x"), keep_at_or_above(npx, lod).alias("_y"))
    return (
        rows.join(with_key(mapping.select(S.SAMPLE_ID, S.SUBSAMPLE_ID), S.SAMPLE_ID), S.SAMPLE_ID, "inner")
        .groupBy(*REPLICATE_KEYS)
        .agg(
            F.count("_x").alias("_n_values"),
            lognormal_cv(F.stddev_samp("_x")).alias("intra_cv"),
            F.when(F.count("_y") > 1, lognormal_cv(F.stddev_samp("_y"))).alias("intra_cv_lod"),
            count_rows().alias("n_replicates"),
        )
        .where(F.col("_n_values") > 1)
        .drop("_n_values")
    )


def replicate_inter_cv(
    df: DataFrame,
    mapping: DataFrame,
    npx: str = S.NPX,
    lod: str = S.LOD,
    drop_below_lod: bool = False,
) -> DataFrame:
    """Inter-plate CV of the replicates of each (assay, block, assay type, subsample): over the
    plate means of its non-missing values, at least two plates. With ``drop_below_lod`` a value
    under its LOD, or without a LOD, is left out first."""
    value = keep_at_or_above(npx, lod) if drop_below_lod else F.col(npx)
    keys_in = [S.SAMPLE_ID, S.ASSAY_ID, S.BLOCK, S.ASSAY_TYPE, S.PLATE_ID]
    rows = df.select(*keys_in, value.alias("_x")).join(with_key(mapping.select(S.SAMPLE_ID, S.SUBSAMPLE_ID), S.SAMPLE_ID), S.SAMPLE_ID, "inner")
    plates = rows.groupBy(*REPLICATE_KEYS).agg(F.avg("_x").alias("_mean"))
    return (
        plates.groupBy(*[k for k in REPLICATE_KEYS if k != S.PLATE_ID])
        .agg(F.count("_mean").alias("n_plates"), lognormal_cv(F.stddev_samp("_mean")).alias("inter_cv"))
        .where(F.col("n_plates") > 1)
    )


def median_cv(cv: DataFrame) -> DataFrame:
    """Median replicate CV per (assay, plate, sample type); only assay type 'assay'.

    The CV table (one row per replicate group) is checkpointed once for the size check and
    the medians.

    The sample type is the subsample id when it names a control type, else SAMPLE. A group
    holds one CV per subsample of one plate; its size is checked before the median.
    """
    sub = F.col(S.SUBSAMPLE_ID)
    typed = cv.where(F.col(S.ASSAY_TYPE) == S.ASSAY_TYPE_ASSAY).withColumn(
        S.SAMPLE_TYPE, F.when(sub.contains(S.CONTROL_MARKER), sub).otherwise(F.lit(S.SAMPLE))
    )
    return group_quantiles(
        typed, [S.ASSAY_ID, S.PLATE_ID, S.SAMPLE_TYPE], [("intra_cv", [0.5], ["intra_cv_median"])], checkpoint_input=True
    )


def cv_quartiles(med: DataFrame) -> DataFrame:
    """Per (plate, sample type): number of assays and the quartiles of their median CVs.

    A group holds one value per assay of the panel.
    """
    return group_quantiles(
        med,
        [S.PLATE_ID, S.SAMPLE_TYPE],
        [("intra_cv_median", [0.25, 0.5, 0.75], ["q1", "q2", "q3"])],
        extra_aggs=[count_rows().alias("n")],
        checkpoint_input=True,
    ).select(S.PLATE_ID, S.SAMPLE_TYPE, "n", "q1", "q2", "q3")


def vendor_cv_coverage(df: DataFrame) -> DataFrame:
    """Per (plate, sample): number of rows with a vendor intra CV and with a vendor inter CV."""
    def n_of(c: str):
        return F.count(c) if c in df.columns else F.lit(0).cast("bigint")

    return df.groupBy(S.PLATE_ID, S.SAMPLE_ID).agg(
        n_of(S.VENDOR_INTRA_CV).alias("n_intra_cv"), n_of(S.VENDOR_INTER_CV).alias("n_inter_cv")
    )


def reconcile_cv(
    cv: DataFrame,
    df: DataFrame,
    tol: float = 1e-5,
    plate: str | None = None,
    vendor_col: str = S.VENDOR_INTRA_CV,
) -> DataFrame:
    """Compare our SAMPLE_CONTROL replicate CVs with the vendor's, per (assay, plate).

    Returns (test, passed, n): ``test`` 'signed' counts ``ours - vendor < tol`` (as the
    reference does -- a much smaller value passes), 'absolute' counts ``|ours - vendor| < tol``.
    ``passed`` is NULL where either value is missing. ``plate`` restricts to one plate.
    """
    ours = cv.where(F.col(S.SUBSAMPLE_ID) == S.SAMPLE_CONTROL).select(
        S.ASSAY_ID, S.PLATE_ID, F.col("intra_cv").alias("new_intra_cv")
    )
    vendor = df.where(F.col(vendor_col).isNotNull()).select(S.ASSAY_ID, S.PLATE_ID, vendor_col).distinct()
    if plate is not None:
        ours = ours.where(F.col(S.PLATE_ID) == plate)
        vendor = vendor.where(F.col(S.PLATE_ID) == plate)
    diff = F.col("new_intra_cv") - F.col(vendor_col)
    j = ours.join(vendor, [S.ASSAY_ID, S.PLATE_ID], "inner").select(
        (diff < F.lit(tol)).alias("signed"), (F.abs(diff) < F.lit(tol)).alias("absolute")
    )
    tests = j.select(
        F.explode(
            F.array(
                F.struct(F.lit("signed").alias("test"), F.col("signed").alias("passed")),
                F.struct(F.lit("absolute").alias("test"), F.col("absolute").alias("passed")),
            )
        ).alias("t")
    ).select("t.test", "t.passed")
    return tests.groupBy("test", "passed").agg(count_rows().alias("n"))


def cv_by_block(df: DataFrame, npx: str = S.NPX) -> DataFrame:
    """Per block: assays with a sample-control CV, mean intra CV, mean inter CV, dilution.

    Intra CVs are per (assay, plate), inter CVs per assay; assays are placed in blocks by
    the measurement table. The dilution comes from the fixed 8-row block table. One scan: the
    blocks of an assay travel with its (assay, plate) aggregate.
    """
    control = F.when(F.col(S.SAMPLE_TYPE) == S.SAMPLE_CONTROL, F.col(npx))
    plates = (
        df.where(F.col(S.ASSAY_TYPE) == S.ASSAY_TYPE_ASSAY)
        .groupBy(S.ASSAY_ID, S.PLATE_ID)
        .agg(
            F.avg(control).alias("npx_mean"),
            lognormal_cv(F.stddev_samp(control)).alias("intra_cv"),
            F.collect_set(S.BLOCK).alias("_blocks"),
        )
    )
    by_assay = Window.partitionBy(S.ASSAY_ID)
    plates = plates.withColumns(
        {
            "inter_cv": lognormal_cv(F.stddev_samp("npx_mean").over(by_assay)),
            "_blocks": F.array_distinct(F.flatten(F.collect_list("_blocks").over(by_assay))),
            "_first": F.row_number().over(by_assay.orderBy(S.PLATE_ID)) == 1,
        }
    )
    placed = plates.withColumn(S.BLOCK, F.explode("_blocks"))
    a = placed.groupBy(S.BLOCK).agg(
        F.countDistinct(F.when(F.col("intra_cv").isNotNull(), F.col(S.ASSAY_ID))).alias("n_assays"),
        F.avg("intra_cv").alias("intra_cv_mean"),
        F.avg(F.when(F.col("_first"), F.col("inter_cv"))).alias("inter_cv_mean"),
    ).where("n_assays > 0")
    spark = df.sparkSession
    dil = F.broadcast(spark.createDataFrame(list(S.BLOCK_DILUTION.items()), f"{S.BLOCK} string, dilution string"))
    return a.join(dil, S.BLOCK, "left")


def median_cv_panel(df: DataFrame, mapping: DataFrame, sample_type: str = S.SAMPLE) -> DataFrame:
    """``median_cv_overall`` from the measurements: the measurements are joined with the replicate
    map and grouped once for both CVs, and both medians of each step are taken together."""
    sub = F.col(S.SUBSAMPLE_ID)
    typed = replicate_intra_cv_both(df, mapping).where(F.col(S.ASSAY_TYPE) == S.ASSAY_TYPE_ASSAY)
    typed = typed.withColumn(S.SAMPLE_TYPE, F.when(sub.contains(S.CONTROL_MARKER), sub).otherwise(F.lit(S.SAMPLE)))
    typed = typed.where(F.col(S.SAMPLE_TYPE) == sample_type)
    both = [("intra_cv", [0.5], ["_all"]), ("intra_cv_lod", [0.5], ["_lod"])]
    med = group_quantiles(typed, [S.ASSAY_ID, S.PLATE_ID, S.SAMPLE_TYPE], both, checkpoint_input=True)
    both = [("_all", [0.5], ["_m_all"]), ("_lod", [0.5], ["_m_lod"])]
    out = group_quantiles(med, [S.SAMPLE_TYPE], both, checkpoint_input=True)
    # One row, of NULLs where there is no such sample type.
    return out.agg(F.max("_m_all").alias("median_cv_all"), F.max("_m_lod").alias("median_cv_lod"))


def median_cv_overall(med_all: DataFrame, med_lod: DataFrame, sample_type: str = S.SAMPLE) -> DataFrame:
    """Median CV of the whole panel with all values and without values below LOD (one row):
    the median over the per-(assay, plate) median CVs of ``sample_type`` (``median_cv``
    output), as the panel-level figures are quoted per assay.

    Both inputs are tagged, unioned and grouped by the tag: one pass, one group per input.
    Each group grows with the study (every assay x plate), so beyond the size bound the
    medians take the distributed exact route. The two-row result is pivoted to one row.
    """
    tagged = med_all.where(F.col(S.SAMPLE_TYPE) == sample_type).select(F.lit("all").alias("_set"), "intra_cv_median")
    tagged = tagged.unionByName(
        med_lod.where(F.col(S.SAMPLE_TYPE) == sample_type).select(F.lit("lod").alias("_set"), "intra_cv_median")
    )
    med = group_quantiles(tagged, ["_set"], [("intra_cv_median", [0.5], ["_m"])], checkpoint_input=True)
    wide = med.groupBy().pivot("_set", ["all", "lod"]).agg(F.max("_m"))
    return wide.select(F.col("all").alias("median_cv_all"), F.col("lod").alias("median_cv_lod"))
