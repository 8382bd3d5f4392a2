"""Extension-control ratio and plate-control / intensity normalisation (Q19-Q23)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import count_rows, is_in
from ..functions.stats import attach_quantiles, group_quantiles
from .qc import IntegrityError

PLATE_ASSAY = [S.PLATE_ID, S.ASSAY_ID]


def ext_npx(df: DataFrame, count: str = S.COUNT, out: str = "ext_npx_calc") -> DataFrame:
    """log2(Count / Count of the extension control of the same sample and block).

    Every block has one extension control. Its count comes from a partial aggregate with
    one row per (sample, block), joined back: a hot sample is split by AQE's skew join
    instead of landing in one window partition.
    """
    ext = extension_counts(df, count)
    j = df.join(ext, [S.SAMPLE_ID, S.BLOCK], "left")
    return j.withColumn(out, F.log2(F.try_divide(F.col(count).cast("double"), F.col("_ext_count")))).drop("_ext_count")


def extension_counts(df: DataFrame, count: str = S.COUNT) -> DataFrame:
    """Count of the extension control per (sample, block) (the largest if it repeats)."""
    return (
        df.where(F.col(S.ASSAY_TYPE) == S.EXT_CTRL)
        .groupBy(S.SAMPLE_ID, S.BLOCK)
        .agg(F.max(count).alias("_ext_count"))
    )


def _median_specs(value: str) -> list:
    t = F.col(S.SAMPLE_TYPE)
    return [
        (F.when(t == S.PLATE_CONTROL, F.col(value)), [0.5], ["pc_median"]),
        (F.when(t == S.SAMPLE, F.col(value)), [0.5], ["sample_median"]),
    ]


def plate_medians(df: DataFrame, value: str = S.EXT_NPX) -> DataFrame:
    """Per (plate, assay): median ExtNPX of the plate controls and of the samples.

    All rows count, QC-failed ones too. The group size is checked before the medians
    (``group_quantiles``).
    """
    return group_quantiles(df.select(*PLATE_ASSAY, S.SAMPLE_TYPE, value), PLATE_ASSAY, _median_specs(value))


def with_plate_medians(df: DataFrame, value: str = S.EXT_NPX) -> DataFrame:
    """All rows with ``pc_median`` and ``sample_median`` of their (plate, assay).

    A grouped mutate: when every plate x assay is within the size bound it is one window
    pass (one shuffle, no join); otherwise the medians come from the distributed route
    and are joined back.
    """
    return attach_quantiles(df, PLATE_ASSAY, _median_specs(value))


def normalize(df: DataFrame, value: str = S.EXT_NPX) -> DataFrame:
    """All rows with pc_median, sample_median, npx_pc = ExtNPX - pc_median and
    npx_intensity = ExtNPX - sample_median; both NULL for SampleQC FAIL or "NA".

    A plate without plate controls gets NULL PC values.
    """
    failed = is_in(S.SAMPLE_QC, [S.QC_FAIL, S.QC_NA])
    x = F.col(value)
    return (
        with_plate_medians(df, value)
        .withColumn("npx_pc", F.when(~failed, x - F.col("pc_median")))
        .withColumn("npx_intensity", F.when(~failed, x - F.col("sample_median")))
    )


def one_row_per_key(side: DataFrame, keys: list[str], value: str, what: str) -> DataFrame:
    """(keys, value) of a side table. A repeated key, which would repeat measurements, fails the job that
    reads it: the check is part of the plan, so nothing runs when the operator is called."""
    message = F.lit(f"{what} repeats a key ({', '.join(keys)})")
    rows = side.groupBy(*keys).agg(count_rows().alias("_rows"), F.max(value).alias("_value"))
    return rows.select(*keys, F.when(F.col("_rows") == 1, F.col("_value")).otherwise(F.raise_error(message)).alias(value))


def normalize_pc_with_lot_factor(df: DataFrame, lots: DataFrame, value: str = S.EXT_NPX, check: bool = True) -> DataFrame:
    """npx_pc_lot = ExtNPX - median(plate-control ExtNPX) - lot factor of the assay.

    ``lots`` holds (assay_id, pc_lot_factor), one row per assay; an assay without a factor
    is not adjusted (factor 0), a repeated assay fails the job. QC-failed rows give
    NULL as in ``normalize``.
    """
    lots = one_row_per_key(lots, [S.ASSAY_ID], "pc_lot_factor", "the lot-factor table") if check else lots
    failed = is_in(S.SAMPLE_QC, [S.QC_FAIL, S.QC_NA])
    n = normalize(df, value).join(lots.select(S.ASSAY_ID, "pc_lot_factor"), S.ASSAY_ID, "left")
    lf = F.coalesce(F.col("pc_lot_factor"), F.lit(0.0))
    return n.withColumn("npx_pc_lot", F.when(~failed, F.col(value) - F.col("pc_median") - lf))


def choose_npx(normalized: DataFrame, kind: str = "intensity", mark_excluded: bool = True) -> DataFrame:
    """Fill the delivered columns from ``normalize`` output: NPX holds the chosen kind,
    PCNormalizedNPX always the plate-control values, Normalization names the kind.

    With ``mark_excluded`` rows of excluded assays (type 'assay' with AssayQC "NA") are
    labelled EXCLUDED and carry no NPX.
    """
    if kind not in ("intensity", "plate_control"):
        raise ValueError("kind must be 'intensity' or 'plate_control'")
    chosen = "npx_intensity" if kind == "intensity" else "npx_pc"
    label = "Intensity" if kind == "intensity" else "Plate control"
    excluded = (
        (F.col(S.ASSAY_TYPE) == S.ASSAY_TYPE_ASSAY) & (F.col(S.ASSAY_QC) == S.QC_NA) if mark_excluded else F.lit(False)
    )
    excluded = F.coalesce(excluded, F.lit(False))
    return normalized.withColumns(
        {
            S.NPX: F.when(~excluded, F.col(chosen)),
            S.PC_NPX: F.when(~excluded, F.col("npx_pc")),
            S.NORMALIZATION: F.when(excluded, F.lit("EXCLUDED")).otherwise(F.lit(label)),
        }
    )


def counts_only(df: DataFrame) -> DataFrame:
    """Rows of samples failing SampleQC: only counts are reported for them, no NPX."""
    return df.where(F.col(S.SAMPLE_QC) == S.QC_FAIL).select(
        S.SAMPLE_ID, S.SAMPLE_TYPE, S.PLATE_ID, S.ASSAY_ID, S.BLOCK, S.COUNT
    )
