"""Integrity checks and QC reports (Q08-Q18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import count_rows, matches, not_in_or_null, qc_label
from ..functions.stats import group_quantiles
from ..session import materialize


# Column label of rows without a block.
MISSING_LABEL = "missing"


class IntegrityError(ValueError):
    """The measurement table breaks a rule the operators rely on."""


# ---------------------------------------------------------------------------
# Integrity (Q08-Q12)
# ---------------------------------------------------------------------------
def duplicate_samples(df: DataFrame, sample: str = S.SAMPLE_ID, assay: str = S.ASSAY_ID) -> DataFrame:
    """Distinct sample ids having a (sample, assay) pair more than once.

    Two aggregations, both partial: the pair count is keyed by (sample, assay), so a hot
    sample is spread over its assays; the second shuffle only carries duplicated pairs.
    """
    return (
        df.groupBy(sample, assay)
        .agg(count_rows().alias("_n"))
        .where(F.col("_n") > 1)
        .select(sample)
        .distinct()
    )


def non_conforming_assay_ids(df: DataFrame, assay: str = S.ASSAY_ID, pattern: str = S.ASSAY_ID_PATTERN) -> DataFrame:
    """Distinct assay ids that do not contain the id pattern (a NULL id does not conform)."""
    return df.select(assay).distinct().where(~matches(assay, pattern))


def uniprot_mismatches(df: DataFrame, assay: str = S.ASSAY_ID, uniprot: str = S.UNIPROT) -> DataFrame:
    """Assay ids with more than one distinct UniProt id (a missing UniProt counts as a value).

    Returns (assay_id, n_uniprot, extra) with extra = n_uniprot - 1, the number of repeats
    the reference's vector holds. Empty, with the same schema, when there is no UniProt column.
    """
    if uniprot not in df.columns:
        df = df.withColumn(uniprot, F.lit(None).cast("string"))
    return (
        df.select(assay, uniprot)
        .distinct()
        .groupBy(assay)
        .agg(count_rows().alias("n_uniprot"))
        .where(F.col("n_uniprot") > 1)
        .select(F.col(assay).alias(S.ASSAY_ID), "n_uniprot", (F.col("n_uniprot") - 1).alias("extra"))
    )


def value_column(df: DataFrame) -> str:
    """The value column the integrity checks use: NPX, else Quantified_value; the assay id must exist."""
    cols = set(df.columns)
    if S.NPX in cols or "NPX" in cols:
        kind = S.NPX if S.NPX in cols else "NPX"
    elif "quantified_value" in cols or "Quantified_value" in cols:
        kind = "quantified_value" if "quantified_value" in cols else "Quantified_value"
    else:
        raise IntegrityError("no value column: expected NPX or Quantified_value")
    if S.ASSAY_ID not in cols and "OlinkID" not in cols:
        raise IntegrityError("no assay id column: expected OlinkID or assay_id")
    return kind


def all_missing(df: DataFrame, key: str, npx: str = S.NPX) -> DataFrame:
    """Ids (samples or assays) whose every value is missing, with their row count.

    The standard validation the reference relies on flags these. One partial aggregate
    per id: two counters per group cross the shuffle.
    """
    return (
        df.groupBy(key)
        .agg(count_rows().alias("n_rows"), F.count(npx).alias("_n_values"))
        .where(F.col("_n_values") == 0)
        .drop("_n_values")
    )


def all_missing_samples(df: DataFrame, npx: str = S.NPX) -> DataFrame:
    return all_missing(df, S.SAMPLE_ID, npx)


def all_missing_assays(df: DataFrame, npx: str = S.NPX) -> DataFrame:
    return all_missing(df, S.ASSAY_ID, npx)


def check_integrity(df: DataFrame) -> dict:
    """Bundle: value column kind and the lazy check results."""
    kind = value_column(df)
    return {
        "data_type": kind,
        "non_conforming_oid": non_conforming_assay_ids(df),
        "duplicate_samples": duplicate_samples(df),
        "uniprot_replacements": uniprot_mismatches(df),
        "all_missing_samples": all_missing_samples(df, kind),
        "all_missing_assays": all_missing_assays(df, kind),
    }


# ---------------------------------------------------------------------------
# QC flags (Q13-Q16)
# ---------------------------------------------------------------------------
def flagged_assays(df: DataFrame) -> DataFrame:
    """Distinct (assay id, name, block, AssayQC) of type 'assay' whose AssayQC is not PASS.

    A missing AssayQC is dropped (comparison with NULL); the string "NA" is kept.
    """
    return (
        df.where((F.col(S.ASSAY_TYPE) == S.ASSAY_TYPE_ASSAY) & (F.col(S.ASSAY_QC) != S.QC_PASS))
        .select(S.ASSAY_ID, S.ASSAY, S.BLOCK, S.ASSAY_QC)
        .distinct()
    )


def flagged_samples(df: DataFrame) -> DataFrame:
    """Distinct sample ids with a SampleQC outside {"NA", PASS}; a missing SampleQC is flagged."""
    return df.where(not_in_or_null(S.SAMPLE_QC, [S.QC_NA, S.QC_PASS])).select(S.SAMPLE_ID).distinct()


def _status_counts(df: DataFrame) -> DataFrame:
    """Rows per (sample, block, status): a small table next to the measurements."""
    return df.groupBy(S.SAMPLE_ID, S.BLOCK, S.SAMPLE_QC).agg(count_rows().alias("_n"))


def sample_qc_long(df: DataFrame) -> DataFrame:
    """For flagged samples, per (sample, block): every status as ``STATUS (n=k)``, joined by ", ".

    Statuses are ordered as text, a missing status last (written "NA"). The measurement
    table is read once: the status counts (one row per sample x block x status) are a
    partial aggregate, and a sample is flagged by a window over its own count rows (at
    most blocks x QC states of them) -- no second scan, no join.
    """
    return _statuses(_status_counts(df))


def _statuses(all_counts: DataFrame) -> DataFrame:
    flag = not_in_or_null(S.SAMPLE_QC, [S.QC_NA, S.QC_PASS]).cast("int")
    counts = (
        all_counts.withColumn("_flagged", F.max(flag).over(Window.partitionBy(S.SAMPLE_ID)))
        .where(F.col("_flagged") == 1)
        .drop("_flagged")
    )
    label = F.concat(qc_label(S.SAMPLE_QC), F.lit(" (n="), F.col("_n").cast("string"), F.lit(")"))
    item = F.struct(F.col(S.SAMPLE_QC).isNull().alias("_missing"), F.col(S.SAMPLE_QC).alias("_s"), label.alias("_l"))
    return counts.groupBy(S.SAMPLE_ID, S.BLOCK).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["_l"]), ", ").alias("qc")
    )


def sample_qc_matrix(df: DataFrame, blocks: list[str] | None = None) -> DataFrame:
    """``sample_qc_long`` with one column block_<id> for each block.

    With a list of blocks nothing runs when the operator is called; a flagged sample's block that the
    list leaves out fails the job (``MISSING_LABEL`` stands for rows without a block). Without a
    list the status counts are written first, in one scan of the measurements; the columns are the
    panel's usual blocks and every other one counted, and the matrix is built from the counts.
    """
    counts = _status_counts(df)
    label = F.coalesce(S.BLOCK, F.lit(MISSING_LABEL))
    if blocks is None:
        counts = materialize(counts)
        present = {r[0] for r in counts.select(label).distinct().collect()}  # one row per block
        blocks = list(S.BLOCKS) + sorted(present - set(S.BLOCKS))
    unknown = F.raise_error(F.concat(F.lit("block without a column: "), label))
    named = _statuses(counts).withColumn(S.BLOCK, F.when(label.isin(blocks), label).otherwise(unknown))
    wide = named.groupBy(S.SAMPLE_ID).pivot(S.BLOCK, blocks).agg(F.max("qc"))
    return wide.select(S.SAMPLE_ID, *[F.col(f"`{b}`").alias(f"block_{b}") for b in blocks])


def qc_summary(df: DataFrame) -> DataFrame:
    """Per block: samples by their worst SampleQC, and assays (type 'assay') that fail AssayQC.

    A sample counts as failed when any of its rows in the block has SampleQC FAIL, else as warned
    when any has WARN, else as passed when any has PASS. One pass: counts per (block, sample) and
    per (block, assay) are partial aggregates.
    """
    has = {s: F.max(F.when(F.col(S.SAMPLE_QC) == s, 1).otherwise(0)) for s in (S.QC_FAIL, S.QC_WARN, S.QC_PASS)}
    per_sample = df.groupBy(S.BLOCK, S.SAMPLE_ID).agg(*[v.alias(f"_{s}") for s, v in has.items()])
    fail, warn, passed = (F.col(f"_{s}") == 1 for s in (S.QC_FAIL, S.QC_WARN, S.QC_PASS))
    samples = per_sample.groupBy(S.BLOCK).agg(
        F.count_if(fail).alias("samples_failed"),
        F.count_if(~fail & warn).alias("samples_warned"),
        F.count_if(~fail & ~warn & passed).alias("samples_passed"),
    )
    bad = (F.col(S.ASSAY_TYPE) == S.ASSAY_TYPE_ASSAY) & (F.col(S.ASSAY_QC) != S.QC_PASS)
    assays = df.groupBy(S.BLOCK, S.ASSAY_ID).agg(F.max(F.when(bad, 1).otherwise(0)).alias("_bad"))
    assays = assays.groupBy(S.BLOCK).agg(F.sum("_bad").alias("assays_failed"))
    assays = assays.withColumnRenamed(S.BLOCK, "_block")
    return samples.join(assays, F.col(S.BLOCK).eqNullSafe(F.col("_block"))).drop("_block")


def uniprot_map(df: DataFrame) -> DataFrame:
    """For assays with several UniProt ids: each id found and the one kept, the smallest id that is
    not NULL. (Which id to keep is our choice; it only has to be the same for all rows.)"""
    pairs = df.select(S.ASSAY_ID, S.UNIPROT).distinct()
    kept = F.min(S.UNIPROT).over(Window.partitionBy(S.ASSAY_ID))
    n = F.count(F.lit(1)).over(Window.partitionBy(S.ASSAY_ID))
    out = pairs.withColumns({"uniprot_kept": kept, "_n": n}).where("_n > 1")
    return out.select(S.ASSAY_ID, S.UNIPROT, "uniprot_kept")


def inspect_qc(df: DataFrame, blocks: list[str] | None = None) -> dict[str, DataFrame]:
    """Bundle: flagged assays, flagged sample ids, block-wise SampleQC matrix. All lazy with a list of
    blocks; without one the matrix needs the blocks of the data (one scan, see ``sample_qc_matrix``)."""
    return {
        "flagged_assays": flagged_assays(df),
        "flagged_sample_ids": flagged_samples(df),
        "flagged_samples_matrix": sample_qc_matrix(df, blocks),
    }


# ---------------------------------------------------------------------------
# Negative-control signal and outlier samples (Q17, Q18)
# ---------------------------------------------------------------------------
def negative_control_signal(df: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Counts of each assay relative to the extension control, in negative controls passing SampleQC.

    Per row the ratio is Count / Count of the extension control of the same sample and block
    (one per block, looked up whatever its own QC). Per assay: number of controls, largest ratio, and ``flagged`` when it is
    above ``threshold`` (the vendor's limit is not published: a parameter).
    The control counts are a partial aggregate (one row per sample and block) joined back.
    """
    from .normalize import extension_counts

    nc = df.where(F.col(S.SAMPLE_TYPE) == S.NEGATIVE_CONTROL)
    rows = (
        nc.where((F.col(S.ASSAY_TYPE) == S.ASSAY_TYPE_ASSAY) & (F.col(S.SAMPLE_QC) == S.QC_PASS))
        .join(extension_counts(nc), [S.SAMPLE_ID, S.BLOCK], "left")
        .select(S.SAMPLE_ID, S.ASSAY_ID, F.try_divide(F.col(S.COUNT).cast("double"), F.col("_ext_count")).alias("_ratio"))
    )
    return (
        rows.groupBy(S.ASSAY_ID)
        .agg(F.countDistinct(S.SAMPLE_ID).alias("n_controls"), F.max("_ratio").alias("max_ratio"))
        .withColumn("flagged", F.col("max_ratio") > F.lit(threshold))
    )


def qc_outliers(df: DataFrame, iqr_sd: float = 3.0, median_sd: float = 3.0, npx: str = S.NPX) -> DataFrame:
    """Per (sample, panel): IQR and median of NPX; ``outlier`` 1 when either lies outside
    mean +- k sd of that statistic over the panel's samples, else 0 (NULL without values).

    The per-sample quantiles hold one sample's values (size-checked); the panel statistics
    are one row per panel, joined back (broadcast by size).
    """
    per_sample = group_quantiles(
        df.select(S.SAMPLE_ID, S.PANEL, npx), [S.SAMPLE_ID, S.PANEL], [(npx, [0.25, 0.5, 0.75], ["_q1", "median", "_q3"])]
    ).select(S.SAMPLE_ID, S.PANEL, (F.col("_q3") - F.col("_q1")).alias("iqr"), "median")
    panel = per_sample.groupBy(S.PANEL).agg(
        F.avg("iqr").alias("_iqr_mean"),
        F.stddev_samp("iqr").alias("_iqr_sd"),
        F.avg("median").alias("_med_mean"),
        F.stddev_samp("median").alias("_med_sd"),
    )
    j = per_sample.join(panel, S.PANEL)
    out_iqr = (F.col("iqr") > F.col("_iqr_mean") + iqr_sd * F.col("_iqr_sd")) | (
        F.col("iqr") < F.col("_iqr_mean") - iqr_sd * F.col("_iqr_sd")
    )
    out_med = (F.col("median") > F.col("_med_mean") + median_sd * F.col("_med_sd")) | (
        F.col("median") < F.col("_med_mean") - median_sd * F.col("_med_sd")
    )
    return j.select(
        S.SAMPLE_ID, S.PANEL, "iqr", "median", F.when(out_iqr | out_med, 1).when(~(out_iqr | out_med), 0).alias("outlier")
    )
