"""Manifest and subject joins (Q58-Q60)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import with_key


def project_counts(manifest: DataFrame, project: str = "project") -> DataFrame:
    """Rows per project (a NULL project is a group of its own)."""
    return manifest.groupBy(project).agg(F.count(F.lit(1)).alias("n"))


def full_sample_sheet(
    sheet: DataFrame,
    manifest: DataFrame,
    subjects: DataFrame,
    external_id: str = "olink_sample_id",
    subject_cols: tuple[str, ...] = ("subj_type", "sex", "tissue_type"),
) -> DataFrame:
    """Sample sheet joined to the manifest (sample id = external id), then to subjects on subj_id.

    Inner joins: controls and samples unknown to the manifest or to the subject sheet leave.
    Both side tables grow with samples/subjects: the planner broadcasts them only while their
    size (estimated, then measured by AQE at run time) is under the broadcast threshold.
    """
    m = manifest
    with_manifest = sheet.join(m, sheet[S.SAMPLE_ID] == m[external_id], "inner").drop(m[external_id])
    subj = subjects.select("subj_id", *subject_cols)
    return with_manifest.join(subj, "subj_id", "inner")


def restrict_samples(df: DataFrame, sheet: DataFrame) -> DataFrame:
    """Rows of ``df`` whose sample is in ``sheet`` (a left-semi join; ``df`` rows are never repeated).

    A sheet read from files reaches the scan of a large ``df`` as a runtime Bloom filter.
    """
    return df.join(with_key(sheet.select(S.SAMPLE_ID), S.SAMPLE_ID), S.SAMPLE_ID, "left_semi")
