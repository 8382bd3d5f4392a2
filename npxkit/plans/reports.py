"""The reference's three report chains as functions returning lazy DataFrames.

* ``qc_report`` -- integrity checks and QC flags of a measurement table.
* ``precision_report`` -- LOD, sample sheets, replicate CVs, medians, quartiles and the
  chart data, with and without values below LOD.
* ``pca_report`` -- restrict to the annotated samples and compute principal components.

Results are lazy, but building them can run small jobs: the size checks of quantiles, the column
lists of wide results, and the checkpoints asked for.
Where one input feeds many results, ``materialize`` (a reliable checkpoint in the shared
``spark.checkpoint.dir``) can be asked for, so the input is computed once and a lost
executor does not recompute the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import schema as S
from ..operators import charts, components, cv, lod, manifest, matrix, qc, sheet
from ..session import materialize


def qc_report(df: DataFrame, checkpoint_input: bool = False) -> dict[str, DataFrame]:
    """Integrity bundle plus QC flags (flagged assays, samples, block-wise matrix).

    With ``checkpoint_input`` the columns the checks read are written once to the shared
    checkpoint folder, so the six outputs do not each rescan the source.
    """
    if checkpoint_input:
        cols = [c for c in (S.SAMPLE_ID, S.SAMPLE_TYPE, S.WELL_ID, S.PLATE_ID, S.ASSAY_ID, S.UNIPROT, S.ASSAY,
                            S.ASSAY_TYPE, S.BLOCK, S.ASSAY_QC, S.SAMPLE_QC, S.NPX) if c in df.columns]
        df = materialize(df.select(*cols))
    out = dict(qc.check_integrity(df))
    out.update(qc.inspect_qc(df))
    out["sample_sheet"] = sheet.sample_sheet(df)
    out["plate_layout"] = sheet.plate_layout(out["sample_sheet"])
    return out


def precision_report(
    df: DataFrame,
    manifest_df: DataFrame,
    subjects_df: DataFrame,
    fixed_lod: DataFrame | None = None,
    checkpoint_input: bool = False,
) -> dict[str, DataFrame]:
    """Replicate-CV report of a study, with all values and with values below LOD left out.

    ``fixed_lod`` (assay, reference id, pc_lod) is appended first when given; otherwise the
    table's own ``lod`` column is used.
    """
    data = lod.append_fixed_lod(df, fixed_lod) if fixed_lod is not None else df
    if checkpoint_input:
        data = materialize(data)
    sample_sheet = sheet.sample_sheet(data)
    full = manifest.full_sample_sheet(sample_sheet, manifest_df, subjects_df)
    mapping = cv.replicate_map(full, sample_sheet)
    out: dict[str, DataFrame] = {"full_sample_sheet": full, "project_counts": manifest.project_counts(manifest_df)}
    out["below_lod_per_sample"] = lod.below_lod_per_sample(data)
    out["below_lod_per_plate"] = lod.below_lod_per_plate(out["below_lod_per_sample"])
    meds = {}
    for suffix, drop in (("", False), ("_lod", True)):
        rcv = cv.replicate_intra_cv(data, mapping, drop_below_lod=drop)
        med = cv.median_cv(rcv)
        meds[suffix] = med
        out[f"replicate_intra_cv{suffix}"] = rcv
        out[f"median_cv{suffix}"] = med
        out[f"cv_quartiles{suffix}"] = cv.cv_quartiles(med)
    if S.VENDOR_INTRA_CV in data.columns:
        out["reconcile_cv"] = cv.reconcile_cv(out["replicate_intra_cv"], data)
        out["vendor_cv_coverage"] = cv.vendor_cv_coverage(data)
    out["cv_density"] = charts.cv_density(meds[""])
    points = charts.cv_vs_detectability(lod.percent_above_lod(data), meds[""])
    out["cv_vs_detectability"] = points
    out["cv_detectability_fit"] = charts.cv_detectability_fit(points)
    out["median_cv_overall"] = cv.median_cv_overall(meds[""], meds["_lod"])
    return out


def pca_report(df: DataFrame, full_sheet: DataFrame, k: int = 5) -> dict[str, object]:
    """PCA of the samples present in ``full_sheet``: scores with metadata, variance, loadings."""
    data = manifest.restrict_samples(df, full_sheet)
    res = components.pca(data, k=k)
    return {
        "scores": res.scores.join(full_sheet, "sample_id", "left"),
        "variance": res.variance,
        "loadings": res.loadings,
        "assays": res.assays,
    }
