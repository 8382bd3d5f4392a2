"""The three report chains run end to end on the smallest fixture."""

from conftest import SF001
from npxkit.plans import reports
from npxkit.sources import fixtures as fx
from npxkit.operators import manifest, sheet


def test_qc_report(spark):
    d = fx.npx(spark, SF001)
    out = reports.qc_report(d)
    assert out["data_type"] == "npx"
    for name, df in out.items():
        if name != "data_type":
            assert df.count() >= 0


def test_precision_report(spark):
    d = fx.npx(spark, SF001)
    with_vendor = d.join(fx.vendor_cv(d), ["assay_id", "plate_id"], "left")
    out = reports.precision_report(with_vendor, fx.manifest(d), fx.subjects(d), fixed_lod=fx.fixed_lod(d),
                                   checkpoint_input=True)
    assert out["cv_quartiles"].count() > 0
    assert "reconcile_cv" in out
    assert out["median_cv_overall"].count() == 1
    for df in out.values():
        df.count()


def test_pca_report(spark):
    d = fx.npx(spark, SF001)
    full = manifest.full_sample_sheet(sheet.sample_sheet(d), fx.manifest(d), fx.subjects(d))
    out = reports.pca_report(d, full, k=3)
    assert out["variance"].count() == 3
    assert out["scores"].count() == full.count()


def test_qc_report_checkpointed_input(spark):
    d = fx.npx(spark, SF001)
    out = reports.qc_report(d, checkpoint_input=True)
    assert out["flagged_samples_matrix"].count() == reports.qc_report(d)["flagged_samples_matrix"].count()
