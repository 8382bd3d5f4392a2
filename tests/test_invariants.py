"""Invariants of the chart data and normalisation on the dense fixture."""

import numpy as np
from pyspark.sql import functions as F

from conftest import SF01
from npxkit import schema as S
from npxkit.operators import charts, cv, normalize
from npxkit.sources import fixtures as fx


def test_density_integrates_to_about_one(spark):
    d = fx.npx(spark, SF01)
    rcv = cv.replicate_intra_cv(d, d.select(S.SAMPLE_ID, F.col(S.SAMPLE_TYPE).alias(S.SUBSAMPLE_ID)).distinct())
    dens = charts.cv_density(cv.median_cv(rcv)).toPandas()
    for _, g in dens.groupby([S.SAMPLE_TYPE, S.PLATE_ID]):
        g = g.sort_values("grid_index")
        integral = np.trapezoid(g["density"], g["x"])
        assert 0.5 < integral <= 1.0 + 1e-6, integral


def test_histogram_counts_sum_to_rows(spark):
    a = cv.attach_control_cv(fx.npx(spark, SF01))
    h = charts.cv_histogram(a)
    assert h.agg(F.sum("n")).first()[0] == a.where(F.col("intra_cv").isNotNull()).count()


def test_plate_controls_have_median_zero_after_pc_normalisation(spark):
    n = normalize.normalize(fx.npx(spark, SF01)).where(F.col(S.SAMPLE_TYPE) == S.PLATE_CONTROL)
    med = n.groupBy(S.PLATE_ID, S.ASSAY_ID).agg(F.median(F.col(S.EXT_NPX) - F.col("pc_median")).alias("m"))
    assert med.where(F.abs("m") > 1e-12).count() == 0
