"""PCA invariants and agreement with NumPy's SVD on the dense fixture (sf0.01)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from npxkit import schema as S
from npxkit.operators import components, matrix
from npxkit.sources import fixtures as fx


@pytest.fixture(scope="module")
def data(spark):
    return fx.npx(spark, SF01).where(F.col(S.SAMPLE_TYPE) == S.SAMPLE)


@pytest.fixture(scope="module")
def result(data):
    return components.pca(data, k=5)


def numpy_reference(data):
    """The reference's steps done on the driver with NumPy (test only: small fixture)."""
    pdf = data.select(S.SAMPLE_ID, S.ASSAY_ID, S.PLATE_ID, S.NPX).toPandas()
    var = pdf.groupby([S.ASSAY_ID, S.PLATE_ID])[S.NPX].var(ddof=1)
    keep = var[(var > 0) & var.notna()].index
    pdf = pdf.set_index([S.ASSAY_ID, S.PLATE_ID]).loc[lambda d: d.index.isin(keep)].reset_index()
    pdf = pdf[pdf[S.NPX].notna()]
    wide = pdf.pivot(index=S.SAMPLE_ID, columns=S.ASSAY_ID, values=S.NPX).sort_index(axis=1).sort_index()
    wide = wide.fillna(wide.median())
    x = wide.to_numpy()
    sd = x.std(axis=0, ddof=1)
    z = (x - x.mean(axis=0)) / np.where(sd == 0, 1, sd)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    v = vt.T
    signs = np.where(v[np.abs(v).argmax(axis=0), range(v.shape[1])] < 0, -1.0, 1.0)
    scores = (z @ v) * signs
    pct = s**2 / (s**2).sum() * 100
    return wide.index.to_list(), scores, pct, list(wide.columns)


def test_pca_matches_numpy(data, result):
    ids, ref_scores, ref_pct, ref_assays = numpy_reference(data)
    assert result.assays == ref_assays
    got = {r[S.SAMPLE_ID]: [r[f"pc{j + 1}"] for j in range(5)] for r in result.scores.collect()}
    assert sorted(got) == sorted(ids)
    mine = np.array([got[i] for i in ids])
    np.testing.assert_allclose(mine, ref_scores[:, :5], atol=1e-8)
    var = result.variance.orderBy("component").collect()
    np.testing.assert_allclose([r.percent for r in var], ref_pct[:5], atol=1e-8)
    assert var[0].label == f"PC1 ({ref_pct[0]:.1f}%)"


def test_pca_invariants(result):
    s = np.array([[r[f"pc{j + 1}"] for j in range(5)] for r in result.scores.collect()])
    np.testing.assert_allclose(s.mean(axis=0), 0, atol=1e-9)
    gram = s.T @ s
    np.testing.assert_allclose(gram - np.diag(np.diag(gram)), 0, atol=1e-6)
    pct = [r.percent for r in result.variance.orderBy("component").collect()]
    assert all(a >= b for a, b in zip(pct, pct[1:])) and sum(pct) <= 100 + 1e-9
    lead = result.loadings[np.abs(result.loadings).argmax(axis=0), range(result.loadings.shape[1])]
    assert (lead > 0).all()


def matrix_frame(spark, x, missing=()):
    rows = [(f"S{i:04d}", f"A{j:05d}", "P", float(x[i, j])) for i in range(x.shape[0]) for j in range(x.shape[1]) if (i, j) not in missing]
    return spark.createDataFrame(rows, f"{S.SAMPLE_ID} string, {S.ASSAY_ID} string, {S.PLATE_ID} string, {S.NPX} double")


def dense(x, missing=()):
    """NumPy: medians for missing cells, scaled, decomposed, signs fixed."""
    x = x.copy()
    for j in range(x.shape[1]):
        gone = [i for i, c in missing if c == j]
        x[gone, j] = np.median(np.delete(x[:, j], gone))
    sd = x.std(axis=0, ddof=1)
    z = (x - x.mean(axis=0)) / np.where(sd == 0, 1, sd)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    v = vt.T
    signs = np.where(v[np.abs(v).argmax(axis=0), range(v.shape[1])] < 0, -1.0, 1.0)
    return (z @ v) * signs, s**2 / (s**2).sum() * 100, v * signs


@pytest.mark.parametrize("shape", [(12, 40), (40, 12), (25, 25)])
def test_routes_agree_with_numpy(spark, shape):
    rng = np.random.default_rng(sum(shape))
    x = rng.normal(size=shape) * np.linspace(1, 3, shape[1]) + rng.normal(size=(shape[0], 3)) @ rng.normal(size=(3, shape[1]))
    missing = {(int(i), int(j)) for i, j in zip(rng.integers(0, shape[0], 30), rng.integers(0, shape[1], 30))}
    df = matrix_frame(spark, x, missing)
    scores, percent, loadings = dense(x, missing)
    for route in ("dual", "primal", "subspace"):
        got = components.pca(df, k=3, route=route, tolerance=1e-13)
        assert got.route == route and got.assays == [f"A{j:05d}" for j in range(shape[1])]
        mine = np.array([[r.pc1, r.pc2, r.pc3] for r in got.scores.orderBy(S.SAMPLE_ID).collect()])
        np.testing.assert_allclose(mine, scores[:, :3], atol=1e-8)
        np.testing.assert_allclose(got.loadings, loadings[:, :3], atol=1e-8)
        np.testing.assert_allclose([r.percent for r in got.variance.orderBy("component").collect()], percent[:3], atol=1e-8)


def test_route_follows_the_shape(spark, monkeypatch):
    x = np.random.default_rng(0).normal(size=(6, 9))
    assert components.pca(matrix_frame(spark, x), k=2).route == "dual"
    assert components.pca(matrix_frame(spark, x.T), k=2).route == "primal"
    monkeypatch.setattr(components, "PRIMAL_ASSAYS", 4)
    assert components.pca(matrix_frame(spark, x.T), k=2).route == "subspace"
    with pytest.raises(matrix.IntegrityError):
        components.pca(matrix_frame(spark, x).where("false"))
    with pytest.raises(matrix.IntegrityError):
        components.pca(matrix_frame(spark, x).unionAll(matrix_frame(spark, x)))


def test_constant_assays_and_few_samples(spark):
    x = np.random.default_rng(1).normal(size=(3, 8))
    x[:, 2] = 0.1 + 0.2  # no variance beyond rounding
    for route in ("dual", "primal", "subspace"):
        got = components.pca(matrix_frame(spark, x), k=5, drop_constant=False, route=route)
        assert got.loadings.shape == (8, 2)
        assert abs(got.loadings[2]).max() < 1e-9
        assert sum(r.percent for r in got.variance.collect()) == pytest.approx(100.0)


def test_a_panel_too_wide_for_its_square(spark):
    """80,000 assays: nothing p x p fits, the leading five components agree with NumPy's."""
    n, p = 24, 80_000
    i, j = np.arange(n)[:, None], np.arange(p)[None, :]
    x = sum((6 - r) * np.sin(i * (0.7 + r) + r) * np.cos(j * (0.31 + 0.17 * r)) for r in range(5))
    noise = np.sin(i * 12.9898 + j * 78.233)
    x = x + 0.05 * noise
    terms = " + ".join(f"{6 - r} * sin(i * {0.7 + r}D + {r}) * cos(j * {0.31 + 0.17 * r}D)" for r in range(5))
    df = spark.range(n * p).selectExpr("id % 24 as i", "id div 24 as j").selectExpr(
        f"concat('S', lpad(i, 4, '0')) as {S.SAMPLE_ID}", f"concat('A', lpad(j, 5, '0')) as {S.ASSAY_ID}",
        f"'P' as {S.PLATE_ID}", f"{terms} + 0.05D * sin(i * 12.9898D + j * 78.233D) as {S.NPX}",
    )
    scores, percent, _ = dense(x)
    got = components.pca(df, k=5, route="subspace")
    mine = np.array([[r[f"pc{c + 1}"] for c in range(5)] for r in got.scores.orderBy(S.SAMPLE_ID).collect()])
    np.testing.assert_allclose(mine, scores[:, :5], atol=1e-6 * np.abs(scores).max())
    np.testing.assert_allclose([r.percent for r in got.variance.orderBy("component").collect()], percent[:5], atol=1e-6)


def test_the_check_sees_a_wrong_result(spark):
    x = np.random.default_rng(4).normal(size=(10, 14))
    df = matrix_frame(spark, x, {(0, 0), (3, 5)})
    result = components.pca(df, k=3)
    rows = components.pca_check(df, result).collect()
    assert len(rows) == 3 and all(r.residual < 1e-9 and abs(r.length - 1) < 1e-9 and r.skew < 1e-9 and abs(r.spread - 1) < 1e-9 for r in rows)
    assert {(r.total, r.samples) for r in rows} == {(14.0, 10)}
    result.loadings = np.roll(result.loadings, 1, axis=0)
    assert all(r.residual > 1e-3 for r in components.pca_check(df, result).collect())
