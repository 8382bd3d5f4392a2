import numpy as np
import pytest
from npxkit.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<double>, component int, n string"


def plain(rows, k=wh.COMPONENTS):
    """Per (length, id): the digest of plain NumPy over the distinct whole-number vectors."""
    by = {}
    for i, v in rows:
        if v and all(c is not None and np.isfinite(c) for c in v):
            by.setdefault(len(v), []).append((i, tuple(int(np.floor(256 * c)) for c in v)))
    out = []
    for dim, members in by.items():
        fit = np.array(sorted({x for _, x in members}), dtype=float)
        n, s = len(fit), [sum(c) for c in zip(*{x for _, x in members})]
        mean = np.array(s) / n
        v = (fit - mean).T @ (fit - mean) / n
        e, u = np.linalg.eigh(v)
        e, u = e[::-1][:k], u[:, ::-1][:, :k]
        for i, x in members:
            dev = sum((n * a - b) ** 2 for a, b in zip(x, s))
            w = (np.array(x) - mean) @ u / np.sqrt(np.maximum(e, 1e-300))
            out += [(i, j + 1, n, dev, abs(w[j]), e[j] / np.trace(v)) for j in range(len(e))]
    return out


def check(df, rows):
    got, want = df.collect(), plain(rows)
    assert len(got) == len(want)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3])
    got, want = sorted(got, key=key), sorted(want, key=key)
    for g, w in zip(got, want):
        assert (g.vec_id, g.component, g.n, g.deviation) == w[:4]
        assert g.whitened is not None and abs(abs(g.whitened) - w[4]) <= 1e-6 * max(1.0, w[4])
        assert abs(g.explained - w[5]) <= 1e-9
        assert g.identity_error <= 1e-9


def data(n=400, dim=9, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * np.linspace(0.3, 2.0, dim)
    x[50:90] = x[50]  # copies count once
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)


def test_matches_numpy(spark):
    rows = data()
    df = wh.whiten(frame(spark, rows).repartition(5))
    check(df, rows)
    # One axis and one sign for all rows: the whitened fit list has the identity as covariance.
    seen = {}
    for r in df.collect():
        seen.setdefault(r.vec_id, {})[r.component] = r.whitened
    x = np.array([[seen[i][j] for j in range(1, 5)] for i in [*range(50), *range(89, 400)]])
    np.testing.assert_allclose(np.cov(x.T, bias=True), np.eye(4), atol=1e-9)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [1.0, -inf]), (5, [])]
    good = [(None, [0.5, 1.0]), (7, [-0.001, 3.0]), (7, [-0.0, 0.0]), (8, [0.0, -0.0]), (8, [5.0, 1.5]), (9, [1.0, 2.0, 3.0]), (10, [4.0, 2.0, 1.0]), (11, [4.0, 9.0, 1.0])]
    got = wh.query(frame(spark, bad + good)).collect()
    assert {r.vec_id for r in got} == {None, 7, 8, 9, 10, 11}
    two = [r for r in got if r.vec_id in (None, 7, 8)]
    assert len(two) == 2 * 5 and {r.n for r in two} == {4} and all(r.whitened is not None for r in two)
    three = [r for r in got if r.vec_id in (9, 10, 11)]
    # Three vectors span two components: the third has no variance.
    assert all((r.whitened is None) == (r.component == 3) for r in three)
    assert all(r.explained < 1e-12 for r in three if r.component == 3)
    assert all(r.identity_error < 1e-9 for r in got)
    assert wh.query(frame(spark, bad)).count() == 0
    assert wh.query(frame(spark, bad).limit(0)).count() == 0
    (one, *_), same = wh.query(frame(spark, [(1, [1.0, 2.0])] * 3)).collect(), 6
    assert one.n == 1 and one.whitened is None and one.explained is None and one.identity_error is None and one.deviation == 0
    assert wh.query(frame(spark, [(1, [1.0, 2.0])] * 3)).count() == same


def test_values_beyond_64_bits(spark):
    rows = [(1, [1e30, 1.0]), (2, [-1e30, 2.0]), (3, [1e7, 3.0])]
    got = wh.query(frame(spark, rows)).collect()
    assert len(got) == 6 and all(r.deviation is None for r in got if r.vec_id < 3)
    rows = [(i, [1e6 * i, -3e5 * i * i, 7.5]) for i in range(200)]  # deviations near 2^63: counted with whole numbers
    got = {r.vec_id: r.deviation for r in wh.query(frame(spark, rows)).collect()}
    want = {i: d for i, j, _, d, *_ in plain(rows) if j == 1}
    assert got == {i: d if d < 2**63 else None for i, d in want.items()}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 30])
def test_inertia_matches_eigenvalues(n):
    rng = np.random.default_rng(n)
    for _ in range(20):
        a = rng.normal(size=(n, n))
        a = (a + a.T) / 2
        e = np.linalg.eigvalsh(a)
        for shift in [0.0, *rng.normal(size=3)]:
            p, m, z = wh.inertia(a - shift * np.eye(n))
            assert (p, m, z) == ((e > shift).sum(), (e < shift).sum(), 0)
    assert wh.inertia(np.array([[0.0, 1.0], [1.0, 0.0]])) == (1, 1, 0)
    assert wh.inertia(np.zeros((n, n))) == (0, 0, n)


@pytest.mark.parametrize(
    "spectrum",
    [[5, 4, 3, 2, 1], [5, 5, 5, 1, 0], [1, 1, 1, 1, 1], [3, 3 - 1e-9, 2, 2 - 1e-13, 0], [1e12, 1, 1e-6, 0, 0], [0, 0, 0, 0, 0], [2]],
)
def test_spectra(spectrum):
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(len(spectrum), len(spectrum))))
    v = (q * np.array(spectrum, dtype=float)) @ q.T
    v = (v + v.T) / 2
    values, axes = wh.Slicer(v).leading(4)
    np.testing.assert_allclose(values, spectrum[:4], rtol=1e-12, atol=1e-12 * max(spectrum))
    np.testing.assert_allclose(axes @ axes.T, np.eye(len(values)), atol=1e-12)
    assert np.abs(v @ axes.T - axes.T * values).max() <= 1e-11 * max(spectrum)
