import numpy as np
import pytest
from npxkit.llm import vantage_points as vp

SCHEMA = "vec_id long, embedding array<float>, row long, score string"


def plain(rows, k=vp.K):
    single = lambda v: v and [None if c is None else float(np.float32(c)) for c in v]
    good = [(i, single(v)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for n, (i, v) in enumerate(good):
        if i is None or i % vp.EVERY:
            continue
        others = [(float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j is None, j or 0, m) for m, (j, w) in enumerate(good) if m != n and len(w) == len(v)]
        out += [(i, r + 1, None if null else j, d) for r, (d, null, j, _) in enumerate(sorted(others)[:k])]
    return out


def key(r):
    return (r[0], r[1], r[2] is None, r[2] or 0)


def check(df, rows):
    got = sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect()), key=key)
    want = sorted(plain(rows), key=key)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    np.testing.assert_allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12, atol=1e-300)


def clustered(n=1500, dim=6, seed=2):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(20, dim))
    x = centre[rng.integers(0, 20, n)] + 0.1 * rng.normal(size=(n, dim))
    x[100:400] = x[100]  # a third of the queries' neighbours are equal
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]


@pytest.fixture
def exact(monkeypatch):
    monkeypatch.setattr(vp, "LEAF", 16)
    monkeypatch.setattr(vp, "SHARD_VALUES", 2048)  # several shards
    monkeypatch.setattr(vp, "QUERY_BLOCK", 3)
    monkeypatch.setattr(vp, "FACTOR", 1.0)


def found(spark, rows, factor=1.0):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    from pyspark.sql import functions as F

    return vp.neighbours(df, F.pmod(F.col("vec_id"), F.lit(vp.EVERY)) == 0, factor=factor)


def test_factor_one_is_exact(spark, exact):
    rows = clustered()
    check(found(spark, rows), rows)


def test_odd_vectors(spark, exact):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]),
        (100, [1.0, 0.0]),
        (100, [1.0, 0.0]),  # a repeated row
        (100, [3.0, 4.0]),  # one id, another vector
        (None, [1.0, 0.0]),
        (None, [2.0, 0.0]),
        (200, None),
        (300, []),
        (400, [0.0, 0.0]),
        (500, [1.0, None]),
        (600, [nan, 1.0]),
        (700, [inf, 1.0]),
        (800, [1.0, 2.0, 3.0]),  # alone with its length
        (-100, [1e30, 1e30]),
        (7, [1e-30, 0.0]),
    ]
    check(found(spark, rows), rows)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    assert vp.query(df.limit(0)).count() == 0
    assert vp.query(df.where("vec_id = 800")).count() == 0


def test_distances_do_not_overflow():
    a, b = np.array([[3e200, 0.0], [3e-200, 0.0]]), np.array([[0.0, 4e200], [0.0, 4e-200]])
    np.testing.assert_allclose(vp.distances(a, b), [5e200, 5e-200], rtol=1e-15)


def test_bounds_skip_rows_and_keep_recall():
    x = np.array([v for _, v in clustered(6000, 6)])
    tree, q = vp.Tree(x), x[::100]
    own = np.arange(0, len(x), 100)
    best, rows, seen = tree.search(q, own, 10, 1.0)
    far = np.sqrt(((q[:, None] - x[None]) ** 2).sum(-1))
    far[np.arange(len(q)), own] = np.inf
    np.testing.assert_allclose(best, np.sort(far, axis=1)[:, :10], rtol=1e-12)
    assert seen < 0.5 * len(q) * len(x)
    relaxed, some, fewer = tree.search(q, own, 10, vp.FACTOR)
    assert fewer < seen
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(rows, some)]) >= 0.9


def test_recall_of_the_query(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    pdf = df.toPandas()
    x, ids = np.stack(pdf.embedding).astype(float), pdf.vec_id.to_numpy()
    got = {}
    for r in vp.query(df).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = {q: set(ids[[j for j in np.argsort(((x - v) ** 2).sum(1), kind="stable") if ids[j] != q][:10]]) for q, v in zip(ids, x) if q % 100 == 0}
    assert set(got) == set(want)
    assert np.mean([len(set(got[q]) & want[q]) / 10 for q in want]) >= 0.9
