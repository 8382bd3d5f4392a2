"""Nearest samples against brute force: many pivots, hot cells, ties, samples without values."""

import numpy as np
import pytest

from npxkit import schema as S
from npxkit.operators import neighbours
from npxkit.operators.qc import IntegrityError


def brute(x, k):
    out = []
    for a, v in x.items():
        near = sorted((float(np.sqrt(((v - w) ** 2).sum())), b) for b, w in x.items() if b != a)[:k]
        out += [(a, r + 1, b, d) for r, (d, b) in enumerate(near)]
    return sorted(out)


def check(df, x, k):
    got = sorted(tuple(r) for r in df.collect())
    want = brute(x, k)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    np.testing.assert_allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)


def frame(spark, x):
    return spark.createDataFrame([(a, [float(c) for c in v]) for a, v in x.items()], f"{S.SAMPLE_ID} string, features array<double>")


@pytest.mark.parametrize("pivots,block", [(1, 512), (7, 16), (40, 5)])
def test_matches_brute_force(spark, monkeypatch, pivots, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rng = np.random.default_rng(pivots)
    centre = 4 * rng.normal(size=(9, 5))
    x = {f"S{i:03d}": centre[i % 9] + rng.normal(size=5) for i in range(150)}
    x |= {f"T{i:03d}": x["S007"] for i in range(60)}  # a cell of equal samples, tied by id
    check(neighbours.nearest_vectors(frame(spark, x).repartition(5), 4, pivots), x, 4)


def test_far_cells_are_not_visited():
    rng = np.random.default_rng(0)
    pivots = np.array([[0.0, 0.0], [100.0, 0.0], [0.0, 100.0]])
    summary = [(i, 50, 1.0, sorted(rng.random(11))) for i in range(3)]
    least, within = neighbours._limits(pivots, summary, 10)
    assert all(least[i, j] > 50 for i in range(3) for j in range(3) if i != j)
    assert all(least[i, i] < 0 for i in range(3)) and max(within.values()) < 3


def test_fewer_samples_than_k(spark):
    x = {"a": np.array([0.0]), "b": np.array([1.0]), "c": np.array([1.0])}
    check(neighbours.nearest_vectors(frame(spark, x), 10), x, 10)
    assert neighbours.nearest_vectors(frame(spark, {"a": x["a"]}), 3).count() == 0
    assert neighbours.nearest_vectors(frame(spark, x).limit(0), 3).count() == 0


def rows(spark, cells):
    return spark.createDataFrame(cells, f"{S.SAMPLE_ID} string, {S.ASSAY_ID} string, {S.PLATE_ID} string, {S.NPX} double")


def test_samples_without_values_and_duplicates(spark):
    cells = [(s, a, "P", v) for s, vs in {"a": (1.0, 2.0), "b": (1.5, None), "c": (9.0, 4.0), "d": (None, None), "e": (1.0, 2.0)}.items() for a, v in zip("xy", vs)]
    got = {(r[0], r[1]): r[2] for r in neighbours.sample_neighbours(rows(spark, cells), k=2).collect()}
    assert {s for s, _ in got} == {"a", "b", "c", "e"} and "d" not in got.values()
    assert got["a", 1] == "e" and got["e", 1] == "a" and got["c", 1] == "b"
    with pytest.raises(IntegrityError):
        neighbours.sample_neighbours(rows(spark, [*cells, cells[0]]), k=2).collect()


def test_no_pairs_in_the_plan(spark):
    x = {f"S{i}": np.array([float(i)]) for i in range(5)}
    plan = neighbours.nearest_vectors(frame(spark, x), 2)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_a_cell_of_thousands_is_visited_once(spark, monkeypatch):
    """Rows that reach the blocks: each sample as a query and as a visitor, not once more for every 512 queries."""

    def counted(k):
        def run(batches):
            import pyarrow as pa

            n = sum(b.num_rows for b in batches)
            yield pa.RecordBatch.from_arrays([pa.array(["n"]), pa.array([n], pa.int32()), pa.array([""]), pa.array([0.0])], names=["sample_id", "rank", "neighbour_id", "distance"])

        return run

    monkeypatch.setattr(neighbours, "_nearest", counted)
    x = {f"S{i:04d}": np.array([i % 7, i / 3]) for i in range(1600)}
    rows = neighbours.nearest_vectors(frame(spark, x), 3, 1).collect()
    assert sum(r["rank"] for r in rows) == 2 * 1600
