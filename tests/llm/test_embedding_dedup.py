import numpy as np
import pyarrow as pa
from brute import components
from npxkit.llm import embedding_dedup as ed


def plain(rows):
    good = {}
    for i, v, label in rows:
        if v is None or label is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good[i] = (np.array(v, dtype=float), label)
    links = []
    ids = sorted(good)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            (x, p), (y, q) = good[a], good[b]
            if p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links.append((a, b))
    count = {i: 0 for i, *_ in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return count, components(list(count), links)


def check(df, rows):
    count, component = plain(rows)
    got = {r.vec_id: r for r in df.collect()}
    assert {i: r.n_links for i, r in got.items()} == count
    assert {i: r.component_id for i, r in got.items()} == component
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def near(n=600, dim=8, labels=3, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(n // 6, dim))
    x = centre[rng.integers(0, len(centre), n)] + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.08, 0.2], size=(n, 1))
    x[5], x[6], x[7] = x[4], x[4] * 3, x[4]
    return [(i, [float(np.float32(v)) for v in x[i]], int(i % labels)) for i in range(n)]


SCHEMA = "vec_id long, embedding array<float>, label int, rep long, cell string"


def test_links_match_all_pairs(spark, monkeypatch):
    rows = near()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    monkeypatch.setattr(ed, "CELL_ROWS", 8)  # many cells
    monkeypatch.setattr(ed, "BLOCK", 16)  # several blocks for a cell
    check(ed.near_duplicates(df), rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0),
        (2, [2.0, 0.0], 0),
        (3, [1.0, 0.0], 1),
        (4, [1.0, 0.0], None),
        (5, None, 0),
        (6, [0.0, 0.0], 0),
        (7, [1.0, None], 0),
        (8, [nan, 1.0], 0),
        (9, [inf, 1.0], 0),
        (10, [1.0, 0.0, 0.0], 0),
        (11, [], 0),
        (12, [1.0, 0.0], 0),
        (13, [1e-30, 0.0], 0),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    check(ed.near_duplicates(df), rows)
    assert ed.near_duplicates(df.limit(0)).count() == 0


def test_repeated_rows_count_as_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 1.0], 0, 1, "x")] * 3 + [(2, [1.0, 1.0], 0, 1, "x")], SCHEMA)
    rows = ed.near_duplicates(df).collect()
    assert len(rows) == 4 and {r.n_links for r in rows} == {3} and {r.component_id for r in rows} == {1}


def test_null_and_repeated_ids(spark):
    rows = [
        (None, [1.0, 0.0], 0),
        (None, [0.99, 0.01], 0),
        (5, [1.0, 0.001], 0),
        (None, [0.0, 1.0], 1),  # linked vectors without any id
        (None, [0.01, 1.0], 1),
        (9, [1.0, 0.0], 2),  # one id, two vectors: one of them linked
        (9, [0.0, 1.0], 2),
        (3, [0.0, 2.0], 2),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in ed.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 2, 5), (None, 2, 5), (5, 2, 5), (None, 1, None), (None, 1, None), (9, 0, 9), (9, 1, 3), (3, 1, 3)], key=str)


def test_vectors_are_sent_about_once_a_round(spark, monkeypatch):
    """Vectors went to each cell that they might have links in: many copies of each at once."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=64)], 0) for i in range(400)]
    for i in range(0, 400, 40):
        rows[i + 1] = (i + 1, [v + 1e-3 for v in rows[i][1]], 0)
    copies, compare, write = [], ed._compare, ed.materialize

    def counting(*given):
        def run(batches):
            held = list(batches)
            n = sum(b.num_rows for b in held)
            yield pa.RecordBatch.from_pydict({"rep": pa.array([-1], pa.int64()), "links": pa.array([n], pa.int64()), "other": pa.array([-1], pa.int64())})
            yield from compare(*given)(iter(held))

        return run

    def kept(df):
        out = write(df)
        if "other" in df.columns:
            copies.append(out.where("rep = -1").agg({"links": "sum"}).first()[0])
        return out

    monkeypatch.setattr(ed, "CELL_ROWS", 4)
    monkeypatch.setattr(ed, "_compare", counting)
    monkeypatch.setattr(ed, "materialize", kept)
    check(ed.near_duplicates(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)), rows)
    assert copies and max(copies) <= 450
