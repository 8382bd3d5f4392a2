"""Held-out accuracy of the two classifiers, and their odd cases."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import none, odd  # noqa: F401
from npxkit.llm import quality, toxicity
from npxkit.llm.hashed_text import Sparse, gathered, grams, one_text_each

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    return docs, labels


def test_toxicity_on_held_out_rows(tables):
    docs, labels = tables
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.query(docs, labels).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out]
    assert 0.1 < len(held) / len(rows) < 0.3
    assert np.mean([t == p for t, p in held]) > 0.97
    assert np.mean([p for t, p in held if t]) > 0.8
    assert np.mean([p for t, p in held if not t]) < 0.01


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.query(docs, labels).collect()
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in rows)
    held = [(truth[r.doc_id], r.selected) for r in rows if r.held_out]
    assert np.mean([not s for t, s in held if t == 0]) > 0.9
    assert np.mean([s for t, s in held if t == 1]) > 0.99


def test_labels_of_the_held_out_fold_do_not_matter(spark, odd):
    labels = [(i, i % 2) for i in range(1, 13)]
    frame = spark.createDataFrame(labels, "doc_id long, toxic int")
    changed = frame.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    a, b = (sorted((str(r.doc_id), r.score) for r in toxicity.query(odd, x).collect()) for x in (frame, changed))
    assert a == b and len(a) == odd.count()


def test_odd_labels(spark, odd, none):
    kind = "doc_id long, quality int, toxic int"
    some = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 0, 0), (3, None, None), (None, 1, 1), (8, 1, 1), (99, 0, 1)], kind)
    empty = spark.createDataFrame([], kind)
    for labels in (some, empty):
        rows = toxicity.query(odd, labels).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        rows = quality.query(odd, labels).collect()
        assert len(rows) == odd.count() and all(0 <= r.tail_probability <= 1 for r in rows)
        kept = quality.selected(odd, labels)
        assert kept.columns == odd.columns and {r.grade for r in kept.collect()} <= {"g"}
    assert quality.selected(odd, empty).count() == odd.count()
    assert toxicity.query(none, some).count() == quality.query(none, some).count() == 0


def test_ordinal_gradient_matches_differences():
    rng = np.random.default_rng(0)
    lengths, grade = rng.integers(0, 4, 60), rng.integers(0, 4, 60)
    cols, vals = rng.integers(0, 5, lengths.sum()), rng.normal(size=lengths.sum())
    dense = np.zeros((60, 5))
    np.add.at(dense, (np.repeat(np.arange(60), lengths), cols), vals)

    def loss(p):
        cuts = np.cumsum(np.append(p[5], np.exp(p[6:])))
        tail = 1 / (1 + np.exp(-((dense @ p[:5])[:, None] - cuts[None, :])))
        tail = np.column_stack([np.ones(60), tail, np.zeros(60)])
        return -np.log(tail[np.arange(60), grade] - tail[np.arange(60), grade + 1]).mean() + 0.005 * (p[:5] ** 2).sum()

    p = rng.normal(size=8) * 0.5
    steps = 1e-6 * np.eye(8)
    wanted = [(loss(p + s) - loss(p - s)) / 2e-6 for s in steps]
    got = quality._ordinal_gradient(Sparse(lengths, cols, vals, 5), grade, 3, 0.01)(p)
    np.testing.assert_allclose(got, wanted, rtol=1e-5, atol=1e-7)


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    grade = rng.integers(0, 4, 400)
    x = Sparse(np.full(400, 2), np.tile([0, 1], 400), np.column_stack([grade + rng.normal(size=400), np.ones(400)]).ravel(), 2)
    w, cuts = quality._fit_ordinal(x, grade, 3)
    assert (np.diff(cuts) > 0).all() and w[0] > 0.5
    tail = 1 / (1 + np.exp(-(x.dot(w)[:, None] - cuts[None, :])))
    assert np.corrcoef(tail.sum(axis=1), grade)[0, 1] > 0.6


def test_a_repeated_id_gives_one_text(spark):
    docs = spark.createDataFrame([(1, f"text {i % 50}") for i in range(500)] + [(2, None), (2, "b"), (3, "c")], "doc_id long, text string")
    sample = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, label int")
    rows = sorted((r.label, r.text) for r in one_text_each(docs, sample, "label").collect())
    assert rows == [(0, ""), (1, "text 0")]


def test_grams_stay_in_their_document():
    data = "abcdéfg", "xyz", "", "ab"
    raw = [d.encode() for d in data]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    buf = np.frombuffer(b"".join(raw), dtype=np.uint8)
    ((doc, _),) = grams(buf, off, (3,))
    assert np.bincount(doc, minlength=4).tolist() == [5, 1, 0, 0]


def test_products_need_little_memory_besides_the_rows():
    rng = np.random.default_rng(5)
    lengths, width = rng.integers(0, 1000, 4000), 500
    x = Sparse(lengths, rng.integers(0, width, lengths.sum()).astype(np.int32), rng.random(lengths.sum()).astype(np.float32), width)
    w, g = rng.normal(size=width), rng.normal(size=len(lengths))
    forth = np.bincount(x.rows, weights=x.vals * w[x.cols], minlength=len(lengths))
    back = np.bincount(x.cols, weights=x.vals * g[x.rows], minlength=width)
    tracemalloc.start()
    try:
        got = x.dot(w), x.back(g)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.array_equal(got[0], forth) and np.array_equal(got[1], back)
    assert most < 8 * lengths.sum()  # one array of doubles for all entries would be as much


def test_gathered_rows_leave_nothing_with_arrow(spark):
    rows = [(n % 3, (n * 7919) % 1009, [n, n + 1][: n % 3], [n / 4, 0.5][: n % 3]) for n in range(1000)]
    frame = spark.createDataFrame(rows, "label int, key long, buckets array<int>, vals array<float>")
    before = pa.total_allocated_bytes()
    label, lengths, buckets, vals = gathered(frame.repartition(3), "label", ("buckets", "vals"))
    assert pa.total_allocated_bytes() == before
    rows.sort(key=lambda r: r[:2])
    assert label.tolist() == [r[0] for r in rows] and lengths.tolist() == [len(r[2]) for r in rows]
    assert buckets.tolist() == [b for r in rows for b in r[2]] and vals.tolist() == [v for r in rows for v in r[3]]
    assert [len(a) for a in gathered(frame.where("key < 0"), "label", ("buckets", "vals"))] == [0] * 4
