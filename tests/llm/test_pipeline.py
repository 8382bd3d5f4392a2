"""The pipeline's stages against plain versions, each on its predecessor's rows."""

import hashlib
from pathlib import Path

import pytest
from brute import jaccard_components, repeated
from llm_fixtures import none, odd, small  # noqa: F401
from npxkit.llm import mixing, quality
from npxkit.llm.base import materialize, table
from npxkit.session import ensure_checkpoint_dir

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark):
    docs, out = table(spark, SF, "documents"), {}
    for name, stage in cp.STAGES:
        out[name] = (docs, materialize(stage(spark, docs, SF)))
        docs = out[name][1]
    return out


def test_columns_stay_until_the_last_stage(staged):
    for name, (before, after) in list(staged.items())[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes


def test_quality_keeps_what_the_classifier_selects(spark, staged):
    before, after = staged["quality"]
    labels = table(spark, SF, "labels")
    graded = quality.graded(before, quality.fit(before, quality.grades_of(labels))).collect()
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in graded if r._tail >= quality.SELECT_AT)
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(good - {r.doc_id for r in after.collect()}) <= 0.02 * len(good)


def test_one_of_each_group_of_near_duplicates_stays(staged):
    before, after = staged["near_duplicates"]
    _, component = jaccard_components([(r.doc_id, r.text) for r in before.collect()], 5, 80)
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(component.values()))


def test_rows_of_one_id_with_unlike_texts_are_documents_of_their_own(spark):
    words = lambda a: " ".join(f"{a}{i}" for i in range(60))
    texts = [(1, words("a")), (2, words("a") + " more"), (2, words("b")), (2, words("c")), (2, words("c")), (3, words("d")), (3, words("d") + " x")]
    texts += [(4, "!"), (4, ""), (4, ""), (5, ""), (None, words("a")), (None, words("e")), (None, words("e"))]
    docs = spark.createDataFrame([(i, t, f"s{n}") for n, (i, t) in enumerate(texts)], "doc_id long, text string, source string")
    runs = [cp.near_duplicate_stage(spark, docs.repartition(n), SF).collect() for n in (1, 7)]
    got = sorted((str(r.doc_id), r.text) for r in runs[0])
    smaller = min((words("d"), words("d") + " x"), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    kept = [(1, words("a")), (2, words("b")), (2, words("c")), (3, smaller), (4, "!"), (4, ""), (5, "")]
    assert got == sorted((str(i), t) for i, t in [*kept, (None, words("a")), (None, words("e"))])
    assert sorted(map(str, runs[0])) == sorted(map(str, runs[1]))


def test_repeats_are_gone(staged):
    before, after = staged["repeats"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    plain = repeated([t for _, t in rows], cp.REPEAT_BYTES)
    left = {i: x[3].decode("utf-8", "ignore") for (i, _), x in zip(rows, plain) if not x[0] or x[3].strip()}
    assert {r.doc_id: r.text for r in after.collect()} == left
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_mixture_takes_what_was_drawn(staged):
    before, after = staged["mixture"]
    copies = {r.doc_id: r.copies for r in mixing.mix(before).collect()}
    got = {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in copies.items() if n}


def test_all_ids_are_packed(staged):
    before, after = staged["packed"]
    rows = after.collect()
    per_doc = {r.doc_id: r["count"] for r in before.groupBy("doc_id").count().collect()}
    total = {}
    for r in rows:
        total.setdefault(r.doc_id, [0, r.doc_tokens])[0] += r.length
    assert {i: n // size for i, (n, size) in total.items()} == per_doc
    assert all(n % size == 0 for n, size in total.values())


def test_stages_take_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for name, stage in cp.STAGES[:-1]:
            after = stage(spark, docs, SF)
            assert after.columns == docs.columns, name
            assert after.count() <= 3 * docs.count()
        assert cp.STAGES[-1][1](spark, docs, SF).count() >= docs.count()


def test_run_returns_the_last_stage(spark):
    assert cp.run(spark, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_near_duplicates_leave_no_prefixes_on_disk(spark):
    """Tables of finished steps, the prefixes' above all, stayed written while the later stages ran."""
    top = Path(ensure_checkpoint_dir(spark).removeprefix("file://").removeprefix("file:"))
    before = set(top.glob("llm-*"))
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:30], f"x{i}", *base[31:]])) for i in range(20)] + [(i, f"alone {i} at a place {i * i} of its own") for i in range(20, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = cp.near_duplicate_stage(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == [0, *range(20, 40)]
    columns = {c for d in set(top.glob("llm-*")) - before for c in spark.read.parquet(str(d)).columns}
    assert "_row" in columns and not columns & {"prefix", "pos", "h"}
