import random

import numpy as np
import pyarrow as pa
from brute import repeated
from llm_fixtures import none, odd, small  # noqa: F401
from npxkit.llm import suffix_dedup as sd


def outcome(rows):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)


def expected(rows, size):
    rows = [(r.doc_id, r.text) for r in rows]
    return sorted((str(i), len((t or "").encode()), *x[:3]) for (i, t), x in zip(rows, repeated([t for _, t in rows], size)))


def test_removal_matches_brute_force(small):
    assert outcome(sd.query(small).collect()) == expected(small.collect(), sd.MIN_BYTES)


def test_odd_rows(odd, none):
    assert outcome(sd.query(odd).collect()) == expected(odd.collect(), sd.MIN_BYTES)
    assert sd.query(none).count() == 0


def tricky(spark):
    rng = random.Random(5)
    core = "".join(rng.choice("abcd") for _ in range(150))
    texts = []
    for n in range(60):
        a, b = rng.randrange(0, 40), rng.randrange(100, 150)
        side = "".join(rng.choice("ab") for _ in range(rng.randrange(0, 30)))
        texts.append(side + core[a:b] + side[::-1])
    texts += ["ab" * 200, "ab" * 90, "é" * 120, "x" + "é" * 120, core + core]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def removed(docs, **limits):
    out = sd._removed(sd._keyed(docs), [], False, **limits)
    return sorted((str(r._id), r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect())


def test_edges_of_repeats(spark):
    docs = tricky(spark)
    for bucket_rows in (1000, 2):  # the second counts strings instead of collecting large buckets
        got = removed(docs, min_bytes=60, gram=16, cell=8, bucket_rows=bucket_rows)
        assert got == [(i, *rest) for i, _, *rest in expected(docs.collect(), 60)]


def test_groups_hold_all_occurrences_of_equal_bytes(spark):
    docs = tricky(spark)
    data = {r.doc_id: r.text.encode() for r in docs.collect()}
    groups = {}
    for r in sd.repeats(docs, min_bytes=60, gram=16, cell=8).collect():
        assert r.stop - r.start >= 60
        groups.setdefault(r.group, []).append(data[r.doc_id][r.start : r.stop])
    assert groups and all(len(set(g)) == 1 for g in groups.values())


def test_interval_tree_reports_left_diverse_groups():
    members = [(b"xa", b"pq"), (b"ya", b"pr"), (b"za", b"pq")]
    found = list(sd.maximal_repeats(members, cell=4, core_bytes=10, min_bytes=13))
    # "a" + core + "p" is common to all, "a" + core + "pq" to two; left of "a" they differ.
    sizes = {(length, tuple(sorted(m for m, _ in places))) for length, places in found}
    assert (13, (0, 2)) in sizes or (12, (0, 1, 2)) in sizes


def test_columns_stay(odd):
    out = sd.without_repeats(odd, min_bytes=200, drop_emptied=True)
    assert out.columns == odd.columns and out.dtypes == odd.dtypes
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    left = {}
    for (i, t), x in zip(rows, repeated([t for _, t in rows], 200)):
        if not x[0] or x[3].strip():
            left.setdefault(str(i), []).append(x[3].decode("utf-8", "ignore"))
    got = {}
    for r in out.collect():
        got.setdefault(str(r.doc_id), []).append(r.text or "")
        assert (r.rest, r._id, r.n_chars or 0) == ("r", 9, len(r.text or ""))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in left.items()}


def test_copies_of_a_row_cost_their_number(spark):
    """Rows equal in id and text, beside a text that shares a part of them: every copy goes, and cells grow
    with the copies, not with their square."""
    part = " ".join(f"shared passage number {i}" for i in range(40))
    docs = [(5, f"begin {part} end")] * 40 + [(None, f"begin {part} end")] * 3 + [(6, f"other {part} close"), (7, "x" * 900)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = sd.query(frame).collect()
    assert outcome(rows) == expected(frame.collect(), sd.MIN_BYTES)


def test_merged_spans_match_a_plain_merge():
    rng = np.random.default_rng(4)
    rows = [[{"start": int(s), "stop": int(s + n)} for s, n in zip(rng.integers(0, 300, k), rng.integers(1, 40, k))] for k in (5, 0, 30, 1, 200)]
    rows = [*rows, None, rows[0], []]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    first, start, stop = sd._merged(pa.array([None, *rows], kind).slice(1))
    for i, spans in enumerate(rows):
        covered = sorted({p for x in spans or () for p in range(x["start"], x["stop"])})
        runs = [(a, b) for a, b in zip(start[first[i] : first[i + 1]], stop[first[i] : first[i + 1]])]
        assert sorted(p for a, b in runs for p in range(a, b)) == covered
        assert all(b < a for (_, b), (a, _) in zip(runs, runs[1:]))
