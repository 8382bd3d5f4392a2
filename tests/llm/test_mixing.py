import math
from collections import defaultdict

import oracle
import pytest
from brute import WORD
from llm_fixtures import none, odd, small  # noqa: F401
from npxkit.llm import mixing


SF001 = "/root/testdata/sf0.001"


def water(sizes):
    """Targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else share[s] for s in names}
        capped |= over


def check(rows, source):
    count = lambda t: len(WORD.findall(t or ""))
    assert sorted((str(r.doc_id), r.source or "", r["size"]) for r in rows) == sorted(
        (str(r.doc_id), r.source or "", count(r.text)) for r in source
    )
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
    targets = water(dict(sizes))
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source])
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= largest[s]


def test_targets_copies_and_totals(small):
    check(mixing.query(small).collect(), small.collect())


def test_odd_rows(odd, none):
    check(mixing.query(odd).collect(), odd.collect())
    assert mixing.query(none).count() == 0


def test_reruns_agree(small):
    assert sorted(mixing.query(small).collect()) == sorted(mixing.query(small.repartition(5)).collect())


def test_oracle(spark, small):
    ok, _, _, detail = oracle.compare(spark, oracle.duck(SF001), SF001, "op3", lambda s, d: mixing.query(small), mixing.oracle_sql())
    assert ok, detail


def test_mixture_repeats_documents(odd):
    drawn = defaultdict(int)
    for r in mixing.mix(odd).collect():
        drawn[r.doc_id, r.source, r["size"]] += r.copies
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id, r.source, len(WORD.findall(r.text or ""))] += 1
        assert (r["size"], r._size, r._rank) == ("s", 3, 7)
    assert got == {k: n for k, n in drawn.items() if n}


def test_crossings_add_up():
    rate, offset = 0.37, 0.81
    copies = [math.floor((i + 1) * rate + offset) - math.floor(i * rate + offset) for i in range(1000)]
    assert abs(sum(copies) - 370) <= 1


def test_sources_are_planned_once(small):
    # The windows over sources, and the trial of the offsets, were part of every later plan.
    plan = mixing.mixed_documents(small)._jdf.queryExecution().optimizedPlan().toString()
    assert sum(x.lstrip(" :+-").startswith("Window ") for x in plan.splitlines()) == 1
    assert "md5" not in plan
