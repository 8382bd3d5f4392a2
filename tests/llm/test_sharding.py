import zlib
from collections import defaultdict

from brute import jump
from llm_fixtures import none, odd, small  # noqa: F401
from npxkit.llm import sharding


def check(df, source):
    rows = df.collect()
    expected = sorted(((r.doc_id, r.text) for r in source.collect()), key=str)
    assert len(rows) == len(expected)
    slots = defaultdict(list)
    for r in rows:
        key = r.doc_id or 0
        assert r.shard == jump(key, 24)
        assert r.grown_shard == jump(key, 25)
        assert r.grown_shard in (r.shard, 24)
        assert r.law == "key"
        slots[r.shard].append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    sizes = sorted((r.doc_id if r.doc_id is not None else -99, r["size"], r.text_crc32) for r in rows)
    assert sizes == sorted(
        (i if i is not None else -99, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in expected
    )


def test_jump_hash_slots_and_sizes(small):
    check(sharding.query(small), small)


def test_odd_rows(odd, none):
    check(sharding.query(odd), odd)
    assert sharding.query(none).count() == 0
