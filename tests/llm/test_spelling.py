import collections
import re
import zlib

import numpy as np
from llm_fixtures import none, odd, small  # noqa: F401
from npxkit.llm import spelling as sp


def one_edit(a, b):
    """Exactly one inserted, deleted or replaced code point, by trying them."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_counts(docs):
    n = collections.Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def plain(n, near=None):
    words = sorted(n)
    near = near or {w: [x for x in words if x != w and one_edit(w, x)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def check(df, n):
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}
    assert got == plain(n)


def test_words_and_forms_match_a_plain_scan(small):
    rows = small.where("length(text) < 1500")
    n = plain_counts((r.doc_id, r.text) for r in rows.collect())
    assert {r.word: r.n for r in sp.word_counts(rows).collect()} == n
    check(sp.query(rows), n)


def test_odd_rows(odd, none):
    check(sp.query(odd.unionAll(odd)), plain_counts((r.doc_id, r.text) for r in odd.unionAll(odd).collect()))
    assert sp.query(none).count() == 0


def edited(rng, w):
    at, c = int(rng.integers(0, len(w))), "abé"[rng.integers(0, 3)]
    return (w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :], w + c)[rng.integers(0, 4)]


def test_edits_at_every_place_and_hot_halves(spark, monkeypatch):
    """Words with one common beginning or end, cut into many blocks, and long chains of edits."""
    monkeypatch.setattr(sp, "BLOCK", 16)
    monkeypatch.setattr(sp, "TILE", 8)
    rng = np.random.default_rng(3)
    words = {"common" + "".join(rng.choice(list("ab"), 6)) for _ in range(60)}
    words |= {"".join(rng.choice(list("ab"), 5)) + "ending" for _ in range(30)}
    words |= {"straße", "漢字漢字漢字漢", "漢字漢字漢字漢漢"}
    for _ in range(3):
        words |= {edited(rng, w) for w in list(words)}
    n = {w: int(rng.choice([2, 3, 25, 300, 5000])) for w in sorted(words)}
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    check(sp.forms(df), n)


def test_chains_end_at_their_root(spark):
    chain = ["aaaaaaaa", "aaaaaaab", "aaaaaabb", "aaaaabbb", "aaaabbbb", "aaabbbbb", "aabbbbbb"]
    n = {w: 2 * 10**i for i, w in enumerate(chain)}
    n["aaaaaaac"] = 2  # a tie of counts below
    n["xaaaaaab"] = 20
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    check(sp.forms(df), n)
    assert {r.root for r in sp.forms(df).collect() if r.word in chain} == {"aabbbbbb"}


def test_oracle_agrees(spark):
    from oracle import compare, duck

    sf = "/root/testdata/sf0.001"
    from npxkit.llm.queries import ORACLE, QUERIES

    ok, rows, _, detail = compare(spark, duck(sf), sf, "op12_spelling", QUERIES["op12_spelling"], ORACLE["op12_spelling"])
    assert ok and rows, detail
