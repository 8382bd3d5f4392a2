import hashlib
import re

import pandas as pd
from pyspark.sql import functions as F
from llm_fixtures import none, odd, small  # noqa: F401
from npxkit.llm import winnowing as wn


def tokens(text):
    return [t for run in re.findall("[^\x20\x09-\x0d]+", text or "") for t in ([run] if len(run) <= wn.WORD else run)]


def test_fingerprints_match_a_plain_scan(spark):
    texts = ["", None, " \n", "a", "a b", "a b c d e f g h i", "a " * 60, "x" * 300, "ab" * 50, "é" * 900, "a " + "y" * wn.WORD + " " + "z" * (wn.WORD + 1) + " b", "\U0001f600" * 70]
    texts += [" ".join(f"w{(i * i) % 37}" for i in range(n)) for n in (5, 12, 40, 700)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = df.select("i", wn.fingerprint(F.col("text")).alias("fp")).collect()
    grams = []
    for i, t in enumerate(texts):
        w = tokens(t)
        grams += [(i, n, *(w[n : n + wn.K] + [None] * wn.K)[: wn.K]) for n in range(max(1, len(w) - wn.K + 1)) if w]
    hashed = spark.createDataFrame(pd.DataFrame(grams, columns=["i", "n", "a", "b", "c"]))
    hashed = hashed.select("i", "n", F.xxhash64("a", "b", "c").bitwiseAND(F.lit(0xFFFFFFFF)).alias("h")).toPandas().sort_values(["i", "n"])
    for r in rows:
        h = hashed[hashed.i == r.i].h.tolist()
        chosen = set()
        for s in range(max(1, len(h) - wn.W + 1) if h else 0):
            window = h[s : s + wn.W]
            low = min(window)
            chosen.add((low, s + max(j for j, x in enumerate(window) if x == low)))
        assert [(x.hash, x.pos) for x in r.fp] == sorted(chosen, key=lambda x: x[1])


def check(rows, docs):
    docs = sorted(((r.doc_id, r.text or "") for r in docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert len(rows) == len(docs)
    expected = []
    for n, (i, t) in enumerate(docs):
        half = len(t) // 2
        edited = t[: len(t) - half] + docs[(n + 1) % len(docs)][1][:half]
        expected.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in rows) == sorted(expected)
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1)


def plain_likeness(spark, texts):
    """Jaccard of the sets of chosen hashes, from the fingerprints as Spark gives them."""
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return {r.i: r.fp for r in df.select("i", wn.fingerprint(F.col("text")).alias("fp")).collect()}


def test_edited_texts_and_likeness(small, spark):
    rows = wn.query(small).collect()
    check(rows, small.collect())
    docs = sorted(((r.doc_id, r.text or "") for r in small.collect()))
    n = len(docs)
    edited = [t[: len(t) - len(t) // 2] + docs[(i + 1) % n][1][: len(t) // 2] for i, (_, t) in enumerate(docs)]
    fps = plain_likeness(spark, [t for _, t in docs] + edited)
    place = {r.doc_id: r for r in rows}
    for i, (doc_id, _) in enumerate(docs):
        r, own, new, other = place[doc_id], fps[i], fps[n + i], fps[(i + 1) % n]
        sets = [{x.hash for x in f} for f in (own, new, other)]
        for got, a in ((r.near_edited, sets[1]), (r.near_next, sets[2])):
            assert got == (len(sets[0] & a) / len(sets[0] | a) if sets[0] | a else 1.0)
        assert (r.n_places, r.unedited_places) == (len(own), len(set(own) & set(new)))
    by_text = {}
    text = {r.doc_id: r.text for r in small.collect()}
    for r in rows:
        assert by_text.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint


def test_odd_rows(odd, none):
    check(wn.query(odd).collect(), odd.collect())
    assert wn.query(none).count() == 0


def test_shared_tokens_share_a_hash(spark):
    shared = " ".join(f"s{i}" for i in range(wn.W + wn.K - 1))
    df = spark.createDataFrame([(f"a b c {shared} d e", f"q r {shared} t")], "a string, b string")
    row = df.select(F.array_intersect(wn.hash_set(F.col("a")), wn.hash_set(F.col("b"))).alias("both")).first()
    assert row.both


def test_an_inserted_character_changes_its_surroundings_only(spark):
    for alphabet in ("的一是不了人我在有他这为之大来以个中上们", "abcdefghijklmnopqrstuvwxyz0123456789+/"):
        text = "".join(alphabet[(i * i * 7 + i // 3) % len(alphabet)] for i in range(900))
        fps = plain_likeness(spark, [text, text[:300] + "#" + text[300:]])
        a, b = ({(x.hash, x.pos) for x in fps[i]} for i in (0, 1))
        assert {x for x in a if x[1] < 300 - wn.K - wn.W} <= b
        assert {(h, p + 1) for h, p in a if p > 300 + wn.W} <= b


def test_edited_texts_equal_duckdb(spark):
    """``n_chars`` and ``edited_sha256`` of the whole small table by plain SQL."""
    import duckdb

    path = "/root/testdata/sf0.001/documents.parquet"
    sql = f"""
    with d as (select doc_id, coalesce(text, '') t from '{path}'),
    e as (select *, coalesce(lead(t) over (order by doc_id), first(t) over (order by doc_id)) nxt, length(t) n from d)
    select doc_id, n, sha256(substring(t, 1, n - n // 2) || substring(nxt, 1, n // 2)) from e order by doc_id"""
    got = wn.query(spark.read.parquet(path)).orderBy("doc_id").select("doc_id", "n_chars", "edited_sha256").collect()
    assert [tuple(r) for r in got] == duckdb.sql(sql).fetchall()
