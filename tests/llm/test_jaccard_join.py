import pytest
from brute import components, jaccard_components, shingles
from llm_fixtures import none, odd, small  # noqa: F401
from npxkit.llm import jaccard_join as jj


def check(rows, docs, words, percent):
    sizes, component = jaccard_components([(r.doc_id, r.text) for r in docs], words, percent)
    assert {r.doc_id: r.n_shingles for r in rows} == sizes
    assert {r.doc_id: r.component_id for r in rows} == component


@pytest.mark.parametrize("words, percent", [(4, 85), (5, 80)])
def test_components_match_all_pairs(small, words, percent):
    check(jj.classes(small, words, percent).collect(), small.collect(), words, percent)


def test_threshold_is_inclusive(spark):
    # 17 of 20 shingles: exactly 85 %.
    base = [f"w{i}" for i in range(23)]
    at = " ".join(base[:20] + ["x", "y", "z"][:0])
    texts = [" ".join(base), at, " ".join(base[:19]), "w0 w1", "W0 w1", "w0 w1 w2", ""]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    assert len(shingles(texts[0], 4)) == 20 and len(shingles(at, 4)) == 17
    check(jj.query(docs).collect(), docs.collect(), 4, 85)


def test_odd_rows(odd, none):
    rows = jj.query(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[2].component_id == 1 and by_id[1].component_id == 1
    assert by_id[3].n_shingles == by_id[4].n_shingles == by_id[5].n_shingles == 0
    assert all(by_id[i].component_id == i for i in (3, 4, 5, 6, 7, 12))
    assert all(r.component_id is None for r in rows if r.doc_id is None and not r.n_shingles)
    assert jj.query(none).count() == 0


def test_frequent_shingles_lose_no_links(spark):
    shared = " ".join(f"s{i}" for i in range(40))
    texts = [f"{shared} tail{i} a{i} b{i}" for i in range(30)] + [f"{shared} " + " ".join(f"q{i}{j}" for j in range(40)) for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(jj.query(docs).collect(), docs.collect(), 4, 85)


def near_copies(n):
    """A crowd whose texts have two to seven words of their own: some link, some with nothing."""
    base = [f"c{i}" for i in range(90)]
    texts = []
    for i in range(n):
        words = list(base)
        for j in range(2 + i % 6):
            words[(i * 7 + j * 13) % 90] = f"x{i}y{j}"
        texts.append(" ".join(words))
    return texts


def test_crowds_in_small_blocks_lose_no_links(spark, monkeypatch):
    monkeypatch.setattr(jj, "CROWD_ROWS", 16)
    monkeypatch.setattr(jj, "CROWD_SHINGLES", 900)
    monkeypatch.setattr(jj, "HUBS", 3)
    docs = spark.createDataFrame(list(enumerate(near_copies(90))), "doc_id long, text string")
    check(jj.query(docs).collect(), docs.collect(), 4, 85)


def test_pairs_of_a_crowd_are_not_generated(spark, monkeypatch):
    """Near copies that link and such that do not are settled in blocks: no pair is left to the join."""
    left, plain = [], jj.candidates

    def counted(members, percent):
        out = plain(members, percent)
        left.append(out.count())
        return out

    monkeypatch.setattr(jj, "candidates", counted)
    docs = spark.createDataFrame(list(enumerate(near_copies(200))), "doc_id long, text string")
    check(jj.query(docs).collect(), docs.collect(), 4, 85)
    assert left == [0]


def in_many_blocks(monkeypatch):
    """Blocks of a few documents; the largest number of rows of a shingle that is left to the join goes to the list."""
    most, plain = [], jj.candidates

    def watched(members, percent):
        most.append(members.groupBy("h").count().agg({"count": "max"}).first()[0] or 0)
        return plain(members, percent)

    monkeypatch.setattr(jj, "candidates", watched)
    monkeypatch.setattr(jj, "CROWD_ROWS", 16)
    monkeypatch.setattr(jj, "HUBS", 2)
    monkeypatch.setattr(jj, "FACING", 7, raising=False)
    return most


def test_blocks_of_a_crowd_meet_instead_of_their_pairs(spark, monkeypatch):
    """Documents of unlike blocks that link with nothing made a row for each pair and shingle in the join."""
    most = in_many_blocks(monkeypatch)
    docs = spark.createDataFrame(list(enumerate(near_copies(200))), "doc_id long, text string")
    check(jj.query(docs).collect(), docs.collect(), 4, 85)
    assert len(most) == 1 and most[0] < jj.CROWD


def test_meetings_take_all_texts_of_a_repeated_id(spark, monkeypatch):
    most = in_many_blocks(monkeypatch)
    texts = near_copies(120)
    rows = [(i // 2, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, None)]
    sets = [(i, shingles(t, 4)) for i, t in rows if i is not None]
    links = [(a, b) for n, (a, x) in enumerate(sets) for b, y in sets[n + 1 :] if 100 * len(x & y) >= 85 * len(x | y)]
    found = jj.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = components({i for i, _ in sets}, links)
    assert len(found) == len(rows) and most[0] < jj.CROWD
    assert all(r.component_id == expected[r.doc_id] for r in found if r.doc_id is not None)


def test_unlike_documents_of_a_crowd_send_no_texts(spark, monkeypatch):
    """Documents of two lines each share every line with many others and link with few: texts went to all blocks that they faced."""
    sent, plain = [], jj._sent

    def counted(routes, texts):
        sent.append(routes.count())
        return plain(routes, texts)

    in_many_blocks(monkeypatch)
    monkeypatch.setattr(jj, "_sent", counted)
    lines = [" ".join(f"l{i}w{j}" for j in range(12)) for i in range(14)]
    texts = [f"{a} {b}" for a in lines for b in lines if a != b] + [f"{lines[0]} {lines[1]} x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(jj.query(docs).collect(), docs.collect(), 4, 85)
    assert sum(sent) < 20


def test_marks_keep_all_that_link(spark, monkeypatch):
    """Blocks of a few rows, cut groups of pairs: links of every size are found."""
    monkeypatch.setattr(jj, "MARKED_ROWS", 8)
    monkeypatch.setattr(jj, "GROUP_DOCS", 4)
    monkeypatch.setattr(jj, "FEW", 1000)
    texts = near_copies(60) + [" ".join(f"w{i}" for i in range(n)) for n in range(20, 70)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(jj.query(docs).collect(), docs.collect(), 4, 85)
