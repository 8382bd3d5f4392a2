import numpy as np
import pytest
from llm_fixtures import none, odd  # noqa: F401
from npxkit.llm import license_scan as ls

TEMPLATES = [("short", "Released under the Foo License."), ("long", " ".join(f"term{i % 17} word{i}" for i in range(40)))]


def hashes(text):
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    _, _, first, h = ls._word_hashes(data, np.array([0, len(data)]))
    return h, first


def plain_best(template, text):
    """Best coverage over all alignments, without candidates or a band."""
    a, b = hashes(template)[0], hashes(text)[0]
    return ls.align(a, b, -len(a), len(b))[0] / len(a) if len(b) else 0.0


def edited(n):
    words = TEMPLATES[1][1].split()
    return " ".join(w for i, w in enumerate(words) if i % 9 != n % 9)


@pytest.mark.parametrize(
    "text",
    [
        "some text. Released under the Foo License. more",
        "RELEASED, under: the foo license",
        "released under another license",
        "released under the",
        "lead in " + TEMPLATES[1][1] + " lead out",
        "x y " + edited(3) + " z",
        "x y " + edited(7) + " z " + edited(2),
        "nothing at all",
    ],
)
def test_scan_agrees_with_full_alignment(text):
    index = ls.Index.build(TEMPLATES)
    h, first = hashes(text)
    found = {index.names[t]: c for _, t, c, *_ in reversed(ls.matches_of(h, first, index, 0.8))}
    for name, template in TEMPLATES:
        best = plain_best(template, text)
        assert (name in found) == (best >= 0.8)
        if name in found:
            assert found[name] == pytest.approx(best)


def test_spans_and_repeats(spark):
    line = "Released under the MIT License."
    texts = [(1, f"é {line} middle words here {line}"), (2, line), (2, line), (None, line), (3, None), (4, ""), (5, ("pad " * 50 + line + " ") * 200)]
    df = spark.createDataFrame([(*t, "t", 1.0) for t in texts], "doc_id long, text string, template string, coverage double")
    rows = ls.scan(df).collect()
    spans = sorted((r.start_char, r.end_char) for r in rows if r.doc_id == 1)
    text = texts[0][1]
    assert [text[a:b] for a, b in spans] == ["Released under the MIT License"] * 2
    count = lambda i: sum(r.doc_id == i for r in rows)
    assert (count(2), count(None), count(3), count(4), count(5)) == (2, 1, 0, 0, 200)
    assert all(r.coverage == 1 and r.matched_words == 5 for r in rows)


def test_odd_rows(odd, none):
    assert {r.doc_id for r in ls.query(odd).collect()} == {11}
    assert ls.query(none).count() == 0
    assert ls.scan(odd, []).count() == 0


def named(index, text):
    h, first = hashes(text)
    return [index.names[t] for _, t, *_ in ls.matches_of(h, first, index, ls.MIN_COVERAGE)]


def test_every_notice_goes_by_its_own_name():
    index = ls.Index.build(ls.TEMPLATES)
    for name, text, *_ in ls.TEMPLATES:
        assert named(index, f"some words before {text} and some after") == [name]


def test_one_changed_or_missing_word_is_found():
    for name, text, *keys in ls.TEMPLATES:
        words = text.split()
        if len(words) > 20:
            continue
        index = ls.Index.build([(name, text)])
        for i in range(len(words)):
            for new in ([], ["changed"]):
                edit = " ".join([*words[:i], *new, *words[i + 1 :]])
                # A written word such as "4.0" or "BY-NC" is several words of the scan.
                assert (named(index, f"pad {edit} pad") == [name]) == (plain_best(text, edit) >= ls.MIN_COVERAGE)


@pytest.mark.parametrize(
    "text, names",
    [
        ("Released under a MIT License.", ["MIT (line)"]),
        ("Released under the Foo License.", []),
        ("This work is licensed under the GNU General Public License, version 1.", []),
        ("Licensed under CC BY 3.0.", []),
        ("Released under the MIT License. Licensed under CC BY-SA 4.0.", ["MIT (line)", "CC-BY-SA-4.0 (short)"]),
    ],
)
def test_names_and_versions(text, names):
    assert named(ls.Index.build(ls.TEMPLATES), text) == names


def test_overlaps_of_a_long_row_of_notices():
    index = ls.Index.build(ls.TEMPLATES)
    line = "Licensed under the Apache License, Version 2.0."
    assert named(index, f"{line} filler " * 300) == ["Apache-2.0 (line)"] * 300
