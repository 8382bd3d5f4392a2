"""Licence scans: winnowed fingerprints pick candidates, banded alignment reports what matches.

Words are runs of ASCII letters, digits and bytes of other characters, in lower case. The
templates' word grams are winnowed (smallest hash of a few neighbours, rightmost on a tie) into an
inverted index (hash -> template and position). A template of n words that may miss e of them keeps
a run of at least ceil((n - e) / (e + 1)) words whatever words are missing or replaced; grams have at
most ``GRAM`` words and windows at most ``WINDOW`` grams, and both are smaller for a short template,
so that such a run always holds a chosen gram. (Words put in between can break the runs further.)
Each text's grams are looked up; hits of a template that lie near one diagonal (position in the text
less position in the template) are a candidate, unless too few words of the template are near. A
local alignment within a band around the diagonals of its hits gives the matched words: coverage is
their share of the template, the span reaches from the first to the last. A template may name words
that the span must hold, such as a version. Of matches in the same place (one holds the middle word
of the other) the one of best score is reported, so a notice goes by the name of the nearest licence.

The templates are a small list held by every task; ``TEMPLATE_WORDS`` bounds their total length.

Nulls: a null text is empty, and an empty text matches nothing. A null id is kept. Whole texts are
scanned, whatever their length; a text that holds a notice many times reports each. Repeated rows
report alike. Ties between alignments go to the earliest end, between matches to the larger coverage,
the earlier start, the earlier template. An empty table, or no templates, gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_templates import TEMPLATES
from .textbytes import Hasher, mix, slices, window_argmin, words

GRAM = 3
WINDOW = 2
MIN_COVERAGE = 0.8
TEMPLATE_WORDS = 200_000
_U = np.uint64
# Document, template, coverage, matched words, first and last word, score.
Match = tuple[int, int, float, int, int, int, int]

_BREAK = np.ones(256, dtype=bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_BREAK[128:] = False


def _word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    s, e, first = words(buf, off, _BREAK)
    return s, e, first, Hasher(buf, 0, lower=True).span(s, e) if len(s) else np.zeros(0, _U)


def _grams(h: np.ndarray, size: int) -> np.ndarray:
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, dtype=_U)
    for i in range(size):
        out = mix(out + h[i : i + n])
    return out


def _least(n: int, min_coverage: float) -> int:
    """Words of ``n`` that a match must have."""
    return max(1, ceil(min_coverage * n - 1e-9))


@dataclass
class Index:
    """Templates' words, the words a match must hold, and the winnowed grams of each size sorted by hash."""

    names: list[str]
    words: list[np.ndarray]
    keys: list[np.ndarray]
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def build(cls, templates: Sequence[tuple[str, ...]], min_coverage: float = MIN_COVERAGE) -> Index:
        index = cls([], [], [], {})
        chosen: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for name, *texts in templates:
            own, *keys = (_word_hashes(x, np.array([0, len(x)]))[3] for x in (np.frombuffer(t.encode(), dtype=np.uint8) for t in texts))
            if not len(own):
                continue
            least = _least(len(own), min_coverage)
            run = -(-least // (len(own) - least + 1))
            size = min(GRAM, run)
            grams = _grams(own, size)
            at = np.unique(window_argmin(grams, min(WINDOW, run - size + 1, len(grams))))
            chosen.setdefault(size, []).append((grams[at], np.full(len(at), len(index.names)), at))
            index.names.append(name)
            index.words.append(own)
            index.keys.append(np.concatenate([np.zeros(0, _U), *keys]))
        if sum(map(len, index.words)) > TEMPLATE_WORDS:
            raise ValueError(f"templates hold more than {TEMPLATE_WORDS} words")
        for size, parts in chosen.items():
            h, t, a = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            index.grams[size] = h[order], t[order], a[order]
        return index

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(position in the text, words of the gram, template, position in the template)."""
        out = [(np.zeros(0, np.int64),) * 4]
        for size, (known, template, at) in self.grams.items():
            grams = _grams(words, size)
            if not len(grams):
                continue
            low = np.searchsorted(known, grams, side="left")
            found = np.flatnonzero(known[np.minimum(low, len(known) - 1)] == grams)
            low, high = low[found], np.searchsorted(known, grams[found], side="right")
            n = high - low
            entry = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            out.append((np.repeat(found, n), np.full(len(entry), size), template[entry], at[entry]))
        return tuple(np.concatenate(x) for x in zip(*out))


def align(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int, int]:
    """Local alignment within the diagonals ``low..high``: (matched words, first and last matched
    position in ``text``, score). A match scores 2; a word against another word, or against none, -1."""
    m, n, width = len(template), len(text), high - low + 1
    before = [(0, 0, -1, -1)] * (width + 1)  # score, matches, first, last
    best = (0, 0, -1, -1)
    for i in range(m):
        row: list[tuple[int, int, int, int]] = []
        left = (0, 0, -1, -1)
        word = template[i]
        for k in range(width):
            j = i + low + k
            if j < 0 or j >= n:
                left = (0, 0, -1, -1)
                row.append(left)
                continue
            score, matches, first, last = before[k]  # one word less of both
            if text[j] == word:
                cell = (score + 2, matches + 1, j if first < 0 else first, j)
            else:
                cell = (score - 1, matches, first, last)
            up = before[k + 1]  # a word of the template against none
            for other in (up, left):
                if other[0] - 1 > cell[0]:
                    cell = (other[0] - 1, *other[1:])
            if cell[0] <= 0:
                cell = (0, 0, -1, -1)
            row.append(cell)
            left = cell
            if cell[0] > best[0]:
                best = cell
        row.append((0, 0, -1, -1))
        before = row
    return best[1], best[2], best[3], best[0]


def _candidates(pos: np.ndarray, template: np.ndarray, at: np.ndarray, doc: np.ndarray, index: Index) -> Iterator[tuple[int, int, int, int]]:
    """(document, template, lowest and highest diagonal) of groups of hits."""
    size = np.array([len(w) for w in index.words])[template]
    band = 4 + size // 8
    diagonal = pos - at
    order = np.lexsort((diagonal, template, doc))
    doc, template, diagonal, band = (x[order] for x in (doc, template, diagonal, band))
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (template[1:] != template[:-1]) | (diagonal[1:] - diagonal[:-1] > band[1:])
    cuts = np.append(np.flatnonzero(new), len(doc))
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(doc[a]), int(template[a]), int(diagonal[a]), int(diagonal[b - 1])


def _nearest(found: list[Match]) -> Iterator[Match]:
    """Of one document's matches in the same place, the one of best score; in order of place."""
    middles: list[int] = []
    kept: list[Match] = []
    for x in sorted(found, key=lambda x: (-x[6], -x[2], x[4], x[1])):
        a, b = x[4], x[5]
        middle = (a + b) // 2
        # No kept span holds another's middle, so their starts, middles and ends come in the same order.
        i = bisect_left(middles, middle)
        near = range(max(i - 1, 0), min(i + 1, len(kept)))
        if not any(kept[k][4] <= middle <= kept[k][5] or a <= middles[k] <= b for k in near):
            middles.insert(i, middle)
            kept.insert(i, x)
    yield from kept


def matches_of(h: np.ndarray, first: np.ndarray, index: Index, min_coverage: float) -> list[Match]:
    """The matches of a buffer's documents, by document and place."""
    pos, size, template, at = index.hits(h)
    doc = np.searchsorted(first, pos, side="right") - 1
    inside = pos + size <= first[doc + 1] if len(pos) else np.zeros(0, bool)
    pos, template, at, doc = pos[inside], template[inside], at[inside], doc[inside]
    found: dict[int, list[Match]] = {}
    if not len(pos):
        return []
    for d, t, low, high in _candidates(pos, template, at, doc, index):
        own = index.words[t]
        band = 4 + len(own) // 8
        # The words that the band can reach, cut to the document.
        begin = max(int(first[d]), low - band)
        end = min(int(first[d + 1]), high + band + len(own) + 1)
        least = _least(len(own), min_coverage)
        if np.isin(h[begin:end], own).sum() < least:
            continue  # too few of the template's words for any alignment
        n, a, b, score = align(own, h[begin:end], low - band - begin, high + band - begin)
        if n >= least and np.isin(index.keys[t], h[begin + a : begin + b + 1]).all():
            found.setdefault(d, []).append((d, t, n / len(own), n, begin + a, begin + b, score))
    return [x for d in sorted(found) for x in _nearest(found[d])]


def _scan(index: Index, min_coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, off in slices(batch, "text"):
                s, e, first, h = _word_hashes(buf, off)
                found = matches_of(h, first, index, min_coverage)
                if not found:
                    continue
                doc, template, coverage, n, a, b, _ = (np.array(x) for x in zip(*found))
                chars = np.append(0, np.cumsum((buf & 0xC0) != 0x80))
                base = chars[off[doc]]
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id").take(pa.array(doc)),
                        pa.array([index.names[t] for t in template]),
                        pa.array(coverage, pa.float64()),
                        pa.array(n, pa.int64()),
                        pa.array(chars[s[a]] - base, pa.int64()),
                        pa.array(chars[e[b]] - base, pa.int64()),
                    ],
                    names=["doc_id", "template", "coverage", "matched_words", "start_char", "end_char"],
                )

    return run


def scan(docs: DataFrame, templates: Sequence[tuple[str, ...]] = TEMPLATES, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row per match: document, template, coverage, matched words, span in code points.

    A template is (name, text) or (name, text, words that a match must hold)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = f"doc_id {kind}, template string, coverage double, matched_words long, start_char long, end_char long"
    return rows.mapInArrow(_scan(Index.build(templates, min_coverage), min_coverage), schema)


def query(docs: DataFrame) -> DataFrame:
    return scan(docs)
