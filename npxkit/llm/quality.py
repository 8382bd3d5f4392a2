"""Quality grades: an ordinal cumulative-link regression on hashed text.

Ratings are grades 0..G. One weight vector is shared by all thresholds:
``P(grade >= g) = sigmoid(w.x - threshold_g)`` with thresholds kept in order by fitting the
logarithms of their gaps. A document gets its expected grade (the sum of its tail probabilities)
and the probability that its grade is at least ``SELECT_FROM``, by which it is selected.

Features are n-grams of code points, of the text (ASCII case ignored) and of its shape (capitals,
small letters, digits, other characters), hashed to 2^18 buckets; a value is the square root of
the n-gram's share of the document. One more feature is the share of words that repeat the word
before them. The model is fitted on a bounded, repeatable sample of
the graded ids (``FIT_ROWS``), one text each: the smallest of those under an id; the ``FEATURES`` n-grams of most documents are used. Every whole
text is scored in one pass over the table.

Nulls: a null text is empty; an empty text has no features, and its score is the thresholds'
alone. Null grades are not learned from; of repeated grades the lowest counts. Repeated rows are
scored alike. Without grades everything is selected with probability 1; if all grades are equal,
the probabilities are 0 or 1 accordingly. An empty table gives an empty result. Extra columns are
kept by ``selected``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialize
from .hashed_text import BITS, Sparse, bounded_sample, counted, descend, gathered, grams, one_text_each, sigmoid
from .textbytes import Hasher, slices, words
from .toxicity import held_out

TEXT_SIZES = (1, 3)
SHAPE_SIZES = (2, 3)
FIT_ROWS = 8192
FEATURES = 8192
SELECT_FROM = 1
SELECT_AT = 0.5
_SCALE = 10.0
ECHO = 0  # the bucket of repeated words
_TABLE_ROWS = 128
_SEEN = ["grade", "key", "buckets", "vals"]
_SEEN_TYPES = "grade int, key long, buckets array<int>, vals array<float>"


@dataclass
class Model:
    weight: np.ndarray  # by bucket
    active: np.ndarray
    thresholds: np.ndarray  # ascending; of grades 1..G


def _parts(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    yield from grams(buf, off, TEXT_SIZES)
    yield from grams(buf, off, SHAPE_SIZES, shape=True)


def _chars(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Code points of each document, 1 at least."""
    before = np.append(0, np.cumsum((buf & 0xC0) != 0x80))
    return np.maximum(np.diff(before[off]), 1)


def _echoes(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Value of the feature of repeated words, from the share of words that equal the word before."""
    s, e, first = words(buf, off)
    count = np.diff(first)
    if not len(s):
        return np.zeros(len(count))
    h = Hasher(buf, 0, lower=True).span(s, e)
    same = np.append(0, np.cumsum(np.append(False, h[1:] == h[:-1])))
    # The first word of a document has none before it.
    echoes = np.where(count > 1, same[first[1:]] - same[np.minimum(first[:-1] + 1, len(s))], 0)
    return _SCALE * np.sqrt(echoes / np.maximum(count - 1, 1))


def _values(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, value) of all features, by document."""
    doc, bucket, n = counted(_parts(buf, off))
    other = bucket != ECHO
    doc, bucket = doc[other], bucket[other]
    value = _SCALE * np.sqrt(n[other] / _chars(buf, off)[doc])
    rows = np.arange(len(off) - 1)
    doc, bucket, value = np.append(doc, rows), np.append(bucket, np.full(len(rows), ECHO)), np.append(value, _echoes(buf, off))
    order = np.argsort(doc, kind="stable")
    return doc[order], bucket[order], value[order]


def _sums(buf: np.ndarray, off: np.ndarray, model: Model) -> np.ndarray:
    """Weighted sums of the documents' features: counts go to a dense table of a few documents by
    the model's features, which needs no sorting."""
    rows, chars = len(off) - 1, _chars(buf, off)
    column = np.full(1 << BITS, -1, dtype=np.int32)
    chosen = np.flatnonzero(model.active & (np.arange(1 << BITS) != ECHO))
    column[chosen] = np.arange(len(chosen))
    weight, width = model.weight[chosen], len(chosen)
    z = _echoes(buf, off) * model.weight[ECHO]
    if not width:
        return z
    for a in range(0, rows, _TABLE_ROWS):
        b = min(a + _TABLE_ROWS, rows)
        counts = np.zeros((b - a) * width, dtype=np.int64)
        for doc, bucket in _parts(buf[off[a] : off[b]], off[a : b + 1] - off[a]):
            at = column[bucket]
            counts += np.bincount((doc * width + at)[at >= 0], minlength=len(counts))
        held = np.flatnonzero(counts)
        totals = np.bincount(held // width, weights=np.sqrt(counts[held]) * weight[held % width], minlength=b - a)
        z[a:b] += _SCALE * totals / np.sqrt(chars[a:b])
    return z


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, buf, off in slices(batch, "text"):
            doc, bucket, value = _values(buf, off)
            at = pa.array(np.searchsorted(doc, np.arange(rows.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("grade"),
                    rows.column("key"),
                    pa.ListArray.from_arrays(at, pa.array(bucket.astype(np.int32))),
                    pa.ListArray.from_arrays(at, pa.array(value.astype(np.float32))),
                ],
                names=_SEEN,
            )


def _ordered(theta: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])]))


def _ordinal_gradient(x: Sparse, grade: np.ndarray, top: int, penalty: float):
    """Gradient of the mean negative log-likelihood of the grades, and of half the penalty on the squared
    weights, by the weights and the thresholds' parameters."""

    def gradient(p: np.ndarray) -> np.ndarray:
        w, theta = p[: x.width], p[x.width :]
        z = x.dot(w)
        cuts = _ordered(theta)
        tail = np.column_stack([np.ones(len(z)), sigmoid(z[:, None] - cuts[None, :]), np.zeros(len(z))])
        slope = tail * (1 - tail)
        rows = np.arange(len(z))
        chance = np.maximum(tail[rows, grade] - tail[rows, grade + 1], 1e-12)
        d_low, d_high = slope[rows, grade] / chance, slope[rows, grade + 1] / chance
        dz = -(d_low - d_high) / len(z)
        d_cut = np.zeros(top + 2)
        np.add.at(d_cut, grade, d_low / len(z))
        np.add.at(d_cut, grade + 1, -d_high / len(z))
        d_cut = d_cut[1:-1]
        after = np.cumsum(d_cut[::-1])[::-1]  # a gap moves all later thresholds
        d_theta = np.concatenate([after[:1], after[1:] * np.exp(theta[1:])])
        return np.concatenate([x.back(dz) + penalty * w, d_theta])

    return gradient


def _fit_ordinal(x: Sparse, grade: np.ndarray, top: int, penalty: float = 1e-4, steps: int = 250) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of the cumulative-link model with a small penalty on the weights."""
    level = np.arange(1, top + 1)
    share = np.clip([(grade >= g).mean() for g in level], 1e-3, 1 - 1e-3)
    cut = -np.log(share / (1 - share))
    cut = np.maximum.accumulate(cut + np.arange(top) * 1e-3)
    start = np.concatenate([np.zeros(x.width), cut[:1], np.log(np.maximum(np.diff(cut), 1e-3))])
    p = descend(_ordinal_gradient(x, grade, top, penalty), start, steps, 0.05)
    return p[: x.width], _ordered(p[x.width :])


def fit(docs: DataFrame, grades: DataFrame) -> Model:
    """``grades``: (doc_id, grade), of the rows to learn from. What reaches the driver is bounded by
    ``FIT_ROWS`` and ``FEATURES``."""
    known = grades.where("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    sample = bounded_sample(known, "doc_id", FIT_ROWS)
    rows = materialize(one_text_each(docs, sample, "grade").mapInArrow(_features, _SEEN_TYPES))
    most = rows.select(F.explode("buckets").alias("b")).groupBy("b").count().orderBy(F.col("count").desc(), "b").limit(FEATURES)
    chosen = np.array([r.b for r in most.select("b").collect()], dtype=np.int64)
    active = np.zeros(1 << BITS, dtype=bool)
    active[chosen] = True
    column = np.full(1 << BITS, -1)
    column[chosen] = np.arange(len(chosen))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = column[batch.column(2).flatten().to_numpy(zero_copy_only=False)]
            vals = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), batch.column(2).value_lengths().to_numpy(zero_copy_only=False))[flat >= 0]
            at = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(v)) for v in (flat[flat >= 0].astype(np.int32), vals[flat >= 0])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *lists], names=_SEEN)

    grade, lengths, feats, vals = gathered(rows.mapInArrow(kept, _SEEN_TYPES), "grade", ("buckets", "vals"))
    grade = np.maximum(grade, 0).astype(np.int64)
    weight = np.zeros(1 << BITS)
    if not len(grade):
        return Model(weight, active, np.array([-35.0]))
    top = int(grade.max())
    if top == 0:
        return Model(weight, active, np.array([35.0]))
    w, thresholds = _fit_ordinal(Sparse(lengths, feats, vals, len(chosen)), grade, top)
    weight[chosen] = w
    return Model(weight, active, thresholds)


def _grade(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, off in slices(batch, "text"):
                z = _sums(buf, off, model)
                tails = sigmoid(z[:, None] - model.thresholds[None, :])
                at = min(SELECT_FROM, len(model.thresholds)) - 1
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, at])],
                    names=[*rows.schema.names, "_expected", "_tail"],
                )

    return run


def graded(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``_expected`` (grade) and ``_tail`` (probability of a grade to select)."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns) if c != "text"}
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), F.col("text").alias("_text"), F.coalesce("text", F.lit("")).alias("text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    out = rows.mapInArrow(_grade(model), f"{kinds}, _expected double, _tail double")
    back = [F.col("_text").alias("text") if c == "text" else F.col(names[c]).alias(c) for c in docs.columns]
    return out.select(*back, "_expected", "_tail")


def grades_of(labels: DataFrame) -> DataFrame:
    """Ratings of the labels table: 0 poor, 1 well written but toxic, 2 well written."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2))
    return labels.select("doc_id", grade.alias("grade"))


def selected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier selects, unchanged."""
    out = graded(docs, fit(docs, grades_of(labels)))
    return out.where(F.col("_tail") >= SELECT_AT).select(*docs.columns)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    learn = grades_of(labels).where(~held_out(F.col("doc_id")))
    out = graded(docs.select("doc_id", "text"), fit(docs, learn))
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("_expected").alias("expected_grade"),
        F.col("_tail").alias("tail_probability"),
        (F.col("_tail") >= SELECT_AT).alias("selected"),
    )
