"""Toxicity scores: a linear classifier of character n-grams scaled by naive Bayes log-count
ratios, trained on labelled text.

Features are the n-grams of 4, 6 and 8 code points (ASCII case ignored), hashed to 2^18 buckets;
a value is the logarithm of one plus the n-gram's count. On a bounded, repeatable sample of the
labelled rows (``FIT_ROWS``), documents with each n-gram are counted by class; the ``FEATURES``
n-grams that tell the classes apart best are kept, and a logistic regression is fitted on them,
each scaled by its log-count ratio. Every whole text is then scored in one pass over the table.

Nulls: a null text is empty; an empty text gets the score of no features. Labels that are null
are not learned from; repeated labels count once, 1 if any is 1. Repeated rows are scored alike.
Without labels of both classes every score is the (smoothed) share of class 1. An empty table gives
an empty result. Only ``doc_id``, ``text`` and the label are read; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import materialize
from .hashed_text import BITS, Sparse, bounded_sample, counted, descend, gathered, grams, one_text_each, sigmoid, sums
from .textbytes import slices

SIZES = (4, 6, 8)
FIT_ROWS = 8192
FEATURES = 4096
FOLDS = 5
_SEEN = ["label", "key", "buckets", "counts"]
_SEEN_TYPES = "label int, key long, buckets array<int>, counts array<int>"


@dataclass
class Model:
    weight: np.ndarray  # by bucket
    bias: float


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, buf, off in slices(batch, "text"):
            doc, bucket, n = counted(grams(buf, off, SIZES))
            at = pa.array(np.searchsorted(doc, np.arange(rows.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(v.astype(np.int32))) for v in (bucket, n)]
            yield pa.RecordBatch.from_arrays([rows.column("label"), rows.column("key"), *lists], names=_SEEN)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """``labels``: (doc_id, label), of the rows to learn from. What reaches the driver is bounded:
    counts of the kept n-grams, and the sample's kept n-grams."""
    known = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    sample = bounded_sample(known, "doc_id", FIT_ROWS)
    rows = materialize(one_text_each(docs, sample, "label").mapInArrow(_features, _SEEN_TYPES))
    weight = np.zeros(1 << BITS)
    totals = dict(rows.groupBy("label").count().collect())
    n1, n0 = totals.get(1, 0), sum(n for k, n in totals.items() if k != 1)
    bias = float(np.log((n1 + 0.5) / (n0 + 0.5)))
    if not n1 or not n0:
        return Model(weight, bias if n1 + n0 else -35.0)

    is_one = F.when(F.col("label") == 1, 1).otherwise(0)
    by_gram = rows.select(is_one.alias("one"), F.explode("buckets").alias("b")).groupBy("b")
    by_gram = by_gram.agg(F.sum("one").alias("one"), F.count(F.lit(1)).alias("n"))
    p = (F.col("one") + 1) / F.lit(float(n1 + 2))
    q = (F.col("n") - F.col("one") + 1) / F.lit(float(n0 + 2))
    pooled = (F.col("n") + 2) / F.lit(float(n1 + n0 + 4))
    apart = F.abs(p - q) / F.sqrt(pooled * (1.0000001 - pooled))
    best = by_gram.withColumn("ratio", F.log(p / q)).orderBy(apart.desc(), "b").limit(FEATURES).select("b", "ratio").collect()
    ratio = np.zeros(1 << BITS)
    ratio[[r.b for r in best]] = [r.ratio for r in best]
    column = np.full(1 << BITS, -1)
    column[[r.b for r in best]] = np.arange(len(best))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = column[batch.column(2).flatten().to_numpy(zero_copy_only=False)]
            n = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), batch.column(2).value_lengths().to_numpy(zero_copy_only=False))[flat >= 0]
            at = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(v[flat >= 0].astype(np.int32))) for v in (flat, n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *lists], names=_SEEN)

    label, lengths, buckets, n = gathered(rows.mapInArrow(kept, _SEEN_TYPES), "label", ("buckets", "counts"))
    y = (label == 1).astype(float)
    scale = np.array([r.ratio for r in best])
    x = Sparse(lengths, buckets, (np.log2(1 + n) * scale[buckets]).astype(np.float32), len(best))

    def gradient(wb: np.ndarray) -> np.ndarray:
        g = (sigmoid(x.dot(wb[:-1]) + wb[-1]) - y) / len(y)
        return np.append(x.back(g) + 1e-4 * wb[:-1], g.sum())

    wb = descend(gradient, np.append(np.zeros(len(best)), bias), 200, 0.02)
    weight[[r.b for r in best]] = wb[:-1] * scale
    return Model(weight, float(wb[-1]))


def _score(model: Model):
    active = model.weight != 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, off in slices(batch, "text"):
                doc, bucket, n = counted(grams(buf, off, SIZES), active)
                z = sums(doc, np.log2(1 + n) * model.weight[bucket], rows.num_rows) + model.bias
                keep = [c for c in rows.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), pa.array(sigmoid(z))], names=[*keep, "score"])

    return run


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_score(model), f"doc_id {kind}, score double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    learn = labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label"))
    out = scores(docs, fit(docs, learn))
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
