"""Principal components of the imputed, standardised sample x assay matrix Z (Q54-Q56).

Three routes give the same scores, shares of variance and loadings; ``route`` picks one, and by
default the shape of the matrix (n samples, p assays) does:

* ``dual`` -- n <= p and n <= ``DUAL_SAMPLES``, the usual study of few samples and a wide panel. The
  n x n Gram matrix Z Z' is the sum of blocks of assays: a task turns its assays into a dense block
  and multiplies it with itself. Its eigenvectors u give scores u sqrt(lambda) and, in a second pass
  over the blocks, loadings Z'u / sqrt(lambda). Nothing p x p exists.
* ``primal`` -- p <= ``PRIMAL_ASSAYS``: Spark ML's covariance, p x p, on the driver.
* ``subspace`` -- many samples and a panel too wide for that. A basis W of p x l (l = k + ``OVERSAMPLE``)
  is replaced by an orthogonal basis of Z'Z W, one pass over the samples each, until the leading
  residuals are within ``tolerance``. Then Z W is factored by a tall-skinny QR: each task's triangle, triangles
  stacked and factored again; the last triangle's singular vectors turn W into loadings. The
  driver holds p x l numbers.

Observed cells travel as z-scores; a missing cell's value, its assay's median, is one number per
assay, so no route writes a dense table of the cells that are not there.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import count_rows
from ..functions.stats import group_quantiles
from ..functions.vectors import sum_vectors
from ..session import materialize
from .matrix import assay_list, drop_constant_assays, imputed_vectors
from .qc import IntegrityError

DUAL_SAMPLES = 5000
PRIMAL_ASSAYS = 4096
OVERSAMPLE = 15
MAX_PASSES = 200
_CHUNK = 4096  # rows of a p x l or n x n matrix that travel as one array
_GRAM_BYTES = 1 << 31  # of all tasks' Gram matrices together


class PcaResult:
    """Scores (sample_id, pc1..pck), percent of variance per component, loadings (assay x k)."""

    def __init__(self, scores: DataFrame, variance: DataFrame, loadings: np.ndarray, assays: list[str], route: str):
        self.scores = scores
        self.variance = variance
        self.loadings = loadings
        self.assays = assays
        self.route = route

    def loadings_table(self) -> DataFrame:
        """(assay_id, component, loading), a row for each entry."""
        k = self.loadings.shape[1]
        rows = [(a, j + 1, float(v)) for a, row in zip(self.assays, self.loadings) for j, v in zip(range(k), row)]
        return self.scores.sparkSession.createDataFrame(rows, f"{S.ASSAY_ID} string, component int, loading double")


@dataclass
class Standardised:
    """Observed cells (sample_id, assay_id, z), assays (assay_id, place, z0: the z-score of a missing cell), and the
    numbers of samples and assays. ``total`` is the sum of squares of the whole matrix."""

    cells: DataFrame
    assays: DataFrame
    n: int
    p: int
    total: float


def _shape(values: DataFrame) -> tuple[int, int, int]:
    """Samples, assays and the largest number of samples of an assay; duplicate cells raise."""
    pairs = values.groupBy(S.SAMPLE_ID, S.ASSAY_ID).agg(count_rows().alias("_n"))
    per_assay = pairs.groupBy(S.ASSAY_ID).agg(count_rows().alias("_samples"), F.max("_n").alias("_dup"))
    r = per_assay.agg(count_rows().alias("p"), F.max("_samples").alias("most"), F.max("_dup").alias("dup")).first()
    if (r["dup"] or 0) > 1:
        raise IntegrityError("duplicate (sample, assay) pairs: a matrix cell would hold several values")
    return values.select(S.SAMPLE_ID).distinct().count(), int(r["p"]), int(r["most"] or 0)


def standardised(values: DataFrame, n: int, p: int, most: int) -> Standardised:
    """z-scores of (sample_id, assay_id, _v) over the matrix whose missing cells hold the assay's median.

    Mean and variance of a column follow from its observed count, mean, variance and median, so the
    matrix need not be filled to be standardised. A column without variance is zero.
    """
    v = F.col("_v")
    stats = group_quantiles(
        values,
        [S.ASSAY_ID],
        [("_v", [0.5], ["_median"])],
        extra_aggs=[F.count(v).alias("_c"), F.avg(v).alias("_avg"), F.var_pop(v).alias("_var")],
        known_max_group=most,
    )
    here, missing = F.col("_c").cast("double"), (F.lit(n) - F.col("_c")).cast("double")
    mean = (here * F.col("_avg") + missing * F.col("_median")) / F.lit(float(n))
    square = here * (F.col("_var") + F.pow(F.col("_avg") - mean, F.lit(2.0))) + missing * F.pow(F.col("_median") - mean, F.lit(2.0))
    stats = stats.select(S.ASSAY_ID, "_median", "_c", mean.alias("_mean"), F.sqrt(square / F.lit(float(max(n - 1, 1)))).alias("_sd"))
    # An all but equal column has no variance beyond rounding.
    scale = F.when(F.col("_sd") > F.lit(1e-14) * F.greatest(F.abs("_mean"), F.lit(1e-290)), F.lit(1.0) / F.col("_sd")).otherwise(F.lit(0.0))
    panel = Window.orderBy(S.ASSAY_ID)  # one row per assay: a table of the panel
    assays = materialize(
        stats.select(
            S.ASSAY_ID,
            (F.row_number().over(panel) - 1).alias("place"),
            F.col("_mean").alias("mean"),
            scale.alias("scale"),
            ((F.col("_median") - F.col("_mean")) * scale).alias("z0"),
        )
    )
    cells = values.join(assays, S.ASSAY_ID).select(S.SAMPLE_ID, S.ASSAY_ID, "place", ((v - F.col("mean")) * F.col("scale")).alias("z"))
    kept = assays.where("scale > 0").count()
    return Standardised(cells, assays.select(S.ASSAY_ID, "place", "z0"), n, p, float(kept) * max(n - 1, 1))


def _chunks(m: np.ndarray) -> Iterator[pa.RecordBatch]:
    step = max(1, _CHUNK // 16 if m.shape[1] > 256 else _CHUNK)
    for begin in range(0, len(m), step):
        yield pa.RecordBatch.from_arrays([pa.array([begin], pa.int64()), pa.array([m[begin : begin + step].ravel()])], names=["chunk", "part"])


_PARTS = "chunk long, part array<double>"


def _collected(parts: DataFrame, height: int, width: int) -> np.ndarray:
    """The sum of all tasks' matrices, added chunk by chunk by Spark."""
    out = np.zeros((height, width))
    for chunk, part in sum_vectors(parts, ["chunk"], "part").toLocalIterator():
        rows = np.array(part).reshape(-1, width)
        out[chunk : chunk + len(rows)] = rows
    return out


def _lists(batch: pa.RecordBatch, name: str, *fields: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row of each entry of a list column of structs, and the entries' fields."""
    column = batch.column(batch.schema.get_field_index(name))
    rows = np.repeat(np.arange(batch.num_rows), column.value_lengths().to_numpy(zero_copy_only=False))
    flat = column.flatten()
    return rows, [flat.field(f).to_numpy(zero_copy_only=False) for f in fields]


def _blocks(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Dense blocks of assays: a row per assay, a column per sample."""
    for batch in batches:
        step = max(1, (1 << 24) // max(n, 1))
        for begin in range(0, batch.num_rows, step):
            some = batch.slice(begin, step)
            z0 = some.column(some.schema.get_field_index("z0")).to_numpy(zero_copy_only=False)
            block = np.repeat(z0[:, None], n, axis=1)
            rows, (sample, z) = _lists(some, "cells", "sample", "z")
            block[rows, sample] = z
            yield some, block


def _signed(loadings: np.ndarray) -> np.ndarray:
    """Signs that make each component's entry of largest magnitude (the first of equal ones) positive."""
    lead = loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])]
    return np.where(lead < 0, -1.0, 1.0)


def _variance(spark, percent: np.ndarray) -> DataFrame:
    rows = [(j + 1, float(p)) for j, p in enumerate(percent)]
    label = F.format_string("PC%d (%.1f%%)", F.col("component"), F.col("percent"))
    return spark.createDataFrame(rows, "component int, percent double").withColumn("label", label)


def _dual(z: Standardised, k: int) -> PcaResult:
    spark = z.cells.sparkSession
    order = Window.orderBy(S.SAMPLE_ID)  # at most DUAL_SAMPLES rows
    samples = materialize(z.cells.select(S.SAMPLE_ID).distinct().select(S.SAMPLE_ID, (F.row_number().over(order) - 1).alias("sample")))
    tasks = max(1, min(int(_GRAM_BYTES // (8 * z.n * z.n)), -(-z.p // 64)))
    columns = z.cells.join(F.broadcast(samples), S.SAMPLE_ID).groupBy("place").agg(F.collect_list(F.struct("sample", "z")).alias("cells"))
    columns = materialize(columns.join(z.assays, "place").select(S.ASSAY_ID, "place", "z0", "cells").repartition(tasks))
    n = z.n

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, block in _blocks(batches, n):
            total = block.T @ block if total is None else total + block.T @ block
        if total is not None:
            yield from _chunks(total)

    g = _collected(columns.mapInArrow(gram, _PARTS), n, n)
    values, vectors = np.linalg.eigh((g + g.T) / 2)
    values, vectors = np.maximum(values[::-1][:k], 0.0), vectors[:, ::-1][:, :k]
    root = np.sqrt(values)

    def loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, block in _blocks(batches, n):
            v = (block @ vectors) / np.where(root > 0, root, 1.0)
            yield pa.RecordBatch.from_arrays([some.column(some.schema.get_field_index(S.ASSAY_ID)), pa.array(list(v))], names=["assay", "v"])

    rows = columns.mapInArrow(loaded, "assay string, v array<double>").collect()  # p x k numbers
    rows.sort(key=lambda r: r["assay"].encode())
    loadings = np.array([r["v"] for r in rows])
    signs = _signed(loadings)
    names = [r[0] for r in samples.orderBy("sample").select(S.SAMPLE_ID).collect()]
    scores = [(name, *map(float, row)) for name, row in zip(names, vectors * root * signs)]
    schema = f"{S.SAMPLE_ID} string, " + ", ".join(f"pc{j + 1} double" for j in range(k))
    percent = 100.0 * values / max(float(np.trace(g)), np.finfo(float).tiny)
    return PcaResult(spark.createDataFrame(scores, schema), _variance(spark, percent), loadings * signs, [r["assay"] for r in rows], "dual")


def _primal(values: DataFrame, n: int, p: int, k: int) -> PcaResult:
    spark = values.sparkSession
    assays = assay_list(values)
    vec = imputed_vectors(values.withColumnRenamed("_v", S.NPX), check=False)
    # The vectors feed three jobs (scaler fit, PCA fit, scores): write them once.
    vec = materialize(vec.select(S.SAMPLE_ID, array_to_vector("features").alias("features")))
    scaled = StandardScaler(inputCol="features", outputCol="z", withMean=True, withStd=True).fit(vec).transform(vec)
    model = PCA(k=k, inputCol="z", outputCol="pc").fit(scaled)
    loadings = model.pc.toArray()
    signs = _signed(loadings)
    arr = vector_to_array(F.col("pc"))
    scores = model.transform(scaled).select(
        S.SAMPLE_ID, *[(arr[j] * F.lit(float(signs[j]))).alias(f"pc{j + 1}") for j in range(k)]
    )
    return PcaResult(scores, _variance(spark, 100.0 * model.explainedVariance.toArray()), loadings * signs, assays, "primal")


def _subspace(z: Standardised, k: int, tolerance: float, seed: int) -> PcaResult:
    spark = z.cells.sparkSession
    listed = z.assays.orderBy("place").select(S.ASSAY_ID, "z0").collect()  # one row per assay of the panel
    z0, p = np.array([r["z0"] for r in listed]), z.p
    rows = materialize(z.cells.groupBy(S.SAMPLE_ID).agg(F.collect_list(F.struct("place", "z")).alias("cells")))
    width = min(k + OVERSAMPLE, p, z.n)
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(p, width)))[0]

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for batch in batches:
            step = max(1, (1 << 24) // max(p, 1))
            for begin in range(0, batch.num_rows, step):
                some = batch.slice(begin, step)
                block = np.repeat(z0[None, :], some.num_rows, axis=0)
                row, (place, value) = _lists(some, "cells", "place", "z")
                block[row, place] = value
                yield some, block

    def turned(basis: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for _, block in dense(batches):
                part = block.T @ (block @ basis)
                total = part if total is None else total + part
            if total is not None:
                yield from _chunks(total)

        return run

    for _ in range(MAX_PASSES):
        a = _collected(rows.mapInArrow(turned(w), _PARTS), p, width)
        theta, s = np.linalg.eigh((w.T @ a + a.T @ w) / 2)
        theta, s = theta[::-1][:k], s[:, ::-1][:, :k]
        residual = np.linalg.norm(a @ s - (w @ s) * theta, axis=0).max() / max(theta[0], np.finfo(float).tiny)
        if residual <= tolerance:
            break
        w = np.linalg.qr(a)[0]
    else:
        warnings.warn(f"components settled to {residual:.1e} of the largest eigenvalue in {MAX_PASSES} passes", stacklevel=3)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, block in dense(batches):
            yield pa.RecordBatch.from_arrays([some.column(some.schema.get_field_index(S.SAMPLE_ID)), pa.array(list(block @ w))], names=[S.SAMPLE_ID, "y"])

    def triangle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            y = batch.column(batch.schema.get_field_index("y")).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            r = np.linalg.qr(np.vstack([r, y]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array(list(r))], names=["y"])

    y = materialize(rows.mapInArrow(scored, f"{S.SAMPLE_ID} string, y array<double>"))
    triangles = y.select("y").mapInArrow(triangle, "y array<double>").repartition(8).mapInArrow(triangle, "y array<double>")
    r = np.linalg.qr(np.array([t["y"] for t in triangles.collect()]), mode="r")  # eight triangles of l x l
    _, sizes, turn = np.linalg.svd(r)
    loadings = (w @ turn.T)[:, :k]
    signs = _signed(loadings)
    turn = turn[:k] * signs[:, None]
    pcs = [F.aggregate(F.zip_with("y", F.array(*[F.lit(float(t)) for t in turn[j]]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) for j in range(k)]
    scores = y.select(S.SAMPLE_ID, *[c.alias(f"pc{j + 1}") for j, c in enumerate(pcs)])
    percent = 100.0 * sizes[:k] ** 2 / max(z.total, np.finfo(float).tiny)
    return PcaResult(scores, _variance(spark, percent), loadings * signs, [r[S.ASSAY_ID] for r in listed], "subspace")


def pca(
    df: DataFrame,
    k: int = 5,
    npx: str = S.NPX,
    drop_constant: bool = True,
    route: str | None = None,
    tolerance: float = 1e-9,
    seed: int = 0,
) -> PcaResult:
    """Principal components of the centred, unit-variance (n-1) sample x assay matrix.

    Steps as the reference: drop constant plate x assay groups, keep non-missing values, impute missing
    cells with the assay median, centre and scale, PCA. The values are written once to the shared
    folder because every later job reads them. Components are min(k, n - 1, p). Sign: the
    largest-magnitude loading of each component is positive. A zero-variance assay contributes
    nothing (the reference's prcomp would stop).
    """
    data = drop_constant_assays(df, npx) if drop_constant else df
    values = materialize(data.select(S.SAMPLE_ID, S.ASSAY_ID, F.col(npx).cast("double").alias("_v")).where(F.col("_v").isNotNull()))
    n, p, most = _shape(values)
    if not n:
        raise IntegrityError("no value left: a matrix without samples has no components")
    k_eff = max(1, min(k, n - 1, p))
    route = route or ("dual" if n <= p and n <= DUAL_SAMPLES else "primal" if p <= PRIMAL_ASSAYS else "subspace")
    if route == "primal":
        return _primal(values, n, p, k_eff)
    z = standardised(values, n, p, most)
    return _dual(z, k_eff) if route == "dual" else _subspace(z, k_eff, tolerance, seed)


def pca_builtin(df: DataFrame, k: int = 5, npx: str = S.NPX) -> PcaResult:
    """``pca`` on SAMPLE rows only (as the packaged PCA chart is called in the reference)."""
    return pca(df.where(F.col(S.SAMPLE_TYPE) == S.SAMPLE), k, npx)


def pca_check(df: DataFrame, result: PcaResult, npx: str = S.NPX, drop_constant: bool = True) -> DataFrame:
    """What makes the result a PCA, computed from the data by joins and sums: per component ``residual``
    (largest entry of C v - lambda v, with C the correlation matrix), ``length`` (of v), ``skew``
    (largest product with another component's v), ``spread`` (variance of the scores over lambda),
    and the ``total`` variance and ``samples`` of the matrix.

    Z v are the scores, so C v needs one join of the scores with the z-scores and one sum per assay.
    """
    data = drop_constant_assays(df, npx) if drop_constant else df
    values = materialize(data.select(S.SAMPLE_ID, S.ASSAY_ID, F.col(npx).cast("double").alias("_v")).where(F.col("_v").isNotNull()))
    z = standardised(values, *_shape(values))
    k = result.loadings.shape[1]
    v = materialize(result.loadings_table())
    scores = result.scores.select(S.SAMPLE_ID, F.posexplode(F.array(*[f"pc{j + 1}" for j in range(k)])).alias("at", "score"))
    scores = materialize(scores.select(S.SAMPLE_ID, (F.col("at") + 1).alias("component"), "score"))
    spread = scores.groupBy("component").agg(F.var_samp("score").alias("value"), F.sum("score").alias("all"))
    # Over all samples of an assay, missing cells hold z0: sum z s = sum (z - z0) s over the observed + z0 sum s.
    seen = z.cells.join(z.assays.select("place", "z0"), "place").join(scores, S.SAMPLE_ID)
    seen = seen.groupBy(S.ASSAY_ID, "component").agg(F.sum((F.col("z") - F.col("z0")) * F.col("score")).alias("part"))
    terms = seen.join(z.assays.select(S.ASSAY_ID, "z0"), S.ASSAY_ID).join(spread, "component").join(v, [S.ASSAY_ID, "component"])
    cv = (F.col("part") + F.col("z0") * F.col("all")) / F.lit(float(max(z.n - 1, 1)))
    lead = F.col("percent") / 100.0 * F.lit(z.total / max(z.n - 1, 1))
    lambdas = result.variance.select("component", lead.alias("lambda"))
    residual = terms.join(lambdas, "component").groupBy("component").agg(F.max(F.abs(cv - F.col("lambda") * F.col("loading"))).alias("residual"))
    other = v.select(S.ASSAY_ID, F.col("component").alias("other"), F.col("loading").alias("with"))
    products = v.join(other, S.ASSAY_ID).groupBy("component", "other").agg(F.sum(F.col("loading") * F.col("with")).alias("dot"))
    same = F.col("component") == F.col("other")
    lengths = products.groupBy("component").agg(F.max(F.when(same, F.sqrt("dot"))).alias("length"), F.max(F.when(~same, F.abs("dot"))).alias("skew"))
    out = residual.join(lengths, "component").join(lambdas, "component").join(spread, "component")
    return out.select(
        "component",
        "residual",
        "length",
        F.coalesce("skew", F.lit(0.0)).alias("skew"),
        F.try_divide(F.col("value"), F.col("lambda")).alias("spread"),
        F.lit(z.total / max(z.n - 1, 1)).alias("total"),
        F.lit(z.n).cast("bigint").alias("samples"),
    )
