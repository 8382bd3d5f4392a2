"""Helpers shared by the operators of this subpackage: written tables, distributed
numbering, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_LOCAL_BITS = 33  # monotonically_increasing_id: partition index << 33 | row index


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Give the executors this package, once per application: their Python functions live in it, and
    it need not be installed there."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="npxkit-code-"), "npxkit_code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(package.rglob("*.py")):
            out.write(f, f.relative_to(package.parent))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxed(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and all others in one struct ``_others``, out of the way of any name."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    return docs.select(*needed, F.struct(*others).alias("_others") if others else F.lit(None).alias("_others"))


def unboxed(df: DataFrame, columns: Sequence[str], *needed: str) -> DataFrame:
    """The original columns again."""
    return df.select(*(F.col(c) if c in needed else F.col("_others").getField(c).alias(c) for c in columns))


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder named by ``spark.checkpoint.dir`` and
    read it back. Cuts the lineage, survives the loss of executors, and later jobs read the
    same rows even where ``df`` depends on the physical layout."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote. Only for tables that no later job reads: what was
    computed from them must have been written, so that a lost executor does not need them again. Spark
    drops shuffle files when the driver collects the plans that made them: that is asked for, or else
    files of finished steps stay until its memory happens to be full."""
    for t in tables:
        path = getattr(t, "_written_to", None)
        if path:
            sc = t.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    for t in tables[:1]:
        release(t.sparkSession)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more."""
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    setting = str(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return int(setting) if setting.isdigit() else 200


def ranked(df: DataFrame, order: Sequence[Column | str], rank: str = "_rank") -> DataFrame:
    """``df`` with its 0-based rank over the whole table in the given order.

    Rows are range-partitioned and sorted; a row's rank is the number of rows in earlier
    partitions (one row per partition, a bounded table) plus its index in its own. Rows that
    tie on every order column may come in either order; order by enough columns that such
    rows are equal. The table is written once because ranks depend on the layout.
    """
    spark = df.sparkSession
    laid = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    laid = materialize(laid.withColumn("_mid", F.monotonically_increasing_id()))
    laid = laid.withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS))
    sizes = laid.groupBy("_pid").agg(F.count(F.lit(1)).alias("_rows"))
    # One row per shuffle partition: a small table by construction.
    before = sizes.select("_pid", (F.sum("_rows").over(Window.orderBy("_pid")) - F.col("_rows")).alias("_before"))
    out = laid.join(F.broadcast(before), "_pid")
    local = F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return out.withColumn(rank, F.col("_before") + local).drop("_pid", "_mid", "_before")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected links ``(a, b)``: rows ``(node, component)`` with the
    smallest node of the component, for every node that has a link.

    Alternates large-star and small-star rounds (a logarithmic number in practice) until the
    links no longer change. Every round is two aggregations and two joins on node ids, which
    adaptive execution splits where a node has very many links; rounds are written tables, so
    a lost executor does not replay earlier rounds.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = materialize(e)
    last = None
    for _ in range(max_rounds):
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large-star: neighbours above u point to the smallest node next to u
        star = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = star.where("u <> v").distinct()
        # small-star: u and its lower neighbours point to the smallest of them
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        moved = star.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, materialize(moved.unionAll(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        discard(before)
        seen = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % F.lit(1 << 31))).first())
        if seen == last:
            break
        last = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    member = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return member.unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
