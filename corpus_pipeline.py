"""A corpus pipeline of five stages over ``documents``, each a Spark job whose rows are written
and read again by the next one.

1. ``quality``: documents that the ordinal quality classifier rejects go. It learns from the
   labels of all labelled rows.
2. ``near_duplicates``: of each group of documents linked by the n-gram Jaccard join (five
   words, similarity 0.8 or more) the one with the smallest id stays, of those with that id the
   one whose text has the smallest hash. Rows are linked and dropped by their texts: rows of one
   id with unlike texts are documents of their own.
3. ``repeats``: byte strings of 200 bytes or more (less than 50 words) that occur elsewhere
   in the corpus are taken out of the texts, at every place; a document of which nothing is left goes.
4. ``mixture``: sources are mixed to their target weights; a document is repeated or dropped
   as drawn.
5. ``packed``: the texts are packed into sequences; one row per piece.

All stages but the last return the columns of ``documents``. Rows with a null id link with nothing
in the second stage; of those with equal texts one stays. Texts without words link with nothing
either; of rows equal in id and text one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from npxkit.llm import jaccard_join, mixing, packing, quality, suffix_dedup
from npxkit.llm.base import materialize, ship_code, table

WORDS = 5
PERCENT = 80
REPEAT_BYTES = 200
REPEAT_GRAM = 64


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.selected(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_all")
    # Rows are numbered in a written table: their numbers are the nodes, whatever their ids.
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("_row"), whole))
    doc_id, text = F.col("_all").getField("doc_id"), F.col("_all").getField("text")
    named = rows.where(doc_id.isNotNull()).select(F.col("_row").alias("doc_id"), text.alias("text"))
    grouped = jaccard_join.classes(named, WORDS, PERCENT).where("n_shingles > 0").select(F.col("doc_id").alias("_row"), "component_id")
    # Of rows equal in id and text the other columns decide, so that reruns keep the same.
    others = [F.col("_all").getField(f.name) for f in docs.schema if f.name not in ("doc_id", "text") and "map<" not in f.dataType.simpleString()]
    own = rows.select("_row", doc_id.alias("_id"), F.md5(text.cast("binary")).alias("_md5"), F.xxhash64(F.lit(0), *others).alias("_rest"))
    own = own.join(grouped, "_row", "left")
    alone = F.col("component_id").isNull()
    first = own.groupBy("component_id", F.when(alone, F.col("_id")).alias("_i"), F.when(alone, F.col("_md5")).alias("_t")).agg(
        F.min(F.struct("_id", "_md5", "_rest", "_row")).alias("_first")
    )
    kept = rows.join(materialize(first.select(F.col("_first").getField("_row").alias("_row"))), "_row", "left_semi")
    return kept.select(*(F.col("_all").getField(c).alias(c) for c in docs.columns))


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs, min_bytes=REPEAT_BYTES, gram=REPEAT_GRAM, drop_emptied=True)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.query(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeat_stage),
    ("mixture", mixture_stage),
    ("packed", packing_stage),
]

# Fitted models, suffix arrays and retrieval are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each over all that its predecessor kept."""
    ship_code(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
