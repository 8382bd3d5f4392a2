"""Session helpers: the checkpoint folder comes from the session."""

from pyspark.sql import functions as F

from npxkit.session import ensure_checkpoint_dir, materialize


def test_checkpoint_dir_is_read_from_the_session(spark):
    d = ensure_checkpoint_dir(spark)
    assert d and d == spark.sparkContext.getCheckpointDir()
    assert ensure_checkpoint_dir(spark) == d  # never replaced once set


def test_materialize_cuts_lineage(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    m = materialize(df)
    assert sorted(r.x for r in m.collect()) == list(range(0, 20, 2))
    assert "LogicalRDD" in m._jdf.queryExecution().logical().toString()
