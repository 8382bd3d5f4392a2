"""The distributed exact quantile equals NumPy's linear quantile, also for a group with a third of all rows."""

import numpy as np
from pyspark.sql import functions as F

from npxkit.functions.stats import bounded_quantiles, exact_quantiles


def test_exact_quantiles_hot_group(spark):
    rng = np.random.default_rng(7)
    rows = [("hot", float(v)) for v in rng.normal(size=3000)]
    rows += [(f"g{i % 40}", float(v)) for i, v in enumerate(rng.normal(size=6000))]
    rows += [("ties", 1.0)] * 5 + [("ties", 2.0)] * 4 + [("one", 3.5), ("nulls", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    probs = [0.1, 0.25, 0.5, 0.75, 1.0]
    got = exact_quantiles(df, ["g"], "v", probs, [f"q{i}" for i in range(len(probs))])
    got = {r.g: r for r in got.collect()}
    assert "nulls" not in got
    by_group = {}
    for g, v in rows:
        if v is not None:
            by_group.setdefault(g, []).append(v)
    for g, vals in by_group.items():
        ref = np.quantile(np.array(vals), probs)
        mine = [got[g][f"q{i}"] for i in range(len(probs))]
        np.testing.assert_allclose(mine, ref, rtol=0, atol=1e-12)
        assert got[g].n_values == len(vals)
    builtin = {r.g: r.q for r in df.groupBy("g").agg(bounded_quantiles("v", probs).alias("q")).collect()}
    for g in by_group:
        np.testing.assert_allclose([got[g][f"q{i}"] for i in range(len(probs))], builtin[g], atol=1e-12)


def test_exact_quantiles_single_global_group(spark):
    df = spark.range(1001).select(F.lit(1).alias("k"), (F.col("id") * 0.5).alias("v")).repartition(5)
    r = exact_quantiles(df, ["k"], "v", [0.5, 0.9], ["m", "p90"]).first()
    assert r.m == 250.0 and r.p90 == 450.0 and r.n_values == 1001


def test_group_quantiles_splits_hot_groups(spark):
    from npxkit.functions.stats import attach_quantiles, group_quantiles

    rows = [("hot", None, float(i)) for i in range(50)] + [("cold", "x", 1.0), ("cold", "x", 3.0), (None, "y", 5.0)]
    rows += [("empty", "z", None)]
    df = spark.createDataFrame(rows, "g string, h string, v double")
    got = group_quantiles(df, ["g", "h"], [("v", [0.5], ["med"])], extra_aggs=[F.count(F.lit(1)).alias("n")],
                          max_group_values=10)
    got = {(r.g, r.h): (r.med, r.n) for r in got.collect()}
    assert got == {("hot", None): (24.5, 50), ("cold", "x"): (2.0, 2), (None, "y"): (5.0, 1), ("empty", "z"): (None, 1)}
    att = attach_quantiles(df, ["g", "h"], [("v", [0.5], ["med"])], max_group_values=10).collect()
    assert len(att) == len(rows)
    assert {(r.g, r.h, r.med) for r in att} == {("hot", None, 24.5), ("cold", "x", 2.0), (None, "y", 5.0), ("empty", "z", None)}


def test_exact_quantiles_property(spark):
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    groups = st.lists(
        st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(-5, 5).map(float)), min_size=1, max_size=60
    )

    @settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
    @given(rows=groups, p=st.floats(0, 1), parts=st.integers(1, 9))
    def check(rows, p, parts):
        df = spark.createDataFrame(rows, "g string, v double").repartition(parts)
        got = {r.g: r.q for r in exact_quantiles(df, ["g"], "v", [p], ["q"]).collect()}
        for g in {g for g, _ in rows}:
            vals = np.array([v for gg, v in rows if gg == g])
            np.testing.assert_allclose(got[g], np.quantile(vals, p), atol=1e-9)

    check()


def test_selection_orders_all_doubles(spark):
    vals = [0.0, -0.0, 5e-324, -5e-324, 1e-308, 1.0, 1.0 + 2**-52, -1.0, 1e308, -1e308, float("inf"), float("-inf"), 3.5, 2.0, 3.0, 4.0, 5.0]  # 17: the probabilities are exact
    df = spark.createDataFrame([("a", v) for v in vals] + [(None, 2.0), (None, -7.25)], "g string, v double")
    probs = [i / (len(vals) - 1) for i in range(len(vals))]
    rows = {r.g: r for r in exact_quantiles(df, ["g"], "v", probs, [f"q{i}" for i in range(len(probs))]).collect()}
    assert [rows["a"][f"q{i}"] for i in range(1, len(vals) - 1)] == sorted(vals)[1:-1]
    assert (rows[None].q0, rows[None].n_values) == (-7.25, 2)


def test_ties_are_counted_where_they_lie(spark):
    """A group of equal values is one counter per task: its rows are not moved."""
    df = spark.range(200_000, numPartitions=8).select(F.lit("g").alias("k"), F.lit(2.5).alias("v"))
    r = exact_quantiles(df, ["k"], "v", [0.25, 0.5], ["q", "m"]).first()
    assert (r.q, r.m, r.n_values) == (2.5, 2.5, 200_000)
