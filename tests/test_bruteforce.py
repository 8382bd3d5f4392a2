"""Operators against pandas brute force (the R semantics written out row by row) on random small frames."""

import math

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from npxkit.operators import cv, lod

SCHEMA = "sample_id string, plate_id string, assay_id string, block string, assay_type string, npx double, lod double"

rows_strategy = st.lists(
    st.tuples(
        st.sampled_from(["S1", "S2", "S3", "S4", "S5", "S6"]),
        st.sampled_from(["P1", "P2"]),
        st.sampled_from(["A1", "A2", "A3"]),
        st.one_of(st.none(), st.integers(-3, 3).map(float)),
        st.one_of(st.none(), st.sampled_from([-1.0, 0.0, 1.0])),
    ),
    min_size=1,
    max_size=40,
)


def frame(spark, rows):
    full = [(s, p, a, "1", "assay", v, l) for s, p, a, v, l in rows]
    return spark.createDataFrame(full, SCHEMA), pd.DataFrame(full, columns=[c.split()[0] for c in SCHEMA.split(", ")])


def recode_reference(pdf: pd.DataFrame) -> pd.DataFrame:
    d = pdf.copy()
    d["npx"] = [v if (v is not None and not pd.isna(v) and l is not None and not pd.isna(l) and v >= l) else None
                for v, l in zip(d["npx"], d["lod"])]
    d["npx"] = d["npx"].astype(float)
    too_many = d.groupby(["plate_id", "assay_id"])["npx"].transform(lambda x: x.isna().mean() > 0.5)
    d.loc[too_many, "npx"] = np.nan
    global_too_many = d.groupby("assay_id")["npx"].transform(lambda x: x.isna().mean() > 0.5)
    d.loc[global_too_many, "npx"] = np.nan
    keep = d.groupby("assay_id")["npx"].transform(lambda x: x.notna().sum() > 0)
    return d[keep]


def rowset(df):
    return sorted(tuple(None if (isinstance(x, float) and math.isnan(x)) else x for x in r) for r in df)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=rows_strategy)
def test_recode_matches_bruteforce(spark, rows):
    sdf, pdf = frame(spark, rows)
    got = lod.recode_low_quality(sdf).select("sample_id", "plate_id", "assay_id", "npx").collect()
    ref = recode_reference(pdf)[["sample_id", "plate_id", "assay_id", "npx"]]
    assert rowset(tuple(r) for r in got) == rowset(ref.itertuples(index=False, name=None))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=rows_strategy, drop=st.booleans())
def test_replicate_cv_matches_bruteforce(spark, rows, drop):
    sdf, pdf = frame(spark, rows)
    mapping = pd.DataFrame({"sample_id": ["S1", "S2", "S3", "S4", "S5", "S6", "S1"],
                            "subsample_id": ["X", "X", "X", "Y", "Y", "Z", "Z"]})
    got = cv.replicate_intra_cv(sdf, spark.createDataFrame(mapping), drop_below_lod=drop).collect()
    d = pdf.merge(mapping, on="sample_id")
    if drop:
        d["npx"] = [v if (not pd.isna(v) and not pd.isna(l) and v >= l) else np.nan for v, l in zip(d["npx"], d["lod"])]
    ref = {}
    for key, g in d.groupby(["assay_id", "block", "assay_type", "plate_id", "subsample_id"]):
        vals = g["npx"].dropna().astype(float)
        if len(vals) > 1:
            sd = vals.std(ddof=1)
            ref[key] = (100 * math.sqrt(math.exp((math.log(2) * sd) ** 2) - 1), len(g))
    mine = {(r.assay_id, r.block, r.assay_type, r.plate_id, r.subsample_id): (r.intra_cv, r.n_replicates) for r in got}
    assert set(mine) == set(ref)
    for k, (cvv, n) in ref.items():
        assert mine[k][1] == n and math.isclose(mine[k][0], cvv, rel_tol=1e-9, abs_tol=1e-9)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(values=st.lists(st.one_of(st.none(), st.integers(-20, 20).map(float)), min_size=1, max_size=30))
def test_boxplot_matches_bruteforce(spark, values):
    from npxkit.operators import charts

    rows = [("S1", "1", "P1", "PASS" if i % 3 else None, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "sample_id string, block string, plate_id string, sample_qc string, npx double")
    got = {r.sample_qc: r for r in charts.npx_boxplot(df).collect()}
    for qc_state in {r[3] for r in rows}:
        vals = np.array([r[4] for r in rows if r[3] == qc_state and r[4] is not None])
        if len(vals) == 0:
            assert qc_state not in got
            continue
        q1, med, q3 = np.quantile(vals, [0.25, 0.5, 0.75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        r = got[qc_state]
        assert (r.n, r.q1, r.median, r.q3) == (len(vals), q1, med, q3)
        assert r.whisker_low == vals[vals >= lo].min() and r.whisker_high == vals[vals <= hi].max()
        assert r.n_outliers == int(((vals < lo) | (vals > hi)).sum())
