"""The quantile queries again, with the group-size bound forced low so every median and
quartile takes the distributed exact route (range partitioning + global ranks)."""

import pytest

import __spark_entry__ as E
from conftest import SF01
from npxkit.functions.stats import MAX_GROUP_VALUES_CONF
from oracle import compare, duck

QUANTILE_QUERIES = [
    "median_cv",
    "cv_quartiles_lod",
    "normalize_pc",
    "append_fixed_lod",
    "nc_lod",
    "below_lod_per_plate",
    "qc_outliers",
    "npx_boxplot",
    "cv_density",
    "impute_median",
    "median_cv_overall",
    "nc_lod_low_count",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.fixture()
def low_bound(spark):
    spark.conf.set(MAX_GROUP_VALUES_CONF, "3")
    yield
    spark.conf.unset(MAX_GROUP_VALUES_CONF)


@pytest.mark.parametrize("name", QUANTILE_QUERIES)
def test_distributed_route_matches_oracle(spark, con, low_bound, name):
    ok, _, _, detail = compare(spark, con, SF01, name, E.queries()[name], E.oracle_sql()[name])
    assert ok, detail
