"""Physical-plan properties the scale design relies on (checked on sf0.001)."""

import re

import pytest

import __spark_entry__ as E
from conftest import SF001
from npxkit.operators import cv, manifest


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(p: str) -> int:
    return len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning)", p))


@pytest.mark.parametrize("name", ["normalize_pc", "normalize_intensity", "npx_boxplot"])
def test_median_mutates_shuffle_once_without_join(spark, name):
    p = plan(E.queries()[name](spark, SF001))
    assert shuffles(p) == 1, p
    assert "Window" in p and "SortMergeJoin" not in p and "BroadcastHashJoin" not in p


def test_no_cartesian_product_anywhere(spark):
    for name, fn in E.queries().items():
        p = plan(fn(spark, SF001))
        assert "CartesianProduct" not in p, name


def test_scans_read_only_needed_columns(spark):
    p = plan(E.queries()["percent_above_lod"](spark, SF001))
    schemas = re.findall(r"ReadSchema: struct<(.*?)>(?:,|$| )", p, flags=re.M)
    assert schemas, p
    for s in schemas:
        assert set(re.findall(r"(\w+):", s)) <= {"vec_id", "embedding", "label", "element"}, s


def test_replicate_cv_aggregates_partially_before_the_shuffle(spark):
    p = plan(E.queries()["replicate_intra_cv_long"](spark, SF001))
    assert "partial_stddev_samp" in p and "partial_count" in p


def test_recode_joins_back_once(spark):
    p = plan(E.queries()["recode_low_quality"](spark, SF001))
    assert p.count("Join") <= 2, p  # flags x per-assay flags (small), rows x flags


@pytest.mark.parametrize("name", ["sample_qc_long", "sample_qc_matrix"])
def test_qc_matrix_reads_the_table_once(spark, name):
    p = plan(E.queries()[name](spark, SF001))
    assert p.count("FileScan parquet") == 1, p
    assert "Join" not in p and shuffles(p) == 2, p


def test_a_sheet_reaches_the_scan_as_a_bloom_filter(spark, tmp_path):
    """Measurements of samples outside the sheet are dropped before the shuffle, also with a whole sheet."""
    rows = [(f"S{i % 90}", f"OID{i % 7}", "B", "assay", "P1", float(i)) for i in range(3000)] + [(None, "OID1", "B", "assay", "P1", 1.0)]
    kinds = "sample_id string, assay_id string, block string, assay_type string, plate_id string, npx double"
    spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / "npx"))
    sheet = [(f"S{i}", f"U{i // 2}") for i in range(0, 20)] + [("", "U99"), (None, "U98")]
    spark.createDataFrame(sheet, "sample_id string, subsample_id string").write.parquet(str(tmp_path / "sheet"))
    npx, sheet_rows = spark.read.parquet(str(tmp_path / "npx")), spark.read.parquet(str(tmp_path / "sheet"))
    forced = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    }
    queries = (lambda: manifest.restrict_samples(npx, sheet_rows), lambda: cv.replicate_intra_cv(npx, sheet_rows))
    plain = [sorted(map(tuple, q().collect())) for q in queries]
    before = {k: spark.conf.get(k) for k in forced}
    try:
        for k, v in forced.items():
            spark.conf.set(k, v)
        for query, want in zip(queries, plain):
            df = query()
            p = df._jdf.queryExecution().optimizedPlan().toString()
            side = [line for line in p.split("\n") if "might_contain" in line]
            assert len(side) == 1 and "Filter" in side[0], p
            assert sorted(map(tuple, df.collect())) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(plain[0]) == sum(1 for r in rows if r[0] is not None and r[0] in {s for s, _ in sheet})
