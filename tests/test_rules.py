"""Missing-value rules on tiny hand-made frames (FIXTURES §2.4)."""

import math
import statistics

import pytest
from pyspark.sql import functions as F
from npxkit.operators import charts, cv, lod, matrix, normalize, qc
from npxkit.operators.qc import IntegrityError
from npxkit.sources.readers import read_npx

ROW = "sample_id string, sample_type string, plate_id string, assay_id string, block string, assay_type string, " \
      "npx double, lod double, sample_qc string, ext_npx double"


def frame(spark, rows):
    full = []
    for r in rows:
        d = dict(sample_id="S1", sample_type="SAMPLE", plate_id="P1", assay_id="OID00001", block="1",
                 assay_type="assay", npx=None, lod=None, sample_qc="PASS", ext_npx=None)
        d.update(r)
        full.append(tuple(d[k] for k in ["sample_id", "sample_type", "plate_id", "assay_id", "block", "assay_type",
                                          "npx", "lod", "sample_qc", "ext_npx"]))
    return spark.createDataFrame(full, ROW)


def test_missing_lod_recodes_to_null(spark):
    out = lod.below_lod_to_null(frame(spark, [dict(npx=1.0, lod=None)])).first()
    assert out.npx is None


def test_nan_becomes_null_at_ingest(spark, tmp_path):
    df = spark.createDataFrame([("S1", "OID00001", float("nan"))], "SampleID string, OlinkID string, NPX double")
    p = str(tmp_path / "nan.parquet")
    df.write.parquet(p)
    r = read_npx(spark, p).first()
    assert r.npx is None and r.sample_id == "S1" and r.assay_id == "OID00001"


def _mapping(spark, samples, sub="SUB1"):
    return spark.createDataFrame([(s, sub) for s in samples], "sample_id string, subsample_id string")


def test_single_value_group_is_dropped(spark):
    df = frame(spark, [dict(sample_id="A", npx=1.0), dict(sample_id="B", npx=None)])
    assert cv.replicate_intra_cv(df, _mapping(spark, ["A", "B"])).count() == 0


def test_two_values_and_a_null(spark):
    df = frame(spark, [dict(sample_id="A", npx=1.0), dict(sample_id="B", npx=2.0), dict(sample_id="C", npx=None)])
    r = cv.replicate_intra_cv(df, _mapping(spark, ["A", "B", "C"])).first()
    sd = math.sqrt(0.5)
    assert r.n_replicates == 3
    assert r.intra_cv == pytest.approx(100 * math.sqrt(math.exp((math.log(2) * sd) ** 2) - 1))


def test_half_missing_is_kept(spark):
    rows = [dict(sample_id=f"S{i}", npx=v, lod=0.0) for i, v in enumerate([1.0, None, 2.0, None])]
    out = lod.recode_low_quality(frame(spark, rows))
    assert out.count() == 4
    assert sorted(r.npx for r in out.collect() if r.npx is not None) == [1.0, 2.0]


def test_more_than_half_missing_drops_assay(spark):
    rows = [dict(sample_id=f"S{i}", npx=v, lod=0.0) for i, v in enumerate([1.0, None, None, None])]
    assert lod.recode_low_quality(frame(spark, rows)).count() == 0


def test_null_sample_qc_is_flagged(spark):
    df = frame(spark, [dict(sample_qc=None), dict(sample_id="S2", sample_qc="NA"), dict(sample_id="S3", sample_qc="WARN")])
    assert sorted(r.sample_id for r in qc.flagged_samples(df).collect()) == ["S1", "S3"]


def test_equal_replicates_give_zero_cv_and_constant_assay(spark):
    df = frame(spark, [dict(sample_id="A", npx=1.5), dict(sample_id="B", npx=1.5)])
    assert cv.replicate_intra_cv(df, _mapping(spark, ["A", "B"])).first().intra_cv == 0.0
    assert matrix.drop_constant_assays(df).count() == 0


def test_single_value_plate_leaves_matrix(spark):
    assert matrix.drop_constant_assays(frame(spark, [dict(npx=1.0)])).count() == 0


def test_plate_without_plate_control(spark):
    rows = [dict(sample_id=f"S{i}", ext_npx=float(i)) for i in range(3)]
    out = normalize.normalize(frame(spark, rows)).collect()
    assert all(r.npx_pc is None for r in out)
    assert all(r.npx_intensity is not None for r in out)


def test_failed_and_na_qc_are_not_normalised_but_null_qc_is(spark):
    rows = [dict(sample_id="A", sample_type="PLATE_CONTROL", ext_npx=1.0),
            dict(sample_id="B", ext_npx=2.0, sample_qc="FAIL"),
            dict(sample_id="C", ext_npx=3.0, sample_qc="NA"),
            dict(sample_id="D", ext_npx=4.0, sample_qc=None)]
    out = {r.sample_id: r.npx_pc for r in normalize.normalize(frame(spark, rows)).collect()}
    assert out["B"] is None and out["C"] is None and out["D"] == 3.0


def test_duplicate_pairs_raise_in_matrix(spark):
    df = frame(spark, [dict(npx=1.0), dict(npx=2.0)])
    with pytest.raises(IntegrityError):
        matrix.wide_matrix(df)
    assert [r.sample_id for r in qc.duplicate_samples(df).collect()] == ["S1"]


def test_percent_above_lod_all_missing_is_null(spark):
    r = lod.percent_above_lod(frame(spark, [dict(npx=None, lod=1.0)])).first()
    assert r.perc_gt_lod is None


def test_below_lod_count_is_zero_not_null(spark):
    r = lod.below_lod_per_sample(frame(spark, [dict(npx=None, lod=None)])).first()
    assert r.n_below_lod == 0 and r.total_assays == 1 and r.non_nas == 0


def test_qc_label_for_missing_status(spark):
    df = frame(spark, [dict(sample_qc=None), dict(sample_qc="WARN"), dict(sample_qc="WARN")])
    assert qc.sample_qc_long(df).first().qc == "WARN (n=2), NA (n=1)"


def test_mean_over_sd_zero_sd_is_null(spark):
    intra = spark.createDataFrame([("A", "P1", 1.0), ("A", "P2", 1.0)], "assay_id string, plate_id string, npx_mean double")
    r = cv.control_inter_cv(intra).first()
    assert r.mean_over_sd is None and r.inter_cv == 0.0


def test_histogram_bins_right_closed(spark):
    df = spark.createDataFrame([("1", 0.25, 1.0, 0.0), ("1", 0.2500001, 1.0, 0.0), ("1", -0.25, None, 0.0)],
                               "block string, intra_cv double, npx double, lod double")
    got = sorted((r.bin_center, r.above_lod, r.n) for r in charts.cv_histogram(df).collect())
    assert got == [(-0.5, None, 1), (0.0, True, 1), (0.5, True, 1)]


def test_nc_lod_needs_ten_controls(spark):
    rows = [dict(sample_id=f"N{i}", sample_type="NEGATIVE_CONTROL", npx=float(i)) for i in range(5)]
    with pytest.raises(lod.NotEnoughControls):
        lod.nc_lod(frame(spark, rows))
    rows = [dict(sample_id=f"N{i}", sample_type="NEGATIVE_CONTROL", npx=float(i)) for i in range(11)]
    r = lod.nc_lod(frame(spark, rows)).first()
    sd = statistics.stdev(range(11))
    assert r.nc_median == 5.0 and r.lod == pytest.approx(5.0 + max(3 * sd, 0.2))


def test_duplicate_pairs_raise_in_imputation(spark):
    df = frame(spark, [dict(npx=1.0), dict(npx=2.0), dict(sample_id="S2", npx=3.0)])
    with pytest.raises(IntegrityError):
        matrix.impute_median(df)


def test_choose_npx_marks_excluded_assays(spark):
    rows = [dict(sample_id="A", sample_type="PLATE_CONTROL", ext_npx=1.0), dict(sample_id="B", ext_npx=2.0)]
    df = frame(spark, rows).withColumn("assay_qc", F.lit("NA"))
    out = normalize.choose_npx(normalize.normalize(df)).collect()
    assert {r.normalization for r in out} == {"EXCLUDED"} and all(r.npx is None for r in out)
    out = normalize.choose_npx(normalize.normalize(df.withColumn("assay_qc", F.lit("PASS"))), "plate_control").collect()
    assert {r.normalization for r in out} == {"Plate control"}
    assert sorted(r.npx for r in out) == [0.0, 1.0]


def test_all_missing_samples_and_assays(spark):
    df = frame(spark, [dict(sample_id="A", assay_id="X", npx=None), dict(sample_id="A", assay_id="Y", npx=None),
                       dict(sample_id="B", assay_id="X", npx=1.0), dict(sample_id="B", assay_id="Y", npx=None)])
    assert [(r.sample_id, r.n_rows) for r in qc.all_missing_samples(df).collect()] == [("A", 2)]
    assert [(r.assay_id, r.n_rows) for r in qc.all_missing_assays(df).collect()] == [("Y", 2)]


def test_qc_matrix_keeps_every_block(spark):
    from npxkit.operators import qc

    rows = [("S1", "Cardio", "FAIL"), ("S1", "9", "WARN"), ("S2", None, "FAIL"), ("S3", "1", "PASS")]
    df = spark.createDataFrame(rows, "sample_id string, block string, sample_qc string")
    wide = {r.sample_id: r.asDict() for r in qc.sample_qc_matrix(df).collect()}
    assert wide["S1"]["block_Cardio"] == "FAIL (n=1)" and wide["S1"]["block_9"] == "WARN (n=1)"
    assert wide["S2"]["block_missing"] == "FAIL (n=1)"
    assert set(wide) == {"S1", "S2"}
    with pytest.raises(Exception, match="block without a column"):
        qc.sample_qc_matrix(df, ["1", "9"]).collect()


def test_plate_layout_keeps_every_well(spark):
    from npxkit.operators import sheet

    rows = [("S1", "SAMPLE", "A13", "P1"), ("S2", "CONTROL", "A1", "P1"), ("S3", "SAMPLE", None, "P1")]
    df = spark.createDataFrame(rows, "sample_id string, sample_type string, well_id string, plate_id string")
    grid = {(r.plate, r.row): r.asDict() for r in sheet.plate_layout(sheet.sample_sheet(df)).collect()}
    assert grid["P1", "A"]["col_13"] == "SAMPLE" and grid["P1", "A"]["col_1"] == "CONTROL"
    assert grid["P1", None]["col_missing"] == "SAMPLE"


def test_low_count_lod(spark):
    rows = [
        (f"N{i}", "NEGATIVE_CONTROL", "PASS", assay, "1", kind, count, npx)
        for i in range(10)
        for assay, kind, count, npx in (("A", "assay", 2, 0.5 + i / 100), ("B", "assay", 900, 1.0), ("E", "ext_ctrl", 1024, 0.0))
    ]
    df = spark.createDataFrame(
        rows, "sample_id string, sample_type string, sample_qc string, assay_id string, block string, assay_type string, read_count long, npx double"
    )
    plain = {r.assay_id: r.lod for r in lod.nc_lod(df).collect()}
    low = {r.assay_id: r.lod for r in lod.nc_lod(df, low_count=150).collect()}
    assert low["B"] == plain["B"]
    assert low["A"] == pytest.approx(-8.0)  # log2(2 * 2 / 1024)


def test_imputation_is_linear_in_the_panel(spark):
    df = spark.range(400).selectExpr(
        "concat('S', id % 20) as sample_id", "explode(sequence(1, 60)) as a", "cast(id as double) as npx", "id"
    ).where("(a + id) % 3 > 0 and id % 20 + 1 > 0").selectExpr("sample_id", "concat('A', a) as assay_id", "npx", "id")
    df = df.where("id < 20")
    out = matrix.impute_median(df)
    assert out.count() == 20 * 60 and out.where("npx_imputed is null").count() == 0
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "element_at" not in plan and len(plan) < 40_000  # no constants per assay


def test_side_tables_must_not_repeat_keys(spark):
    """Nothing runs when the operator is called; the job that reads the side table fails."""
    df = frame(spark, [dict(ext_npx=1.0, assay_id="A", plate_id="P", sample_type="SAMPLE", sample_qc="PASS")])
    df = df.selectExpr("*", "'D' as data_analysis_ref_id")
    kind = "assay_id string, data_analysis_ref_id string, pc_lod double"
    fixed = spark.createDataFrame([("A", "D", 1.0), ("A", "D", 2.0)], kind)
    with pytest.raises(Exception, match="repeats a key"):
        lod.append_fixed_lod(df, fixed).collect()
    assert lod.append_fixed_lod(df, spark.createDataFrame([("A", "D", None), ("B", "D", 1.0)], kind)).first()["pc_lod"] is None
    lots = spark.createDataFrame([("A", 1.0), ("A", 2.0)], "assay_id string, pc_lot_factor double")
    with pytest.raises(Exception, match="repeats a key"):
        normalize.normalize_pc_with_lot_factor(df, lots).collect()


def test_wide_matrix_of_a_whole_panel(spark):
    """5,440 columns: as many as a delivered panel has."""
    n, p = 12, 5440
    df = spark.range(n * p).where("id % 7 <> 3").selectExpr(
        "concat('S', lpad(id % 12, 3, '0')) as sample_id", "concat('OID', lpad(id div 12, 5, '0')) as assay_id", "id / 10.0D as npx"
    )
    wide = matrix.wide_matrix(df)
    assert len(wide.columns) == p + 1 and wide.columns[1:] == sorted(wide.columns[1:])
    rows = {r[0]: r for r in wide.collect()}
    assert len(rows) == n
    for i in range(n):
        got = rows[f"S{i:03d}"]
        assert all(got[j + 1] == (None if (j * n + i) % 7 == 3 else (j * n + i) / 10.0) for j in range(p))
    some = matrix.wide_matrix(df, ["OID00001", "nothing"])
    assert some.columns == ["sample_id", "OID00001", "nothing"] and some.count() == n
    assert all(r["nothing"] is None for r in some.collect())


def test_panel_median_in_one_pass_agrees_with_two_chains(spark):
    rows = []
    for i, (plate, sub, x) in enumerate(
        [("P1", "A", 1.0), ("P1", "A", 1.5), ("P1", "A", None), ("P1", "B", 0.2), ("P1", "B", 2.0), ("P2", "A", 0.1), ("P2", "A", 0.2), ("P2", "B", 3.0)]
    ):
        for assay, low, kind in (("OID1", 0.15, "assay"), ("OID2", 1.0, "assay"), ("OID3", None, "assay"), ("OID4", 0.0, "ext_ctrl")):
            rows.append((f"S{i}", assay, "1", kind, plate, None if x is None else x * len(assay) / 3 + i % 3, low))
    df = spark.createDataFrame(rows, "sample_id string, assay_id string, block string, assay_type string, plate_id string, npx double, lod double")
    subs = ["A", "A", "A", "B", "B", "A", "A", "B"]
    mapping = spark.createDataFrame([(f"S{i}", s) for i, s in enumerate(subs)] + [("S0", "SAMPLE_CONTROL")], "sample_id string, subsample_id string")
    two = cv.median_cv_overall(*(cv.median_cv(cv.replicate_intra_cv(df, mapping, drop_below_lod=drop)) for drop in (False, True))).first()
    one = cv.median_cv_panel(df, mapping).first()
    assert one.median_cv_all is not None and one.median_cv_lod is not None
    assert one.median_cv_all == pytest.approx(two.median_cv_all) and one.median_cv_lod == pytest.approx(two.median_cv_lod)
    nothing = cv.median_cv_panel(df.limit(0), mapping).collect()
    assert [tuple(r) for r in nothing] == [(None, None)]
