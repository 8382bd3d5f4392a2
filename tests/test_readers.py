"""Readers and writers (Q01-Q04) and the integrity bundle."""

import pytest

from npxkit.operators import qc
from npxkit.sources import readers


def test_fixed_lod_decimal_comma(spark, tmp_path):
    p = tmp_path / "lod.csv"
    p.write_text("OlinkID;DataAnalysisRefID;LOD\nOID00001;D10001;1,5\nOID00002;D10001;-0,25\nOID00003;D10001;n/a\n")
    got = {r.assay_id: r.pc_lod for r in readers.read_fixed_lod(spark, str(p)).collect()}
    assert got == {"OID00001": 1.5, "OID00002": -0.25, "OID00003": None}


def test_fixed_lod_missing_column(spark, tmp_path):
    p = tmp_path / "lod.csv"
    p.write_text("A;B\n1;2\n")
    with pytest.raises(readers.SchemaError):
        readers.read_fixed_lod(spark, str(p))


def test_subjects_skip_title_and_rename(spark, tmp_path):
    p = tmp_path / "subj.csv"
    p.write_text("Sample details\nID,Aliquot,Sub,Type,Sex,Tissue,Extra\nSUBJ1,A1,SUB1,case,F,plasma,x\n")
    r = readers.read_subjects(spark, str(p)).first()
    assert r.asDict() == dict(subj_id="SUBJ1", aliquot_id="A1", subsample_id="SUB1", subj_type="case", sex="F",
                              tissue_type="plasma")


def test_manifest_drops_position_columns(spark, tmp_path):
    p = tmp_path / "man.csv"
    p.write_text("P,Plate,R,C,W,Subj,Aliq,Sub,Olink\nPRJ_A,PL1,A,1,A1,SUBJ1,A1,SUB1,S000001\n")
    m = readers.read_manifest(spark, str(p))
    assert m.columns == ["project", "plate_id", "subj_id", "aliquot_id", "subsample_id", "olink_sample_id"]


def test_read_npx_vendor_names_and_columns(spark, tmp_path):
    df = spark.createDataFrame([("S1", "OID00001", "PASS", 3, 1.0)],
                               "SampleID string, OlinkID string, SampleQC string, Count int, NPX double")
    p = str(tmp_path / "npx.parquet")
    readers.write_result(df, p)
    got = readers.read_npx(spark, p)
    assert got.columns == ["sample_id", "assay_id", "sample_qc", "read_count", "npx"]
    assert dict(got.dtypes)["read_count"] == "bigint"
    assert readers.read_npx(spark, p, columns=["sample_id", "npx"]).columns == ["sample_id", "npx"]
    with pytest.raises(readers.SchemaError):
        readers.read_npx(spark, p, columns=["lod"])


def test_integrity_bundle(spark):
    df = spark.createDataFrame([("S1", "OID12345", "P1", 1.0), ("S1", "OID12345", "P2", 2.0), ("S2", "X1", None, 1.0)],
                               "sample_id string, assay_id string, uniprot string, npx double")
    res = qc.check_integrity(df)
    assert res["data_type"] == "npx"
    assert [r.assay_id for r in res["non_conforming_oid"].collect()] == ["X1"]
    assert [r.sample_id for r in res["duplicate_samples"].collect()] == ["S1"]
    assert [(r.assay_id, r.n_uniprot, r.extra) for r in res["uniprot_replacements"].collect()] == [("OID12345", 2, 1)]
    with pytest.raises(qc.IntegrityError):
        qc.value_column(df.drop("npx"))


def test_read_npx_null_key_fails_when_read(spark, tmp_path):
    df = spark.createDataFrame([("S1", "OID00001", 1.0), (None, "OID00002", 2.0)],
                               "SampleID string, OlinkID string, NPX double")
    p = str(tmp_path / "nullkey.parquet")
    readers.write_result(df, p)
    with pytest.raises(Exception, match="NULL key"):
        readers.read_npx(spark, p).collect()
    assert readers.read_npx(spark, p, check_keys=False).count() == 2


def test_sheets_keep_line_breaks_in_quoted_fields(spark, tmp_path):
    p = tmp_path / "subj.csv"
    body = "".join(f"SUBJ{i},A{i},SUB{i},\"case\nof two lines, one comma\",F,plasma\n" for i in range(300))
    p.write_text('"A title\nof two lines"\nID,Aliquot,Sub,Type,Sex,Tissue\n' + body)
    rows = readers.read_subjects(spark, str(p)).collect()
    assert sorted(r.subj_id for r in rows) == sorted(f"SUBJ{i}" for i in range(300))
    assert {r.subj_type for r in rows} == {"case\nof two lines, one comma"}
    with pytest.raises(readers.SchemaError):
        readers.read_subjects(spark, str(p), skip_lines=400)


def test_a_sheet_of_several_files_has_a_title_in_each(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"s{n}.csv").write_text(f"title {n}\nID,Aliquot,Sub,Type,Sex,Tissue\nSUBJ{n},A,S,case,F,plasma\n")
    assert sorted(r.subj_id for r in readers.read_subjects(spark, str(tmp_path)).collect()) == ["SUBJ0", "SUBJ1", "SUBJ2"]
