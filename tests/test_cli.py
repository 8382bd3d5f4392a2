"""The command line writes every table of a report chain."""

import os

from conftest import SF001
from npxkit.__main__ import main
from npxkit.sources import fixtures as fx


def test_cli_reports(spark, tmp_path):
    d = fx.npx(spark, SF001)
    npx_path, man_path, subj_path = str(tmp_path / "npx"), str(tmp_path / "man"), str(tmp_path / "subj")
    d.drop("label", "subsample_id").write.parquet(npx_path)
    fx.manifest(d).write.parquet(man_path)
    fx.subjects(d).write.parquet(subj_path)
    qc = main(["qc", "--npx", npx_path, "--out", str(tmp_path / "qc")])
    assert "flagged_samples_matrix" in qc and os.path.isdir(qc["flagged_samples_matrix"])
    prec = main(["precision", "--npx", npx_path, "--manifest", man_path, "--subjects", subj_path,
                 "--out", str(tmp_path / "prec")])
    assert "cv_quartiles_lod" in prec
    assert spark.read.parquet(prec["cv_quartiles"]).count() > 0
    pca = main(["pca", "--npx", npx_path, "--manifest", man_path, "--subjects", subj_path, "--k", "3",
                "--out", str(tmp_path / "pca")])
    assert spark.read.parquet(pca["variance"]).count() == 3
