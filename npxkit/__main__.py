"""Command line: run a report chain and write every table as Parquet.

    python -m npxkit qc        --npx PATH --out DIR
    python -m npxkit precision --npx PATH --manifest PATH --subjects PATH [--fixed-lod CSV] --out DIR
    python -m npxkit pca       --npx PATH --manifest PATH --subjects PATH [--k 5] --out DIR

Measurement input: Parquet with vendor or library column names. Manifest and subject
sheets: Parquet/CSV with library column names (manifest: olink_sample_id, project,
plate_id, subj_id, subsample_id; subjects: subj_id, subj_type, sex, tissue_type), or the
workbook exports read by position with ``--vendor-sheets``.
"""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import DataFrame, SparkSession

from .operators import manifest as manifest_ops
from .operators import sheet
from .plans import reports
from .session import get_session
from .sources import readers


def _side(spark: SparkSession, path: str, kind: str, vendor: bool) -> DataFrame:
    if vendor:
        fmt = "parquet" if path.endswith(".parquet") else "csv"
        return readers.read_manifest(spark, path, fmt=fmt) if kind == "manifest" else readers.read_subjects(spark, path, fmt=fmt)
    if path.endswith(".csv"):
        return spark.read.option("header", True).csv(path)
    return spark.read.parquet(path)


def _write(tables: dict, out: str) -> dict:
    written = {}
    for name, value in tables.items():
        if isinstance(value, DataFrame):
            target = os.path.join(out, name)
            readers.write_result(value, target)
            written[name] = target
    return written


def main(argv: list[str] | None = None) -> dict:
    p = argparse.ArgumentParser(prog="python -m npxkit")
    p.add_argument("report", choices=["qc", "precision", "pca"])
    p.add_argument("--npx", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--manifest")
    p.add_argument("--subjects")
    p.add_argument("--fixed-lod")
    p.add_argument("--vendor-sheets", action="store_true")
    p.add_argument("--k", type=int, default=5)
    p.add_argument("--master")
    a = p.parse_args(argv)

    spark = get_session(master=a.master)
    npx = readers.read_npx(spark, a.npx)
    if a.report == "qc":
        tables = reports.qc_report(npx)
    else:
        if not (a.manifest and a.subjects):
            p.error("--manifest and --subjects are needed for this report")
        man = _side(spark, a.manifest, "manifest", a.vendor_sheets)
        subj = _side(spark, a.subjects, "subjects", a.vendor_sheets)
        if a.report == "precision":
            fixed = readers.read_fixed_lod(spark, a.fixed_lod) if a.fixed_lod else None
            tables = reports.precision_report(npx, man, subj, fixed_lod=fixed)
        else:
            full = manifest_ops.full_sample_sheet(sheet.sample_sheet(npx), man, subj)
            tables = reports.pca_report(npx, full, k=a.k)
    written = _write(tables, a.out)
    print(json.dumps({"report": a.report, "tables": written}))
    return written


if __name__ == "__main__":
    main()
