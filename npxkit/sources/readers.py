"""Readers and writers (Q01-Q04)."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.columns import nan_to_null


class SchemaError(ValueError):
    """An input lacks a column the library needs."""


def to_library_columns(df: DataFrame) -> DataFrame:
    """Rename vendor columns (SampleID, OlinkID, ...) to the library's snake_case names."""
    present = {k: v for k, v in S.VENDOR_COLUMNS.items() if k in df.columns and k != v}
    return df.withColumnsRenamed(present) if present else df


KEY_COLUMNS = [S.SAMPLE_ID, S.ASSAY_ID, S.PLATE_ID]


def read_npx(
    spark: SparkSession, path: str | list[str], columns: list[str] | None = None, check_keys: bool = True
) -> DataFrame:
    """Read measurement Parquet (vendor or library column names) into the library schema.

    Known columns are cast to their declared types, NaN becomes NULL in every double
    column (R's is.na treats both alike), and the required columns are checked. With
    ``columns`` only those (library names) are kept, so the scan reads only them.

    With ``check_keys`` a NULL sample, assay or plate id fails the job when it is read
    (R joins match missing keys, Spark's equi-joins do not). The check is a filter
    condition next to the scan, not an extra pass, and the key columns stay untouched so
    filters on them still reach the Parquet scan.
    """
    paths = [path] if isinstance(path, str) else list(path)
    df = to_library_columns(spark.read.parquet(*paths))
    missing = [c for c in S.REQUIRED_COLUMNS if c not in df.columns]
    if missing:
        raise SchemaError(f"missing required columns: {missing}")
    if columns is not None:
        absent = [c for c in columns if c not in df.columns]
        if absent:
            raise SchemaError(f"missing requested columns: {absent}")
        df = df.select(*columns)
    casts = {}
    for f in df.schema.fields:
        want = S.NPX_TYPES.get(f.name, f.dataType)
        c = F.col(f.name) if want == f.dataType else F.col(f.name).cast(want)
        if isinstance(want, (T.DoubleType, T.FloatType)):
            c = nan_to_null(c)
        if want != f.dataType or isinstance(want, (T.DoubleType, T.FloatType)):
            casts[f.name] = c
    df = df.withColumns(casts) if casts else df
    keys = [k for k in KEY_COLUMNS if k in df.columns] if check_keys else []
    if keys:
        missing_key = functools.reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
        msg = F.lit(f"NULL key ({', '.join(keys)}) in the measurement table")
        df = df.where(F.when(missing_key, F.raise_error(msg)).otherwise(F.lit(True)))
    return df


def read_fixed_lod(
    spark: SparkSession,
    path: str,
    assay_col: str = "OlinkID",
    ref_col: str = "DataAnalysisRefID",
    lod_col: str = "LOD",
    sep: str = ";",
) -> DataFrame:
    """Fixed-LOD text file: ``;``-separated with a header, decimal comma allowed.

    All fields are read as text, the LOD is converted with ',' -> '.' (text that is not a
    number becomes NULL). Returns (assay_id, data_analysis_ref_id, pc_lod).
    """
    raw = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path)
    for c in (assay_col, ref_col, lod_col):
        if c not in raw.columns:
            raise SchemaError(f"fixed LOD file lacks column {c!r}; has {raw.columns}")
    lod = F.regexp_replace(F.trim(F.col(lod_col)), ",", ".")
    return raw.select(
        F.trim(F.col(assay_col)).alias(S.ASSAY_ID),
        F.trim(F.col(ref_col)).alias(S.DAR_ID),
        lod.try_cast("double").alias(S.PC_LOD),
    )


SUBJECT_COLUMNS = ["subj_id", "aliquot_id", "subsample_id", "subj_type", "sex", "tissue_type"]
MANIFEST_COLUMNS = [
    "project",
    "plate_id",
    "row",
    "col",
    "well",
    "subj_id",
    "aliquot_id",
    "subsample_id",
    "olink_sample_id",
]


_SHEET_WIDTH = 64  # columns that a sheet can have


def _sheet(spark: SparkSession, path: str, skip_lines: int, fmt: str) -> DataFrame:
    """A sheet whose first ``skip_lines`` records (title lines) are left out; the next one is the header.

    Records are read by the CSV source under a wide text schema (a quoted field may hold line breaks) and
    numbered within their file, so no line is handled outside of it.
    """
    if fmt == "parquet":
        return spark.read.parquet(path)
    schema = ", ".join(f"_f{i} string" for i in range(_SHEET_WIDTH))
    rows = spark.read.schema(schema).option("header", False).option("multiLine", True).csv(path)
    in_file = Window.partitionBy("_file").orderBy("_at")
    rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    rows = rows.withColumn("_line", F.row_number().over(in_file) - 1)
    header = rows.where(F.col("_line") == skip_lines).orderBy("_file").drop("_file", "_at", "_line").first()
    if header is None:
        raise SchemaError(f"sheet {path!r} has no header after {skip_lines} lines")
    width = max((i + 1 for i, name in enumerate(header) if name is not None), default=0)
    names = [header[i] if header[i] is not None else f"_c{i}" for i in range(width)]
    return rows.where(F.col("_line") > skip_lines).select(*[f"_f{i}" for i in range(width)]).toDF(*names)


def read_subjects(spark: SparkSession, path: str, skip_lines: int = 1, fmt: str = "csv") -> DataFrame:
    """Subject sheet exported from the workbook: a title line skipped, the first six
    columns kept and renamed by position."""
    df = _sheet(spark, path, skip_lines, fmt)
    if len(df.columns) < len(SUBJECT_COLUMNS):
        raise SchemaError(f"subject sheet has {len(df.columns)} columns, needs {len(SUBJECT_COLUMNS)}")
    return df.select(*df.columns[: len(SUBJECT_COLUMNS)]).toDF(*SUBJECT_COLUMNS)


def read_manifest(spark: SparkSession, path: str, skip_lines: int = 0, fmt: str = "csv") -> DataFrame:
    """Manifest sheet: nine columns renamed by position; row, col and well dropped."""
    df = _sheet(spark, path, skip_lines, fmt)
    if len(df.columns) != len(MANIFEST_COLUMNS):
        raise SchemaError(f"manifest has {len(df.columns)} columns, expected {len(MANIFEST_COLUMNS)}")
    return df.toDF(*MANIFEST_COLUMNS).drop("row", "col", "well")


def write_result(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Write a result table as Parquet (optionally partitioned, e.g. by project and plate)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
