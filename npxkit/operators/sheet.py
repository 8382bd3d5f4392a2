"""Shape, preview, sample sheet and plate layout (Q05-Q07)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S


def shape(df: DataFrame) -> DataFrame:
    """Row and column count as a one-row frame: (n_rows, n_cols)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(len(df.columns)).alias("n_cols"))


def preview(df: DataFrame, n: int = 6, order_by: list[str] | None = None) -> DataFrame:
    """First ``n`` rows in key order (an unordered ``limit`` is not deterministic).

    Spark plans ``orderBy`` + ``limit`` as a top-k (TakeOrderedAndProject): each task keeps
    ``n`` rows, no full sort.
    """
    keys = order_by or [c for c in (S.SAMPLE_ID, S.ASSAY_ID) if c in df.columns] or df.columns
    return df.orderBy(*keys).limit(n)


def sample_sheet(df: DataFrame) -> DataFrame:
    """Distinct (sample, type, well, plate) plus the plate column and row taken from the well id.

    Output: sample_id, sample_type, well, plate, column ("Column " + characters 2-3 of the
    well), row (first character of the well).
    """
    well = F.col("well")
    return (
        df.select(S.SAMPLE_ID, S.SAMPLE_TYPE, F.col(S.WELL_ID).alias("well"), F.col(S.PLATE_ID).alias("plate"))
        .distinct()
        .withColumn("column", F.concat(F.lit("Column "), F.substring(well, 2, 2)))
        .withColumn("row", F.substring(well, 1, 1))
    )


def plate_layout(sheet: DataFrame, fill: str = S.SAMPLE_TYPE, columns: list[str] | None = None) -> DataFrame:
    """Plate grid: one row per (plate, plate row), one column per plate column.

    The cell holds ``fill`` of the sample in that well (the smallest one if a well repeats). With a list
    of plate columns nothing runs when the operator is called, and a sample in another one fails the
    job. Without a list they are col_1..col_12 and every other plate column of the sheet (one
    ``distinct``, at most as many as a plate has columns). Samples without a well go to
    ``col_missing``.
    """
    number = F.coalesce(F.regexp_replace("column", "^Column ", ""), F.lit("missing"))
    if columns is None:
        found = {r[0] for r in sheet.select(number).distinct().collect()} - set(S.PLATE_COLUMNS)
        columns = list(S.PLATE_COLUMNS) + sorted(found, key=lambda c: (not c.isdigit(), int(c) if c.isdigit() else 0, c))
    unknown = F.raise_error(F.concat(F.lit("plate column without a place: "), number))
    placed = sheet.withColumn("_column", F.when(number.isin(columns), number).otherwise(unknown))
    wide = placed.groupBy("plate", "row").pivot("_column", columns).agg(F.min(fill))
    return wide.select("plate", "row", *[F.col(f"`{c}`").alias(f"col_{c}") for c in columns])
