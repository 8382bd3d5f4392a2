"""Column expressions with R's missing-value rules.

All of these are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LN2 = math.log(2.0)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """N6: R's is.na() is TRUE for NaN; Spark keeps NaN apart from NULL. Fold it once."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def keep_at_or_above(value: str | Column, limit: str | Column) -> Column:
    """N1: ifelse(value < limit, NA, value). A missing limit makes the value missing too."""
    value, limit = col(value), col(limit)
    return F.when(value >= limit, value)


def not_in_or_null(c: str | Column, values: list[str]) -> Column:
    """N2: !x %in% values -- a true NULL is not in the set, so it is selected."""
    c = col(c)
    return c.isNull() | ~c.isin(*values)


def is_in(c: str | Column, values: list[str]) -> Column:
    """N4: x %in% values -- NULL gives FALSE, never NULL."""
    return F.coalesce(col(c).isin(*values), F.lit(False))


def matches(c: str | Column, pattern: str) -> Column:
    """N5: grepl(pattern, x) -- unanchored; a NULL input does not match."""
    return F.coalesce(col(c).rlike(pattern), F.lit(False))


def lognormal_cv(sd: Column) -> Column:
    """CV (%) of log2-scale values: 100 * sqrt(exp((ln 2 * sd)^2) - 1)."""
    return F.lit(100.0) * F.sqrt(F.exp(F.pow(F.lit(LN2) * sd, F.lit(2.0))) - F.lit(1.0))


def count_rows() -> Column:
    """N15: n() counts rows whatever their values."""
    return F.count(F.lit(1))


def share_true(cond: Column) -> Column:
    """N8: mean(cond, na.rm = TRUE) on a double 0/1, NULL conditions left out."""
    return F.avg(F.when(cond, F.lit(1.0)).when(~cond, F.lit(0.0)))


def qc_label(status: str | Column) -> Column:
    """N14: paste0 writes a missing value as the text NA."""
    return F.coalesce(col(status), F.lit("NA"))


def with_key(df: DataFrame, key: str) -> DataFrame:
    """Rows of a side table that have a key; the others match nothing in an equi-join.

    For a text key this is a comparison, which the optimizer (unlike an IS NOT NULL) counts as a
    restriction: where the other side's scan is large and the join is shuffled, it builds a Bloom
    filter of the keys and drops the other side's rows before their shuffle.
    """
    has_key = F.col(key) >= "" if isinstance(df.schema[key].dataType, StringType) else F.col(key).isNotNull()
    return df.where(has_key)
