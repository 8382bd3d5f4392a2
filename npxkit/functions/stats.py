"""Exact quantiles (R type 7 / linear interpolation) in two forms, and a dispatcher.

* ``bounded_quantiles`` -- the built-in ``percentile`` aggregate. It keeps the values of one
  group in one task, so it is only used for groups whose size has been checked.
* ``exact_quantiles`` -- for groups that grow with the data (an assay over every sample of a
  study) or a hot key. The values at the interpolation ranks are selected digit by digit of their
  ordered bits, from counts: values are neither sorted nor shuffled, and nothing of a group is
  gathered.
* ``group_quantiles`` -- measures the largest group with one partial-aggregate pass and
  picks the first form when every group is within ``npxkit.quantile.maxGroupValues``
  values (default 1,000,000), the second otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_DIGIT = 16  # bits found in a round of a selection
MAX_GROUP_VALUES_CONF = "npxkit.quantile.maxGroupValues"
DEFAULT_MAX_GROUP_VALUES = 1_000_000


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL (grouping semantics), keeping one copy of the keys."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = [left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys]
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def bounded_quantiles(value: str | Column, probs: Sequence[float]) -> Column:
    """Array of exact type-7 quantiles of ``value`` (NULLs skipped) for a bounded group."""
    v = F.col(value) if isinstance(value, str) else value
    return F.percentile(v, F.array(*[F.lit(float(p)) for p in probs]))


def _ordered_bits(value: Column) -> Column:
    """The 64 bits of a double as a long that sorts as the double does (the two zeros as one)."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("bigint")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)


def _from_ordered_bits(bits: Column) -> Column:
    plain = F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)
    return F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), plain).cast("double")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Exact type-7 quantiles of ``value`` per group of ``keys`` by selection, without sorting a group or holding it
    in one task.

    Returns one row per group having at least one non-NULL value: ``keys`` + ``names`` (double) +
    ``n_values``. The value at a rank is found digit by digit: a double's 64 bits, arranged to sort as the
    double does, are four digits of ``_DIGIT`` bits. Each round counts, by partial aggregation, the values
    that share the digits found so far by their next digit; running sums of these counts (at most 2^16 per
    group and rank) name it. Equal values are one counter in each task, so a group of ties is spread
    over all tasks like any other, and only counters are shuffled.
    """
    keys = list(keys)
    v = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    # Four rounds read the bits: write them once.
    coded = materialize(v.select(*keys, _ordered_bits(F.col("_v")).alias("_bits")))
    sizes = materialize(coded.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    # h = (n - 1) p ; Q = x[floor h] + (h - floor h) (x[floor h + 1] - x[floor h])
    hs = [(F.col("_n") - 1).cast("double") * F.lit(float(p)) for p in probs]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(h), F.least(F.floor(h) + 1, F.col("_n") - 1)) for h in hs])))
    found = sizes.select(*keys, F.explode(ranks).alias("_rank"), F.lit(0).cast("bigint").alias("_prefix"), F.lit(0).cast("bigint").alias("_below"))
    for shift in range(64 - _DIGIT, -1, -_DIGIT):
        first = shift == 64 - _DIGIT
        # All values share the empty prefix of the first round.
        prefix = F.lit(0).cast("bigint") if first else F.shiftright("_bits", shift + _DIGIT)
        rows = coded.select(*keys, prefix.alias("_prefix"), F.shiftright("_bits", shift).alias("_next"))
        if not first:
            rows = join_on_keys(rows, found.select(*keys, "_prefix").distinct(), [*keys, "_prefix"], "left_semi")
        counts = rows.groupBy(*keys, "_prefix", "_next").agg(F.count(F.lit(1)).alias("_c"))
        upto = F.sum("_c").over(Window.partitionBy(*keys, "_prefix").orderBy("_next"))
        counts = counts.select(*keys, "_prefix", "_next", "_c", upto.alias("_upto"))
        hit = join_on_keys(found, counts, [*keys, "_prefix"])
        local = F.col("_rank") - F.col("_below")
        hit = hit.where((local < F.col("_upto")) & (local >= F.col("_upto") - F.col("_c")))
        found = materialize(
            hit.select(*keys, "_rank", F.col("_next").alias("_prefix"), (F.col("_below") + F.col("_upto") - F.col("_c")).alias("_below"))
        )
    values = join_on_keys(found.select(*keys, "_rank", _from_ordered_bits(F.col("_prefix")).alias("_v")), sizes, keys)
    aggs = []
    for i, h in enumerate(hs):
        lo = F.floor(h)
        aggs.append(F.max(F.when(F.col("_rank") == lo, F.col("_v"))).alias(f"_lo{i}"))
        aggs.append(F.max(F.when(F.col("_rank") == lo + 1, F.col("_v"))).alias(f"_hi{i}"))
    out = values.groupBy(*keys).agg(F.max("_n").alias("n_values"), *aggs)
    cols = []
    for i, (p, name) in enumerate(zip(probs, names)):
        h = (F.col("n_values") - 1).cast("double") * F.lit(float(p))
        lo_v, hi_v = F.col(f"_lo{i}"), F.coalesce(F.col(f"_hi{i}"), F.col(f"_lo{i}"))
        # At a rank itself nothing is interpolated, also where the next value is infinite.
        cols.append(F.when(h == F.floor(h), lo_v).otherwise(lo_v + (h - F.floor(h)) * (hi_v - lo_v)).alias(name))
    return out.select(*keys, *cols, "n_values")


def nrd0_bandwidth(n: Column, sd: Column, iqr: Column, first_abs: Column) -> Column:
    """Silverman's rule as R's ``bw.nrd0``: 0.9 * lo * n^-0.2 with lo = min(sd, IQR/1.34),
    falling back to sd, then |x[1]|, then 1 when zero."""
    lo = F.least(sd, iqr / F.lit(1.34))
    lo = F.when(lo != 0, lo).when(sd != 0, sd).when(first_abs != 0, first_abs).otherwise(F.lit(1.0))
    return F.lit(0.9) * lo * F.pow(n.cast("double"), F.lit(-0.2))


GAUSS_NORM = 1.0 / math.sqrt(2.0 * math.pi)


QuantileSpec = tuple  # (value column, probabilities, output names)


def _limit(df: DataFrame, max_group_values: int | None) -> int:
    return max_group_values or int(df.sparkSession.conf.get(MAX_GROUP_VALUES_CONF, str(DEFAULT_MAX_GROUP_VALUES)))


def _prepare(
    df: DataFrame,
    keys: list[str],
    specs: Sequence[QuantileSpec],
    checkpoint_input: bool = False,
    known_max_group: int | None = None,
) -> tuple[DataFrame, int, DataFrame]:
    """Cast each spec's value to double as _qv<i>; measure the largest group (one
    partial-aggregate pass: one counter per group and spec). Returns the prepared data,
    the largest group size and the (lazy) per-group counts.

    With ``checkpoint_input`` the prepared input is written once to the shared checkpoint
    folder, so the size check and the quantiles read it instead of recomputing its lineage
    (for inputs that are themselves aggregates, hence small next to the raw table).
    """
    vals = [(F.col(v) if isinstance(v, str) else v).cast("double").alias(f"_qv{i}") for i, (v, _, _) in enumerate(specs)]
    data = df.select("*", *vals)
    if checkpoint_input:
        data = materialize(data)
    counts = data.groupBy(*keys).agg(
        F.greatest(*[F.count(f"_qv{i}") for i in range(len(specs))], F.lit(0)).alias("_n")
    )
    if known_max_group is not None:
        return data, known_max_group, counts
    biggest = counts.agg(F.max("_n")).first()[0] or 0
    return data, biggest, counts


def _split_hot(data: DataFrame, keys: list[str], counts: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows of groups within the bound, and rows of hot groups. There are fewer hot groups
    than (values / limit), so the hot-key table stays small next to the data."""
    hot = counts.where(F.col("_n") > limit).select(*keys)
    return join_on_keys(data, hot, keys, "left_anti"), join_on_keys(data, hot, keys, "left_semi")


def _exact_table(data: DataFrame, keys: list[str], specs: Sequence[QuantileSpec], groups: DataFrame) -> DataFrame:
    out = groups
    for i, (_, probs, ns) in enumerate(specs):
        q = exact_quantiles(data, keys, f"_qv{i}", probs, ns).drop("n_values")
        out = join_on_keys(out, q, keys, "left")
    return out


def _bounded_groups(data: DataFrame, keys: list[str], specs: Sequence[QuantileSpec], extra_aggs: Sequence[Column]) -> DataFrame:
    qs = [bounded_quantiles(f"_qv{i}", probs).alias(f"_q{i}") for i, (_, probs, _) in enumerate(specs)]
    out = data.groupBy(*keys).agg(*qs, *extra_aggs)
    picks = [F.col(f"_q{i}")[j].alias(n) for i, (_, _, ns) in enumerate(specs) for j, n in enumerate(ns)]
    extra = [c for c in out.columns if c not in keys and not c.startswith("_q")]
    return out.select(*keys, *picks, *extra)


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    specs: Sequence[QuantileSpec],
    extra_aggs: Sequence[Column] = (),
    max_group_values: int | None = None,
    checkpoint_input: bool = False,
    known_max_group: int | None = None,
) -> DataFrame:
    """Exact type-7 quantiles per group of ``keys`` for each spec (value, probs, names), NULL
    values skipped, plus ``extra_aggs`` over the group's rows. Every group of ``df`` appears
    once; a group without values gets NULL quantiles.

    One partial-aggregate pass finds the largest group (values per spec). Groups within the
    bound use the built-in ``percentile`` in one aggregation together with ``extra_aggs``;
    groups above it (hot keys) are split off and take ``exact_quantiles``, which spreads
    each of them over many tasks. ``known_max_group`` (the largest number of values in a
    group, if the caller measured it already) skips the measuring pass.
    """
    keys = list(keys)
    data, biggest, counts = _prepare(df, keys, specs, checkpoint_input, known_max_group)
    limit = _limit(df, max_group_values)
    bounded = _bounded_groups(data, keys, specs, extra_aggs)
    if biggest <= limit:
        return bounded
    cold, hot = _split_hot(data, keys, counts, limit)
    groups = hot.groupBy(*keys).agg(*extra_aggs) if extra_aggs else hot.select(*keys).distinct()
    hot_q = _exact_table(hot, keys, specs, groups)
    return _bounded_groups(cold, keys, specs, extra_aggs).unionByName(hot_q.select(*bounded.columns))


def attach_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    specs: Sequence[QuantileSpec],
    max_group_values: int | None = None,
) -> DataFrame:
    """``df`` with its group's quantiles added as columns (a grouped mutate).

    Groups within the size bound get a window aggregate over ``keys``: the rows are
    shuffled once, no join, and a group's values are buffered only in the task that owns
    it. Hot groups are split off; their quantiles come from the distributed exact route
    and are joined back (NULL keys match, as in grouping).
    """
    keys = list(keys)
    data, biggest, counts = _prepare(df, keys, specs)
    tmp = [f"_qv{i}" for i in range(len(specs))]

    def windowed(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys)
        with_q = rows.withColumns({f"_q{i}": bounded_quantiles(f"_qv{i}", probs).over(w) for i, (_, probs, _) in enumerate(specs)})
        picks = {n: F.col(f"_q{i}")[j] for i, (_, _, ns) in enumerate(specs) for j, n in enumerate(ns)}
        return with_q.withColumns(picks).drop(*tmp, *[f"_q{i}" for i in range(len(specs))])

    if biggest <= _limit(df, max_group_values):
        return windowed(data)
    cold, hot = _split_hot(data, keys, counts, _limit(df, max_group_values))
    table = _exact_table(hot, keys, specs, hot.select(*keys).distinct())
    hot_rows = join_on_keys(hot, table, keys, "left").drop(*tmp)
    cold_rows = windowed(cold)
    return cold_rows.unionByName(hot_rows.select(*cold_rows.columns))
