"""Mixing sources to target weights by systematic sampling, built from SQL expressions only.

Sources have weights; targets share a total of words by weight, but no source is taken more
than ``max_repeat`` times: what a capped source cannot take is shared among the others by
weight until none is above its cap. A document of a source with target ``t`` and size ``s``
has ``t / s`` expected copies. Documents of a source are ordered by size, the expected copies
are prefix-summed, and a document is emitted once for each integer boundary that the sum
crosses, shifted by one offset per source. Because neighbours in that order have nearly equal
sizes, the words taken differ from the target by about one document.

The offset is random but repeatable: ``OFFSETS`` equally spaced offsets start at a random point
given by the source's name and a seed, and the one whose words come nearest to the target is
kept (the first on a tie).

Nulls: a null text has size 0; a null source is a source of its own, ordered last; a null id is
ordered first among equal sizes. Documents of size 0 are copied like others and take no words;
a source with no words has target 0 and gives no copies. Repeated rows count as documents.
An empty table gives an empty result. Extra columns are ignored by ``mix`` and kept by
``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import boxed, materialize, ranked, unboxed

# A word is a run of other characters than space and 0x09-0x0D.
WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHT_CYCLE = 3
MAX_REPEAT = 3
OFFSETS = 16


def word_count(text: Column) -> Column:
    """Number of words of a text; a word starts where no word character stands before it."""
    # Collapsing every word to one character and dropping the rest leaves a character per word.
    letters = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "w")
    return F.length(F.translate(letters, " \t\n\x0b\x0c\r", "")).cast("bigint")


def source_targets(sizes: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Per source (rows ``source, source_size``): weight by code point order (null last) and
    target. One row per source throughout; the windows over that table need no partition key.

    With the sources in the order of cap / weight, the capped ones come first: a source is
    capped if its cap is below its share of what the capped ones before it leave.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % F.lit(WEIGHT_CYCLE) + 1).cast("bigint"))
    w = w.withColumn("cap", (F.col("source_size") * max_repeat).cast("bigint"))
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    w = w.select(
        "*",
        F.sum("source_size").over(Window.partitionBy()).alias("_total"),
        (F.sum("cap").over(by_need) - F.col("cap")).alias("_capped_before"),
        (F.sum("weight").over(Window.partitionBy()) - F.sum("weight").over(by_need) + F.col("weight")).alias("_weight_left"),
    )
    level = (F.col("_total") - F.col("_capped_before")).cast("double") / F.col("_weight_left").cast("double")
    w = w.withColumn("_level", level)
    over = F.col("cap").cast("double") <= F.col("_level") * F.col("weight").cast("double")
    w = w.withColumn("_over", over)
    # The level at which water stands: that of the first source that is not capped.
    stands = F.min(F.when(~F.col("_over"), F.struct((F.col("cap") / F.col("weight")).alias("o"), F.col("_level")))).over(Window.partitionBy())
    w = w.withColumn("_stands", stands["_level"])
    target = F.when(F.col("_over"), F.col("cap").cast("double")).otherwise(
        F.least(F.col("_stands") * F.col("weight").cast("double"), F.col("cap").cast("double"))
    )
    return w.select("source", "source_size", "weight", target.alias("target"))


def _crossed(rank: Column, rate: Column, offset: Column) -> Column:
    """Integer boundaries between the prefix sums before and after the document of this rank."""
    before = F.floor(rank.cast("double") * rate + offset)
    return (F.floor((rank + 1).cast("double") * rate + offset) - before).cast("bigint")


def mix(docs: DataFrame, seed: int = 0, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Every document with its size, its source's size and target, its number of copies and
    the words taken. Only ids, sources and sizes are shuffled, ordered by (source, size), so a
    source that holds most rows spreads over many tasks."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    order = [F.col("source").asc_nulls_last(), F.col("size").desc(), F.col("doc_id")]
    rows = materialize(ranked(rows, order))
    sizes = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n"), F.min("_rank").alias("_first")
    )
    plan = source_targets(sizes.select("source", "source_size"), max_repeat)
    plan = plan.join(sizes.select(F.col("source").alias("_s"), "_first"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    name = F.concat(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")), F.lit(f"|{seed}"))
    start = F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0 * OFFSETS)
    plan = plan.withColumn("_rate", rate).withColumn("_start", start)
    # One row per source, written: the jobs below read it instead of planning and computing it again.
    plan = materialize(plan.withColumnRenamed("source", "_source"))
    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_at", F.col("_rank") - F.col("_first"))

    def offset(k: int) -> Column:
        return F.col("_start") + F.lit(k / OFFSETS)

    taken = [F.sum(_crossed(F.col("_at"), F.col("_rate"), offset(k)) * F.col("size")).alias(f"t{k}") for k in range(OFFSETS)]
    tried = placed.groupBy("_source").agg(F.max("target").alias("_goal"), *taken)
    gap = F.array(*[F.struct(F.abs(F.col(f"t{k}") - F.col("_goal")).alias("gap"), F.lit(k).alias("k")) for k in range(OFFSETS)])
    best = materialize(tried.select(F.col("_source").alias("_best_of"), F.array_min(gap)["k"].alias("_k")))
    out = placed.join(best, F.col("source").eqNullSafe(F.col("_best_of")))
    chosen = F.col("_start") + F.col("_k").cast("double") / F.lit(float(OFFSETS))
    out = out.withColumn("copies", _crossed(F.col("_at"), F.col("_rate"), chosen))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix itself: each row of ``docs`` repeated as often as it was drawn.

    Rows are matched to their draw by id and size, which costs one shuffle of the texts;
    rows that share id and size (repeated rows) are drawn the same number of times in all,
    dealt out among them.
    """
    drawn = mix(docs, seed).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    drawn = drawn.where("_copies > 0").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_src"), F.col("size").alias("_sz"), "_copies", "_rows"
    )
    sized = boxed(docs, "doc_id", "source", "text").withColumn("_size", word_count(F.col("text")))
    same = (
        F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_src")) & (F.col("_size") == F.col("_sz"))
    )
    out = sized.join(drawn, same)
    # The n-th of several rows with equal id, source and size takes the n-th share of their copies.
    nth = F.row_number().over(Window.partitionBy("doc_id", "source", "_size").orderBy("text")) - 1
    out = out.withColumn("_nth", nth)
    share = F.floor(F.col("_copies") * (F.col("_nth") + 1) / F.col("_rows")) - F.floor(F.col("_copies") * F.col("_nth") / F.col("_rows"))
    out = out.withColumn("_times", share.cast("int")).where("_times > 0")
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return unboxed(out, docs.columns, "doc_id", "source", "text")


def query(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def oracle_sql() -> str:
    """The same draw in DuckDB, with the same arithmetic in the same order."""
    tried = ",\n".join(
        f"sum((floor((nth + 1)::double * rate + (start + {k / OFFSETS}::double)) - floor(nth::double * rate + (start + {k / OFFSETS}::double)))::bigint * size) as t{k}"
        for k in range(OFFSETS)
    )
    gaps = ", ".join(f"{{'gap': abs(t{k} - goal), 'k': {k}}}" for k in range(OFFSETS))
    return f"""
with rows as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents
), sized as (
  select source, sum(size)::bigint as source_size from rows group by source
), weighed as (
  select *, ((row_number() over (order by source nulls last) - 1) % {WEIGHT_CYCLE} + 1)::bigint as weight, (source_size * {MAX_REPEAT})::bigint as cap from sized
), level as (
  select *, ((sum(source_size) over ()) - ((sum(cap) over need) - cap))::double
         / ((sum(weight) over ()) - (sum(weight) over need) + weight)::double as lvl
  from weighed window need as (order by cap::double / weight::double, source nulls last rows unbounded preceding)
), capped as (
  select *, cap::double <= lvl * weight::double as over_cap from level
), stands as (
  select min_by(lvl, cap::double / weight::double) as lvl from capped where not over_cap
), plan as (
  select source, source_size, case when over_cap then cap::double
         else least((select lvl from stands) * weight::double, cap::double) end as target
  from capped
), placed as (
  select r.doc_id, r.source, r.size, p.source_size, p.target,
         case when p.source_size > 0 then p.target / p.source_size::double else 0.0::double end as rate,
         ('0x' || substr(md5(coalesce('s' || r.source, 'n') || '|0'), 1, 8))::bigint::double / {4294967296.0 * OFFSETS}::double as start,
         row_number() over (partition by r.source order by r.size desc, r.doc_id nulls first) - 1 as nth
  from rows r join plan p on r.source is not distinct from p.source
), tried as (
  select source, max(target) as goal, {tried} from placed group by source
), best as (
  select source, list_min([{gaps}]).k as k from tried
)
select p.doc_id, p.size, p.source_size, p.target, p.source,
       (floor((nth + 1)::double * rate + (start + k::double / {float(OFFSETS)}::double))
        - floor(nth::double * rate + (start + k::double / {float(OFFSETS)}::double)))::bigint as copies,
       copies * p.size as taken
from placed p join best b on p.source is not distinct from b.source
"""
