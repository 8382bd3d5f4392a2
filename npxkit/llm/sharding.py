"""Sharding by jump consistent hashing, built from SQL expressions only.

Nulls: a null id is hashed as the key 0 (its own stable key); a null text counts no bytes and
its crc32 is that of no bytes. Empty and very long texts need nothing special (only their
length and checksum travel). Repeated rows and repeated ids go to the same shard and get
slots of their own. An empty table gives an empty result. Extra columns are ignored by
``shard_rows``; ``jump_shard`` is a plain expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import ranked

# Fixed values of the jump hash: the multiplier of its 64-bit congruential step.
MULTIPLIER = 2862933555777941757
ROW_BYTES = 8


def jump_shard(key: Column, shards: int) -> Column:
    """Shard in ``[0, shards)`` of a bigint key. With one shard more a key either stays or
    moves to the new shard.

    The congruential step is done in ``decimal(38, 0)``, which holds the product of two 64-bit
    numbers, so nothing overflows under ANSI rules. The candidate grows in every step, hence
    at most ``shards`` steps are needed; finished keys fall through.
    """
    wide = "decimal(38,0)"
    two64 = F.lit("18446744073709551616").cast(wide)
    two33 = F.lit("8589934592").cast(wide)
    start = F.when(key < 0, key.cast(wide) + two64).otherwise(key.cast(wide)).cast(wide)

    def step(state: Column, _: Column) -> Column:
        seed = (state["seed"] * F.lit(str(MULTIPLIER)).cast("decimal(19,0)") + F.lit(1)).cast(wide) % two64
        # The upper 31 bits; the remainder goes first, for a decimal quotient is rounded.
        high = ((seed - seed % two33) / two33).cast("double")
        # (b + 1) * 2^31 / ((seed >> 33) + 1)
        ahead = F.floor((state["ahead"] + 1).cast("double") * (F.lit(2147483648.0) / (high + 1.0))).cast("bigint")
        done = state["ahead"] >= shards
        return F.when(done, state).otherwise(
            F.struct(seed.cast(wide).alias("seed"), state["ahead"].alias("at"), F.least(ahead, F.lit(1 << 40)).alias("ahead"))
        )

    first = F.struct(start.alias("seed"), F.lit(-1).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("ahead"))
    steps = F.sequence(F.lit(1), F.lit(shards + 1))
    return F.aggregate(steps, first, step, lambda s: s["at"].cast("int"))


def shard_rows(docs: DataFrame, shards: int) -> DataFrame:
    """Every document with its shard among ``shards``, its slot there (gapless from 0, by id)
    and its shard if there were one more. Only ids, sizes and checksums are shuffled."""
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        jump_shard(key, shards).alias("shard"),
        jump_shard(key, shards + 1).alias("grown_shard"),
    )
    rows = ranked(rows, ["shard", "doc_id", "text_crc32", "size"])
    first = rows.groupBy("shard").agg(F.min("_rank").alias("_first"))  # one row per shard
    return rows.join(F.broadcast(first), "shard").withColumn("slot", F.col("_rank") - F.col("_first"))


def query(docs: DataFrame, shards: int = 24) -> DataFrame:
    """All documents in 24 shards under the ``key`` law."""
    return shard_rows(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


# Fixed value: the reflected polynomial of the checksum.
CRC_POLYNOMIAL = 0xEDB88320


def oracle_sql(shards: int = 24) -> str:
    """The same rows in DuckDB: the jump hash as a recursive query over 128-bit integers, the
    checksum as a fold over the bytes with a generated table."""
    seed = f"(seed * {MULTIPLIER}::hugeint + 1) % 18446744073709551616::hugeint"
    return f"""
with recursive docs as materialized (
  select doc_id, coalesce(doc_id, 0)::bigint as k, octet_length(encode(coalesce(text, ''))) as bytes, hex(encode(coalesce(text, ''))) as h from documents
), crc_table as (
  select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda c, z: case when c % 2 = 1 then xor(c >> 1, {CRC_POLYNOMIAL}) else c >> 1 end)) as t
), summed as (
  select doc_id, k, bytes,
         xor(list_reduce(list_prepend(4294967295, list_transform(range(bytes), lambda i: ('0x' || substr(h, 2 * i::bigint + 1, 2))::bigint)),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::bigint as text_crc32
  from docs, crc_table
), jump(k, buckets, seed, b0, ahead) as (
  select distinct k, v.b, k::hugeint + case when k < 0 then 18446744073709551616::hugeint else 0::hugeint end, -1::bigint, 0::bigint
  from docs, (values ({shards}), ({shards + 1})) v(b)
  union all
  select k, buckets, {seed}, ahead,
         floor((ahead + 1)::double * (2147483648.0::double / (({seed} // 8589934592::hugeint)::double + 1.0::double)))::bigint
  from jump where ahead < buckets
), placed as (
  select k, buckets, max(b0)::integer as shard from jump group by k, buckets
)
select doc_id, (bytes + {ROW_BYTES})::bigint as size, text_crc32, 'key' as law, a.shard as shard,
       row_number() over (partition by a.shard order by doc_id nulls first, text_crc32, bytes) - 1 as slot, b.shard as grown_shard
from summed d
join placed a on a.k = d.k and a.buckets = {shards}
join placed b on b.k = d.k and b.buckets = {shards + 1}
"""
