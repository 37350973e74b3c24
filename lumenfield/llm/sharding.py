r"""Sharding by fixed virtual slots and a versioned slot-to-shard map; DataFrame functions only.

A record's virtual slot is a hash of its key and size, so it never changes. Only the map
from slots to shards does: the first version deals the slots round, and each later one is
an edit of the one before, made from the bytes now in each slot. An edit leaves the
largest slots of a shard where they are as long as they fit the mean, and gives the rest,
largest first, to the shard that holds least. Shards that are new take what the others
give up; shards that are gone give up all. Versions are kept side by side in one folder.

The law of the shards is ``bytes``: sizes near equal. The map has ``SLOTS`` rows whatever
the input, so it may be sorted in one task. A record's place in its shard comes from the
rows in the slots before its own and its order inside its slot. Equal records (key, size,
checksum) are counted before they are shuffled and dealt out again afterwards, so that a
record repeated any number of times burdens no task.

Null text: no bytes, checksum 0. Null keys are hashed as ''. Empty table: empty result.
Columns besides key and text are ignored, whatever their names. A single record larger
than the mean makes its shard larger.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfield.session import cut, work_path

SLOTS = 1 << 13
SHARDS = 40
HEADER = 16


def records(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """(key, size, text_crc32, v): each record with its virtual slot; at most 65,536 slots."""
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + HEADER).cast("long")
    crc = F.coalesce(F.crc32(text), F.lit(0)).cast("long")
    digest = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), size.cast("string")))
    slot = F.conv(F.substring(digest, 1, 4), 16, 10).cast("int") % slots
    return docs.select(F.col(key), size.alias("size"), crc.alias("text_crc32"), slot.alias("v"))


def loads(rows: DataFrame) -> DataFrame:
    """(v, bytes, n) of each slot that holds records."""
    return rows.groupBy("v").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def first_map(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(v, shard): the slots dealt round."""
    return spark.range(slots).select(F.col("id").cast("int").alias("v"), (F.col("id") % shards).cast("int").alias("shard"))


def edit(current: DataFrame, held: DataFrame, shards: int) -> DataFrame:
    """(v, shard): the next version of a map, for ``shards`` shards and the bytes that the slots hold now."""
    slots = current.join(held.select("v", "bytes"), "v", "left").fillna(0, ["bytes"])
    order = Window.partitionBy("shard").orderBy(F.desc("bytes"), "v").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("bytes").over(order), F.lit(0))
    fits = (before + F.col("bytes")) * shards <= F.sum("bytes").over(Window.partitionBy())
    slots = slots.withColumn("stays", (F.col("shard") < shards) & (fits | (before == 0) | (F.col("bytes") == 0)))
    kept = slots.filter("stays")
    sums = kept.groupBy("shard").agg(F.sum("bytes").alias("bytes")).agg(F.map_from_entries(F.collect_list(F.struct("shard", "bytes"))).alias("sums"))
    pool = slots.filter("not stays").agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("b"), "v"))).alias("pool"))
    start = f"transform(sequence(0, {shards - 1}), i -> coalesce(sums[i], 0L))"
    least = "int(array_position(acc.held, array_min(acc.held))) - 1"
    step = f"(acc, x) -> named_struct('held', transform(acc.held, (h, i) -> if(i = {least}, h - x.b, h)), 'shard', array_append(acc.shard, {least}))"
    dealt = F.expr(f"aggregate(pool, named_struct('held', {start}, 'shard', cast(array() as array<int>)), {step}, acc -> acc.shard)")
    # both are single rows
    moved = pool.withColumn("_", F.lit(1)).join(sums.withColumn("_", F.lit(1)), "_").select(F.inline(F.arrays_zip("pool", dealt.alias("shard"))))
    return kept.select("v", "shard").unionByName(moved.select("pool.v", "shard"))


def save_map(slot_map: DataFrame, folder: str, version: int) -> None:
    """Add a version; an existing one is never overwritten."""
    slot_map.coalesce(1).write.mode("errorifexists").parquet(f"{folder}/version={version:06d}")


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """One version of the map, the latest by default."""
    if version is None:
        version = spark.read.parquet(folder).agg(F.max("version")).first()[0]
    return spark.read.parquet(os.path.join(folder, f"version={version:06d}"))


def placed(rows: DataFrame, slot_map: DataFrame, held: DataFrame) -> DataFrame:
    """(key, size, text_crc32, shard, slot): each record's shard and its place there, from 0 without gaps."""
    names = [c for c in rows.columns if c != "v"]
    first = Window.partitionBy("shard").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    begin = held.join(slot_map, "v").withColumn("_begin", F.coalesce(F.sum("n").over(first), F.lit(0))).select("v", "shard", "_begin")
    order = Window.partitionBy("v").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    groups = rows.groupBy("v", *names).agg(F.count("*").alias("_n")).withColumn("_place", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    at = F.col("_begin") + F.col("_place")
    return groups.join(begin, "v").select(*names, "shard", F.explode(F.sequence(at, at + F.col("_n") - 1)).alias("slot"))


def rebalance(spark: SparkSession, folder: str, held: DataFrame, shards: int) -> DataFrame:
    """Edit the latest version in ``folder`` for the bytes that slots hold now; saves and returns the next version."""
    version = spark.read.parquet(folder).agg(F.max("version")).first()[0]
    save_map(edit(load_map(spark, folder, version), held, shards), folder, version + 1)
    return load_map(spark, folder, version + 1)


def shard(docs: DataFrame, folder: str, shards: int = SHARDS, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """(key, size, text_crc32, shard, slot) of all records by the first map and its edit for them, both saved in ``folder``."""
    spark = docs.sparkSession
    rows = cut(records(docs, key, text, slots))
    held = cut(loads(rows).coalesce(1))
    save_map(first_map(spark, shards, slots), folder, 0)
    return placed(rows, rebalance(spark, folder, held, shards), held)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = shard(docs, work_path(spark, "slots"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLE = rf"""
with recursive tab as (
  select list(c order by i) t
  from (select i, list_reduce([i::ubigint, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end) c from range(256) r(i))
), b as (
  select doc_id, [('0x' || x)::ubigint for x in regexp_extract_all(hex(encode(coalesce(text, ''))), '..')] b from documents
), d as (
  select doc_id, (len(b) + {HEADER})::bigint size,
    xor(list_reduce(list_prepend(4294967295::ubigint, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255)::bigint + 1])), 4294967295)::bigint crc
  from b, tab
), r as materialized (
  select *, ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || size), 1, 4))::int % {SLOTS} v from d
), s as materialized (
  select v, sum(size)::bigint bytes, count(*) n, v % {SHARDS} shard from r group by v
), e as materialized (
  select *, coalesce(sum(bytes) over (partition by shard order by bytes desc, v rows between unbounded preceding and 1 preceding), 0) bef,
    sum(bytes) over () total from s
), k as (
  select v, n, bytes, shard from e where (bef + bytes) * {SHARDS} <= total or bef = 0
), p as materialized (
  select row_number() over (order by bytes desc, v) i, v, n, bytes from e where not ((bef + bytes) * {SHARDS} <= total or bef = 0)
), q as (
  select list(coalesce(x, 0)::bigint order by i) held from range({SHARDS}) r(i) left join (select shard, sum(bytes) x from k group by shard) on shard = i
), z as (
  select 0::bigint i, held, -1::bigint shard from q
  union all
  select p.i, [case when j = list_position(z.held, list_min(z.held)) then z.held[j] + p.bytes else z.held[j] end for j in range(1, {SHARDS + 1})],
    list_position(z.held, list_min(z.held)) - 1
  from z join p on p.i = z.i + 1
), m as (
  select v, n, shard from k union all select p.v, p.n, z.shard from z join p on p.i = z.i
), g as (
  select v, shard, coalesce(sum(n) over (partition by shard order by v rows between unbounded preceding and 1 preceding), 0) beg from m
)
select doc_id, size, crc text_crc32, 'bytes' law, shard::int shard,
  (beg + row_number() over (partition by r.v order by doc_id nulls first, size, crc) - 1)::bigint slot, null::int grown_shard
from r join g on g.v = r.v
"""
