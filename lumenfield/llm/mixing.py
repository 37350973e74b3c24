"""Mixing sources to target weights by capped water-filling; DataFrame functions only.

Each source has a weight and may be repeated at most ``epochs`` times. A budget is dealt
out by weight; a source above its cap is clamped and the excess goes to the others by
weight, until none is above. That fixed point is a water level: with the sources in order
of cap / weight, a prefix is clamped and the rest get level * weight, so one running sum
over the sources finds it. Within a source every document is taken floor(rate) times, and
once more for the fraction: documents in a seeded order, as many as fill the source's
rest, the last one if at least half of it fits.

The running sums go over buckets of the seeded order first, so no source is one window.
Rows that share a doc_id are told apart by text size only and count as separate rows.
Null text: size 0, taken 0. Null source: a source of its own, last in order. Empty table:
empty result. A budget beyond all caps fills every cap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfield.session import cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2.0
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def weighed(docs: DataFrame, source: str, weights: tuple[int, ...]) -> DataFrame:
    """(source, weight): the sources by code point, null last, with the weights repeating."""
    place = F.row_number().over(Window.orderBy(F.col(source).isNull(), F.col(source))) - 1
    return docs.select(source).distinct().withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))


def water_fill(sources: DataFrame, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """``sources(weight, source_size)`` with ``target``; one row per source, so a single sorted pass is small."""
    level = Window.orderBy(F.col("_cap") / F.col("weight"), "_cap", "weight").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    filled = (
        sources.withColumn("_cap", F.col("source_size") * F.lit(epochs))
        .withColumn("_budget", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("_before", F.coalesce(F.sum("_cap").over(level), F.lit(0.0)))
        .withColumn("_rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(level), F.lit(0.0)))
        .withColumn("_level", (F.col("_budget") - F.col("_before")) / F.col("_rest"))
    )
    # clamping a source below the level raises the level of the rest, clamping one above it lowers it: the highest is right
    reached = F.max("_level").over(everything)
    return filled.withColumn("target", F.least("_cap", reached * F.col("weight"))).drop("_cap", "_budget", "_before", "_rest", "_level")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """(key, size, source, source_size, target, whole, extra, taken): how often each document is taken."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    order = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    sized = cut(docs.select(F.col(key), F.col(source).alias("source"), size.alias("size"), order.alias("_order"), F.substring(order, 1, 3).alias("_bucket")))
    buckets = cut(sized.groupBy("source", "_bucket").agg(F.sum("size").alias("_words")))
    per_source = buckets.groupBy("source").agg(F.sum("_words").alias("source_size"))
    targets = water_fill(per_source.join(weighed(per_source, "source", weights).withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), share, epochs)
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("_start", F.coalesce(F.sum("_words").over(before), F.lit(0))).drop("_words")
    plan = starts.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "weight")
    plan = plan.withColumnsRenamed({"source": "_s", "_bucket": "_b"})
    inner = Window.partitionBy("source", "_bucket").orderBy("_order", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    placed = placed.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    extra = F.col("_start") + F.col("_inner") + F.col("size") / 2.0 <= rest
    return (
        placed.withColumn("whole", whole)
        .withColumn("extra", extra & (F.col("size") > 0) & (F.col("whole") < epochs))
        .withColumn("taken", F.col("size") * (F.col("whole") + F.col("extra").cast("long")))
        .drop("_order", "_bucket", "_inner", "_s", "_b", "_start")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it, one row per repetition."""
    rates = mix(docs).select("doc_id", "source", (F.col("whole") + F.col("extra").cast("long")).alias("_times")).filter("_times > 0")
    rates = rates.groupBy("doc_id", "source").agg(F.min("_times").alias("_times")).withColumnsRenamed({"doc_id": "_id", "source": "_src"})
    kept = docs.join(rates, docs["doc_id"].eqNullSafe(F.col("_id")) & docs["source"].eqNullSafe(F.col("_src")))
    return kept.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select(*docs.columns)


ORACLE = rf"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size, md5('{SEED}:' || doc_id) ord
  from documents
), src as (
  select source, sum(size)::bigint source_size from sized group by source
), w as (
  select source, source_size, 2.0::double * source_size cap,
    [{', '.join(f'{w}.0' for w in WEIGHTS)}][(row_number() over (order by source is null, source) - 1) % {len(WEIGHTS)} + 1]::double weight
  from src
), f as (
  select *, sum(source_size) over () * 1.5::double budget,
    coalesce(sum(cap) over (order by cap / weight, cap, weight rows between unbounded preceding and 1 preceding), 0) bef,
    sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, cap, weight rows between unbounded preceding and 1 preceding), 0) rest
  from w
), l as (select *, (budget - bef) / rest lev from f),
t as (
  select source, source_size, least(cap, (max(lev) over ()) * weight)::double target from l
), p as (
  select s.doc_id, s.size, t.source_size, t.target,
    case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end::bigint whole,
    coalesce(sum(s.size) over (partition by s.source order by s.ord, s.size rows between unbounded preceding and 1 preceding), 0) bef
  from sized s join t on s.source is not distinct from t.source
)
select doc_id, size, source_size, target,
  (size * (whole + case when bef + size / 2.0::double <= target - whole * source_size and size > 0 and whole < 2 then 1 else 0 end))::bigint taken
from p
"""
