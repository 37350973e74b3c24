"""Exact numbering and running totals inside groups of any size.

A plain window puts a whole group into one task. Here the rows are dealt to partitions by
sampled boundaries of (keys, order), whatever the range of the values; totals per key and
partition are accumulated over the partitions, and the window runs inside each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfield.session import cut


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[Column], weight: Column, name: str) -> DataFrame:
    """Add ``name``, the sum of ``weight`` over the rows of the same ``keys`` up to this one by ``order``.

    Rows that tie in ``order`` lie in one partition; they are taken in any order.
    """
    keys = list(keys)
    # the partition of a row must not change between the totals and the window
    dealt = cut(df.withColumn("_weight", weight).repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy(*keys, "_part").agg(F.sum("_weight").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_part").alias("_at"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("_part") == F.col("_at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    local = dealt.withColumn("_local", F.sum("_weight").over(inside))
    return local.join(offsets, same).withColumn(name, (F.col("_offset") + F.col("_local")).cast("bigint")).select(*df.columns, name)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Add ``name`` = 1, 2, ... within ``keys`` by ``order``."""
    return running_total(df, keys, order, F.lit(1), name)


def magnitude_bucket(value: Column, steps: int = 256) -> Column:
    """A bucket that grows with a positive double: its exponent and the first mantissa steps.

    At most ``steps`` buckets per power of two, so the number of buckets is bounded by
    the range of exponents and not by the number of rows.
    """
    exponent = F.floor(F.log2(value))
    mantissa = value * F.pow(F.lit(2.0), -exponent)
    bucket = exponent * steps + F.floor((mantissa - 1) * steps)
    return F.when(value > 0, bucket).otherwise(F.lit(-2000 * steps)).cast("bigint")
