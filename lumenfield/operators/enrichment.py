"""False-discovery control over all scorable objects of a run, or per sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfield.functions.scalars import yes
from lumenfield.operators.ranks import magnitude_bucket

HEAVY = 1000
STEPS = 1024


def adjust(df: DataFrame, p: str = "p", keys: Sequence[str] = (), out: str = "q") -> DataFrame:
    """Benjamini-Hochberg q of ``p`` within ``keys`` (the whole run when empty).

    NULL and NaN stay without q and are not part of the family; other values outside [0, 1]
    are an error. The family is reduced to distinct p-values first; ranks and suffix minima
    then run per magnitude bucket, and only one row per bucket is accumulated over the whole
    family. On the way back to the rows, values that many rows share (at most ``HEAVY`` of
    them can hold that share) come by broadcast, and these rows and those without p are
    spread by their hash, so no value burdens one task.
    """
    keys = list(keys)
    known = df.filter(F.col(p).isNotNull() & ~F.isnan(p))
    known = known.withColumn(p, F.when(F.col(p).between(0, 1), F.col(p)).otherwise(F.raise_error(F.lit("p-values must lie in [0, 1]")).cast("double")))
    distinct = (
        known.groupBy(*keys, p).agg(F.count("*").alias("_ties"))
        .withColumn("_bucket", magnitude_bucket(F.col(p), STEPS))
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(p)
    family = Window.partitionBy(*keys)
    along = family.orderBy("_bucket")

    sizes = distinct.groupBy(*keys, "_bucket").agg(F.sum("_ties").alias("_size"))
    sizes = sizes.select(
        *keys, "_bucket",
        F.coalesce(F.sum("_size").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_size").over(family).alias("_n"), F.lit(distinct.agg(F.sum("_ties")).scalar()).alias("_all"),
    )
    rank = F.col("_before") + F.sum("_ties").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    raw = distinct.join(sizes, [*keys, "_bucket"]).withColumn(
        "_raw", (F.col(p) * F.col("_n").cast("double")) / rank.cast("double")
    )
    lows = raw.groupBy(*keys, "_bucket").agg(F.min("_raw").alias("_low"))
    lows = lows.select(
        *keys, "_bucket", F.min("_low").over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_later")
    )
    here = F.min("_raw").over(inside.rowsBetween(0, Window.unboundedFollowing))
    adjusted = raw.join(lows, [*keys, "_bucket"]).select(
        *keys, p, F.least(F.lit(1.0), here, F.col("_later")).alias(out), (F.col("_ties") * HEAVY > F.col("_all")).alias("_heavy")
    )
    heavy = adjusted.filter("_heavy").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, p])], F.col(out).alias("_q"))
    same = F.lit(True)
    for i, k in enumerate([*keys, p]):
        same = same & (F.col(k) == F.col(f"_k{i}"))
    met = df.join(F.broadcast(heavy), same, "left").drop(*[f"_k{i}" for i in range(len(keys) + 1)])
    # no p is negative, so the others find no partner wherever they go
    spread = -1.0 - F.pmod(F.xxhash64(*df.columns), F.lit(1 << 20))
    placed = met.withColumn("_p", F.when(F.col("_q").isNull() & F.col(p).isNotNull() & ~F.isnan(p), F.col(p)).otherwise(spread))
    light = adjusted.filter("not _heavy").select(*keys, F.col(p).alias("_p"), out)
    joined = placed.join(light, [*keys, "_p"], "left")
    return joined.select(*df.columns, F.coalesce("_q", out).alias(out))


def classify(df: DataFrame, threshold: float = 0.05, sample: str | None = "image_id") -> DataFrame:
    """Pooled q, per-sample q and the three-valued call (NULL when not scorable)."""
    out = adjust(df, "p", out="q")
    if sample:
        out = adjust(out, "p", keys=[sample], out="q_sample")
    return out.withColumn("detected", F.when(yes(F.col("scorable")), F.col("q") <= threshold))


def optional_channel(fields: DataFrame, objects: DataFrame, measured: DataFrame) -> DataFrame:
    """Keep every object; a field without the channel has NULL measurements, not zeros."""
    joined = (
        objects.join(fields.select("image_id", F.col("ebfp_provided").alias("provided")), "image_id", "left")
        .join(measured, ["image_id", "object_id"], "left")
    )
    given = yes(F.col("provided"))
    return joined.withColumns(
        {
            "provided": given,
            "p": F.when(given, F.col("p")),
            "scorable": given & yes(F.col("scorable")),
            "ebfp_status": F.when(~given, "channel_not_provided")
            .when(yes(F.col("scorable")), "scorable")
            .otherwise("insufficient_null_locations"),
        }
    )
