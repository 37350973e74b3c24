"""Counts and percentages by field, replicate and run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfield.functions.scalars import percent, total, yes
from lumenfield.operators.ranks import running_total

METRICS = ["viability_percent", "ebfp_all_percent", "ebfp_live_percent", "double_positive_percent"]

COUNTS = [
    "total", "live_only", "dead_only", "double_positive",
    "ebfp_all_count", "ebfp_all_scorable", "ebfp_all_unscorable",
    "ebfp_live_count", "ebfp_live_scorable", "ebfp_live_unscorable",
    "ebfp_dead_count", "ebfp_dead_scorable",
    "ebfp_channel_not_provided", "ebfp_live_channel_not_provided",
]


def object_counts() -> list[Column]:
    """The integer counts of one group of classified objects."""
    here = F.col("object_id").isNotNull()
    live = here & (F.col("status") == "live_only")
    other = here & (F.col("status") != "live_only")
    provided = yes(F.col("provided"))
    scorable = here & provided & yes(F.col("scorable"))
    positive = scorable & yes(F.col("detected"))
    return [
        total(here).alias("total"),
        total(live).alias("live_only"),
        total(here & (F.col("status") == "dead_only")).alias("dead_only"),
        total(here & (F.col("status") == "double_positive")).alias("double_positive"),
        total(positive).alias("ebfp_all_count"),
        total(scorable).alias("ebfp_all_scorable"),
        total(here & ~scorable).alias("ebfp_all_unscorable"),
        total(positive & live).alias("ebfp_live_count"),
        total(scorable & live).alias("ebfp_live_scorable"),
        total(live & ~scorable).alias("ebfp_live_unscorable"),
        total(positive & other).alias("ebfp_dead_count"),
        total(scorable & other).alias("ebfp_dead_scorable"),
        total(here & ~provided).alias("ebfp_channel_not_provided"),
        total(live & ~provided).alias("ebfp_live_channel_not_provided"),
    ]


def with_percentages(counts: DataFrame) -> DataFrame:
    """Percentages from pooled counts; an empty denominator gives NULL."""
    c = F.col
    return counts.withColumns(
        {
            "viability_percent": percent(c("live_only"), c("total")),
            "ebfp_all_percent": percent(c("ebfp_all_count"), c("ebfp_all_scorable")),
            "ebfp_live_percent": percent(c("ebfp_live_count"), c("ebfp_live_scorable")),
            "double_positive_percent": percent(c("double_positive"), c("total")),
            "viability_excluding_double_percent": percent(
                c("live_only"), c("live_only") + c("dead_only")
            ),
            "green_any_percent": percent(c("live_only") + c("double_positive"), c("total")),
            "ebfp_dead_percent": percent(c("ebfp_dead_count"), c("ebfp_dead_scorable")),
        }
    ).drop("ebfp_dead_scorable")


def count_summary(objects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The twenty-column summary of ``objects`` per group."""
    return with_percentages(objects.groupBy(*keys).agg(*object_counts()))


def field_counts(fields: DataFrame, objects: DataFrame) -> DataFrame:
    """Integer counts per field; a field without objects keeps its row of zeros."""
    counted = objects.groupBy("image_id").agg(*object_counts())
    joined = fields.join(counted, "image_id", "left")
    return joined.withColumns({name: F.coalesce(F.col(name), F.lit(0)) for name in COUNTS})


def field_summary(fields: DataFrame, objects: DataFrame) -> DataFrame:
    """``fields`` needs h, w, dy, dx (um) and ebfp_provided besides its ids."""
    area = F.col("h") * F.col("w") * F.col("dy") * F.col("dx") / F.lit(1e6)
    summary = with_percentages(field_counts(fields, objects))
    return summary.withColumn("detected_objects_per_mm2", F.col("total") / area).select(
        "image_id", "replicate_id", "ebfp_provided", *[n for n in COUNTS if n != "ebfp_dead_scorable"],
        "viability_percent", "ebfp_all_percent", "ebfp_live_percent", "double_positive_percent",
        "viability_excluding_double_percent", "green_any_percent", "ebfp_dead_percent",
        "detected_objects_per_mm2",
    )


def replicate_summary(fields: DataFrame, objects: DataFrame) -> DataFrame:
    """Counts pooled over a replicate's fields, then percentages of the pooled counts."""
    pooled = field_counts(fields, objects).groupBy("replicate_id").agg(
        F.count("*").alias("n_fields"),
        total(F.col("ebfp_provided")).alias("n_fields_with_ebfp"),
        *[F.sum(name).alias(name) for name in COUNTS],
    )
    return with_percentages(pooled)


def long_metrics(summary: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return summary.unpivot(list(keys), list(metrics), "metric", "value")


def replicate_stats(summary: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Unweighted mean, sample SD and number of defined values across replicates."""
    return long_metrics(summary, ["replicate_id"], metrics).groupBy("metric").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sample_sd"),
        F.count("value").alias("n_defined"),
    )


def grid_counts(objects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Status counts and viability of a threshold grid."""
    counts = objects.groupBy(*keys).agg(
        total(F.col("status") == "live_only").alias("live_only"),
        total(F.col("status") == "dead_only").alias("dead_only"),
        total(F.col("status") == "double_positive").alias("double_positive"),
        F.count("*").alias("total"),
    )
    return counts.withColumn("viability_percent", percent(F.col("live_only"), F.col("total")))


def pooled_grid(grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    names = ["live_only", "dead_only", "double_positive", "total"]
    pooled = grid.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])
    return pooled.withColumn("viability_percent", percent(F.col("live_only"), F.col("total")))


def q_sweep(called: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Detections per field at several q thresholds, over scorable objects."""
    swept = called.withColumn("q_threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    scorable, live = yes(F.col("scorable")), F.col("status") == "live_only"
    positive = scorable & yes(F.col("q") <= F.col("q_threshold"))
    counts = swept.groupBy("image_id", "q_threshold").agg(
        total(positive).alias("ebfp_all_count"),
        total(scorable).alias("ebfp_all_scorable"),
        total(positive & live).alias("ebfp_live_count"),
        total(scorable & live).alias("ebfp_live_scorable"),
    )
    return counts.withColumns(
        {
            "ebfp_all_percent": percent(F.col("ebfp_all_count"), F.col("ebfp_all_scorable")),
            "ebfp_live_percent": percent(F.col("ebfp_live_count"), F.col("ebfp_live_scorable")),
        }
    )


def run_warnings(fields: DataFrame, objects: DataFrame) -> DataFrame:
    """(rule, affected) rows, only for rules that fire. ``objects`` carries mask audit columns."""
    by_object = objects.agg(
        total(F.col("mask_pixels_overwritten") > 0).alias("masks_overlap"),
        total(yes(F.col("mask_lost"))).alias("masks_lost"),
        total(~yes(F.col("scorable"))).alias("unscorable"),
    ).unpivot([], ["masks_overlap", "masks_lost", "unscorable"], "rule", "affected")
    by_field = fields.agg(total(~F.col("ebfp_provided")).alias("affected")).select(
        F.lit("channel_not_provided").alias("rule"), "affected"
    )
    replicates = (
        fields.agg(F.count_distinct("replicate_id").alias("affected"))
        .filter("affected < 2")
        .select(F.lit("fewer_than_two_replicates").alias("rule"), "affected")
    )
    fired = by_object.unionByName(by_field).filter("affected > 0")
    return fired.unionByName(replicates)


def median(table: DataFrame, metric: str) -> float | None:
    """The exact median: counts of each value are added up along the values; None without any."""
    values = table.filter(F.col(metric).isNotNull()).groupBy(metric).agg(F.count("*").alias("_n"))
    ranked = running_total(values, [], [F.col(metric)], F.col("_n"), "_upto")
    size = ranked.agg(F.max("_upto")).first()[0]
    if not size:
        return None
    middle = ranked.agg(*[F.min(F.when(F.col("_upto") >= rank, F.col(metric))) for rank in ((size + 1) // 2, size // 2 + 1)]).first()
    return 0.5 * middle[0] + 0.5 * middle[1]


def representative_field(summary: DataFrame, metric: str, order: str) -> DataFrame:
    """The field nearest to the median of ``metric``; the first field when none is defined."""
    distance = F.abs(F.col(metric) - F.lit(median(summary, metric)).cast("double"))
    ranked = summary.withColumn("_distance", distance)
    pick = ranked.agg(
        F.min_by(
            F.struct(*summary.columns),
            F.struct(F.col(metric).isNull(), F.coalesce("_distance", F.lit(0.0)), F.col(order)),
        ).alias("best")
    )
    return pick.select("best.*").filter(F.col(order).isNotNull())
