"""Sensitivity sweeps: one segmentation per (channel, setting), matched over all setting pairs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfield.functions.scalars import percent
from lumenfield.operators import regions
from lumenfield.operators.matching import admissible_pairs, one_to_one
from lumenfield.operators.trees import component_tree, tree_regions
from lumenfield.session import cut

Setting = tuple[str, float, float, int]  # name, low, high, min_area


def with_settings(px: DataFrame, settings: Mapping[str, Sequence[Setting]]) -> DataFrame:
    """One copy of each mask pixel per setting of its channel; the low threshold applies at once."""
    choices = F.lit(None)
    for channel, options in settings.items():
        rows = F.array(*[
            F.struct(F.lit(n).alias("setting"), F.lit(float(lo)).alias("low"), F.lit(float(hi)).alias("high"), F.lit(int(area)).alias("min_area"))
            for n, lo, hi, area in options
        ])
        choices = F.when(F.col("channel") == channel, rows).otherwise(choices)
    return px.select(*px.columns, F.inline(choices))


def sweep_segments(
    px: DataFrame, settings: Mapping[str, Sequence[Setting]], shape: tuple[int, int], split: bool = False,
    peak_window: int = 7, min_distance: float = 6, keys: Sequence[str] = ("image_id", "channel"),
) -> tuple[DataFrame, DataFrame]:
    """(label pixels, regions) keyed by image, channel and setting; whole components unless ``split``.

    Whole components of all settings come from one component tree; its pixels are labelled
    once, and the regions of each setting are rows of the tree.
    """
    if split:
        keys = [*keys, "setting"]
        swept = with_settings(px.withColumn("raw", F.col("value")), settings)
        limits = {c: F.col(c) for c in ("low", "high", "min_area")}
        return regions.segment(swept, [*keys, *limits], *limits.values(), shape, peak_window, min_distance, True)
    keys = list(keys)
    lows = {channel: sorted({float(low) for _, low, _, _ in options}) for channel, options in settings.items()}
    levels, rules = F.lit(None).cast("array<double>"), None
    for channel, options in settings.items():
        here = F.col("channel") == channel
        levels = F.when(here, F.array(*[F.lit(low) for low in lows[channel]])).otherwise(levels)
        rows = F.array(*[
            F.struct(F.lit(n).alias("setting"), F.lit(lows[channel].index(float(low)) + 1).alias("_level"), F.lit(float(high)).alias("high"), F.lit(int(area)).alias("min_area"))
            for n, low, high, area in options
        ])
        rules = F.when(here, rows) if rules is None else rules.when(here, rows)
    pixels, paths = component_tree(px.filter(F.col("channel").isin(*settings)), keys, levels)
    found = tree_regions(pixels, paths, keys).withColumn("_rule", F.explode(rules)).filter(F.col("_rule._level") == F.col("level"))
    edge = (F.col("y0") == 0) | (F.col("x0") == 0) | (F.col("y1") == shape[0] - 1) | (F.col("x1") == shape[1] - 1)
    good = found.filter((F.col("n") >= F.col("_rule.min_area")) & (F.col("top") >= F.col("_rule.high")) & ~edge)
    good = good.select(*keys, F.col("_rule.setting").alias("setting"), "level", "root", "y", "x", F.col("n").alias("area"), F.col("top").alias("peak_contrast"))
    props = cut(regions.dense_ids(good, [*keys, "setting"], ["root"]))
    named = paths.join(props.select(*keys, "setting", "level", "root", "id"), [*keys, "level", "root"]).select(*keys, "depth", "node", "setting", "id")
    return pixels.join(named, [*keys, "depth", "node"]).drop("depth", "node"), props.drop("level", "root")


def sweep_counts(
    px: DataFrame, fields: DataFrame, settings: Mapping[str, Sequence[Setting]], shape: tuple[int, int],
    max_distance: float, dilation: int, window: int, **segmenting,
) -> DataFrame:
    """Status counts per image and pair of settings; the counts need no object table.

    ``both`` is the size of the one-to-one matching; what is left over on either side is
    live-only and dead-only. Fields without detections keep their zero rows.
    """
    pixels, props = sweep_segments(px, settings, shape, **segmenting)
    sides = {"green_setting": F.col("setting"), "red_setting": F.col("setting")}
    pairs = admissible_pairs(
        pixels.withColumns(sides), props.withColumns(sides), max_distance, {"y": dilation, "x": dilation}, {"y": window, "x": window},
        green_keys=["green_setting"], red_keys=["red_setting"],
    )
    keys = ["image_id", "green_setting", "red_setting"]
    both = one_to_one(pairs, keys).groupBy(*keys).agg(F.count("*").alias("both"))
    sizes = props.groupBy("image_id", "channel", "setting").agg(F.count("*").alias("n"))
    def names(channel):
        return F.explode(F.array(*[F.lit(s[0]) for s in settings[channel]]))

    grid = fields.withColumn("green_setting", names("green")).withColumn("red_setting", names("red"))
    for channel in ("green", "red"):
        side = sizes.filter(F.col("channel") == channel).select("image_id", F.col("setting").alias(f"{channel}_setting"), F.col("n").alias(f"n_{channel}"))
        grid = grid.join(side, ["image_id", f"{channel}_setting"], "left")
    grid = grid.join(both, keys, "left").withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in ("n_green", "n_red", "both")})
    counted = grid.withColumns({
        "live_only": F.col("n_green") - F.col("both"), "dead_only": F.col("n_red") - F.col("both"), "double_positive": F.col("both"),
        "total": F.col("n_green") + F.col("n_red") - F.col("both"),
    })
    return counted.withColumn("viability_percent", percent(F.col("live_only"), F.col("total")))
