"""Calibrated volumes: segmentation, region tables, cross-channel association groups."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfield.functions.scalars import join_ids, total
from lumenfield.operators import regions
from lumenfield.operators.components import connected_roots, label_components
from lumenfield.operators.matching import admissible_pairs
from lumenfield.operators.raster import distance_to_background
from lumenfield.session import cut

AXES = ["z", "y", "x"]
RED_NODES = 1 << 40


def deepest_first() -> Column:
    """Volume peak order: strongest first, ties in raster order."""
    return F.struct((-F.col("value")).alias("v"), *AXES)


def peak_radii(peak_window: int, spacing: Mapping[str, float]) -> dict[str, int]:
    """Planar half window in pixels; its depth follows the calibration and is at least one plane."""
    radius = peak_window // 2
    pitch = math.sqrt(spacing["y"] * spacing["x"])
    return {"z": max(1, math.floor(radius * pitch / spacing["z"])), "y": radius, "x": radius}


def region_props_3d(
    voxels: DataFrame, keys: Sequence[str], region: Sequence[str], spacing: Mapping[str, float], shape: Sequence[int], weighted: bool
) -> DataFrame:
    """Volume, centroid, peak, boundary contact and largest XY cross-section per region.

    Two aggregation levels: planes of a region first, then the region.
    """
    group = [*keys, *region]
    weight = F.col("value") if weighted else F.lit(1)
    planes = voxels.groupBy(*group, "z").agg(
        F.count("*").alias("n"), F.sum(weight).alias("w"), F.sum(weight * F.col("y")).alias("wy"), F.sum(weight * F.col("x")).alias("wx"),
        F.max("value").alias("top"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"),
    )
    at_edge = (
        (F.min("z") == 0) | (F.max("z") == shape[0] - 1) | (F.min("y0") == 0) | (F.max("y1") == shape[1] - 1)
        | (F.min("x0") == 0) | (F.max("x1") == shape[2] - 1)
    )
    return planes.groupBy(*group).agg(
        (F.sum(F.col("w") * F.col("z")) / F.sum("w")).alias("z"), (F.sum("wy") / F.sum("w")).alias("y"), (F.sum("wx") / F.sum("w")).alias("x"),
        F.sum("n").alias("voxels"), (F.sum("n") * F.lit(math.prod(spacing.values()))).alias("volume_um3"),
        F.max("top").alias("peak_intensity"), at_edge.alias("touches_boundary"), F.max("n").alias("max_xy_area_px"),
    )


def _finish(pieces: DataFrame, keys: list[str], props: DataFrame, keep: Column, exclude_border: bool) -> tuple[DataFrame, DataFrame]:
    props = props.filter(keep)
    if exclude_border:
        props = props.filter(~F.col("touches_boundary"))
    props = cut(regions.dense_ids(props, keys, ["root", "seed"]))
    labels = pieces.join(props.select(*keys, "root", "seed", "id"), [*keys, "root", "seed"])
    return labels.select(*keys, *AXES, "value", "id"), props.drop("root", "seed")


def segment_projection(
    contrast: DataFrame, keys: Sequence[str], low: Column, high: Column, min_area: int, spacing: Mapping[str, float],
    shape: Sequence[int], peak_window: int, min_distance_px: float, exclude_border: bool,
) -> tuple[DataFrame, DataFrame]:
    """Segment stacks of planar contrast with the ordinary planar controls, extended into depth."""
    keys = list(keys)
    pitch = math.sqrt(spacing["y"] * spacing["x"])
    labels = label_components(contrast.filter(F.col("value") >= low), keys, AXES, "full")
    planes = labels.groupBy(*keys, "root", "z").agg(F.count("*").alias("n"), F.max("value").alias("top"))
    whole = planes.groupBy(*keys, "root").agg(F.sum("n").alias("voxels"), F.max("top").alias("top"), F.max("n").alias("section"), F.first(high).alias("_high"))
    good = whole.filter((F.col("voxels") >= min_area) & (F.col("top") >= F.col("_high")) & (F.col("section") >= min_area))
    labels = cut(labels.join(good.select(*keys, "root"), [*keys, "root"], "left_semi"))
    maxima = regions.local_maxima(labels, contrast, keys, peak_radii(peak_window, spacing), high)
    peaks = regions.plateau_peaks(maxima, keys, spacing, "full")
    peaks = regions.with_fallback(labels, peaks, keys, AXES)
    kept = regions.thin_seeds(cut(peaks), keys, spacing, min_distance_px * pitch, deepest_first())
    seeds = cut(regions.number_seeds(kept, keys, deepest_first()))
    pieces = cut(regions.split_regions(labels, seeds, keys, AXES, "full", by_age=True))
    props = region_props_3d(pieces, keys, ["root", "seed"], spacing, shape, weighted=True)
    keep = (F.col("voxels") >= min_area) & (F.col("max_xy_area_px") >= min_area) & (F.col("peak_intensity") >= high)
    return _finish(pieces, keys, props, keep, exclude_border)


def segment_raw(
    intensity: DataFrame, keys: Sequence[str], low: Column, high: Column, min_volume_um3: float, spacing: Mapping[str, float],
    shape: Sequence[int], seed_distance_um: float, exclude_border: bool,
) -> tuple[DataFrame, DataFrame]:
    """Segment absolute intensities: face-connected components split by their distance to background."""
    keys = list(keys)
    min_voxels = max(1, math.ceil(min_volume_um3 / math.prod(spacing.values()) - 1e-10))
    labels = label_components(intensity.filter(F.col("value") >= low), keys, AXES, "faces")
    whole = labels.groupBy(*keys, "root").agg(F.count("*").alias("n"), F.max("value").alias("top"), F.first(high).alias("_high"))
    good = whole.filter((F.col("n") >= min_voxels) & (F.col("top") >= F.col("_high"))).select(*keys, "root")
    labels = cut(labels.join(good, [*keys, "root"], "left_semi"))
    depth = distance_to_background(labels, keys, spacing).withColumnRenamed("distance", "value")
    depth = cut(depth.select(*keys, "root", *AXES, "value"))
    deepest = regions.window_maximum(depth, depth, [*keys, "root"], dict.fromkeys(AXES, 1))
    maxima = deepest.filter("value >= _most").drop("_most")
    peaks = regions.plateau_peaks(maxima, keys, spacing, "faces")
    kept = regions.thin_seeds(cut(peaks), keys, spacing, seed_distance_um, deepest_first())
    seeds = cut(regions.number_seeds(kept, keys, deepest_first()))
    flooded = regions.split_regions(depth, seeds, keys, AXES, "faces", by_age=True).drop("value")
    pieces = cut(flooded.join(labels.select(*keys, *AXES, "value"), [*keys, *AXES]))
    props = region_props_3d(pieces, keys, ["root", "seed"], spacing, shape, weighted=False)
    keep = (F.col("voxels") >= min_voxels) & (F.col("peak_intensity") >= high)
    return _finish(pieces, keys, props, keep, exclude_border)


# ---------------------------------------------------------------- association


def _sides(labels: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    green = labels.filter("channel = 'green'").select(*keys, F.col("id").alias("green_id"), *AXES)
    red = labels.filter("channel = 'red'").select(*keys, F.col("id").alias("red_id"), *AXES)
    return green, red


def overlaps(labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shared voxels of every green/red pair."""
    green, red = _sides(labels, keys)
    return green.join(red, [*keys, *AXES]).groupBy(*keys, "green_id", "red_id").agg(F.count("*").alias("overlap"))


def surface_gap_pairs(labels: DataFrame, keys: Sequence[str], gap_um: float, spacing: Mapping[str, float]) -> DataFrame:
    """Pairs with voxel centres within ``gap_um`` (0: a shared voxel): smallest gap and shared voxels.

    Squared distances add up over axes, so green voxels spread along one axis at a time
    and keep the minimum per place; the last axis is looked up from the red voxels.
    """
    green, red = _sides(labels, keys)
    limit = (gap_um + 1e-10) ** 2

    def steps(axis: str, column: str) -> Column:
        reach = math.floor((gap_um + 1e-10) / spacing[axis])
        return F.explode(F.array(*[
            F.struct((F.col(axis) + k).alias(column), F.lit((k * spacing[axis]) ** 2).alias("far")) for k in range(-reach, reach + 1)
        ])).alias("_s")

    spread = green.withColumn("d2", F.lit(0.0))
    for axis in AXES[:-1]:
        others = [c for c in spread.columns if c not in (axis, "d2")]
        moved = spread.select(*others, "d2", steps(axis, axis)).select(*others, f"_s.{axis}", (F.col("d2") + F.col("_s.far")).alias("d2"))
        spread = moved.filter(F.col("d2") <= limit).groupBy(*keys, "green_id", *AXES).agg(F.min("d2").alias("d2"))
    wanted = red.select(*keys, "red_id", "z", "y", F.col("x").alias("_x"), steps("x", "x")).select(*keys, "red_id", "z", "y", "_x", "_s.x", "_s.far")
    near = spread.join(wanted, [*keys, *AXES]).withColumn("d2", F.col("d2") + F.col("far")).filter(F.col("d2") <= limit)
    closest = near.groupBy(*keys, "green_id", "red_id", "z", "y", "_x").agg(F.min("d2").alias("d2"))
    return closest.groupBy(*keys, "green_id", "red_id").agg(F.sqrt(F.min("d2")).alias("gap_um"), total(F.col("d2") == 0).alias("overlap"))


def shared_control_pairs(
    labels: DataFrame, props: DataFrame, keys: Sequence[str], max_distance_px: float, dilation_px: int, window_px: int, spacing: Mapping[str, float], depth: int
) -> DataFrame:
    """Planar matching controls in depth: window and dilation keep their pixel size in XY and follow the pitch in Z."""
    pitch = math.sqrt(spacing["y"] * spacing["x"])
    window = {"z": math.ceil(window_px * pitch / spacing["z"]), "y": window_px, "x": window_px}
    z_grow = min(math.floor(dilation_px * pitch / spacing["z"] + 1e-12), depth - 1)
    grow = {"z": z_grow if dilation_px else 0, "y": dilation_px, "x": dilation_px}
    pairs = admissible_pairs(labels, props, max_distance_px * pitch, grow, window, spacing, 1e-10, keys)
    common = overlaps(labels, keys)
    return pairs.join(common, [*keys, "green_id", "red_id"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))


def association_groups(props: DataFrame, pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, channel, id, object_id): connected groups of the bipartite graph, single nodes kept.

    Groups are numbered by their first member, green by id and then red by id.
    """
    keys = list(keys)
    edges = pairs.select(*keys, F.col("green_id").alias("a"), (F.col("red_id") + RED_NODES).alias("b"))
    roots = connected_roots(edges, keys)
    node = F.when(F.col("channel") == "green", F.col("id")).otherwise(F.col("id") + RED_NODES)
    members = props.select(*keys, "channel", "id", node.alias("node")).join(roots, [*keys, "node"], "left")
    members = members.withColumn("root", F.coalesce("root", "node"))
    numbers = regions.dense_ids(members.select(*keys, "root").distinct(), keys, ["root"], "object_id")
    return members.join(numbers, [*keys, "root"]).select(*keys, "channel", "id", "object_id")


def group_table(members: DataFrame, props: DataFrame, common: DataFrame, keys: Sequence[str], spacing: Mapping[str, float]) -> DataFrame:
    """Status, member ids, weighted centroid, union volume and count bounds of every group.

    The union volume subtracts every member intersection, also of pairs that failed admission.
    """
    keys = list(keys)
    full = members.join(props, [*keys, "channel", "id"])
    green, red = F.col("channel") == "green", F.col("channel") == "red"
    weight = F.col("voxels")
    rolled = full.groupBy(*keys, "object_id").agg(
        total(green).alias("n_green"), total(red).alias("n_red"),
        join_ids(F.collect_list(F.when(green, F.col("id")))).alias("green_ids"), join_ids(F.collect_list(F.when(red, F.col("id")))).alias("red_ids"),
        *[(F.sum(F.col(a) * weight) / F.sum(weight)).alias(a) for a in AXES],
        F.sum("voxels").alias("_voxels"), F.bool_or("touches_boundary").alias("touches_boundary"),
    )
    g = members.filter(green).select(*keys, F.col("id").alias("green_id"), "object_id")
    r = members.filter(red).select(*keys, F.col("id").alias("red_id"), "object_id")
    inside = common.join(g, [*keys, "green_id"]).join(r, [*keys, "red_id", "object_id"]).groupBy(*keys, "object_id").agg(F.sum("overlap").alias("_shared"))
    joined = rolled.join(inside, [*keys, "object_id"], "left").withColumn("_shared", F.coalesce("_shared", F.lit(0)))
    single = (F.col("n_green") == 1) & (F.col("n_red") == 1)
    status = (
        F.when(F.col("n_red") == 0, "green_only").when(F.col("n_green") == 0, "red_only")
        .when(single & (F.col("_shared") > 0), "dual_positive_candidate").otherwise("unresolved")
    )
    reason = (
        F.when(F.col("n_red") == 0, "no red object in reach").when(F.col("n_green") == 0, "no green object in reach")
        .when(single & (F.col("_shared") > 0), "one pair sharing voxels").when(single, "one pair without shared voxels")
        .otherwise("several members, no forced pairing")
    )
    return joined.withColumns({
        "status": status, "reason": reason,
        "volume_um3": (F.col("_voxels") - F.col("_shared")) * F.lit(math.prod(spacing.values())),
        **{f"{a}_um": F.col(a) * F.lit(float(spacing[a])) for a in AXES},
        "candidate_count_min": F.greatest("n_green", "n_red"), "candidate_count_max": F.col("n_green") + F.col("n_red"),
        "review_required": (F.col("n_green") > 0) & (F.col("n_red") > 0),
    }).drop("_voxels", "_shared")


STATUSES = ["green_only", "red_only", "dual_positive_candidate", "unresolved"]


def volume_counts(groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Group counts by status and count bounds per volume."""
    return groups.groupBy(*keys).agg(
        *[total(F.col("status") == s).alias(s) for s in STATUSES], F.count("*").alias("total_groups"),
        F.sum("n_green").alias("green_objects"), F.sum("n_red").alias("red_objects"),
        F.sum("candidate_count_min").alias("candidate_count_min"), F.sum("candidate_count_max").alias("candidate_count_max"),
        total(F.col("touches_boundary")).alias("boundary_groups"),
    )
