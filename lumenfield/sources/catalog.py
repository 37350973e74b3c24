"""Series metadata: support verdicts, depth calibration, plane selection, parameter rules."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: micrometres per length unit
MICROMETRES = {"m": 1e6, "mm": 1e3, "um": 1.0, "µm": 1.0, "μm": 1.0, "nm": 1e-3}


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that fires, NULL when none does."""
    return F.coalesce(*[F.when(broken, F.lit(name)) for name, broken in rules])


def all_reasons(rules: list[tuple[str, Column]]) -> Column:
    """Every rule that fires, as an array."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]))


def series_catalog(series: DataFrame) -> DataFrame:
    """Support verdict with the first failing reason; reads metadata columns only."""
    c = F.col
    rules = [
        ("lifetime_data", c("is_flim")),
        ("no_xy_plane", (c("size_x") < 1) | (c("size_y") < 1)),
        ("sample_composite", c("size_s") > 1),
        ("unusual_dimension", c("size_other") > 1),
        ("unstitched_tiles", c("n_tiles") > 1),
        ("pixel_type", ~c("dtype").isin("uint8", "uint16")),
        ("bit_packed", c("bit_packed")),
        ("channel_layout", c("n_channel_elements") != c("size_c")),
        ("channel_depth", ~c("bits").between(1, 16)),
        ("mixed_channel_types", (c("bits") <= 8) != (c("dtype") == "uint8")),
    ]
    return series.withColumn("reason", first_reason(rules)).select(
        "series_id", "name", "size_x", "size_y", "size_z", "size_c", "size_t", "dtype",
        F.when(c("bits").between(1, 16), F.expr("shiftleft(1, bits) - 1")).alias("detector_max"),
        c("reason").isNull().alias("supported"), "reason",
    )


def z_calibration(series: DataFrame) -> DataFrame:
    """Spacing and positions in micrometres; unknown unit or no extent gives NULL, never a guess."""
    units = F.create_map(*[F.lit(v) for pair in MICROMETRES.items() for v in pair])
    factor = F.try_element_at(units, F.col("unit"))
    origin, length, n = F.col("origin") * factor, F.col("length") * factor, F.col("size_z")
    steps = n - 1
    spacing = F.when(steps > 0, F.try_divide(F.abs(length), steps))
    known = factor.isNotNull() & ((n == 1) | (spacing > 0))
    positions = F.transform(
        F.sequence(F.lit(0).cast("bigint"), steps),
        lambda i: F.when(n == 1, origin).otherwise(origin + length * i / steps),
    )
    return series.select(
        "series_id", "size_z",
        F.when(known, spacing).alias("z_spacing_um"),
        F.when(known, positions).alias("z_positions_um"),
    )


def check_selection(requests: DataFrame, depth: int, n_channels: int, times: int) -> DataFrame:
    """Add the first broken selection rule as ``reason``.

    ``requests(image_id, green_channel, red_channel, z_start, z_stop, time_index)``; ranges are half open.
    """
    c = F.col
    rules = [
        ("missing_channel", c("green_channel").isNull() | c("red_channel").isNull()),
        ("channel_outside", ~c("green_channel").between(0, n_channels - 1) | ~c("red_channel").between(0, n_channels - 1)),
        ("same_channel", c("green_channel") == c("red_channel")),
        ("z_range", (c("z_start") < 0) | (c("z_start") >= c("z_stop")) | (c("z_stop") > depth)),
        ("time_outside", ~c("time_index").between(0, times - 1)),
    ]
    return requests.withColumn("reason", first_reason(rules))


def select_planes(voxels: DataFrame, requests: DataFrame) -> DataFrame:
    """Keep the requested planes and name their role; ``voxels`` needs ``channel_index`` and ``z``."""
    roles = requests.filter("reason is null").select(
        "image_id", "z_start", "z_stop",
        F.explode(F.map_from_arrays(F.array("green_channel", "red_channel"), F.array(F.lit("green"), F.lit("red")))).alias("channel_index", "role"),
    )
    kept = voxels.join(roles, ["image_id", "channel_index"])
    return kept.filter("z >= z_start and z < z_stop").drop("z_start", "z_stop", "channel_index")


def parameter_rules() -> list[tuple[str, Column]]:
    c = F.col
    return [
        ("thresholds", ~((c("low") > 0) & (c("low") <= c("high")) & (c("high") <= c("dtype_max")))),
        ("sigma", ~(c("sigma_px") > 0)),
        ("min_area", ~(c("min_area_px") >= 1)),
        ("background_sigma", ~(c("background_sigma_px") > 0)),
        ("peak_window", ~((c("peak_window_px") >= 3) & (c("peak_window_px") % 2 == 1))),
        ("peak_distance", ~(c("min_peak_distance_px") >= 1)),
        ("match_distance", ~(c("max_distance_px") > 0)),
        ("match_dilation", ~c("dilation_px").isin(0, 1)),
        ("match_window", c("overlap_window_radius_px") < c("max_distance_px") + c("dilation_px")),
        ("q_threshold", ~((c("q_threshold") > 0) & (c("q_threshold") < 1))),
        ("null_annulus", ~((c("null_inner_px") > 0) & (c("null_inner_px") < c("null_outer_px")))),
        ("null_locations", ~(c("min_null_locations") >= 1)),
        ("display_bounds", ~(c("display_high") > c("display_low"))),
        ("central_crop", ~((c("central_crop_fraction") > 0) & (c("central_crop_fraction") <= 1))),
        ("raw_mode_background", (c("mode") == "raw_intensity") & (c("background_sigma_um") != 0)),
    ]


def parameter_violations(parameters: DataFrame, key: str = "param_id") -> DataFrame:
    """(key, rule) for every broken rule of a parameter table."""
    return parameters.select(key, F.explode(all_reasons(parameter_rules())).alias("rule"))


def require_sound(parameters: DataFrame, key: str = "param_id") -> DataFrame:
    """Guard of a sweep: keep the parameter rows that break no rule."""
    return parameters.filter(F.size(all_reasons(parameter_rules())) == 0)


