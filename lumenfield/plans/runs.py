"""Whole-run plans: smoothing, segmentation, splitting, matching, enrichment and summaries together."""

from __future__ import annotations

from lumenfield.config import configuration
from lumenfield.experiment import analyze, save_run, verify_run
from lumenfield.plans.matching import raster_fields
from lumenfield.plans.registry import query
from lumenfield.session import work_path
from lumenfield.sources.recipes import recipe

# the default controls scaled to the 64-pixel frames of the raster recipe
SMALL = configuration(
    input={"shape": (64, 64), "pixel_size_um": (1.0, 1.0)},
    segmentation={"green": {"high": 14.0, "low": 9.0, "min_area_px": 4}, "red": {"high": 14.0, "low": 9.0, "min_area_px": 4}, "peak_window_px": 5, "min_peak_distance_px": 3.0},
    ebfp={"null_inner_px": 6, "null_outer_px": 20, "min_null_locations": 5, "occupied_dilation_px": 0},
)


def run(spark, sf):
    return analyze(recipe(spark, sf, "px"), raster_fields(spark, sf), SMALL, recipe(spark, sf, "blue"))


@query("run_field_summary")
def run_field_summary(spark, sf):
    """The complete planar run over all fields, rolled up per field."""
    return run(spark, sf)["field_summary"]


@query("run_verified")
def run_verified(spark, sf):
    """Save a complete run and verify the digests of its files."""
    folder = work_path(spark, "run")
    save_run(spark, run(spark, sf), folder)
    return verify_run(spark, folder).groupBy("status").count().withColumnRenamed("count", "files")
