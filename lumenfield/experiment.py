"""A whole planar run as one chain of DataFrame steps, and its stored form.

``analyze`` takes every field of an experiment at once: rasters in, tables out. All
fields share each Spark stage; only the run-wide false-discovery step brings the
objects of different fields together.
"""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfield.operators import background, enrichment, matching, raster, regions, rollups
from lumenfield.session import cut
from lumenfield.sources import audits

IMAGE, PLANE = ["image_id"], ["image_id", "channel"]


def working_contrast(px: DataFrame, config: Mapping) -> DataFrame:
    """Dense (image_id, channel, y, x, value = contrast, raw)."""
    rules = config["segmentation"]
    sigma = {c: rules[c]["sigma_px"] for c in ("green", "red")}
    dense = raster.contrast(px, sigma, rules["background_sigma_px"], config["input"]["shape"])
    raw = px.select(*PLANE, "y", "x", F.col("value").cast("double").alias("raw"))
    joined = dense.join(raw, [*PLANE, "y", "x"], "left")
    return joined.select(*PLANE, "y", "x", F.col("contrast").alias("value"), F.coalesce("raw", F.lit(0.0)).alias("raw"))


def per_channel(config: Mapping, name: str):
    rules = config["segmentation"]
    return F.when(F.col("channel") == "green", F.lit(rules["green"][name])).otherwise(F.lit(rules["red"][name]))


def segment_fields(px: DataFrame, config: Mapping) -> tuple[DataFrame, DataFrame]:
    """(label pixels, channel detections) of all fields."""
    rules = config["segmentation"]
    field = cut(working_contrast(px, config))
    return regions.segment(
        field, PLANE, per_channel(config, "low"), per_channel(config, "high"), per_channel(config, "min_area_px"),
        config["input"]["shape"], rules["peak_window_px"], rules["min_peak_distance_px"], rules["exclude_border"],
    )


def match_fields(pixels: DataFrame, detections: DataFrame, config: Mapping) -> tuple[DataFrame, DataFrame]:
    """(objects with mask audit, overlay labels) of all fields."""
    rules = config["matching"]
    d, w = rules["dilation_px"], rules["overlap_window_radius_px"]
    pairs = matching.admissible_pairs(pixels, detections, rules["max_distance_px"], {"y": d, "x": d}, {"y": w, "x": w})
    objects = cut(matching.match_objects(detections, matching.one_to_one(pairs, IMAGE), IMAGE))
    masks = cut(matching.object_pixels(pixels, objects, IMAGE))
    overlay = cut(matching.mask_overlay(masks, IMAGE))
    return matching.overlay_audit(objects, masks, overlay, IMAGE), overlay


def measure_fields(objects: DataFrame, overlay: DataFrame, signal: DataFrame, fields: DataFrame, config: Mapping) -> DataFrame:
    """Enrichment of every object; fields without the channel keep their objects unmeasured."""
    rules = config["ebfp"]
    given = fields.filter("ebfp_provided").select("image_id")
    measured = background.empirical_p(
        objects.join(given, "image_id", "left_semi").select(*IMAGE, "object_id"), overlay.join(given, "image_id", "left_semi"), signal, IMAGE,
        config["input"]["shape"], rules["min_null_locations"], roi_dilation=rules["roi_dilation_px"],
        occupied_dilation=rules["occupied_dilation_px"], inner=rules["null_inner_px"], outer=rules["null_outer_px"], tolerance=rules["comparison_tolerance"],
    )
    joined = objects.join(measured.withColumnRenamed("ebfp_status", "_status"), [*IMAGE, "object_id"], "left")
    joined = joined.join(fields.select("image_id", F.col("ebfp_provided").alias("provided")), "image_id")
    return joined.withColumns({
        "scorable": F.coalesce("scorable", F.lit(False)), "ebfp_status": F.coalesce("_status", F.lit("channel_not_provided")),
    }).drop("_status")


def analyze(px: DataFrame, fields: DataFrame, config: Mapping, signal: DataFrame | None = None) -> dict[str, DataFrame]:
    """Run all fields: detections, objects, labels, field and replicate summaries, statistics, warnings.

    ``px(image_id, channel, y, x, value)`` holds the non-zero pixels of both channels,
    ``fields(image_id, replicate_id, h, w, dy, dx, ebfp_provided)`` one row per field and
    ``signal(image_id, y, x, value)`` the optional third channel.
    """
    pixels, detections = segment_fields(px, config)
    objects, overlay = match_fields(pixels, detections, config)
    if signal is None:
        fields = fields.withColumn("ebfp_provided", F.lit(False))
        signal = px.select("image_id", "y", "x", "value").filter(F.lit(False))
    measured = cut(measure_fields(objects, overlay, signal, fields, config))
    called = cut(enrichment.classify(measured, config["ebfp"]["q_threshold"]).join(fields.select("image_id", "replicate_id"), "image_id"))
    summary = rollups.replicate_summary(fields, called)
    return {
        "detections": detections, "objects": called, "labels": overlay, "field_summary": rollups.field_summary(fields, called),
        "replicate_summary": summary, "replicate_stats": rollups.replicate_stats(summary), "warnings": rollups.run_warnings(fields, called),
    }


def save_run(spark: SparkSession, tables: Mapping[str, DataFrame], folder: str) -> DataFrame:
    """Write every table once and record the digest of each written file."""
    for name, df in tables.items():
        audits.write_table(df, os.path.join(folder, "tables", name))
    digests = run_digests(spark, folder)
    audits.write_table(digests, os.path.join(folder, "digests"))
    return audits.read_table(spark, os.path.join(folder, "digests"), "parquet", digests.schema)


def run_digests(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(os.path.join(folder, "tables"))
    return files.select(F.regexp_extract("path", "/tables/(.*)$", 1).alias("path"), F.sha2("content", 256).alias("sha"), F.col("length").alias("bytes"))


def verify_run(spark: SparkSession, folder: str) -> DataFrame:
    """(path, status) of every recorded or present file: ok, changed, missing or unexpected."""
    now = run_digests(spark, folder)
    recorded = audits.read_table(spark, os.path.join(folder, "digests"), "parquet", now.schema)
    return audits.verify_digests(recorded, now, "path")
