"""Streaming plans; each one ends in a table that equals its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfield.operators import review
from lumenfield.plans.raster import PLANE
from lumenfield.plans.registry import query
from lumenfield.plans.review import BOUNDS_SQL, STATUS_SQL, SUMS_SQL
from lumenfield.session import work_path
from lumenfield.sources.recipes import duck, recipe, table
from lumenfield.streaming import jobs


def folders(spark, name):
    base = work_path(spark, name)
    return f"{base}/out", f"{base}/checkpoint"


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("stream_projection", duck("vox", body="select image_id, channel, y, x, max(value) as value from vox group by 1,2,3,4"))
def stream_projection(spark, sf):
    planes = work_path(spark, "planes")
    voxels = recipe(spark, sf, "vox")
    voxels.repartition("image_id", "z").write.parquet(planes)
    # three micro-batches
    files = len(spark.read.parquet(planes).inputFiles())
    stream = spark.readStream.schema(voxels.schema).option("maxFilesPerTrigger", max(1, -(-files // 3))).parquet(planes)
    return jobs.stream_projection(stream, PLANE, *folders(spark, "projection"))


@query("stream_new_fields", "select distinct sha256(concat_ws(':',cast(user_id as varchar),event_type)) as fingerprint, user_id, event_type from events")
def stream_new_fields(spark, sf):
    return jobs.stream_new_fields(event_stream(spark, sf), ["user_id", "event_type"], *folders(spark, "fields"))


@query("stream_reviews", duck("grp", body=f"""with
e as (select 'F'||cast(user_id%25 as varchar) as image_id, event_id%40 as object_id, event_id as revision, case event_type when 'click' then 'pairs' when 'error' then 'uncertain' when 'view' then 'unreviewed' else 'separate' end as decision from events),
l as (select image_id, object_id, arg_max(decision, revision) as decision from e group by 1,2),
gg as (select image_id, object_id%40 as object_id, cast(sum(n_green) as bigint) as n_green, cast(sum(n_red) as bigint) as n_red from grp group by 1,2),
g as (select *, {STATUS_SQL} as status from gg),
rv as (select g.*, coalesce(l.decision,'unreviewed') as decision, case l.decision when 'pairs' then 1 else 0 end as n_pairs, n_green>0 and n_red>0 as mixed from g left join l using (image_id, object_id)),
s as (select image_id, {SUMS_SQL} from rv group by 1) select *, {BOUNDS_SQL} from s"""))
def stream_reviews(spark, sf):
    """Latest decision per object from the feed, then bounds recomputed from the saved groups."""
    decision = (
        F.when(F.col("event_type") == "click", "pairs").when(F.col("event_type") == "error", "uncertain")
        .when(F.col("event_type") == "view", "unreviewed").otherwise("separate")
    )
    feed = event_stream(spark, sf).select(
        F.concat(F.lit("F"), (F.col("user_id") % 25).cast("string")).alias("image_id"), (F.col("event_id") % 40).alias("object_id"),
        F.col("event_id").alias("revision"), decision.alias("decision"), F.lit(1).cast("bigint").alias("n_pairs"),
    )
    last = jobs.stream_latest(feed, ["image_id", "object_id"], "revision", *folders(spark, "reviews"))
    groups = recipe(spark, sf, "grp").groupBy("image_id", (F.col("object_id") % 40).alias("object_id")).agg(
        F.sum("n_green").alias("n_green"), F.sum("n_red").alias("n_red")
    )
    status = review.group_status(F.col("n_green"), F.col("n_red"), F.col("object_id") % 3 != 0)
    return review.viability_bounds(groups.withColumn("status", status), last)
