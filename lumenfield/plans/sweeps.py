"""Threshold sensitivity plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfield.operators import rollups, sweeps
from lumenfield.plans.matching import DILATION, DISTANCE, RADIUS, assignment_cte, overlap_cte
from lumenfield.plans.raster import FRAME
from lumenfield.plans.regions import cc_cte, split_cte
from lumenfield.plans.registry import query
from lumenfield.sources.recipes import duck, recipe

FACTORS = [0.75, 1.0, 1.25]
GRID = {c: [(str(f), 60 * f, 90 * f, 2) for f in FACTORS] for c in ("green", "red")}
CUTOFFS = {"green": [("60-90-2", 60, 90, 2), ("60-100-3", 60, 100, 3)], "red": [("50-80-2", 50, 80, 2), ("60-90-2", 60, 90, 2)]}


def sweep_sql(settings, split: bool = False) -> str:
    rows = ", ".join(f"('{c}','{n}',{lo}::double,{hi}::double,{a})" for c, options in settings.items() for n, lo, hi, a in options)
    regions = """sp as (select image_id, channel, setting, row_number() over (partition by image_id, channel, setting order by root) as id, root, y, x from (
 select image_id, channel, setting, root, sum(value*y)/sum(value)::double as y, sum(value*x)/sum(value)::double as x, count(*) as n, max(value) as top, any_value(high) as high, any_value(min_area) as min_area,
 min(y) y0, min(x) x0, max(y) y1, max(x) x1 from sl group by 1,2,3,4) where n>=min_area and top>=high and y0>0 and x0>0 and y1<63 and x1<63),
reg as (select image_id, channel, setting as gs, setting as rs, id, y, x from sp),
pix as (select l.image_id, l.channel, l.setting as gs, l.setting as rs, l.y, l.x, p.id from sl l join sp p using (image_id, channel, setting, root)),
"""
    if split:
        regions = f"""{split_cte("sl", "spl", "image_id, channel, setting", 5, 3)},
sp as (select g.image_id, g.channel, g.setting, g.id, sum(px.value*g.y)/sum(px.value)::double as y, sum(px.value*g.x)/sum(px.value)::double as x from spl g join px on px.image_id=g.image_id and px.channel=g.channel and px.y=g.y and px.x=g.x group by 1,2,3,4),
reg as (select image_id, channel, setting as gs, setting as rs, id, y, x from sp),
pix as (select image_id, channel, setting as gs, setting as rs, y, x, id from spl),
"""
    return f"""st(channel, setting, low, high, min_area) as (values {rows}),
sm as (select p.image_id, p.channel, p.y, p.x, p.value, s.setting, s.high, s.min_area from px p join st s using (channel) where p.value>=s.low),
{cc_cte("sm", "sl", keys="image_id, channel, setting")},
{regions}{overlap_cte("edges", DISTANCE, DILATION, RADIUS, "gs", "rs")}, {assignment_cte("edges", "best", "image_id, gs, rs")},
nb as (select image_id, gs, rs, count(*) as n_both from best group by 1,2,3),
ng as (select image_id, setting, count(*) as n from sp where channel='green' group by 1,2), nr as (select image_id, setting, count(*) as n from sp where channel='red' group by 1,2),
fl as (select distinct image_id from px),
grid as (select f.image_id, g.setting as green_setting, r.setting as red_setting, coalesce(ng.n,0) as n_green, coalesce(nr.n,0) as n_red, coalesce(nb.n_both,0) as n_both from fl f cross join (select setting from st where channel='green') g cross join (select setting from st where channel='red') r
 left join ng on ng.image_id=f.image_id and ng.setting=g.setting left join nr on nr.image_id=f.image_id and nr.setting=r.setting left join nb on nb.image_id=f.image_id and nb.gs=g.setting and nb.rs=r.setting)"""


GRID_SQL = f"""{sweep_sql(GRID)},
tg as (select image_id, image_id%4 as replicate_id, cast(green_setting as double) as green_threshold_factor, cast(red_setting as double) as red_threshold_factor, n_green-n_both as live_only, n_red-n_both as dead_only, n_both as double_positive, n_green+n_red-n_both as total,
 100::double*(n_green-n_both)/nullif(n_green+n_red-n_both,0) as viability_percent from grid),
tr as (select green_threshold_factor, red_threshold_factor, replicate_id, cast(sum(live_only) as bigint) as live_only, cast(sum(dead_only) as bigint) as dead_only, cast(sum(double_positive) as bigint) as double_positive, cast(sum(total) as bigint) as total,
 100::double*sum(live_only)/nullif(sum(total),0) as viability_percent from tg group by 1,2,3)"""


def grid(spark, sf, **segmenting):
    px = recipe(spark, sf, "px")
    counts = sweeps.sweep_counts(px, px.select("image_id").distinct(), GRID, FRAME, DISTANCE, DILATION, RADIUS, **segmenting)
    return counts.select(
        "image_id", (F.col("image_id") % 4).alias("replicate_id"), F.col("green_setting").cast("double").alias("green_threshold_factor"),
        F.col("red_setting").cast("double").alias("red_threshold_factor"), "live_only", "dead_only", "double_positive", "total", "viability_percent",
    )


def by_replicate(spark, sf):
    return rollups.pooled_grid(grid(spark, sf), ["green_threshold_factor", "red_threshold_factor", "replicate_id"])


@query("threshold_grid", duck("px", body=f"with recursive {GRID_SQL} select * from tg"))
def threshold_grid(spark, sf):
    return grid(spark, sf)


@query("threshold_grid_split", duck("px", body=f"""with recursive {sweep_sql(GRID, split=True)}
select image_id, image_id%4 as replicate_id, cast(green_setting as double) as green_threshold_factor, cast(red_setting as double) as red_threshold_factor, n_green-n_both as live_only, n_red-n_both as dead_only, n_both as double_positive, n_green+n_red-n_both as total,
 100::double*(n_green-n_both)/nullif(n_green+n_red-n_both,0) as viability_percent from grid"""))
def threshold_grid_split(spark, sf):
    """The grid over fully split regions (peaks, thinning and flooding per setting)."""
    return grid(spark, sf, split=True, peak_window=5, min_distance=3)


@query("grid_by_replicate", duck("px", body=f"with recursive {GRID_SQL} select * from tr"))
def grid_by_replicate(spark, sf):
    return by_replicate(spark, sf)


@query("grid_aggregate", duck("px", body=f"""with recursive {GRID_SQL} select green_threshold_factor, red_threshold_factor, round(avg(viability_percent),8) as mean, round(stddev_samp(viability_percent),8) as std, count(viability_percent) as count from tr group by 1,2"""))
def grid_aggregate(spark, sf):
    return by_replicate(spark, sf).groupBy("green_threshold_factor", "red_threshold_factor").agg(
        F.round(F.avg("viability_percent"), 8).alias("mean"), F.round(F.stddev_samp("viability_percent"), 8).alias("std"), F.count("viability_percent").alias("count")
    )


@query("grid_pivot", duck("px", body=f"""with recursive {GRID_SQL} select red_threshold_factor, {", ".join(f"round(avg(viability_percent) filter (where green_threshold_factor={f}),8) as green_{str(f).replace('.', '_')}" for f in FACTORS)} from tg group by 1"""))
def grid_pivot(spark, sf):
    """Mean viability as a matrix: red factors down, green factors across."""
    wide = grid(spark, sf).groupBy("red_threshold_factor").pivot("green_threshold_factor", FACTORS).agg(F.avg("viability_percent"))
    return wide.select("red_threshold_factor", *[F.round(F.col(f"`{f}`"), 8).alias("green_" + str(f).replace(".", "_")) for f in FACTORS])


@query("component_grid", duck("px", body=f"""with recursive {sweep_sql(CUTOFFS)} select image_id, green_setting, red_setting, n_green, n_red, n_both as "both", n_green+n_red-n_both as "union", 100::double*(n_green-n_both)/nullif(n_green+n_red-n_both,0) as livepercent from grid"""))
def component_grid(spark, sf):
    """Absolute cutoffs on unsplit components."""
    px = recipe(spark, sf, "px")
    counts = sweeps.sweep_counts(px, px.select("image_id").distinct(), CUTOFFS, FRAME, DISTANCE, DILATION, RADIUS)
    return counts.select(
        "image_id", "green_setting", "red_setting", "n_green", "n_red", "both", F.col("total").alias("union"), F.col("viability_percent").alias("livepercent")
    )
