"""Signal enrichment plans on a sparse third channel."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfield.operators import background, enrichment, regions, rollups
from lumenfield.operators.components import label_components
from lumenfield.operators.raster import circular_shift
from lumenfield.plans.objects import SUMMARY
from lumenfield.plans.raster import FRAME
from lumenfield.plans.regions import cc_cte
from lumenfield.plans.registry import query
from lumenfield.session import cut
from lumenfield.sources.recipes import duck, recipe

IMAGE = ["image_id"]
SETTINGS = {"roi_dilation": 1, "occupied_dilation": 2, "inner": 6, "outer": 20}
MIN_LOCATIONS = 10

BRIGHT = f"""bright as (select image_id, y, x, max(value) as value from px where value>=110 group by 1,2,3),
{cc_cte("bright", "lab", keys="image_id")},
ids as (select image_id, root, row_number() over (partition by image_id order by root) as object_id, bool_or(value>=130) as strong, count(*) as n from lab group by 1,2),
lb as (select l.image_id, l.y, l.x, i.object_id from lab l join ids i using (image_id, root))"""

ROI = f"""{BRIGHT},
roi as (select distinct b.image_id, b.object_id, cast(b.y+dy as integer) as y, cast(b.x+dx as integer) as x from lb b, range(-1,2) u(dy), range(-1,2) v(dx)
 where abs(dy)+abs(dx)<=1 and b.y+dy between 0 and 63 and b.x+dx between 0 and 63
 and not exists (select 1 from lb o where o.image_id=b.image_id and o.y=b.y+dy and o.x=b.x+dx and o.object_id<>b.object_id))"""

NULLS = f"""{ROI},
rect as (select image_id, object_id, greatest(min(y)-1,0) y0, least(max(y)+1,63) y1, greatest(min(x)-1,0) x0, least(max(x)+1,63) x1 from lb group by 1,2),
occ as (select distinct b.image_id, b.y+dy as y, b.x+dx as x from lb b, range(-2,3) u(dy), range(-2,3) v(dx) where abs(dy)+abs(dx)<=2),
offs as (select cast(dy as integer) as dy, cast(dx as integer) as dx from range(-20,21) u(dy), range(-20,21) v(dx) where dy*dy+dx*dx between 36 and 400),
cand as (select r.image_id, r.object_id, dy, dx from rect r, offs where y0+dy>=0 and x0+dx>=0 and y1+dy<=63 and x1+dx<=63),
hit as (select distinct c.image_id, c.object_id, c.dy, c.dx from cand c join roi r using (image_id, object_id) join occ o on o.image_id=c.image_id and o.y=r.y+c.dy and o.x=r.x+c.dx),
place as (select * from cand anti join hit using (image_id, object_id, dy, dx)),
sums as (select p.image_id, p.object_id, p.dy, p.dx, cast(coalesce(sum(b.value),0) as double) as null_sum from place p join roi r using (image_id, object_id) left join blue b on b.image_id=p.image_id and b.y=r.y+p.dy and b.x=r.x+p.dx group by 1,2,3,4)"""

TESTED = f"""{NULLS},
obs as (select r.image_id, r.object_id, count(*) as roi_pixels, coalesce(sum(b.value),0)::double as ssum, count(*) filter (where b.value>0) as nz from roi r left join blue b using (image_id, y, x) group by 1,2),
nul as (select s.image_id, s.object_id, count(*) as n, count(*) filter (where s.null_sum>=o.ssum-1e-5::double) as ge, avg(null_sum) as m, stddev_samp(null_sum) as sd, quantile_cont(null_sum,0.99) as q99 from sums s join obs o using (image_id, object_id) group by 1,2),
tst as (select o.image_id, o.object_id, o.roi_pixels, o.ssum, o.nz, coalesce(n.n,0) as n, n.m, n.sd, n.q99, coalesce(n.n,0)>={MIN_LOCATIONS} as scorable,
 case when coalesce(n.n,0)>={MIN_LOCATIONS} then (1+n.ge)/(n.n+1)::double end as p from obs o left join nul n using (image_id, object_id))"""


def tested_cte(tag: str, dilation: int, signal: str) -> str:
    """The test of one ROI dilation and one signal table, with suffixed CTE names."""
    d = dilation
    return f"""
roi{tag} as (select distinct b.image_id, b.object_id, cast(b.y+dy as integer) as y, cast(b.x+dx as integer) as x from lb b, range(-{d},{d}+1) u(dy), range(-{d},{d}+1) v(dx)
 where abs(dy)+abs(dx)<={d} and b.y+dy between 0 and 63 and b.x+dx between 0 and 63
 and not exists (select 1 from lb o where o.image_id=b.image_id and o.y=b.y+dy and o.x=b.x+dx and o.object_id<>b.object_id)),
rect{tag} as (select image_id, object_id, greatest(min(y)-{d},0) y0, least(max(y)+{d},63) y1, greatest(min(x)-{d},0) x0, least(max(x)+{d},63) x1 from lb group by 1,2),
cand{tag} as (select r.image_id, r.object_id, dy, dx from rect{tag} r, offs where y0+dy>=0 and x0+dx>=0 and y1+dy<=63 and x1+dx<=63),
hit{tag} as (select distinct c.image_id, c.object_id, c.dy, c.dx from cand{tag} c join roi{tag} r using (image_id, object_id) join occ o on o.image_id=c.image_id and o.y=r.y+c.dy and o.x=r.x+c.dx),
place{tag} as (select * from cand{tag} anti join hit{tag} using (image_id, object_id, dy, dx)),
sums{tag} as (select p.image_id, p.object_id, p.dy, p.dx, cast(coalesce(sum(b.value),0) as double) as null_sum from place{tag} p join roi{tag} r using (image_id, object_id) left join {signal} b on b.image_id=p.image_id and b.y=r.y+p.dy and b.x=r.x+p.dx group by 1,2,3,4),
obs{tag} as (select r.image_id, r.object_id, coalesce(sum(b.value),0)::double as ssum from roi{tag} r left join {signal} b using (image_id, y, x) group by 1,2),
nul{tag} as (select s.image_id, s.object_id, count(*) as n, count(*) filter (where s.null_sum>=o.ssum-1e-5::double) as ge from sums{tag} s join obs{tag} o using (image_id, object_id) group by 1,2),
obj{tag} as (select o.image_id, o.object_id, coalesce(n.n,0)>={MIN_LOCATIONS} as scorable, true as provided, case when i.strong then 'live_only' else 'dead_only' end as status,
 case when coalesce(n.n,0)>={MIN_LOCATIONS} then (1+n.ge)/(n.n+1)::double end as p from obs{tag} o left join nul{tag} n using (image_id, object_id) join ids i using (image_id, object_id)),
rk{tag} as (select p, sum(count(*)) over (order by p) as rk, sum(count(*)) over () as n from obj{tag} where p is not null group by p),
q{tag} as (select p, least(1.0::double, min((p*n)/rk) over (order by p rows between current row and unbounded following)) as q from rk{tag}),
call{tag} as (select o.*, case when o.scorable then q.q<=0.05 end as detected from obj{tag} o left join q{tag} q on o.p=q.p)"""


AROUND = NULLS.split("cand as")[0].rstrip().rstrip(",").replace("rect as (", "rect_ as (").replace("roi as (", "roi_ as (")


def bright_objects(spark, sf):
    """(label pixels with object_id, objects): bright blobs of either channel."""
    bright = recipe(spark, sf, "px").filter("value >= 110").groupBy("image_id", "y", "x").agg(F.max("value").alias("value"))
    labels = label_components(bright, IMAGE)
    strong = F.when(F.bool_or(F.col("value") >= 130), "live_only").otherwise("dead_only")
    objects = labels.groupBy("image_id", "root").agg(strong.alias("status"))
    objects = cut(regions.dense_ids(objects, IMAGE, ["root"], "object_id"))
    return cut(labels.join(objects, ["image_id", "root"]).select("image_id", "object_id", "y", "x")), objects.drop("root")


@query("signal_roi", duck("px", body=f"with recursive {ROI} select * from roi"))
def signal_roi(spark, sf):
    labels, _ = bright_objects(spark, sf)
    return background.signal_roi(labels, IMAGE, 1, FRAME).select("image_id", "object_id", "y", "x")


@query("roi_signal", duck("px", "blue", body=f"""with recursive {ROI}
select r.image_id, r.object_id, count(*) as ebfp_roi_pixels, cast(coalesce(sum(b.value),0) as bigint) as ebfp_sum, count(*) filter (where b.value>0) as ebfp_nonzero_pixels,
coalesce(sum(b.value),0)/count(*)::double as ebfp_mean from roi r left join blue b using (image_id, y, x) group by 1,2"""))
def roi_signal(spark, sf):
    labels, _ = bright_objects(spark, sf)
    return background.roi_signal(background.signal_roi(labels, IMAGE, 1, FRAME), recipe(spark, sf, "blue"), IMAGE)


@query("null_placements", duck("px", body=f"with recursive {NULLS.split('sums as')[0].rstrip().rstrip(',')} select image_id, object_id, dy, dx from place"))
def null_placements(spark, sf):
    labels, _ = bright_objects(spark, sf)
    rows = background.placements(labels, recipe(spark, sf, "blue"), IMAGE, FRAME, rows=True, **SETTINGS)
    return rows.select("image_id", "object_id", "dy", "dx")


@query("null_sums", duck("px", "blue", body=f"with recursive {NULLS} select * from sums"))
def null_sums(spark, sf):
    labels, _ = bright_objects(spark, sf)
    rows = background.placements(labels, recipe(spark, sf, "blue"), IMAGE, FRAME, rows=True, **SETTINGS)
    return rows.select("image_id", "object_id", "dy", "dx", "null_sum")


@query("empirical_p", duck("px", "blue", body=f"""with recursive {TESTED}
select image_id, object_id, roi_pixels as ebfp_roi_pixels, ssum as ebfp_sum, round(ssum/roi_pixels,8) as ebfp_mean, nz as ebfp_nonzero_pixels,
round(m/roi_pixels,8) as ebfp_bg_mean, round(sd/roi_pixels,6) as ebfp_bg_sd, round(q99/roi_pixels,6) as ebfp_bg_q99, n as ebfp_shift_locations, round(p,10) as ebfp_p,
round(case when m>0 then (ssum/roi_pixels)/(m/roi_pixels) end,6) as ebfp_enrichment, scorable as ebfp_scorable, case when scorable then 'scorable' else 'insufficient_null_locations' end as ebfp_status from tst"""))
def empirical_p(spark, sf):
    labels, objects = bright_objects(spark, sf)
    measured = background.empirical_p(objects, labels, recipe(spark, sf, "blue"), IMAGE, FRAME, MIN_LOCATIONS, **SETTINGS)
    return measured.select(
        "image_id", "object_id", "ebfp_roi_pixels", "ebfp_sum", F.round("ebfp_mean", 8).alias("ebfp_mean"), "ebfp_nonzero_pixels",
        F.round("ebfp_bg_mean", 8).alias("ebfp_bg_mean"), F.round("ebfp_bg_sd", 6).alias("ebfp_bg_sd"), F.round("ebfp_bg_q99", 6).alias("ebfp_bg_q99"),
        "ebfp_shift_locations", F.round("p", 10).alias("ebfp_p"), F.round("ebfp_enrichment", 6).alias("ebfp_enrichment"),
        F.col("scorable").alias("ebfp_scorable"), "ebfp_status",
    )


def classified(spark, sf, labels, objects, signal, dilation=1):
    """Measure and call the objects with ``signal``; each dilation is its own family."""
    settings = {**SETTINGS, "roi_dilation": dilation}
    measured = background.empirical_p(objects, labels, signal, IMAGE, FRAME, MIN_LOCATIONS, **settings)
    return enrichment.classify(cut(measured.select("image_id", "object_id", "status", "p", "scorable")), sample=None).withColumn("provided", F.lit(True))


@query("dilation_sweep", duck("px", "blue", body=f"""with recursive {AROUND.rstrip().rstrip(",")}, {tested_cte("0", 0, "blue")}, {tested_cte("1", 1, "blue")}, {tested_cte("2", 2, "blue")},
alld as (select 0 as dilation, * from call0 union all select 1, * from call1 union all select 2, * from call2)
select dilation, image_id, {SUMMARY} from alld group by 1,2"""))
def dilation_sweep(spark, sf):
    """Detection summary per field for ROI dilations of 0, 1 and 2 pixels, each re-adjusted."""
    labels, objects = bright_objects(spark, sf)
    swept = None
    for dilation in (0, 1, 2):
        calls = classified(spark, sf, labels, objects, recipe(spark, sf, "blue"), dilation).withColumn("dilation", F.lit(dilation))
        swept = calls if swept is None else swept.unionByName(calls)
    return rollups.count_summary(swept, ["dilation", "image_id"])


@query("spatial_shift_null", duck("px", "blue", body=f"""with recursive shifted as (select image_id, cast((y+35)%64 as integer) as y, cast((x+35)%64 as integer) as x, value from blue),
{AROUND.rstrip().rstrip(",")}, {tested_cte("1", 1, "blue")}, {tested_cte("2", 1, "shifted")}, cut as (select max(p) as fixed_p_cutoff from call1 where detected),
redone as (select c.* exclude (detected), cut.fixed_p_cutoff, case when scorable then coalesce(p<=fixed_p_cutoff,false) end as detected from call2 c, cut)
select image_id, fixed_p_cutoff, {SUMMARY} from redone group by 1,2"""))
def spatial_shift_null(spark, sf):
    """Calls of the circularly shifted channel at the unshifted run's p cutoff."""
    labels, objects = bright_objects(spark, sf)
    blue = recipe(spark, sf, "blue")
    cutoff = classified(spark, sf, labels, objects, blue).filter("detected").select(F.max("p")).scalar()
    shifted = classified(spark, sf, labels, objects, circular_shift(blue, 35, 35, FRAME)).withColumn("fixed_p_cutoff", cutoff)
    fixed = shifted.withColumn("detected", F.when(F.col("scorable"), F.coalesce(F.col("p") <= F.col("fixed_p_cutoff"), F.lit(False))))
    return rollups.count_summary(fixed, ["image_id", "fixed_p_cutoff"])


@query("signal_summary", duck("px", "blue", body=f"""with recursive {TESTED},
obj as (select t.image_id, t.object_id, t.p, t.scorable, true as provided, case when i.strong then 'live_only' else 'dead_only' end as status from tst t join ids i using (image_id, object_id)),
d as (select p, count(*) as c from obj where p is not null group by p), r as (select p, sum(c) over (order by p) as rk, sum(c) over () as n from d),
qv as (select p, least(1.0::double, min((p*n)/rk) over (order by p rows between current row and unbounded following)) as q from r),
called as (select o.*, case when o.scorable then qv.q<=0.05 end as detected from obj o left join qv on o.p=qv.p)
select image_id, {SUMMARY} from called group by image_id"""))
def signal_summary(spark, sf):
    """From rasters to calls: objects, placements, empirical p, run-wide adjustment, field summary."""
    labels, objects = bright_objects(spark, sf)
    return rollups.count_summary(classified(spark, sf, labels, objects, recipe(spark, sf, "blue")), IMAGE)
