"""Planar matching plans and the flagship roll-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfield.operators import matching, rollups
from lumenfield.plans.raster import FRAME
from lumenfield.plans.regions import PROPS, unsplit_regions
from lumenfield.plans.registry import query
from lumenfield.session import cut
from lumenfield.sources.recipes import duck, recipe

DISTANCE, DILATION, RADIUS = 6, 1, 24

CENT_PAIRS = """edges as (select g.image_id, g.id as green_id, r.id as red_id, sqrt((g.y-r.y)*(g.y-r.y)+(g.x-r.x)*(g.x-r.x)) as distance
from cent g join cent r on g.image_id=r.image_id and g.channel='green' and r.channel='red' and abs(g.y-r.y)<=6 and abs(g.x-r.x)<=6 where (g.y-r.y)*(g.y-r.y)+(g.x-r.x)*(g.x-r.x)<=36)"""


def assignment_cte(edges: str, out: str, keys: str = "image_id") -> str:
    """Every matching of every component, the best one kept (components are small)."""
    ks = [k.strip() for k in keys.split(",")]
    on = lambda a, b: " and ".join(f"{a}.{k}={b}.{k}" for k in ks)
    cols = lambda a: ", ".join(f"{a}.{k}" for k in ks)
    return f"""
{out}_n as (select {keys}, 2*green_id as a, 2*red_id+1 as b from {edges} union all select {keys}, 2*red_id+1, 2*green_id from {edges}),
{out}_r({keys}, node, reach) as (select {keys}, a, a from {out}_n union select {cols("r")}, r.node, n.b from {out}_r r join {out}_n n on {on("r", "n")} and n.a=r.reach),
{out}_c as (select {keys}, node, min(reach) as comp from {out}_r group by all),
{out}_i as (select {cols("e")}, c.comp, e.green_id, e.red_id, e.distance, row_number() over (partition by {cols("e")}, c.comp order by e.green_id, e.red_id) as i,
 count(*) over (partition by {cols("e")}, c.comp) as n from {edges} e join {out}_c c on {on("e", "c")} and c.node=2*e.green_id),
{out}_w({keys}, comp, i, used, picks, cost) as (select distinct {keys}, comp, 0::bigint, []::bigint[], []::bigint[], 0::double from {out}_i
 union all select {cols("w")}, w.comp, w.i+1, case when take=1 then list_concat(w.used,[2*e.green_id,2*e.red_id+1]) else w.used end,
 case when take=1 then list_append(w.picks, e.i) else w.picks end, case when take=1 then w.cost+e.distance else w.cost end
 from {out}_w w join {out}_i e on {on("w", "e")} and e.comp=w.comp and e.i=w.i+1, (values (0),(1)) t(take)
 where take=0 or not (list_contains(w.used,2*e.green_id) or list_contains(w.used,2*e.red_id+1))),
{out}_b as (select {cols("w")}, w.comp, arg_min(w.picks, w.cost - 1e6::double*len(w.picks)) as picks from {out}_w w join (select distinct {keys}, comp, n from {out}_i) z on {on("w", "z")} and w.comp=z.comp and w.i=z.n group by all),
{out} as (select {cols("e")}, e.green_id, e.red_id, e.distance from {out}_i e join {out}_b b on {on("e", "b")} and e.comp=b.comp and list_contains(b.picks, e.i))"""


LABELLED = f"""{PROPS}, pix as (select l.image_id, l.channel, l.y, l.x, p.id from lab l join props p using (image_id, channel, root)),
reg as (select image_id, channel, id, y, x, peak_contrast from props)"""


def overlap_cte(out: str, distance: int, dilation: int, radius: int, gk: str = "", rk: str = "", pix: str = "pix", reg: str = "reg") -> str:
    gks, rks = [k for k in [gk] if k], [k for k in [rk] if k]
    g = "".join(f", g.{k}" for k in gks)
    r = "".join(f", r.{k}" for k in rks)
    return f"""
{out}_g as (select p.image_id{"".join(", p." + k for k in gks)}, p.id, p.y, p.x, c.y as cy, c.x as cx from {pix} p join {reg} c on p.image_id=c.image_id and p.channel=c.channel and p.id=c.id {"".join(f" and p.{k}=c.{k}" for k in gks)}
 where p.channel='green' and abs(p.y-round_even(c.y,0))<={radius} and abs(p.x-round_even(c.x,0))<={radius}),
{out} as (select distinct g.image_id{g}{r}, g.id as green_id, r.id as red_id, sqrt((g.cy-c.y)*(g.cy-c.y)+(g.cx-c.x)*(g.cx-c.x)) as distance
 from {out}_g g join {pix} r on r.image_id=g.image_id and r.channel='red' and abs(r.y-g.y)<={dilation} and abs(r.x-g.x)<={dilation}
 join {reg} c on c.image_id=r.image_id and c.channel='red' and c.id=r.id {"".join(f" and c.{k}=r.{k}" for k in rks)}
 where abs(r.y-round_even(g.cy,0))<={radius} and abs(r.x-round_even(g.cx,0))<={radius} and sqrt((g.cy-c.y)*(g.cy-c.y)+(g.cx-c.x)*(g.cx-c.x))<={distance})"""


OBJECTS = f"""{LABELLED}, {overlap_cte("edges", DISTANCE, DILATION, RADIUS)}, {assignment_cte("edges", "best")},
gobj as (select g.image_id, g.id as green_id, coalesce(b.red_id,0) as red_id, g.y, g.x, case when b.red_id is null then 'live_only' else 'double_positive' end as status,
 g.peak_contrast as green_peak, coalesce(r.peak_contrast,0) as red_peak from reg g left join best b on b.image_id=g.image_id and b.green_id=g.id left join reg r on r.image_id=g.image_id and r.channel='red' and r.id=b.red_id where g.channel='green'),
robj as (select r.image_id, 0::bigint as green_id, r.id as red_id, r.y, r.x, 'dead_only' as status, 0 as green_peak, r.peak_contrast as red_peak from reg r
 where r.channel='red' and (r.image_id, r.id) not in (select image_id, red_id from best)),
objs as (select *, row_number() over (partition by image_id order by green_id=0, greatest(green_id*(green_id>0)::bigint, red_id*(green_id=0)::bigint)) as object_id from (select * from gobj union all select * from robj))"""


def channel_sides(spark, sf):
    cent = recipe(spark, sf, "cent")
    return cent.filter("channel = 'green'"), cent.filter("channel = 'red'")


@query("centroid_range_join", duck("cent", body=f"with {CENT_PAIRS} select image_id, green_id, red_id, round(distance,8) as distance from edges"))
def centroid_range_join(spark, sf):
    pairs = matching.centroid_pairs(*channel_sides(spark, sf), ["image_id"], 6.0)
    return pairs.withColumn("distance", F.round("distance", 8))


@query("one_to_one_match", duck("cent", body=f"with recursive {CENT_PAIRS}, {assignment_cte('edges', 'best')} select image_id, green_id, red_id, round(distance,8) as distance from best"))
def one_to_one_match(spark, sf):
    pairs = matching.centroid_pairs(*channel_sides(spark, sf), ["image_id"], 6.0)
    return matching.one_to_one(pairs, ["image_id"]).withColumn("distance", F.round("distance", 8))


def planar_pairs(spark, sf):
    pixels, props = unsplit_regions(spark, sf)
    pixels, props = cut(pixels), cut(props)
    return pixels, props, matching.admissible_pairs(pixels, props, DISTANCE, {"y": DILATION, "x": DILATION}, {"y": RADIUS, "x": RADIUS})


@query("overlap_semi_join", duck("px", body=f"with recursive {LABELLED}, {overlap_cte('edges', DISTANCE, DILATION, RADIUS)} select image_id, green_id, red_id, round(distance,8) as distance from edges"))
def overlap_semi_join(spark, sf):
    return planar_pairs(spark, sf)[2].withColumn("distance", F.round("distance", 8))


def planar_objects(spark, sf):
    """(label pixels, matched objects) of unsplit regions."""
    pixels, props, pairs = planar_pairs(spark, sf)
    objects = matching.match_objects(props, matching.one_to_one(pairs, ["image_id"]), ["image_id"])
    return pixels, cut(objects)


@query("match_status", duck("px", body=f"with recursive {OBJECTS} select image_id, object_id, green_id, red_id, status, round(y,8) as y, round(x,8) as x, green_peak, red_peak from objs"))
def match_status(spark, sf):
    _, objects = planar_objects(spark, sf)
    return objects.select(
        "image_id", "object_id", "green_id", "red_id", "status", F.round("y", 8).alias("y"), F.round("x", 8).alias("x"), "green_peak", "red_peak"
    )


OVERLAY = f"""{OBJECTS},
opix as (select distinct p.image_id, o.object_id, p.y, p.x from pix p join objs o on o.image_id=p.image_id and ((p.channel='green' and p.id=o.green_id) or (p.channel='red' and p.id=o.red_id))),
over_ as (select image_id, y, x, max(object_id) as object_id from opix group by 1,2,3),
audit as (select o.image_id, o.object_id, o.status, coalesce(a.n,0) as area, coalesce(f.n,0) as mask_pixels_final, coalesce(a.n,0)-coalesce(f.n,0) as mask_pixels_overwritten, coalesce(f.n,0)=0 as mask_lost
 from objs o left join (select image_id, object_id, count(*) n from opix group by 1,2) a using (image_id, object_id) left join (select image_id, object_id, count(*) n from over_ group by 1,2) f using (image_id, object_id))"""


def audited_objects(spark, sf):
    pixels, objects = planar_objects(spark, sf)
    masks = cut(matching.object_pixels(pixels, objects, ["image_id"]))
    overlay = matching.mask_overlay(masks, ["image_id"])
    return matching.overlay_audit(objects, masks, overlay, ["image_id"]), overlay


@query("mask_overlay", duck("px", body=f"with recursive {OVERLAY} select * from audit"))
def mask_overlay(spark, sf):
    audited, _ = audited_objects(spark, sf)
    return audited.select("image_id", "object_id", "status", "area", "mask_pixels_final", "mask_pixels_overwritten", "mask_lost")


@query("overlay_pixels", duck("px", body=f"with recursive {OVERLAY} select * from over_"))
def overlay_pixels(spark, sf):
    return audited_objects(spark, sf)[1].select("image_id", "y", "x", "object_id")


@query("run_warnings", duck("px", body=f"""with recursive {OVERLAY},
f as (select distinct l_suppkey//10 as image_id from lineitem), o as (select a.*, (a.image_id%3<>0 and a.object_id%11<>0) as scorable from audit a),
w as (select 'masks_overlap' as rule, count(*) filter (where mask_pixels_overwritten>0) as affected from o union all select 'masks_lost', count(*) filter (where mask_lost) from o
 union all select 'unscorable', count(*) filter (where not scorable) from o union all select 'channel_not_provided', count(*) filter (where image_id%3=0) from f)
select * from w where affected>0 union all select 'fewer_than_two_replicates', count(distinct image_id%4) from f having count(distinct image_id%4)<2"""))
def run_warnings(spark, sf):
    audited, _ = audited_objects(spark, sf)
    objects = audited.withColumn("scorable", (F.col("image_id") % 3 != 0) & (F.col("object_id") % 11 != 0))
    return rollups.run_warnings(raster_fields(spark, sf), objects)


def raster_fields(spark, sf):
    """Field dimension of the raster recipes: four replicates, every third field without signal channel."""
    fields = recipe(spark, sf, "px").select("image_id").distinct()
    return fields.select(
        "image_id", (F.col("image_id") % 4).alias("replicate_id"), F.lit(FRAME[0]).alias("h"), F.lit(FRAME[1]).alias("w"),
        F.lit(1.0).alias("dy"), F.lit(1.0).alias("dx"), (F.col("image_id") % 3 != 0).alias("ebfp_provided"),
    )


@query("viability_by_replicate", duck("px", body=f"""with recursive {OBJECTS},
f as (select distinct image_id, image_id%4 as replicate_id from px),
j as (select f.replicate_id, o.object_id, o.status from f left join objs o using (image_id))
select j.replicate_id, (select count(*) from f where f.replicate_id=j.replicate_id) as n_fields, count(object_id) as total, count(*) filter (where status='live_only') as live_only,
count(*) filter (where status='dead_only') as dead_only, count(*) filter (where status='double_positive') as double_positive,
100::double*count(*) filter (where status='live_only')/nullif(count(object_id),0) as viability_percent from j group by j.replicate_id"""))
def viability_by_replicate(spark, sf):
    """Flagship: raster -> components -> regions -> matching -> replicate counts and viability."""
    _, objects = planar_objects(spark, sf)
    none = F.lit(False)
    plain = objects.withColumns({"provided": none, "scorable": none, "detected": none})
    summary = rollups.replicate_summary(raster_fields(spark, sf), plain)
    return summary.select("replicate_id", "n_fields", "total", "live_only", "dead_only", "double_positive", "viability_percent")
