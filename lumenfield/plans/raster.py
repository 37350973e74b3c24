"""Raster plans: projections, smoothing, neighbourhoods, statistics and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfield.operators import raster
from lumenfield.plans.registry import query
from lumenfield.session import cut
from lumenfield.sources.recipes import duck, recipe, table

FRAME = (64, 64)
STACK = (7, 32, 32)
PLANE = ["image_id", "channel"]
SPACING = (2.0, 0.5, 0.5)


def reflect_matrix(name: str, sigma: float, size: int) -> str:
    """CTEs for the 1-D Gaussian with mirrored borders as a (target, source) weight table."""
    radius = int(4 * sigma + 0.5)
    return f"""
{name}_k as (select k, exp(-0.5::double*(k/{sigma!r}::double)*(k/{sigma!r}::double)) as w from range(-{radius},{radius}+1) r(k)),
{name}_s as (select sum(w) as s from {name}_k),
{name}_i as (select t, k, w, ((t+k)%{2 * size}+{2 * size})%{2 * size} as m from range({size}) g(t), {name}_k),
{name} as (select t, case when m<{size} then m else {2 * size - 1}-m end as src, sum(w/(select s from {name}_s)) as w from {name}_i group by 1,2)"""


def smooth_cte(out: str, source: str, kernel_y: str, kernel_x: str, keys: str = "image_id, channel") -> str:
    return f"""
{out}_h as (select {keys}, y, k.t as x, sum(value*k.w) as value from {source} join {kernel_x} k on k.src=x group by all),
{out} as (select {keys}, k.t as y, x, sum(value*k.w) as value from {out}_h join {kernel_y} k on k.src=y group by all)"""


@query("gaussian_smooth", duck("px", body=f"""with {reflect_matrix("m", 1.2, 64)}, {smooth_cte("g", "px", "m", "m")}
select image_id, channel, cast(y as integer) as y, cast(x as integer) as x, round(value,6) as value from g"""))
def gaussian_smooth(spark, sf):
    smooth = raster.smooth_planes(recipe(spark, sf, "px"), PLANE, {"value": (1.2, 1.2)}, FRAME)
    return smooth.withColumn("value", F.round("value", 6))


@query("contrast", duck("px", body=f"""with gx as (select * from px where channel='green'), rx as (select * from px where channel='red'),
{reflect_matrix("mg", 1.2, 64)}, {reflect_matrix("mr", 1.0, 64)}, {reflect_matrix("mb", 12.0, 64)},
{smooth_cte("sg", "gx", "mg", "mg")}, {smooth_cte("sr", "rx", "mr", "mr")}, {smooth_cte("sb", "px", "mb", "mb")},
near as (select * from sg union all select * from sr)
select image_id, channel, cast(y as integer) as y, cast(x as integer) as x, round(n.value-b.value,6)+0.0::double as contrast from near n join sb b using (image_id, channel, y, x)"""))
def contrast(spark, sf):
    work = raster.contrast(recipe(spark, sf, "px"), {"green": 1.2, "red": 1.0}, 12.0, FRAME)
    return work.withColumn("contrast", F.round("contrast", 6) + F.lit(0.0))


@query("gaussian_smooth_3d", duck("vox", body=f"""with {reflect_matrix("mz", 0.5, 7)}, {reflect_matrix("mp", 2.0, 32)},
{smooth_cte("g", "vox", "mp", "mp", "image_id, channel, z")},
v as (select image_id, channel, k.t as z, y, x, sum(value*k.w) as value from g join mz k on k.src=z group by all)
select image_id, channel, cast(z as integer) as z, cast(y as integer) as y, cast(x as integer) as x, round(value,6) as value from v"""))
def gaussian_smooth_3d(spark, sf):
    smooth = raster.smooth_volume(recipe(spark, sf, "vox"), PLANE, 1.0, SPACING, STACK)
    return smooth.withColumn("value", F.round("value", 6))


@query("threshold_mask", duck("px", body="select image_id, channel, y, x, value from px where value>=60"))
def threshold_mask(spark, sf):
    return recipe(spark, sf, "px").filter("value >= 60")


@query("max_projection", duck("vox", body="select image_id, channel, y, x, max(value) as value from vox where z>=1 and z<6 group by 1,2,3,4"))
def max_projection(spark, sf):
    return raster.max_projection(recipe(spark, sf, "vox"), PLANE, 1, 6)


@query("projection_reconcile", duck("vox", body="""with r as (select image_id, channel, y, x, max(value) as value from vox group by 1,2,3,4),
s as (select image_id, channel, y, x, value + case when image_id%3=1 and (y*32+x)%97=5 then 1 else 0 end as value from r where not (image_id%5=2 and (y*32+x)%211=3)),
j as (select image_id, channel, coalesce(s.value,0) as a, coalesce(r.value,0) as b from r full join s using (image_id, channel, y, x))
select image_id, channel, count(*) as n_pixels, count(*) filter (where a<>b) as n_different, count(*) filter (where a<>b)=0 as equal from j group by 1,2"""))
def projection_reconcile(spark, sf):
    """Recomputed projection against a stored one with planted differences."""
    again = cut(raster.max_projection(recipe(spark, sf, "vox"), PLANE))  # both sides come from one scan
    bump = F.expr("case when image_id % 3 = 1 and (y*32+x) % 97 = 5 then 1 else 0 end")
    stored = again.filter("not (image_id % 5 = 2 and (y*32+x) % 211 = 3)").withColumn("value", F.col("value") + bump)
    return raster.projection_reconcile(stored, again, PLANE)


@query("decimate", duck("px", body="""with f as (select distinct s_suppkey//10 as image_id, 64 as h, 64 - 24*((s_suppkey//10)%2) as w from supplier),
k as (select image_id, cast(ceil(greatest(h,w)/(case when image_id%2=0 then 20.0 else 20.0 end)) as integer) as k from f)
select px.* from px join k using (image_id) where y%k=0 and x%k=0"""))
def decimate(spark, sf):
    frames = table(spark, sf, "supplier").select(F.expr("s_suppkey div 10").alias("image_id")).distinct().select(
        "image_id", F.lit(64).alias("h"), (64 - 24 * (F.col("image_id") % 2)).alias("w")
    )
    return raster.decimate(recipe(spark, sf, "px"), frames, 20).select("image_id", "channel", "y", "x", "value")


@query("raster_contract", duck("px", "planes", body="""with f as (select image_id, channel, case when image_id%4=1 then 60 else 64 end as h, 64 as w, case when image_id%5=2 then 127 else 65535 end as value_max
 from planes where not (image_id%7=5 and channel='red')),
w as (select distinct image_id, unnest(['green','red']) as channel from f),
s as (select image_id, channel, count(*) as n_pixels, min(y) y0, max(y) y1, min(x) x0, max(x) x1, min(value) lo, max(value) hi from px group by 1,2),
k as (select image_id, channel from f union select image_id, channel from w union select image_id, channel from s)
select k.image_id, k.channel, coalesce(n_pixels,0) as n_pixels, case when f.h is null and n_pixels is null then 'missing' when f.h is null then 'undeclared'
 when y0<0 or x0<0 or y1>=h or x1>=w then 'outside_frame' when lo<0 or hi>value_max then 'outside_type' else 'ok' end as verdict
from k left join f using (image_id, channel) left join s using (image_id, channel)"""))
def raster_contract(spark, sf):
    """Planes against their declaration: some declared but empty, some missing, some not declared."""
    ident = F.col("image_id")
    frames = recipe(spark, sf, "planes").filter("not (image_id % 7 = 5 and channel = 'red')").select(
        *PLANE, F.when(ident % 4 == 1, 60).otherwise(64).alias("h"), F.lit(64).alias("w"), F.when(ident % 5 == 2, 127).otherwise(65535).alias("value_max")
    )
    return raster.raster_contract(recipe(spark, sf, "px"), frames)


@query("infer_shape", duck("px", body="""select image_id, channel, max(y)+1 as h, max(x)+1 as w, max(value) as value_max,
case when max(value)<256 then 'uint8' when max(value)<65536 then 'uint16' else 'unsupported' end as dtype from px group by 1,2"""))
def infer_shape(spark, sf):
    return raster.infer_shape(recipe(spark, sf, "px"), PLANE)


DENSE = """p as (select distinct image_id, channel from planes), dense as (select p.image_id, p.channel, coalesce(px.value,0) as value
from p cross join range(64) gy(y) cross join range(64) gx(x) left join px on px.image_id=p.image_id and px.channel=p.channel and px.y=gy.y and px.x=gx.x)"""
POINTS = [0.0, 25.0, 50.0, 75.0, 90.0, 95.0, 99.0, 99.9, 100.0]


@query("intensity_diagnostics", duck("px", "planes", body=f"""with {DENSE}
select image_id, channel, count(distinct value) as n_levels, {", ".join(f"round(quantile_cont(value, {p / 100!r}::double),6) as p{str(p).rstrip('0').rstrip('.').replace('.', '_')}" for p in POINTS)} from dense group by 1,2"""))
def intensity_diagnostics(spark, sf):
    found = raster.intensity_diagnostics(recipe(spark, sf, "px"), PLANE, 64 * 64, POINTS, recipe(spark, sf, "planes"))
    return found.select(*PLANE, "n_levels", *[F.round(c, 6).alias(c) for c in found.columns[3:]])


@query("top_levels", duck("px", "planes", body=f"""with {DENSE}, c as (select image_id, channel, value, count(*) as pixels from dense group by 1,2,3),
r as (select *, cast(row_number() over (partition by image_id, channel order by pixels desc, value desc) as integer) as position from c)
select image_id, channel, value, pixels, position, pixels*100.0::double/4096 as percent from r where position<=12"""))
def top_levels(spark, sf):
    return raster.top_levels(recipe(spark, sf, "px"), PLANE, 64 * 64, planes=recipe(spark, sf, "planes"))


@query("raster_profile", duck("px", "planes", body=f"""with {DENSE} select image_id, channel, min(value) as minimum, max(value) as maximum,
count(*) filter (where value=0)/4096::double as zero_fraction, count(*) filter (where value>=255) as saturated_pixels from dense group by 1,2"""))
def raster_profile(spark, sf):
    return raster.raster_profile(recipe(spark, sf, "px"), PLANE, 64 * 64, planes=recipe(spark, sf, "planes"))


@query("suggest_thresholds", duck("vox", "planes", body="""with p as (select distinct image_id, channel from planes),
dense as (select p.image_id, p.channel, coalesce(v.value,0) as value from p cross join range(7) gz(z) cross join range(32) gy(y) cross join range(32) gx(x)
 left join vox v on v.image_id=p.image_id and v.channel=p.channel and v.z=gz.z and v.y=gy.y and v.x=gx.x),
q as (select image_id, channel, quantile_cont(value,0.5) as base, quantile_cont(value,0.999) as bright from dense group by 1,2),
s as (select *, greatest(bright-base, 255*0.025::double) as span from q),
l as (select *, least(255::double, greatest(1::double, base+0.2::double*span)) as low from s)
select image_id, channel, round(low,3) as low, round(least(255::double, greatest(low, base+0.5::double*span)),3) as high, 10.0::double as min_volume_um3 from l"""))
def suggest_thresholds(spark, sf):
    return raster.suggest_thresholds(recipe(spark, sf, "vox"), PLANE, STACK, 255, SPACING, recipe(spark, sf, "planes"))


@query("dilate_square", duck("px", body="""select distinct image_id, channel, cast(y+dy as integer) as y, cast(x+dx as integer) as x
from px, range(-1,2) a(dy), range(-1,2) b(dx) where value>=60 and y+dy between 0 and 63 and x+dx between 0 and 63"""))
def dilate_square(spark, sf):
    return raster.dilate(recipe(spark, sf, "px").filter("value >= 60"), PLANE, raster.square(1), FRAME)


@query("dilate_cross", duck("px", body="""select distinct image_id, channel, cast(y+dy as integer) as y, cast(x+dx as integer) as x
from px, range(-2,3) a(dy), range(-2,3) b(dx) where value>=60 and abs(dy)+abs(dx)<=2 and y+dy between 0 and 63 and x+dx between 0 and 63"""))
def dilate_cross(spark, sf):
    return raster.dilate(recipe(spark, sf, "px").filter("value >= 60"), PLANE, raster.cross(2), FRAME)


@query("circular_shift", duck("blue", body="select image_id, cast((y+35)%64 as integer) as y, cast((x+35)%64 as integer) as x, value from blue"))
def circular_shift(spark, sf):
    return raster.circular_shift(recipe(spark, sf, "blue"), 35, 35, FRAME)


@query("display_map", duck("px", body="""select image_id, y, x, least(1::double,greatest(0::double,coalesce(max(value) filter (where channel='green'),0)/120::double)) as green,
least(1::double,greatest(0::double,(coalesce(max(value) filter (where channel='red'),0)-10)/80::double)) as red from px group by 1,2,3"""))
def display_map(spark, sf):
    return raster.composite(recipe(spark, sf, "px"), {"green": (0, 120), "red": (10, 90)})


@query("display_bytes", duck("px", body="""select image_id, channel, y, x, cast(floor(least(255::double,greatest(0::double,(value-10)*(255::double/(90::double-10::double))))) as integer) as level from px"""))
def display_bytes(spark, sf):
    return recipe(spark, sf, "px").select(
        *PLANE, "y", "x", raster.display_byte(F.col("value"), F.lit(10.0), F.lit(90.0)).alias("level")
    )


LABELS = "select image_id, channel, y, x, value//40 as label from px where value>=40"


def intensity_labels(spark, sf):
    """A label raster with touching labels: intensity classes of 40 levels."""
    return recipe(spark, sf, "px").filter("value >= 40").select(*PLANE, "y", "x", F.expr("value div 40").cast("int").alias("label"))


@query("label_boundaries", duck("px", body=f"""with l as ({LABELS}), n as (select l.*, (select count(*) from l m where m.image_id=l.image_id and m.channel=l.channel and m.label=l.label and abs(m.y-l.y)+abs(m.x-l.x)=1) as same from l)
select image_id, channel, y, x, label from n where same<4"""))
def label_boundaries(spark, sf):
    return raster.label_boundaries(intensity_labels(spark, sf), PLANE)


@query("outline_segments", duck("px", body=f"""with l as ({LABELS}),
v as (select l.image_id, l.channel, l.y, l.x, -0.5::double as side from l left join l m on m.image_id=l.image_id and m.channel=l.channel and m.y=l.y and m.x=l.x-1 where m.label is distinct from l.label
 union all select l.image_id, l.channel, l.y, l.x, 0.5::double from l left join l m on m.image_id=l.image_id and m.channel=l.channel and m.y=l.y and m.x=l.x+1 where m.label is null),
h as (select l.image_id, l.channel, l.y, l.x, -0.5::double as side from l left join l m on m.image_id=l.image_id and m.channel=l.channel and m.y=l.y-1 and m.x=l.x where m.label is distinct from l.label
 union all select l.image_id, l.channel, l.y, l.x, 0.5::double from l left join l m on m.image_id=l.image_id and m.channel=l.channel and m.y=l.y+1 and m.x=l.x where m.label is null)
select image_id, channel, 'vertical' as orientation, y-0.5::double as y0, x+side as x0, y+0.5::double as y1, x+side as x1 from v
union all select image_id, channel, 'horizontal', y+side, x-0.5::double, y+side, x+0.5::double from h"""))
def outline_segments(spark, sf):
    return raster.outline_segments(intensity_labels(spark, sf), PLANE)


POINT = "cast(image_id%7 as integer) as z0, cast((image_id*5)%32 as integer) as y0, cast((image_id*11)%32 as integer) as x0"


@query("orthogonal_sections", duck("vox", body=f"""with v as (select *, {POINT} from vox)
select 'xy' as section, image_id, channel, z, y, x, value from v where z=z0 union all select 'xz', image_id, channel, z, y, x, value from v where y=y0
union all select 'yz', image_id, channel, z, y, x, value from v where x=x0"""))
def orthogonal_sections(spark, sf):
    return raster.orthogonal_sections(recipe(spark, sf, "vox"), view_points(spark, sf)).select(
        "section", *PLANE, "z", "y", "x", "value"
    )


def view_points(spark, sf):
    fields = table(spark, sf, "supplier").select(F.expr("s_suppkey div 10").alias("image_id")).distinct()
    return fields.selectExpr("image_id", *POINT.split(", "))


@query("crop_window", duck("px", body="""with c as (select *, least(greatest((image_id*13)%64-8,0),48) as ya, least(greatest((image_id*29)%64-8,0),48) as xa from px),
w as (select 'around_point' as crop, image_id, channel, y, x, value from c where y between ya and ya+15 and x between xa and xa+15)
select * from w union all select 'central', image_id, channel, y, x, value from px where y between 20 and 43 and x between 20 and 43"""))
def crop_window(spark, sf):
    """A 16-pixel window clamped to the frame around one point per field, and the central crop."""
    px = recipe(spark, sf, "px")
    ya = raster.clamp_start((F.col("image_id") * 13) % 64, 16, 64)
    xa = raster.clamp_start((F.col("image_id") * 29) % 64, 16, 64)
    around = px.filter(F.col("y").between(ya, ya + 15) & F.col("x").between(xa, xa + 15))
    central = raster.central_crop(px, 0.375, FRAME)
    return around.select(F.lit("around_point").alias("crop"), "*").unionByName(central.select(F.lit("central").alias("crop"), "*"))


@query("depth_profile", duck("vox", body=f"""with p as (select distinct image_id, channel, {POINT} from vox),
b as (select *, greatest(0,y0-4) ya, least(31,y0+4) yb, greatest(0,x0-4) xa, least(31,x0+4) xb from p),
s as (select v.image_id, v.channel, v.z, sum(v.value) as s from vox v join b using (image_id, channel) where v.y between ya and yb and v.x between xa and xb group by 1,2,3)
select b.image_id, b.channel, cast(g.z as integer) as z, coalesce(s.s,0)/((yb-ya+1)*(xb-xa+1))::double as mean
from b cross join range(7) g(z) left join s on s.image_id=b.image_id and s.channel=b.channel and s.z=g.z"""))
def depth_profile(spark, sf):
    rois = view_points(spark, sf).select("image_id", "y0", "x0", F.lit(4).alias("radius"))
    return raster.depth_profile(recipe(spark, sf, "vox"), rois, STACK)


@query("point_lookup", duck("px", body="""with p as (select event_id, user_id%10 as image_id, case when event_id%2=0 then 'green' else 'red' end as channel, cast(event_id%70 as integer) as y, cast((event_id*7)%64 as integer) as x from events)
select p.event_id, p.image_id, p.channel, p.y, p.x, coalesce(l.label,0) as label from p left join (select image_id, channel, y, x, value//40 as label from px where value>=40) l using (image_id, channel, y, x) where p.y<64"""))
def point_lookup(spark, sf):
    points = table(spark, sf, "events").select(
        "event_id", (F.col("user_id") % 10).alias("image_id"), F.when(F.col("event_id") % 2 == 0, "green").otherwise("red").alias("channel"),
        (F.col("event_id") % 70).cast("int").alias("y"), ((F.col("event_id") * 7) % 64).cast("int").alias("x"),
    )
    return raster.point_lookup(points, intensity_labels(spark, sf), FRAME, keys=PLANE).select("event_id", *PLANE, "y", "x", "label")
