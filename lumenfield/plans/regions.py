"""Components, peaks, seeds, splitting and region tables of planar fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfield.functions.scalars import total
from lumenfield.operators import components, regions
from lumenfield.plans.raster import FRAME, PLANE
from lumenfield.plans.registry import query
from lumenfield.session import cut
from lumenfield.sources.recipes import duck, recipe

LOW, HIGH, MIN_AREA, WINDOW, SPACE = 50, 80, 2, 5, 3


def code_sql(axes: str) -> str:
    out = "0::bigint"
    for a in axes:
        out = f"(({out})*2097152+{a})"
    return out


def cc_cte(mask: str, out: str, axes: str = "yx", conn: str = "full", keys: str = "image_id, channel") -> str:
    """Components by transitive closure: ``out`` is ``mask`` plus ``root``."""
    near = " and ".join(f"abs(a.{v}-b.{v})<=1" for v in axes)
    if conn == "faces":
        near += " and " + "+".join(f"abs(a.{v}-b.{v})" for v in axes) + "=1"
    ks = [k.strip() for k in keys.split(",")]
    same = " and ".join(f"a.{k}=b.{k}" for k in ks)
    cols = ", ".join(f"m.{k}" for k in ks)
    return f"""
{out}_m as (select *, {code_sql(axes)} as code from {mask}),
{out}_e as (select {", ".join("a." + k for k in ks)}, a.code as s, b.code as t from {out}_m a join {out}_m b on {same} and {near}),
{out}_r({keys}, code, reach) as (select {keys}, code, code from {out}_m union select {", ".join("r." + k for k in ks)}, r.code, e.t from {out}_r r join {out}_e e on {" and ".join(f"r.{k}=e.{k}" for k in ks)} and r.reach=e.s),
{out} as (select m.* exclude (code), g.root from {out}_m m join (select {keys}, code, min(reach) as root from {out}_r group by all) g using ({keys}, code))"""


MASK = f"mask as (select * from px where value>={LOW})"
COMPONENTS = f"{MASK}, {cc_cte('mask', 'lab')}"
ADMITTED = f"""{COMPONENTS},
comp as (select image_id, channel, root, count(*) as area, max(value) as peak, min(y) y0, max(y) y1, min(x) x0, max(x) x1 from lab group by 1,2,3),
good as (select * from comp where area>={MIN_AREA} and peak>={HIGH})"""


def labelled(spark, sf):
    return components.label_components(recipe(spark, sf, "px").filter(F.col("value") >= LOW), PLANE)


def admitted(spark, sf):
    return regions.admit(labelled(spark, sf), PLANE, (F.col("area") >= MIN_AREA) & (F.col("peak") >= HIGH))


@query("connected_components", duck("px", body=f"with recursive {COMPONENTS} select image_id, channel, y, x, value, root from lab"))
def connected_components(spark, sf):
    return labelled(spark, sf).select(*PLANE, "y", "x", "value", "root")


@query("hysteresis", duck("px", body=f"""with recursive {COMPONENTS}
select * from lab where (image_id, channel, root) in (select image_id, channel, root from lab group by all having max(value)>={HIGH})"""))
def hysteresis(spark, sf):
    kept = regions.admit(labelled(spark, sf), PLANE, F.col("peak") >= HIGH)
    return kept.select(*PLANE, "y", "x", "value", "root")


@query("component_filter", duck("px", body=f"""with recursive {COMPONENTS}, c as (select image_id, channel, root, count(*) as area from lab group by all having count(*)>=4),
n as (select *, row_number() over (partition by image_id, channel order by root) as id from c)
select lab.image_id, lab.channel, y, x, value, id from lab join n using (image_id, channel, root)"""))
def component_filter(spark, sf):
    """Components of at least four pixels, renumbered in raster order of their first pixel."""
    labels = labelled(spark, sf)
    kept = regions.component_sizes(labels, PLANE).filter("area >= 4")
    ids = regions.dense_ids(kept, PLANE, ["root"]).select(*PLANE, "root", "id")
    return labels.join(ids, [*PLANE, "root"]).select(*PLANE, "y", "x", "value", "id")


@query("border_exclusion", duck("px", body=f"""with recursive {COMPONENTS}, c as (select image_id, channel, root from lab group by all having min(y)>0 and min(x)>0 and max(y)<63 and max(x)<63)
select lab.* from lab join c using (image_id, channel, root)"""))
def border_exclusion(spark, sf):
    kept = regions.exclude_border(labelled(spark, sf), [*PLANE, "root"], {"y": FRAME[0], "x": FRAME[1]})
    return kept.select(*PLANE, "y", "x", "value", "root")


PROPS = f"""{ADMITTED},
inner_ as (select * from good where y0>0 and x0>0 and y1<63 and x1<63),
props as (select image_id, channel, row_number() over (partition by image_id, channel order by root) as id, * exclude (image_id, channel) from
 (select l.image_id, l.channel, l.root, sum(value*y)/sum(value)::double as y, sum(value*x)/sum(value)::double as x, count(*) as area, max(value) as peak_contrast,
  avg(value) as mean_raw, max(value) as max_raw from lab l join inner_ i using (image_id, channel, root) group by 1,2,3))"""


def unsplit_regions(spark, sf):
    """(label pixels with id, region table) of whole admitted components away from the border."""
    inner = regions.exclude_border(admitted(spark, sf), [*PLANE, "root"], {"y": FRAME[0], "x": FRAME[1]})
    inner = cut(inner.withColumn("raw", F.col("value")))
    props = regions.dense_ids(regions.region_props(inner, PLANE, ["root"]), PLANE, ["root"])
    return inner.join(props.select(*PLANE, "root", "id"), [*PLANE, "root"]), props


@query("region_props", duck("px", body=f"""with recursive {PROPS}
select image_id, channel, id, round(y,8) as y, round(x,8) as x, area, peak_contrast, round(mean_raw,8) as mean_raw, max_raw from props"""))
def region_props(spark, sf):
    _, props = unsplit_regions(spark, sf)
    return props.select(
        *PLANE, "id", F.round("y", 8).alias("y"), F.round("x", 8).alias("x"), "area", "peak_contrast", F.round("mean_raw", 8).alias("mean_raw"), "max_raw"
    )


@query("detection_diagnostics", duck("px", body=f"""with recursive {PROPS}
select image_id, channel, count(*) as detections, cast(sum(area) as bigint) as segmented_pixels, median(area) as area_median_px, count(*) filter (where area<=5) as area_le_5_count,
count(*) filter (where area<8) as area_lt_8_count, median(peak_contrast) as peak_contrast_median, count(*) filter (where peak_contrast<90) as peak_contrast_lt_90_count,
count(*) filter (where max_raw<=85) as raw_max_le_85_count from props group by 1,2"""))
def detection_diagnostics(spark, sf):
    _, props = unsplit_regions(spark, sf)
    return props.groupBy(*PLANE).agg(
        F.count("*").alias("detections"), F.sum("area").alias("segmented_pixels"), F.percentile("area", F.lit(0.5)).alias("area_median_px"),
        total(F.col("area") <= 5).alias("area_le_5_count"), total(F.col("area") < 8).alias("area_lt_8_count"),
        F.percentile("peak_contrast", F.lit(0.5)).alias("peak_contrast_median"), total(F.col("peak_contrast") < 90).alias("peak_contrast_lt_90_count"),
        total(F.col("max_raw") <= 85).alias("raw_max_le_85_count"),
    )


MAXIMA = f"""{ADMITTED},
cand as (select l.*, g.y0, g.y1, g.x0, g.x1 from lab l join good g using (image_id, channel, root) where l.value>={HIGH}),
peaks as (select image_id, channel, root, y, x, value from cand c where not exists (select 1 from px q where q.image_id=c.image_id and q.channel=c.channel
 and q.y between greatest(c.y-{WINDOW // 2},c.y0) and least(c.y+{WINDOW // 2},c.y1) and q.x between greatest(c.x-{WINDOW // 2},c.x0) and least(c.x+{WINDOW // 2},c.x1) and q.value>c.value)),
ranked as (select *, row_number() over (partition by image_id, channel, root order by value desc, y desc, x desc) as rn from peaks)"""


def peaks(spark, sf):
    labels = cut(admitted(spark, sf))
    return regions.local_maxima(labels, recipe(spark, sf, "px"), PLANE, {"y": WINDOW // 2, "x": WINDOW // 2}, F.lit(HIGH))


@query("local_maxima", duck("px", body=f"with recursive {MAXIMA} select image_id, channel, root, y, x, value from peaks"))
def local_maxima(spark, sf):
    return peaks(spark, sf).select(*PLANE, "root", "y", "x", "value")


@query("seed_rank", duck("px", body=f"with recursive {MAXIMA} select image_id, channel, root, y, x, value, cast(rn as integer) as seed from ranked"))
def seed_rank(spark, sf):
    return regions.number_seeds(peaks(spark, sf), PLANE, regions.strongest_first()).select(*PLANE, "root", "y", "x", "value", "seed")


THINNED = f"""{MAXIMA},
walk as (select image_id, channel, root, rn, true as kept, y, x, value, [{{'y': y, 'x': x}}] as acc from ranked where rn=1
 union all select r.image_id, r.channel, r.root, r.rn, len(list_filter(w.acc, lambda p: (p.y-r.y)*(p.y-r.y)+(p.x-r.x)*(p.x-r.x)<{SPACE * SPACE}))=0, r.y, r.x, r.value,
 case when len(list_filter(w.acc, lambda p: (p.y-r.y)*(p.y-r.y)+(p.x-r.x)*(p.x-r.x)<{SPACE * SPACE}))=0 then list_append(w.acc, {{'y': r.y, 'x': r.x}}) else w.acc end
 from walk w join ranked r on r.image_id=w.image_id and r.channel=w.channel and r.root=w.root and r.rn=w.rn+1)"""


@query("seed_thinning", duck("px", body=f"with recursive {THINNED} select image_id, channel, root, y, x, value from walk where kept"))
def seed_thinning(spark, sf):
    thinned = regions.thin_seeds(cut(peaks(spark, sf)), PLANE, {"y": 1.0, "x": 1.0}, SPACE, regions.strongest_first())
    return thinned.select(*PLANE, "root", "y", "x", "value")


def split_cte(lab: str, out: str, keys: str, window: int, space: int) -> str:
    """Peaks, greedy thinning and the priority flood as recursive SQL.

    ``lab(keys, y, x, value, root, high, min_area)`` -> ``out(keys, y, x, id)``; ``px`` is the field.
    """
    ks = [k.strip() for k in keys.split(",")]
    def on(a, b):
        return " and ".join(f"{a}.{k}={b}.{k}" for k in [*ks, "root"])

    cols = ", ".join([*ks, "root"])
    def of(a):
        return ", ".join(f"{a}.{k}" for k in [*ks, "root"])

    far = f"(p.y-r.y)*(p.y-r.y)+(p.x-r.x)*(p.x-r.x)<{space * space}"
    r = window // 2
    return f"""
{out}_c as (select {cols}, min(y) y0, max(y) y1, min(x) x0, max(x) x1, any_value(high) as high, any_value(min_area) as min_area from {lab} group by all having count(*)>=any_value(min_area) and max(value)>=any_value(high)),
{out}_l as (select l.*, c.y0, c.y1, c.x0, c.x1 from {lab} l join {out}_c c on {on("l", "c")}),
{out}_p as (select * from {out}_l c where value>=high and not exists (select 1 from px q where q.image_id=c.image_id and q.channel=c.channel
 and q.y between greatest(c.y-{r},c.y0) and least(c.y+{r},c.y1) and q.x between greatest(c.x-{r},c.x0) and least(c.x+{r},c.x1) and q.value>c.value)),
{out}_r as (select *, row_number() over (partition by {cols} order by value desc, y desc, x desc) as rn from {out}_p),
{out}_w as (select {cols}, rn, true as kept, y, x, value, [{{'y': y, 'x': x}}] as acc from {out}_r where rn=1
 union all select {of("r")}, r.rn, len(list_filter(w.acc, lambda p: {far}))=0, r.y, r.x, r.value,
 case when len(list_filter(w.acc, lambda p: {far}))=0 then list_append(w.acc, {{'y': r.y, 'x': r.x}}) else w.acc end from {out}_w w join {out}_r r on {on("r", "w")} and r.rn=w.rn+1),
{out}_f as (select {cols}, y, x, value from (select *, row_number() over (partition by {cols} order by value desc, y, x) as k from {out}_l l where not exists (select 1 from {out}_p p where {on("p", "l")})) where k=1),
{out}_s as (select *, row_number() over (partition by {cols} order by value desc, y desc, x desc) as j, count(*) over (partition by {cols}) as n from (select {cols}, y, x, value from {out}_w where kept union all select * from {out}_f)),
{out}_m as (select {of("l")}, list({{'y': l.y, 'x': l.x, 'v': l.value}}) as cells from {out}_l l where exists (select 1 from {out}_s s where {on("s", "l")} and s.n>1) group by all),
{out}_q as (select {cols}, list({{'l': -value, 'y': y, 'x': x, 'j': j}}) as queue, list({{'y': y, 'x': x, 'j': j}}) as own from {out}_s where n>1 group by all
 union all select {of("z")}, list_concat(list_sort(z.queue)[2:], list_transform(z.fresh, lambda c: {{'l': greatest(z.pop.l, -c.v), 'y': c.y, 'x': c.x, 'j': z.pop.j}})),
  list_concat(z.own, list_transform(z.fresh, lambda c: {{'y': c.y, 'x': c.x, 'j': z.pop.j}}))
 from (select u.*, list_filter(u.cells, lambda c: abs(c.y-u.pop.y)<=1 and abs(c.x-u.pop.x)<=1 and not list_contains(u.taken, c.y*4096+c.x)) as fresh
  from (select t.*, m.cells, list_sort(t.queue)[1] as pop, list_transform(t.own, lambda o: o.y*4096+o.x) as taken from {out}_q t join {out}_m m on {on("t", "m")} where len(t.queue)>0) u) z),
{out}_o as (select {cols}, unnest(own) as o from {out}_q where len(queue)=0),
{out}_g as (select {cols}, o.y as y, o.x as x, o.j as seed from {out}_o union all select {of("l")}, l.y, l.x, 1 from {out}_l l where exists (select 1 from {out}_s s where {on("s", "l")} and s.n=1)),
{out}_z as (select {cols}, seed from {out}_g g join (select {cols}, min_area from {out}_c) c using ({cols}) group by {cols}, seed having count(*)>=any_value(min_area) and min(y)>0 and min(x)>0 and max(y)<63 and max(x)<63),
{out}_i as (select *, row_number() over (partition by {keys} order by root, seed) as id from {out}_z),
{out} as (select {", ".join("g." + k for k in ks)}, g.y, g.x, i.id from {out}_g g join {out}_i i on {on("g", "i")} and g.seed=i.seed)"""


def planar_segments(spark, sf):
    """Whole planar segmentation with splitting: (label pixels, regions)."""
    field = recipe(spark, sf, "px").withColumn("raw", F.col("value"))
    return regions.segment(field, PLANE, F.lit(LOW), F.lit(HIGH), F.lit(MIN_AREA), FRAME, WINDOW, SPACE, True)


@query("seeded_split", duck("px", body=f"""with recursive {COMPONENTS}, slab as (select *, {HIGH} as high, {MIN_AREA} as min_area from lab),
{split_cte("slab", "spl", "image_id, channel", WINDOW, SPACE)} select image_id, channel, y, x, id from spl"""))
def seeded_split(spark, sf):
    """Label pixels after splitting touching regions from their seeds."""
    pixels, _ = planar_segments(spark, sf)
    return pixels.select(*PLANE, "y", "x", "id")
