"""Volume plans: 3-D components, peaks, region tables and association groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfield.operators import raster, regions, volume
from lumenfield.operators.components import label_components
from lumenfield.plans.raster import PLANE
from lumenfield.plans.regions import cc_cte
from lumenfield.plans.registry import query
from lumenfield.session import cut
from lumenfield.sources.recipes import duck, recipe

STACK = (7, 32, 32)
PITCH = {"z": 2.0, "y": 0.5, "x": 0.5}
ZLOW, ZHIGH, ZAREA = 50, 60, 2
IMAGE = ["image_id"]

VMASK = f"vmask as (select * from vox where value>={ZLOW})"
FULL = f"{VMASK}, {cc_cte('vmask', 'vlab', 'zyx', 'full')}"
FACES = f"{VMASK}, {cc_cte('vmask', 'vlab', 'zyx', 'faces')}"


def bright_voxels(spark, sf):
    return recipe(spark, sf, "vox").filter(F.col("value") >= ZLOW)


@query("connected_components_3d", duck("vox", body=f"""with recursive {VMASK}, {cc_cte('vmask', 'la', 'zyx', 'full')}, {cc_cte('vmask', 'lb', 'zyx', 'faces')}
select 'full' as connectivity, * from la union all select 'faces', * from lb"""))
def connected_components_3d(spark, sf):
    out = None
    for connectivity in ("full", "faces"):
        part = label_components(bright_voxels(spark, sf), PLANE, volume.AXES, connectivity)
        part = part.select(F.lit(connectivity).alias("connectivity"), *PLANE, "z", "y", "x", "value", "root")
        out = part if out is None else out.unionByName(part)
    return out


DISTANCES = """o as (select dz, dy, dx, sqrt(dz*dz*4.0::double+(dy*dy+dx*dx)*0.25::double) as d from range(-7,8) a(dz), range(-12,13) b(dy), range(-12,13) c(dx) where dz*dz*4+(dy*dy+dx*dx)*0.25<=9 and not (dz=0 and dy=0 and dx=0)),
vdist as (select l.image_id, l.channel, l.root, l.z, l.y, l.x, min(o.d) as d from vlab l cross join o left join vlab m on m.image_id=l.image_id and m.channel=l.channel and m.root=l.root and m.z=l.z+o.dz and m.y=l.y+o.dy and m.x=l.x+o.dx
where m.root is null group by 1,2,3,4,5,6)"""


@query("distance_to_background", duck("vox", body=f"with recursive {FACES}, {DISTANCES} select image_id, channel, root, z, y, x, round(d,8) as distance from vdist"))
def distance_to_background(spark, sf):
    labels = label_components(bright_voxels(spark, sf), PLANE, volume.AXES, "faces")
    found = raster.distance_to_background(labels, PLANE, PITCH)
    return found.select(*PLANE, "root", "z", "y", "x", F.round("distance", 8).alias("distance"))


V_PEAKS = f"""{FULL},
vcomp as (select image_id, channel, root, count(*) as n, max(value) as peak, min(z) z0, max(z) z1, min(y) y0, max(y) y1, min(x) x0, max(x) x1 from vlab group by 1,2,3 having count(*)>={ZAREA} and max(value)>={ZHIGH}),
vcand as (select l.*, c.z0, c.z1, c.y0, c.y1, c.x0, c.x1 from vlab l join vcomp c using (image_id, channel, root) where l.value>={ZHIGH}),
vmax as (select image_id, channel, root as component, z, y, x, value from vcand c where not exists (select 1 from vox q where q.image_id=c.image_id and q.channel=c.channel
 and abs(q.z-c.z)<=1 and abs(q.y-c.y)<=1 and abs(q.x-c.x)<=1 and q.z between c.z0 and c.z1 and q.y between c.y0 and c.y1 and q.x between c.x0 and c.x1 and q.value>c.value)),
{cc_cte('vmax', 'plat', 'zyx', 'full', 'image_id, channel, component')},
pm as (select *, avg(z) over w as mz, avg(y) over w as my, avg(x) over w as mx from plat window w as (partition by image_id, channel, component, root)),
pr as (select *, row_number() over (partition by image_id, channel, component, root order by round((z-mz)*(z-mz)*4::double+((y-my)*(y-my)+(x-mx)*(x-mx))*0.25::double,9), z, y, x) as rn from pm)"""


@query("local_maxima_3d", duck("vox", body=f"with recursive {V_PEAKS} select image_id, channel, component as root, z, y, x, value from pr where rn=1"))
def local_maxima_3d(spark, sf):
    voxels = recipe(spark, sf, "vox")
    labels = label_components(voxels.filter(F.col("value") >= ZLOW), PLANE, volume.AXES, "full")
    labels = cut(regions.admit(labels, PLANE, (F.col("area") >= ZAREA) & (F.col("peak") >= ZHIGH)))
    maxima = regions.local_maxima(labels, voxels, PLANE, volume.peak_radii(3, PITCH), F.lit(ZHIGH))
    return regions.plateau_peaks(maxima, PLANE, PITCH, "full").select(*PLANE, "root", "z", "y", "x", "value")


def grown_cte(p: str, ranked: str, lab: str, near: str, touching: str) -> str:
    """Greedy thinning of ``ranked`` peaks and the flood of ``lab``, first come first served, as recursive SQL; ends in ``<p>pc``."""
    return f"""
{p}wk as (select image_id, channel, root, n, true as kept, z, y, x, value, [{{'z': z, 'y': y, 'x': x}}] as acc from {ranked} where n=1
 union all select r.image_id, r.channel, r.root, r.n, len(list_filter(w.acc, lambda p: {near}))=0, r.z, r.y, r.x, r.value,
 case when len(list_filter(w.acc, lambda p: {near}))=0 then list_append(w.acc, {{'z': r.z, 'y': r.y, 'x': r.x}}) else w.acc end
 from {p}wk w join {ranked} r on r.image_id=w.image_id and r.channel=w.channel and r.root=w.root and r.n=w.n+1),
{p}sd as (select *, row_number() over (partition by image_id, channel, root order by value desc, z, y, x) as j, count(*) over (partition by image_id, channel, root) as total from {p}wk where kept),
{p}cl as (select image_id, channel, root, list({{'z': z, 'y': y, 'x': x, 'v': value}}) as cells from {lab} where (image_id, channel, root) in (select image_id, channel, root from {p}sd where total>1) group by all),
{p}fl as (select image_id, channel, root, 0 as age, list({{'l': -value, 'a': 0, 'j': j, 'z': z, 'y': y, 'x': x}}) as queue, list({{'z': z, 'y': y, 'x': x, 'j': j}}) as own from {p}sd where total>1 group by all
 union all select image_id, channel, root, age+len(fresh)::integer, list_concat(list_sort(queue)[2:], list_transform(fresh, lambda c, i: {{'l': -c.v, 'a': age+i::integer, 'j': pop.j, 'z': c.z, 'y': c.y, 'x': c.x}})),
  list_concat(own, list_transform(fresh, lambda c: {{'z': c.z, 'y': c.y, 'x': c.x, 'j': pop.j}}))
 from (select u.*, list_sort(list_transform(list_filter(u.cells, lambda c: {touching} and not list_contains(u.taken, (c.z*4096+c.y)*4096+c.x)),
   lambda c: {{'far': abs(c.z-u.pop.z)+abs(c.y-u.pop.y)+abs(c.x-u.pop.x), 'z': c.z, 'y': c.y, 'x': c.x, 'v': c.v}})) as fresh
  from (select t.*, m.cells, list_sort(t.queue)[1] as pop, list_transform(t.own, lambda o: (o.z*4096+o.y)*4096+o.x) as taken from {p}fl t join {p}cl m using (image_id, channel, root) where len(t.queue)>0) u) s),
{p}ow as (select image_id, channel, root, unnest(own) as o from {p}fl where len(queue)=0),
{p}pc as (select image_id, channel, root, o.z as z, o.y as y, o.x as x, o.j as seed from {p}ow
 union all select l.image_id, l.channel, l.root, l.z, l.y, l.x, 1 from {lab} l join {p}sd s on s.image_id=l.image_id and s.channel=l.channel and s.root=l.root and s.total=1)"""


# planar controls: window 3 px (one plane), peaks 3 px = 1.5 um apart, sections of two pixels
V_NEAR = "((p.z-r.z)*(p.z-r.z)*4::double+((p.y-r.y)*(p.y-r.y)+(p.x-r.x)*(p.x-r.x))*0.25::double)<2.25::double"
V_SPLIT = f"""{V_PEAKS},
vsec as (select image_id, channel, root from (select image_id, channel, root, z, count(*) as n from vlab group by all) group by all having max(n)>={ZAREA}),
vpk as (select p.image_id, p.channel, p.component as root, p.z, p.y, p.x, p.value from pr p join vsec s on s.image_id=p.image_id and s.channel=p.channel and s.root=p.component where p.rn=1),
vfb as (select image_id, channel, root, z, y, x, value from (select l.*, row_number() over (partition by image_id, channel, root order by value desc, z, y, x) as k from vlab l join vcomp using (image_id, channel, root) join vsec using (image_id, channel, root)
 where (image_id, channel, root) not in (select image_id, channel, root from vpk)) where k=1),
vrk as (select *, row_number() over (partition by image_id, channel, root order by value desc, z, y, x) as n from (select * from vpk union all select * from vfb)),
{grown_cte("v", "vrk", "vlab", V_NEAR, "abs(c.z-u.pop.z)<=1 and abs(c.y-u.pop.y)<=1 and abs(c.x-u.pop.x)<=1")},
vpv as (select p.*, l.value from vpc p join vlab l using (image_id, channel, root, z, y, x)),
vok as (select image_id, channel, root, seed from (select image_id, channel, root, seed, z, count(*) as n, max(value) as top from vpv group by all) group by all having sum(n)>={ZAREA} and max(n)>={ZAREA} and max(top)>={ZHIGH}),
vid as (select *, row_number() over (partition by image_id, channel order by root, seed) as id from vok)"""


@query("seeded_split_3d", duck("vox", body=f"with recursive {V_SPLIT} select image_id, channel, z, y, x, id from vpv join vid using (image_id, channel, root, seed)"))
def seeded_split_3d(spark, sf):
    """Label voxels of the planar-control mode after splitting touching regions."""
    shared, _ = volume.segment_projection(recipe(spark, sf, "vox"), PLANE, F.lit(ZLOW), F.lit(ZHIGH), ZAREA, PITCH, STACK, 3, 3, False)
    return shared.select(*PLANE, "z", "y", "x", "id")


# seeds 2 um apart, objects of two voxels (1 um3)
R_NEAR = V_NEAR.replace("2.25::double", "4.0::double")
R_SPLIT = f"""{FACES}, {DISTANCES},
rgood as (select image_id, channel, root from vlab group by all having count(*)>=2 and max(value)>={ZHIGH}),
rlab as (select d.image_id, d.channel, d.root, d.z, d.y, d.x, d.d as value from vdist d join rgood using (image_id, channel, root)),
rmax as (select image_id, channel, root as component, z, y, x, value from rlab c where not exists (select 1 from rlab q where q.image_id=c.image_id and q.channel=c.channel and q.root=c.root
 and abs(q.z-c.z)<=1 and abs(q.y-c.y)<=1 and abs(q.x-c.x)<=1 and q.value>c.value)),
{cc_cte('rmax', 'rplat', 'zyx', 'faces', 'image_id, channel, component')},
rpm as (select *, avg(z) over w as mz, avg(y) over w as my, avg(x) over w as mx from rplat window w as (partition by image_id, channel, component, root)),
rpr as (select *, row_number() over (partition by image_id, channel, component, root order by round((z-mz)*(z-mz)*4::double+((y-my)*(y-my)+(x-mx)*(x-mx))*0.25::double,9), z, y, x) as rn from rpm),
rrk as (select image_id, channel, component as root, z, y, x, value, row_number() over (partition by image_id, channel, component order by value desc, z, y, x) as n from rpr where rn=1),
{grown_cte("r", "rrk", "rlab", R_NEAR, "abs(c.z-u.pop.z)+abs(c.y-u.pop.y)+abs(c.x-u.pop.x)=1")},
rpv as (select p.*, l.value from rpc p join vlab l using (image_id, channel, root, z, y, x)),
rok as (select image_id, channel, root, seed from rpv group by all having count(*)>=2 and max(value)>={ZHIGH}),
rid as (select *, row_number() over (partition by image_id, channel order by root, seed) as id from rok)"""


@query("seeded_split_3d_raw", duck("vox", body=f"with recursive {R_SPLIT} select image_id, channel, z, y, x, id from rpv join rid using (image_id, channel, root, seed)"))
def seeded_split_3d_raw(spark, sf):
    """Label voxels of the absolute-intensity mode, split by distance to background."""
    raw, _ = volume.segment_raw(recipe(spark, sf, "vox"), PLANE, F.lit(ZLOW), F.lit(ZHIGH), 1.0, PITCH, STACK, 2.0, False)
    return raw.select(*PLANE, "z", "y", "x", "id")


V_PROPS = f"""{FULL},
sec as (select image_id, channel, root, z, count(*) as n from vlab group by 1,2,3,4),
vprops as (select image_id, channel, row_number() over (partition by image_id, channel order by root) as id, * exclude (image_id, channel) from (
 select l.image_id, l.channel, l.root, sum(value*z)/sum(value)::double as z, sum(value*y)/sum(value)::double as y, sum(value*x)/sum(value)::double as x, count(*) as voxels,
  count(*)*0.5::double as volume_um3, max(value) as peak_intensity, min(z)=0 or max(z)=6 or min(y)=0 or max(y)=31 or min(x)=0 or max(x)=31 as touches_boundary
 from vlab l group by 1,2,3 having count(*)>={ZAREA} and max(value)>={ZHIGH}) p join (select image_id, channel, root, max(n) as max_xy_area_px from sec group by 1,2,3) s using (image_id, channel, root)),
vpix as (select l.image_id, l.channel, l.z, l.y, l.x, p.id from vlab l join vprops p using (image_id, channel, root))"""


def unsplit_volume(spark, sf):
    """(label voxels with id, region table) of whole admitted components."""
    labels = label_components(bright_voxels(spark, sf), PLANE, volume.AXES, "full")
    labels = cut(regions.admit(labels, PLANE, (F.col("area") >= ZAREA) & (F.col("peak") >= ZHIGH)))
    props = volume.region_props_3d(labels, PLANE, ["root"], PITCH, STACK, weighted=True)
    props = cut(regions.dense_ids(props, PLANE, ["root"]))
    return labels.join(props.select(*PLANE, "root", "id"), [*PLANE, "root"]).select(*PLANE, "z", "y", "x", "id"), props.drop("root")


@query("region_props_3d", duck("vox", body=f"""with recursive {V_PROPS}
select image_id, channel, id, round(z,8) as z, round(y,8) as y, round(x,8) as x, voxels, volume_um3, peak_intensity, touches_boundary, max_xy_area_px from vprops"""))
def region_props_3d(spark, sf):
    _, props = unsplit_volume(spark, sf)
    return props.select(
        *PLANE, "id", *[F.round(a, 8).alias(a) for a in volume.AXES], "voxels", "volume_um3", "peak_intensity", "touches_boundary", "max_xy_area_px"
    )


OVERLAPS = "common as (select g.image_id, g.id as green_id, r.id as red_id, count(*) as overlap from vpix g join vpix r using (image_id, z, y, x) where g.channel='green' and r.channel='red' group by 1,2,3)"


@query("surface_gap_join", duck("vox", body=f"""with recursive {V_PROPS},
near as (select g.image_id, g.id as green_id, r.id as red_id, sqrt((g.z-r.z)*(g.z-r.z)*4::double+((g.y-r.y)*(g.y-r.y)+(g.x-r.x)*(g.x-r.x))*0.25::double) as d, r.z, r.y, r.x
 from vpix g join vpix r on g.image_id=r.image_id and g.channel='green' and r.channel='red' and g.z=r.z and abs(g.y-r.y)<=2 and abs(g.x-r.x)<=2)
select image_id, green_id, red_id, round(min(d),8) as gap_um, count(*) filter (where d=0) as overlap from near where d<=1.0 group by 1,2,3"""))
def surface_gap_join(spark, sf):
    labels, _ = unsplit_volume(spark, sf)
    return volume.surface_gap_pairs(labels, IMAGE, 1.0, PITCH).withColumn("gap_um", F.round("gap_um", 8))


# planar controls: distance 4 px, dilation 1 px (no plane at this pitch), window 6 px (2 planes)
SHARED = f"""{V_PROPS}, {OVERLAPS},
sg as (select p.image_id, p.id, p.z, p.y, p.x, c.z as cz, c.y as cy, c.x as cx from vpix p join vprops c using (image_id, channel, id) where p.channel='green'
 and abs(p.z-round_even(c.z,0))<=2 and abs(p.y-round_even(c.y,0))<=6 and abs(p.x-round_even(c.x,0))<=6),
spairs as (select distinct g.image_id, g.id as green_id, r.id as red_id, sqrt((g.cz-c.z)*(g.cz-c.z)*4::double+((g.cy-c.y)*(g.cy-c.y)+(g.cx-c.x)*(g.cx-c.x))*0.25::double) as distance
 from sg g join vpix r on r.image_id=g.image_id and r.channel='red' and r.z=g.z and abs(r.y-g.y)<=1 and abs(r.x-g.x)<=1 join vprops c on c.image_id=r.image_id and c.channel='red' and c.id=r.id
 where abs(r.z-round_even(g.cz,0))<=2 and abs(r.y-round_even(g.cy,0))<=6 and abs(r.x-round_even(g.cx,0))<=6
 and sqrt((g.cz-c.z)*(g.cz-c.z)*4::double+((g.cy-c.y)*(g.cy-c.y)+(g.cx-c.x)*(g.cx-c.x))*0.25::double)<=2.0::double+1e-10::double)"""


@query("match_3d_shared", duck("vox", body=f"""with recursive {SHARED}
select s.image_id, s.green_id, s.red_id, round(s.distance,8) as distance, coalesce(c.overlap,0) as overlap from spairs s left join common c using (image_id, green_id, red_id)"""))
def match_3d_shared(spark, sf):
    labels, props = unsplit_volume(spark, sf)
    return volume.shared_control_pairs(labels, props, IMAGE, 4, 1, 6, PITCH, STACK[0]).withColumn("distance", F.round("distance", 8))


GROUPS = f"""{SHARED},
gn as (select image_id, green_id as a, red_id+1099511627776 as b from spairs union all select image_id, red_id+1099511627776, green_id from spairs),
nodes as (select image_id, channel, id, case when channel='green' then id else id+1099511627776 end as node from vprops),
reach(image_id, node, r) as (select image_id, node, node from nodes union select e.image_id, e.node, g.b from reach e join gn g on g.image_id=e.image_id and g.a=e.r),
roots as (select image_id, node, min(r) as root from reach group by 1,2),
memb as (select n.image_id, n.channel, n.id, dense_rank() over (partition by n.image_id order by t.root) as object_id from nodes n join roots t using (image_id, node))"""


def grouped_volume(spark, sf):
    labels, props = unsplit_volume(spark, sf)
    labels = cut(labels)
    pairs = cut(volume.shared_control_pairs(labels, props, IMAGE, 4, 1, 6, PITCH, STACK[0]))
    members = volume.association_groups(props, pairs, IMAGE)
    return labels, props, cut(members)


@query("association_groups", duck("vox", body=f"with recursive {GROUPS} select * from memb"))
def association_groups(spark, sf):
    return grouped_volume(spark, sf)[2]


ROLLED = f"""{GROUPS},
roll as (select m.image_id, m.object_id, count(*) filter (where channel='green') as n_green, count(*) filter (where channel='red') as n_red,
 coalesce(string_agg(cast(id as varchar),';' order by id) filter (where channel='green'),'') as green_ids, coalesce(string_agg(cast(id as varchar),';' order by id) filter (where channel='red'),'') as red_ids,
 sum(z*voxels)/sum(voxels) as z, sum(y*voxels)/sum(voxels) as y, sum(x*voxels)/sum(voxels) as x, sum(voxels) as vox_, bool_or(touches_boundary) as touches_boundary
 from memb m join vprops p using (image_id, channel, id) group by 1,2),
ins as (select c.image_id, g.object_id, sum(overlap) as shared from common c join memb g on g.image_id=c.image_id and g.channel='green' and g.id=c.green_id join memb r on r.image_id=c.image_id and r.channel='red' and r.id=c.red_id and r.object_id=g.object_id group by 1,2),
gt as (select roll.*, coalesce(shared,0) as shared, case when n_red=0 then 'green_only' when n_green=0 then 'red_only' when n_green=1 and n_red=1 and coalesce(shared,0)>0 then 'dual_positive_candidate' else 'unresolved' end as status
 from roll left join ins using (image_id, object_id))"""


def group_table(spark, sf):
    labels, props, members = grouped_volume(spark, sf)
    return volume.group_table(members, props, volume.overlaps(labels, IMAGE), IMAGE, PITCH)


@query("group_status", duck("vox", body=f"with recursive {ROLLED} select image_id, object_id, status, n_green, n_red, n_green>0 and n_red>0 as review_required from gt"))
def group_status(spark, sf):
    return group_table(spark, sf).select("image_id", "object_id", "status", "n_green", "n_red", "review_required")


@query("group_rollup", duck("vox", body=f"""with recursive {ROLLED} select image_id, object_id, green_ids, red_ids, round(z,8) as z, round(y,8) as y, round(x,8) as x, round(z*2.0::double,8) as z_um, round(y*0.5::double,8) as y_um, round(x*0.5::double,8) as x_um,
cast((vox_-shared)*0.5 as double) as volume_um3, greatest(n_green,n_red) as candidate_count_min, n_green+n_red as candidate_count_max, touches_boundary from gt"""))
def group_rollup(spark, sf):
    table = group_table(spark, sf)
    return table.select(
        "image_id", "object_id", "green_ids", "red_ids", *[F.round(c, 8).alias(c) for c in ["z", "y", "x", "z_um", "y_um", "x_um"]],
        "volume_um3", "candidate_count_min", "candidate_count_max", "touches_boundary",
    )


@query("volume_counts", duck("vox", body=f"""with recursive {ROLLED} select image_id, {", ".join(f"count(*) filter (where status='{s}') as {s}" for s in volume.STATUSES)}, count(*) as total_groups,
cast(sum(n_green) as bigint) as green_objects, cast(sum(n_red) as bigint) as red_objects, cast(sum(greatest(n_green,n_red)) as bigint) as candidate_count_min, cast(sum(n_green+n_red) as bigint) as candidate_count_max,
count(*) filter (where touches_boundary) as boundary_groups from gt group by 1"""))
def volume_counts(spark, sf):
    return volume.volume_counts(group_table(spark, sf), IMAGE)
