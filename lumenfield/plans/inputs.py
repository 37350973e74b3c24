"""Manifests, catalogs, audits, sinks and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenfield.functions import scalars
from lumenfield.operators import ranks
from lumenfield.plans.objects import CALLED, called
from lumenfield.plans.registry import query
from lumenfield.session import work_path
from lumenfield.sources import arrays, audits, catalog, manifest
from lumenfield.sources.recipes import duck, recipe, table


@query("manifest_scan", duck("manifest", body="""select trim(image_id) as image_id, trim(replicate_id) as replicate_id,
nullif(trim(green),'') as green, nullif(trim(red),'') as red, nullif(trim(ebfp),'') as ebfp from manifest"""))
def manifest_scan(spark, sf):
    folder = work_path(spark, "manifest")
    rows = recipe(spark, sf, "manifest")
    rows.drop("seq").write.option("header", True).csv(folder)
    scanned = manifest.scan_manifest(spark, folder)
    # compare relative paths: the folder's name is new for each run
    local = {c: F.expr(f"substring({c}, length(folder) + 2)") for c in manifest.CHANNELS}
    return scanned.withColumns(local).select("image_id", "replicate_id", *manifest.CHANNELS)


@query("manifest_violations", duck("manifest", body="""with
m as (select seq, trim(image_id) as image_id, trim(replicate_id) as replicate_id, nullif(trim(green),'') as green,
 case when seq%59=6 then concat('img/./sub/../', substr(green, 5)) else nullif(trim(red),'') end as red, nullif(trim(ebfp),'') as ebfp from manifest),
spelled as (select seq, 1 as c, image_id, green as path from m where green is not null union all select seq, 2, image_id, red from m where red is not null union all select seq, 3, image_id, ebfp from m where ebfp is not null),
files as (select seq, c, image_id, replace(path, './sub/../', '') as path from spelled)
select image_id, 'missing_file' as rule, path as detail from files where path not in (select path from files where c>1 or seq%61<>7)
union all select image_id, 'invalid_image_id' as rule, image_id as detail from m where not regexp_full_match(image_id, '[A-Za-z0-9][A-Za-z0-9_.-]*')
union all select image_id, 'invalid_replicate_id', replicate_id from m where not regexp_full_match(replicate_id, '[A-Za-z0-9][A-Za-z0-9_.-]*')
union all select image_id, 'unsafe_filename', image_id from m where regexp_full_match(image_id, '[A-Za-z0-9][A-Za-z0-9_.-]*')
  and (image_id like '%.' or regexp_full_match(upper(split_part(image_id,'.',1)), 'CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9]'))
union all select image_id, 'missing_channel', 'green' from m where green is null
union all select image_id, 'missing_channel', 'red' from m where red is null
union all select image_id, 'duplicate_image_id', cast(count(*) as varchar) from m group by image_id having count(*)>1
union all select min(image_id), 'duplicate_field_id', cast(count(*) as varchar) from m group by lower(image_id) having count(*)>1
union all select min(image_id), 'reused_path', path from files group by path having count(*)>1"""))
def manifest_violations(spark, sf):
    """Every rule, with one file spelled in two ways and some files that do not exist."""
    rows = recipe(spark, sf, "manifest")
    rows = rows.withColumn("red", F.when(F.col("seq") % 59 == 6, F.concat(F.lit("img/./sub/../"), F.expr("substr(green, 5)"))).otherwise(F.col("red")))
    there = rows.withColumn("green", F.when(F.col("seq") % 61 != 7, F.col("green")))
    files = manifest.channel_paths(manifest.trimmed(there)).select(F.concat(F.lit("./"), "path").alias("path"))
    return manifest.violations(rows, files)


def plane_files(spark, sf):
    """A folder with an array file for each declared plane, empty ones too."""
    folder = work_path(spark, "planes")
    written = arrays.write_planes(recipe(spark, sf, "px"), recipe(spark, sf, "planes"), (64, 64), folder)
    audits.write_table(written, f"{folder}-list")
    return folder


def tail(path):
    return F.regexp_extract(path, "([^/]*/[^/]*)$", 1).alias("path")


@query("npy_scan", duck("px", body="""select image_id||'/'||channel||'.npy' as path, case when max(value) over (partition by image_id, channel)<256 then 'uint8' else 'uint16' end as dtype, 0 as z, y, x, value from px"""))
def npy_scan(spark, sf):
    """Planes written as array files, read back by ranges of rows."""
    return arrays.scan_arrays(spark, plane_files(spark, sf), 1 << 10).select(tail("path"), "dtype", "z", "y", "x", "value")


@query("npy_headers", duck("px", "planes", body="""select image_id||'/'||channel||'.npy' as path, case when coalesce(max(value),0)<256 then 'uint8' else 'uint16' end as dtype, 64::bigint as h, 64::bigint as w
from (select distinct image_id, channel from planes) left join px using (image_id, channel) group by image_id, channel"""))
def npy_headers(spark, sf):
    """Type and shape of every array file, those without a non-zero pixel too."""
    kind = F.when(F.substring("dtype", 3, 1) == "1", "uint8").otherwise("uint16").alias("dtype")
    return arrays.array_headers(spark, plane_files(spark, sf)).select(tail("path"), kind, F.col("shape")[0].alias("h"), F.col("shape")[1].alias("w"))


@query("series_catalog", duck("series", body="""with v as (select *, case
when is_flim then 'lifetime_data' when size_x<1 or size_y<1 then 'no_xy_plane' when size_s>1 then 'sample_composite'
when size_other>1 then 'unusual_dimension' when n_tiles>1 then 'unstitched_tiles'
when dtype not in ('uint8','uint16') then 'pixel_type' when bit_packed then 'bit_packed'
when n_channel_elements<>size_c then 'channel_layout' when bits not between 1 and 16 then 'channel_depth'
when (bits<=8) <> (dtype='uint8') then 'mixed_channel_types' end as reason from series)
select series_id, name, size_x, size_y, size_z, size_c, size_t, dtype,
case when bits between 1 and 16 then cast((1<<bits)-1 as integer) end as detector_max, reason is null as supported, reason from v"""))
def series_catalog(spark, sf):
    return catalog.series_catalog(recipe(spark, sf, "series"))


@query("z_calibration", duck("series", body="""with u as (select *, case unit when 'm' then 1e6::double when 'mm' then 1e3::double when 'um' then 1::double when 'nm' then 1e-3::double end as f from series),
c as (select series_id, size_z, origin*f as o, length*f as l, case when size_z>1 then abs(length*f)/(size_z-1) end as s, f from u),
k as (select *, f is not null and (size_z=1 or s>0) as known from c),
p as (select series_id, unnest(range(size_z)) as position from k where known)
select k.series_id, k.size_z, round(case when known then s end, 6) as z_spacing_um, p.position,
round(case when k.size_z=1 then o else o + l*p.position/(k.size_z-1) end, 6)+0.0::double as z_um from k left join p using (series_id)"""))
def z_calibration(spark, sf):
    calibrated = catalog.z_calibration(recipe(spark, sf, "series"))
    exploded = calibrated.select("series_id", "size_z", "z_spacing_um", F.posexplode_outer("z_positions_um").alias("position", "z_um"))
    return exploded.select(
        "series_id", "size_z", F.round("z_spacing_um", 6).alias("z_spacing_um"),
        F.when(F.col("z_um").isNotNull(), F.col("position")).cast("bigint").alias("position"), (F.round("z_um", 6) + F.lit(0.0)).alias("z_um"),
    )


REQUESTS = """select distinct s_suppkey {div} 10 as image_id, cast((s_suppkey {div} 10) % 2 as int) as green_channel,
cast(1 - (s_suppkey {div} 10) % 2 as int) as red_channel, cast((s_suppkey {div} 10) % 3 as int) as z_start,
cast(case when (s_suppkey {div} 10) % 7 = 6 then 9 else (s_suppkey {div} 10) % 3 + 2 + (s_suppkey {div} 10) % 2 end as int) as z_stop,
0 as time_index from {supplier}"""


@query("plane_select", duck("vox", body="with q as (" + REQUESTS.format(div="//", supplier="supplier") + """)
select v.image_id, case when (channel='green') = (green_channel=0) then 'green' else 'red' end as role, z, y, x, value
from vox v join q using (image_id) where z_stop<=7 and z>=z_start and z<z_stop"""))
def plane_select(spark, sf):
    requests = spark.sql(REQUESTS.format(div="div", supplier="{supplier}"), supplier=table(spark, sf, "supplier"))
    checked = catalog.check_selection(requests, depth=7, n_channels=2, times=1)
    voxels = recipe(spark, sf, "vox").withColumn("channel_index", F.when(F.col("channel") == "green", 0).otherwise(1))
    return catalog.select_planes(voxels.drop("channel"), checked).select("image_id", "role", "z", "y", "x", "value")


@query("role_recovery", duck("manifest", body="""with
m as (select cast(seq as varchar) as image_id, green, red, seq from manifest),
paths as (select image_id, 'green' as role, green as path from m union all select image_id, 'red', red from m where red<>''),
ex as (select image_id, 'green' as original_role, 0 as channel_index, 'img/'||image_id||'_g.npy' as path from m
 union all select image_id, case when seq%10=0 then 'ebfp' else 'red' end, 1, 'img/'||image_id||case when seq%29=0 then '_g.npy' else '_r.npy' end from m),
j as (select p.image_id, p.role, count(e.original_role) as n, min(e.original_role) as o, min(e.channel_index) as c from paths p left join ex e on e.image_id=p.image_id and e.path=p.path group by 1,2)
select image_id, role, n as n_matches, case when n=1 then o end as original_role, case when n=1 then c end as channel_index,
case when n=1 then 'ok' when n=0 then 'not_recorded' else 'ambiguous' end as verdict from j"""))
def role_recovery(spark, sf):
    rows = recipe(spark, sf, "manifest").withColumn("image_id", F.col("seq").cast("string"))
    paths = rows.unpivot("image_id", ["green", "red"], "role", "path").filter("path <> ''")
    names = F.array(
        F.struct(F.lit("green").alias("original_role"), F.lit(0).alias("channel_index"), F.lit("_g.npy").alias("tail")),
        F.struct(F.when(F.col("seq") % 10 == 0, "ebfp").otherwise("red").alias("original_role"), F.lit(1).alias("channel_index"),
                 F.when(F.col("seq") % 29 == 0, "_g.npy").otherwise("_r.npy").alias("tail")),
    )
    exports = rows.select("image_id", F.explode(names).alias("e")).select(
        "image_id", "e.original_role", "e.channel_index", F.concat(F.lit("img/"), "image_id", "e.tail").alias("path")
    )
    return manifest.recover_roles(paths, exports)


@query("import_discovery", duck("manifest", body="""with
p as (select image_id, 'green' as channel, trim(green) as path, seq from manifest union all select image_id, 'red', trim(red), seq from manifest where trim(red)<>''
 union all select image_id, 'ebfp', trim(ebfp), seq from manifest where trim(ebfp)<>''),
f as (select distinct path from p),
ex as (select path, length(path) as bytes, sha256(path) as sha from f where cast(regexp_extract(path,'([0-9]+)',1) as bigint)%5<>0),
now as (select path, length(path)+case when cast(regexp_extract(path,'([0-9]+)',1) as bigint)%31=0 then 1 else 0 end as bytes,
 sha256(path||case when cast(regexp_extract(path,'([0-9]+)',1) as bigint)%19=0 then '!' else '' end) as sha from f where cast(regexp_extract(path,'([0-9]+)',1) as bigint)%37<>0)
select p.image_id, p.channel, p.path, case when e.sha is null then 'unknown_import' when n.sha is null then 'missing_file'
when e.bytes<>n.bytes or e.sha<>n.sha then 'changed' else 'verified' end as state
from p left join ex e using (path) left join now n using (path)"""))
def import_discovery(spark, sf):
    rows = recipe(spark, sf, "manifest")
    files = manifest.channel_paths(manifest.trimmed(rows)).select("path").distinct()
    files = files.withColumn("k", F.regexp_extract("path", "([0-9]+)", 1).cast("bigint"))
    exports = files.filter("k % 5 <> 0").select("path", F.length("path").alias("bytes"), F.sha2("path", 256).alias("sha"))
    current = files.filter("k % 37 <> 0").select(
        "path",
        (F.length("path") + F.when(F.col("k") % 31 == 0, 1).otherwise(0)).alias("bytes"),
        F.sha2(F.concat("path", F.when(F.col("k") % 19 == 0, "!").otherwise("")), 256).alias("sha"),
    )
    return manifest.discover_imports(rows, exports, current)


@query("calibration_compat", """with f as (select s_suppkey as seq, s_nationkey as batch, 64 + case when s_suppkey%17=0 then 1 else 0 end as h, 64 as w,
case when s_suppkey%13=0 then 'uint16' else 'uint8' end as dtype, 2.25::double*(1 + case s_suppkey%7 when 3 then 1e-9::double when 4 then 1e-7::double else 0 end) as dy, 2.25::double as dx from supplier),
o as (select *, first(h) over w0 as h0, first(dtype) over w0 as t0, first(dy) over w0 as dy0, first(dx) over w0 as dx0 from f window w0 as (partition by batch order by seq))
select batch, seq, h=h0 and dtype=t0 and abs(dy-dy0)<=greatest(1e-8::double*greatest(dy,dy0),1e-12::double) and abs(dx-dx0)<=greatest(1e-8::double*greatest(dx,dx0),1e-12::double) as compatible from o""")
def calibration_compat(spark, sf):
    key = F.col("s_suppkey")
    fields = table(spark, sf, "supplier").select(
        key.alias("seq"), F.col("s_nationkey").alias("batch"),
        (64 + F.when(key % 17 == 0, 1).otherwise(0)).alias("h"), F.lit(64).alias("w"),
        F.when(key % 13 == 0, "uint16").otherwise("uint8").alias("dtype"),
        (2.25 * (1 + F.when(key % 7 == 3, 1e-9).when(key % 7 == 4, 1e-7).otherwise(0.0))).alias("dy"), F.lit(2.25).alias("dx"),
    )
    return manifest.calibration_compat(fields, "batch", "seq").select("batch", "seq", "compatible")


@query("assign_unique_ids", """with c as (select c_custkey as seq, concat(case when c_custkey%2=0 then 'F' else 'f' end, cast(c_custkey%100 as varchar)) as image_id from customer),
r as (select *, row_number() over (partition by lower(image_id) order by seq) as k from c)
select seq, image_id, case when k=1 then image_id else concat(image_id,'_',cast(k as varchar)) end as unique_id from r""")
def assign_unique_ids(spark, sf):
    key = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(
        key.alias("seq"), F.concat(F.when(key % 2 == 0, "F").otherwise("f"), (key % 100).cast("string")).alias("image_id")
    )
    return manifest.assign_unique_ids(rows, "image_id", "seq")


@query("content_digest", "select doc_id, sha256(text) as sha256, octet_length(encode(text)) as bytes from documents")
def content_digest(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("bytes")
    )


@query("verify_digests", duck("recorded", "current", body="""with
r as (select * from recorded union all select doc_id, concat(sha,'x'), bytes from recorded where doc_id%29=4),
c as (select * from current union all select * from current where doc_id%31=6),
rn as (select doc_id, count(*) as n, min(sha) as sha from r group by 1), cn as (select doc_id, count(*) as n, min(sha) as sha from c group by 1)
select coalesce(r.doc_id,c.doc_id) as doc_id,
case when coalesce(r.n,0)>1 or coalesce(c.n,0)>1 then 'duplicate_key' when c.doc_id is null then 'missing' when r.doc_id is null then 'unexpected' when r.sha=c.sha then 'ok' else 'changed' end as status
from rn r full join cn c on r.doc_id=c.doc_id"""))
def verify_digests(spark, sf):
    recorded, current = recipe(spark, sf, "recorded"), recipe(spark, sf, "current")
    recorded = recorded.unionByName(recorded.filter("doc_id % 29 = 4").withColumn("sha", F.concat("sha", F.lit("x"))))
    return audits.verify_digests(recorded, current.unionByName(current.filter("doc_id % 31 = 6")), "doc_id")


@query("golden_diff", """with o as (select o_orderkey as k, o_totalprice as total, o_orderstatus as status, o_orderpriority as prio from orders),
a as (select * from o where k%101<>7 union all select * from o where k%101<>7 and k%89=3),
g as (select k, case when k%53=1 then total*(1+1e-9::double) when k%59=1 then total*(1+1e-14::double) when k%61=1 then null else total end as total,
 case when k%67=2 then 'X' else status end as status, prio from o where k%103<>9),
b as (select * from g union all select * from g where k%97=5),
an as (select k, count(*) as n, min(total) as total, min(status) as status from a group by 1), bn as (select k, count(*) as n, min(total) as total, min(status) as status from b group by 1),
j as (select coalesce(a.k,b.k) as k, coalesce(a.n,0) as na, coalesce(b.n,0) as nb, a.total as ta, b.total as tb, a.status as sa, b.status as sb from an a full join bn b on a.k=b.k)
select k, 'duplicate_key' as difference from j where na>1 or nb>1 union all select k, 'row_missing' from j where na=0 and nb=1 union all select k, 'row_unexpected' from j where nb=0 and na=1
union all select k, 'total' from j where na=1 and nb=1 and not coalesce(abs(ta-tb)<=1e-12::double+1e-12::double*abs(tb), ta is null and tb is null)
union all select k, 'status' from j where na=1 and nb=1 and sa is distinct from sb""")
def golden_diff(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("total"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("prio"),
    )
    k = F.col("k")
    golden = orders.filter("k % 103 <> 9").withColumn(
        "total",
        F.when(k % 53 == 1, F.col("total") * (1 + F.lit(1e-9))).when(k % 59 == 1, F.col("total") * (1 + F.lit(1e-14)))
        .when(k % 61 == 1, F.lit(None)).otherwise(F.col("total")),
    ).withColumn("status", F.when(k % 67 == 2, "X").otherwise(F.col("status")))
    actual = orders.filter("k % 101 <> 7")
    return audits.golden_diff(actual.unionByName(actual.filter("k % 89 = 3")), golden.unionByName(golden.filter("k % 97 = 5")), ["k"], ["total"], ["status", "prio"])


@query("incremental_todo", """with r as (select event_id, user_id, event_type, sha256(concat_ws(':',cast(user_id as varchar),event_type)) as fingerprint from events),
done as (select distinct fingerprint from r where event_id%9=0) select event_id, user_id, event_type, fingerprint from r where fingerprint not in (select fingerprint from done)""")
def incremental_todo(spark, sf):
    requests = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    finished = requests.filter("event_id % 9 = 0").select(
        scalars.fingerprint(F.col("user_id"), F.col("event_type")).alias("fingerprint")
    ).distinct()
    todo = audits.incremental_todo(requests, finished, ["user_id", "event_type"])
    return todo.select("event_id", "user_id", "event_type", "fingerprint")


@query("sink_roundtrip", duck("obj", body="""with g as (select image_id, count(*) as n, cast(sum(object_id) as bigint) as id_sum, count(p) as n_p, round(max(p),12) as max_p from obj group by 1)
select f.format, g.* from g, (select unnest(['csv','json','parquet']) as format) f"""))
def sink_roundtrip(spark, sf):
    objects = recipe(spark, sf, "obj")
    back = None
    for fmt in ("parquet", "csv", "json"):
        folder = work_path(spark, f"objects-{fmt}")
        audits.write_table(objects, folder, fmt, partition=["image_id"])
        read = audits.read_table(spark, folder, fmt, objects.schema)
        counted = read.groupBy("image_id").agg(
            F.count("*").alias("n"), F.sum("object_id").alias("id_sum"), F.count("p").alias("n_p"), F.round(F.max("p"), 12).alias("max_p")
        ).select(F.lit(fmt).alias("format"), "*")
        back = counted if back is None else back.unionByName(counted)
    return back


@query("sorted_sink", duck("obj", body="select image_id, object_id, status, p, row_number() over (order by image_id, object_id) as position from obj"))
def sorted_sink(spark, sf):
    """Objects saved in the order of (field, object) and read back with their place in the files."""
    folder = work_path(spark, "sorted")
    audits.write_table(recipe(spark, sf, "obj").select("image_id", "object_id", "status", "p"), folder, order=["image_id", "object_id"])
    return audits.with_positions(spark, folder)


@query("summary_audit", duck("obj", body="""with s as (select image_id, count(*) filter (where status='live_only') as l, count(*) filter (where status='dead_only') as d,
count(*) filter (where status='double_positive') as b, count(*) as t from obj group by 1),
x as (select case when t%5=0 then '' else image_id end as image_id, l, case when t%3=0 then -d else d end as d, b, t + case when t%4=1 then 1 else 0 end as t from s)
select image_id, 'negative_count' as rule from x where least(l,d,b,t)<0 union all select image_id, 'sum_differs' from x where l+d+b<>t
union all select image_id, 'missing_identifier' from x where image_id=''"""))
def summary_audit(spark, sf):
    saved = recipe(spark, sf, "obj").groupBy("image_id").agg(
        *[scalars.total(F.col("status") == s).alias(s) for s in ("live_only", "dead_only", "double_positive")], F.count("*").alias("n")
    )
    n = F.col("n")
    planted = saved.select(
        F.when(n % 5 == 0, "").otherwise(F.col("image_id")).alias("image_id"), "live_only",
        F.when(n % 3 == 0, -F.col("dead_only")).otherwise(F.col("dead_only")).alias("dead_only"), "double_positive",
        (n + F.when(n % 4 == 1, 1).otherwise(0)).alias("total"),
    )
    return audits.summary_audit(planted, ["image_id"])


PARAMETERS = """select p_partkey as param_id, cast(p_partkey % 40 as int) as low, cast(10 + p_size as int) as high, 255 as dtype_max,
cast(p_partkey % 7 as double) / 2 as sigma_px, cast(p_partkey % 30 as int) as min_area_px, cast(p_partkey % 13 as double) as background_sigma_px,
cast(p_partkey % 9 as int) as peak_window_px, cast(p_partkey % 6 as double) as min_peak_distance_px, cast(p_partkey % 8 as double) as max_distance_px,
cast(p_partkey % 3 as int) as dilation_px, cast(p_size % 12 as double) as overlap_window_radius_px, cast(p_size as double) / 40 as q_threshold,
cast(p_partkey % 20 as int) as null_inner_px, cast(p_size as int) as null_outer_px, cast(p_partkey % 200 as int) as min_null_locations,
cast(p_partkey % 50 as int) as display_low, cast(p_size as int) as display_high, cast(p_size as double) / 45 as central_crop_fraction,
case when p_partkey % 5 = 0 then 'raw_intensity' else 'projection_config' end as mode, cast(p_partkey % 2 as double) as background_sigma_um from {part}"""


@query("param_violations", "with p as (" + PARAMETERS.format(part="part") + """)
select param_id, 'thresholds' as rule from p where not (low>0 and low<=high and high<=dtype_max)
union all select param_id, 'sigma' from p where not sigma_px>0 union all select param_id, 'min_area' from p where not min_area_px>=1
union all select param_id, 'background_sigma' from p where not background_sigma_px>0
union all select param_id, 'peak_window' from p where peak_window_px<3 or peak_window_px%2=0
union all select param_id, 'peak_distance' from p where min_peak_distance_px<1 union all select param_id, 'match_distance' from p where max_distance_px<=0
union all select param_id, 'match_dilation' from p where dilation_px not in (0,1)
union all select param_id, 'match_window' from p where overlap_window_radius_px < max_distance_px+dilation_px
union all select param_id, 'q_threshold' from p where not (q_threshold>0 and q_threshold<1)
union all select param_id, 'null_annulus' from p where not (null_inner_px>0 and null_inner_px<null_outer_px)
union all select param_id, 'null_locations' from p where min_null_locations<1 union all select param_id, 'display_bounds' from p where display_high<=display_low
union all select param_id, 'central_crop' from p where not (central_crop_fraction>0 and central_crop_fraction<=1)
union all select param_id, 'raw_mode_background' from p where mode='raw_intensity' and background_sigma_um<>0""")
def param_violations(spark, sf):
    parameters = spark.sql(PARAMETERS, part=table(spark, sf, "part"))
    return catalog.parameter_violations(parameters)


@query("annotated_export", duck("obj", body=f"""with {CALLED}, rev as (select cast(user_id%25 as varchar) as nk, max(event_id) as revision from events group by 1)
select c.image_id, count(*) filter (where c.status='live_only') as live_only, count(*) as total,
coalesce(cast(max(rev.revision) as varchar),'provisional') as review_revision, 'pairs are scenarios, not a confidence interval' as assumptions
from called c left join rev on c.image_id='F'||rev.nk group by 1"""))
def annotated_export(spark, sf):
    """A summary with its review revision and assumptions; extra columns are dropped by the fixed list."""
    summary = called(spark, sf).groupBy("image_id").agg(
        scalars.total(F.col("status") == "live_only").alias("live_only"), F.count("*").alias("total"), F.max("p").alias("unused")
    )
    latest = table(spark, sf, "events").groupBy(F.concat(F.lit("F"), (F.col("user_id") % 25).cast("string")).alias("image_id")).agg(
        F.max("event_id").alias("revision")
    )
    joined = summary.join(latest, "image_id", "left")
    return joined.select(
        "image_id", "live_only", "total",
        F.coalesce(F.col("revision").cast("string"), F.lit("provisional")).alias("review_revision"),
        F.lit("pairs are scenarios, not a confidence interval").alias("assumptions"),
    )


@query("sanitize_stem", """with t as (select page_id, url, trim(regexp_replace(url,'[^A-Za-z0-9_.-]+','_','g'),'_.-') as s from pages),
u as (select page_id, case when s='' then 'image' else s end as s from t)
select page_id, case when regexp_full_match(upper(split_part(s,'.',1)),'CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9]') then 'image_'||s else s end as stem from u""")
def sanitize_stem(spark, sf):
    return table(spark, sf, "pages").select("page_id", scalars.sanitize_stem(F.col("url")).alias("stem"))


@query("json_props", "select event_id, cast(json_extract(props,'$.k') as integer) as k, props as text from events")
def json_props(spark, sf):
    parsed = F.from_json("props", "k int")
    rebuilt = F.regexp_replace(F.to_json(F.struct(parsed["k"].alias("k"))), ":", ": ")
    return table(spark, sf, "events").select("event_id", parsed["k"].alias("k"), rebuilt.alias("text"))


@query("id_list_roundtrip", """with t as (select l_orderkey, l_linenumber, concat_ws(';',cast(l_partkey as varchar),cast(l_suppkey as varchar),cast(l_orderkey as varchar)) as text from lineitem),
a as (select l_orderkey, l_linenumber, list_sort([cast(v as bigint) for v in string_split(text,';')]) as ids from t)
select l_orderkey, l_linenumber, array_to_string(ids,';') as ids, len(ids) as n, ids[-1] as last_id from a""")
def id_list_roundtrip(spark, sf):
    """Member lists as text and back: split, cast, sorted and joined again."""
    text = F.concat_ws(";", "l_partkey", "l_suppkey", "l_orderkey")
    ids = scalars.parse_ids(text)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", scalars.join_ids(ids).alias("ids"), F.size(ids).cast("bigint").alias("n"), F.element_at(ids, -1).alias("last_id")
    )


@query("dense_relabel", """with s as (select o_custkey as label, min(o_orderkey) as first_seen, count(*) as n from orders group by 1)
select label, n, row_number() over (order by first_seen) as dense_id from s""")
def dense_relabel(spark, sf):
    """Dense ids in first-seen order, numbered range by range."""
    first = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("label")).agg(
        F.min("o_orderkey").alias("first_seen"), F.count("*").alias("n")
    )
    dense = ranks.numbered(first, [], [F.col("first_seen")], "dense_id")
    return dense.select("label", "n", "dense_id")


@query("row_runs", duck("px", body="""with m as (select image_id, channel, y, x, value, x - row_number() over (partition by image_id, channel, y order by x) as island from px where value>=20)
select image_id, channel, y, min(x) as x_start, max(x) as x_stop, count(*) as n, max(value) as peak from m group by image_id, channel, y, island"""))
def row_runs(spark, sf):
    """Horizontal runs of mask pixels (gaps and islands within one raster row)."""
    line = Window.partitionBy("image_id", "channel", "y").orderBy("x")
    mask = recipe(spark, sf, "px").filter("value >= 20").withColumn("island", F.col("x") - F.row_number().over(line))
    return mask.groupBy("image_id", "channel", "y", "island").agg(
        F.min("x").alias("x_start"), F.max("x").alias("x_stop"), F.count("*").alias("n"), F.max("value").alias("peak")
    ).drop("island")


@query("latest_revision", """select user_id%25 as image_id, event_id%40 as object_id, max(event_id) as revision, arg_max(event_type, event_id) as decision,
strftime(arg_max(ts, event_id),'%Y%m%dT%H%M%S') as created from events where event_type in ('view','click','error','purchase','signup') group by 1,2""")
def latest_revision(spark, sf):
    """Latest decision per object as one partial aggregation; the last revision wins."""
    feed = table(spark, sf, "events").select(
        (F.col("user_id") % 25).alias("image_id"), (F.col("event_id") % 40).alias("object_id"),
        F.col("event_id").alias("revision"), "event_type", "ts",
    )
    latest = feed.groupBy("image_id", "object_id").agg(
        F.max_by(F.struct("revision", "event_type", "ts"), "revision").alias("last")
    )
    return latest.select(
        "image_id", "object_id", "last.revision", F.col("last.event_type").alias("decision"),
        F.date_format("last.ts", "yyyyMMdd'T'HHmmss").alias("created"),
    )
