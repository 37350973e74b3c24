"""Experiment tables derived from the star-schema parquet files.

Each recipe is one SQL text used by both engines: Spark runs it over the parquet
scans, and ``duck`` turns it into a CTE for the oracle (``div`` -> ``//`` and
``sha2(x,256)`` -> ``sha256(x)``). All recipes keep a field's raster bounded by its
frame, while the number of fields grows with the scale factor.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

RECIPES = {
    # sparse raster, 64x64, two channels
    "px": """
select l_suppkey div 10 as image_id, case when l_linestatus='F' then 'green' else 'red' end as channel,
       cast(l_partkey % 64 as int) as y, cast(l_orderkey % 64 as int) as x,
       cast(sum(l_quantity) as int) as value
from {lineitem} group by 1,2,3,4""",
    # sparse third channel on the same frame
    "blue": """
select l_suppkey div 10 as image_id, cast(l_partkey % 64 as int) as y, cast(l_orderkey % 64 as int) as x,
       cast(max(l_quantity) as int) as value
from {lineitem} group by 1,2,3""",
    # the declared planes: both channels of every field, a third one without any pixel, a field without red
    "planes": """
select distinct l_suppkey div 10 as image_id, case when l_linenumber % 2 = 0 then 'green' else 'red' end as channel from {lineitem}
union all select distinct l_suppkey div 10, 'far' from {lineitem} where (l_suppkey div 10) % 3 = 0
union all select -1, 'green' from {region} where r_regionkey = 0""",
    # volume, 7x32x32, two channels
    "vox": """
select l_suppkey div 10 as image_id, case when l_linestatus='F' then 'green' else 'red' end as channel,
       cast(l_linenumber-1 as int) as z, cast(l_partkey % 32 as int) as y, cast(l_orderkey % 32 as int) as x,
       cast(sum(l_quantity) as int) as value
from {lineitem} group by 1,2,3,4,5""",
    # detection centroids on a 1024x1024 frame
    "cent": """
select l_suppkey div 10 as image_id, case when l_linestatus='F' then 'green' else 'red' end as channel,
       l_orderkey*10+l_linenumber as id, l_extendedprice % 1024 as y,
       (cast(l_orderkey as double)*cast(7.25 as double)+l_partkey) % 1024 as x
from {lineitem}""",
    # one field, F99, has no objects
    "fields": """
select concat('F', cast(n_nationkey as varchar(10))) as image_id,
       concat('R', cast(n_regionkey as varchar(10))) as replicate_id,
       1024 as h, 1024 as w, cast(2.272724609375 as double) as dy, cast(2.272724609375 as double) as dx,
       n_nationkey % 5 <> 0 as ebfp_provided, n_nationkey as seq
from {nation}
union all select 'F99', 'R99', 1024, 1024, cast(2.272724609375 as double), cast(2.272724609375 as double), true, 99""",
    # classified objects with empirical p-values
    "obj": """
select concat('F', cast(n_nationkey as varchar(10))) as image_id,
       concat('R', cast(n_regionkey as varchar(10))) as replicate_id,
       o_orderkey as object_id,
       case o_orderstatus when 'F' then 'live_only' when 'O' then 'dead_only' else 'double_positive' end as status,
       n_nationkey % 5 <> 0 as provided, (n_nationkey % 5 <> 0 and o_orderkey % 11 <> 0) as scorable,
       case when n_nationkey % 5 <> 0 and o_orderkey % 11 <> 0 then
         cast(1 + (case when o_orderstatus='F' then (o_orderkey*37) % 20 else (o_orderkey*37) % 4000 end) as double)/4001
       end as p
from {orders} join {customer} on o_custkey=c_custkey join {nation} on c_nationkey=n_nationkey""",
    # association groups
    "grp": """
select o.o_orderkey as object_id, concat('F', cast(c_nationkey as varchar(10))) as image_id,
       cast(sum(case when l_linestatus='F' then 1 else 0 end) as bigint) as n_green,
       cast(sum(case when l_linestatus='O' then 1 else 0 end) as bigint) as n_red, min(o_orderpriority) as prio
from {lineitem} join {orders} o on l_orderkey=o.o_orderkey join {customer} on o_custkey=c_custkey group by 1,2""",
    # field manifest with planted faults
    "manifest": """
select case when c_custkey % 97 = 3 then concat('-f', cast(c_custkey as varchar(10)))
            when c_custkey % 50 = 2 then concat('f', cast(c_custkey-2 as varchar(10)))
            when c_custkey % 50 = 1 then concat('F', cast(c_custkey-1 as varchar(10)))
            else concat(case when c_custkey % 2=0 then 'F' else 'f' end, cast(c_custkey as varchar(10))) end as image_id,
       c_mktsegment as replicate_id, concat('img/', cast(c_custkey as varchar(10)), '_g.npy') as green,
       case when c_custkey % 83 = 5 then '' when c_custkey % 71 = 4 then concat('img/', cast(c_custkey as varchar(10)), '_g.npy')
            else concat('img/', cast(c_custkey as varchar(10)), '_r.npy') end as red,
       case when c_custkey % 3 = 0 then concat(' img/', cast(c_custkey as varchar(10)), '_b.npy ') else '  ' end as ebfp,
       c_custkey as seq
from {customer}""",
    # acquisition metadata, one row per image series
    "series": """
select p_partkey as series_id, p_name as name, 64*(p_size % 6) as size_x, 64 as size_y,
       1 + p_partkey % 3 as size_c, 1 + p_partkey % 9 as size_z, 1 + p_partkey % 2 as size_t,
       case when p_partkey % 13 = 0 then 3 else 1 end as size_s,
       case when p_partkey % 23 = 0 then 2 else 1 end as size_other,
       case when p_partkey % 17 = 0 then 4 else 1 end as n_tiles,
       p_partkey % 19 = 0 as is_flim,
       case when p_partkey % 7 = 0 then 'float32' when p_partkey % 2 = 1 then 'uint8' else 'uint16' end as dtype,
       case when p_partkey % 11 = 0 then 2 + p_partkey % 3 else 1 + p_partkey % 3 end as n_channel_elements,
       p_partkey % 29 = 0 as bit_packed,
       cast(case when p_partkey % 31 = 0 then 20 when p_partkey % 37 = 0 then 12
            when p_partkey % 2 = 1 then 8 else 16 end as int) as bits,
       cast(p_retailprice as double) / 1e6 as origin, cast(p_size as double) * (case when p_partkey % 2 = 0 then 1 else -1 end) / 1e3 as length,
       case p_partkey % 5 when 0 then 'm' when 1 then 'mm' when 2 then 'um' when 3 then 'nm' else 'inch' end as unit
from {part}""",
    "recorded": """
select doc_id, sha2(text,256) as sha, n_chars as bytes from {documents} where doc_id % 41 <> 2""",
    "current": """
select doc_id, sha2(case when doc_id % 37 = 5 then concat(text,'!') else text end,256) as sha, n_chars as bytes
from {documents} where doc_id % 43 <> 1""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def recipe(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = RECIPES[name]
    used = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in sorted(used)})


def duck(*names: str, body: str) -> str:
    """Prefix ``body`` (``with [recursive] ctes select ...`` or a plain select) with the recipes as CTEs."""
    parts = []
    for name in names:
        text = re.sub(r"\{(\w+)\}", r"\1", RECIPES[name])
        text = text.replace(" div ", "//")
        text = re.sub(r"sha2\((.*),256\)", r"sha256(\1)", text)
        parts.append(f"{name} as ({text})")
    head = re.match(r"\s*with\s+(recursive\s+)?", body, re.IGNORECASE)
    prefix = "with recursive " if head and head.group(1) else "with "
    rest = ",\n" + body[head.end() :] if head else "\n" + body
    return prefix + ",\n".join(parts) + rest
