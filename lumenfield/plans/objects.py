"""Object-level tables: false-discovery control, roll-ups, sweeps, ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfield.functions.scalars import percent, total, yes
from lumenfield.operators import enrichment, ranks, rollups
from lumenfield.plans.registry import query
from lumenfield.sources.recipes import duck, recipe, table

# The oracle's own wording of the run-wide adjustment.
CALLED = """
d as (select p, count(*) as c from obj where p is not null group by p),
r as (select p, sum(c) over (order by p) as rk, sum(c) over () as n from d),
qv as (select p, least(1.0::double, min((p*n)/rk) over (order by p rows between current row and unbounded following)) as q from r),
called as (select o.*, qv.q, case when o.scorable then qv.q <= 0.05 end as detected from obj o left join qv on o.p = qv.p)
"""

SUMMARY = """
count(object_id) as total,
count(*) filter (where status='live_only') as live_only,
count(*) filter (where status='dead_only') as dead_only,
count(*) filter (where status='double_positive') as double_positive,
count(*) filter (where detected and scorable and provided) as ebfp_all_count,
count(*) filter (where scorable and provided) as ebfp_all_scorable,
count(object_id) - count(*) filter (where scorable and provided) as ebfp_all_unscorable,
count(*) filter (where detected and scorable and provided and status='live_only') as ebfp_live_count,
count(*) filter (where scorable and provided and status='live_only') as ebfp_live_scorable,
count(*) filter (where status='live_only') - count(*) filter (where scorable and provided and status='live_only') as ebfp_live_unscorable,
count(*) filter (where detected and scorable and provided and status<>'live_only') as ebfp_dead_count,
count(*) filter (where object_id is not null and not provided) as ebfp_channel_not_provided,
count(*) filter (where not provided and status='live_only') as ebfp_live_channel_not_provided,
100::double*count(*) filter (where status='live_only')/nullif(count(object_id),0) as viability_percent,
100::double*count(*) filter (where detected and scorable and provided)/nullif(count(*) filter (where scorable and provided),0) as ebfp_all_percent,
100::double*count(*) filter (where detected and scorable and provided and status='live_only')/nullif(count(*) filter (where scorable and provided and status='live_only'),0) as ebfp_live_percent,
100::double*count(*) filter (where status='double_positive')/nullif(count(object_id),0) as double_positive_percent,
100::double*count(*) filter (where status='live_only')/nullif(count(*) filter (where status in ('live_only','dead_only')),0) as viability_excluding_double_percent,
100::double*count(*) filter (where status in ('live_only','double_positive'))/nullif(count(object_id),0) as green_any_percent,
100::double*count(*) filter (where detected and scorable and provided and status<>'live_only')/nullif(count(*) filter (where scorable and provided and status<>'live_only'),0) as ebfp_dead_percent
"""

Q_THRESHOLDS = [0.01, 0.025, 0.05, 0.1]
P_THRESHOLDS = [0.001, 0.005, 0.01, 0.025, 0.05]


def called(spark, sf):
    return enrichment.classify(recipe(spark, sf, "obj"), sample=None)


@query("bh_pooled", duck("obj", body=f"with {CALLED} select image_id, object_id, p, q, detected from called"))
def bh_pooled(spark, sf):
    return called(spark, sf).select("image_id", "object_id", "p", "q", "detected")


@query("bh_by_group", duck("obj", body="""with
d as (select image_id, p, count(*) as c from obj where p is not null group by 1,2),
r as (select image_id, p, sum(c) over (partition by image_id order by p) as rk, sum(c) over (partition by image_id) as n from d),
qv as (select image_id, p, least(1.0::double, min((p*n)/rk) over (partition by image_id order by p rows between current row and unbounded following)) as q_sample from r)
select o.image_id, o.object_id, o.p, qv.q_sample from obj o left join qv on o.p=qv.p and o.image_id=qv.image_id"""))
def bh_by_group(spark, sf):
    adjusted = enrichment.adjust(recipe(spark, sf, "obj"), "p", ["image_id"], "q_sample")
    return adjusted.select("image_id", "object_id", "p", "q_sample")


@query("count_summary", duck("obj", body=f"with {CALLED} select image_id, {SUMMARY} from called group by image_id"))
def count_summary(spark, sf):
    return rollups.count_summary(called(spark, sf), ["image_id"])


@query("field_summary", duck("fields", "obj", body=f"""with {CALLED},
s as (select image_id, {SUMMARY} from called group by image_id)
select f.image_id, f.replicate_id, f.ebfp_provided,
{", ".join(f"coalesce(s.{c},0) as {c}" for c in rollups.COUNTS if c != "ebfp_dead_scorable")},
s.viability_percent, s.ebfp_all_percent, s.ebfp_live_percent, s.double_positive_percent,
s.viability_excluding_double_percent, s.green_any_percent, s.ebfp_dead_percent,
coalesce(s.total,0)/(f.h*f.w*f.dy*f.dx/1e6::double) as detected_objects_per_mm2
from fields f left join s using (image_id)"""))
def field_summary(spark, sf):
    return rollups.field_summary(recipe(spark, sf, "fields"), called(spark, sf))


REPLICATES = f"""
fo as (select f.replicate_id as rep, c.object_id, c.status, c.provided, c.scorable, c.detected from fields f left join called c on c.image_id=f.image_id),
nf as (select replicate_id, count(*) as n_fields, count(*) filter (where ebfp_provided) as n_fields_with_ebfp from fields group by 1),
rs as (select nf.replicate_id, nf.n_fields, nf.n_fields_with_ebfp, s.* exclude (rep) from nf join (select rep, {SUMMARY} from fo group by rep) s on s.rep=nf.replicate_id)
"""


@query("replicate_summary", duck("fields", "obj", body=f"with {CALLED}, {REPLICATES} select * from rs"))
def replicate_summary(spark, sf):
    return rollups.replicate_summary(recipe(spark, sf, "fields"), called(spark, sf))


@query("replicate_stats", duck("fields", "obj", body=f"""with {CALLED}, {REPLICATES},
m as (unpivot (select replicate_id, {", ".join(rollups.METRICS)} from rs) on {", ".join(rollups.METRICS)} into name metric value value)
select metric, round(avg(value),8) as mean, round(stddev_samp(value),8) as sample_sd, count(value) as n_defined from m group by metric"""))
def replicate_stats(spark, sf):
    stats = rollups.replicate_stats(replicate_summary(spark, sf))
    return stats.select("metric", F.round("mean", 8).alias("mean"), F.round("sample_sd", 8).alias("sample_sd"), "n_defined")


@query("q_sweep", duck("obj", body=f"""with {CALLED}, t as (select unnest([0.01,0.025,0.05,0.1]::double[]) as q_threshold)
select image_id, q_threshold,
count(*) filter (where scorable and q<=q_threshold) as ebfp_all_count, count(*) filter (where scorable) as ebfp_all_scorable,
count(*) filter (where scorable and q<=q_threshold and status='live_only') as ebfp_live_count,
count(*) filter (where scorable and status='live_only') as ebfp_live_scorable,
100::double*count(*) filter (where scorable and q<=q_threshold)/nullif(count(*) filter (where scorable),0) as ebfp_all_percent,
100::double*count(*) filter (where scorable and q<=q_threshold and status='live_only')/nullif(count(*) filter (where scorable and status='live_only'),0) as ebfp_live_percent
from called, t group by 1,2"""))
def q_sweep(spark, sf):
    return rollups.q_sweep(called(spark, sf), Q_THRESHOLDS)


@query("p_sweep", duck("obj", body="""with x as (select *, case when scorable then 4000 - object_id % 100 end as null_n from obj)
select image_id, count(*) as n, min(null_n) as null_locations_min, median(null_n) as null_locations_median,
count(*) filter (where p<=0.001)/count(*)::double as p_0_001_fraction,
count(*) filter (where p<=0.005)/count(*)::double as p_0_005_fraction,
count(*) filter (where p<=0.01)/count(*)::double as p_0_01_fraction,
count(*) filter (where p<=0.025)/count(*)::double as p_0_025_fraction,
count(*) filter (where p<=0.05)/count(*)::double as p_0_05_fraction
from x group by image_id"""))
def p_sweep(spark, sf):
    objects = recipe(spark, sf, "obj").withColumn(
        "null_n", F.when(F.col("scorable"), F.lit(4000) - F.col("object_id") % 100)
    )
    return objects.groupBy("image_id").agg(
        F.count("*").alias("n"),
        F.min("null_n").alias("null_locations_min"),
        F.percentile("null_n", F.lit(0.5)).alias("null_locations_median"),
        *[
            (total(F.col("p") <= t) / F.count("*")).alias("p_" + str(t).replace(".", "_") + "_fraction")
            for t in P_THRESHOLDS
        ],
    )


@query("detection_by_status", duck("obj", body=f"""with {CALLED}
select image_id, status, count(*) as n, count(*) filter (where detected) as detected,
count(*) filter (where detected)/count(*)::double as fraction from called group by 1,2"""))
def detection_by_status(spark, sf):
    return called(spark, sf).groupBy("image_id", "status").agg(
        F.count("*").alias("n"),
        total(F.col("detected")).alias("detected"),
        (total(F.col("detected")) / F.count("*")).alias("fraction"),
    )


@query("fixed_cutoff_null", duck("obj", body=f"""with {CALLED},
cut as (select max(p) as cutoff from called where detected),
shifted as (select c.* exclude (detected, p), case when scorable then (1+(object_id*53)%4000)::double/4001 end as p from called c),
redone as (select s.*, cut.cutoff, case when scorable then coalesce(s.p<=cut.cutoff,false) end as detected from shifted s, cut)
select image_id, max(cutoff) as fixed_p_cutoff, {SUMMARY} from redone group by image_id"""))
def fixed_cutoff_null(spark, sf):
    """Calls of a shifted channel at the p cutoff fixed by the unshifted run."""
    base = called(spark, sf)
    cutoff = base.filter("detected").select(F.max("p")).scalar()
    shifted = base.withColumn(
        "p", F.when(F.col("scorable"), (1 + (F.col("object_id") * 53) % 4000).cast("double") / 4001)
    )
    redone = shifted.withColumn("fixed_p_cutoff", cutoff).withColumn(
        "detected", F.when(F.col("scorable"), yes(F.col("p") <= F.col("fixed_p_cutoff")))
    )
    return rollups.count_summary(redone, ["image_id", "fixed_p_cutoff"])


@query("optional_channel", duck("fields", "obj", body="""select o.image_id, o.object_id, o.status, f.ebfp_provided as provided,
case when f.ebfp_provided then o.p end as p, (f.ebfp_provided and o.scorable) as scorable,
case when not f.ebfp_provided then 'channel_not_provided' when o.scorable then 'scorable' else 'insufficient_null_locations' end as ebfp_status
from obj o left join fields f using (image_id)"""))
def optional_channel(spark, sf):
    objects = recipe(spark, sf, "obj")
    measured = objects.filter("scorable").select("image_id", "object_id", "p", "scorable")
    kept = objects.select("image_id", "object_id", "status")
    joined = enrichment.optional_channel(recipe(spark, sf, "fields"), kept, measured)
    return joined.select("image_id", "object_id", "status", "provided", "p", "scorable", "ebfp_status")


@query("representative_field", duck("fields", "obj", body=f"""with {CALLED},
v as (select f.image_id, f.seq, 100::double*count(*) filter (where c.status='live_only')/nullif(count(c.object_id),0) as viability_percent
      from fields f left join called c on c.image_id=f.image_id group by 1,2),
m as (select quantile_cont(viability_percent,0.5) as med from v)
select image_id, seq, viability_percent from v, m order by viability_percent is null, coalesce(abs(viability_percent-med),0), seq limit 1"""))
def representative_field(spark, sf):
    fields = recipe(spark, sf, "fields")
    summary = rollups.with_percentages(rollups.field_counts(fields, called(spark, sf)))
    return rollups.representative_field(summary.select("image_id", "seq", "viability_percent"), "viability_percent", "seq")


@query("distinct_first_seen", """with g as (select o_orderpriority as value, min(o_orderkey) as first_seen, count(*) as n from orders group by 1)
select value, first_seen, n, row_number() over (order by first_seen) as position from g""")
def distinct_first_seen(spark, sf):
    """Distinct values in the order of their first row; the window sees one row per value."""
    first = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("value")).agg(
        F.min("o_orderkey").alias("first_seen"), F.count("*").alias("n")
    )
    return ranks.numbered(first, [], [F.col("first_seen")], "position")


@query("key_set_diff", """with a as (select distinct c_custkey as k from customer), b as (select distinct o_custkey as k from orders)
select 'only_left' as side, k from a where k not in (select k from b)
union all select 'only_right', k from b where k not in (select k from a)
union all select 'both', k from a where k in (select k from b)""")
def key_set_diff(spark, sf):
    """Both differences and the intersection of two key sets in one aggregation."""
    left = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lit(1).alias("side"))
    right = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.lit(2).alias("side"))
    seen = left.unionByName(right).groupBy("k").agg(F.bit_or("side").alias("sides"))
    return seen.select(
        F.when(F.col("sides") == 1, "only_left").when(F.col("sides") == 2, "only_right").otherwise("both").alias("side"), "k"
    )


@query("exact_percentiles", duck("obj", body="""with
x as (select image_id, cast(round(p*4001) as bigint) as k from obj where p is not null)
select image_id, round(quantile_cont(k,0.0),6) as p0, round(quantile_cont(k,0.25),6) as p25, round(quantile_cont(k,0.5),6) as p50,
round(quantile_cont(k,0.75),6) as p75, round(quantile_cont(k,0.9),6) as p90, round(quantile_cont(k,0.99),6) as p99, round(quantile_cont(k,1.0),6) as p100 from x group by 1"""))
def exact_percentiles(spark, sf):
    """Linear-interpolated percentiles of the exceedance rank (an integer of bounded range)."""
    points = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99, "p100": 1.0}
    ranks_ = recipe(spark, sf, "obj").filter("p is not null").select(
        "image_id", F.round(F.col("p") * 4001).cast("bigint").alias("k")
    )
    grouped = ranks_.groupBy("image_id").agg(F.percentile("k", F.array(*map(F.lit, points.values()))).alias("v"))
    return grouped.select("image_id", *[F.round(F.col("v")[i], 6).alias(n) for i, n in enumerate(points)])


@query("union_fields", duck("obj", body="""select replicate_id, image_id, object_id, status, 'scored' as part from obj where scorable
union all select replicate_id, image_id, object_id, status, 'unscored' from obj where not scorable"""))
def union_fields(spark, sf):
    """Concatenate per-part tables by column name."""
    objects = recipe(spark, sf, "obj")
    scored = objects.filter("scorable").select("image_id", "object_id", "status", "replicate_id", F.lit("scored").alias("part"))
    rest = objects.filter("not scorable").select("replicate_id", "status", "object_id", "image_id", F.lit("unscored").alias("part"))
    return scored.unionByName(rest).select("replicate_id", "image_id", "object_id", "status", "part")
