"""Reviewer decisions, viability bounds and reports on association groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfield.operators import review
from lumenfield.plans.registry import query
from lumenfield.sources.recipes import duck, recipe

STATUS_SQL = """case when n_red=0 then 'green_only' when n_green=0 then 'red_only' when n_green=1 and n_red=1 and object_id%3<>0 then 'dual_positive_candidate' else 'unresolved' end"""
DECIDED = f"""
g as (select *, {STATUS_SQL} as status from grp),
dec as (select image_id, object_id, case when prio='1-URGENT' and n_green=1 and n_red=1 then 'same_cell' when prio='2-HIGH' then 'separate' when prio='3-MEDIUM' then 'uncertain'
 when prio='4-NOT SPECIFIED' and object_id%2=0 then 'pairs' end as decision, 1::bigint as n_pairs from grp where n_green>0 and n_red>0),
rv as (select g.*, coalesce(d.decision,'unreviewed') as decision, case d.decision when 'same_cell' then 1 when 'pairs' then d.n_pairs else 0 end as n_pairs, n_green>0 and n_red>0 as mixed from g left join (select * from dec where decision is not null) d using (image_id, object_id))"""

SUMS_SQL = """cast(sum(n_green) as bigint) as green_objects, cast(sum(n_red) as bigint) as red_objects,
cast(sum(case when mixed and decision not in ('unreviewed','uncertain') then n_pairs else 0 end) as bigint) as paired_min,
cast(sum(case when mixed and decision not in ('unreviewed','uncertain') then n_pairs when mixed then least(n_green,n_red) else 0 end) as bigint) as paired_max,
count(*) filter (where mixed) as mixed_groups, count(*) filter (where mixed and decision not in ('unreviewed','uncertain')) as reviewed_groups,
count(*) filter (where mixed and decision in ('unreviewed','uncertain')) as pending_groups, count(*) filter (where status='dual_positive_candidate') as dual_candidates,
count(*) filter (where status='unresolved') as unresolved_groups, count(*) filter (where mixed and decision='uncertain') as uncertain_groups,
count(*) filter (where mixed and decision='unreviewed') as unreviewed_groups, count(*) as total_groups, count(*) filter (where status='green_only') as green_only, count(*) filter (where status='red_only') as red_only"""

BOUNDS_SQL = """green_objects-paired_max as live_min, green_objects-paired_min as live_max, green_objects+red_objects-paired_max as total_min, green_objects+red_objects-paired_min as total_max,
red_objects as dead_count, paired_min as definite_same_cell_pairs, paired_max-paired_min as pending_pair_max,
100::double*(green_objects-paired_max)/nullif(green_objects+red_objects-paired_max,0) as viability_min_pct, 100::double*(green_objects-paired_min)/nullif(green_objects+red_objects-paired_min,0) as viability_max_pct,
case when pending_groups=0 then 100::double*(green_objects-paired_max)/nullif(green_objects+red_objects-paired_max,0) end as viability_pct"""


def groups(spark, sf):
    table = recipe(spark, sf, "grp")
    return table.withColumn("status", review.group_status(F.col("n_green"), F.col("n_red"), F.col("object_id") % 3 != 0))


def decisions(spark, sf):
    prio, single = F.col("prio"), (F.col("n_green") == 1) & (F.col("n_red") == 1)
    decision = (
        F.when((prio == "1-URGENT") & single, "same_cell").when(prio == "2-HIGH", "separate").when(prio == "3-MEDIUM", "uncertain")
        .when((prio == "4-NOT SPECIFIED") & (F.col("object_id") % 2 == 0), "pairs")
    )
    mixed = recipe(spark, sf, "grp").filter("n_green > 0 and n_red > 0")
    return mixed.select("image_id", "object_id", decision.alias("decision"), F.lit(1).cast("bigint").alias("n_pairs")).filter("decision is not null")


@query("apply_decisions", duck("grp", body=f"with {DECIDED} select image_id, object_id, status, n_green, n_red, decision, n_pairs from rv"))
def apply_decisions(spark, sf):
    reviewed = review.apply_decisions(groups(spark, sf), decisions(spark, sf))
    return reviewed.select("image_id", "object_id", "status", "n_green", "n_red", "decision", "n_pairs")


@query("viability_bounds", duck("grp", body=f"with {DECIDED}, s as (select image_id, {SUMS_SQL} from rv group by 1) select *, {BOUNDS_SQL} from s"))
def viability_bounds(spark, sf):
    return review.viability_bounds(groups(spark, sf), decisions(spark, sf))


REPORT_SQL = f"""{DECIDED}, s as (select image_id, {SUMS_SQL} from rv group by 1),
f as (select fields.image_id, fields.replicate_id, {", ".join(f"coalesce({n},0) as {n}" for n in review.SUMS)} from fields left join s using (image_id)),
r as (select case grouping(replicate_id, image_id) when 0 then 'field' when 1 then 'replicate' else 'overall' end as level, replicate_id, image_id, count(*) as n_fields,
 {", ".join(f"cast(sum({n}) as bigint) as {n}" for n in review.SUMS)} from f group by rollup(replicate_id, image_id)),
rep as (select *, {BOUNDS_SQL} from r)"""


def report(spark, sf):
    return review.viability_report(recipe(spark, sf, "fields"), groups(spark, sf), decisions(spark, sf))


@query("viability_report", duck("fields", "grp", body=f"with {REPORT_SQL} select * from rep"))
def viability_report(spark, sf):
    return report(spark, sf)


@query("viability_caption", duck("fields", "grp", body=f"""with {REPORT_SQL},
t as (select *, format('{{:.1f}}', round_even(viability_min_pct,1)) as lo, format('{{:.1f}}', round_even(viability_max_pct,1)) as hi, format('{{:.1f}}', round_even(viability_pct,1)) as pt from rep)
select level, replicate_id, image_id, case when viability_min_pct is null then '{review.NOT_MEASURABLE}' when pending_groups>0 then '{review.PROVISIONAL}'||lo||'–'||hi||'%'
 else case when mixed_groups>0 then '{review.REVIEWED}' else '{review.APPARENT}' end||pt||'%' end as caption,
case when viability_min_pct is null then 'Not measured' when viability_pct is not null then pt||'%' else lo||'–'||hi||'%' end as viability_text,
format('Mixed groups reviewed: {{}}/{{}} · Pending: {{}}', reviewed_groups, mixed_groups, pending_groups) as progress,
case when live_min=live_max then format('{{:,}}', live_min) else format('{{:,}}', live_min)||'–'||format('{{:,}}', live_max) end as live_text,
case when total_min=total_max then format('{{:,}}', total_min) else format('{{:,}}', total_min)||'–'||format('{{:,}}', total_max) end as total_text from t"""))
def viability_caption(spark, sf):
    return review.viability_text(report(spark, sf)).select(
        "level", "replicate_id", "image_id", "caption", "viability_text", "progress", "live_text", "total_text"
    )


@query("batch_rollup", duck("fields", "grp", body=f"""with g as (select *, {STATUS_SQL} as status from grp),
c as (select image_id, count(*) filter (where status='green_only') as green_only, count(*) filter (where status='red_only') as red_only, count(*) filter (where status='dual_positive_candidate') as dual_positive_candidate,
 count(*) filter (where status='unresolved') as unresolved, count(*) as total_groups, sum(greatest(n_green,n_red)) as cmin, sum(n_green+n_red) as cmax from g group by 1),
f as (select fields.image_id, fields.replicate_id, c.* exclude (image_id) from fields left join c using (image_id))
select replicate_id, image_id, count(*) as n_fields, {", ".join(f"cast(coalesce(sum({n}),0) as bigint) as {n}" for n in ["green_only", "red_only", "dual_positive_candidate", "unresolved", "total_groups"])},
cast(coalesce(sum(cmin),0) as bigint) as candidate_count_min, cast(coalesce(sum(cmax),0) as bigint) as candidate_count_max from f group by rollup(replicate_id, image_id)"""))
def batch_rollup(spark, sf):
    return review.batch_rollup(recipe(spark, sf, "fields"), groups(spark, sf))


@query("review_progress", duck("grp", body=f"""with {DECIDED}, x as (select image_id, status in ('dual_positive_candidate','unresolved') as m, decision in ('same_cell','separate','pairs') as d from rv)
select image_id, count(*) filter (where m) as mixed, count(*) filter (where m and d) as resolved, count(*) filter (where m and not d) as pending from x group by 1"""))
def review_progress(spark, sf):
    return review.review_progress(review.apply_decisions(groups(spark, sf), decisions(spark, sf)))


@query("review_queue", duck("grp", body=f"with g as (select *, {STATUS_SQL} as status from grp) select image_id, object_id, status, n_green, n_red from g where status in ('dual_positive_candidate','unresolved')"))
def review_queue(spark, sf):
    return review.review_queue(groups(spark, sf)).select("image_id", "object_id", "status", "n_green", "n_red")


@query("orphan_decisions", duck("grp", body="""with d as (select case when object_id%41=0 then image_id||'x' else image_id end as image_id, case when object_id%43=0 then -object_id else object_id end as object_id from grp where prio<>'5-LOW')
select image_id, object_id, 'unknown_field' as rule from d where image_id not in (select image_id from grp)
union all select image_id, object_id, 'unknown_group' from d where image_id in (select image_id from grp) and (image_id, object_id) not in (select image_id, object_id from grp)"""))
def orphan_decisions(spark, sf):
    table = recipe(spark, sf, "grp")
    k = F.col("object_id")
    fed = table.filter("prio <> '5-LOW'").select(
        F.when(k % 41 == 0, F.concat("image_id", F.lit("x"))).otherwise(F.col("image_id")).alias("image_id"), F.when(k % 43 == 0, -k).otherwise(k).alias("object_id")
    )
    return review.orphan_decisions(fed, table.select("image_id"), table)


MEMBERS_SQL = f"""m as (select image_id, object_id, case when object_id%53=0 then 'green_only' when object_id%59=0 then 'bogus' else {STATUS_SQL} end as status,
 case when object_id%89=0 then 777 else object_id*10 end as base, n_green, n_red from grp),
t as (select image_id, object_id, status, case when object_id%83=0 then '' else array_to_string([cast(base+i as varchar) for i in range(1,n_green+1)],';')||case when object_id%97=0 and n_green>0 then ';'||cast(base+1 as varchar) else '' end end as green_ids,
 case when object_id%83=0 then '' else array_to_string([cast(base+i as varchar) for i in range(1,n_red+1)],';')||case when object_id%71=0 and n_red>0 then ';x' else '' end end as red_ids from m),
l as (select *, list_filter(string_split(green_ids,';'), lambda v: v<>'') as g, list_filter(string_split(red_ids,';'), lambda v: v<>'') as r from t)"""


def member_lists(spark, sf):
    k = F.col("object_id")
    base = F.when(k % 89 == 0, F.lit(777)).otherwise(k * 10)
    def ids(n):
        steps = F.when(n > 0, F.sequence(F.lit(1).cast("bigint"), n)).otherwise(F.array().cast("array<bigint>"))
        return F.array_join(F.transform(steps, lambda i: (base + i).cast("string")), ";")

    repeated = F.when((k % 97 == 0) & (F.col("n_green") > 0), F.concat(F.lit(";"), (base + 1).cast("string"))).otherwise("")
    broken = F.when((k % 71 == 0) & (F.col("n_red") > 0), ";x").otherwise("")
    return groups(spark, sf).withColumns({
        "status": F.when(k % 53 == 0, "green_only").when(k % 59 == 0, "bogus").otherwise(F.col("status")),
        "green_ids": F.when(k % 83 == 0, "").otherwise(F.concat(ids(F.col("n_green")), repeated)),
        "red_ids": F.when(k % 83 == 0, "").otherwise(F.concat(ids(F.col("n_red")), broken)),
    })


@query("membership_violations", duck("grp", body=f"""with {MEMBERS_SQL},
e as (select distinct image_id, object_id, 'G'||unnest(g) as member from l union select distinct image_id, object_id, 'R'||unnest(r) from l)
select image_id, object_id, 'no_members' as rule from l where len(g)=0 and len(r)=0
union all select image_id, object_id, 'invalid_member' from l where len(list_filter(list_concat(g,r), lambda v: not regexp_full_match(v,'[1-9][0-9]*')))>0
union all select image_id, object_id, 'member_repeated' from l where len(list_distinct(g))<len(g) or len(list_distinct(r))<len(r)
union all select image_id, object_id, 'unknown_status' from l where status not in ('green_only','red_only','dual_positive_candidate','unresolved')
union all select image_id, object_id, 'status_mismatch' from l where (status='green_only' and (len(r)>0 or len(g)<>1)) or (status='red_only' and (len(g)>0 or len(r)<>1))
 or (status in ('dual_positive_candidate','unresolved') and (len(g)=0 or len(r)=0)) or (status='dual_positive_candidate' and (len(g)<>1 or len(r)<>1))
union all select image_id, min(object_id), 'member_in_two_groups' from e group by image_id, member having count(*)>1"""))
def membership_violations(spark, sf):
    return review.membership_violations(member_lists(spark, sf))


@query("decision_violations", duck("grp", body="""with d as (select image_id, object_id, n_green, n_red, case when object_id%61=0 then 'maybe' when prio='1-URGENT' then 'same_cell' when prio='2-HIGH' then 'separate' when prio='3-MEDIUM' then 'uncertain' else 'pairs' end as decision,
 case when object_id%7=0 then [1,1] when prio in ('4-NOT SPECIFIED','5-LOW') or object_id%29=0 then [1] else []::integer[] end as gs,
 case when object_id%7=0 then [1,2] when (prio in ('4-NOT SPECIFIED','5-LOW') or object_id%29=0) and object_id%11=0 then [9] when prio in ('4-NOT SPECIFIED','5-LOW') or object_id%29=0 then [1] else []::integer[] end as rs from grp)
select image_id, object_id, 'unknown_decision' as rule from d where decision='maybe'
union all select image_id, object_id, 'pairs_not_allowed' from d where decision<>'pairs' and len(gs)>0
union all select image_id, object_id, 'pair_outside_group' from d where len(list_filter(gs, lambda v: v>n_green))>0 or len(list_filter(rs, lambda v: v>n_red))>0
union all select image_id, object_id, 'member_in_two_pairs' from d where len(list_distinct(gs))<len(gs) or len(list_distinct(rs))<len(rs)
union all select image_id, object_id, 'same_cell_needs_one_pair' from d where decision='same_cell' and (n_green<>1 or n_red<>1)
union all select image_id, object_id, 'group_not_mixed' from d where decision in ('same_cell','separate','pairs') and (n_green=0 or n_red=0)"""))
def decision_violations(spark, sf):
    k, prio = F.col("object_id"), F.col("prio")
    table = recipe(spark, sf, "grp")
    def pair(g, r):
        return F.struct(F.lit(g).cast("bigint").alias("g"), F.lit(r).cast("bigint").alias("r"))

    paired = prio.isin("4-NOT SPECIFIED", "5-LOW") | (k % 29 == 0)
    fed = table.select(
        "image_id", "object_id",
        F.when(k % 61 == 0, "maybe").when(prio == "1-URGENT", "same_cell").when(prio == "2-HIGH", "separate").when(prio == "3-MEDIUM", "uncertain").otherwise("pairs").alias("decision"),
        F.when(k % 7 == 0, F.array(pair(1, 1), pair(1, 2))).when(paired & (k % 11 == 0), F.array(pair(1, 9))).when(paired, F.array(pair(1, 1))).alias("pairs"),
    )
    def members(n):
        return F.when(n > 0, F.sequence(F.lit(1).cast("bigint"), n)).otherwise(F.array().cast("array<bigint>"))

    lists = table.select("image_id", "object_id", members(F.col("n_green")).alias("greens"), members(F.col("n_red")).alias("reds"))
    return review.decision_violations(fed, lists)
