"""Reviewer decisions and the bounds they put on viability.

A group holds green and red detections. A reviewed pair is one cell; pending mixed groups
give a range of possible pairings, never an averaged percentage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfield.functions.scalars import percent, total
from lumenfield.operators.volume import STATUSES
from lumenfield.session import cut

# fixed values: decisions and caption texts
DECISIONS = ["same_cell", "separate", "pairs", "uncertain", "unreviewed"]
PAIRING = ["same_cell", "separate", "pairs"]
NOT_MEASURABLE = "Viability not measurable · no detected cells"
PROVISIONAL, REVIEWED, APPARENT = "Provisional viability: ", "Reviewed viability: ", "Apparent viability: "

SUMS = [
    "green_objects", "red_objects", "paired_min", "paired_max", "mixed_groups", "reviewed_groups", "pending_groups",
    "dual_candidates", "unresolved_groups", "uncertain_groups", "unreviewed_groups", "total_groups", "green_only", "red_only",
]
GROUPS_A_TASK = 1 << 18
REVISION_PATTERN = r"^[0-9]{8}T[0-9]{6}\.[0-9]{6}Z_[0-9a-f]{12}\z"


def latest(feed: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row per key, as one partial aggregation."""
    rest = [c for c in feed.columns if c not in keys]
    last = feed.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return last.select(*keys, "_last.*")


def apply_decisions(groups: DataFrame, decisions: DataFrame, keys: Sequence[str] = ("image_id", "object_id")) -> DataFrame:
    """Every group with its decision (default unreviewed) and number of reviewed pairs."""
    chosen = decisions.select(*keys, "decision", "n_pairs")
    joined = groups.join(chosen, list(keys), "left").withColumn("decision", F.coalesce("decision", F.lit("unreviewed")))
    pairs = F.when(F.col("decision") == "same_cell", 1).when(F.col("decision") == "pairs", F.coalesce("n_pairs", F.lit(0))).otherwise(0)
    return joined.withColumn("n_pairs", pairs.cast("bigint"))


def group_sums() -> list[Column]:
    c = F.col
    mixed = (c("n_green") > 0) & (c("n_red") > 0)
    pending = mixed & c("decision").isin("unreviewed", "uncertain")
    reviewed = mixed & ~c("decision").isin("unreviewed", "uncertain")
    zero = F.lit(0).cast("bigint")
    return [
        F.sum("n_green").alias("green_objects"), F.sum("n_red").alias("red_objects"),
        F.sum(F.when(reviewed, c("n_pairs")).otherwise(zero)).alias("paired_min"),
        F.sum(F.when(reviewed, c("n_pairs")).when(pending, F.least("n_green", "n_red")).otherwise(zero)).alias("paired_max"),
        total(mixed).alias("mixed_groups"), total(reviewed).alias("reviewed_groups"), total(pending).alias("pending_groups"),
        total(c("status") == "dual_positive_candidate").alias("dual_candidates"), total(c("status") == "unresolved").alias("unresolved_groups"),
        total(mixed & (c("decision") == "uncertain")).alias("uncertain_groups"), total(mixed & (c("decision") == "unreviewed")).alias("unreviewed_groups"),
        F.count("*").alias("total_groups"), total(c("status") == "green_only").alias("green_only"), total(c("status") == "red_only").alias("red_only"),
    ]


def with_bounds(sums: DataFrame) -> DataFrame:
    """Live, total and viability bounds; the point value only exists when nothing is pending."""
    c = F.col
    counted = sums.withColumns({
        "live_min": c("green_objects") - c("paired_max"), "live_max": c("green_objects") - c("paired_min"),
        "total_min": c("green_objects") + c("red_objects") - c("paired_max"), "total_max": c("green_objects") + c("red_objects") - c("paired_min"),
        "dead_count": c("red_objects"), "definite_same_cell_pairs": c("paired_min"), "pending_pair_max": c("paired_max") - c("paired_min"),
    })
    ranged = counted.withColumns({
        "viability_min_pct": percent(c("live_min"), c("total_min")), "viability_max_pct": percent(c("live_max"), c("total_max")),
    })
    return ranged.withColumn("viability_pct", F.when(c("pending_groups") == 0, c("viability_min_pct")))


def field_sums(fields: DataFrame, reviewed: DataFrame) -> DataFrame:
    sums = reviewed.groupBy("image_id").agg(*group_sums())
    joined = fields.select("image_id", "replicate_id").join(sums, "image_id", "left")
    return joined.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in SUMS})


def viability_bounds(groups: DataFrame, decisions: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    return with_bounds(apply_decisions(groups, decisions).groupBy(*keys).agg(*group_sums()))


def viability_report(fields: DataFrame, groups: DataFrame, decisions: DataFrame) -> DataFrame:
    """Field, replicate and overall rows from pooled integers (a roll-up over one row per field)."""
    sums = field_sums(fields, apply_decisions(groups, decisions))
    rolled = sums.rollup("replicate_id", "image_id").agg(
        F.grouping_id().alias("_level"), F.count("*").alias("n_fields"), *[F.sum(n).alias(n) for n in SUMS]
    )
    level = F.when(F.col("_level") == 0, "field").when(F.col("_level") == 1, "replicate").otherwise("overall")
    return with_bounds(rolled.withColumn("level", level).drop("_level"))


def batch_rollup(fields: DataFrame, groups: DataFrame) -> DataFrame:
    """Group counts by field, replicate and run."""
    counts = groups.groupBy("image_id").agg(
        *[total(F.col("status") == s).alias(s) for s in STATUSES], F.count("*").alias("total_groups"),
        F.sum(F.greatest("n_green", "n_red")).alias("candidate_count_min"), F.sum(F.col("n_green") + F.col("n_red")).alias("candidate_count_max"),
    )
    names = [*STATUSES, "total_groups", "candidate_count_min", "candidate_count_max"]
    joined = fields.select("image_id", "replicate_id").join(counts, "image_id", "left")
    joined = joined.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in names})
    return joined.rollup("replicate_id", "image_id").agg(F.count("*").alias("n_fields"), *[F.sum(n).alias(n) for n in names])


def group_status(n_green: Column, n_red: Column, shared: Column) -> Column:
    return (
        F.when(n_red == 0, "green_only").when(n_green == 0, "red_only")
        .when((n_green == 1) & (n_red == 1) & shared, "dual_positive_candidate").otherwise("unresolved")
    )


def review_queue(groups: DataFrame) -> DataFrame:
    """Candidates a reviewer has to look at."""
    return groups.filter(F.col("status").isin("double_positive", "dual_positive_candidate", "unresolved"))


def review_progress(reviewed: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    mixed = F.col("status").isin("dual_positive_candidate", "unresolved")
    done = mixed & F.col("decision").isin(PAIRING)
    return reviewed.groupBy(*keys).agg(
        total(mixed).alias("mixed"), total(done).alias("resolved"), (total(mixed) - total(done)).alias("pending")
    )


def tenths(value: Column) -> Column:
    return F.format_string("%.1f", F.bround(value, 1))


def value_range(low: Column, high: Column) -> Column:
    """``n`` or ``low–high`` with thousands separators."""
    a, b = F.format_number(low, 0), F.format_number(high, 0)
    return F.when(low == high, a).otherwise(F.concat(a, F.lit("–"), b))


def viability_text(bounds: DataFrame) -> DataFrame:
    """Caption, progress and range texts of a bounds table."""
    c = F.col
    low, high = c("viability_min_pct"), c("viability_max_pct")
    span = F.concat(tenths(low), F.lit("–"), tenths(high), F.lit("%"))
    caption = (
        F.when(low.isNull() | high.isNull(), NOT_MEASURABLE)
        .when(c("pending_groups") > 0, F.concat(F.lit(PROVISIONAL), span))
        .otherwise(F.concat(F.when(c("mixed_groups") > 0, REVIEWED).otherwise(APPARENT), tenths(c("viability_pct")), F.lit("%")))
    )
    short = F.when(low.isNull(), "Not measured").when(c("viability_pct").isNotNull(), F.concat(tenths(c("viability_pct")), F.lit("%"))).otherwise(span)
    progress = F.format_string("Mixed groups reviewed: %d/%d · Pending: %d", c("reviewed_groups"), c("mixed_groups"), c("pending_groups"))
    return bounds.withColumns({
        "caption": caption, "viability_text": short, "progress": progress,
        "live_text": value_range(c("live_min"), c("live_max")), "total_text": value_range(c("total_min"), c("total_max")),
    })


# ---------------------------------------------------------------- validation


def orphan_decisions(decisions: DataFrame, fields: DataFrame, groups: DataFrame) -> DataFrame:
    """Decisions that name a field or a group the analysis does not hold."""
    known = decisions.join(fields.select("image_id").distinct(), "image_id", "left_semi")
    lost = decisions.join(fields.select("image_id").distinct(), "image_id", "left_anti")
    stray = known.join(groups.select("image_id", "object_id"), ["image_id", "object_id"], "left_anti")
    names = ["image_id", "object_id"]
    return lost.select(*names, F.lit("unknown_field").alias("rule")).unionByName(stray.select(*names, F.lit("unknown_group").alias("rule")))


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda t: t != "")


def membership_violations(groups: DataFrame, per_task: int = GROUPS_A_TASK) -> DataFrame:
    """(image_id, object_id, rule) for broken member lists of saved groups with ``green_ids``/``red_ids`` texts.

    The groups are written down once and dealt to tasks of about ``per_task`` groups, and so
    are their members, so that what a task holds doesn't grow with the number of groups.
    """
    names = ["image_id", "object_id"]
    groups = cut(groups.select(*names, "status", "green_ids", "red_ids"))
    tasks = -(-groups.count() // per_task) or 1
    groups = groups.repartition(tasks, *names)
    lists = groups.withColumns({"_g": _tokens(F.col("green_ids")), "_r": _tokens(F.col("red_ids"))})
    n_g, n_r = F.size("_g"), F.size("_r")
    def bad(name):
        return F.size(F.filter(name, lambda t: ~t.rlike(r"^[1-9][0-9]*\z"))) > 0

    def twice(name):
        return F.size(F.array_distinct(name)) < F.size(name)

    status = F.col("status")
    mismatch = (
        ((status == "green_only") & ((n_r > 0) | (n_g != 1))) | ((status == "red_only") & ((n_g > 0) | (n_r != 1)))
        | (status.isin("dual_positive_candidate", "unresolved") & ((n_g == 0) | (n_r == 0)))
        | ((status == "dual_positive_candidate") & ((n_g != 1) | (n_r != 1)))
    )
    rules = F.array_compact(F.array(
        F.when((n_g == 0) & (n_r == 0), F.lit("no_members")), F.when(bad("_g") | bad("_r"), F.lit("invalid_member")),
        F.when(twice("_g") | twice("_r"), F.lit("member_repeated")), F.when(~F.coalesce(status.isin(STATUSES), F.lit(False)), F.lit("unknown_status")),
        F.when(mismatch, F.lit("status_mismatch")),
    ))
    single = lists.select(*names, F.explode(rules).alias("rule"))
    repeated = groups.groupBy(*names).count().filter("count > 1").select(*names, F.lit("duplicate_object").alias("rule"))
    members = lists.select(*names, F.explode(F.array_distinct(F.concat(
        F.transform("_g", lambda t: F.concat(F.lit("G"), t)), F.transform("_r", lambda t: F.concat(F.lit("R"), t))
    ))).alias("member")).repartition(tasks, "image_id", "member")
    shared = members.groupBy("image_id", "member").agg(
        F.min("object_id").alias("object_id"), F.max("object_id").alias("_last"), F.max(F.col("object_id").isNull()).alias("_unnamed")
    ).filter("object_id < _last or (object_id is not null and _unnamed)")
    return single.unionByName(repeated).unionByName(shared.select(*names, F.lit("member_in_two_groups").alias("rule")))


def decision_violations(decisions: DataFrame, groups: DataFrame) -> DataFrame:
    """(image_id, object_id, rule) for decisions a group cannot carry.

    ``decisions(image_id, object_id, decision, pairs array<struct<g,r>>)``; ``groups`` carries member arrays ``greens`` and ``reds``.
    """
    joined = decisions.join(groups.select("image_id", "object_id", "greens", "reds"), ["image_id", "object_id"])
    pairs, decision = F.coalesce(F.col("pairs"), F.array().cast("array<struct<g:bigint,r:bigint>>")), F.col("decision")
    gs, rs = F.transform(pairs, lambda p: p["g"]), F.transform(pairs, lambda p: p["r"])
    outside = (F.size(F.array_except(gs, F.col("greens"))) > 0) | (F.size(F.array_except(rs, F.col("reds"))) > 0)
    again = (F.size(F.array_distinct(gs)) < F.size(gs)) | (F.size(F.array_distinct(rs)) < F.size(rs))
    n_g, n_r = F.size("greens"), F.size("reds")
    rules = F.array_compact(F.array(
        F.when(~decision.isin(DECISIONS), F.lit("unknown_decision")),
        F.when((decision != "pairs") & (F.size(pairs) > 0), F.lit("pairs_not_allowed")),
        F.when(outside, F.lit("pair_outside_group")), F.when(again, F.lit("member_in_two_pairs")),
        F.when((decision == "same_cell") & ((n_g != 1) | (n_r != 1)), F.lit("same_cell_needs_one_pair")),
        F.when(decision.isin(PAIRING) & ((n_g == 0) | (n_r == 0)), F.lit("group_not_mixed")),
    ))
    return joined.select("image_id", "object_id", F.explode(rules).alias("rule"))


def valid_revision(revision: Column) -> Column:
    return F.coalesce(revision.rlike(REVISION_PATTERN), F.lit(False))
