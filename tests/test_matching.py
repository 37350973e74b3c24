"""Planar matching on literal masks, assignment against enumeration."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import naive
from lumenfield.operators import matching
from lumenfield.operators.components import contract

LABEL = "image_id bigint, channel string, y int, x int, id bigint"


def matched(spark, green, red, distance=6, dilation=1, window=24):
    """Objects and audit from two label arrays."""
    rows = [(1, c, int(y), int(x), int(a[y, x])) for c, a in (("green", green), ("red", red)) for y, x in np.argwhere(a)]
    pixels = spark.createDataFrame(rows, LABEL)
    props = pixels.groupBy("image_id", "channel", "id").agg(F.avg("y").alias("y"), F.avg("x").alias("x"), F.lit(9.0).alias("peak_contrast"))
    pairs = matching.admissible_pairs(pixels, props, distance, {"y": dilation, "x": dilation}, {"y": window, "x": window})
    objects = matching.match_objects(props, matching.one_to_one(pairs, ["image_id"]), ["image_id"])
    masks = matching.object_pixels(pixels, objects, ["image_id"])
    overlay = matching.mask_overlay(masks, ["image_id"])
    return matching.overlay_audit(objects, masks, overlay, ["image_id"]).orderBy("object_id").collect()


def stamp(shape, *places, radius=3):
    out = np.zeros(shape, int)
    for i, place in enumerate(places, 1):
        out[naive.disk(shape, place, radius)] = i
    return out


def test_red_only(spark):
    rows = matched(spark, np.zeros((96, 113), int), stamp((96, 113), (40, 50)))
    assert [(r.status, r.green_id) for r in rows] == [("dead_only", 0)]


def test_two_green_one_red(spark):
    rows = matched(spark, stamp((100, 100), (50, 40), (50, 47)), stamp((100, 100), (50, 43)))
    assert [(r.status, r.green_id, r.red_id) for r in rows] == [("double_positive", 1, 1), ("live_only", 2, 0)]


def test_near_but_separate(spark):
    green, red = np.zeros((60, 60), int), np.zeros((60, 60), int)
    green[20:23, 20:23], red[20:23, 26:29] = 1, 1
    assert [r.status for r in matched(spark, green, red, distance=8)] == ["live_only", "dead_only"]


def test_later_object_takes_the_pixels(spark):
    green, red = np.zeros((30, 30), int), np.zeros((30, 30), int)
    green[10:14, 10:14] = 1
    red[12:16, 10:30] = 1
    rows = matched(spark, green, red, distance=2)
    assert [(r.status, r.area, r.mask_pixels_final, r.mask_pixels_overwritten) for r in rows] == [("live_only", 16, 8, 8), ("dead_only", 80, 80, 0)]


@pytest.mark.parametrize("seed", range(60))
def test_assignment_by_enumeration(seed):
    rng = random.Random(seed)
    edges = [(g, r, rng.random()) for g in range(5) for r in range(5) if rng.random() < 0.45]
    best = (0, 0.0)

    def extend(i, used_g, used_r, n, cost):
        nonlocal best
        best = max(best, (n, -cost))
        for j in range(i, len(edges)):
            g, r, d = edges[j]
            if g not in used_g and r not in used_r:
                extend(j + 1, used_g | {g}, used_r | {r}, n + 1, cost + d)

    extend(0, frozenset(), frozenset(), 0, 0.0)
    found = matching.best_matching(edges)
    cost = {(g, r): d for g, r, d in edges}
    assert (len(found), pytest.approx(sum(cost[p] for p in found))) == (best[0], -best[1])


def test_range_join_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    sides = {c: rng.random((80, 2)) * 60 for c in ("g", "r")}
    frames = {c: spark.createDataFrame([(1, i, float(y), float(x)) for i, (y, x) in enumerate(p)], "image_id bigint, id bigint, y double, x double") for c, p in sides.items()}
    got = {(r.green_id, r.red_id) for r in matching.centroid_pairs(frames["g"], frames["r"], ["image_id"], 6.0).collect()}
    distance = np.linalg.norm(sides["g"][:, None] - sides["r"][None], axis=2)
    assert got == {tuple(map(int, p)) for p in np.argwhere(distance <= 6)}


def test_components_are_solved_as_a_stream(spark):
    """Components that go on over record batches, next to others of equal roots in other fields and settings."""
    rng = random.Random(11)
    rows = {(i, s, 10 * c + rng.randrange(4), 10 * c + rng.randrange(4)): rng.random() for i in range(3) for s in "ab" for c in range(12) for _ in range(6)}
    pairs = spark.createDataFrame([(*k, d) for k, d in rows.items()], "image_id bigint, setting string, green_id bigint, red_id bigint, distance double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        out = matching.one_to_one(pairs, ["image_id", "setting"])
        got = {tuple(r)[:4] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = set()
    for i in range(3):
        for s in "ab":
            own = sorted((g, r, d) for (a, b, g, r), d in rows.items() if (a, b) == (i, s))
            want |= {(i, s, *p) for p in matching.best_matching(own)}
    assert got == want
    # one call per image, setting and block of roots was most of the time
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()


def test_contract_takes_all_groups_at_once():
    rng = np.random.default_rng(5)
    pairs, group = rng.integers(0, 30, (200, 2)), rng.integers(0, 9, 200)
    want = [(*map(int, star), g) for g in range(9) for star in contract(pairs[group == g])]
    assert sorted(map(tuple, contract(pairs, group).tolist())) == sorted(want)


def test_least_distance_wins_where_a_sum_with_a_million_would_tie():
    """The pair that F1 names: 3.5e-12 apart, equal once 1e6 is taken off."""
    near, far = 4.590250537820729, 4.5902505378242795
    assert near - 1e6 == far - 1e6
    assert matching.best_matching([(399842, 309202, far), (399842, 622963, near)]) == [(399842, 622963)]


def test_a_repeated_pair_is_matched_once_at_its_least_distance(spark):
    """Two detections of a field may share an id; the SQL takes one edge of such a pair."""
    rows = [(1, 10, 20, 3.0), (1, 10, 20, 1.0), (1, 10, 20, 3.0), (1, 11, 21, 2.0), (1, 11, 21, 2.0), (1, 11, 22, 2.5), (1, 12, 22, 4.0), (2, 10, 20, 5.0)]
    pairs = spark.createDataFrame(rows, "image_id bigint, green_id bigint, red_id bigint, distance double")
    got = sorted(map(tuple, matching.one_to_one(pairs, ["image_id"]).collect()))
    assert got == [(1, 10, 20, 1.0), (1, 11, 21, 2.0), (1, 12, 22, 4.0), (2, 10, 20, 5.0)]
    # the farther edge comes last
    assert matching.best_matching([(1, 5, 1.0), (1, 6, 2.0), (1, 5, 9.0)]) == [(1, 5)]
