"""Components, peaks, seeds, splitting and planar segmentation against naive versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import naive
from lumenfield.operators import components, raster, regions, trees

PX = "image_id bigint, channel string, y int, x int, value double"
VX = "image_id bigint, channel string, z int, y int, x int, value double"
KEYS = ["image_id", "channel"]


def frame(spark, array, schema=PX):
    return spark.createDataFrame(naive.pixels(array), schema)


def as_array(rows, shape, name, axes=("y", "x")):
    out = np.zeros(shape, int)
    for r in rows:
        out[tuple(r[a] for a in axes)] = r[name]
    return out


def same_partition(a, b):
    assert ((a > 0) == (b > 0)).all()
    pairs = set(zip(a[a > 0].tolist(), b[b > 0].tolist()))
    assert len(pairs) == len({p for p, _ in pairs}) == len({q for _, q in pairs})


@pytest.mark.parametrize("density,full", [(0.3, True), (0.45, True), (0.55, False)])
def test_components_across_tiles(spark, density, full):
    rng = np.random.default_rng(int(density * 100))
    mask = rng.random((23, 31)) < density
    got = components.label_components(frame(spark, mask), KEYS, ["y", "x"], "full" if full else "faces", {"y": 5, "x": 7})
    rows = got.collect()
    same_partition(as_array([{"y": r.y, "x": r.x, "v": r.root + 1} for r in rows], mask.shape, "v"), naive.components(mask, full))
    first = {}
    for r in sorted(rows, key=lambda r: (r.y, r.x)):
        first.setdefault(r.root, r)
    assert all(r.root == (r.y << 21) + r.x for r in first.values())


def test_components_of_volume_across_tiles(spark):
    mask = np.random.default_rng(5).random((6, 11, 13)) < 0.2
    got = components.label_components(frame(spark, mask, VX), KEYS, ["z", "y", "x"], "full", {"z": 2, "y": 4, "x": 5})
    rows = [{"z": r.z, "y": r.y, "x": r.x, "v": r.root + 1} for r in got.collect()]
    same_partition(as_array(rows, mask.shape, "v", ("z", "y", "x")), naive.components(mask))


def test_edge_components_over_many_batches(spark):
    """A long chain and a hub, contracted in tiny batches, still come out whole."""
    chain = [("c", i, i + 1) for i in range(1, 120)]
    hub = [("h", 1000, i) for i in range(1, 90)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = components.connected_roots(spark.createDataFrame(chain + hub, "k string, a bigint, b bigint"), ["k"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert {(r.k, r.root) for r in got} == {("c", 1), ("h", 1)}
    assert len(got) == 120 + 90


def test_few_edges_take_no_rounds(spark, monkeypatch):
    rng = np.random.default_rng(3)
    order = rng.permutation(3000).tolist()
    edges = [("p", a, b) for a, b in zip(order[:2000], order[1:2000])] + [("q", a, b) for a, b in zip(order[2000:], order[2001:])] + [(None, 1, 2)]
    table = spark.createDataFrame(edges, "k string, a bigint, b bigint").repartition(40).cache()
    want = {("p", n): min(order[:2000]) for n in order[:2000]} | {("q", n): min(order[2000:]) for n in order[2000:]}

    def roots():
        return {(r.k, r.node): r.root for r in components.connected_roots(table, ["k"]).filter("k is not null").collect()}

    rounds = []
    large = components._large_star
    monkeypatch.setattr(components, "_large_star", lambda *a: rounds.append(1) or large(*a))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert roots() == want and not rounds
        # what is more than a few still goes through rounds, whatever a task may hold
        monkeypatch.setattr(components, "FEW", -1)
        monkeypatch.setattr(components, "FOLD", 100)
        monkeypatch.setattr(components, "HELD", 10)
        assert roots() == want and rounds
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_smoothing_matches_direct_sum(spark):
    plane = np.random.default_rng(2).integers(0, 50, (19, 27)).astype(float)
    got = raster.smooth_planes(frame(spark, plane), KEYS, {"a": (1.2, 1.2), "b": (6.0, 6.0)}, plane.shape, block=8)
    dense = got.toPandas().sort_values(["y", "x"])
    for name, sigma in (("a", 1.2), ("b", 6.0)):
        np.testing.assert_allclose(dense[name].to_numpy().reshape(plane.shape), naive.gaussian(plane, sigma), atol=1e-10)


@pytest.mark.parametrize("seed", range(4))
def test_split_matches_naive(spark, seed):
    rng = np.random.default_rng(seed)
    z = np.round(naive.gaussian(rng.random((40, 44)) * 100, 1.0), 1 if seed % 2 else 6)
    field = frame(spark, z).withColumn("raw", F.col("value"))
    low, high = float(np.quantile(z, 0.45)), float(np.quantile(z, 0.6))
    pixels, props = regions.segment(field, KEYS, F.lit(low), F.lit(high), F.lit(3), z.shape, 3, 4, True)
    want = naive.split_plane(z, low, high, 3, 3, 4)
    assert want.max() > 10
    np.testing.assert_array_equal(as_array(pixels.collect(), z.shape, "id"), want)
    for row in props.collect():
        ys, xs = np.nonzero(want == row.id)
        assert row.area == len(ys) and row.y == pytest.approx(np.average(ys, weights=z[ys, xs])) and row.peak_contrast == z[ys, xs].max()


def test_constant_image_has_no_regions(spark):
    plane = np.full((83, 121), 17.0)
    work = raster.contrast(frame(spark, plane), {"green": 1.2}, 12.0, plane.shape)
    field = work.select(*KEYS, "y", "x", F.col("contrast").alias("value"), F.lit(17.0).alias("raw"))
    pixels, props = regions.segment(field, KEYS, F.lit(5.0), F.lit(10.0), F.lit(20), plane.shape)
    assert props.count() == 0 and pixels.count() == 0
    assert {"id", "y", "x", "area", "peak_contrast", "mean_raw", "max_raw", "parent_count"} <= set(props.columns)


def test_blob_on_the_border_is_excluded(spark):
    yy, xx = np.mgrid[:91, :137]
    plane = sum(100 * np.exp(-((yy - 45) ** 2 + (xx - c) ** 2) / 18) for c in (55, 136))
    work = raster.contrast(frame(spark, plane), {"green": 1.2}, 12.0, plane.shape)
    field = work.select(*KEYS, "y", "x", F.col("contrast").alias("value"), F.col("contrast").alias("raw"))
    _, props = regions.segment(field, KEYS, F.lit(5.0), F.lit(10.0), F.lit(20), plane.shape)
    rows = props.collect()
    assert len(rows) == 1 and rows[0].x == pytest.approx(55, abs=0.2)


def test_thinning_is_the_greedy_result(spark):
    rng = np.random.default_rng(9)
    points = {(int(y), int(x)) for y, x in rng.integers(0, 40, (160, 2))}
    rows = [(1, "green", 0, y, x, float(rng.integers(0, 6))) for y, x in sorted(points)]
    peaks = spark.createDataFrame(rows, "image_id bigint, channel string, root bigint, y int, x int, value double")
    kept = regions.thin_seeds(peaks, KEYS, {"y": 1.0, "x": 1.0}, 6, regions.strongest_first()).collect()
    ordered = sorted(((r[3], r[4], r[5]) for r in rows), key=lambda r: (-r[2], -r[0], -r[1]))
    assert {(r.y, r.x) for r in kept} == set(naive.greedy([(y, x) for y, x, _ in ordered], 6))


LABEL = "image_id bigint, channel string, root bigint, y int, x int, value double"


def split(spark, z, seeds, tile):
    labels = spark.createDataFrame([(1, "green", 0, int(y), int(x), float(z[y, x])) for y, x in np.ndindex(z.shape)], LABEL)
    planted = spark.createDataFrame([(1, "green", 0, int(y), int(x), j, len(seeds)) for j, (y, x) in enumerate(seeds, 1)], "image_id bigint, channel string, root bigint, y int, x int, seed int, parent_count bigint")
    return as_array(regions.split_regions(labels, planted, KEYS, ["y", "x"], tile=tile).collect(), z.shape, "seed")


@pytest.mark.parametrize("levels, tile", [(3, {"y": 5, "x": 7}), (40, {"y": 6, "x": 4}), (3, None)])
def test_one_component_over_many_tiles(spark, levels, tile):
    rng = np.random.default_rng(levels)
    z = np.ceil(naive.gaussian(rng.random((19, 26)), 1.0) * levels * 2)
    seeds = [tuple(map(int, p)) for p in rng.permutation(np.argwhere(z > 0))[:6]]
    np.testing.assert_array_equal(split(spark, z, seeds, tile), naive.least_passes(z, z > 0, seeds))


def test_ties_between_seeds_go_by_level_then_position(spark):
    # a flat strip: the seed at x=0 comes first at every step to the right of it
    assert split(spark, np.full((1, 7), 5.0), [(0, 0), (0, 6)], {"y": 4, "x": 2}).tolist() == [[1, 1, 1, 1, 1, 1, 2]]
    # the bright side runs down to the saddle before the dim seed starts, so the saddle is its
    assert split(spark, np.array([[9.0, 7, 3, 4, 6]]), [(0, 0), (0, 4)], {"y": 4, "x": 2}).tolist() == [[1, 1, 1, 2, 2]]
    # behind a pass at level 2 all is one basin, whoever comes over the pass first
    assert split(spark, np.array([[8.0, 2, 6, 6, 2, 8]]), [(0, 0), (0, 5)], {"y": 4, "x": 3}).tolist() == [[1, 1, 1, 1, 2, 2]]


@pytest.mark.parametrize("tile", [{"y": 8, "x": 8}, {"y": 5, "x": 64}])
def test_thinning_over_tiles(spark, tile):
    rng = np.random.default_rng(4)
    points = sorted({(int(y), int(x)) for y, x in rng.integers(0, 40, (700, 2))})
    rows = [(1, "green", int(x > 20), y, x, float(rng.integers(0, 3))) for y, x in points]
    kept = regions.thin_seeds(spark.createDataFrame(rows, LABEL), KEYS, {"y": 1.0, "x": 1.0}, 6, regions.strongest_first(), tile).collect()
    want = set()
    for root in (0, 1):
        want |= set(naive.greedy([(r[3], r[4]) for r in sorted((r for r in rows if r[2] == root), key=lambda r: (-r[5], -r[3], -r[4]))], 6))
    assert {(r.y, r.x) for r in kept} == want and len(kept) == len(want)


def test_a_saturated_plateau_takes_few_jobs(spark):
    peaks = spark.range(256 * 256).selectExpr("1L as image_id", "'green' as channel", "0L as root", "int(id div 256) as y", "int(id % 256) as x", "255.0d as value")
    spark.sparkContext.setJobGroup("plateau", "thinning")
    kept = regions.thin_seeds(peaks, KEYS, {"y": 1.0, "x": 1.0}, 6, regions.strongest_first()).collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("plateau")
    spark.sparkContext.setJobGroup("tests", "")
    assert len(jobs) < 15
    # rows of six, shifted so that each point fills the gap of the row before it
    assert len(kept) > 256 * 256 / 36 and (255, 255) in {(r.y, r.x) for r in kept}
    near = {(r.y, r.x) for r in kept}
    assert not any((y + a, x + b) in near for y, x in near for a in range(6) for b in range(-5, 6) if (a or b) and a * a + b * b < 36)


@pytest.mark.parametrize("tile", [{"y": 5, "x": 7}, None])
def test_component_tree_holds_the_components_of_every_level(spark, tile):
    rng = np.random.default_rng(12)
    z = np.ceil(naive.gaussian(rng.random((23, 30)), 0.8) * 20)
    lows = [8.0, 9.0, 11.0, 12.0, 50.0]
    both = frame(spark, z).unionByName(spark.createDataFrame(naive.pixels(z.max() - z, channel="red"), PX))
    pixels, paths = trees.component_tree(both, KEYS, F.array(*[F.lit(v) for v in lows]), tile=tile)
    assert pixels.count() == pixels.select(*KEYS, "y", "x").distinct().count()
    members = pixels.join(paths, [*KEYS, "depth", "node"]).collect()
    table = {(r.channel, r.level, r.root): r for r in trees.tree_regions(pixels, paths, KEYS).collect()}
    for channel, plane in (("green", z), ("red", z.max() - z)):
        for level, low in enumerate(lows, 1):
            here = [r for r in members if r.channel == channel and r.level == level]
            same_partition(as_array([{"y": r.y, "x": r.x, "v": r.root + 1} for r in here], z.shape, "v"), naive.components(plane >= low))
            for root in {r.root for r in here}:
                ys, xs = np.array([(r.y, r.x) for r in here if r.root == root]).T
                row, v = table.pop((channel, level, root)), plane[ys, xs]
                assert root == min((y << 21) + x for y, x in zip(ys.tolist(), xs.tolist()))
                assert (row.n, row.top, row.y0, row.y1, row.x0, row.x1) == (len(ys), v.max(), ys.min(), ys.max(), xs.min(), xs.max())
                assert (row.y, row.x) == (pytest.approx(np.average(ys, weights=v)), pytest.approx(np.average(xs, weights=v)))
    assert not table


def test_small_rasters_are_dealt_to_all_partitions(spark):
    """Their few bytes used to be joined in one partition, with all of the labelling."""
    mask = spark.range(400).selectExpr("id % 40 as image_id", "cast(id % 7 as int) as y", "cast(id div 40 as int) as x", "1 as value")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        labels = components.label_components(mask, ["image_id"])
        counts = labels.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.countDistinct("image_id").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(counts) > 3 and sum(r.n for r in counts) == 40
