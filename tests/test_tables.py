"""Roll-ups, review bounds, manifests, ids, audits, array files, streams and whole runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import naive
from lumenfield import analyze, configuration, save_run, verify_run
from lumenfield.operators import raster, review, rollups
from lumenfield.sources import arrays, audits, manifest
from lumenfield.streaming import jobs

OBJ = "image_id string, object_id bigint, status string, provided boolean, scorable boolean, detected boolean"
FIELDS = "image_id string, replicate_id string, h int, w int, dy double, dx double, ebfp_provided boolean"


def test_replicates_pool_counts_before_percentages(spark):
    rows = [("a", i, "live_only" if i == 0 else "dead_only", True, True, False) for i in range(10)]
    rows += [("b", i, "dead_only" if i == 0 else "live_only", True, True, False) for i in range(10)] + [("c", 0, "live_only", True, True, False)]
    fields = spark.createDataFrame([(i, r, 10, 10, 1.0, 1.0, True) for i, r in (("a", "gel1"), ("b", "gel1"), ("c", "gel2"), ("d", "gel2"))], FIELDS)
    objects = spark.createDataFrame(rows, OBJ)
    summary = rollups.replicate_summary(fields, objects)
    assert {r.replicate_id: r.viability_percent for r in summary.collect()} == {"gel1": 50.0, "gel2": 100.0}
    stats = {r.metric: r for r in rollups.replicate_stats(summary).collect()}["viability_percent"]
    assert stats["mean"] == 75.0 and stats.sample_sd == pytest.approx(np.std([50, 100], ddof=1))
    empty = rollups.field_summary(fields, objects).filter("image_id = 'd'").collect()[0]
    assert empty.total == 0 and empty.viability_percent is None


def test_unscorable_objects_leave_only_the_signal_denominator(spark):
    rows = [("a", 1, "live_only", True, True, True), ("a", 2, "live_only", True, False, None), ("a", 3, "dead_only", True, True, False)]
    r = rollups.count_summary(spark.createDataFrame(rows, OBJ), ["image_id"]).collect()[0]
    assert (r.ebfp_all_percent, r.ebfp_live_percent, r.ebfp_all_unscorable) == (50.0, 100.0, 1)
    assert r.viability_percent == pytest.approx(200 / 3)


CASES = [
    # groups (green, red), decisions, live range, total range, viability range, point
    ([(1, 0), (0, 1), (1, 1)], {}, (1, 2), (3, 4), (100 / 3, 50.0), None),
    ([(1, 1)], {1: ("same_cell", 0)}, (0, 0), (1, 1), (0.0, 0.0), 0.0),
    ([(1, 1)], {1: ("separate", 0)}, (1, 1), (2, 2), (50.0, 50.0), 50.0),
    ([(1, 1), (1, 1), (1, 1)], {1: ("same_cell", 0), 2: ("uncertain", 0)}, (0, 2), (3, 5), (0.0, 40.0), None),
    ([(1, 2)], {}, (0, 1), (2, 3), (0.0, 100 / 3), None),
    ([(2, 3)], {1: ("pairs", 1)}, (1, 1), (4, 4), (25.0, 25.0), 25.0),
]


@pytest.mark.parametrize("groups,decisions,live,total,viability,point", CASES)
def test_bounds(spark, groups, decisions, live, total, viability, point):
    g = spark.createDataFrame([("f", i, a, b) for i, (a, b) in enumerate(groups, 1)], "image_id string, object_id bigint, n_green bigint, n_red bigint")
    g = g.withColumn("status", review.group_status(F.col("n_green"), F.col("n_red"), F.lit(True)))
    d = spark.createDataFrame([("f", k, name, n) for k, (name, n) in decisions.items()], "image_id string, object_id bigint, decision string, n_pairs bigint")
    r = review.viability_bounds(g, d).collect()[0]
    assert (r.live_min, r.live_max) == live and (r.total_min, r.total_max) == total
    assert (r.viability_min_pct, r.viability_max_pct) == pytest.approx(viability)
    assert r.viability_pct == (pytest.approx(point) if point is not None else None)


def sequential_ids(ids):
    taken, out = set(), []
    for name in ids:
        unique, n = name, 2
        while unique.lower() in taken:
            unique, n = f"{name}_{n}", n + 1
        taken.add(unique.lower())
        out.append(unique)
    return out


@pytest.mark.parametrize("ids", [
    ["a", "A", "a", "b"], ["a", "a_2", "a", "a"], ["a", "a", "a_2", "a", "a_2"], ["a_3", "a", "a", "a", "a_2", "a"],
    ["a_2", "a_2", "a", "a", "a_2_2", "a", "a_3", "a"], ["a", "a", "a_2", "a_2_2", "a_2", "a_2"],
])
def test_unique_ids_equal_sequential_append(spark, ids):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(ids, 1)], "seq bigint, image_id string")
    got = [r.unique_id for r in manifest.assign_unique_ids(rows, "image_id", "seq").orderBy("seq").collect()]
    assert got == sequential_ids(ids)


def test_unique_ids_random(spark):
    rng = np.random.default_rng(11)
    ids = [str(rng.choice(["a", "A_2", "a_2", "a_3", "b", "a_2_2", "a_4", "b_2"])) for _ in range(60)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(ids, 1)], "seq bigint, image_id string")
    got = [r.unique_id for r in manifest.assign_unique_ids(rows, "image_id", "seq").orderBy("seq").collect()]
    assert got == sequential_ids(ids)


def test_a_stem_with_many_literal_children(spark):
    ids = ["a"] * 40 + [f"a_{n}" for n in range(1000, 1, -1)] + ["a"] * 700 + ["a_99999999999999999999", "a_123456789012", "A"]
    rows = spark.createDataFrame([(1_700_000_000_000_000 + i, v) for i, v in enumerate(ids)], "seq bigint, image_id string")
    spark.sparkContext.setJobGroup("ids", "numbering")
    got = [r.unique_id for r in manifest.assign_unique_ids(rows, "image_id", "seq").orderBy("seq").collect()]
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("ids")
    spark.sparkContext.setJobGroup("tests", "")
    assert got == sequential_ids(ids)
    # whatever the number of children: two sweeps, and the stages of three running totals
    assert len(jobs) < 60


def test_median_is_exact(spark):
    rng = np.random.default_rng(2)
    for values in ([], [None], [3.0], [1.0, 4.0], [7.0] * 50 + [1.0], rng.normal(size=301).round(1).tolist(), (rng.random(200) * 1e18).tolist()):
        table = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        known = [v for v in values if v is not None]
        assert rollups.median(table, "v") == (pytest.approx(np.median(known), rel=1e-15) if known else None)


def test_manifest_scan(spark, tmp_path):
    path = tmp_path / "samples.csv"
    path.write_text("﻿image_id,replicate_id,red,green\n f1 ,r1, img/r.npy ,/abs/g.npy\nf2,r1,,x.npy\n", encoding="utf-8")
    rows = manifest.scan_manifest(spark, str(path)).orderBy("image_id").collect()
    assert rows[0].image_id == "f1" and rows[0].red.endswith(f"{tmp_path}/img/r.npy") and rows[0].green == "/abs/g.npy" and rows[0].ebfp is None
    assert rows[1].red is None
    path.write_text("image_id,green\nf1,x\n")
    with pytest.raises(ValueError, match="replicate_id"):
        manifest.scan_manifest(spark, str(path))


def test_array_files(spark, tmp_path):
    rng = np.random.default_rng(5)
    arrays_ = {
        "a": np.zeros((2, 3, 4), np.uint16), "b": np.eye(3, dtype=np.uint8), "zero": np.zeros((4, 5), np.uint8), "big": rng.integers(0, 3, (7, 9, 11)).astype(">u2"),
        "fortran": np.asfortranarray(rng.integers(0, 3, (4, 5, 6)).astype(np.uint8)), "flat": np.asfortranarray(rng.integers(0, 3, (4, 5)).astype(np.uint16)),
    }
    arrays_["a"][1, 2, 3] = 999
    (tmp_path / "in/deeper").mkdir(parents=True)
    for name, array in arrays_.items():
        np.save(tmp_path / f"in/deeper/{name}.npy", array)
    for budget in (1, 50, 1 << 20):
        got = arrays.scan_arrays(spark, str(tmp_path / "in"), budget).collect()
        for name, array in arrays_.items():
            volume = array if array.ndim == 3 else array[None]
            mine = [(r.z, r.y, r.x, r.value) for r in got if r.path.endswith(f"/{name}.npy")]
            assert sorted(mine) == [(*map(int, p), int(volume[tuple(p)])) for p in np.argwhere(volume)]
    heads = {r.path.rsplit("/", 1)[1]: tuple(r.shape) for r in arrays.array_headers(spark, str(tmp_path / "in")).collect()}
    assert heads == {f"{name}.npy": array.shape for name, array in arrays_.items()}


@pytest.mark.parametrize("array", [np.zeros(3, np.uint8), np.zeros((2, 2), np.int32), np.zeros((0, 2), np.uint8), np.array([["a"]], object)])
def test_other_array_files_are_refused(spark, tmp_path, array):
    np.save(tmp_path / "x.npy", array, allow_pickle=True)
    with pytest.raises(Exception, match="expected a nonempty uint8/uint16 plane or volume"):
        arrays.scan_arrays(spark, str(tmp_path)).collect()


def test_a_cut_array_file_is_refused(spark, tmp_path):
    np.save(tmp_path / "x.npy", np.ones((30, 30), np.uint8))
    whole = (tmp_path / "x.npy").read_bytes()
    (tmp_path / "x.npy").write_bytes(whole[:-1])
    with pytest.raises(Exception, match="do not hold the array"):
        arrays.scan_arrays(spark, str(tmp_path)).collect()


def test_a_volume_is_read_by_ranges(spark, tmp_path):
    # sparse file: 3 GB of zeros but for its last planes
    volume = np.lib.format.open_memmap(tmp_path / "v.npy", "w+", np.uint16, (1500, 1024, 1024))
    volume[-1, 5, 6], volume[700, 0, 1023] = 7, 9
    volume.flush()
    del volume
    got = arrays.scan_arrays(spark, str(tmp_path)).collect()
    assert sorted((r.z, r.y, r.x, r.value) for r in got) == [(700, 0, 1023, 9), (1499, 5, 6, 7)]


def test_sinks_refuse_existing_targets(spark, tmp_path):
    df = spark.range(3)
    audits.write_table(df, str(tmp_path / "t"))
    with pytest.raises(Exception, match="already exists"):
        audits.write_table(df, str(tmp_path / "t"))


def test_stream_equals_batch_over_many_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(1, int(z), int(y), int(x), int(v)) for z, y, x, v in zip(*[rng.integers(0, 6, 300) for _ in range(3)], rng.integers(1, 99, 300))]
    planes = spark.createDataFrame(rows, "image_id bigint, z int, y int, x int, value int")
    planes.repartition(6, "z").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(planes.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = jobs.stream_projection(stream, ["image_id"], str(tmp_path / "out"), str(tmp_path / "cp"))
    want = planes.groupBy("image_id", "y", "x").agg(F.max("value").alias("value"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_stream_publishes_each_field_once(spark, tmp_path):
    for i in range(3):
        rows = [(k, f"2024-01-0{i + 1} 0{k}:00:00") for k in range(i, i + 4)]
        spark.createDataFrame(rows, "field int, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("field int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = jobs.stream_new_fields(stream, ["field"], str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.field for r in got.collect()) == list(range(6))


def test_stream_publishes_a_new_field_however_late(spark, tmp_path):
    days = [("2024-01-05", [1, 2]), ("2024-01-06", [2, 3]), ("2024-01-01", [1, 9]), ("2024-01-07", [1, 3])]
    for i, (day, fields) in enumerate(days):
        rows = [(k, f"{day} 00:00:00") for k in fields]
        spark.createDataFrame(rows, "field int, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("field int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = jobs.stream_new_fields(stream, ["field"], str(tmp_path / "out"), str(tmp_path / "cp"))
    assert got.columns == ["fingerprint", "field"] and sorted(r.field for r in got.collect()) == [1, 2, 3, 9]


def test_planes_without_a_pixel_are_measured(spark):
    planes = spark.createDataFrame([(1, "green"), (1, "red"), (2, "green")], "image_id int, channel string")
    px = spark.createDataFrame([(1, "green", 0, 0, 255), (1, "green", 0, 1, 3), (2, "green", 0, 0, 0)], "image_id int, channel string, y int, x int, value int")
    keys = ["image_id", "channel"]
    by = lambda df: {(r.image_id, r.channel): tuple(r)[2:] for r in df.collect()}
    assert by(raster.raster_profile(px, keys, 4, planes=planes)) == {(1, "green"): (0, 255, 0.5, 1), (1, "red"): (0, 0, 1.0, 0), (2, "green"): (0, 0, 1.0, 0)}
    assert by(raster.top_levels(px, keys, 4, planes=planes).filter("position = 1"))[1, "red"] == (0, 4, 1, 100.0)
    assert by(raster.intensity_diagnostics(px, keys, 4, [50, 100], planes))[1, "red"] == (1, 0.0, 0.0)
    assert by(raster.suggest_thresholds(px, keys, (1, 2, 2), 255, (1.0, 1.0, 1.0), planes)).keys() == {(1, "green"), (1, "red"), (2, "green")}
    assert by(raster.histogram(px, keys, 4))[2, "green"] == (0, 4)
    frames = planes.selectExpr("*", "2 as h", "2 as w", "255 as value_max")
    assert {k: v[-1] for k, v in by(raster.raster_contract(px, frames)).items()} == {(1, "green"): "ok", (1, "red"): "ok", (2, "green"): "ok", (2, "red"): "missing"}
    assert by(raster.raster_contract(px, frames.filter("image_id = 2")))[1, "green"] == (2, "undeclared")


def test_whole_run_with_and_without_signal(spark, tmp_path):
    shape = (140, 150)
    green = sum(90 * np.exp(-((np.mgrid[:140, :150][0] - y) ** 2 + (np.mgrid[:140, :150][1] - x) ** 2) / 18) for y, x in ((70, 60), (70, 100)))
    red = 60 * np.exp(-((np.mgrid[:140, :150][0] - 70) ** 2 + (np.mgrid[:140, :150][1] - 101) ** 2) / 18)
    rows = []
    for image in (1, 2):
        rows += naive.pixels(np.round(green), image, "green") + naive.pixels(np.round(red), image, "red")
    px = spark.createDataFrame(rows, "image_id bigint, channel string, y int, x int, value double").withColumn("value", F.col("value").cast("int"))
    spot = naive.disk(shape, (70, 60), 2) * 20
    signal = spark.createDataFrame([(1, int(y), int(x), int(spot[y, x])) for y, x in np.argwhere(spot)], "image_id bigint, y int, x int, value int")
    fields = spark.createDataFrame([(1, "r1", *shape, 1.0, 1.0, True), (2, "r2", *shape, 1.0, 1.0, False)], FIELDS.replace("image_id string", "image_id bigint"))
    config = configuration(input={"shape": shape, "pixel_size_um": (1.0, 1.0)})
    tables = analyze(px, fields, config, signal)
    objects = {(r.image_id, r.object_id): r for r in tables["objects"].collect()}
    assert {k: r.status for k, r in objects.items()} == {(i, j): s for i in (1, 2) for j, s in ((1, "live_only"), (2, "double_positive"))}
    assert objects[1, 1].detected is True and objects[1, 2].detected is False
    assert objects[2, 1].p is None and objects[2, 1].detected is None and objects[2, 1].ebfp_status == "channel_not_provided"
    assert {r.rule for r in tables["warnings"].collect()} == {"unscorable", "channel_not_provided"}
    save_run(spark, {k: tables[k] for k in ("objects", "field_summary")}, str(tmp_path / "run"))
    assert {r.status for r in verify_run(spark, str(tmp_path / "run")).collect()} == {"ok"}
    plain = analyze(px, fields, config)
    assert plain["objects"].filter("scorable").isEmpty() and plain["objects"].count() == 4


def test_manifest_cells_keep_quotes_and_lose_white_space(spark, tmp_path):
    from lumenfield.sources.manifest import scan_manifest

    path = tmp_path / "m.csv"
    path.write_text('image_id,replicate_id,green,red\n"a","r1","/x ""q"".npy","\t"\n')
    row = scan_manifest(spark, str(path)).first()
    assert row["green"] == '/x "q".npy' and row["red"] is None


def test_repeated_keys_are_named_whatever_the_order(spark):
    left = [("a", "1"), ("b", "2"), ("b", "3"), ("c", "4"), ("d", "5"), ("d", "5"), (None, "6")]
    right = [("a", "1"), ("b", "2"), ("c", "5"), ("c", "4"), ("e", "7"), (None, "8")]
    want = {("a", "ok"), ("b", "duplicate_key"), ("c", "duplicate_key"), ("d", "duplicate_key"), ("e", "unexpected"), (None, "changed")}
    for turn in (1, -1):
        sides = [spark.createDataFrame(rows[::turn], "path string, sha string").repartition(3) for rows in (left, right)]
        assert {tuple(r) for r in audits.verify_digests(*sides, "path").collect()} == want
        cells = audits.golden_diff(*sides, ["path"], [], ["sha"]).collect()
        assert {tuple(r) for r in cells} == {(k, {"changed": "sha", "unexpected": "row_missing"}.get(w, w)) for k, w in want if w != "ok"} and len(cells) == 5


def test_stream_tables_stay_compact_over_restarts(spark, tmp_path):
    rng = np.random.default_rng(6)
    seen, every = {}, 3
    source, folder = tmp_path / "in", tmp_path / "out"
    merge = lambda rows: rows.groupBy("k").agg(F.max("v").alias("v"))
    table = jobs.Snapshots(spark, str(folder), spark.createDataFrame([], "k int, v int").schema, merge, every)
    for number in range(11):
        rows = [(int(k), int(v)) for k, v in rng.integers(0, 30, (8, 2))]
        for k, v in rows:
            seen[k] = max(v, seen.get(k, v))
        batch = spark.createDataFrame(rows, "k int, v int")
        table.add(merge(batch), number)
        if number % 4 != 1:
            # replayed after a restart, by a new object
            table = jobs.Snapshots(spark, str(folder), batch.schema, merge, every)
            table.add(merge(batch), number)
        assert {r.k: r.v for r in table.read().collect()} == seen
        assert len(list(folder.glob("_kind=*/_slot=*"))) <= every + 3
    # the same through a stream that is stopped and started again
    for turn in range(2):
        for i in range(10):
            spark.createDataFrame([(turn * 10 + i % 4, i)], "k int, v int").coalesce(1).write.parquet(str(source / f"{turn}-{i}"))
        stream = spark.readStream.schema("k int, v int").option("maxFilesPerTrigger", 1).parquet(str(source / "*"))
        got = jobs.keep(stream, merge, str(tmp_path / "kept"), str(tmp_path / "cp"))
    assert {r.k: r.v for r in got.collect()} == {0: 8, 1: 9, 2: 6, 3: 7, 10: 8, 11: 9, 12: 6, 13: 7}
    assert len(list((tmp_path / "kept").glob("_kind=*/_slot=*"))) <= jobs.EVERY + 3


def test_manifest_rules_about_files(spark, tmp_path):
    schema = "image_id string, replicate_id string, green string, red string, ebfp string"
    assert [tuple(r) for r in manifest.violations(spark.createDataFrame([], schema)).collect()] == [(None, "empty_manifest", None)]
    (tmp_path / "img").mkdir()
    for name in ("g.npy", "r.npy"):
        (tmp_path / "img" / name).write_bytes(b"x")
    here = f"file:{tmp_path}"
    rows = [("a", "r", f"{here}/img/g.npy", f"{here}/img/./x/../r.npy", None), ("b", "r", f"{here}//img/r.npy", f"{here}/img/no.npy", " ")]
    got = manifest.violations(spark.createDataFrame(rows, schema), manifest.existing_files(spark, str(tmp_path))).collect()
    assert {tuple(r) for r in got} == {("a", "reused_path", f"{here}/img/r.npy"), ("b", "missing_file", f"{here}/img/no.npy")}
    paths = [("/a/../b", "/b"), ("/../a", "/a"), ("../a/./..", ".."), ("../../a", "../../a"), ("a//b/", "a/b"), ("./x", "x")]
    out = spark.createDataFrame(paths, "p string, want string").select(manifest.resolved(F.col("p")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in out)


def test_members_are_dealt_by_their_number(spark):
    rows = [("F1", i, "unresolved", f"{i};{i + 1000}" if i % 3 else "7;7", "5" if i == 4 else f"{i}") for i in range(40)]
    rows += [("F2", 1, "green_only", "7", ""), ("F2", 1, "green_only", "7", ""), ("F2", None, "green_only", "9", ""), ("F2", 3, "green_only", "9", "")]
    groups = spark.createDataFrame(rows, "image_id string, object_id bigint, status string, green_ids string, red_ids string")
    out = review.membership_violations(groups, per_task=5)
    got = sorted((r.image_id, r.object_id) for r in out.collect() if r.rule == "member_in_two_groups")
    # G7 in every third group, R5 in the groups 4 and 5; the repeated row of F2 is one group
    assert got == [("F1", 0), ("F1", 4), ("F2", 3)]
    # one task a shuffle partition held the members of ever more groups
    assert "member#" in (plan := out._jdf.queryExecution().toString()) and ", 9), REPARTITION_BY_NUM" in plan
