"""False-discovery control, placements and empirical p-values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import naive
from lumenfield.operators import background, enrichment, ranks

LABEL = "image_id bigint, y int, x int, object_id bigint"
SIGNAL = "image_id bigint, y int, x int, value double"
REAL = {"roi_dilation": 1, "occupied_dilation": 2, "inner": 18, "outer": 65}


def q_values(spark, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, p double")
    return [r.q for r in enrichment.adjust(rows).orderBy("i").collect()]


def test_known_values(spark):
    assert q_values(spark, [0.2, 0.001, 0.04, 0.01]) == pytest.approx([0.2, 0.004, 0.16 / 3, 0.02])


def test_missing_stays_missing(spark):
    assert q_values(spark, [0.001, None, 0.1]) == [pytest.approx(0.002), None, pytest.approx(0.1)]


def test_many_values_over_many_buckets(spark):
    rng = np.random.default_rng(0)
    p = np.concatenate([rng.random(400), rng.random(200) ** 6, np.full(50, 1.0), np.full(40, 1 / 4001)]).tolist()
    p[3] = None
    got, want = q_values(spark, p), naive.adjust(p)
    assert got[3] is None and [g for g in got if g is not None] == pytest.approx([w for w in want if w is not None], rel=1e-12)


def test_nulls_and_one_frequent_value_are_spread(spark):
    # nine of ten without p; half of the rest share one value
    rows = [(i, None if i % 10 else 0.5 if i % 20 else (i % 977 + 1) / 1000, i % 2) for i in range(40_000)]
    df = spark.createDataFrame(rows, "i int, p double, side int")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        for keys in ([], ["side"]):
            out = enrichment.adjust(df, "p", keys)
            got = {r.i: r.q for r in out.collect()}
            groups = [rows] if not keys else [[r for r in rows if r[2] == k] for k in (0, 1)]
            for part in groups:
                for r, want in zip(part, naive.adjust([r[1] for r in part])):
                    assert got[r[0]] == (want if want is None else pytest.approx(want))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_values_outside_the_unit_interval_are_refused(spark):
    for p in (-0.1, 1.5, float("inf")):
        with pytest.raises(Exception, match="p-values must lie in"):
            q_values(spark, [0.5, p])
    assert q_values(spark, [0.5, float("nan")])[0] == 0.5


def test_bucket_is_monotone(spark):
    values = sorted({*np.random.default_rng(1).random(3000).tolist(), 0.5, 0.25, 1.0, np.nextafter(0.5, 0), np.nextafter(0.5, 1), 1e-300})
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", ranks.magnitude_bucket(F.col("v")).alias("b")).orderBy("v").collect()
    assert all(a.b <= b.b for a, b in zip(rows, rows[1:]))


def measure(spark, labels, signal, **settings):
    lab = spark.createDataFrame([(1, int(y), int(x), int(labels[y, x])) for y, x in np.argwhere(labels)], LABEL)
    sig = spark.createDataFrame([(1, int(y), int(x), float(signal[y, x])) for y, x in np.argwhere(signal)], SIGNAL)
    objects = lab.select("image_id", "object_id").distinct()
    return background.empirical_p(objects, lab, sig, ["image_id"], labels.shape, **settings), lab, sig


def test_no_background_is_unscorable(spark):
    labels = np.ones((40, 50), int)
    measured, _, _ = measure(spark, labels, np.full((40, 50), 23.0), **REAL)
    row = measured.collect()[0]
    assert row.ebfp_shift_locations == 0 and not row.scorable and row.p is None and row.ebfp_status == "insufficient_null_locations"


def test_flat_signal_is_not_enriched(spark):
    labels = naive.disk((140, 160), (70, 80), 3).astype(int)
    row = measure(spark, labels, np.full(labels.shape, 23.0), **REAL)[0].collect()[0]
    assert row.ebfp_shift_locations > 100 and row.p == 1.0


def test_offset_changes_the_mean_not_p(spark):
    labels = naive.disk((140, 160), (70, 80), 3).astype(int)
    signal = np.where(labels > 0, 15.0, 0.0)
    a = measure(spark, labels, signal, **REAL)[0].collect()[0]
    b = measure(spark, labels, signal + 20, **REAL)[0].collect()[0]
    assert a.p == b.p < 0.001 and b.ebfp_mean - a.ebfp_mean == pytest.approx(20)


def test_placements_match_naive_over_tiles(spark):
    rng = np.random.default_rng(4)
    labels = np.zeros((90, 150), int)
    for i, (y, x) in enumerate([(10, 12), (14, 18), (60, 62), (63, 66), (44, 140), (80, 3)], 1):
        labels[naive.disk(labels.shape, (y, x), 2)] = i
    signal = rng.integers(0, 9, labels.shape).astype(float)
    _, lab, sig = measure(spark, labels, signal, **REAL)
    settings = {"roi_dilation": 1, "occupied_dilation": 2, "inner": 5, "outer": 14}
    roi = {}
    for r in background.signal_roi(lab, ["image_id"], 1, labels.shape).collect():
        roi.setdefault(r.object_id, []).append((r.y, r.x))
    got = {}
    for r in background.placements(lab, sig, ["image_id"], labels.shape, rows=True, **settings).collect():
        got.setdefault(r.object_id, {})[r.dy, r.dx] = r.null_sum
    for k, cells in roi.items():
        assert got.get(k, {}) == naive.placements(labels, signal, k, cells, 2, 5, 14, 1)


def test_overwritten_object_is_kept(spark):
    lab = spark.createDataFrame([(1, 5, 5, 1)], LABEL)
    objects = spark.createDataFrame([(1, 1), (1, 2)], "image_id bigint, object_id bigint")
    sig = spark.createDataFrame([(1, 5, 5, 3.0)], SIGNAL)
    rows = background.empirical_p(objects, lab, sig, ["image_id"], (20, 20), inner=2, outer=6, min_locations=5).orderBy("object_id").collect()
    assert [r.ebfp_status for r in rows] == ["scorable", "missing_object_mask"] and rows[1].ebfp_roi_pixels == 0


def test_numbering_by_time_stamps(spark):
    # a narrow range of large keys, one key for most rows, a NULL key
    rows = spark.range(5000).selectExpr("case when id % 7 = 0 then null when id % 5 = 0 then 'b' else 'a' end as k", "timestamp_micros(1700000000000000 + (id * 7919) % 5000) as t")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        got = ranks.numbered(rows, ["k"], [F.col("t")], "n")
        assert got.columns == ["k", "t", "n"]
        want = rows.withColumn("n", F.expr("cast(row_number() over (partition by k order by t) as bigint)"))
        assert got.exceptAll(want).isEmpty() and got.count() == 5000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_numbering_equals_plain_row_number(spark):
    rng = np.random.default_rng(7)
    rows = [("hot" if rng.random() < 0.6 else "cold", int(v)) for v in rng.permutation(2000)]
    df = spark.createDataFrame(rows, "k string, v bigint")
    got = {(r.k, r.v): r.n for r in ranks.numbered(df, ["k"], [F.col("v")], "n").collect()}
    for k in ("hot", "cold"):
        for n, v in enumerate(sorted(v for kk, v in rows if kk == k), 1):
            assert got[k, v] == n
