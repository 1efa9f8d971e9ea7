import numpy as np
from pyspark.sql import functions as F

from trackspark.functions import scalars as S
from trackspark.operators import features, smoothing
from trackspark.operators import timeseries as T


def test_to_finite_purges_what_is_no_number(spark):
    df = spark.createDataFrame([("1.5",), ("NaN",), ("inf",), ("x",), (None,)], "a string")
    assert [r[0] for r in df.select(S.to_finite(F.col("a"))).collect()] == [1.5, None, None, None, None]


def test_vertical_rate_reads_lists_and_names(spark):
    df = spark.createDataFrame([('{"velocity_raw":[1,2,-64,"GS"]}',), ('{"baro_rate":0,"rocd":128}',), ("{",), (None,)], "j string")
    assert [r[0] for r in df.select(S.vertical_rate_fpm(F.col("j"))).collect()] == [-64.0, 128.0, None, None]


def test_bucket_halves_go_to_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "t double")
    assert [r[0] for r in df.select(S.bucket_time(F.col("t"))).collect()] == [0.0, 2.0, 2.0]


def test_gap_at_the_threshold_does_not_split(spark):
    df = spark.createDataFrame([("a", float(t)) for t in (*range(10), 39, 70)], "k string, t double")
    got = [r.component for r in T.split_gaps(df, ["k"], "t", 30.0, 5.0).orderBy("t").collect()]
    assert got == [0] * 11 + [1]


def test_scale_of_equal_values_is_zero(spark):
    df = spark.createDataFrame([("a", 2.0)] * 3 + [("b", None)], "k string, v double")
    assert {r.k: r.scale for r in T.mad_scale(df, ["k"], "v").collect()} == {"a": 0.0, "b": 0.0}


def test_smoother_recovers_quadratic_motion():
    t = np.arange(46.0)
    pos = np.stack([92 * t, 0.35 * t * t, 750 + 0.08 * t * t], 1)
    vel = np.stack([np.full(46, 92.0), 0.7 * t, 0.16 * t], 1)
    s = smoothing.constant_acceleration(t, pos, vel, smoothing.PRESETS["accurate"])
    assert np.sqrt(((s[:, :, 0] - pos) ** 2).sum(1).mean()) < 2


def test_stabilized_runs_have_support(spark):
    rows = [("a", float(t), 100.0, 5.0 if t < 20 or t > 22 else 0.0, "climb" if t < 20 or t > 22 else "level") for t in range(40)]
    df = spark.createDataFrame(rows, "track_id string, t double, speed double, vz_smooth double, label string")
    got = features.stabilize_labels(df, 4, 6.0).collect()
    assert [(r.label, r.n) for r in got] == [("climb", 40)]


def test_checksum_of_an_intact_and_a_broken_frame(spark):
    from trackspark.operators import decode

    df = spark.createDataFrame([("8D4840D6202CC371C32CE0576098",), ("8D4840D6202CC371C32CE0576099",), ("",)], "payload_hex string")
    good, bad, none = [r[0] for r in df.select(decode.crc_remainder(F.col("payload_hex"))).collect()]
    assert good == 0 and bad != 0 and none is None
    assert [tuple(r) for r in decode.frame_header(df).select("df", "icao").collect()][:2] == [(17, "4840D6")] * 2


def test_selected_boundaries_keep_their_distance(spark):
    from trackspark.operators import segmentation

    rows = [("a", i, float(i), 80.0 + i, "climb") for i in (0, 3, 20, 25, 60)]
    df = spark.createDataFrame(rows, "track_id string, sample_index long, t double, score double, to_label string")
    got = sorted(r.sample_index for r in segmentation.select_boundaries(df).collect())
    assert got == [3, 25, 60]


def test_warping_of_equal_curves_is_free(spark):
    from trackspark.operators import evaluation

    rows = [("a", k, float(t), float(t * t), float(t)) for k in (0, 1) for t in range(30)] + [("b", 0, 0.0, 1.0, 1.0)]
    got = {r.track_id: r.dtw for r in evaluation.dtw_mean(spark.createDataFrame(rows, "track_id string, which int, t double, x double, y double")).collect()}
    assert got["a"] == 0 and got["b"] is None


def test_curve_distances_see_every_point_and_axis(spark):
    from trackspark.operators import evaluation, quality

    rng = np.random.default_rng(5)
    a, b = np.cumsum(rng.normal(size=(650, 3)), 0), np.cumsum(rng.normal(size=(600, 3)), 0)
    a[301] += 500  # one point, and an error that is vertical only, decide
    curves = {"far": (a, b), "up": (a, a + [0, 0, 40.0])}
    rows = [(k, w, float(t), *map(float, p)) for k, pair in curves.items() for w, c in enumerate(pair) for t, p in enumerate(c)]
    pairs = spark.createDataFrame(rows, "track_id string, which int, t double, x double, y double, z double")
    h = {r.track_id: r for r in evaluation.hausdorff(pairs).collect()}
    w = {r.track_id: r.dtw for r in evaluation.dtw_mean(pairs).collect()}
    f = {r.track_id: r.frechet for r in quality.frechet(pairs).collect()}
    for k, (x, y) in curves.items():
        d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
        there, back = d.min(1).max(), d.min(0).max()
        assert np.allclose([h[k].hausdorff, h[k].reverse, h[k].symmetric], [there, back, max(there, back)])
        warp, reach = np.full(d.shape, np.inf), np.full(d.shape, np.inf)
        for i in range(len(x)):
            for j in range(len(y)):
                before = [(p, q) for p, q in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if p >= 0 and q >= 0]
                warp[i, j] = d[i, j] + min((warp[p] for p in before), default=0)
                reach[i, j] = max(d[i, j], min((reach[p] for p in before), default=0))
        assert np.isclose(w[k], warp[-1, -1] / sum(d.shape)) and np.isclose(f[k], reach[-1, -1])


def test_flat_keyframes_tell_an_override_and_where_acceleration_comes_from(spark):
    """The field's elevation replaces altitudes inside the window on the ground, and what was reported stays readable."""
    from trackspark.operators import prepare

    columns = "raw_id long, track_id string, ts_utc double, lat double, lon double, alt double, gs double, track double, ve double, vn double, vz double, kind string, bucket double, field_ft double, ground_first double, ground_last double"
    rows = [
        (1, "A", 0.0, 57.0, 24.0, 90.0, 100.0, 90.0, 51.0, 0.0, 1.0, "position_velocity", 0.0, 36.0, 0.0, 1.0),
        (2, "A", 4.0, 57.0, 24.1, 136.0, 100.0, 90.0, 55.0, 3.0, None, "position_velocity", 4.0, 36.0, 0.0, 1.0),
        (3, "A", 5.0, 57.0, 24.1, None, None, None, None, None, None, "position", 5.0, 36.0, 0.0, 1.0),
        (4, "A", 30.0, None, None, None, 100.0, 90.0, 51.0, 0.0, 1.0, "velocity", 30.0, 36.0, 0.0, 1.0),
    ]
    flat = prepare.flatten_keyframes(prepare.build_keyframes(spark.createDataFrame(rows, columns)))
    a, b, c, e = flat.orderBy("t").collect()
    assert (a.alt_ft, a.alt_reported_ft, a.altitude_source, a.on_ground, a.height_m) == (36.0, 90.0, "field elevation", True, 0.0)
    assert (b.alt_ft, b.alt_reported_ft, b.altitude_source, b.on_ground) == (136.0, None, "reported", False)
    assert (c.altitude_source, c.height_shown_m, c.has_vertical, c.velocity_formed, c.acc_source) == ("missing", None, None, None, None)
    assert (e.altitude_source, e.on_ground, e.distance_km, e.position_formed) == (None, None, None, None)
    assert (a.acc_source, b.acc_source, e.acc_source) == ("first", "change of velocity", "too long")
    assert (b.acc_east, b.acc_north, b.acc_up, b.acc_horizontal, b.acc_size) == (1.0, 0.75, None, 1.25, 1.25)
    assert (a.n_velocity_3d, b.n_velocity_3d, a.row_ids, a.event_kinds) == (1, 0, "[1]", '["position_velocity"]')
    assert len(flat.columns) >= 50


def test_flat_keyframes_of_an_empty_table(spark):
    from trackspark.operators import prepare

    columns = "raw_id long, track_id string, ts_utc double, lat double, lon double, alt double, gs double, track double, ve double, vn double, vz double, kind string, bucket double, field_ft double"
    assert prepare.flatten_keyframes(prepare.build_keyframes(spark.createDataFrame([], columns))).count() == 0
