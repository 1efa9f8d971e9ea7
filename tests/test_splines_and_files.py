import json
import struct
import tempfile

import numpy as np
import pytest

from trackspark.operators import splines
from trackspark.sources import files
from trackspark.sources import messages as M


def test_basis_is_a_partition_of_unity_and_its_derivatives_sum_to_zero():
    knots = np.concatenate([[0.0] * 3, np.linspace(0, 10, 6), [10.0] * 3])
    t = np.linspace(0, 10, 41)
    assert np.allclose(splines.basis(knots, 3, t).sum(1), 1)
    for k in (1, 2, 3):
        assert np.allclose(splines.basis(knots, 3, t, k).sum(1), 0)
    b, d = splines.basis(knots, 3, t), splines.basis(knots, 3, t, 1)
    c = np.linalg.lstsq(b, t**3, rcond=None)[0]
    assert np.allclose(b @ c, t**3) and np.allclose(d @ c, 3 * t**2, atol=1e-6)


def test_spline_follows_smooth_motion():
    t = np.arange(0.0, 60.0)
    pos = np.stack([90 * t, 600 * np.sin(t / 18), 120 + 45 * np.cos(t / 16)], 1)
    vel = np.gradient(pos, t, axis=0)
    knots, c = splines.fit_spline(t, pos, vel, "accurate")
    assert np.sqrt(((splines.basis(knots, 3, t) @ c - pos) ** 2).sum(1).mean()) < 5


def test_constant_velocity_smoother_keeps_a_line():
    t = np.arange(20.0)
    pos = np.stack([80 * t, -3 * t, 500 + 0 * t], 1)
    s = splines.constant_velocity(t, pos, np.tile([80.0, -3, 0], (20, 1)))
    assert np.abs(s[:, :, 0] - pos).max() < 1e-3


def test_hermite_reproduces_cubics_and_goes_on_straight(spark):
    states = spark.createDataFrame([("a", float(t), float(t**3), float(3 * t * t)) for t in (0, 2, 5)], "k string, t double, x double, vx double")
    asked = spark.createDataFrame([("a", t) for t in (1.0, 3.5, 5.0, 6.0, -1.0)] + [("b", 1.0)], "k string, t double")
    got = {(r.k, r.t): r.x for r in splines.evaluate_hermite(states, asked, ["k"]).collect()}
    assert got[("a", 1.0)] == pytest.approx(1) and got[("a", 3.5)] == pytest.approx(3.5**3) and got[("a", 5.0)] == pytest.approx(125)
    assert got[("a", 6.0)] == pytest.approx(200) and got[("a", -1.0)] == pytest.approx(0) and got[("b", 1.0)] is None


def rule(track="t", first=0.0, last=1.0):
    return {"track_id": track, "icao": "ABC", "time_window": {"first_point_unix": first, "last_point_unix": last}, "boundary": {"value": 90, "unit": "km"}}


def written(rules):
    path = tempfile.mkdtemp(prefix="spark-") + "/rules.json"
    with open(path, "w") as f:
        json.dump({"rules": rules}, f)
    return path


def test_rules_are_checked(spark):
    r = files.read_rules(spark, written([rule("a"), rule("b")]))
    assert r.count() == 2
    assert files.select_rules(r, ["a"]).count() == 1 and files.select_rules(r.where("track_id = 'a'"), ["abc"]).count() == 1
    with pytest.warns(UserWarning, match="twice"):
        assert files.select_rules(r, ["a", "a"]).count() == 1
    with pytest.raises(Exception, match="several rules"):  # an address of two rules does not say which
        files.select_rules(r, ["abc"]).collect()
    for bad in ([rule("a") | {"outlier_multiplier": {"value": 3, "unit": "sigma"}}], [rule("a") | {"field_elevation": {"value": 3, "unit": "yd"}}], [rule("a", float("nan"), 1.0)]):
        with pytest.raises(Exception, match="invalid rule"):
            files.read_rules(spark, written(bad)).collect()
    for bad in ([rule("a"), rule("a")], [rule("a", 2, 1)], [rule("a") | {"boundary": {"value": 1, "unit": "mi"}}]):
        with pytest.raises(Exception, match="invalid rule"):
            files.read_rules(spark, written(bad)).collect()
    with pytest.raises(Exception, match="no rule"):
        files.select_rules(r, ["zz"]).collect()


def test_spool_records_are_rows_and_a_torn_one_is_left_out(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/spool.bin"
    with open(path, "wb") as f:
        for i in range(3):
            f.write(struct.pack(">I6sBBB", 100 + i, (7 + i).to_bytes(6, "big"), 5, 3, 4) + b"abcd")
        f.write(struct.pack(">I6sBBB", 1, bytes(6), 1, 1, 14) + b"x")
    got = sorted(files.read_spool(spark, path).collect(), key=lambda r: r.ts_utc)
    assert [(r.ts_utc, r.mlat48, bytes(r.payload)) for r in got] == [(100 + i, 7 + i, b"abcd") for i in range(3)]


def test_tracks_are_written_with_a_manifest(spark):
    df = spark.createDataFrame([("a", "m", 1.0), ("a", "n", 2.0), ("b", "m", 3.0)], "track_id string, method string, t double")
    path = tempfile.mkdtemp(prefix="spark-") + "/out"
    manifest = {r.track_id: r for r in files.write_tracks(df, path).collect()}
    assert manifest["a"].methods == ["m", "n"] and manifest["a"].t1 == 2.0 and spark.read.parquet(path).count() == 3


def test_columns_map_without_case(spark):
    df = spark.createDataFrame([("1.5", "x")], "Lat string, other string")
    assert M.map_columns(df, {"lat": "double", "lon": "double"}).collect()[0].asDict() == {"lat": 1.5, "lon": None}
    with pytest.raises(ValueError):
        M.map_columns(df, {"lon": "double"}, strict=True)


def test_keyframes_of_one_time_are_averaged(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/k.json"
    with open(path, "w") as f:
        json.dump({"keyframes": [{"t": 1, "x": 2, "s": "a"}, {"t": 1, "x": 4, "s": "a"}, {"x": 9}]}, f)
    got = files.read_keyframes_json(spark, path, "keyframes array<struct<t double, x double, s string>>").collect()
    assert [(r.t, r.x, r.s) for r in got] == [(1.0, 3.0, "a")]
