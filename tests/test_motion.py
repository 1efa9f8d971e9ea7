"""Regimes, fits, renders, comparison and decoding against plain numpy, public example frames and synthetic motions."""

import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackspark.functions import scalars as S
from trackspark.operators import compare, decode, fits, prepare, quality, regimes, render, segment_scores
from trackspark.operators import timeseries as T
from trackspark.plans.complete_queries import staged
from trackspark.sources import files

NAMES = ["x", "y", "z", "vx", "vy", "vz"]


def frame(spark, tracks):
    """{track: (t, pos)} -> samples with velocities of the curve."""
    parts = []
    for name, (t, pos) in tracks.items():
        vel = np.gradient(pos, t, axis=0)
        parts.append(pd.DataFrame({"track_id": name, "i": np.arange(len(t)), "t": t} | {c: np.c_[pos, vel][:, k] for k, c in enumerate(NAMES)}))
    return spark.createDataFrame(pd.concat(parts))


def course(heading, speed=80.0, z=600.0, n=None):
    """Positions of a constant speed along headings (mathematical angles, one a second) and heights."""
    h = np.asarray(heading, float)
    step = speed * np.stack([np.cos(h), np.sin(h)], 1)
    return np.c_[np.vstack([[0, 0], np.cumsum(step[:-1], 0)]), np.broadcast_to(z, len(h))]


@pytest.fixture(scope="module")
def segmented(spark):
    t = np.arange(160.0)
    rng = np.random.default_rng(0)
    turn = np.cumsum(np.where((t > 60) & (t <= 90), np.radians(3.0), 0.0))
    climb = np.where(t < 60, 600.0, 600 + 6 * np.minimum(t - 60, 40))
    lobe = 600 + np.where(t < 85, 4 * np.clip(t - 45, 0, 40), 160 - 4 * np.clip(t - 85, 0, 40))
    tracks = {
        "turn": (t, course(turn)), "jitter": (t, course(rng.normal(0, 0.002, 160))), "climb": (t, course(0 * t, z=climb)), "lobe": (t, course(0 * t, z=lobe)),
        "gap": (np.r_[t[:60], t[60:] + 90], course(0 * t)),
    }
    s = frame(spark, tracks)
    rows = staged(regimes.component_rows(s), "rows")
    f = staged(regimes.motion_features(rows), "features")
    labels = staged(regimes.regime_labels(regimes.raw_labels(f)), "labels")
    bands = staged(regimes.adaptive_deadbands(f), "bands")
    c = staged(regimes.union_candidates(regimes.transition_candidates(labels, f, kinds=("energy", "turn")), regimes.go_around_candidates(f, bands), regimes.vertical_reversal_candidates(f, bands), regimes.altitude_lobe_candidates(f, bands)), "candidates")
    b = staged(regimes.select_boundaries(c, rows), "boundaries")
    return {"rows": rows, "features": f, "labels": labels, "candidates": c, "boundaries": b, "segments": staged(regimes.build_segments(rows, b), "segments")}


def test_segmentation_of_synthetic_motions(segmented):
    b, seg, lab, c = (segmented[k].toPandas() for k in ("boundaries", "segments", "labels", "candidates"))
    assert len(b[b.track_id == "turn"]) >= 2 and lab[lab.track_id == "turn"].turn.str.startswith("turn_left").any()
    assert len(seg[seg.track_id == "jitter"]) == 1
    assert (abs(b[b.track_id == "climb"].i - 60) <= 6).any() and (lab[lab.track_id == "climb"].energy == "climb").sum() >= 30
    near = c[(c.track_id == "lobe") & c.reasons.map(lambda r: "altitude_lobe_transition" in r)]
    assert len(near) and (abs(near.i - 85) <= 6).any() and (abs(b[b.track_id == "lobe"].i - 85) <= 6).any()
    assert sorted(seg[seg.track_id == "gap"].component.unique()) == [0, 1]
    for _, g in seg.groupby(["track_id", "component"]):  # segments tile a component and share their ends
        g = g.sort_values("segment")
        assert (g["first"].to_numpy()[1:] == g["last"].to_numpy()[:-1]).all() and g["first"].iloc[0] == 0
        assert (g["last"] - g["first"] + 1 >= 8).all() or len(g) == 1


def test_segment_features_and_policies(segmented, spark):
    f = staged(regimes.segment_features(segmented["features"], segmented["labels"], segmented["segments"]), "sf")
    p = fits.select_params(f).toPandas()
    assert set(p.policy) <= set(fits.POLICY) and (p[p.regime_label.str.contains("turn_")].policy == "transition").all()
    assert abs(f.where("track_id = 'turn'").agg(F.sum("heading_change")).first()[0] - np.pi / 2) < 0.1, "the whole turn, over its segments"
    grid = fits.candidate_grid(fits.select_params(f))
    assert grid.groupBy(*fits.SEGMENT).count().agg(F.max("count")).first()[0] <= 17


def test_boundary_selection_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    n = 90
    rows = spark.createDataFrame([("a", 0, i, float(i)) for i in range(n)], "track_id string, component int, i long, t double")
    at = sorted(rng.choice(np.arange(5, 85), 9, replace=False).tolist())
    score = rng.uniform(10, 100, 9)
    c = spark.createDataFrame([("a", 0, int(i), float(i), float(s), ["x"]) for i, s in zip(at, score, strict=True)], "track_id string, component int, i long, t double, score double, reasons array<string>")
    got = {r.i for r in regimes.select_boundaries(c, rows).collect()}
    best = (0.0, set())
    for mask in range(1 << 9):
        own = [k for k in range(9) if mask >> k & 1]
        cuts = [0, *(at[k] for k in own), n - 1]
        if all(b - a >= 15 and b - a + 1 >= 8 for a, b in zip(cuts, cuts[1:], strict=False)):
            best = max(best, (sum(score[k] - 0.01 for k in own), {at[k] for k in own}), key=lambda x: x[0])
    assert got == best[1]


def test_change_points_and_label_helpers():
    x = np.r_[np.zeros(30), np.full(40, 5.0), np.full(30, -2.0)][:, None] + np.random.default_rng(3).normal(0, 0.1, (100, 1))
    assert regimes.change_points(x, 5.0, 5) == [30, 70]
    t = np.arange(12.0)
    lab = np.array(list("aaaabaaaaccc"), object)
    assert "".join(regimes.stabilized(lab, t, (2, 1.0))) == "aaaaaaaaaccc"
    turn = np.array(["turn_left_slow"] * 4 + ["straight"] * 2 + ["turn_left_medium"] * 6, object)
    assert (regimes.bridged(turn, t, 3, 5.0)[4:6] == "turn_left_slow").all()
    assert (regimes.without_weak_turns(turn, 0.001 * t, t, 0.2, 1.0) == "straight").all()


def smooth_curve(n=60):
    t = np.arange(float(n))
    pos = np.stack([90 * t, 600 * np.sin(t / 18), 120 + 45 * np.cos(t / 16)], 1)
    return t, pos, np.gradient(pos, t, axis=0)


@pytest.mark.parametrize("method", ["piecewise_accurate", "quintic_balanced", "join_smooth_smooth"])
def test_anchors_are_met_and_acceleration_is_continuous(method):
    t, pos, vel = smooth_curve()
    cfg = fits.variants()[method]
    anchors = [{"t": 0.0, "p": pos[0]}, {"t": 30.0, "p": pos[30] + [15, -10, 5]}, {"t": 59.0, "p": pos[-1]}]
    fit = fits.solve_bspline(t, pos, vel, cfg, anchors, (0.0, 59.0)) | {"family": "bspline"}
    assert fit["anchor_error"] < 1e-7
    fine = np.linspace(0, 59, 2000)
    acc = fits.evaluate_fit(fit, fine)[:, 2]
    assert np.isfinite(acc).all() and np.abs(np.diff(acc, axis=0)).max() < 0.2 * max(np.abs(acc).max(), 1)


def test_hermite_equals_a_dense_solution_and_leave_one_out():
    t, pos, vel = smooth_curve(14)
    cfg = fits.Config(family="hermite", velocity=0.02, eta=6e4, anchored=False)
    fit = fits.solve_hermite(t, pos, vel, cfg)
    lam, _ = fits.interval_weights(t, pos, cfg)
    gamma = cfg.velocity * fits.velocity_scale(t, pos, vel)
    n = len(t)
    k = np.diag(np.stack([np.ones(n), gamma], 1).ravel())
    gauss, weight = np.polynomial.legendre.leggauss(4)
    for i in range(n - 1):
        h = t[i + 1] - t[i]
        u = (gauss + 1) / 2
        b = np.stack([(12 * u - 6) / h**2, (6 * u - 4) / h, (6 - 12 * u) / h**2, (6 * u - 2) / h], 1)
        k[2 * i : 2 * i + 4, 2 * i : 2 * i + 4] += n * lam[i] * (b * (weight * h / 2)[:, None]).T @ b
    d = np.stack([np.ones(n), gamma], 1).ravel()
    want = np.linalg.solve(k, d[:, None] * np.stack([pos, vel], 1).reshape(2 * n, 3))
    got = np.stack([fit["cx"], fit["cy"], fit["cz"]], 1)
    assert np.allclose(got, want, atol=1e-6)
    den = 1 - np.diag(np.linalg.inv(k)) * d
    scaled = (want - np.stack([pos, vel], 1).reshape(2 * n, 3)) / den[:, None]
    assert np.isclose(fit["loocv"], (d[:, None] * scaled**2).sum() / (3 * n), rtol=1e-6)
    held = fits.solve_hermite(t, pos, vel, fits.Config(family="hermite", velocity=0.02, eta=6e4), [{"t": 0.0, "p": pos[0] + 7, "v": vel[0]}, {"t": 13.0, "p": pos[-1] - 7}]) | {"family": "hermite"}
    ends = fits.evaluate_fit(held, np.array([0.0, 13.0]))
    assert np.allclose(ends[0, 0], pos[0] + 7) and np.allclose(ends[0, 1], vel[0]) and np.allclose(ends[1, 0], pos[-1] - 7)


def test_fits_render_and_hold_out(spark, segmented):
    rows = staged(regimes.in_segments(segmented["rows"], segmented["segments"]).where("track_id in ('turn', 'climb')"), "seg")
    states = staged(fits.boundary_states(segmented["rows"], segmented["boundaries"]), "states")
    f = staged(fits.fit_segments(rows, ["piecewise_balanced", "hermite_balanced"], states), "fits")
    assert f.where("error is not null").count() == 0 and f.agg(F.max("rmse")).first()[0] < 40
    frames = fits.render_fits(f, 0.5).toPandas()
    assert not frames.duplicated(["track_id", "method", "t"]).any() and frames[NAMES].notna().all().all()
    jumps = fits.verify_continuity(f).toPandas()
    assert len(jumps) and jumps[jumps.method == "piecewise_balanced"].jump_p.max() < 1e-6
    held = fits.holdout_rows(rows).toPandas()
    assert held.held_out.any() and not held.groupby(fits.SEGMENT).held_out.agg(["first", "last"]).any().any()
    assert fits.holdout_rollup(fits.segment_holdout(rows)).count() == 2
    with pytest.raises(ValueError):
        fits.fit_segments(rows, ["nothing"])
    assert fits.method_name("cubic_position") == "piecewise_accurate"


def test_overlap_does_not_cross_a_discontinuity(spark):
    rows = spark.createDataFrame([("a", 0, i, float(i)) for i in range(60)], "track_id string, component int, i long, t double")
    seg = spark.createDataFrame([("a", 0, 0, 0, 20), ("a", 0, 1, 20, 40), ("a", 0, 2, 40, 59)], "track_id string, component int, segment long, first long, last long")
    hard = spark.createDataFrame([("a", 0, 20)], "track_id string, component int, i long")
    got = fits.overlapping(rows, seg, 5.0, hard).groupBy("segment").agg(F.min("i").alias("a"), F.max("i").alias("b")).orderBy("segment").collect()
    assert [(r.a, r.b) for r in got] == [(0, 20), (20, 45), (35, 59)]


def test_quintic_states_reproduce_polynomials(spark):
    p = np.poly1d([1e-5, -2e-3, 0.05, 1.0, 3.0, -7.0])
    rows = [("a", float(t), *[float(p.deriv(k)(t)) if k else float(p(t)) for k in (0, 1, 2) for _ in "xyz"]) for t in (0, 3, 7, 12)]
    states = spark.createDataFrame(rows, "track_id string, t double, " + ", ".join(f"{k}{c} double" for k in ("", "v", "a") for c in "xyz"))
    asked = spark.createDataFrame([("a", float(t)) for t in (0.0, 1.5, 3.0, 6.9, 12.0, 14.0, -1.0)], "track_id string, t double")
    for r in render.evaluate_states(states, asked, ["track_id"]).collect():
        if 0 <= r.t <= 12:
            assert np.isclose(r.x, p(r.t)) and np.isclose(r.vy, p.deriv()(r.t)) and np.isclose(r.az, p.deriv(2)(r.t))
        if r.t == 14:
            assert np.isclose(r.x, p(12) + 2 * p.deriv()(12) + 2 * p.deriv(2)(12))


def test_evaluation_equals_numpy(spark):
    rng = np.random.default_rng(5)
    t = np.r_[np.arange(0, 60.0), np.arange(80, 140.0)]
    pos = np.stack([85 * t, 300 * np.sin(t / 25), 700 + 3 * t], 1) + rng.normal(0, 3, (len(t), 3))
    samples = frame(spark, {"a": (t, pos)})
    g = np.arange(0, 139.01, 0.5)
    rp = np.stack([85 * g + 4, 300 * np.sin(g / 25), 700 + 3 * g + np.sin(g)], 1)
    rv = np.stack([85 + 0 * g, 12 * np.cos(g / 25), 3 + np.cos(g)], 1)
    ra = np.stack([0 * g, -0.48 * np.sin(g / 25), -np.sin(g)], 1)
    r = spark.createDataFrame(pd.DataFrame({"track_id": "a", "method": "m_spline", "segment": (g > 100).astype(int), "t": g} | {c: np.c_[rp, rv, ra][:, k] for k, c in enumerate(NAMES + ["ax", "ay", "az"])}))
    m = compare.evaluate(samples, r).toPandas().iloc[0]
    inside = t <= g[-1]
    err = np.stack([np.interp(t[inside], g, rp[:, k]) - pos[inside, k] for k in range(3)], 1)
    rms = lambda x: np.sqrt(np.mean(np.square(x)))
    assert np.isclose(m.position_rmse, rms(np.linalg.norm(err, axis=1))) and np.isclose(m.horizontal_p95, np.quantile(np.linalg.norm(err[:, :2], axis=1), 0.95))
    jerk = np.gradient(ra, g, axis=0, edge_order=1)
    assert np.isclose(m.jerk_rms, rms(np.linalg.norm(jerk, axis=1))) and np.isclose(m.accel_p95, np.quantile(np.linalg.norm(ra, axis=1), 0.95))
    gap = (g > 59) & (g < 80)
    assert m.n_long_gaps == 1 and m.n_gap_frames == gap.sum() and np.isclose(m.gap_accel_p95, np.quantile(np.linalg.norm(ra[gap], axis=1), 0.95))
    assert np.isclose(m.gap_coverage, min(1, gap.sum() / (21 / 0.5 - 1)))
    assert np.isclose(m.velocity_closure_rmse, rms(np.linalg.norm(rv - np.gradient(rp, g, axis=0), axis=1)))
    k = int(np.argmax(g > 100))
    assert m.n_joins == 1 and np.isclose(m.join_velocity_p95, np.linalg.norm(rv[k] - rv[k - 1]))
    raw = np.gradient(pos, t, axis=0)
    near = np.r_[False, np.diff(t) > 10] | np.r_[np.diff(t) > 10, False]
    own = np.stack([np.interp(t, g, rv[:, j]) for j in range(3)], 1)
    assert np.isclose(m.difference_rmse, rms(np.linalg.norm(own - raw, axis=1)[inside & ~near]))
    heading = np.unwrap(np.arctan2(rv[:, 0], rv[:, 1]))
    assert np.isclose(m.turn_all_p95, np.quantile(np.abs(np.degrees(np.gradient(heading, g))), 0.95))
    assert 0 <= m.score <= 100 and np.isclose(m.loss, 100 - m.score) and m.score_locality == 100
    bridged = compare.evaluate(samples, r.where("t <= 59 or t >= 80")).toPandas().iloc[0]
    assert bridged.score_gaps > m.score_gaps, "a render that bridges the gap scores lower"


def test_public_example_frames(spark):
    f = spark.createDataFrame([(0, "8D4840D6202CC371C32CE0576098"), (1, "8D40621D58C382D690C8AC2863A7"), (2, "8D40621D58C386435CC412692AD6"), (3, "8D485020994409940838175B284F"), (4, "8D4840D6202CC371C32CE0576099"), (5, "5D4840D6A8D2F1")], "id long, payload_hex string")
    d = {r.id: r for r in decode.resolve_position(decode.decode_frames(f), 52.0, 4.0).collect()}
    assert d[0].callsign == "KLM1023" and d[0].crc_ok == 1 and d[4].crc_ok == 0 and d[0].tc == 4 and d[5].tc is None
    assert d[1].alt == 38000 and d[2].position_source == "pair" and abs(d[2].lat - 52.26578) < 1e-3 and abs(d[2].lon - 3.93891) < 2e-2
    assert abs(d[1].lat - 52.2572) < 1e-3 and abs(d[1].lon - 3.91937) < 1e-3 and d[1].position_source == "reference"
    assert round(d[3].gs, 2) == 159.20 and round(d[3].track, 2) == 182.88 and d[3].vertical_rate == -832
    assert {r.id for r in decode.decode_incremental(f, f.where("id < 3").select("id"), 1).collect()} == {3}


def test_scalars_of_policies_and_heights(spark):
    one = spark.createDataFrame([("nan", 5.0, 100.0)], "a string, t double, alt double")
    got = one.select(
        S.first_finite(F.col("a"), F.col("t")).alias("f"), S.on_ground_override(F.col("t"), F.lit(None).cast("double"), F.lit(36.0), F.lit(4.0), F.lit(6.0)).alias("g"), S.score_low(F.lit(15.0), 10, 20).alias("s"),
        S.iso_utc(F.lit(1704067200.7)).alias("iso"), S.heading_from_velocity(F.lit(0.0), F.lit(-1.0)).alias("h"), S.field_height(F.col("alt"), F.lit(200.0), True)[1].alias("z"),
        S.vector_end(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), 2.0, 10.0)["x"].alias("v"), S.speed_floor(F.lit("ground"), F.lit("smooth")).alias("floor"), S.source_event_kind(F.lit(" Position "), *[F.lit(1)] * 5).alias("k"),
    ).first()
    assert (got.f, got.g, got.s, got.iso, got.h, got.z, got.v, got.floor, got.k) == (5.0, 36.0, 50.0, "2024-01-01T00:00:00Z", 180.0, 0.0, 10.0, 8.0, "position")
    j = spark.createDataFrame([('{"velocity_raw":[1,2,640,"GS",0,"BARO"]}',), ('{"rocd":0,"baro_rate":64}',), ("{",)], "j string")
    assert [tuple(r) for r in j.select(S.vertical_rate_columns(F.col("j"))["vertical_rate_fpm"], S.vertical_rate_columns(F.col("j"))["vertical_rate_source"]).collect()] == [(640.0, "BARO"), (64.0, None), (None, None)]


def test_filters_fail_loudly_and_keep_support(spark):
    s = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("b", 1.0)], "k string, t double")
    with pytest.raises(Exception, match="repeated time"):
        prepare.unique_times(s, ["k"]).collect()
    assert prepare.min_support(s, ["k"], 2).count() == 3 and prepare.problem_previews(s, ["k"], ["t"], 1).count() == 2
    with pytest.raises(Exception, match="valid time"):
        prepare.drop_invalid_time(s.withColumn("t", F.lit(None).cast("double")), "t").collect()
    t = np.arange(20.0)
    pos = np.stack([80 * t, 0 * t, 500 + 0 * t], 1)
    pos[7] += [20_000, 0, 0]
    f = frame(spark, {"a": (t, pos)}).withColumns({"vx": F.lit(80.0), "vy": F.lit(0.0), "vz": F.lit(0.0)})
    assert 7 not in {r.i for r in quality.filter_motion_outliers(f).collect()} and quality.filter_motion_outliers(f).count() == 19


def test_interval_joins(spark):
    p = spark.createDataFrame([("a", float(t)) for t in (0, 5, 10, 15, 30)] + [("b", 5.0)], "k string, t double")
    iv = spark.createDataFrame([("a", 0, 0.0, 10.0), ("a", 1, 10.0, 20.0)], "k string, nth long, a double, b double")
    assert {(r.k, r.t): r.nth for r in T.in_intervals(p, iv, ["k"], "t", 7.0).collect()} == {("a", 0.0): 0, ("a", 5.0): 0, ("a", 10.0): 1, ("a", 15.0): 1, ("a", 30.0): None, ("b", 5.0): None}
    other = spark.createDataFrame([("a", 19.0, 25.0)], "k string, a double, b double")
    assert [r.nth for r in T.overlapping_intervals(iv, other, ["k"], 6.0).collect()] == [1] and [r.nth for r in T.overlapping_intervals(iv, other, ["k"], 6.0, "left_anti").collect()] == [0]
    inside = compare.in_gap(p, iv.select("k", "a", "b").where("nth = 1"), ["k"], "t").collect()
    assert [(r.t, r.gap_a) for r in inside] == [(15.0, 10.0)]


def test_tables_in_the_catalog_and_sinks(spark):
    spark.createDataFrame([(1, 2.0)], "icao int, lat double").createOrReplaceTempView("few_columns")
    spark.createDataFrame([(1, 2.0, 3.0)], "ICAO int, Lat double, lon double").createOrReplaceTempView("most_columns")
    assert files.find_message_table(spark, ["icao", "lat", "lon"]) == "most_columns" and files.find_message_table(spark, ["nothing"]) is None
    path = tempfile.mkdtemp(prefix="spark-")
    k = spark.createDataFrame([("a", 1.0, ["e"])], "track_id string, t double, events array<string>")
    assert files.split_events(k, k.select("track_id"), path).first().raw_event_count == 1 and "events" not in spark.read.parquet(f"{path}/main").columns
    assert spark.read.option("header", True).csv(files.write_csv({"r": k}, path)[0]).first().events == '["e"]'


def trusted(t, pos, vel):
    """M17 row by row, from its definition."""
    out = []
    for i in range(len(t)):
        a, b = max(i - 1, 0), min(i + 1, len(t) - 1)
        slope = (pos[b] - pos[a]) / (t[b] - t[a])
        miss, up = np.linalg.norm(vel[i] - slope), abs(vel[i, 2] - slope[2])
        said, moved = np.hypot(*vel[i, :2]), np.hypot(*slope[:2])
        angle = np.degrees(np.arccos(np.clip(vel[i, :2] @ slope[:2] / max(said * moved, 1e-9), -1, 1)))
        near = min(np.linalg.norm(pos[i] - pos[j]) for j in (a, b) if j != i)
        w = 0.0 if miss > 165 else min(1, 55 / max(miss, 1e-9))
        w *= min(1, 9 / max(up, 1e-9)) * (1 if said < 3 or moved < 3 else min(1, 35 / max(angle, 1e-9)))
        out.append(0.0 if moved < 3 or near < 10 else w)
    return out


def test_segment_scores_equal_numpy(spark, segmented):
    rows = staged(regimes.in_segments(segmented["rows"], segmented["segments"]), "rows")
    f = staged(fits.fit_segments(rows), "fits")
    traits = staged(regimes.segment_features(segmented["features"], segmented["labels"], segmented["segments"]), "traits")
    got = segment_scores.segment_scores(rows, f, traits).toPandas()
    data = rows.toPandas()
    parts = [f"score_{k}" for k in segment_scores.WEIGHTS]
    rms = lambda x: np.sqrt(np.mean(np.square(x)))
    assert len(got) == f.where("error is null").count() and got[["score", *parts]].stack().between(0, 100).all()
    for fit in f.where("track_id = 'turn' and error is null").collect():
        m = got[(got.track_id == "turn") & (got.component == fit.component) & (got.segment == fit.segment)].iloc[0]
        own = data[(data.track_id == "turn") & (data.component == fit.component) & (data.segment == fit.segment)].sort_values("t")
        t, pos, vel = own.t.to_numpy(), own[NAMES[:3]].to_numpy(), own[NAMES[3:]].to_numpy()
        at, mid = fits.evaluate_fit(fit.asDict(), t - fit.t0), fits.evaluate_fit(fit.asDict(), (t[1:] + t[:-1]) / 2 - fit.t0)[:, 1]
        w = np.array(trusted(t, pos, vel))
        step = np.maximum(np.sqrt(w[1:] * w[:-1]), 0.1)
        slope = np.diff(pos, axis=0) / np.diff(t)[:, None]
        mean = lambda v: np.average(v, axis=0, weights=step)
        spread = lambda v: np.sqrt(np.average(np.sum((v - mean(v)) ** 2, 1), weights=step))
        assert np.isclose(m.position_rmse, rms(np.linalg.norm(at[:, 0] - pos, axis=1)), atol=1e-6)
        assert np.isclose(m.velocity_rmse, np.sqrt(np.average(np.sum((at[:, 1] - vel) ** 2, 1), weights=w)))
        assert np.isclose(m.difference_rmse, np.sqrt(np.average(np.sum((mid - slope) ** 2, 1), weights=step)))
        steady = spread(slope) <= 1e-6
        assert pd.isna(m.detail_ratio) if steady else np.isclose(m.detail_ratio, spread(mid) / spread(slope))
        grid = np.append(np.arange(0, fit.t1 - fit.t0, 1.0), fit.t1 - fit.t0)
        s = fits.evaluate_fit(fit.asDict(), grid)
        assert np.isclose(m.accel_p95, np.quantile(np.linalg.norm(s[:, 2], axis=1), 0.95))
        assert np.isclose(m.closure_velocity, rms(np.linalg.norm(np.diff(s[:, 0], axis=0) / np.diff(grid)[:, None] - (s[1:, 1] + s[:-1, 1]) / 2, axis=1)))
        known = [(m[p], k) for p, k in zip(parts, segment_scores.WEIGHTS.values(), strict=True) if pd.notna(m[p])]
        assert np.isclose(m.score, sum(a * b for a, b in known) / sum(b for _, b in known))


def test_joins_by_event_and_gaps(spark):
    j = spark.createDataFrame([("a", "m", "normal_segment_join", "airborne", 1.0, 2.0, 5.5, 43.0), ("a", "m", "go_around", "unknown", 9.0, 9.0, 9.0, 90.0), ("b", "m", "go_around", "ground", 1.0, 1.0, 1.0, 1.0)], "track_id string, method string, event string, regime string, jump_p double, jump_v double, jump_a double, jump_j double")
    c = segment_scores.continuity_summary(j)
    n = {(r.track_id, r.kind, r.bucket): (r.n, r.jump_a) for r in c.collect()}
    assert n["a", "normal", "all"] == (1, 5.5) and n["a", "event", "go_around"] == (1, 9.0) and n["a", "event", "hard_gap"] == (0, 0.0) and n["a", "regime", "unknown"] == (1, 9.0) and n["b", "normal", "all"] == (0, 0.0)
    assert {r.track_id: r.join_score for r in segment_scores.join_scores(c).collect()} == {"a": pytest.approx(50.0), "b": 100.0}
    t = [*range(0, 60), *range(160, 200), *range(400, 420)]
    s = spark.createDataFrame([("a", float(x)) for x in t] + [("b", 1.0), ("b", 2.0), ("c", 1.0)], "track_id string, t double")
    r = spark.createDataFrame([("a", "m", x) for x in (59.5, 100.0, 130.0, 199.9, 399.5)] + [("a", "n", 60.0), ("b", "m", 1.5), ("c", "m", 1.0)], "track_id string, method string, t double")
    got = {(x.track_id, x.method): (x.n_gaps, x.n_bridged, x.n_bridge_frames, x.gap_score) for x in segment_scores.gap_scores(s, r).collect()}
    assert got == {("a", "m"): (2, 1, 2, 50.0), ("a", "n"): (2, 0, 0, 100.0), ("b", "m"): (0, 0, 0, 100.0), ("c", "m"): (0, 0, 0, None)}
