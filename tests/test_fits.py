"""Spline fits against independent least squares and grids, methods that differ, confidence of velocities, refinement inside bad segments."""

import time
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from test_motion import NAMES, course, frame, smooth_curve, trusted
from trackspark.operators import banded, compare, features, fits, regimes, render, segment_scores, smoothing
from trackspark.operators import timeseries as T
from trackspark.operators.splines import basis
from trackspark.staging import staged


def noisy_curve(n=70, seed=2):
    t, pos, _ = smooth_curve(n)
    rng = np.random.default_rng(seed)
    vel = np.gradient(pos, t, axis=0) + rng.normal(0, 2, pos.shape)
    return t, pos + rng.normal(0, 8, pos.shape), vel


@pytest.mark.parametrize("degree", [3, 5])
@pytest.mark.parametrize("order", [0, 1, 2, 3, 4])
def test_local_basis_equals_the_dense_one(degree, order):
    knots = np.r_[np.zeros(degree + 1), 1.5, 2.0, 2.0, 7.5, np.full(degree + 1, 10.0)]
    t = np.r_[np.linspace(0, 10, 61), 2.0, 10.0]
    if order <= degree:
        assert np.allclose(banded.dense(*banded.local_basis(knots, degree, t, order), len(knots) - degree - 1), basis(knots, degree, t, order))


def test_banded_factor_solves():
    rng = np.random.default_rng(0)
    for m, k in ((1, 1), (4, 4), (30, 6), (900, 4)):
        low = np.tril(rng.normal(0, 1, (m, m))) * (np.subtract.outer(np.arange(m), np.arange(m)) < k) + 6 * np.eye(m)
        a = low @ low.T
        bands = np.array([np.r_[np.diag(a, -q), np.zeros(q)] for q in range(min(k, m))])
        right = rng.normal(0, 1, (m, 3))
        assert np.allclose(a @ banded.substitute(banded.factor(bands), right), right, atol=1e-8)
    with pytest.raises(np.linalg.LinAlgError):
        banded.factor(np.array([[1.0, -1.0], [0.0, 0.0]]))


@pytest.mark.parametrize("method", ["piecewise_accurate", "piecewise_smooth", "quintic_balanced", "join_smooth_smooth"])
def test_a_fit_is_the_stacked_least_squares_solution(method):
    """K4 as one tall weighted system, with the integrals' rows scaled by the number of observations, solved by lstsq."""
    t, pos, vel = noisy_curve()
    cfg = replace(fits.variants()[method], robust=0, anchored=False)
    prior = {"t": 30.0, "p": pos[30], "v": vel[30], "a": [1.0, -2.0, 0.5], "c": 0.4}
    got = fits.solve_bspline(t, pos, vel, replace(cfg, velocity_prior=0.1), [prior])
    knots, d, n = got["knots"], cfg.degree, len(t)
    slope = np.stack([np.r_[(p[1] - p[0]) / (t[1] - t[0]), (p[2:] - p[:-2]) / (t[2:] - t[:-2]), (p[-1] - p[-2]) / (t[-1] - t[-2])] for p in pos.T], 1)
    miss = np.linalg.norm(slope - vel, axis=1)
    scale = np.where(miss > 150, 0, np.minimum(1, 50 / np.maximum(miss, 1e-9))) * trusted(t, pos, vel)
    rows = [np.sqrt(cfg.position) * basis(knots, d, t), np.sqrt(cfg.velocity * scale)[:, None] * basis(knots, d, t, 1)]
    targets = [np.sqrt(cfg.position) * pos, np.sqrt(cfg.velocity * scale)[:, None] * vel]
    nodes, weights = np.polynomial.legendre.leggauss(3)
    grid = np.unique(np.r_[t, knots])
    for a, b in zip(grid[:-1], grid[1:], strict=True):
        i = min(np.searchsorted(t, (a + b) / 2, "right") - 1, n - 2)
        dt = t[i + 1] - t[i]
        lam = cfg.eta * dt / max(np.linalg.norm((pos[i + 1] - pos[i]) / dt) ** 2, cfg.floor**2) * cfg.accel
        for order, w in ((2, lam), (3, cfg.jerk), (4, cfg.snap)):
            if order <= d and w > 0:
                rows.append(np.sqrt(n * w * (b - a) / 2 * weights)[:, None] * basis(knots, d, (a + b) / 2 + (b - a) / 2 * nodes, order))
                targets.append(np.zeros((3, 3)))
    for key, order, w in (("v", 1, 0.1), ("a", 2, cfg.accel_prior)):
        own = np.sqrt(w * (0.25 + 0.75 * 0.4))
        rows.append(own * basis(knots, d, np.array([30.0]), order))
        targets.append(own * np.array([prior[key]]))
    rows.append(np.sqrt(1e-7) * np.eye(got["n_basis"]))
    targets.append(np.zeros((got["n_basis"], 3)))
    want = np.linalg.lstsq(np.vstack(rows), np.vstack(targets), rcond=None)[0]
    c = np.stack([got["cx"], got["cy"], got["cz"]], 1)
    assert np.allclose(basis(knots, d, t) @ c, basis(knots, d, t) @ want, atol=1e-3)
    at = fits.evaluate_fit(got | {"family": "bspline"}, np.array([30.0]))[0]
    assert np.isclose(got["anchor_velocity_error"], np.linalg.norm(at[1] - prior["v"])) and np.isclose(got["anchor_accel_error"], np.linalg.norm(at[2] - prior["a"]))


def test_hard_velocities_are_met_and_whole_components_are_solved_in_bands():
    t, pos, vel = noisy_curve(60)
    anchors = [{"t": 20.0, "p": pos[20], "v": vel[20] + 5, "c": 1.0}]
    held = fits.solve_bspline(t, pos, vel, replace(fits.variants()["piecewise_balanced"], hard_velocity=True), anchors)
    free = fits.solve_bspline(t, pos, vel, fits.variants()["piecewise_balanced"], anchors)
    assert held["anchor_error"] < 1e-7 and held["anchor_velocity_error"] < 1e-7 and free["anchor_error"] < 1e-7
    n = 6000
    long_t = np.arange(float(n))
    long_pos = np.stack([90 * long_t, 600 * np.sin(long_t / 40), 120 + 45 * np.cos(long_t / 30)], 1)
    began = time.time()
    fit = fits.solve_bspline(long_t, long_pos, np.gradient(long_pos, axis=0), fits.variants()["global_accurate"])
    assert fit["n_basis"] == 900 and fit["rmse"] < 60 and time.time() - began < 20


def test_anchors_that_a_fit_does_not_meet_are_told():
    t, pos, vel = smooth_curve(20)
    cfg = fits.Config(family="hermite", velocity=0.02, eta=6e4, anchored=False)
    off = fits.solve_hermite(t, pos, vel, cfg, [{"t": 5.0, "p": pos[5] + [300.0, 400.0, 0.0]}])
    assert off["anchor_error"] > 400 and off["anchor_velocity_error"] is None
    met = fits.solve_hermite(t, pos, vel, replace(cfg, anchored=True), [{"t": 5.0, "p": pos[5] + 9, "v": vel[5]}])
    at = fits.evaluate_fit(met | {"family": "hermite"}, np.array([5.0]))[0]
    assert met["anchor_error"] < 1e-9 and np.allclose(at[0], pos[5] + 9) and np.allclose(at[1], vel[5])
    assert fits.solve_hermite(t, pos, vel, cfg)["anchor_error"] is None
    with pytest.raises(ValueError):
        fits.solve_hermite(t, pos, vel, cfg, [{"t": 5.4, "p": pos[5]}])


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_search_finds_the_grids_optimum_with_a_tenth_of_its_solves(seed):
    t, pos, vel = noisy_curve(40, seed)
    cfg = fits.variants()["hermite_balanced"]
    found, score, solves = fits.search_hermite(t, pos, vel, cfg)
    (e0, e1), (g0, g1), _, _ = fits.SEARCH
    vs, shape = fits.velocity_scale(t, pos, vel), fits.interval_weights(t, pos, replace(cfg, eta=1.0))[0]
    cost = lambda e, g: fits.hermite_nodes(t, pos, vel, 10**e * shape, 10**g * vs)[1]
    grid = min(cost(e, g) for e in np.arange(e0, e1 + 0.1, 0.2) for g in np.arange(g0, g1 + 0.1, 0.2))
    assert score <= grid * 1.002 and solves <= 26 * 18 / 4 and np.isclose(score, cost(np.log10(found.eta), np.log10(found.velocity)))
    fine = 51 * 36  # a grid as fine as the search's last step, 0.1 in both
    assert solves <= fine / 10


@pytest.fixture(scope="module")
def segmented(spark):
    t = np.arange(150.0)
    turn = np.cumsum(np.where((t > 50) & (t <= 90), np.radians(3.0), 0.0))
    pos = course(turn, z=600 + 3 * np.clip(t - 60, 0, 40))
    pos = pos + np.random.default_rng(1).normal(0, 6, pos.shape)
    rows = staged(regimes.component_rows(frame(spark, {"a": (t, pos)})), "rows")
    b = spark.createDataFrame([("a", 0, 50, 50.0), ("a", 0, 100, 100.0)], "track_id string, component int, i long, t double")
    segments = staged(regimes.build_segments(rows, b), "segments")
    data = staged(regimes.in_segments(rows, segments), "data")
    return {"rows": rows, "boundaries": b, "segments": segments, "data": data, "states": staged(fits.boundary_states(rows, b), "states"), "filtered": staged(smoothing.smooth_ca(rows), "filtered")}


def test_every_family_fits_in_its_own_way(spark, segmented):
    s = segmented
    names = [n for n in fits.Methods().known if n.endswith("_balanced")]
    f = staged(fits.fit_segments(s["data"], names, s["states"], filtered=s["filtered"]), "fits")
    got = f.toPandas()
    assert got.error.isna().all() and len(got[got.method == "global_balanced"]) == 1 and (got.groupby("method").size().drop("global_balanced") == 3).all()
    frames = fits.render_fits(f, 1.0).toPandas().pivot_table(index="t", columns="method", values="y")
    plain = frames["piecewise_balanced"]
    for other, base in (("overlap_balanced", plain), ("global_balanced", plain), ("quintic_filter_balanced", frames["quintic_balanced"]), ("searched_hermite_balanced", frames["hermite_balanced"])):
        assert (frames[other] - base).abs().max() > 1e-3, other
    with pytest.raises(ValueError):
        fits.fit_segments(s["data"], ["quintic_filter_balanced"], s["states"])


def test_overlap_sees_its_neighbours_but_not_across_a_discontinuity(spark, segmented):
    s = segmented
    hard = s["boundaries"].select("track_id", "component", "i")
    both = [fits.fit_segments(s["data"], ["overlap_balanced"], s["states"], hard=h).toPandas().set_index("segment") for h in (None, hard)]
    plain = fits.fit_segments(s["data"], ["piecewise_balanced"], s["states"]).toPandas().set_index("segment")
    assert (both[0].t0 == plain.t0).all() and (both[0].t1 == plain.t1).all() and (both[0].n == plain.n).all()
    assert len(both[0].knots[1]) > len(plain.knots[1]) and len(both[1].knots[1]) == len(plain.knots[1])


def test_blended_states_lie_half_way(spark, segmented):
    base, filtered = segmented["states"].toPandas().set_index("i"), segmented["filtered"].toPandas().set_index("t")
    got = fits.blended_states(segmented["states"], segmented["filtered"]).toPandas().set_index("i")
    for i in base.index:
        assert np.allclose(got.loc[i, NAMES].astype(float), (base.loc[i, NAMES].astype(float) + filtered.loc[base.t[i], NAMES].astype(float)) / 2)
        assert np.isclose(got.confidence[i], min(1, base.confidence[i] + 0.15))


def test_confidence_of_velocities_equals_its_definition(spark):
    rng = np.random.default_rng(3)
    t = np.cumsum(rng.choice([0.5, 1.0, 4.0], 80))
    pos = np.stack([60 * t, 40 * np.sin(t / 3), 500 + 3 * t], 1)
    vel = np.gradient(pos, t, axis=0) + rng.normal(0, 30, pos.shape)
    pos[20:24] = pos[20]  # stale positions
    vel[40] += 900
    s = frame(spark, {"a": (t, pos)}).toPandas().assign(**{c: vel[:, k] for k, c in enumerate(NAMES[3:])})
    both = spark.createDataFrame(pd.concat([s, s.head(1).assign(track_id="one")]))
    got = features.velocity_confidence(both).toPandas().sort_values("t")
    own = got[got.track_id == "a"].confidence.to_numpy()
    assert np.allclose(own, trusted(t, pos, vel)) and np.allclose(own, fits.velocity_confidence(t, pos, vel))
    assert 0 < own[(own > 0) & (own < 1)].size and own[21] == 0 and own[40] == 0 and got[got.track_id == "one"].confidence.iloc[0] == 1


def brute_heading(x, y, least):
    out = []
    for i in range(len(x)):
        far = [j for j in range(len(x)) if np.hypot(x[j] - x[i], y[j] - y[i]) > least]
        j = next((j for j in far if j > i), None)
        k = next((j for j in reversed(far) if j < i), None)
        a, b = (i, j) if j is not None else (k, i)
        out.append(0.0 if a is None else np.degrees(np.arctan2(x[b] - x[a], y[b] - y[a])) % 360)
    return np.array(out)


@pytest.mark.parametrize("kind", ["creeping", "still", "moving", "circling", "one"])
def test_neighbour_heading_equals_brute_force(spark, kind):
    rng = np.random.default_rng(6)
    n = 1 if kind == "one" else 150
    x, y = {"creeping": (np.arange(n) * 0.03, np.zeros(n)), "still": (np.zeros(n), np.zeros(n)), "moving": (np.cumsum(rng.normal(3, 2, n)), np.cumsum(rng.normal(0, 2, n)))}.get(kind, (0.4 * np.cos(np.arange(n)), 0.4 * np.sin(np.arange(n))))
    got = render.neighbour_heading(spark.createDataFrame(pd.DataFrame({"k": "a", "t": np.arange(n, dtype=float), "x": x, "y": y, "tag": 7})), ["k"]).toPandas().sort_values("t")
    assert np.allclose(got.heading, brute_heading(x, y, 0.5)) and list(got.columns) == ["k", "t", "x", "y", "tag", "heading"]


def test_linear_fill_takes_time_in_proportion(spark):
    took = []
    for n in (2000, 40_000):
        df = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("t"), F.when(F.col("id") % 50 == 7, F.col("id") * 2.0).alias("v"))
        began = time.time()
        last = T.linear_fill(df, ["k"], ["t"], "v", "f").orderBy(F.desc("t")).first()
        took.append(time.time() - began)
    assert last.f == 2.0 * 39_957 and took[1] < 20


@pytest.fixture(scope="module")
def missed_turn(spark):
    """One long segment that hides a sharp turn, so that its fit is bad."""
    t = np.arange(200.0)
    pos = course(np.cumsum(np.where((t > 90) & (t <= 120), np.radians(6.0), 0.0)), speed=120.0, z=900.0)
    s = frame(spark, {"a": (t, pos)})
    rows = staged(regimes.component_rows(s), "rows")
    f = staged(regimes.motion_features(rows), "features")
    labels = staged(regimes.regime_labels(regimes.raw_labels(f)), "labels")
    none = staged(spark.createDataFrame([], "track_id string, component int, i long, t double, score double, reasons array<string>"), "none")
    return {"rows": rows, "features": f, "labels": labels, "boundaries": none, "segments": regimes.build_segments(rows, none)}


def test_refinement_enters_the_bad_segment_only(spark, missed_turn):
    m = missed_turn
    bad = spark.createDataFrame([("a", 0, 0, ["rmse"], 1)], "track_id string, component int, segment long, reasons array<string>, place long")
    inner = fits.inner_boundaries(m["rows"], m["segments"], bad).collect()
    assert len(inner) == 1 and 85 <= inner[0].i <= 126 and "feature_split" in inner[0].reasons and inner[0].score >= 100
    only_height = bad.withColumn("reasons", F.array(F.lit("vertical_p95")))
    assert fits.inner_boundaries(m["rows"], m["segments"], only_height).count() == 0
    data = regimes.in_segments(m["rows"], m["segments"])
    residuals = data.select(*fits.SEGMENT, F.lit("m").alias("method"), "i", "t", F.lit(0.0).alias("ex"), F.lit(0.0).alias("ey"), F.when(F.col("i").between(140, 150), 90.0).otherwise(1.0).alias("ez"))
    new = fits.refined_boundaries(m["rows"], m["boundaries"], m["segments"], residuals, only_height).collect()
    assert len(new) == 1 and 140 <= new[0].i <= 150 and "vertical_residual_peak" in new[0].reasons
    assert fits.refined_boundaries(m["rows"], m["boundaries"], m["segments"], residuals, bad, most_segments=1).count() == 0


def test_component_fit_splits_where_it_misses_a_turn_and_keeps_the_rest(spark, missed_turn):
    out = fits.component_fit(missed_turn, "accurate", most=2, stage=staged)
    segments, f = out["segments"].toPandas(), out["fits"].toPandas()
    assert len(f) == len(segments) and f.error.isna().all() and sorted(f.segment) == sorted(segments.segment)
    jumps = fits.verify_continuity(out["fits"]).toPandas()
    if len(segments) > 1:
        assert jumps.jump_p.max() < 1e-6 and jumps.jump_v.max() < 1e-6
        assert any("quality_refinement" in r.reasons for r in out["boundaries"].collect())
    assert f.rmse.max() < 200


def test_candidates_come_in_the_presets_order(spark):
    p = spark.createDataFrame([("a", 0, 0, "turn_left", 60.0, 50, *[1.0] * 7), ("a", 0, 1, "energy_constant", 400.0, 400, *[1.0] * 7)], "track_id string, component int, segment long, regime_label string, duration double, n long, " + ", ".join(f"p_{c} double" for c in ("eta", "velocity", "spacing", "per_basis", "jerk", "accel_prior", "accel")))
    wide = p.withColumns({"p_eta": F.lit(2e4), "p_velocity": F.lit(0.05), "p_spacing": F.lit(4.0), "p_per_basis": F.lit(5.0), "p_jerk": F.lit(0.004), "p_accel_prior": F.lit(0.1)})
    names = {r.segment: r.l for r in fits.candidate_grid(wide, "balanced").groupBy("segment").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "recipe"))), lambda x: x["recipe"]).alias("l")).collect()}
    assert names[0][:8] == ["base", "more_detail", "detail_light", "detail_heavy", "low_velocity", "short_1", "short_2", "short_3"] and len(names[0]) == 14
    assert names[1][5] == "high_velocity" and len(names[1]) == 14
    assert fits.candidate_grid(wide, "smooth").where("segment = 0").count() == 10
    assert fits.candidate_grid(wide.withColumn("p_eta", F.lit(1e9)), "accurate").agg(F.max("p_eta")).first()[0] == 1e6


def test_join_table_has_a_row_for_each_join(spark, segmented):
    s = segmented
    f = staged(fits.fit_segments(s["data"], ["piecewise_balanced"], s["states"]), "fits")
    traits = s["segments"].select(*fits.SEGMENT, F.lit("turn_left").alias("regime_label"), F.lit(80.0).alias("median_speed"))
    b = s["boundaries"].withColumn("reasons", F.array(F.when(F.col("i") == 50, "go_around_transition").otherwise("turn_state_transition")))
    joined = segment_scores.join_rows(b, s["segments"], fits.verify_continuity(f), traits)
    sides = fits.joins(s["rows"], fits.fit_residuals(s["data"], f), f, s["segments"])
    got = segment_scores.join_table(joined, s["states"], fits.harmonized_velocities(sides, s["states"]), sides).toPandas().set_index("i")
    assert sorted(got.index) == [50, 100] and got.event[50] == "go_around" and got.event[100] == "normal_segment_join"
    rmse = f.toPandas().set_index("segment").rmse
    assert np.allclose(got.left_rmse, [rmse[0], rmse[1]]) and np.allclose(got.right_rmse, [rmse[1], rmse[2]]) and got.harmonized_vx.notna().all()
    scores = spark.createDataFrame([("a", 0, k, "piecewise_balanced", 1.0, 2.0) for k in range(3)], "track_id string, component int, segment long, method string, velocity_rmse double, score double")
    table = segment_scores.segment_table(scores, s["segments"], f).toPandas()
    assert len(table) == 3 and {"velocity_rmse", "fit_velocity_rmse"} <= set(table.columns) and table.columns.is_unique


def test_motion_is_planned_once(spark):
    t = np.arange(60.0)
    s = frame(spark, {"a": (t, course(0 * t))})
    r = s.withColumns({"method": F.lit("m"), "segment": F.lit(0)})
    kept = []
    got = compare.evaluate(s, r, stage=lambda df, name: kept.append(name) or staged(df, name)).first()
    assert kept == ["motion"] and got.position_rmse < 1e-9
