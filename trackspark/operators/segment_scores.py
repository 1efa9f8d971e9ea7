"""Scores of fitted segments without a true track: evidence, differences, smoothness, plausibility, detail and closure (E21), joins and
gaps (E22), continuity by event and regime (A18), the report of joins (J12), and flat tables of all of it (A21).

A segment is fitted and evaluated in one task, as in fits.py; everything after that is an aggregate on track, component, segment and method.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.functions import scalars as S
from trackspark.operators import compare, features, fits
from trackspark.operators import timeseries as T
from trackspark.operators.fits import COMPONENT, SEGMENT

KEYS = [*SEGMENT, "method"]

#: Weights of the seven parts of a segment's score.
WEIGHTS = {"position": 0.12, "velocity": 0.18, "difference": 0.16, "smoothness": 0.22, "plausibility": 0.14, "detail": 0.10, "closure": 0.08}
#: Plausible p95 of acceleration, turn rate and vertical acceleration (soft, hard) by regime bucket; others count as airborne.
PLAUSIBLE = {"ground": ((3.5, 9.0), (10.0, 35.0), (1.0, 5.0)), "approach_final": ((5.0, 16.0), (4.0, 14.0), (2.5, 10.0)), "airborne": ((7.0, 22.0), (5.0, 18.0), (3.0, 12.0))}
#: Buckets that a summary of continuity always has.
EVENTS = ("normal_segment_join", "hard_gap", "go_around", "surveillance_or_track_discontinuity")
REGIMES = ("ground", "airborne", "approach_final")
JUMPS = ("jump_p", "jump_v", "jump_a", "jump_j")


def _norm(*columns: str) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [F.col(c) * F.col(c) for c in columns]))


def _mean_score(parts: list[tuple[Column, float]]) -> Column:
    """P26, held at 100 where rounding passes it."""
    x = S.weighted_score(parts)
    return F.when(x > 100, 100.0).otherwise(x)


def _weighted_rms(value: Column, weight: Column) -> Column:
    return F.sqrt(F.sum(weight * value * value) / F.nullif(F.sum(F.when(value.isNotNull(), weight)), F.lit(0.0)))


def evidence(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """Rows of each fit at its observations: KEYS, t, position errors e*, velocity errors w*, confidence (M17); of the step to the next row
    its length dt, weight, velocity of the positions f* and of the fit at mid-time m* (NULL after the last row)."""
    f = fitted.where("error is null").select(*KEYS, "family", "degree", "t0", "knots", "cx", "cy", "cz")
    own = rows.where(~F.col("guard") if "guard" in rows.columns else F.lit(True))
    own = features.velocity_confidence(own.select(*SEGMENT, "i", "t", "x", "y", "z", "vx", "vy", "vz"), tuple(SEGMENT))
    listed = own.groupBy(*SEGMENT).agg(F.sort_array(F.collect_list(F.struct("t", "i", "x", "y", "z", "vx", "vy", "vz", "confidence"))).alias("rows"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for r in frame.to_dict("records"):
                t = np.array([x["t"] for x in r["rows"]])
                pos, vel = (np.array([[x[c] for c in names] for x in r["rows"]], float) for names in (("x", "y", "z"), ("vx", "vy", "vz")))
                at, mid = fits.evaluate_fit(r, t - r["t0"]), fits.evaluate_fit(r, (t[:-1] + t[1:]) / 2 - r["t0"])
                scale = np.array([x["confidence"] for x in r["rows"]])
                step = np.diff(t)
                out = {"t": t, "confidence": scale, "dt": np.r_[step, np.nan], "weight": np.r_[np.maximum(np.sqrt(scale[:-1] * scale[1:]), 0.1), np.nan]}
                for k, c in enumerate("xyz"):
                    out |= {f"e{c}": at[:, 0, k] - pos[:, k], f"w{c}": at[:, 1, k] - vel[:, k], f"f{c}": np.r_[np.diff(pos[:, k]) / np.maximum(step, 1e-6), np.nan], f"m{c}": np.r_[mid[:, 1, k], np.nan]}
                yield pd.DataFrame({k: r[k] for k in KEYS} | out)

    names = ("t", "confidence", "dt", "weight", *(f"{p}{c}" for c in "xyz" for p in "ewfm"))
    out = T.spread(listed.join(f, SEGMENT), *KEYS).mapInPandas(run, "track_id string, component int, segment long, method string, " + ", ".join(f"{n} double" for n in names))
    return out.select(*KEYS, *(F.nanvl(n, F.lit(None).cast("double")).alias(n) for n in names))


def grid_states(fitted: DataFrame, step: float = 1.0) -> DataFrame:
    """Each fit on its own whole grid, both ends included: KEYS, t, x..az and jerk jx, jy, jz."""
    f = fitted.where("error is null").select(*KEYS, "family", "degree", "t0", "t1", "knots", "cx", "cy", "cz")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for r in frame.to_dict("records"):
                span = r["t1"] - r["t0"]
                tau = np.arange(0.0, span + step / 2, step)
                tau = np.append(tau[tau < span], span)
                low, high = np.maximum(tau - 1e-3, 0.0), np.minimum(tau + 1e-3, span)
                at = fits.evaluate_fit(r, tau)
                jerk = (fits.evaluate_fit(r, high)[:, 2] - fits.evaluate_fit(r, low)[:, 2]) / np.maximum(high - low, 1e-9)[:, None]
                out = {f"{p}{c}": at[:, d, k] for d, p in enumerate(("", "v", "a")) for k, c in enumerate("xyz")} | {f"j{c}": jerk[:, k] for k, c in enumerate("xyz")}
                yield pd.DataFrame({k: r[k] for k in KEYS} | {"t": r["t0"] + tau} | out)

    return T.spread(f, *KEYS).mapInPandas(run, "track_id string, component int, segment long, method string, t double, " + ", ".join(f"{p}{c} double" for p in ("", "v", "a", "j") for c in "xyz"))


def evidence_metrics(e: DataFrame) -> DataFrame:
    """Of evidence(): position errors, confidence-weighted velocity errors (NULL with fewer than two reliable rows), and differences over
    steps that are no gap (more than max(30 s, 5 medians)), with the heading's error and the variability of both velocities."""
    steps = F.percentile(F.when(F.col("dt") > 1e-6, F.col("dt")), 0.5).over(Window.partitionBy(*KEYS))
    limit = F.greatest(F.lit(30.0), 5 * steps)
    e = e.withColumns({"_e": _norm("ex", "ey", "ez"), "_miss": _norm("wx", "wy", "wz"), "_use": F.when((F.col("dt") > 1e-6) & (F.col("dt") <= limit), F.col("weight"))})
    part = Window.partitionBy(*KEYS)
    e = e.withColumns({f"_{p}{c}": F.sum(F.col("_use") * F.col(f"{p}{c}")).over(part) / F.nullif(F.sum("_use").over(part), F.lit(0.0)) for p in "fm" for c in "xyz"})
    use, near = F.col("_use"), F.col("_use").isNotNull()
    d = {c: F.col(f"m{c}") - F.col(f"f{c}") for c in "xyz"}
    flat = F.sqrt(d["x"] * d["x"] + d["y"] * d["y"])
    cross, dot = F.col("fx") * F.col("my") - F.col("fy") * F.col("mx"), F.col("fx") * F.col("mx") + F.col("fy") * F.col("my")
    heading = F.when(near & (_norm("fx", "fy") > 5) & (_norm("mx", "my") > 5), F.abs(F.degrees(F.atan2(cross, dot))))
    total = F.nullif(F.sum(use), F.lit(0.0))
    reliable = F.col("confidence") > 0.05

    def variability(p: str) -> Column:
        square = reduce(lambda x, y: x + y, [(F.col(f"{p}{c}") - F.col(f"_{p}{c}")) ** 2 for c in "xyz"])
        return F.when(F.count(use) >= 2, F.sqrt(F.sum(use * square) / total))

    enough = (F.count_if(reliable) >= 2) & (F.sum(F.when(reliable, F.col("confidence"))) > 1e-9)
    g = e.groupBy(*KEYS).agg(
        F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"), T.rms(F.col("_e")).alias("position_rmse"), F.percentile("_e", 0.95).alias("position_p95"),
        F.count_if(reliable).alias("n_reliable"), F.avg("confidence").alias("mean_confidence"),
        F.when(enough, _weighted_rms(F.col("_miss"), F.col("confidence"))).alias("velocity_rmse"), F.when(enough, _weighted_rms(_norm("wx", "wy"), F.col("confidence"))).alias("velocity_horizontal_rmse"),
        F.when(enough, _weighted_rms(F.col("wz"), F.col("confidence"))).alias("velocity_vertical_rmse"), F.count(use).alias("n_steps"),
        _weighted_rms(F.sqrt(flat * flat + d["z"] * d["z"]), use).alias("difference_rmse"), _weighted_rms(flat, use).alias("difference_horizontal_rmse"), _weighted_rms(d["z"], use).alias("difference_vertical_rmse"),
        F.percentile(heading, 0.5).alias("heading_median"), F.percentile(heading, 0.95).alias("heading_p95"), variability("f").alias("raw_variability"), variability("m").alias("fit_variability"), enough.alias("_enough"),
    )
    p95 = T.weighted_quantile(e, KEYS, "_miss", "confidence", 0.95).withColumnRenamed("wq__miss", "_p95")
    ratio = F.when(F.col("raw_variability") > 1e-6, F.col("fit_variability") / F.col("raw_variability"))
    return g.join(p95, KEYS, "left").withColumns({"velocity_p95": F.when(F.col("_enough"), F.col("_p95")), "detail_ratio": ratio}).drop("_p95", "_enough")


def smoothness_metrics(frames: DataFrame, buckets: DataFrame) -> DataFrame:
    """Of grid_states() and SEGMENT's bucket and speed floor: sizes of acceleration, jerk and snap, turns, changes of the acceleration's
    direction a minute, and how far position, velocity and acceleration agree with each other's steps (NULL with fewer than three)."""
    w = Window.partitionBy(*KEYS).orderBy("t")
    f = frames.join(buckets.select(*SEGMENT, "floor"), SEGMENT)
    lag = lambda c: F.lag(c).over(w)
    dt = F.greatest(F.col("t") - lag("t"), F.lit(1e-6))
    size = lambda parts: F.sqrt(reduce(lambda a, b: a + b, [p * p for p in parts]))
    a, j, safe = _norm("ax", "ay", "az"), _norm("jx", "jy", "jz"), F.greatest(_norm("vx", "vy"), F.col("floor"))
    cross = F.abs(F.col("vx") * F.col("ay") - F.col("vy") * F.col("ax"))
    f = f.withColumns({"_a": a, "_j": j, "_calm": j / safe, "_turn": cross / (safe * safe), "_curve": cross / (safe * safe * safe)})
    both = (F.col("_a") > 1e-6) & (lag("_a") > 1e-6)
    cosine = reduce(lambda x, y: x + y, [F.col(f"a{c}") * lag(f"a{c}") for c in "xyz"]) / F.greatest(F.col("_a") * lag("_a"), F.lit(1e-9))
    f = f.withColumns({
        "_s": size([(F.col(f"j{c}") - lag(f"j{c}")) / dt for c in "xyz"]), "_turned": F.coalesce(both & (cosine < -0.25), F.lit(False)),
        "_pv": size([(F.col(c) - lag(c)) / dt - (F.col(f"v{c}") + lag(f"v{c}")) / 2 for c in "xyz"]), "_va": size([(F.col(f"v{c}") - lag(f"v{c}")) / dt - (F.col(f"a{c}") + lag(f"a{c}")) / 2 for c in "xyz"]),
    })
    p = lambda c: F.percentile(c, 0.95)
    span = F.max("t") - F.min("t")
    whole = F.count("*") >= 3
    return f.groupBy(*KEYS).agg(
        T.rms(F.col("_a")).alias("accel_rms"), p("_a").alias("accel_p95"), F.max("_a").alias("accel_max"), p(F.abs("az")).alias("vertical_accel_p95"), T.rms(F.col("_j")).alias("jerk_rms"), p("_j").alias("jerk_p95"),
        F.max("_j").alias("jerk_max"), T.rms(F.col("_calm")).alias("calm_rms"), p("_calm").alias("calm_p95"), T.rms(F.col("_s")).alias("snap_rms"), p("_s").alias("snap_p95"), F.degrees(p("_turn")).alias("turn_p95"),
        F.degrees(F.max("_turn")).alias("turn_max"), p("_curve").alias("curvature_p95"), F.when(whole & (span > 0), F.count_if("_turned") / span * 60).otherwise(0.0).alias("turns_a_minute"),
        F.when(whole, T.rms(F.col("_pv"))).alias("closure_velocity"), F.when(whole, T.rms(F.col("_va"))).alias("closure_accel"),
    )


def segment_scores(rows: DataFrame, fitted: DataFrame, traits: DataFrame, step: float = 1.0) -> DataFrame:
    """All metrics and the seven parts of each segment's score, their weighted mean and its word. traits: of
    regimes.segment_features(). Segments whose fit failed have no row; parts that cannot be known are NULL and do not count."""
    bucket = S.regime_bucket(F.col("regime_label"), F.col("median_speed"))
    buckets = traits.select(*SEGMENT, "regime_label", bucket.alias("bucket")).withColumn("floor", S.speed_floor(F.col("bucket"), F.lit("balanced")))
    m = evidence_metrics(evidence(rows, fitted)).join(smoothness_metrics(grid_states(fitted, step), buckets), KEYS, "left").join(buckets, SEGMENT)
    low = lambda c, soft, hard: S.score_low(F.col(c), soft, hard)

    def plausible(c: str, nth: int) -> Column:
        out = low(c, *PLAUSIBLE["airborne"][nth])
        for name in ("ground", "approach_final"):
            out = F.when(F.col("bucket") == name, low(c, *PLAUSIBLE[name][nth])).otherwise(out)
        return out

    # Soft and hard limits of each metric, and its weight in its part.
    parts = {
        "position": low("position_rmse", 25, 180),
        "velocity": _mean_score([(low("velocity_rmse", 10, 55), 0.55), (low("velocity_p95", 25, 95), 0.25), (low("velocity_vertical_rmse", 3, 18), 0.20)]),
        "difference": _mean_score([(low("difference_rmse", 12, 70), 0.38), (low("difference_horizontal_rmse", 10, 65), 0.26), (low("difference_vertical_rmse", 3, 20), 0.18), (low("heading_median", 5, 45), 0.18)]),
        "smoothness": _mean_score([(low("calm_rms", 0.08, 0.80), 0.42), (low("jerk_p95", 8, 55), 0.26), (low("snap_rms", 4, 80), 0.20), (F.when(F.col("jerk_rms").isNotNull(), low("turns_a_minute", 3, 30)), 0.12)]),
        "plausibility": _mean_score([(plausible("accel_p95", 0), 0.45), (plausible("turn_p95", 1), 0.35), (plausible("vertical_accel_p95", 2), 0.20)]),
        "detail": S.score_ratio_band(F.col("detail_ratio"), 0.35, 1.20, 0.08, 2.50),
        "closure": _mean_score([(low("closure_velocity", 0.25, 5), 0.55), (low("closure_accel", 0.10, 3), 0.45)]),
    }
    out = m.withColumns({f"score_{k}": c for k, c in parts.items()}).withColumn("score", _mean_score([(F.col(f"score_{k}"), w) for k, w in WEIGHTS.items()]))
    return out.withColumns({"duration": F.col("t1") - F.col("t0"), "grade": S.score_interpretation(F.col("score"))})


def join_rows(boundaries: DataFrame, segments: DataFrame, continuity: DataFrame, traits: DataFrame) -> DataFrame:
    """Joins of fitted neighbours (fits.verify_continuity) with their boundary, its event and the left segment's regime bucket."""
    at = segments.select(*SEGMENT, F.col("last").alias("i")).join(boundaries.select(*COMPONENT, "i", "t", "reasons"), [*COMPONENT, "i"])
    bucket = traits.select(*SEGMENT, S.regime_bucket(F.col("regime_label"), F.col("median_speed")).alias("regime"))
    return continuity.join(at, SEGMENT, "left").join(bucket, SEGMENT, "left").withColumns({"event": S.boundary_event_bucket(F.col("reasons"), F.lit(False)), "regime": F.coalesce("regime", F.lit("unknown"))})


def continuity_summary(joined: DataFrame, keys: tuple[str, ...] = ("track_id", "method")) -> DataFrame:
    """Keys, kind (event, regime or normal), bucket, count and largest jumps. The named buckets are always there, with count 0 and jumps
    0; normal joins leave out all events."""
    cases = F.array(F.struct(F.lit("event").alias("kind"), F.col("event").alias("bucket")), F.struct(F.lit("regime").alias("kind"), F.col("regime").alias("bucket")), F.when(F.col("event") == "normal_segment_join", F.struct(F.lit("normal").alias("kind"), F.lit("all").alias("bucket"))))
    found = joined.select(*keys, *JUMPS, F.explode(F.array_compact(cases)).alias("c")).groupBy(*keys, "c.kind", "c.bucket").agg(F.count("*").alias("n"), *(F.max(c).alias(c) for c in JUMPS))
    always = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(b).alias("bucket")) for k, b in [*(("event", x) for x in EVENTS[:3]), *(("regime", x) for x in REGIMES), ("normal", "all")]))
    named = joined.select(*keys).distinct().select(*keys, F.explode(always).alias("c")).select(*keys, "c.kind", "c.bucket")
    both = named.join(found, [*keys, "kind", "bucket"], "full_outer")
    return both.select(*keys, "kind", "bucket", F.coalesce("n", F.lit(0)).alias("n"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in JUMPS))


def join_scores(summary: DataFrame, keys: tuple[str, ...] = ("track_id", "method")) -> DataFrame:
    """Of continuity_summary(): 0.58 of the largest acceleration jump's score and 0.42 of the jerk jump's over normal joins; 100 where there are none."""
    score = _mean_score([(S.score_low(F.col("jump_a"), 1, 10), 0.58), (S.score_low(F.col("jump_j"), 6, 80), 0.42)])
    return summary.where("kind = 'normal'").select(*keys, F.col("n").alias("n_normal_joins"), F.col("jump_a").alias("normal_accel_jump"), F.col("jump_j").alias("normal_jerk_jump"), F.when(F.col("n") == 0, 100.0).otherwise(score).alias("join_score"))


def gap_scores(samples: DataFrame, render: DataFrame) -> DataFrame:
    """Of each track and method (compare.KEYS): hard gaps of the samples, those that the render bridges with frames well inside, these
    frames, and 100 * (1 - bridged share); 100 without gaps, NULL for a track without two different times."""
    w = Window.partitionBy("track_id").orderBy("t")
    g = samples.select("track_id", F.col("t").alias("a"), F.lead("t").over(w).alias("b"))
    median = F.percentile(F.when(F.col("b") - F.col("a") > 1e-6, F.col("b") - F.col("a")), 0.5)
    g = g.withColumn("_m", median.over(Window.partitionBy("track_id")))
    known = g.where("_m is not null").select("track_id").distinct().withColumn("_known", F.lit(True))
    gaps = g.where(F.col("b") - F.col("a") > F.greatest(F.lit(30.0), 5 * F.col("_m")))
    margin = F.least(F.greatest(F.col("_m"), F.lit(0.25)), F.greatest((F.col("b") - F.col("a")) * 0.25, F.lit(0.25)))
    gaps = gaps.select("track_id", (F.col("a") + margin).alias("a"), (F.col("b") - margin).alias("b")).where("b > a")
    methods = render.select(*compare.KEYS).distinct()
    own = gaps.join(methods, "track_id")
    inside = compare.in_gap(render.select(*compare.KEYS, "t"), own, compare.KEYS, "t").where("t > gap_a").groupBy(*compare.KEYS).agg(F.count_distinct("gap_a").alias("_bridged"), F.count("*").alias("_frames"))
    n = own.groupBy(*compare.KEYS).agg(F.count("*").alias("_gaps"))
    out = methods.join(n, compare.KEYS, "left").join(inside, compare.KEYS, "left").join(known, "track_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(*compare.KEYS, zero("_gaps").alias("n_gaps"), zero("_bridged").alias("n_bridged"), zero("_frames").alias("n_bridge_frames"), F.when(F.col("_known"), S.score_low(zero("_bridged") / F.greatest(zero("_gaps"), F.lit(1)), 0, 1)).alias("gap_score"))


def join_table(joined: DataFrame, states: DataFrame, velocities: DataFrame, sides: DataFrame) -> DataFrame:
    """Each join with its shared state's confidence, the harmonised velocity and the fits' errors on both sides, by left joins on
    the boundary. states: fits.boundary_states(); velocities: fits.harmonized_velocities(); sides: fits.joins()."""
    at = [*COMPONENT, "i"]
    s = states.select(*at, F.col("confidence").alias("state_confidence"))
    v = velocities.select(*at, *(F.col(f"v{c}").alias(f"harmonized_v{c}") for c in "xyz"))
    out = joined.join(s, at, "left").join(v, at, "left").join(sides.select(*at, F.col("l_rmse").alias("left_rmse"), F.col("r_rmse").alias("right_rmse")), at, "left")
    return out.select(*COMPONENT, "method", "segment", "i", "t", "reasons", "event", "regime", *JUMPS, "smooth_p", "smooth_v", "smooth_a", "state_confidence", "harmonized_vx", "harmonized_vy", "harmonized_vz", "left_rmse", "right_rmse")


def segment_table(scores: DataFrame, segments: DataFrame, fitted: DataFrame, params: DataFrame | None = None) -> DataFrame:
    """A wide row of each segment and method: place, sizes, fit, scores, and the chosen parameters p_* where given."""
    f = fits.fit_diagnostics(fitted).drop("n", "t0", "t1").withColumnRenamed("velocity_rmse", "fit_velocity_rmse")
    out = segments.select(*SEGMENT, F.col("first").alias("first_row"), F.col("last").alias("last_row")).join(f, SEGMENT).join(scores, KEYS, "left")
    if params is None:
        return out
    return out.join(params.select(*SEGMENT, "policy", *(c for c in params.columns if c.startswith("p_"))), SEGMENT, "left")


def method_scores(scores: DataFrame, joins: DataFrame, gaps: DataFrame) -> DataFrame:
    """A19 of E21 and E22: of each track and method the duration-weighted score and parts, joins, gaps, locality and the total."""
    keys = ["track_id", "method"]
    w = F.when(F.col("duration") > 0, F.col("duration")).otherwise(F.greatest(F.col("n").cast("double"), F.lit(1.0)))
    mean = lambda c: F.sum(w * F.col(c)) / F.nullif(F.sum(F.when(F.col(c).isNotNull(), w)), F.lit(0.0))
    g = scores.groupBy(*keys).agg(F.count("*").alias("n_segments"), mean("score").alias("segment_score"), *(mean(f"score_{k}").alias(f"mean_{k}") for k in WEIGHTS))
    out = g.join(joins, keys, "left").join(gaps, keys, "left").withColumns({"join_score": F.coalesce("join_score", F.lit(100.0)), "locality": compare.locality_score(F.col("method"), F.col("n_segments"))})
    total = _mean_score([(F.col("segment_score"), 0.72), (F.col("join_score"), 0.12), (F.col("gap_score"), 0.10), (F.col("locality"), 0.06)])
    return out.withColumn("total", total).withColumn("grade", S.score_interpretation(F.col("total")))


def regime_scores(scores: DataFrame, keys: tuple[str, ...] = ("track_id", "method")) -> DataFrame:
    """A19 by regime: keys, bucket, segments and their duration-weighted score; ground, airborne and approach_final always have a row."""
    keys = list(keys)
    w = F.when(F.col("duration") > 0, F.col("duration")).otherwise(F.greatest(F.col("n").cast("double"), F.lit(1.0)))
    found = scores.groupBy(*keys, F.coalesce("bucket", F.lit("unknown")).alias("bucket")).agg(F.count("*").alias("n_segments"), (F.sum(w * F.col("score")) / F.nullif(F.sum(F.when(F.col("score").isNotNull(), w)), F.lit(0.0))).alias("score"))
    named = scores.select(*keys).distinct().select(*keys, F.explode(F.array(*map(F.lit, REGIMES))).alias("bucket"))
    return named.join(found, [*keys, "bucket"], "full_outer").select(*keys, "bucket", F.coalesce("n_segments", F.lit(0)).alias("n_segments"), "score")


def trajectory_table(scores: DataFrame, methods: DataFrame) -> DataFrame:
    """The rows of method_scores() and of segment_scores() in one table, told apart by row_type."""
    m = methods.withColumn("row_type", F.lit("method_summary"))
    s = scores.select(*KEYS, "regime_label", "bucket", "t0", "t1", "n", "score", "grade", *(f"score_{k}" for k in WEIGHTS), "velocity_rmse", "difference_rmse", "heading_median", "calm_rms", "snap_rms", "turn_p95", "detail_ratio")
    return m.unionByName(s.withColumn("row_type", F.lit("segment")), allowMissingColumns=True)
