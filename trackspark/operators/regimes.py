"""Motion regimes of track components: features, labels, boundary candidates, and segmentation as one job.

Rows are samples (track_id, component, i, t, x, y, z, vx, vy, vz); i counts from 0 within a component (component_rows()). Headings here
are mathematical angles, so a positive rate is a left turn. Windows and joins are native; only what merges one run after another
(labels that lack support, boundary selection) is a grouped job, on a component's runs or candidates.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.functions import scalars as S
from trackspark.operators import quality
from trackspark.operators import timeseries as T

COMPONENT = ["track_id", "component"]
FEATURES = (
    "heading_rate", "signed_heading_rate", "lateral_accel", "abs_lateral_accel", "speed", "vertical_rate", "abs_vertical_rate", "speed_accel",
    "accel", "vertical_accel", "energy_height", "energy_rate", "abs_energy_rate", "mismatch", "residual", "path_angle",
)


@dataclass(frozen=True)
class Limits:
    """Fixed values of the segmentation; rates in degrees a second, times in seconds."""

    window: int = 5
    min_points: int = 8
    min_seconds: float = 15.0
    spacing: float = 12.0
    most_segments: int = 48
    state_points: int = 8
    state_seconds: float = 15.0
    slow: float = 25.0
    energy: tuple[float, float] = (1.0, 0.20)
    vertical: tuple[float, float] = (1.0, 0.20)
    speed_accel: tuple[float, float] = (0.20, 0.20)
    turn: tuple[float, float, float] = (0.75, 0.20, 3.0)
    lateral: tuple[float, float, float] = (0.5, 0.25, 1.25)
    bands: tuple[float, float] = (3.0, 7.0)
    least_turn: float = 12.0
    rough: float | None = None
    reversal: tuple[int, float, float] = (4, 6.0, 25.0)
    lobe: tuple[int, float, float, float, float] = (8, 8.0, 35.0, 12.0, 0.35)
    go_around: tuple[int, float, float] = (4, 6.0, 10.0)
    gap: tuple[int, float] = (8, 25.0)
    max_shift: int = 6


def component_rows(samples: DataFrame, absolute: float | None = 30.0, relative: float = 5.0) -> DataFrame:
    """W11 with its support rule: components of two rows or more, rows numbered from 0 in each; i_track keeps the track's own index."""
    s = samples.withColumnRenamed("i", "i_track") if "i" in samples.columns else samples
    c = T.split_gaps(s, ["track_id"], "t", absolute, relative).withColumn("component", F.col("component").cast("int"))
    part = Window.partitionBy(*COMPONENT)
    return c.withColumns({"_n": F.count("*").over(part), "i": (F.row_number().over(part.orderBy("t")) - 1).cast("long")}).where("_n >= 2").drop("_n")


def _w():
    return Window.partitionBy(*COMPONENT).orderBy("t")


def _interval(df: DataFrame, made: dict[str, Column]) -> DataFrame:
    """Interval values (of a row and the one before) as sample values: ends copied, inside the mean of both sides."""
    w = _w()
    df = df.withColumns({f"_{k}": v for k, v in made.items()})
    return df.withColumns({k: F.coalesce((F.col(f"_{k}") + F.lead(f"_{k}").over(w)) / 2, F.lead(f"_{k}").over(w), F.col(f"_{k}"), F.lit(0.0)) for k in made}).drop(*(f"_{k}" for k in made))


def motion_features(rows: DataFrame) -> DataFrame:
    """M1: the sixteen FEATURES of each row, and their robust z values (A11) as z_<name>; all by component."""
    w = _w()
    dt = F.greatest(F.col("t") - F.lag("t").over(w), F.lit(1e-6))
    step = lambda c: (F.col(c) - F.lag(c).over(w)) / dt
    s = rows.withColumns({"_speed": F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")), "_h": S.direction(F.col("vy"), F.col("vx"))})
    turn = S.wrapped(F.col("_h") - F.lag("_h").over(w), F.pi())
    change = F.sqrt(reduce(lambda a, b: a + b, [step(c) * step(c) for c in ("vx", "vy", "vz")]))
    s = _interval(s, {"_rate": turn / dt, "_acc": F.when(F.lag("t").over(w).isNotNull(), change), "_vacc": step("vz"), **{f"_p{c}": step(c) for c in "xyz"}})
    s = s.withColumn("_e", F.col("z") + F.col("_speed") * F.col("_speed") / (2 * S.GRAVITY))
    for c, out in (("_speed", "_sacc"), ("_e", "_erate")):
        s = T.sample_gradient(s, COMPONENT, "t", c, out)
    s = T.chord_residual(s, COMPONENT, ["t"], ["x", "y", "z"], 2, "residual")
    lateral = F.col("_speed") * F.col("_rate")
    medians = {
        "heading_rate": F.abs("_rate"), "signed_heading_rate": F.col("_rate"), "lateral_accel": lateral, "abs_lateral_accel": F.abs(lateral), "speed": F.col("_speed"), "vertical_rate": F.col("vz"),
        "abs_vertical_rate": F.abs("vz"), "speed_accel": F.coalesce("_sacc", F.lit(0.0)), "accel": F.col("_acc"), "vertical_accel": F.col("_vacc"), "energy_rate": F.coalesce("_erate", F.lit(0.0)), "abs_energy_rate": F.abs(F.coalesce("_erate", F.lit(0.0))),
    }
    three = w.rowsBetween(-1, 1)
    s = s.withColumns({f"_m_{k}": c for k, c in medians.items()})
    s = s.withColumns({k: F.percentile(f"_m_{k}", 0.5).over(three) for k in medians})
    miss = F.sqrt(reduce(lambda a, b: a + b, [(F.col(f"v{c}") - F.col(f"_p{c}")) ** 2 for c in "xyz"]))
    s = s.withColumns({"energy_height": F.col("_e"), "mismatch": miss, "path_angle": F.atan2(F.col("vz"), F.greatest(F.col("_speed"), F.lit(1e-6)))})
    s = s.drop(*(c for c in s.columns if c.startswith("_")))
    z = quality.robust_standardize(s, COMPONENT, list(FEATURES))
    return z.withColumnsRenamed({f"{c}_z": f"z_{c}" for c in FEATURES})


def rough_air_score(weights: tuple[float, float, float, float] = (0.45, 0.45, 0.35, 0.25)) -> Column:
    """M3: root of the summed squares of the weighted z values of mismatch, residual, vertical and speed acceleration."""
    z = [w * F.col(f"z_{c}") for w, c in zip(weights, ("mismatch", "residual", "vertical_accel", "speed_accel"), strict=True)]
    return F.sqrt(reduce(lambda a, b: a + b, [x * x for x in z]))


def adaptive_deadbands(features: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """M2: one row a component; max(floor, scale * MAD), those of turns and lateral acceleration also capped. Turn rates in radians."""
    names = ("energy_rate", "vertical_rate", "speed_accel", "signed_heading_rate", "lateral_accel")
    part = Window.partitionBy(*COMPONENT)
    f = features.select(*COMPONENT, *names).withColumns({f"_m_{c}": F.percentile(c, 0.5).over(part) for c in names})
    g = f.groupBy(*COMPONENT).agg(*(F.percentile(F.abs(F.col(c) - F.col(f"_m_{c}")), 0.5).alias(f"_s_{c}") for c in names), *(F.stddev_pop(c).alias(f"_d_{c}") for c in names))
    scale = lambda c: F.when(1.4826 * F.col(f"_s_{c}") > 1e-9, 1.4826 * F.col(f"_s_{c}")).when(F.col(f"_d_{c}") > 1e-9, F.col(f"_d_{c}")).otherwise(0.0)
    band = lambda c, floor, factor: F.greatest(F.lit(floor), factor * scale(c))
    capped = lambda c, floor, factor, cap: F.greatest(F.lit(floor), F.least(F.lit(cap), F.when(factor * scale(c) > 0, factor * scale(c)).otherwise(floor)))
    rad = lambda x: float(np.radians(x))
    return g.select(
        *COMPONENT, band("energy_rate", *limits.energy).alias("energy_band"), band("vertical_rate", *limits.vertical).alias("vertical_band"), band("speed_accel", *limits.speed_accel).alias("accel_band"),
        capped("signed_heading_rate", rad(limits.turn[0]), limits.turn[1], rad(limits.turn[2])).alias("turn_band"), capped("lateral_accel", *limits.lateral).alias("lateral_band"),
    )


def raw_labels(features: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """M4 and the first half of M5: energy and turn of each row from smoothed features, and turns that only add up over time."""
    f = features.join(adaptive_deadbands(features, limits), COMPONENT).withColumn("rough_score", rough_air_score())
    w = _w()
    around = w.rowsBetween(-max(1, limits.window // 2), max(1, limits.window // 2))
    names = ("speed", "vertical_rate", "speed_accel", "energy_rate", "signed_heading_rate", "lateral_accel", "rough_score")
    f = f.withColumns({f"s_{c}": F.percentile(c, 0.5).over(around) for c in names})
    v, a, e = F.col("s_vertical_rate"), F.col("s_speed_accel"), F.col("s_energy_rate")
    energy = (
        F.when(F.col("s_speed") < limits.slow, "ground_slow").when(v > F.col("vertical_band"), "climb").when(v < -F.col("vertical_band"), "descent")
        .when(a > F.col("accel_band"), "level_accel").when(a < -F.col("accel_band"), "level_decel").when(e > F.col("energy_band"), "energy_gain").when(e < -F.col("energy_band"), "energy_loss").otherwise("energy_constant")
    )
    r = F.col("s_signed_heading_rate")
    name = lambda x, deg: F.concat(F.when(x >= 0, "turn_left_").otherwise("turn_right_"), S.magnitude_band(deg, *limits.bands))
    fast = F.col("s_speed") >= limits.slow
    active = (F.abs(r) >= F.col("turn_band")) | (F.abs("s_lateral_accel") >= F.col("lateral_band"))
    # Sums of trapezoids at the first and last row of a centred window
    half = round(500 * min(max(3 * limits.min_seconds, 20.0), 60.0))
    f = f.withColumn("_trap", F.coalesce(0.5 * (r + F.lag("s_signed_heading_rate").over(w)) * (F.col("t") - F.lag("t").over(w)), F.lit(0.0)))
    f = f.withColumns({"turned": F.sum("_trap").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_ms": F.round(F.col("t") * 1000).cast("long")})
    span = Window.partitionBy(*COMPONENT).orderBy("_ms").rangeBetween(-half, half)
    f = f.withColumns({"_d": F.last("turned").over(span) - F.first("turned").over(span), "_l": F.last("t").over(span) - F.first("t").over(span)})
    slow_turn = fast & (F.abs("_d") >= np.radians(max(12.0, limits.least_turn))) & (F.col("_l") > 0)
    turn = F.when(fast & active, name(r, F.degrees(F.abs(r)))).when(slow_turn, name(F.col("_d"), F.degrees(F.abs("_d")) / F.greatest(F.col("_l"), F.lit(1e-6)))).otherwise("straight")
    rough = F.when(F.col("s_rough_score") >= limits.rough, "rough_air").otherwise("smooth_air") if limits.rough is not None else F.lit("smooth_air")
    return f.withColumns({"energy": energy, "turn": turn, "rough": rough}).drop("_trap", "_ms", "_d", "_l")


def _runs(labels: np.ndarray) -> list[list[int]]:
    """[first, last] of each run of equal labels."""
    cut = np.flatnonzero(labels[1:] != labels[:-1]) + 1
    return [[int(a), int(b)] for a, b in zip(np.r_[0, cut], np.r_[cut, len(labels)] - 1, strict=True)]


def stabilized(labels: np.ndarray, t: np.ndarray, support: tuple[int, float], tokens: tuple[str, ...] = (), special: tuple[int, float] | None = None, passes: int = 12) -> np.ndarray:
    """In each pass the first run without support takes the label of equal neighbours, else of the stronger side (ties: left).

    Runs whose label holds one of the tokens only need the special support. A run that would keep its label is passed over.
    """
    labels = labels.copy()
    for _ in range(passes):
        runs = _runs(labels)
        strength = lambda k: (t[runs[k][1]] - t[runs[k][0]]) + 0.25 * (runs[k][1] - runs[k][0] + 1)  # noqa: B023, E731
        for k, (a, b) in enumerate(runs) if len(runs) > 1 else ():
            points, seconds = special if special and any(x in labels[a] for x in tokens) else support
            if b - a + 1 >= points and t[b] - t[a] >= seconds:
                continue
            sides = [j for j in (k - 1, k + 1) if 0 <= j < len(runs)]
            best = max(sides, key=lambda j: (strength(j), -j))
            if labels[runs[best][0]] != labels[a]:
                labels[a : b + 1] = labels[runs[best][0]]
                break
        else:
            break
    return labels


def bridged(turn: np.ndarray, t: np.ndarray, points: int, seconds: float) -> np.ndarray:
    """Short straight runs between turns to the same side join the turn before them."""
    turn = turn.copy()
    side = lambda x: x.split("_")[1] if x.startswith("turn_") else ""
    k = 1
    runs = _runs(turn)
    while k < len(runs) - 1:
        (a, b), before, after = runs[k], turn[runs[k - 1][0]], turn[runs[k + 1][0]]
        if turn[a] == "straight" and side(before) and side(before) == side(after) and b - a + 1 <= points and t[b] - t[a] <= seconds:
            turn[a : b + 1] = before
            runs, k = _runs(turn), 1
        else:
            k += 1
    return turn


def without_weak_turns(turn: np.ndarray, turned: np.ndarray, t: np.ndarray, least: float, seconds: float) -> np.ndarray:
    """Turns of less than `least` radians, up to the row after their last, or of less time become straight."""
    turn = turn.copy()
    for a, b in _runs(turn):
        if turn[a].startswith("turn_"):
            change = abs(turned[min(b + 1, len(turned) - 1)] - turned[a]) if b > a else 0.0
            if change < least or t[b] - t[a] < seconds:
                turn[a : b + 1] = "straight"
    return turn


def regime_labels(labelled: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """M5's second half and M6: stable energy, turn, rough and regime ([rough_air__]energy[__turn]) of each row. One group a component."""
    schema = "track_id string, component int, i long, energy string, turn string, rough string, regime string"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("i")
        t, turned = g.t.to_numpy(), g.turned.to_numpy()
        own = (max(2, min(limits.state_points, limits.min_points)), max(0.0, min(limits.state_seconds, limits.min_seconds)))
        short = lambda most: (max(2, min(4, limits.min_points)), max(0.0, min(most, limits.min_seconds)))
        energy = stabilized(g.energy.to_numpy(object), t, (max(2, limits.state_points), limits.state_seconds), ("climb", "descent", "accel", "decel", "energy_gain", "energy_loss"), own)
        weak = (np.radians(limits.least_turn), short(4.0)[1])
        turn = bridged(g.turn.to_numpy(object), t, max(2, min(12, limits.min_points)), max(4.0, min(18.0, limits.min_seconds)))
        turn = without_weak_turns(turn, turned, t, *weak)
        turn = without_weak_turns(stabilized(turn, t, own, ("turn_",), short(4.0)), turned, t, *weak)
        rough = stabilized(g.rough.to_numpy(object), t, own, ("rough_air",), short(6.0))
        whole = np.array([("rough_air__" if r == "rough_air" else "") + e + ("" if x == "straight" else f"__{x}") for e, x, r in zip(energy, turn, rough, strict=True)], object)
        regime = stabilized(whole, t, own, ("climb", "descent", "turn_", "rough_air", "accel", "decel"), short(6.0))
        return pd.DataFrame({"track_id": g.track_id, "component": g.component, "i": g.i, "energy": energy, "turn": turn, "rough": rough, "regime": regime})

    return T.spread(labelled.select(*COMPONENT, "i", "t", "energy", "turn", "rough", "turned"), *COMPONENT).groupBy(*COMPONENT).applyInPandas(run, schema)


def transition_weight(kind: str, left: Column, right: Column) -> Column:
    """M7: how much a change of labels matters, by the kind of label."""
    has = lambda *tokens: reduce(lambda a, b: a | b, [left.contains(x) | right.contains(x) for x in tokens])
    if kind != "energy":
        token, yes, no = ("turn_", 12.0, 4.0) if kind == "turn" else ("rough_air", 10.0, 3.0)
        return F.when(has(token), yes).otherwise(no)
    plus = (("climb", "descent"), 10.0), (("energy_gain", "energy_loss"), 6.0), (("accel", "decel"), 4.0), (("rapid",), 3.0)
    return reduce(lambda a, b: a + b, [F.when(has(*tokens), x).otherwise(0.0) for tokens, x in plus], F.lit(4.0))


def boundary_samples(changes: DataFrame, features: DataFrame, max_shift: int = 6, pad: int = 3) -> DataFrame:
    """M8: changes(keys, start, n) of runs -> i, the quietest row of the transition band: within `pad` of the change, at most max_shift
    from its start; of equal costs the nearer, then the lower row. The band is bounded, so the range join is as well."""
    f = features.select(*(F.col(k).alias(f"f_{k}") for k in COMPONENT), F.col("i").alias("f_i"), F.col("t").alias("f_t"), *(F.col(f"z_{c}").alias(f"f_{c}") for c in FEATURES))
    start = F.greatest(F.lit(1), F.least(F.col("start"), F.greatest(F.col("n_rows") - 2, F.lit(1))))
    low = F.greatest(F.lit(1), F.col("start") - 1 - pad, start - max_shift)
    high = F.least(F.col("n_rows") - 2, F.col("start") + pad, start + max_shift)
    near = changes.join(f, (F.col("track_id") == F.col("f_track_id")) & (F.col("component") == F.col("f_component")) & F.col("f_i").between(low, high))
    z = lambda c: F.abs(f"f_{c}")
    away = F.abs(F.col("f_i") - start)
    cost = 0.45 * z("mismatch") + 0.45 * z("residual") + 0.20 * (z("accel") + 0.5 * z("vertical_accel") + 0.5 * z("speed_accel")) + 0.05 * away
    best = F.struct(S.round_half(cost, 9).alias("cost"), away.alias("away"), F.col("f_i").alias("i"), F.col("f_t").alias("t"), *(z(c).alias(c) for c in ("energy_rate", "vertical_rate", "speed_accel", "heading_rate", "abs_lateral_accel", "residual")))
    keys = changes.columns
    return near.groupBy(*keys).agg(F.min(best).alias("b")).where("b.i between 1 and n_rows - 2")


BASE = {"energy": 80.0, "turn": 76.0, "rough": 66.0}


def transition_candidates(labels: DataFrame, features: DataFrame, limits: Limits = Limits(), kinds: tuple[str, ...] = ("energy", "turn", "rough")) -> DataFrame:
    """M7: keys, i, t, score, reasons of the changes of stable labels, each placed by M8."""
    w = _w()
    rows = features.select(*COMPONENT, "i", "t").withColumn("n_rows", F.count("*").over(Window.partitionBy(*COMPONENT)))
    out = []
    for kind in kinds:
        c = labels.select(*COMPONENT, "i", F.col(kind).alias("to")).join(rows, [*COMPONENT, "i"]).withColumn("from", F.lag("to").over(w))
        changes = c.where(F.col("from") != F.col("to")).select(*COMPONENT, F.col("i").alias("start"), "n_rows", "from", "to")
        placed = boundary_samples(changes, features, limits.max_shift)
        b = F.col("b")
        score = (
            BASE[kind] + 2.0 * transition_weight(kind, F.col("from"), F.col("to")) + 0.7 * b["energy_rate"] + 0.6 * b["vertical_rate"] + 0.45 * b["speed_accel"]
            + 0.75 * b["heading_rate"] + 0.45 * b["abs_lateral_accel"] + 0.35 * b["residual"]
        )
        has = lambda *x: reduce(lambda p, q: p | q, [F.col("from").contains(y) | F.col("to").contains(y) for y in x])
        reasons = [F.lit(f"{'rough_air' if kind == 'rough' else kind}_state_transition"), F.concat(F.lit("regime_from_"), "from"), F.concat(F.lit("regime_to_"), "to"), F.when(b["i"] != F.col("start"), "optimized_boundary_sample")]
        if kind == "energy":
            reasons += [F.when(has("climb"), "climb_state_transition"), F.when(has("descent"), "descent_state_transition"), F.when(has("accel", "decel"), "speed_change_transition")]
        out.append(placed.select(*COMPONENT, b["i"].alias("i"), b["t"].alias("t"), score.alias("score"), F.array_compact(F.array(*reasons)).alias("reasons")))
    return reduce(lambda a, b: a.unionByName(b), out)


def _modes(features: DataFrame, limits: Limits, share: float | None, gate: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with smoothed altitude and vertical mode, and the runs of modes with their medians. share: of the altitude's own rate."""
    k = max(3, limits.window)
    f = T.rolling_median(features, COMPONENT, ["t"], "z", k, "alt")
    if share is None:
        f = f.withColumn("rate", F.col("vertical_rate"))
    else:
        f = T.sample_gradient(f, COMPONENT, "t", "alt", "_g").withColumn("rate", F.coalesce(share * F.col("_g") + (1 - share) * F.col("vertical_rate"), F.col("_g")))
    f = T.rolling_median(f.withColumn("_r", F.col("rate")), COMPONENT, ["t"], "_r", k, "rate")
    for c in ("energy_rate", "speed_accel"):
        f = T.rolling_median(f, COMPONENT, ["t"], c, k, f"m_{c}")
    f = f.withColumn("mode", F.when(F.col("rate") >= gate, "climb").when(F.col("rate") <= -gate, "descent").otherwise("level"))
    w = _w()
    f = f.withColumn("_new", F.when(F.col("mode").eqNullSafe(F.lag("mode").over(w)), 0).otherwise(1)).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    f = f.withColumn("n_rows", F.count("*").over(Window.partitionBy(*COMPONENT))).select(*COMPONENT, "i", "t", "alt", "rate", "m_energy_rate", "m_speed_accel", "mode", "run", "n_rows")
    med = lambda c, n: F.percentile(c, 0.5).alias(n)
    runs = f.groupBy(*COMPONENT, "run").agg(
        F.first("mode").alias("mode"), F.min("i").alias("first"), F.max("i").alias("last"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("n"), F.max("n_rows").alias("n_rows"),
        med("alt", "alt"), med("rate", "rate"), med("m_energy_rate", "energy_rate"), med("m_speed_accel", "speed_accel"),
    )
    return f, runs


def _extreme(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """pairs(keys, l_*, r_*) with at_i, at_t, at_alt: the highest row from the end of a climb to the start of the next mode, or the lowest after a descent."""
    r = rows.select(*(F.col(k).alias(f"f_{k}") for k in COMPONENT), F.col("i").alias("f_i"), F.col("alt").alias("f_alt"))
    j = pairs.join(r, (F.col("track_id") == F.col("f_track_id")) & (F.col("component") == F.col("f_component")) & F.col("f_i").between(F.col("l_last"), F.col("r_first")))
    up = F.when(F.col("l_mode") == "climb", -F.col("f_alt")).otherwise(F.col("f_alt"))
    return j.groupBy(*pairs.columns).agg(F.min(F.struct(up.alias("u"), F.col("f_i").alias("i"), F.col("f_alt").alias("alt"))).alias("at"))


def _pairs(runs: DataFrame, most: int) -> DataFrame:
    """Each climb or descent with the next `most` runs of its component, by order among the given runs."""
    w = Window.partitionBy(*COMPONENT).orderBy("first")
    r = runs.withColumn("nth", F.row_number().over(w))
    left = r.where("mode <> 'level'").select(*COMPONENT, *(F.col(c).alias(f"l_{c}") for c in r.columns if c not in COMPONENT))
    right = r.select(*(F.col(k).alias(f"r_{k}") for k in COMPONENT), *(F.col(c).alias(f"r_{c}") for c in r.columns if c not in COMPONENT))
    ahead = left.withColumn("_n", F.explode(F.sequence(F.col("l_nth") + 1, F.col("l_nth") + most)))
    return ahead.join(right, (F.col("track_id") == F.col("r_track_id")) & (F.col("component") == F.col("r_component")) & (F.col("_n") == F.col("r_nth"))).drop("_n", "r_track_id", "r_component")


def _first(pairs: DataFrame, stop: Column, fits: Column) -> DataFrame:
    """Of each left run the first right one that fits, before any that stops the search."""
    w = Window.partitionBy(*COMPONENT, "l_first").orderBy("r_nth")
    p = pairs.withColumns({"_stop": F.max(stop).over(w), "_fits": fits})
    p = p.where("_fits and not _stop").withColumn("_k", F.row_number().over(w)).where("_k = 1")
    return p.drop("_stop", "_fits", "_k")


def _candidates(pairs: DataFrame, rows: DataFrame, at: Column, score: Column, reasons: list[Column]) -> DataFrame:
    at = F.greatest(F.lit(1), F.least(at, F.col("l_n_rows") - 2))
    times = rows.select(*COMPONENT, "i", "t")
    return pairs.select(*COMPONENT, at.alias("i"), score.alias("score"), F.array(*reasons).alias("reasons")).join(times, [*COMPONENT, "i"]).select(*COMPONENT, "i", "t", "score", "reasons")


def _shape() -> Column:
    return F.when(F.col("l_mode") == "climb", "local_altitude_maximum").otherwise("local_altitude_minimum")


def go_around_candidates(features: DataFrame, bands: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """M9: a sustained descent and, at most three runs later and before another descent, a sustained climb: the lowest row between."""
    points, seconds, least = limits.go_around
    rows, runs = _modes(features.join(bands, COMPONENT), limits, None, F.greatest(F.col("vertical_band"), F.lit(0.75)))
    p = _pairs(runs, 3).where((F.col("l_mode") == "descent") & (F.col("l_n") >= points) & (F.col("l_t1") - F.col("l_t0") >= seconds))
    fits = (F.col("r_mode") == "climb") & (F.col("r_n") >= points) & (F.col("r_t1") - F.col("r_t0") >= seconds) & (F.col("r_first") - F.col("l_last") - 1 <= limits.gap[0]) & (F.col("r_t0") - F.col("l_t1") <= limits.gap[1])
    x = _extreme(p.where(fits | (F.col("r_mode") == "descent")), rows)
    drop, gain = F.col("l_alt") - F.col("at.alt"), F.col("r_alt") - F.col("at.alt")
    x = _first(x, F.col("r_mode") == "descent", fits & (F.greatest(drop, gain) >= least))
    over = lambda c: F.greatest(F.lit(0.0), c)
    score = 60.0 + over(drop) + over(gain) + 2 * F.abs("r_rate") + over(F.col("r_energy_rate")) + over(F.col("r_speed_accel"))
    return _candidates(x, rows, F.col("at.i"), score, [F.lit("go_around_transition"), F.lit("vertical_mode_reversal_descent_to_climb"), F.lit("local_altitude_minimum")])


def vertical_reversal_candidates(features: DataFrame, bands: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """A stable climb or descent and, within three stable runs, another mode: the extreme row between. Rates: half reported, half the altitude's."""
    points, seconds, least = limits.reversal
    rows, runs = _modes(features.join(bands, COMPONENT), limits, 0.5, F.greatest(F.col("vertical_band"), F.lit(0.75)))
    p = _pairs(runs.where((F.col("n") >= points) & (F.col("t1") - F.col("t0") >= seconds)), 3)
    near = (F.col("r_first") - F.col("l_last") - 1 <= limits.gap[0]) & (F.col("r_t0") - F.col("l_t1") <= limits.gap[1])
    same = F.col("r_mode") == F.col("l_mode")
    x = _extreme(p.where(near | same), rows)
    sign = F.when(F.col("l_mode") == "climb", 1.0).otherwise(-1.0)
    before, after = sign * (F.col("at.alt") - F.col("l_alt")), sign * (F.col("at.alt") - F.col("r_alt"))
    total = F.greatest(F.lit(0.0), before) + F.greatest(F.lit(0.0), after)
    x = _first(x, same, near & ~same & (total >= least) & (F.greatest(before, after) >= 0.5 * least))
    # median energy rate from the left run's start to the right one's end: bounded, at most four runs and the rows between
    r = rows.select(*(F.col(k).alias(f"f_{k}") for k in COMPONENT), F.col("i").alias("f_i"), F.col("m_energy_rate").alias("f_e"))
    j = x.join(r, (F.col("track_id") == F.col("f_track_id")) & (F.col("component") == F.col("f_component")) & F.col("f_i").between(F.col("l_first"), F.col("r_last")))
    x = j.groupBy(*x.columns).agg(F.percentile("f_e", 0.5).alias("e"))
    score = 55.0 + total + 2 * F.abs("l_rate") + 2 * F.abs("r_rate") + F.abs("e")
    return _candidates(x, rows, F.col("at.i"), score, [F.lit("vertical_reversal_transition"), F.concat(F.lit("vertical_mode_reversal_"), "l_mode", F.lit("_to_"), "r_mode"), _shape()])


def altitude_lobe_candidates(features: DataFrame, bands: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Opposite stable modes with only level ones between: the extreme row, or after a long shelf the later mode's start. Rates: three
    quarters the altitude's own."""
    points, seconds, least, side, gate = limits.lobe
    rows, runs = _modes(features.join(bands, COMPONENT), limits, 0.75, F.greatest(F.lit(gate), 0.5 * F.col("vertical_band"), F.lit(0.05)))
    stable = runs.where((F.col("n") >= points) & (F.col("t1") - F.col("t0") >= seconds))
    w = Window.partitionBy(*COMPONENT).orderBy("first")
    stable = stable.withColumn("shelf", F.sum(F.when(F.col("mode") == "level", F.col("t1") - F.col("t0")).otherwise(0.0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    p = _pairs(stable.where("mode <> 'level'"), 1).where("l_mode <> r_mode")
    x = _extreme(p, rows)
    sign = F.when(F.col("l_mode") == "climb", 1.0).otherwise(-1.0)
    left, right = sign * (F.col("at.alt") - F.col("l_alt")), sign * (F.col("at.alt") - F.col("r_alt"))
    total = F.greatest(F.lit(0.0), left) + F.greatest(F.lit(0.0), right)
    late = (F.col("r_shelf") - F.col("l_shelf") >= seconds) & (F.col("r_first") > F.col("l_last"))
    x = x.where((total >= least) & (F.least(left, right) >= side))
    score = 70.0 + total + 2 * F.abs("l_rate") + 2 * F.abs("r_rate")
    reasons = [F.lit("altitude_lobe_transition"), F.concat(F.lit("altitude_lobe_"), "l_mode", F.lit("_to_"), "r_mode"), _shape(), F.lit("large_vertical_excursion")]
    c = _candidates(x, rows, F.when(late, F.col("r_first")).otherwise(F.col("at.i")), score, reasons)
    ends = rows.groupBy(*COMPONENT).agg(F.min("t").alias("_a"), F.max("t").alias("_b"), F.count("*").alias("_n"))
    keep = (F.col("i") >= points - 1) & (F.col("_n") - F.col("i") >= points) & (F.col("t") - F.col("_a") >= seconds) & (F.col("_b") - F.col("t") >= seconds)
    return c.join(ends, COMPONENT).where(keep).drop("_a", "_b", "_n")


def spike_candidates(features: DataFrame, columns: tuple[str, ...] = ("accel", "mismatch", "residual"), threshold: float = 6.0) -> DataFrame:
    """Rows whose norm of the chosen z values reaches the threshold."""
    z = F.sqrt(reduce(lambda a, b: a + b, [F.col(f"z_{c}") * F.col(f"z_{c}") for c in columns]))
    return features.withColumn("_z", z).where(F.col("_z") >= threshold).select(*COMPONENT, "i", "t", F.col("_z").alias("score"), F.array(F.lit("feature_spike")).alias("reasons"))


def change_points(values: np.ndarray, penalty: float, least: int) -> list[int]:
    """Starts of the parts, but the first, that minimise squared deviations from part means plus a penalty a part; pruned exact search."""
    n, d = values.shape
    s1, s2 = np.vstack([np.zeros(d), np.cumsum(values, 0)]), np.r_[0.0, np.cumsum((values**2).sum(1))]
    best, last, live = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.array([0])
    best[0] = -penalty
    for end in range(least, n + 1):
        own = live[live <= end - least]
        cost = s2[end] - s2[own] - ((s1[end] - s1[own]) ** 2).sum(1) / (end - own)
        total = best[own] + cost + penalty
        k = int(total.argmin())
        best[end], last[end] = total[k], own[k]
        live = np.r_[own[best[own] + cost <= best[end]], live[live > end - least], end - least + 1]
    out, at = [], n
    while last[at] > 0:
        at = last[at]
        out.append(int(at))
    return out[::-1]


def change_point_candidates(features: DataFrame, columns: tuple[str, ...] = ("vertical_rate", "speed_accel", "signed_heading_rate"), factor: float = 3.0, least: int = 8) -> DataFrame:
    """Change points of z values by component, with the penalty factor * ln(n) * columns. One group a component, its z values only."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("i")
        at = change_points(g[[f"z_{c}" for c in columns]].to_numpy(float), factor * np.log(max(len(g), 2)) * len(columns), least) if len(g) >= 2 * least else []
        return g.iloc[at].assign(score=40.0)[[*COMPONENT, "i", "t", "score"]]

    out = T.spread(features.select(*COMPONENT, "i", "t", *(f"z_{c}" for c in columns)), *COMPONENT).groupBy(*COMPONENT).applyInPandas(run, "track_id string, component int, i long, t double, score double")
    return out.withColumn("reasons", F.array(F.lit("pelt")))


def union_candidates(*tables: DataFrame) -> DataFrame:
    """One row for each sample: the best score, and all different reasons in order."""
    u = reduce(lambda a, b: a.unionByName(b), tables)
    return u.groupBy(*COMPONENT, "i").agg(F.first("t").alias("t"), F.max("score").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"))


def candidate_value(reasons: Column, score: Column) -> Column:
    """The score with what its reasons add."""
    has = lambda *x: reduce(lambda a, b: a | b, [F.array_contains(reasons, y) for y in x])
    bonus = (("turn_state_transition",), 160.0), (("altitude_lobe_transition", "vertical_reversal_transition", "go_around_transition"), 75.0), (("climb_state_transition", "descent_state_transition"), 50.0), (("energy_state_transition",), 12.0), (("rough_air_state_transition",), 30.0), (("pelt",), -10.0)
    return reduce(lambda a, b: a + b, [F.when(has(*names), x).otherwise(0.0) for names, x in bonus], score)


def select_boundaries(candidates: DataFrame, rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Of each component the candidates of highest total value, less 0.01 each, whose neighbours and ends leave every segment
    min_points rows and min_seconds, at most most_segments - 1 and `spacing` apart. Only candidates travel; ties: fewer, then earlier ones."""
    ends = rows.groupBy(*COMPONENT).agg(F.min("t").alias("ta"), F.max("t").alias("tb"), F.count("*").alias("n"))
    fit = (F.col("i") >= 1) & (F.col("i") < F.col("n") - 1) & (F.col("i") + 1 >= limits.min_points) & (F.col("n") - F.col("i") >= limits.min_points) & (F.col("t") - F.col("ta") >= limits.min_seconds) & (F.col("tb") - F.col("t") >= limits.min_seconds)
    c = candidates.join(ends, COMPONENT).where(fit & (F.col("n") >= max(2 * limits.min_points - 1, 4))).select(*COMPONENT, "i", "t", "score", "reasons", (candidate_value(F.col("reasons"), F.col("score")) - 0.01).alias("value"))
    seconds = max(limits.min_seconds, limits.spacing)

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("i").reset_index(drop=True)
        i, t, value, n = g.i.to_numpy(), g.t.to_numpy(), g.value.to_numpy(), len(g)
        free = np.array([np.flatnonzero((i[:k] <= i[k] - limits.min_points + 1) & (t[:k] <= t[k] - seconds)).max(initial=-1) for k in range(n)]) + 1
        most = min(limits.most_segments - 1, n)
        best, take = np.zeros((n + 1, most + 1)), np.zeros((n + 1, most + 1), bool)
        for k in range(n):
            with_ = np.r_[-np.inf, best[free[k], :-1] + value[k]]
            take[k + 1] = with_ > best[k] + 1e-12
            best[k + 1] = np.maximum(best[k], with_)
        k, m, kept = n, int(best[n].argmax()), []
        while k > 0 and m > 0:
            if take[k, m]:
                kept.append(k - 1)
                k, m = int(free[k - 1]), m - 1
            else:
                k -= 1
        return g.iloc[sorted(kept)][[*COMPONENT, "i", "t", "score", "reasons"]]

    return T.spread(c, *COMPONENT).groupBy(*COMPONENT).applyInPandas(choose, "track_id string, component int, i long, t double, score double, reasons array<string>")


def build_segments(rows: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Segment, first, last of each component; both ends belong to a segment, so neighbours share the boundary row."""
    ends = rows.groupBy(*COMPONENT).agg(F.array(F.min("i"), F.max("i")).alias("e")).select(*COMPONENT, F.explode("e").alias("i"))
    cuts = ends.unionByName(boundaries.select(*COMPONENT, "i")).distinct()
    w = Window.partitionBy(*COMPONENT).orderBy("i")
    return cuts.select(*COMPONENT, (F.row_number().over(w) - 1).cast("long").alias("segment"), F.col("i").alias("first"), F.lead("i").over(w).alias("last")).where("last is not null")


def in_segments(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """Rows with their segment, by inclusive index range; a shared row stands in both segments, marked is_left_end and is_right_end."""
    s = segments.withColumnsRenamed({k: f"s_{k}" for k in COMPONENT})
    on = (F.col("track_id") == F.col("s_track_id")) & (F.col("component") == F.col("s_component")) & F.col("i").between(F.col("first"), F.col("last"))
    return rows.join(s, on).withColumns({"is_left_end": F.col("i") == F.col("first"), "is_right_end": F.col("i") == F.col("last")}).drop("s_track_id", "s_component", "first", "last")


def segment_features(features: DataFrame, labels: DataFrame, segments: DataFrame) -> DataFrame:
    """Summaries of each segment: size, medians, p95s and ranges of the features, heading and energy change, dominant labels with
    their shares; and its regime (P29)."""
    keys = [*COMPONENT, "segment"]
    rows = in_segments(features.join(labels.drop("t"), [*COMPONENT, "i"]), segments)
    med = [F.percentile(c, 0.5).alias(f"median_{c}") for c in ("speed", "vertical_rate", "mismatch", "residual", "heading_rate", "signed_heading_rate", "speed_accel", "energy_rate", "lateral_accel", "accel")]
    p95 = [F.percentile(F.abs(c), 0.95).alias(f"p95_{c}") for c in ("heading_rate", "vertical_rate", "accel", "mismatch", "residual", "abs_lateral_accel", "vertical_accel", "speed_accel", "energy_rate")]
    mean = [F.avg(c).alias(f"mean_{c}") for c in ("speed", "vertical_rate", "energy_rate")]
    span = [(F.max_by(c, "i") - F.min_by(c, "i")).alias(n) for c, n in (("z", "altitude_change"), ("speed", "speed_change"), ("energy_height", "energy_change"))]
    g = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"), (F.max("t") - F.min("t")).alias("duration"), (F.max("z") - F.min("z")).alias("altitude_range"), F.max("z").alias("top"), F.min("z").alias("bottom"), *med, *p95, *mean, *span,
    )
    w = Window.partitionBy(*keys).orderBy("t")
    turned = rows.select(*keys, F.coalesce(0.5 * (F.col("signed_heading_rate") + F.lag("signed_heading_rate").over(w)) * (F.col("t") - F.lag("t").over(w)), F.lit(0.0)).alias("d"))
    g = g.join(turned.groupBy(*keys).agg(F.sum("d").alias("heading_change")), keys)
    for c in ("energy", "turn", "regime"):
        g = g.join(T.dominant_label(rows, keys, c).withColumnsRenamed({"label": f"dominant_{c}", "share": f"share_{c}"}), keys)
    return g.withColumn("regime_label", S.classify_regime(F.col("median_speed"), F.col("median_mismatch"), F.col("dominant_regime")))


def segment_tracks(samples: DataFrame, limits: Limits = Limits(), spikes: bool = False, change_points: bool = False) -> dict[str, DataFrame]:
    """Samples -> tables rows, features, labels, candidates, boundaries, segments. Lazy; stage `features` and `labels` where they are used often."""
    rows = component_rows(samples)
    features = motion_features(rows)
    raw = raw_labels(features, limits)
    labels = regime_labels(raw, limits)
    bands = adaptive_deadbands(features, limits)
    kinds = ("energy", "turn", "rough") if limits.rough is not None else ("energy", "turn")
    found = [transition_candidates(labels, features, limits, kinds), go_around_candidates(features, bands, limits), vertical_reversal_candidates(features, bands, limits), altitude_lobe_candidates(features, bands, limits)]
    found += [spike_candidates(features)] if spikes else []
    found += [change_point_candidates(features)] if change_points else []
    candidates = union_candidates(*found)
    boundaries = select_boundaries(candidates, rows, limits)
    return {"rows": rows, "features": features, "labels": labels, "candidates": candidates, "boundaries": boundaries, "segments": build_segments(rows, boundaries)}
