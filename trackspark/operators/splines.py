"""Spline fits and state evaluation: grouped jobs give coefficients or states as tables, native joins evaluate them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.operators import timeseries as T

#: Fixed values of the spline presets: knot spacing (s), observations per basis, velocity weight, eta, Huber delta (m), jerk weight.
PRESETS = {
    "accurate": (3.0, 4, 0.04, 5e4, 60.0, 0.001),
    "balanced": (5.0, 7, 0.03, 1e5, 80.0, 0.002),
    "smooth": (7.0, 10, 0.015, 2.5e5, 120.0, 0.006),
}
MOST_BASES = 900


def basis(knots: np.ndarray, degree: int, t: np.ndarray, derivative: int = 0) -> np.ndarray:
    """Cox-de Boor basis functions, or a derivative of them, at the times t: one row a time."""
    n = len(knots) - degree - 1
    span = np.clip(np.searchsorted(knots, t, "right") - 1, degree, n - 1)
    b = np.zeros((len(t), len(knots) - 1))
    b[np.arange(len(t)), span] = 1.0
    for d in range(1, degree + 1):
        new = np.zeros((len(t), len(knots) - 1 - d))
        rising = d > degree - derivative
        for i in range(len(knots) - 1 - d):
            a, c = knots[i + d] - knots[i], knots[i + d + 1] - knots[i + 1]
            left = b[:, i] / a if a > 0 else 0.0
            right = b[:, i + 1] / c if c > 0 else 0.0
            new[:, i] = d * (left - right) if rising else (t - knots[i]) * left + (knots[i + d + 1] - t) * right
        b = new
    return b


def clamped_knots(t: np.ndarray, spacing: float, per_basis: int, degree: int) -> np.ndarray:
    n = int(min(max(np.ceil((t[-1] - t[0]) / spacing), 1), max(len(t) / per_basis - degree, 1), MOST_BASES - degree))
    return np.concatenate([np.full(degree, t[0]), np.linspace(t[0], t[-1], n + 1), np.full(degree, t[-1])])


def fit_spline(t: np.ndarray, pos: np.ndarray, vel: np.ndarray, preset: str, degree: int = 3, robust: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """K4: knots and coefficients of the penalised least squares on positions and velocities, Huber weights in a few solves."""
    spacing, per_basis, velocity_weight, eta, delta, jerk = PRESETS[preset]
    knots = clamped_knots(t, spacing, per_basis, degree)
    b0, b1 = basis(knots, degree, t), basis(knots, degree, t, 1)
    mid = (knots[degree:-degree - 1] + knots[degree + 1 : -degree]) / 2
    width = np.diff(knots[degree:-degree])
    speed = np.maximum(np.interp(mid, t, np.linalg.norm(vel, axis=1)), 1.0)
    b2 = basis(knots, degree, mid, 2)
    penalty = b2.T @ (b2 * (eta * width / speed**2 / len(t) / 1e4 * width)[:, None])
    b3 = basis(knots, degree, mid, 3)
    penalty += jerk * b3.T @ (b3 * width[:, None])
    w = np.ones(len(t))
    for _ in range(robust + 1):
        a = b0.T @ (b0 * w[:, None]) * 2.0 + velocity_weight * b1.T @ b1 + penalty + 1e-7 * np.eye(b0.shape[1])
        c = np.linalg.solve(a, b0.T @ (pos * w[:, None]) * 2.0 + velocity_weight * b1.T @ vel)
        miss = np.linalg.norm(b0 @ c - pos, axis=1)
        w = np.minimum(1.0, delta / np.maximum(miss, 1e-9))
    return knots, c


def fit_bsplines(samples: DataFrame, presets: tuple[str, ...] = ("balanced",), degree: int = 3, least: int = 8) -> DataFrame:
    """One task group a (track, component, preset); rows: knots and coefficients, or the error."""
    table = F.broadcast(samples.sparkSession.createDataFrame([(p,) for p in presets], "method string"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t").drop_duplicates("t")
        head = {"track_id": g.track_id.iloc[0], "component": int(g.component.iloc[0]), "method": g.method.iloc[0], "t0": g.t.min(), "t1": g.t.max(), "n": len(g)}
        empty = {"knots": None, "cx": None, "cy": None, "cz": None, "rmse": None}
        if len(g) < least:
            return pd.DataFrame([head | empty | {"error": "too few rows"}])
        t = g.t.to_numpy() - head["t0"]
        pos = g[["x", "y", "z"]].to_numpy()
        knots, c = fit_spline(t, pos, g[["vx", "vy", "vz"]].to_numpy(), head["method"], degree)
        rmse = float(np.sqrt(((basis(knots, degree, t) @ c - pos) ** 2).sum(1).mean()))
        return pd.DataFrame([head | {"knots": knots, "cx": c[:, 0], "cy": c[:, 1], "cz": c[:, 2], "rmse": rmse, "error": None}])

    schema = "track_id string, component int, method string, t0 double, t1 double, n long, knots array<double>, cx array<double>, cy array<double>, cz array<double>, rmse double, error string"
    return T.spread(samples.crossJoin(table), "track_id", "component", "method").groupBy("track_id", "component", "method").applyInPandas(run, schema)


def constant_velocity(t: np.ndarray, pos: np.ndarray, vel: np.ndarray, sigma: tuple[float, float] = (25.0, 40.0), accel: tuple[float, float] = (8.0, 4.0), gate: float = 4.5) -> np.ndarray:
    """K1: filter and smoother with states position and velocity, on positions alone; noise grows for outliers."""
    n, pick = len(t), [0, 0, 1]
    s, q = np.array([sigma[i] for i in pick]), np.array([accel[i] for i in pick])
    head = min(n, 5)
    slope = np.polyfit(t[:head] - t[0], pos[:head], 1)[0] if head >= 2 else vel[0]
    x, c = np.stack([pos[0], slope], 1), np.zeros((3, 2, 2))
    c[:, 0, 0], c[:, 1, 1] = 2 * s**2, np.array([120.0, 120.0, 40.0]) ** 2
    xs, cs, xp, cp, fs = np.empty((n, 3, 2)), np.empty((n, 3, 2, 2)), np.empty((n, 3, 2)), np.empty((n, 3, 2, 2)), np.empty((n, 2, 2))
    for i in range(n):
        if i:
            dt = max(t[i] - t[i - 1], 1e-3)
            f = np.array([[1, dt], [0, 1]])
            x, c = x @ f.T, f @ c @ f.T + (q**2)[:, None, None] * np.array([[dt**4 / 4, dt**3 / 2], [dt**3 / 2, dt**2]])
            fs[i] = f
        xp[i], cp[i] = x, c
        r = pos[i] - x[:, 0]
        d2 = float((r**2 / (c[:, 0, 0] + s**2)).sum())
        noise = s**2 * max(1.0, d2 / gate**2)
        gain = c[:, :, 0] / (c[:, 0, 0] + noise)[:, None]
        x = x + gain * r[:, None]
        c = c - gain[:, :, None] * c[:, None, 0, :]
        xs[i], cs[i] = x, c
    for i in range(n - 2, -1, -1):
        g = cs[i] @ fs[i + 1].T @ np.linalg.inv(cp[i + 1])
        xs[i] += np.einsum("aij,aj->ai", g, xs[i + 1] - xp[i + 1])
        cs[i] += g @ (cs[i + 1] - cp[i + 1]) @ g.transpose(0, 2, 1)
    return xs


def smooth_cv(samples: DataFrame) -> DataFrame:
    """K1 by track and component; fewer than four rows come back as they are."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t").reset_index(drop=True)
        pos = g[["x", "y", "z"]].to_numpy()
        s = constant_velocity(g.t.to_numpy(), pos, g[["vx", "vy", "vz"]].to_numpy())[:, :, 0] if len(g) >= 4 else pos
        v = g[["vx", "vy", "vz"]].rolling(5, center=True, min_periods=1).median()
        return pd.DataFrame({"track_id": g.track_id, "component": g.component.astype(int), "t": g.t, "x": s[:, 0], "y": s[:, 1], "z": s[:, 2], "vx": v.vx, "vy": v.vy, "vz": v.vz})

    return samples.groupBy("track_id", "component").applyInPandas(run, "track_id string, component int, t double, x double, y double, z double, vx double, vy double, vz double")


def _bracket(states: DataFrame, queries: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    node = F.struct(F.col("t"), *(F.col(c) for c in columns))
    a = states.select(*keys, F.col("t").alias("_t"), F.lit(0).alias("_q"), node.alias("_n"))
    b = queries.select(*keys, F.col("t").alias("_t"), F.lit(1).alias("_q"), F.lit(None).cast(a.schema["_n"].dataType).alias("_n"))
    u = a.unionByName(b)
    before = Window.partitionBy(*keys).orderBy("_t", "_q").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy(F.desc("_t"), "_q").rowsBetween(Window.unboundedPreceding, 0)
    return u.withColumns({"_a": F.last("_n", ignorenulls=True).over(before), "_b": F.last("_n", ignorenulls=True).over(after)}).where("_q = 1").drop("_q", "_n")


def evaluate_hermite(states: DataFrame, queries: DataFrame, keys: list[str], position: str = "x", velocity: str = "vx") -> DataFrame:
    """K6: cubic Hermite between neighbouring states, linear beyond them; native bracket and polynomial."""
    j = _bracket(states, queries, keys, [position, velocity])
    t, a, b = F.col("_t"), F.col("_a"), F.col("_b")
    h = b["t"] - a["t"]
    u = (t - a["t"]) / h
    y = (2 * u * u * u - 3 * u * u + 1) * a[position] + (u * u * u - 2 * u * u + u) * h * a[velocity] + (-2 * u * u * u + 3 * u * u) * b[position] + (u * u * u - u * u) * h * b[velocity]
    out = F.when(a.isNull(), b[position] + b[velocity] * (t - b["t"])).when(b.isNull() | (h <= 0), a[position] + a[velocity] * (t - a["t"])).otherwise(y)
    return j.select(*keys, F.col("_t").alias("t"), out.alias(position))


def adaptive_interval_weight(df: DataFrame, keys: list[str], eta: float, floor: float = 1.0) -> DataFrame:
    """Eta * dt / max(speed^2, floor^2) of each interval, from the speed of its two ends."""
    w = Window.partitionBy(*keys).orderBy("t")
    speed: Column = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy") + F.col("vz") * F.col("vz"))
    s = df.withColumn("_s", speed)
    dt, mean = F.col("t") - F.lag("t").over(w), (F.col("_s") + F.lag("_s").over(w)) / 2
    return s.withColumn("interval_weight", eta * dt / F.greatest(mean * mean, F.lit(floor * floor))).drop("_s")


def boundary_states(samples: DataFrame, boundaries: DataFrame, half: int = 5) -> DataFrame:
    """K8: position, velocity and acceleration at each boundary from a robust quadratic on at most 11 rows; one group a boundary."""
    s = samples.select(F.col("track_id").alias("s_track"), F.col("i").alias("s_i"), F.col("t").alias("s_t"), "x", "y", "z")
    near = boundaries.join(s, (F.col("track_id") == F.col("s_track")) & F.col("s_i").between(F.col("sample_index") - half, F.col("sample_index") + half))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("s_t")
        at = g[g.s_i == g.sample_index]
        t0 = float(at.s_t.iloc[0]) if len(at) else float(g.s_t.mean())
        tau, pos = g.s_t.to_numpy() - t0, g[["x", "y", "z"]].to_numpy()
        a = np.stack([np.ones(len(tau)), tau, tau**2 / 2], 1)
        w = np.ones(len(tau))
        for _ in range(3):
            c = np.linalg.lstsq(a * w[:, None], pos * w[:, None], rcond=None)[0]
            miss = np.linalg.norm(a @ c - pos, axis=1)
            scale = 1.4826 * np.median(np.abs(miss - np.median(miss))) + 1e-9
            w = np.sqrt(np.minimum(1.0, 1.345 * scale / np.maximum(miss, 1e-9)))
        raw = at[["x", "y", "z"]].to_numpy()[0] if len(at) else c[0]
        p = 0.35 * raw + 0.65 * c[0]
        acc = np.clip(c[2], -30, 30)
        out = {"track_id": g.track_id.iloc[0], "sample_index": int(g.sample_index.iloc[0]), "t": t0, "confidence": 1 / (1 + float(miss.mean()) / 50)}
        return pd.DataFrame([out | {f"{k}{d}": v for k, vec in (("", p), ("v", c[1]), ("a", acc)) for d, v in zip("xyz", vec, strict=True)}])

    schema = "track_id string, sample_index long, t double, confidence double, " + ", ".join(f"{k}{d} double" for k in ("", "v", "a") for d in "xyz")
    return near.groupBy("track_id", "sample_index").applyInPandas(run, schema)
