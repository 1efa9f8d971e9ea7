"""Smoothers as grouped jobs: one task group a track, tables in and out."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.operators import timeseries as T
from trackspark.operators.compare import interpolate_columns

#: Fixed values of the presets: position, velocity and jerk sigma as (horizontal, vertical), initial sigmas, gate, largest scale.
PRESETS = {
    "accurate": {"pos": (14.0, 22.0), "vel": (4.5, 2.2), "jerk": (2.4, 1.2), "pos0": (35.0, 55.0), "vel0": (80.0, 30.0), "acc0": (8.0, 4.0), "gate": 5.0, "most": 70.0},
    "balanced": {"pos": (25.0, 40.0), "vel": (8.0, 4.0), "jerk": (1.2, 0.7), "pos0": (60.0, 90.0), "vel0": (80.0, 30.0), "acc0": (8.0, 4.0), "gate": 4.5, "most": 100.0},
    "smooth": {"pos": (55.0, 85.0), "vel": (16.0, 7.5), "jerk": (0.35, 0.20), "pos0": (100.0, 150.0), "vel0": (120.0, 50.0), "acc0": (8.0, 4.0), "gate": 4.0, "most": 150.0},
}
_STATES = [f"{a}{c}" for a in ("", "v", "a") for c in "xyz"]


def _noise(dt: float) -> np.ndarray:
    return np.array([[dt**5 / 20, dt**4 / 8, dt**3 / 6], [dt**4 / 8, dt**3 / 3, dt**2 / 2], [dt**3 / 6, dt**2 / 2, dt]])


#: Rows whose positions give the first acceleration.
HEAD = 7
_H, _EYE, _RIDGE = np.array([[1.0, 0, 0], [0, 1.0, 0]]), np.eye(3), 1e-9


def _axis(p: dict, key: str) -> np.ndarray:
    return np.array([p[key][i] for i in (0, 0, 1)])


def transition(dt: float) -> np.ndarray:
    return np.array([[1, dt, dt * dt / 2], [0, 1, dt], [0, 0, 1]])


def first_state(t: np.ndarray, pos: np.ndarray, vel: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray]:
    """Mean (axis, position velocity acceleration) and covariances of the first row; the acceleration is that of the first HEAD rows' positions."""
    tau = t[:HEAD] - t[0]
    acc0 = np.linalg.lstsq(np.stack([np.ones(len(tau)), tau, tau**2 / 2], 1), pos[:HEAD], rcond=None)[0][2] if len(tau) >= 3 else np.zeros(3)
    c = np.zeros((3, 3, 3))
    for k, key in enumerate(("pos0", "vel0", "acc0")):
        c[:, k, k] = _axis(p, key) ** 2
    return np.stack([pos[0], vel[0], acc0], 1), c


def measurement(p: dict, scale: float) -> np.ndarray:
    r = np.zeros((3, 2, 2))
    r[:, 0, 0], r[:, 1, 1] = scale * _axis(p, "pos") ** 2, scale * _axis(p, "vel") ** 2
    return r


@dataclass
class Filtered:
    """By row: states and covariances after and before the row's measurement, the transition to it, normalised innovation, noise scale, innovation's size."""

    x: np.ndarray
    c: np.ndarray
    xp: np.ndarray
    cp: np.ndarray
    f: np.ndarray
    seen: np.ndarray


def forward(t: np.ndarray, pos: np.ndarray, vel: np.ndarray, p: dict, start: tuple | None = None) -> Filtered:
    """The filter over rows in order. start: time, mean and covariance after the row before them; else first_state() of these rows.

    The axes share the scale of the measurement noise and do not mix otherwise, so three 3 x 3 filters run side by side.
    """
    n = len(t)
    jerk = _axis(p, "jerk") ** 2
    before, x, c = start if start is not None else (None, *first_state(t, pos, vel, p))
    out = Filtered(np.empty((n, 3, 3)), np.empty((n, 3, 3, 3)), np.empty((n, 3, 3)), np.empty((n, 3, 3, 3)), np.tile(_EYE, (n, 1, 1)), np.empty((n, 3)))
    for i in range(n):
        if before is not None:
            dt = max(t[i] - before, 1e-3)
            f = transition(dt)
            x, c = x @ f.T, f @ c @ f.T + jerk[:, None, None] * _noise(dt)
            out.f[i] = f
        before = t[i]
        out.xp[i], out.cp[i] = x, c
        residual = np.stack([pos[i], vel[i]], 1) - x @ _H.T
        nis = float(np.einsum("ai,aij,aj->", residual, np.linalg.inv(_H @ c @ _H.T + measurement(p, 1.0)), residual))
        noise_scale = min(p["most"], max(1.0, nis / (p["gate"] ** 2 * 6)))
        out.seen[i] = nis, noise_scale, np.linalg.norm(residual[:, 0])
        r = measurement(p, noise_scale)
        gain = c @ _H.T @ np.linalg.inv(_H @ c @ _H.T + r)
        x = x + np.einsum("aij,aj->ai", gain, residual)
        a = _EYE - gain @ _H
        c = a @ c @ a.transpose(0, 2, 1) + gain @ r @ gain.transpose(0, 2, 1) + _RIDGE * _EYE
        out.x[i], out.c[i] = x, c
    return out


def backward(s: Filtered, after: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed states and covariances. after: of the row behind the last one its smoothed and predicted state and covariance, and the transition to it."""
    x, c = s.x.copy(), s.c.copy()
    for i in range(len(x) - 1, -1, -1):
        if i == len(x) - 1:
            if after is None:
                continue
            xs, cs, xp, cp, f = after
        else:
            xs, cs, xp, cp, f = x[i + 1], c[i + 1], s.xp[i + 1], s.cp[i + 1], s.f[i + 1]
        g = c[i] @ f.T @ np.linalg.inv(cp)
        x[i] += np.einsum("aij,aj->ai", g, xs - xp)
        c[i] += g @ (cs - cp) @ g.transpose(0, 2, 1)
    return x, c


def constant_acceleration(t: np.ndarray, pos: np.ndarray, vel: np.ndarray, p: dict, told: dict | None = None) -> np.ndarray:
    """Forward filter and backward smoother of position, velocity and acceleration by axis.

    told: gets, by row, the normalised innovation (nis), noise_scale, size of the position's innovation, trace of the smoothed
    covariance, and the filter's own states.
    """
    s = forward(t, pos, vel, p)
    x, c = backward(s)
    if told is not None:
        told |= {"filtered": s.x, "nis": s.seen[:, 0], "noise_scale": s.seen[:, 1], "innovation": s.seen[:, 2], "trace": np.einsum("naii->n", c)}
    return x


def smooth_ca(samples: DataFrame, presets: tuple[str, ...] = ("balanced",)) -> DataFrame:
    """K2: smoothed states of each track and preset; a group that fails carries its error in a row instead of stopping the job."""
    spark = samples.sparkSession
    table = spark.createDataFrame([(p,) for p in presets], "method string")
    more = ("nis", "noise_scale", "innovation", "trace")
    schema = "track_id string, method string, t double, " + ", ".join(f"{c} double" for c in (*_STATES, *more)) + ", error string"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t")
        head = {"track_id": g.track_id.iloc[0], "method": g.method.iloc[0]}
        told: dict = {}
        try:
            s = constant_acceleration(g.t.to_numpy(), g[["x", "y", "z"]].to_numpy(), g[["vx", "vy", "vz"]].to_numpy(), PRESETS[head["method"]], told)
        except np.linalg.LinAlgError as e:
            return pd.DataFrame([head | {"t": None} | dict.fromkeys((*_STATES, *more)) | {"error": str(e)}])
        out = {c: s[:, j % 3, j // 3] for j, c in enumerate(_STATES)} | {c: told[c] for c in more}
        return pd.DataFrame(head | {"t": g.t.to_numpy()} | out | {"error": None})

    return T.spread(samples.crossJoin(F.broadcast(table)), "track_id", "method").groupBy("track_id", "method").applyInPandas(run, schema)


def position_fidelity(samples: DataFrame, render: DataFrame) -> DataFrame:
    """Errors of each method at the samples' times, by linear interpolation of the rendered points."""
    keys = ["track_id", "method"]
    asked = samples.select("track_id", "t", *(F.col(c).alias(f"m{c}") for c in "xyz")).join(render.select(*keys).distinct(), "track_id")
    asked = interpolate_columns(render.where("error is null"), asked, keys, "t", tuple("xyz"))
    e = [F.col(f"m{c}") - F.col(f"p_{c}") for c in "xyz"]
    h, v = F.sqrt(e[0] * e[0] + e[1] * e[1]), F.abs(e[2])
    return asked.groupBy(*keys).agg(
        F.round(T.rms(h), 4).alias("horizontal_rmse"), F.round(T.rms(v), 4).alias("vertical_rmse"), F.round(F.percentile(h, 0.95), 4).alias("horizontal_p95"), F.round(F.max(v), 4).alias("vertical_max"),
    )
