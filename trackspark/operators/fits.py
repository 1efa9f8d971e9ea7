"""Spline fits of segments: configurations as data, one grouped job for each family, tables in and out.

A fit row holds knots and coefficients of one (track, component, segment, method), its diagnostics, or an error; render_fits() turns
rows into frames. Everything around the solvers (policies, states, joins, holdouts, limits) is native.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.functions import scalars as S
from trackspark.operators import banded
from trackspark.operators import timeseries as T
from trackspark.operators.banded import local_basis
from trackspark.operators.regimes import COMPONENT

SEGMENT = [*COMPONENT, "segment"]
PRESETS = ("accurate", "balanced", "smooth")


@dataclass(frozen=True)
class Config:
    """What a fit minimises: weights of positions, velocities, anchors' priors and of the integrals of squared derivatives; and on what: rows
    up to `overlap` seconds beyond the segment, or the `whole` component, with the share of filter states in the boundary states."""

    family: str = "bspline"
    degree: int = 3
    spacing: float = 5.0
    per_basis: float = 7.0
    position: float = 2.0
    velocity: float = 0.03
    eta: float = 1e5
    delta: float = 80.0
    jerk: float = 0.002
    snap: float = 0.0
    accel: float = 1.0
    position_prior: float = 0.0
    velocity_prior: float = 0.0
    accel_prior: float = 0.08
    floor: float = 1.0
    anchored: bool = True
    guard: float = 0.0
    guard_factor: float = 1.0
    overlap: float = 0.0
    robust: int = 2
    filter_blend: float = 0.0
    whole: bool = False
    hard_velocity: bool = False


_BASE = {
    "accurate": Config(spacing=3, per_basis=4, velocity=0.04, eta=5e4, delta=60, jerk=0.001, accel_prior=0.04),
    "balanced": Config(),
    "smooth": Config(spacing=7, per_basis=10, velocity=0.015, eta=2.5e5, delta=120, jerk=0.006, accel_prior=0.14),
}
_HERMITE = {"accurate": (0.02, 6e4), "balanced": (0.015, 1.2e5), "smooth": (0.008, 2.8e5)}


def variants() -> dict[str, Config]:
    """Configurations of eight families in three presets, by name family_preset."""
    out = {}
    for k, p in enumerate(PRESETS):
        base = _BASE[p]
        velocity, eta = _HERMITE[p]
        pick = lambda *x: x[k]  # noqa: B023, E731
        quintic = replace(
            base, degree=5, accel_prior=pick(0.18, 0.20, 1.05), jerk=pick(0.020, 0.025, 0.110), snap=pick(0.0005, 0.001, 0.008), velocity=pick(0.020, 0.015, base.velocity), per_basis=max(base.per_basis, pick(5, 5, 9)),
            position=pick(1.6, 1.6, base.position), floor=pick(20.0, 20.0, base.floor), guard=pick(8.0, 8.0, 0.0), guard_factor=pick(4.0, 4.0, 1.0), velocity_prior=0.05,
        )
        hermite = replace(base, family="hermite", velocity=velocity, eta=eta)
        out |= {
            f"piecewise_{p}": base, f"hermite_{p}": hermite, f"global_{p}": replace(base, anchored=False, accel_prior=0.0, whole=True), f"overlap_{p}": replace(base, velocity_prior=0.15, overlap=pick(10.0, 16.0, 28.0)),
            f"join_smooth_{p}": replace(base, accel_prior=pick(0.22, 0.45, 0.90), jerk=pick(0.015, 0.035, 0.080)), f"stable_hermite_{p}": replace(hermite, velocity=velocity * 0.25, floor=pick(25.0, 35.0, 45.0)),
            f"quintic_{p}": quintic, f"quintic_filter_{p}": replace(quintic, filter_blend=0.5),
        }
    return out


#: Other names of presets and families.
ALIASES = {"position": "accurate", "default": "balanced", "motion": "smooth", "cubic": "piecewise", "bspline": "piecewise", "hermite_v_spline": "hermite", "whole": "global"}


def method_name(name: str) -> str:
    """A method's canonical name; an unknown one is an error."""
    parts = name.lower().replace("-", "_").split("_")
    head, tail = "_".join(parts[:-1]) or "piecewise", parts[-1]
    out = f"{ALIASES.get(head, head)}_{ALIASES.get(tail, tail)}"
    if out not in variants():
        raise ValueError(f"no method {name}")
    return out


class Methods:
    """A registry name -> (configuration, function of a group's arrays to a row); the built-in families are there from the start."""

    def __init__(self):
        self.known = {n: (c, solve_hermite if c.family == "hermite" else solve_bspline) for n, c in variants().items()} | {f"searched_hermite_{p}": (variants()[f"hermite_{p}"], solve_searched) for p in PRESETS}

    def register(self, name: str, config: Config, solve) -> None:
        if name in self.known:
            raise ValueError(f"{name} is registered already")
        self.known[name] = (config, solve)

    def can_fit(self, name: str) -> bool:
        return name in self.known


def interval_weights(t: np.ndarray, pos: np.ndarray, cfg: Config, ends: tuple[float, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Eta * dt / max(speed^2, floor^2) of each interval; and the factor of jerk and snap near true ends, which falls off quadratically."""
    dt = np.diff(t)
    speed = np.linalg.norm(np.diff(pos, axis=0), axis=1) / np.maximum(dt, 1e-9)
    lam = cfg.eta * dt / np.maximum(speed**2, cfg.floor**2) * cfg.accel
    factor = np.ones(len(dt))
    mid = (t[1:] + t[:-1]) / 2
    for e in ends if cfg.guard > 0 and cfg.guard_factor > 1 else ():
        away = np.abs(mid - e) / cfg.guard
        factor = np.maximum(factor, np.where(away <= 1, 1 + (cfg.guard_factor - 1) * (1 - away) ** 2, 1.0))
    return lam, factor


def velocity_confidence(t: np.ndarray, pos: np.ndarray, vel: np.ndarray, gate: float = 55.0, vertical: float = 9.0, angle: float = 35.0, still: float = 3.0, near: float = 10.0) -> np.ndarray:
    """M17 of a fit's own rows, as features.velocity_confidence(): agreement with the two-point slope in size, height and direction, and motion."""
    if len(t) < 2 or not (np.diff(t) > 0).all():
        return np.ones(len(t))
    slope = _slope(t, pos)
    miss = np.linalg.norm(vel - slope, axis=1)
    out = np.where(miss > 3 * gate, 0.0, np.minimum(1.0, gate / np.maximum(miss, gate)))
    out *= np.minimum(1.0, vertical / np.maximum(np.abs(vel[:, 2] - slope[:, 2]), vertical))
    reported, moved = (np.linalg.norm(v[:, :2], axis=1) for v in (vel, slope))
    apart = np.degrees(np.arccos(np.clip((vel[:, :2] * slope[:, :2]).sum(1) / np.maximum(reported * moved, 1e-9), -1, 1)))
    out *= np.where((reported < still) | (moved < still), 1.0, np.minimum(1.0, angle / np.maximum(apart, angle)))
    step = np.linalg.norm(np.diff(pos, axis=0), axis=1)
    return np.where((moved < still) | (np.minimum(np.r_[step[0], step], np.r_[step, step[-1]]) < near), 0.0, out)


def _slope(t: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Two-point differences: over both neighbours inside, over one at the ends."""
    before, after = np.maximum(np.arange(len(t)) - 1, 0), np.minimum(np.arange(len(t)) + 1, len(t) - 1)
    return (pos[after] - pos[before]) / np.maximum(t[after] - t[before], 1e-9)[:, None]


def velocity_scale(t: np.ndarray, pos: np.ndarray, vel: np.ndarray, gate: float = 50.0) -> np.ndarray:
    """Gate / mismatch beyond the gate, 0 beyond three gates, against the two-point slope of positions; times M17."""
    miss = np.linalg.norm(_slope(t, pos) - vel, axis=1) if len(t) > 1 else np.zeros(len(t))
    return np.where(miss > 3 * gate, 0.0, np.minimum(1.0, gate / np.maximum(miss, gate))) * velocity_confidence(t, pos, vel)


def knot_vector(t: np.ndarray, cfg: Config, at: np.ndarray, most: int = 900) -> np.ndarray:
    """Clamped knots: even ones at the spacing, and those asked for, within the rows a basis function must have."""
    d = cfg.degree
    room = max(min(most, max(d + 1, int(len(t) / cfg.per_basis))), d + 1 + len(at)) - d - 1
    span = t[-1] - t[0]
    spacing = max(cfg.spacing, 1.0)
    even = np.arange(t[0] + spacing, t[-1] - 1e-9, spacing)
    if len(even) > room:
        even = np.linspace(t[0], t[-1], room + 2)[1:-1]
    inner = np.unique(np.round(np.r_[even, at[(at > t[0] + 1e-9) & (at < t[-1] - 1e-9)]], 9))
    if len(inner) > room:
        keep = np.linspace(t[0], t[-1], max(room - len(at), 0) + 2)[1:-1]
        inner = np.unique(np.round(np.r_[keep, at[(at > t[0]) & (at < t[-1])]], 9))
    return np.r_[np.full(d + 1, t[0]), inner[(inner > t[0]) & (inner < t[0] + span)], np.full(d + 1, t[-1])]


_GAUSS = np.polynomial.legendre.leggauss(3)


def solve_bspline(t: np.ndarray, pos: np.ndarray, vel: np.ndarray, cfg: Config, anchors: list[dict] = (), ends: tuple[float, ...] = (), scale: np.ndarray | None = None) -> dict:
    """K4: anchors (t, p and, as priors, v, a, c) are met exactly under multipliers, or in part by cfg.position_prior; velocities too with
    cfg.hard_velocity; Huber weights in robust + 1 solves. The integrals of squared derivatives count once for each row.

    The normal matrix has degree + 1 bands, so time and memory are linear in the rows, also for a whole component.
    """
    n, d = len(t), cfg.degree
    knots = knot_vector(t, cfg, np.array([a["t"] for a in anchors], float))
    rows = [local_basis(knots, d, t, k) for k in (0, 1)]
    m = len(knots) - d - 1
    lam, factor = interval_weights(t, pos, cfg, ends)
    grid = np.unique(np.r_[t, knots])
    h = np.diff(grid)
    x = ((grid[:-1, None] + grid[1:, None]) / 2 + h[:, None] / 2 * _GAUSS[0]).ravel()
    w = (h[:, None] / 2 * _GAUSS[1]).ravel()
    of = np.clip(np.searchsorted(t, x, "right") - 1, 0, n - 2)
    fixed = np.zeros((d + 1, m))
    for order, weight in ((2, lam[of]), (3, cfg.jerk * factor[of]), (4, cfg.snap * factor[of])):
        if order <= d and np.any(weight > 0):
            fixed += n * banded.normal(*local_basis(knots, d, x, order), w * weight, m)
    vs = velocity_scale(t, pos, vel) if scale is None else scale
    fixed += banded.normal(*rows[1], cfg.velocity * vs, m)
    fixed[0] += 1e-7
    right = banded.transposed(*rows[1], cfg.velocity * vs[:, None] * vel, m)
    held, target = [], []
    priors: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {"p": [], "v": [], "a": []}
    for a in anchors:
        for key, order, weight in (("p", 0, cfg.position_prior), ("v", 1, cfg.velocity_prior), ("a", 2, cfg.accel_prior)):
            if a.get(key) is None or order > d:
                continue
            at, row = local_basis(knots, d, np.array([float(a["t"])]), order)
            value = np.asarray(a[key], float)
            if cfg.anchored and (key == "p" and cfg.position_prior == 0 or key == "v" and cfg.hard_velocity):
                held.append(banded.dense(at, row, m)[0])
                target.append(value)
            elif weight > 0:
                own = np.array([weight * (0.25 + 0.75 * a.get("c", 1.0))])
                fixed += banded.normal(at, row, own, m)
                right += banded.transposed(at, row, own[:, None] * value[None], m)
            else:
                continue
            priors[key].append((banded.dense(at, row, m)[0], value))
    held, target = np.array(held).reshape(-1, m), np.array(target).reshape(-1, 3)
    weight = np.ones(n)
    for k in range(cfg.robust + 1):
        low = banded.factor(fixed + banded.normal(*rows[0], cfg.position * weight, m))
        c = banded.constrained(low, right + banded.transposed(*rows[0], cfg.position * weight[:, None] * pos, m), held, target)
        miss = np.linalg.norm(banded.applied(*rows[0], c) - pos, axis=1)
        if k < cfg.robust:
            weight = np.minimum(1.0, cfg.delta / np.maximum(miss, cfg.delta))
    velocity = np.linalg.norm(banded.applied(*rows[1], c) - vel, axis=1)
    off = {k: np.array([np.linalg.norm(row @ c - value) for row, value in v]) for k, v in priors.items()}
    return {"degree": d, "knots": knots, "cx": c[:, 0], "cy": c[:, 1], "cz": c[:, 2], "n_basis": m, "least_weight": float(weight.min())} | _told(miss, velocity, lam, vs, off)


def _told(miss: np.ndarray, velocity: np.ndarray, lam: np.ndarray, vs: np.ndarray, off: dict[str, np.ndarray]) -> dict:
    """Errors of a fit at its rows and at its anchors (p position, v velocity, a acceleration; NULL without such anchors), and its weights."""
    out = {"rmse": float(np.sqrt((miss**2).mean())), "p95": float(np.quantile(miss, 0.95)), "most": float(miss.max()), "velocity_rmse": float(np.sqrt((velocity**2).mean()))}
    for key, name in (("p", "anchor"), ("v", "anchor_velocity"), ("a", "anchor_accel")):
        known = len(off.get(key, ())) > 0
        out |= {f"{name}_error": float(off[key].max()) if known else None, f"{name}_p95": float(np.quantile(off[key], 0.95)) if known else None}
    return out | {"lambda_low": float(lam.min(initial=np.inf)), "lambda_high": float(lam.max(initial=0)), "velocity_weight_low": float(vs.min()), "velocity_weight_median": float(np.median(vs))}


def _blocks(t: np.ndarray, lam: np.ndarray, gamma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and upper blocks (2 x 2, of position and velocity) of D + n * Omega."""
    n = len(t)
    h, w = np.diff(t), n * lam
    diag, upper = np.zeros((n, 2, 2)), np.zeros((n - 1, 2, 2))
    diag[:, 0, 0], diag[:, 1, 1] = 1.0, gamma
    diag[:-1] += np.moveaxis(w * np.array([[12 / h**3, 6 / h**2], [6 / h**2, 4 / h]]), 2, 0)
    diag[1:] += np.moveaxis(w * np.array([[12 / h**3, -6 / h**2], [-6 / h**2, 4 / h]]), 2, 0)
    upper[:] = np.moveaxis(w * np.array([[-12 / h**3, 6 / h**2], [-6 / h**2, 2 / h]]), 2, 0)
    return diag, upper


def solve_blocks(diag: np.ndarray, upper: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block-tridiagonal solution, and the diagonal blocks of the inverse: linear in the number of nodes."""
    n = len(diag)
    ahead, y = np.empty_like(diag), right.copy()
    ahead[0] = diag[0]
    for i in range(1, n):
        k = upper[i - 1].T @ np.linalg.inv(ahead[i - 1])
        ahead[i] = diag[i] - k @ upper[i - 1]
        y[i] = right[i] - k @ y[i - 1]
    x = np.empty_like(y)
    x[-1] = np.linalg.solve(ahead[-1], y[-1])
    for i in range(n - 2, -1, -1):
        x[i] = np.linalg.solve(ahead[i], y[i] - upper[i] @ x[i + 1])
    inverse = np.empty_like(diag)
    inverse[-1] = np.linalg.inv(ahead[-1])
    for i in range(n - 2, -1, -1):
        g = np.linalg.inv(ahead[i])
        k = g @ upper[i]
        inverse[i] = g + k @ inverse[i + 1] @ k.T
    return x, inverse


def solve_hermite(t: np.ndarray, pos: np.ndarray, vel: np.ndarray, cfg: Config, anchors: list[dict] = (), ends: tuple[float, ...] = (), scale: np.ndarray | None = None) -> dict:
    """K5 and K7's score: nodal positions and velocities; the entries of anchors, which must stand at rows, are held. loocv: leave-one-out
    error from the diagonal of the smoother, over entries that are free."""
    vs = velocity_scale(t, pos, vel) if scale is None else scale
    lam, _ = interval_weights(t, pos, cfg, ends)
    held = {}
    for a in anchors:
        node = int(np.abs(t - a["t"]).argmin())
        if abs(t[node] - a["t"]) > 1e-6:
            raise ValueError(f"an anchor at {a['t']} s stands at no row")
        if cfg.anchored:
            held |= {(node, k): np.asarray(a[key], float) for k, key in ((0, "p"), (1, "v")) if a.get(key) is not None}
    theta, loocv = hermite_nodes(t, pos, vel, lam, cfg.velocity * vs, held)
    miss, velocity = np.linalg.norm(theta[:, 0] - pos, axis=1), np.linalg.norm(theta[:, 1] - vel, axis=1)
    off = {key: np.array([np.linalg.norm(theta[int(np.abs(t - a["t"]).argmin()), k] - np.asarray(a[key], float)) for a in anchors if a.get(key) is not None]) for k, key in ((0, "p"), (1, "v"))}
    return {"degree": 3, "knots": t, "cx": theta[:, :, 0].ravel(), "cy": theta[:, :, 1].ravel(), "cz": theta[:, :, 2].ravel(), "n_basis": 2 * len(t), "least_weight": 1.0, "loocv": loocv} | _told(miss, velocity, lam, vs, off)


def hermite_nodes(t: np.ndarray, pos: np.ndarray, vel: np.ndarray, lam: np.ndarray, gamma: np.ndarray, held: dict[tuple[int, int], np.ndarray] | None = None) -> tuple[np.ndarray, float]:
    """Nodes (row, position and velocity, axis) of the block-tridiagonal system with the held entries eliminated, and the leave-one-out score."""
    n, held = len(t), held or {}
    diag, upper = _blocks(t, lam, gamma)
    data, weight = np.stack([pos, vel], 1), np.stack([np.ones(n), gamma], 1)
    right = weight[:, :, None] * data
    for (node, k), value in held.items():
        right[node] -= diag[node][:, k, None] * value
        if node:
            right[node - 1] -= upper[node - 1][:, k, None] * value
            upper[node - 1][:, k] = 0
        if node < n - 1:
            right[node + 1] -= upper[node][k, :, None] * value
            upper[node][k] = 0
        diag[node][k], diag[node][:, k] = 0, 0
        diag[node][k, k] = 1.0
    for (node, k), value in held.items():
        right[node, k] = value
    theta, inverse = solve_blocks(diag, upper, right)
    free = np.ones((n, 2), bool)
    for entry in held:
        free[entry] = False
    lever = np.maximum(1 - np.stack([inverse[:, 0, 0], inverse[:, 1, 1]], 1) * weight, 1e-6)
    scaled = (theta - data) / lever[:, :, None]
    return theta, float((weight[:, :, None] * scaled**2)[free].sum() / max(3 * free[:, 0].sum(), 1))


#: K7: bounds of log10 of eta and of the velocity weight, the first step and the least one.
SEARCH = ((2.0, 7.0), (-3.0, 0.5), 1.0, 0.05)


def search_hermite(t: np.ndarray, pos: np.ndarray, vel: np.ndarray, cfg: Config, bounds: tuple = SEARCH) -> tuple[Config, float, int]:
    """K7: eta and velocity weight of least leave-one-out error, its value and the number of solves.

    A pattern search from cfg in log10 space: the first of four neighbours, and of the last move's repetition, that is better is the
    next place, and a place without a better neighbour halves the step. The slopes, the intervals' shape and M17 x M18 are computed
    once; each place scales them and solves the block-tridiagonal system. No derivative is used, and a place is never solved twice.
    """
    (e0, e1), (g0, g1), step, least = bounds
    vs = velocity_scale(t, pos, vel)
    shape, _ = interval_weights(t, pos, replace(cfg, eta=1.0))
    known: dict[tuple[float, float], float] = {}

    def cost(at: tuple[float, float]) -> float:
        if at not in known:
            try:
                known[at] = hermite_nodes(t, pos, vel, 10.0 ** at[0] * shape, 10.0 ** at[1] * vs)[1]
            except np.linalg.LinAlgError:
                known[at] = np.inf
        return known[at]

    inside = lambda e, g: (float(np.clip(e, e0, e1)), float(np.clip(g, g0, g1)))
    now, move = inside(np.log10(cfg.eta), np.log10(max(cfg.velocity, 1e-9))), (0.0, 0.0)
    while step >= least:
        tries = [move, (step, 0.0), (-step, 0.0), (0.0, step), (0.0, -step)]
        better = next((to for d in tries if (to := inside(now[0] + d[0], now[1] + d[1])) != now and cost(to) < cost(now)), None)
        if better is None:
            step, move = step / 2, (0.0, 0.0)
        else:
            now, move = better, (better[0] - now[0], better[1] - now[1])
    return replace(cfg, eta=10.0 ** now[0], velocity=10.0 ** now[1]), cost(now), len(known)


def solve_searched(t: np.ndarray, pos: np.ndarray, vel: np.ndarray, cfg: Config, anchors: list[dict] = (), ends: tuple[float, ...] = (), scale: np.ndarray | None = None) -> dict:
    """K7 and K5: the Hermite fit at the searched weights; eta, velocity weight and number of solves stand beside its diagnostics."""
    found, _, solves = search_hermite(t, pos, vel, cfg)
    return solve_hermite(t, pos, vel, found, anchors, ends, scale) | {"eta": found.eta, "velocity_weight": found.velocity, "n_solves": solves}


def evaluate_fit(fit: dict, tau: np.ndarray) -> np.ndarray:
    """Position, velocity and acceleration (time, order, axis) of a fit at seconds from its t0; Hermite fits go on in a line outside."""
    c = np.stack([np.asarray(fit[k], float) for k in ("cx", "cy", "cz")], 1)
    knots = np.asarray(fit["knots"], float)
    if fit["family"] != "hermite":
        return np.stack([banded.applied(*local_basis(knots, int(fit["degree"]), tau, k), c) for k in range(3)], 1)
    theta = c.reshape(-1, 2, 3)
    k = np.clip(np.searchsorted(knots, tau, "right") - 1, 0, len(knots) - 2)
    h = (knots[k + 1] - knots[k])[:, None]
    u = np.clip((tau - knots[k])[:, None] / h, 0, 1)
    p0, v0, p1, v1 = theta[k, 0], theta[k, 1] * h, theta[k + 1, 0], theta[k + 1, 1] * h
    value = (2 * u**3 - 3 * u**2 + 1) * p0 + (u**3 - 2 * u**2 + u) * v0 + (3 * u**2 - 2 * u**3) * p1 + (u**3 - u**2) * v1
    slope = ((6 * u**2 - 6 * u) * p0 + (3 * u**2 - 4 * u + 1) * v0 + (6 * u - 6 * u**2) * p1 + (3 * u**2 - 2 * u) * v1) / h
    bend = ((12 * u - 6) * p0 + (6 * u - 4) * v0 + (6 - 12 * u) * p1 + (6 * u - 2) * v1) / h**2
    outside = tau[:, None] - np.clip(tau, knots[0], knots[-1])[:, None]
    return np.stack([value + slope * outside, slope, np.where(outside == 0, bend, 0.0)], 1)


_DIAGNOSTICS = (
    "rmse", "p95", "most", "velocity_rmse", "anchor_error", "anchor_p95", "anchor_velocity_error", "anchor_velocity_p95", "anchor_accel_error", "anchor_accel_p95", "lambda_low", "lambda_high", "least_weight",
    "velocity_weight_low", "velocity_weight_median", "loocv", "eta", "velocity_weight", "n_solves",
)
FIT_SCHEMA = (
    "track_id string, component int, segment long, method string, family string, t0 double, t1 double, n long, degree int, n_basis int, knots array<double>, cx array<double>, cy array<double>, cz array<double>, "
    + ", ".join(f"{c} double" for c in _DIAGNOSTICS) + ", error string"
)
_STATE = [f"b_{k}{c}" for k in ("p", "v", "a") for c in "xyz"] + ["b_c"]


def with_states(rows: DataFrame, states: DataFrame | None) -> DataFrame:
    """Rows of segments with the shared state of their boundary row (NULL elsewhere and at component ends)."""
    if states is None:
        return rows.withColumns({c: F.lit(None).cast("double") for c in _STATE})
    s = states.select(*COMPONENT, "i", *(F.col(c).alias(f"b_p{c}") for c in "xyz"), *(F.col(f"{k}{c}").alias(f"b_{k}{c}") for k in "va" for c in "xyz"), F.col("confidence").alias("b_c"))
    return rows.join(s, [*COMPONENT, "i"], "left")


def blended_states(states: DataFrame, filtered: DataFrame, share: float = 0.5) -> DataFrame:
    """Boundary states moved by `share` towards the filter's states (track_id, t, x..az) at their times; confidence grows by 0.15, to 1 at
    most. A boundary without such a state stays as it is."""
    own = filtered.groupBy("track_id", "t").agg(*(F.first(f"{k}{c}").alias(f"_{k}{c}") for k in ("", "v", "a") for c in "xyz"))
    j = states.join(own, ["track_id", "t"], "left")
    known = F.col("_x").isNotNull()
    moved = {f"{k}{c}": F.when(known, (1 - share) * F.coalesce(F.col(f"{k}{c}"), F.col(f"_{k}{c}")) + share * F.col(f"_{k}{c}")).otherwise(F.col(f"{k}{c}")) for k in ("", "v", "a") for c in "xyz"}
    return j.withColumns(moved | {"confidence": F.when(known, F.least(F.lit(1.0), F.greatest("confidence", F.lit(0.0)) + 0.15)).otherwise(F.col("confidence"))}).select(*states.columns)


def _extended(rows: DataFrame, guard: float, hard: DataFrame | None) -> DataFrame:
    """K11 of rows that carry their segment: each segment's rows and, marked guard, its neighbours' within `guard` seconds, with the segment's own parameters."""
    own = [c for c in rows.columns if c.startswith("p_")]
    segments = rows.groupBy(*SEGMENT).agg(F.min("i").alias("first"), F.max("i").alias("last"), *(F.first(c).alias(c) for c in own))
    plain = rows.select(*COMPONENT, "i", "t", *_AXES).dropDuplicates([*COMPONENT, "i"])
    return overlapping(plain, segments.select(*SEGMENT, "first", "last"), guard, hard).join(segments.drop("first", "last"), SEGMENT)


_AXES = ("x", "y", "z", "vx", "vy", "vz")


def fit_segments(
    rows: DataFrame, methods: Iterable[str] = ("piecewise_balanced",), states: DataFrame | None = None, registry: Methods | None = None, least: int = 4, filtered: DataFrame | None = None, hard: DataFrame | None = None,
) -> DataFrame:
    """rows(track_id, component, segment, i, t, x..vz) -> a fit of each segment and method.

    Methods with an overlap also see the rows that far beyond their segment (K11), never across the boundaries `hard`; t0 and t1 are
    those of the segment's own rows. Methods of whole components give one fit each, as segment 0, without joins. Methods with a filter
    blend move the states towards those of `filtered` (K2's rows), which they need. Rows may carry parameters (P31) as columns
    p_<field of Config>, which replace those of methods that fit segments. True component ends get the end guard (K14). A fit that
    fails is a row with its error. A group of rows is sent once for all its methods.
    """
    registry = registry or Methods()
    names = list(methods)
    for name in names:
        if not registry.can_fit(name):
            raise ValueError(f"no method {name}")
    if filtered is None and any(registry.known[n][0].filter_blend for n in names):
        raise ValueError("methods with a filter blend need the filter's states")
    kinds: dict[tuple, list[str]] = {}
    for name in names:
        c = registry.known[name][0]
        kinds.setdefault((c.whole, c.overlap, c.filter_blend), []).append(name)
    out = None
    for (whole, overlap, blend), own in kinds.items():
        data = rows if "guard" in rows.columns else rows.withColumn("guard", F.lit(False))
        if whole:
            data = rows.select(*COMPONENT, F.lit(0).cast("long").alias("segment"), "i", "t", *_AXES).dropDuplicates([*COMPONENT, "i"]).withColumn("guard", F.lit(False))
        elif overlap > 0 and "guard" not in rows.columns:
            data = _extended(rows, overlap, hard)
        at = None if whole or states is None else blended_states(states, filtered, blend) if blend else states
        part = _fit_groups(data, {n: registry.known[n] for n in own}, at, least)
        out = part if out is None else out.unionByName(part)
    return out


def _fit_groups(data: DataFrame, chosen: dict, states: DataFrame | None, least: int) -> DataFrame:
    own = [c[2:] for c in data.columns if c.startswith("p_")]
    part = Window.partitionBy(*COMPONENT)
    data = with_states(data, states).withColumns({"_first": F.min("t").over(part), "_last": F.max("t").over(part)})

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t").drop_duplicates("t")
        inner = g[~g.guard]
        head = {"track_id": g.track_id.iloc[0], "component": int(g.component.iloc[0]), "segment": int(g.segment.iloc[0]), "t0": float(inner.t.min()), "t1": float(inner.t.max()), "n": len(inner), "error": None}
        empty = dict.fromkeys(["degree", "n_basis", "knots", "cx", "cy", "cz", *_DIAGNOSTICS])
        t = g.t.to_numpy() - head["t0"]
        pos, vel = g[["x", "y", "z"]].to_numpy(float), g[["vx", "vy", "vz"]].to_numpy(float)
        shared = []
        for j in np.flatnonzero(g.b_px.notna().to_numpy()):
            r = g.iloc[j]
            shared.append({"t": float(t[j]), "p": [r.b_px, r.b_py, r.b_pz], "v": [r.b_vx, r.b_vy, r.b_vz], "a": None if pd.isna(r.b_ax) else [r.b_ax, r.b_ay, r.b_az], "c": float(r.b_c)})
        true_ends = [j for j in (0, len(t) - 1) if g.t.iloc[j] in (g._first.iloc[0], g._last.iloc[0])]
        ends = tuple(x - head["t0"] for x in (g._first.iloc[0], g._last.iloc[0]))
        out = []
        for name, (cfg, solve) in chosen.items():
            row = head | empty | {"method": name, "family": cfg.family}
            if len(g) < least or head["t0"] >= head["t1"]:
                out.append(row | {"error": "too few rows"})
                continue
            if not cfg.whole:
                cfg = replace(cfg, **{k: type(getattr(cfg, k))(g[f"p_{k}"].iloc[0]) for k in own if pd.notna(g[f"p_{k}"].iloc[0])})
            anchors = shared + [{"t": float(t[j]), "p": pos[j]} for j in true_ends if cfg.anchored and not any(a["t"] == t[j] for a in shared)]
            try:
                out.append(row | solve(t, pos, vel, cfg, anchors, ends))
            except (np.linalg.LinAlgError, ValueError) as e:
                out.append(row | {"error": str(e)})
        return pd.DataFrame(out)

    return T.spread(data, *SEGMENT).groupBy(*SEGMENT).applyInPandas(run, FIT_SCHEMA)


def _frames(batches: Iterable[pd.DataFrame], step: float) -> Iterator[pd.DataFrame]:
    names = [f"{p}{c}" for p in ("", "v", "a") for c in "xyz"]
    for fits in batches:
        for f in fits.to_dict("records"):
            n = int(np.floor((f["t1"] - f["t0"]) / step + 1e-9))
            tau = np.arange(n + 1) * step
            if tau[-1] < f["t1"] - f["t0"] - 1e-9:
                tau = np.r_[tau, f["t1"] - f["t0"]]
            if not f["last"]:
                tau = tau[tau < f["t1"] - f["t0"] - 1e-9]  # the next segment gives the shared time
            out = evaluate_fit(f, tau).reshape(len(tau), 9)
            yield pd.DataFrame({"track_id": f["track_id"], "method": f["method"], "component": f["component"], "segment": f["segment"], "t": f["t0"] + tau} | {c: out[:, k] for k, c in enumerate(names)})


def render_fits(fits: DataFrame, step: float = 0.25) -> DataFrame:
    """K15 of fits: frames of each segment on its own grid; a shared boundary time comes once, from the later segment."""
    w = Window.partitionBy(*COMPONENT, "method").orderBy("segment")
    good = fits.where("error is null").withColumn("last", F.lead("segment").over(w).isNull()).select(*SEGMENT, "method", "family", "t0", "t1", "degree", "knots", "cx", "cy", "cz", "last")
    schema = "track_id string, method string, component int, segment long, t double, " + ", ".join(f"{p}{c} double" for p in ("", "v", "a") for c in "xyz")
    return T.spread(good, *SEGMENT, "method").mapInPandas(lambda b: _frames(b, step), schema)


def fit_residuals(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """Errors of each fit at its segment's own rows: SEGMENT, method, i, t, ex, ey, ez and the fitted velocity."""
    f = fits.where("error is null").select(*SEGMENT, "method", "family", "degree", "t0", "knots", "cx", "cy", "cz")
    j = rows.where(~F.col("guard") if "guard" in rows.columns else F.lit(True)).select(*SEGMENT, "i", "t", "x", "y", "z").join(f.select(*SEGMENT, "method"), SEGMENT)
    asked = j.groupBy(*SEGMENT, "method").agg(F.sort_array(F.collect_list(F.struct("t", "i", "x", "y", "z"))).alias("rows")).join(f, [*SEGMENT, "method"])

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for r in frame.to_dict("records"):
                t = np.array([x["t"] for x in r["rows"]])
                got = evaluate_fit(r, t - r["t0"])
                out = {"i": [x["i"] for x in r["rows"]], "t": t} | {f"e{c}": got[:, 0, k] - np.array([x[c] for x in r["rows"]]) for k, c in enumerate("xyz")} | {f"v{c}": got[:, 1, k] for k, c in enumerate("xyz")}
                yield pd.DataFrame({k: r[k] for k in (*SEGMENT, "method")} | out)

    return T.spread(asked, *SEGMENT, "method").mapInPandas(run, "track_id string, component int, segment long, method string, i long, t double, ex double, ey double, ez double, vx double, vy double, vz double")


def boundary_states(rows: DataFrame, boundaries: DataFrame, points: int = 11, least: int = 3, raw: float = 0.35, accel: float = 30.0) -> DataFrame:
    """K8: shared state of each boundary from the rows before and after it: a robust quadratic on either side (at most `points` rows, the
    boundary's among them), blended by the inverse of their residuals; position raw : robust = 0.35 : 0.65; velocity at most 2.5 times
    the local median speed (10 m/s at least), acceleration at most 30 m/s^2; confidence falls with residual and disagreement.

    One group a boundary: the window of rows is bounded, so a boundary is a small task wherever it lies.
    """
    s = rows.select(*(F.col(k).alias(f"s_{k}") for k in COMPONENT), F.col("i").alias("s_i"), F.col("t").alias("s_t"), "x", "y", "z", "vx", "vy", "vz")
    near = boundaries.select(*COMPONENT, "i").join(s, (F.col("track_id") == F.col("s_track_id")) & (F.col("component") == F.col("s_component")) & F.col("s_i").between(F.col("i") - points + 1, F.col("i") + points - 1))

    def side(g: pd.DataFrame, t0: float) -> tuple | None:
        if len(g) < least:
            return None
        tau, pos = g.s_t.to_numpy() - t0, g[["x", "y", "z"]].to_numpy(float)
        a = np.vander(tau, min(2, len(g) - 1) + 1, increasing=True)
        w = np.ones(len(g))
        for _ in range(3):
            c = np.linalg.lstsq(a * np.sqrt(w)[:, None], pos * np.sqrt(w)[:, None], rcond=None)[0]
            miss = np.linalg.norm(a @ c - pos, axis=1)
            size = 1.4826 * np.median(np.abs(miss - np.median(miss)))
            w = np.minimum(1.0, 1.345 * max(size, 1e-6) / np.maximum(miss, 1e-9))
        return c[0], c[1], 2 * c[2] if len(c) > 2 else np.zeros(3), float(np.sqrt((miss**2).mean()))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("s_i")
        i = g.i.iloc[0]
        at = g[g.s_i == i].iloc[0]
        p_raw, v_raw = at[["x", "y", "z"]].to_numpy(float), at[["vx", "vy", "vz"]].to_numpy(float)
        sides = [x for x in (side(g[g.s_i <= i], at.s_t), side(g[g.s_i >= i], at.s_t)) if x]
        p, v, a, confidence = p_raw, v_raw, np.zeros(3), 0.15
        if sides:
            w = np.array([1 / max(x[3], 1e-6) for x in sides])
            w /= w.sum()
            p, v, a = (sum(k * x[j] for k, x in zip(w, sides, strict=True)) for j in range(3))
            p = raw * p_raw + (1 - raw) * p
            most = max(10.0, 2.5 * float(np.median(np.linalg.norm(g[["vx", "vy", "vz"]], axis=1))))
            v *= min(1.0, most / max(np.linalg.norm(v), 1e-9))
            a *= min(1.0, accel / max(np.linalg.norm(a), 1e-9))
            apart = np.linalg.norm(sides[0][1] - sides[1][1]) if len(sides) == 2 else 0.0
            confidence = 1 / (1 + np.mean([x[3] for x in sides]) / 50 + apart / 100)
        head = {"track_id": g.track_id.iloc[0], "component": int(g.component.iloc[0]), "i": int(i), "t": float(at.s_t), "confidence": float(confidence)}
        return pd.DataFrame([head | {f"{k}{c}": float(x) for k, vec in (("", p), ("v", v), ("a", a)) for c, x in zip("xyz", vec, strict=True)}])

    return T.spread(near, *COMPONENT, "i").groupBy(*COMPONENT, "i").applyInPandas(run, "track_id string, component int, i long, t double, confidence double, " + ", ".join(f"{k}{c} double" for k in ("", "v", "a") for c in "xyz"))


def overlapping(rows: DataFrame, segments: DataFrame, guard: float, hard: DataFrame | None = None) -> DataFrame:
    """Rows of each segment and, marked guard, those within `guard` seconds of it, never across a true discontinuity.

    hard(keys, i): boundaries that part a track. The range join has the component as its key and a window of bounded time.
    """
    ends = segments.join(rows.select(*COMPONENT, F.col("i").alias("first"), F.col("t").alias("ta")), [*COMPONENT, "first"]).join(rows.select(*COMPONENT, F.col("i").alias("last"), F.col("t").alias("tb")), [*COMPONENT, "last"])
    for side in ("first", "last"):
        mark = hard.select(*COMPONENT, F.col("i").alias(side), F.lit(True).alias(f"stop_{side}")) if hard is not None else None
        ends = ends.join(mark, [*COMPONENT, side], "left") if mark is not None else ends.withColumn(f"stop_{side}", F.lit(None).cast("boolean"))
    e = ends.select(
        *(F.col(k).alias(f"e_{k}") for k in COMPONENT), "segment", "first", "last", F.col("ta") - F.when(F.col("stop_first"), 0.0).otherwise(guard), F.col("tb") + F.when(F.col("stop_last"), 0.0).otherwise(guard)
    ).toDF("e_track_id", "e_component", "segment", "first", "last", "lo", "hi")
    j = rows.join(e, (F.col("track_id") == F.col("e_track_id")) & (F.col("component") == F.col("e_component")) & F.col("t").between(F.col("lo"), F.col("hi")))
    return j.withColumn("guard", ~F.col("i").between(F.col("first"), F.col("last"))).drop("e_track_id", "e_component", "first", "last", "lo", "hi")


def harmonized_velocities(left: DataFrame, states: DataFrame) -> DataFrame:
    """Velocity at each join, the weighted mean of both prefits (1 / (1 + rmse / 80)), the shared state (0.75), the reported one (0.10)
    and the median slope of positions (0.35); at most max(30, 2.5 * median reported speed).

    left(COMPONENT, i, l_v*, r_v*, l_rmse, r_rmse, raw_v*, s1_*, s2_*, s3_*, speed): see joins().
    """
    j = left.join(states.select(*COMPONENT, "i", *(F.col(f"v{c}").alias(f"st_v{c}") for c in "xyz")), [*COMPONENT, "i"], "left")
    lw, rw = 1 / (1 + F.col("l_rmse") / 80), 1 / (1 + F.col("r_rmse") / 80)
    out = {}
    for c in "xyz":
        slopes = F.sort_array(F.array_compact(F.array(*(F.col(f"s{k}_{c}") for k in (1, 2, 3)))))
        n = F.size(slopes)
        middle = F.when(n > 0, (F.get(slopes, ((n - 1) / 2).cast("int")) + F.get(slopes, (n / 2).cast("int"))) / 2)
        parts = [(F.col(f"l_v{c}"), lw), (F.col(f"r_v{c}"), rw), (F.col(f"st_v{c}"), F.lit(0.75)), (F.col(f"raw_v{c}"), F.lit(0.10)), (middle, F.lit(0.35))]
        top = sum((F.coalesce(x * w, F.lit(0.0)) for x, w in parts), F.lit(0.0))
        low = sum((F.when(x.isNotNull(), w).otherwise(0.0) for x, w in parts), F.lit(0.0))
        out[f"h{c}"] = top / low
    h = j.withColumns(out)
    size = F.sqrt(F.col("hx") ** 2 + F.col("hy") ** 2 + F.col("hz") ** 2)
    k = F.least(F.lit(1.0), F.greatest(F.lit(30.0), 2.5 * F.greatest(F.col("speed"), F.lit(1e-6))) / F.greatest(size, F.lit(1e-9)))
    return h.select(*COMPONENT, "i", *((F.col(f"h{c}") * k).alias(f"v{c}") for c in "xyz"))


def joins(rows: DataFrame, residuals: DataFrame, fits: DataFrame, segments: DataFrame) -> DataFrame:
    """Each inner boundary with the fitted velocities of the segments on both sides, and the raw slopes around it."""
    w = Window.partitionBy(*COMPONENT).orderBy("t")
    around = rows.select(
        *COMPONENT, "i", *(F.col(f"v{c}").alias(f"raw_v{c}") for c in "xyz"), *(((F.col(c) - F.lag(c).over(w)) / (F.col("t") - F.lag("t").over(w))).alias(f"s1_{c}") for c in "xyz"),
        *(((F.lead(c).over(w) - F.col(c)) / (F.lead("t").over(w) - F.col("t"))).alias(f"s2_{c}") for c in "xyz"), *(((F.lead(c).over(w) - F.lag(c).over(w)) / (F.lead("t").over(w) - F.lag("t").over(w))).alias(f"s3_{c}") for c in "xyz"),
        F.percentile(F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2 + F.col("vz") ** 2), 0.5).over(w.rowsBetween(-3, 3)).alias("speed"),
    )
    own = residuals.join(fits.select(*SEGMENT, "method", "rmse"), [*SEGMENT, "method"]).select(*SEGMENT, "i", "vx", "vy", "vz", "rmse")
    left = segments.select(*SEGMENT, F.col("last").alias("i")).join(own, [*SEGMENT, "i"]).select(*COMPONENT, "i", *(F.col(f"v{c}").alias(f"l_v{c}") for c in "xyz"), F.col("rmse").alias("l_rmse"))
    right = segments.select(*SEGMENT, F.col("first").alias("i")).join(own, [*SEGMENT, "i"]).select(*COMPONENT, "i", *(F.col(f"v{c}").alias(f"r_v{c}") for c in "xyz"), F.col("rmse").alias("r_rmse"))
    return left.join(right, [*COMPONENT, "i"]).join(around, [*COMPONENT, "i"])


#: Eta (accurate, balanced, smooth), velocity weight (the same), knot spacing, rows a basis, jerk, acceleration prior, acceleration factor.
POLICY = {
    "ground": ((None,) * 3, (0.010,) * 3, 4.0, 4.0, 0.004, 0.04, 1.0), "transition": ((3.5e3, 18e3, 11.5e3), (0.090, 0.025, 0.054), 4.0, 5.5, 0.004, 0.08, 0.90),
    "noisy": ((48e3, 250e3, 150e3), (0.036, 0.010, 0.020), 8.0, 12.0, 0.012, 0.16, 1.75), "energy_change": ((7.5e3, 45e3, 29e3), (0.086, 0.025, 0.048), 4.75, 6.5, 0.004, 0.10, 1.0),
    "energy_constant": ((24e3, 150e3, 88e3), (0.070, 0.020, 0.038), 7.0, 10.0, 0.006, 0.12, 1.25), "steady": ((15e3, 100e3, 62e3), (0.095, 0.030, 0.052), 5.0, 7.0, 0.002, 0.08, 1.0),
}


def policy_class(regime: Column, speed: Column, mismatch: Column, slow: float = 25.0) -> Column:
    """The first class that fits: ground, transition, noisy, energy change, energy constant, steady."""
    high = mismatch > F.greatest(F.lit(10.0), 0.25 * F.greatest(speed, F.lit(1.0)))
    has = lambda *x: F.greatest(*(regime.contains(y) for y in x)) if len(x) > 1 else regime.contains(x[0])
    return (
        F.when((regime == "ground_slow") | (speed < slow), "ground").when((regime == "turn_or_transition") | regime.endswith("_turn") | has("turn_"), "transition")
        .when(regime.endswith("_noisy") | has("rough_air", "surveillance_noisy") | (regime == "noisy_airborne") | high, "noisy")
        .when(has("energy_gain", "energy_loss", "energy_exchange"), "energy_change").when((regime == "energy_constant") | regime.startswith("energy_constant__"), "energy_constant").otherwise("steady")
    )


def select_params(features: DataFrame, preset: str = "balanced") -> DataFrame:
    """Segments with the parameters of their regime as columns p_*, by a join with a small table; where reported and position velocity
    part, the velocity weight is that of the noisy class."""
    k = PRESETS.index(preset)
    spark = features.sparkSession
    table = spark.createDataFrame(
        [(n, e[k], v[k], s, o, j, a, x) for n, (e, v, s, o, j, a, x) in POLICY.items()], "policy string, p_eta double, p_velocity double, p_spacing double, p_per_basis double, p_jerk double, p_accel_prior double, p_accel double"
    )
    f = features.select(*SEGMENT, "regime_label", "median_speed", "median_mismatch", "duration", "n", policy_class(F.col("regime_label"), F.col("median_speed"), F.col("median_mismatch")).alias("policy"))
    high = F.col("median_mismatch") > F.greatest(F.lit(10.0), 0.25 * F.greatest(F.col("median_speed"), F.lit(1.0)))
    j = f.join(F.broadcast(table), "policy")
    return j.withColumn("p_velocity", F.when(high & ~F.col("policy").isin("ground", "steady"), POLICY["noisy"][1][k]).otherwise(F.col("p_velocity")))


# Fixed values of K9: multipliers of eta, velocity, knot spacing, rows a basis, jerk and acceleration prior; then their order by preset,
# `short` standing for the three recipes of short transitions; the clamps; and by tokens of a regime the acceleration and jerk that it
# may have and the weight of its motion.
RECIPES = {
    "base": (1, 1, 1, 1, 1, 1), "more_detail": (0.45, 1, 0.7, 0.7, 0.75, 0.7), "detail_light": (0.55, 0.45, 0.75, 0.8, 0.7, 0.75), "detail_heavy": (0.7, 1.75, 0.85, 0.8, 0.9, 0.8), "low_velocity": (1, 0.35, 1, 1, 1, 1),
    "high_velocity": (1, 2, 1, 1, 1, 1), "smoother": (1.8, 0.7, 1.25, 1.35, 1.5, 1.3), "very_smooth": (3.2, 0.3, 1.6, 1.8, 2.5, 1.8), "rough_guard": (4, 0.2, 1.8, 2.1, 3, 2.2), "flexible": (0.75, 1.25, 0.65, 0.65, 0.6, 0.6),
    "flexible_low": (0.85, 0.35, 0.7, 0.75, 0.8, 0.7), "smooth_deriv": (1.4, 0.7, 1.15, 1.2, 2.2, 1.5), "low_jerk": (0.8, 1, 0.9, 0.9, 2, 0.9), "high_smooth": (2.5, 0.7, 1, 1.2, 2, 1.6),
    "low_smooth": (0.35, 1, 1, 0.9, 0.7, 0.7), "wide_knots": (2, 0.3, 1.45, 1.6, 2, 1.5),
}
SHORT_RECIPES = {"short_1": (1.6, 0.2, 1.35, 1.5, 2.4, 1.6), "short_2": (2.4, 0.15, 1.6, 1.8, 3.2, 2), "short_3": (1.4, 0.25, 1.25, 1.45, 2, 1.4)}
ORDER = {
    "accurate": ("base", "more_detail", "detail_light", "detail_heavy", "short", "flexible", "flexible_low", "low_smooth", "low_jerk"),
    "balanced": ("base", "more_detail", "detail_light", "detail_heavy", "low_velocity", "short", *(n for k, n in enumerate(RECIPES) if k >= 5)),
    "smooth": ("base", "short", "smoother", "very_smooth", "rough_guard", "smooth_deriv", "high_smooth", "wide_knots", "low_velocity"),
}
MOST_CANDIDATES = {"accurate": 14, "balanced": 14, "smooth": 10}
CLAMPS = {"eta": (500.0, 1e6), "velocity": (0.0, 0.12), "spacing": (1.0, 12.0), "per_basis": (2.5, 16.0), "jerk": (0.0, 0.05), "accel_prior": (0.0, 0.5), "accel": (0.35, 3.0)}
MOTION = (
    (("rough", "noisy", "surveillance"), (3.5, 2.5, 1.75)), (("turn", "transition"), (7.0, 6.0, 0.65)), (("energy_constant",), (3.0, 2.0, 1.35)), (("energy_gain", "energy_loss", "climb", "descent"), (5.0, 4.0, 1.0)),
    (("ground",), (2.0, 1.5, 1.2)), ((), (4.5, 3.5, 1.0)),
)
TRANSITIONS = ("transition", "turn", "energy_gain", "energy_loss", "climb", "descent")
_MULTIPLIED = {"eta": "m_eta", "velocity": "m_velocity", "spacing": "m_spacing", "per_basis": "m_per_basis", "jerk": "m_jerk", "accel_prior": "m_accel_prior", "accel": "m_accel_prior"}


def _says(regime: Column, tokens: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(regime).contains(x) for x in tokens], F.lit(False))


def candidate_grid(params: DataFrame, preset: str = "balanced", most: int | None = None) -> DataFrame:
    """K9: each segment's parameters times the recipes of the preset in its order, those for short transitions only where a segment is one (at
    most 90 s or 80 rows), clamped; equal ones once, and of the rest the first `most` (14, or 10 for smooth)."""
    rows, nth = [], 0
    for name in ORDER[preset]:
        for recipe, m in SHORT_RECIPES.items() if name == "short" else [(name, RECIPES[name])]:
            rows.append((recipe, name == "short", nth, *map(float, m)))
            nth += 1
    table = F.broadcast(params.sparkSession.createDataFrame(rows, "recipe string, for_short boolean, nth int, " + ", ".join(f"{c} double" for c in dict.fromkeys(_MULTIPLIED.values()))))
    short = _says(F.col("regime_label"), TRANSITIONS) & ((F.col("duration") > 0) & (F.col("duration") <= 90) | (F.col("n") > 0) & (F.col("n") <= 80))
    j = params.join(table, ~F.col("for_short") | short)
    out = j.withColumns({f"p_{c}": F.greatest(F.lit(CLAMPS[c][0]), F.least(F.lit(CLAMPS[c][1]), F.col(f"p_{c}") * F.col(m))) for c, m in _MULTIPLIED.items()})
    same = Window.partitionBy(*SEGMENT, *(F.round(f"p_{c}", 8 if c in ("jerk", "accel_prior") else 6) for c in _MULTIPLIED)).orderBy("nth")
    once = out.withColumn("_r", F.row_number().over(same)).where("_r = 1")
    kept = once.withColumn("_r", F.row_number().over(Window.partitionBy(*SEGMENT).orderBy("nth"))).where(F.col("_r") <= (most or MOST_CANDIDATES[preset]))
    return kept.drop("_r", "for_short", *_MULTIPLIED.values())


def candidate_score(preset: str = "balanced") -> Column:
    """K9: cost of a candidate from rmse, p95, most, accel_rms, jerk_rms, n_basis, n, duration and regime_label: position, motion against what
    the regime may have, complexity, and, for transitions shorter than 75 s, the risk at joins."""
    k = PRESETS.index(preset)
    sp, sm = (0.85, 1.0, 1.2)[k], (0.45, 1.0, 2.0)[k]
    target = [F.lit(x) for x in MOTION[-1][1]]
    for tokens, values in MOTION[-2::-1]:
        target = [F.when(_says(F.col("regime_label"), tokens), v).otherwise(t) for v, t in zip(values, target, strict=True)]
    a, j = F.col("accel_rms") / target[0], F.col("jerk_rms") / target[1]
    crowd = (F.col("n_basis") / F.greatest("n", F.lit(1))) ** 2
    short = F.when(_says(F.col("regime_label"), TRANSITIONS), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (75 - F.col("duration")) / 75))).otherwise(0.0)
    return sp * (F.col("rmse") + 0.2 * F.col("p95") + 0.02 * F.col("most")) + 8 * sm * target[2] * (a * a + 0.6 * j * j) + 4 * crowd + 6 * short * (crowd + 0.1 * j * j)


def tuned(rows: DataFrame, params: DataFrame, preset: str = "balanced", states: DataFrame | None = None, most: int | None = None, config: Config | None = None) -> DataFrame:
    """K9: fits every candidate of every segment and keeps the cheapest; ties: the earlier recipe. nth is its place, recipe its name."""
    grid = candidate_grid(params, preset, most)
    data = rows.join(grid.select(*SEGMENT, "nth", *(c for c in grid.columns if c.startswith("p_"))), SEGMENT)
    keyed = data.withColumn("segment", F.col("segment") * 1000 + F.col("nth"))
    registry = Methods()
    registry.register("candidate", config or variants()[f"piecewise_{preset}"], solve_bspline)
    fits = fit_segments(keyed, ["candidate"], states, registry).withColumn("method", F.lit(f"piecewise_{preset}"))
    frames = render_fits(fits.withColumn("track_id", F.concat_ws("\x1f", "track_id", F.col("segment").cast("string"))))
    w = Window.partitionBy("track_id", "component").orderBy("t")
    step = F.sqrt(sum(((F.col(f"a{c}") - F.lag(f"a{c}").over(w)) ** 2 for c in "xyz"), F.lit(0.0))) / (F.col("t") - F.lag("t").over(w))
    shape = frames.withColumns({"a": F.sqrt(F.col("ax") ** 2 + F.col("ay") ** 2 + F.col("az") ** 2), "j": step}).groupBy("track_id", "component").agg(T.rms(F.col("a")).alias("accel_rms"), T.rms(F.col("j")).alias("jerk_rms"))
    shape = shape.select(F.element_at(F.split("track_id", "\x1f"), 1).alias("track_id"), "component", F.element_at(F.split("track_id", "\x1f"), 2).cast("long").alias("segment"), "accel_rms", F.coalesce("jerk_rms", F.lit(0.0)).alias("jerk_rms"))
    kind = grid.select(*SEGMENT, "nth", "recipe", "regime_label")
    scored = fits.join(shape, SEGMENT).withColumns({"nth": (F.col("segment") % 1000).cast("int"), "segment": F.floor(F.col("segment") / 1000).cast("long"), "duration": F.col("t1") - F.col("t0")}).join(kind, [*SEGMENT, "nth"])
    best = Window.partitionBy(*SEGMENT).orderBy(F.round("cost", 9), "nth")
    return scored.withColumn("cost", candidate_score(preset)).withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r", "accel_rms", "jerk_rms", "regime_label", "duration")


#: Limits of rmse, p95, largest error; of the vertical ones; and of the vertical window error, by preset.
BAD = {"accurate": (90, 180, 450, 6, 12, 22, 7.5), "balanced": (120, 240, 600, 8, 16, 28, 10.0), "smooth": (160, 320, 800, 12, 24, 45, 16.0)}


def bad_segments(residuals: DataFrame, preset: str = "balanced", k: int = 5, run: tuple[int, float] = (3, 3.0)) -> DataFrame:
    """M20 and T4's order: segments whose errors pass a limit, or whose rolling median vertical error stays above one for a while; reasons,
    priority (the largest ratio), and place: the worst first."""
    keys = [*SEGMENT, "method"]
    e = residuals.withColumns({"e": F.sqrt(F.col("ex") ** 2 + F.col("ey") ** 2 + F.col("ez") ** 2), "ev": F.abs("ez")})
    e = T.rolling_median(e, keys, ["t"], "ev", k, "window")
    limits = BAD[preset]
    g = e.groupBy(*keys).agg(
        T.rms(F.col("e")).alias("rmse"), F.percentile("e", 0.95).alias("p95"), F.max("e").alias("most"), T.rms(F.col("ev")).alias("vertical_rmse"), F.percentile("ev", 0.95).alias("vertical_p95"), F.max("ev").alias("vertical_most"), F.max("window").alias("window"),
    )
    longest = T.longest_run_above(e, keys, "t", "window", float(limits[6])).select(*keys, F.col("n").alias("run_rows"), (F.col("t1") - F.col("t0")).alias("run_seconds"))
    names = ("rmse", "p95", "most", "vertical_rmse", "vertical_p95", "vertical_most")
    over = [F.when(F.col(n) > x, n) for n, x in zip(names, limits, strict=False)]
    over.append(F.when((F.col("window") > limits[6]) & (F.col("run_rows") >= run[0]) & (F.col("run_seconds") >= run[1]), "vertical_window"))
    b = g.join(longest, keys, "left").withColumns({"reasons": F.array_compact(F.array(*over)), "priority": F.greatest(*(F.col(n) / x for n, x in zip((*names, "window"), limits, strict=True)))}).where(F.size("reasons") > 0)
    return b.withColumn("place", F.row_number().over(Window.partitionBy(*COMPONENT, "method").orderBy(F.desc("priority"), "segment")).cast("long"))


#: The limits of a segmentation inside a bad segment: one boundary, less support, spikes as candidates.
INSIDE = {"min_points": 8, "min_seconds": 8.0, "spacing": 8.0, "state_points": 7, "state_seconds": 6.0, "most_segments": 2}


def inner_boundaries(rows: DataFrame, segments: DataFrame, bad: DataFrame, stage=lambda df, name: df) -> DataFrame:
    """The boundary that M16, run inside each bad segment under looser limits, finds there: SEGMENT, i, t, score, reasons.

    Each bad segment is a component of its own, so all of them go through one run of the segmentation's jobs. Segments that are bad
    only for their height are left to the residual's peak.
    """
    from trackspark.operators import regimes

    limits = regimes.Limits(**INSIDE)
    flat = bad.where(~F.exists("reasons", lambda r: r.contains("vertical"))).select(*SEGMENT).distinct()
    own = regimes.in_segments(rows, segments).join(flat, SEGMENT)
    first = segments.select(*SEGMENT, "first")
    name = F.concat_ws("\x1f", "track_id", F.col("component").cast("string"), F.col("segment").cast("string"))
    inner = own.join(first, SEGMENT).select(name.alias("track_id"), F.lit(0).alias("component"), (F.col("i") - F.col("first")).alias("i"), "t", *_AXES)
    inner = stage(inner, "inside")
    features = stage(regimes.motion_features(inner), "inside-features")
    labels = stage(regimes.regime_labels(regimes.raw_labels(features, limits), limits), "inside-labels")
    bands = regimes.adaptive_deadbands(features, limits)
    found = [regimes.transition_candidates(labels, features, limits, ("energy", "turn")), regimes.go_around_candidates(features, bands, limits), regimes.vertical_reversal_candidates(features, bands, limits)]
    found += [regimes.altitude_lobe_candidates(features, bands, limits), regimes.spike_candidates(features, threshold=3.0)]
    b = regimes.select_boundaries(regimes.union_candidates(*found), inner, limits)
    part = F.split("track_id", "\x1f")
    keyed = b.select(part[0].alias("track_id"), part[1].cast("int").alias("component"), part[2].cast("long").alias("segment"), "i", "t", "score", "reasons").join(first, SEGMENT)
    return keyed.select(*SEGMENT, (F.col("i") + F.col("first")).alias("i"), "t", F.greatest("score", F.lit(100.0)).alias("score"), F.array_append("reasons", F.lit("feature_split")).alias("reasons"))


def residual_peaks(segments: DataFrame, residuals: DataFrame, bad: DataFrame, points: int = 8, seconds: float = 8.0, window: int = 5) -> DataFrame:
    """M21's other way: in each bad segment the row of largest rolling median error that leaves both parts enough rows and time; the height's
    error, and a twentieth of the whole one, where a reason is vertical. SEGMENT, i, t, score, reasons."""
    wanted = bad.select(*SEGMENT, F.exists("reasons", lambda r: r.contains("vertical")).alias("vertical"))
    r = residuals.join(wanted, SEGMENT).join(segments, SEGMENT)
    part = Window.partitionBy(*SEGMENT)
    r = r.withColumns({"_a": F.min("t").over(part), "_b": F.max("t").over(part), "e": F.sqrt(F.col("ex") ** 2 + F.col("ey") ** 2 + F.col("ez") ** 2), "ev": F.abs("ez")})
    for c in ("e", "ev"):
        r = T.rolling_median(r, SEGMENT, ["t"], c, window, f"{c}_m")
    fit = (F.col("i") - F.col("first") + 1 >= points) & (F.col("last") - F.col("i") + 1 >= points) & (F.col("t") - F.col("_a") >= seconds) & (F.col("_b") - F.col("t") >= seconds)
    r = r.where(fit).withColumn("score", F.when(F.col("vertical"), F.col("ev_m") + 0.05 * F.col("e_m")).otherwise(F.col("e_m")))
    new = r.groupBy(*SEGMENT).agg(F.max_by(F.struct("i", "t", "vertical", "score"), F.struct(F.round("score", 9), -F.col("i"))).alias("m"))
    reason = F.when(F.col("m.vertical"), "vertical_residual_peak").otherwise("residual_peak")
    return new.select(*SEGMENT, F.col("m.i").alias("i"), F.col("m.t").alias("t"), F.greatest("m.score", F.lit(100.0)).alias("score"), F.array(reason).alias("reasons"))


def refined_boundaries(rows: DataFrame, boundaries: DataFrame, segments: DataFrame, residuals: DataFrame, bad: DataFrame, most_new: int = 8, most_segments: int = 48, stage=lambda df, name: df) -> DataFrame:
    """M21, one pass, and T4: boundaries and, in the bad segments of each component, worst first, a new one each: M16's inside, else the
    residual's peak; at most `most_new` of them and `most_segments` segments in all. A segment without room for two parts gets none."""
    inner = inner_boundaries(rows, segments, bad, stage)
    peaks = residual_peaks(segments, residuals, bad).join(inner.select(*SEGMENT), SEGMENT, "left_anti")
    order = bad.select(*SEGMENT, "place")
    count = segments.groupBy(*COMPONENT).agg(F.count("*").alias("_n"))
    new = inner.unionByName(peaks).join(order, SEGMENT).join(count, COMPONENT)
    new = new.withColumn("_r", F.row_number().over(Window.partitionBy(*COMPONENT).orderBy("place", "segment"))).where((F.col("_r") <= most_new) & (F.col("_n") + F.col("_r") <= most_segments))
    new = new.select(*COMPONENT, "i", "t", "score", F.array_append("reasons", F.lit("quality_refinement")).alias("reasons"))
    return boundaries.select(*COMPONENT, "i", "t", "score", "reasons").unionByName(new.join(boundaries.select(*COMPONENT, "i"), [*COMPONENT, "i"], "left_anti"))


def synthetic_gap_plan(samples: DataFrame, fraction: float = 0.05, gaps: int = 1, low: float = 8.0, high: float = 16.0, guard: float = 45.0, seed: int = 17, least: int = 24) -> DataFrame:
    """track_id, i, gap of the rows to delete: windows away from the ends and from each other, without long steps inside. One group a
    track, of its times only; tracks too short give nothing."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("i")
        t, n = g.t.to_numpy(), len(g)
        out: list[tuple[int, int]] = []
        step = np.diff(t)
        if n >= least and (step > 0).any():
            typical = float(np.median(step[step > 0]))
            short, long_ = max(2 * typical, low), max(2 * typical, low, high)
            fewest = max(2, round(short / typical))
            wanted = max(fewest, round(n * fraction))
            count = min(gaps, max(1, wanted // fewest))
            size = int(max(fewest, min(max(fewest, round(long_ / typical)), wanted // count)))
            for rows in (max(3, round(max(guard, 1.5 * long_) / typical)), max(3, round(long_ / typical))):
                a, b = rows, n - rows - size - 1
                if b > a:
                    break
            starts = [round(x) for x in np.linspace(a, b, 4 * count + 2)[1:-1]] if b > a else []
            k = seed % len(starts) if starts else 0
            for s in starts[k:] + starts[:k]:
                if len(out) < count and all(abs(s - o) > 2 * size - 1 for o, _ in out) and s > 0 and s + size < n and not (np.diff(t[s : s + size]) > max(3.5 * typical, 0.5 * short)).any():
                    out.append((s, size))
        rows_ = [(g.track_id.iloc[0], int(g.i.iloc[x]), k) for k, (s, size) in enumerate(out) for x in range(s, s + size)]
        return pd.DataFrame(rows_, columns=["track_id", "i", "gap"]).astype({"i": "int64", "gap": "int64"})

    return samples.select("track_id", "i", "t").groupBy("track_id").applyInPandas(run, "track_id string, i long, gap long")


def score_deleted(samples: DataFrame, plan: DataFrame, refit) -> DataFrame:
    """refit(training rows) gives states (track_id, method, t, x..az); errors at the deleted rows, by track, method and gap."""
    from trackspark.operators import render

    training = samples.join(plan.select("track_id", "i"), ["track_id", "i"], "left_anti")
    deleted = samples.join(plan, ["track_id", "i"])
    states = refit(training).where("t is not null")
    asked = deleted.select("track_id", "t").join(states.select("track_id", "method").distinct(), "track_id")
    got = render.evaluate_states(states, asked, ["track_id", "method"]).select("track_id", "method", "t", *(F.col(c).alias(f"p{c}") for c in "xyz"))
    e = deleted.join(got, ["track_id", "t"])
    return position_error(e.withColumns({f"e{c}": F.col(f"p{c}") - F.col(c) for c in "xyz"}), ["track_id", "method", "gap"])


def position_error(errors: DataFrame, keys: list[str]) -> DataFrame:
    """MSE, RMSE, median, p95 and largest spatial, horizontal and vertical error of rows (ex, ey, ez), and the mean signed vertical one."""
    h, v = F.sqrt(F.col("ex") ** 2 + F.col("ey") ** 2), F.abs("ez")
    e = F.sqrt(h * h + v * v)
    stats = lambda x, n: [F.avg(x * x).alias(f"{n}_mse"), T.rms(x).alias(f"{n}_rmse"), F.percentile(x, 0.5).alias(f"{n}_median"), F.percentile(x, 0.95).alias(f"{n}_p95"), F.max(x).alias(f"{n}_max")]
    return errors.groupBy(*keys).agg(F.count("*").alias("n"), *stats(e, "position"), *stats(h, "horizontal"), *stats(v, "vertical"), F.avg("ez").alias("vertical_mean"))


def holdout_rows(rows: DataFrame, fraction: float = 0.15, least: int = 8) -> DataFrame:
    """K18's split: every stride-th interior row of a segment is held out, about `fraction` (0.01 to 0.40) of them; segments too short hold none out."""
    share = min(max(fraction, 0.01), 0.40)
    part = Window.partitionBy(*SEGMENT)
    r = rows.withColumns({"_k": F.row_number().over(part.orderBy("t")) - 1, "_n": F.count("*").over(part)})
    target = F.least(F.greatest(F.lit(1), F.rint(share * F.col("_n"))), F.greatest(F.lit(1), F.col("_n") - least), F.col("_n") - 2)
    stride = F.greatest(F.lit(2), F.rint((F.col("_n") - 2) / F.greatest(target, F.lit(1))))
    hit = (F.col("_n") >= least + 3) & (F.col("_k") >= 1) & (F.col("_k") <= F.col("_n") - 2) & ((F.col("_k") - 1) % stride == 0) & ((F.col("_k") - 1) / stride < target)
    return r.withColumn("held_out", hit).drop("_k", "_n")


def segment_holdout(rows: DataFrame, method: str = "piecewise_balanced", fraction: float = 0.15) -> DataFrame:
    """Refit of each segment without its held-out rows, and A6 at these."""
    h = holdout_rows(rows, fraction)
    fits = fit_segments(h.where("not held_out"), [method])
    e = fit_residuals(h.where("held_out"), fits)
    return position_error(e, [*SEGMENT, "method"])


def holdout_rollup(scores: DataFrame, keys: tuple[str, ...] = ("track_id", "method")) -> DataFrame:
    """Segments that were scored, their mean RMSE and largest p95."""
    return scores.groupBy(*keys).agg(F.count("*").alias("n_segments"), F.sum("n").alias("n_held_out"), F.avg("position_rmse").alias("mean_rmse"), F.max("position_p95").alias("most_p95"))


def quality_of_fit(residuals: DataFrame, render: DataFrame, rmse: float = 200.0, jerk: float = 20.0) -> DataFrame:
    """A6 of each segment's fit, acceleration and jerk of its frames, and whether one of them is bad."""
    keys = [*SEGMENT, "method"]
    w = Window.partitionBy(*keys).orderBy("t")
    d = F.sqrt(sum(((F.col(f"a{c}") - F.lag(f"a{c}").over(w)) ** 2 for c in "xyz"), F.lit(0.0))) / (F.col("t") - F.lag("t").over(w))
    f = render.withColumns({"a": F.sqrt(F.col("ax") ** 2 + F.col("ay") ** 2 + F.col("az") ** 2), "j": d})
    m = f.groupBy(*keys).agg(T.rms(F.col("a")).alias("accel_rms"), F.percentile("a", 0.95).alias("accel_p95"), F.max("a").alias("accel_max"), T.rms(F.col("j")).alias("jerk_rms"), F.percentile("j", 0.95).alias("jerk_p95"), F.max("j").alias("jerk_max"))
    q = position_error(residuals, keys).join(m, keys, "left")
    return q.withColumn("bad", (F.col("position_rmse") > rmse) | F.coalesce(F.col("jerk_rms") > jerk, F.lit(False)))


def verify_continuity(fits: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Jumps of position, velocity, acceleration and jerk where neighbouring fits of a component meet, and whether they pass a tolerance."""
    ends = fits.where("error is null").select(*SEGMENT, "method", "family", "degree", "t0", "t1", "knots", "cx", "cy", "cz")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for f in frame.to_dict("records"):
                span = f["t1"] - f["t0"]
                got = evaluate_fit(f, np.array([0.0, 1e-3, span - 1e-3, span]))
                jerk = [(got[1, 2] - got[0, 2]) / 1e-3, (got[3, 2] - got[2, 2]) / 1e-3]
                row = {k: f[k] for k in (*SEGMENT, "method")}
                for side, at, third in (("first", 0, jerk[0]), ("last", 3, jerk[1])):
                    row |= {f"{side}_{n}": v.tolist() for n, v in zip(("p", "v", "a", "j"), (*got[at], third), strict=True)}
                yield pd.DataFrame([row])

    schema = "track_id string, component int, segment long, method string, " + ", ".join(f"{s}_{n} array<double>" for s in ("first", "last") for n in "pvaj")
    w = Window.partitionBy(*COMPONENT, "method").orderBy("segment")
    e = T.spread(ends, *SEGMENT, "method").mapInPandas(run, schema)
    jump = lambda n: F.sqrt(F.aggregate(F.zip_with(F.lead(f"first_{n}").over(w), F.col(f"last_{n}"), lambda a, b: (a - b) ** 2), F.lit(0.0), lambda a, b: a + b))
    out = e.withColumns({f"jump_{n}": jump(n) for n in "pvaj"}).where("jump_p is not null").select(*SEGMENT, "method", *(f"jump_{n}" for n in "pvaj"))
    return out.withColumns({f"smooth_{n}": F.col(f"jump_{n}") <= tolerance for n in "pva"})


def component_fit(tables: dict[str, DataFrame], preset: str = "balanced", passes: int = 2, most: int | None = None, stage=lambda df, name: df) -> dict[str, DataFrame]:
    """K12 with K9 and M21: policy, prefit with soft joins, harmonised joins, the cheapest candidate under the joins' velocities as equalities,
    and at most `passes` refinements of bad segments.

    tables: of regimes.segment_tracks(). A refinement only touches the segments that it splits: the others keep their fits and the states
    at their ends, under new numbers, so a pass costs what it changes. It ends early where no bad segment can be split. stage(df, name):
    how a table is kept between the stages (a written table on a cluster).
    """
    from trackspark.operators import regimes

    rows, boundaries = tables["rows"], tables["boundaries"]
    final = replace(variants()[f"piecewise_{preset}"], hard_velocity=True)
    soft = Methods()
    soft.register("prefit", replace(variants()[f"piecewise_{preset}"], position_prior=0.5, velocity_prior=0.025), solve_bspline)
    segments = stage(regimes.build_segments(rows, boundaries), "segments")
    todo, shared, kept, n_boundaries = segments, None, None, boundaries.count()
    for k in range(passes + 1):
        data = stage(regimes.in_segments(rows, todo), f"rows-{k}")
        params = select_params(regimes.segment_features(tables["features"], tables["labels"], todo), preset)
        params = stage(params, f"params-{k}")
        own = data.join(params.select(*SEGMENT, *(c for c in params.columns if c.startswith("p_"))), SEGMENT)
        new = boundaries if shared is None else boundaries.join(shared.select(*COMPONENT, "i"), [*COMPONENT, "i"], "left_anti")
        states = stage(boundary_states(rows, new), f"states-{k}")
        known = states if shared is None else states.unionByName(shared.select(*states.columns))
        prefit = stage(fit_segments(own, ["prefit"], known, soft), f"prefit-{k}")
        velocity = harmonized_velocities(joins(rows, fit_residuals(data, prefit), prefit, todo), states)
        joined = states.join(velocity.withColumnsRenamed({f"v{c}": f"_v{c}" for c in "xyz"}), [*COMPONENT, "i"], "left")
        fresh = joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in ("vx", "vy", "vz") else F.col(c) for c in states.columns))
        shared = stage(fresh if shared is None else fresh.unionByName(shared.select(*states.columns)), f"shared-{k}")
        best = tuned(data, params, preset, shared, most, final)
        fits = stage(best if kept is None else best.unionByName(kept.select(*best.columns)), f"fits-{k}")
        residuals = stage(fit_residuals(regimes.in_segments(rows, segments), fits), f"residuals-{k}")
        bad = stage(bad_segments(residuals, preset), f"bad-{k}")
        if k == passes or bad.isEmpty():
            break
        refined = stage(refined_boundaries(rows, boundaries, segments, residuals, bad, stage=stage), f"boundaries-{k}")
        n = refined.count()
        if n == n_boundaries:
            break
        before, boundaries, n_boundaries = segments, refined, n
        segments = stage(regimes.build_segments(rows, boundaries), f"segments-{k}")
        same = before.withColumnRenamed("segment", "_old").join(segments, [*COMPONENT, "first", "last"]).select(*COMPONENT, "_old", "segment")
        kept = stage(fits.withColumnRenamed("segment", "_old").join(same, [*COMPONENT, "_old"]).drop("_old"), f"kept-{k}")
        todo = stage(segments.join(same.select(*SEGMENT), SEGMENT, "left_anti"), f"todo-{k}")
    return {"segments": segments, "states": shared, "fits": fits, "residuals": residuals, "bad": bad, "boundaries": boundaries}


def filter_diagnostics(states: DataFrame) -> DataFrame:
    """Of smooth_ca()'s rows: NIS, noise scale and covariance trace, and the innovations' sizes, by track and method."""
    q = lambda c: [F.percentile(c, x).alias(f"{c}_q{int(100 * x)}") for x in (0.5, 0.95)]
    return states.where("error is null").groupBy("track_id", "method").agg(
        F.count("*").alias("n"), F.avg("nis").alias("nis_mean"), F.max("nis").alias("nis_max"), *q("nis"), *q("noise_scale"), F.max("noise_scale").alias("noise_scale_max"), F.count_if(F.col("noise_scale") > 1).alias("n_downweighted"),
        *q("trace"), T.rms(F.col("innovation")).alias("innovation_rms"), *q("innovation"), F.max("innovation").alias("innovation_max"), T.rms(F.sqrt(F.col("ax") ** 2 + F.col("ay") ** 2 + F.col("az") ** 2)).alias("accel_rms"),
    )


def fit_diagnostics(fits: DataFrame) -> DataFrame:
    """A fit's sizes, errors, range of lambda and least weight, without its coefficients."""
    return fits.select(*SEGMENT, "method", "family", "t0", "t1", "n", "n_basis", *_DIAGNOSTICS, "error")


def config_table(spark) -> DataFrame:
    """The configurations as rows."""
    return spark.createDataFrame([{"method": n} | asdict(c) | {"per_basis": float(c.per_basis), "spacing": float(c.spacing), "delta": float(c.delta)} for n, c in variants().items()])
