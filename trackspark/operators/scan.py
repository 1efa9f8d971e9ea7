"""The constant-acceleration smoother as an associative scan: chunks of one track run in parallel tasks.

A chunk of rows acts on whatever state enters it as one element (A, b, C, eta, J): the state that leaves it is normal about A x + b with
covariance C, and its rows' likelihood of x is exp(eta x - x J x / 2). Elements of neighbouring chunks combine associatively, so one
row a chunk gives every chunk its entering state. The scale of a row's measurement noise depends on the state before the row; the
elements take the scales of the pass before, and passes are repeated until no scale moves. What is then found is the sequential
filter's own result: its scales are the fixed point. Backwards a chunk is an affine map of the state behind it, without such passes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackspark.operators import smoothing
from trackspark.operators import timeseries as T
from trackspark.operators.smoothing import _EYE, _H, _RIDGE, _STATES, PRESETS, _axis, _noise, first_state, forward, measurement, transition

_SHAPES = {"a": (3, 3, 3), "b": (3, 3), "c": (3, 3, 3), "eta": (3, 3), "j": (3, 3, 3)}
_T = lambda m: m.transpose(0, 2, 1)
_ON = lambda m, v: np.einsum("aij,aj->ai", m, v)


def combined(p: tuple, q: tuple) -> tuple:
    """The element of p's rows followed by q's."""
    a, b, c, eta, j = p
    a2, b2, c2, eta2, j2 = q
    left = a2 @ np.linalg.inv(_EYE + c @ j2)
    right = _T(a) @ np.linalg.inv(_EYE + j2 @ c)
    return left @ a, _ON(left, b + _ON(c, eta2)) + b2, left @ c @ _T(a2) + c2, _ON(right, eta2 - _ON(j2, b)) + eta, right @ j2 @ a + j


def row_element(dt: float, pos: np.ndarray, vel: np.ndarray, scale: float, p: dict) -> tuple:
    """The element of one row after a step of dt."""
    f, q, r = transition(dt), _axis(p, "jerk")[:, None, None] ** 2 * _noise(dt), measurement(p, scale)
    inverse = np.linalg.inv(_H @ q @ _H.T + r)
    gain = q @ _H.T @ inverse
    y, keep = np.stack([pos, vel], 1), _EYE - gain @ _H
    seen = f.T @ _H.T @ inverse
    return keep @ f, _ON(gain, y), keep @ q @ _T(keep) + gain @ r @ _T(gain) + _RIDGE * _EYE, _ON(seen, y), seen @ _H @ f


def left_by(state: tuple[np.ndarray, np.ndarray], e: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance behind an element that a state enters."""
    x, c = state
    a, b, ce, eta, j = e
    k = a @ np.linalg.inv(_EYE + c @ j)
    return _ON(k, x + _ON(c, eta)) + b, k @ c @ _T(a) + ce


def _packed(e: tuple) -> dict:
    return {k: v.ravel().tolist() for k, v in zip(_SHAPES, e, strict=True)}


def _element(r) -> tuple:
    return tuple(np.array(r[k], float).reshape(s) for k, s in _SHAPES.items())


def _arrays(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return g.t.to_numpy(float), g[["x", "y", "z"]].to_numpy(float), g[["vx", "vy", "vz"]].to_numpy(float)


_KEYS = ["track_id", "method", "chunk"]
spread = lambda df: T.spread(df, *_KEYS)
_KEY_SCHEMA = "track_id string, method string, chunk long"
_ELEMENT_SCHEMA = _KEY_SCHEMA + ", scales array<double>, " + ", ".join(f"{k} array<double>" for k in _SHAPES)
_ENTRY_SCHEMA = _KEY_SCHEMA + ", mean array<double>, cov array<double>"


def _chunk_element(g: pd.DataFrame, scales: np.ndarray, p: dict) -> tuple:
    """The element of a chunk's rows; a track's first row has no step before it."""
    t, pos, vel = _arrays(g)
    before = np.r_[g["before"].iloc[0], t[:-1]]
    out = None
    for i in range(len(t)):
        e = row_element(0.0 if np.isnan(before[i]) else max(t[i] - before[i], 1e-3), pos[i], vel[i], scales[i], p)
        out = e if out is None else combined(out, e)
    return out


def _run(g: pd.DataFrame, e, p: dict) -> smoothing.Filtered:
    """The sequential filter over a chunk from the state that enters it."""
    t, pos, vel = _arrays(g)
    before = float(g["before"].iloc[0])
    return forward(t, pos, vel, p, (None if np.isnan(before) else before, np.array(e["mean"], float).reshape(3, 3), np.array(e["cov"], float).reshape(3, 3, 3)))


def _step(s: smoothing.Filtered, g: pd.DataFrame, p: dict) -> tuple:
    """Transition to the row behind the chunk, and the state and covariance predicted there; Nones at a track's end."""
    after, t = float(g["after"].iloc[-1]), float(g.t.iloc[-1])
    if np.isnan(after):
        return None, None, None
    dt = max(after - t, 1e-3)
    f = transition(dt)
    return f, s.x[-1] @ f.T, f @ s.c[-1] @ f.T + _axis(p, "jerk")[:, None, None] ** 2 * _noise(dt)


def smooth_ca_scan(samples: DataFrame, presets: tuple[str, ...] = ("balanced",), rows: int = 10_000, tolerance: float = 1e-9, stage=lambda df, name: df) -> DataFrame:
    """K2 by chunks of `rows` rows: track_id, method, t and the smoothed states, as smooth_ca() gives them.

    A pass is two jobs: elements of all chunks, and the states that enter them, one group a track with one row a chunk. The first pass
    takes all scales as 1; each later one has the scales of more leading rows right, so passes end; as the filter forgets, a few do.
    stage(df, name): how a table is kept between passes (a written table on a cluster). The driver gets one number a pass.
    """
    spark = samples.sparkSession
    table = F.broadcast(spark.createDataFrame([(p,) for p in presets], "method string"))
    w = Window.partitionBy("track_id").orderBy("t")
    base = samples.select("track_id", *(F.col(c).cast("double").alias(c) for c in ("t", "x", "y", "z", "vx", "vy", "vz")))
    base = base.withColumns({"nth": F.row_number().over(w) - 1, "before": F.lag("t").over(w), "after": F.lead("t").over(w)})
    base = stage(base.withColumn("chunk", F.floor(F.col("nth") / rows).cast("long")).crossJoin(table), "chunks")
    head = base.where(F.col("nth") < smoothing.HEAD)

    def start(g: pd.DataFrame) -> pd.DataFrame:
        x, c = first_state(*_arrays(g.sort_values("t")), PRESETS[g.method.iloc[0]])
        return pd.DataFrame([{"track_id": g.track_id.iloc[0], "method": g.method.iloc[0], "mean0": x.ravel().tolist(), "cov0": c.ravel().tolist()}])

    starts = stage(head.groupBy("track_id", "method").applyInPandas(start, "track_id string, method string, mean0 array<double>, cov0 array<double>"), "starts")

    def first_elements(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t")
        scales = np.ones(len(g))
        return pd.DataFrame([{k: g[k].iloc[0] for k in _KEYS} | {"scales": scales.tolist()} | _packed(_chunk_element(g, scales, PRESETS[g.method.iloc[0]]))])

    def enter(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("chunk")
        state = np.array(g.mean0.iloc[0], float).reshape(3, 3), np.array(g.cov0.iloc[0], float).reshape(3, 3, 3)
        out = []
        for r in g.to_dict("records"):
            out.append({k: r[k] for k in _KEYS} | {"mean": state[0].ravel().tolist(), "cov": state[1].ravel().tolist()})
            state = left_by(state, _element(r))
        return pd.DataFrame(out)

    def rescaled(key, g: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        g, e = g.sort_values("t"), e.iloc[0]
        p, known = PRESETS[key[1]], np.array(e.scales)
        scales = _run(g, e, p).seen[:, 1]
        moved = float(np.max(np.abs(scales - known) / scales, initial=0.0))
        return pd.DataFrame([dict(zip(_KEYS, key, strict=True)) | {"scales": scales.tolist()} | _packed(_chunk_element(g, scales, p)) | {"moved": moved}])

    elements = stage(spread(base).groupBy(*_KEYS).applyInPandas(first_elements, _ELEMENT_SCHEMA), "elements")
    while True:
        entered = stage(elements.join(starts, ["track_id", "method"]).groupBy("track_id", "method").applyInPandas(enter, _ENTRY_SCHEMA), "entered")
        both = entered.join(elements.select(*_KEYS, "scales"), _KEYS)
        again = stage(spread(base).groupBy(*_KEYS).cogroup(spread(both).groupBy(*_KEYS)).applyInPandas(rescaled, _ELEMENT_SCHEMA + ", moved double"), "elements")
        if (again.agg(F.max("moved")).first()[0] or 0.0) <= tolerance:
            break
        elements = again.drop("moved")

    def maps(key, g: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        """The chunk as an affine map of the smoothed state behind it: E x + g and E c E' + l; its last row steps to the next chunk's first."""
        g, p = g.sort_values("t"), PRESETS[key[1]]
        s = _run(g, e.iloc[0], p)
        em, gm, lm = np.tile(_EYE, (3, 1, 1)), np.zeros((3, 3)), np.zeros((3, 3, 3))
        for i in range(len(g) - 1, -1, -1):
            last = i == len(g) - 1
            f, xp, cp = _step(s, g, p) if last else (s.f[i + 1], s.xp[i + 1], s.cp[i + 1])
            if f is None:  # the track's last row: nothing behind it
                em, gm, lm = np.zeros((3, 3, 3)), s.x[i], s.c[i]
                continue
            k = s.c[i] @ f.T @ np.linalg.inv(cp)
            em, gm, lm = k @ em, _ON(k, gm - xp) + s.x[i], k @ (lm - cp) @ _T(k) + s.c[i]
        return pd.DataFrame([dict(zip(_KEYS, key, strict=True)) | {"e": em.ravel().tolist(), "g": gm.ravel().tolist(), "l": lm.ravel().tolist()}])

    def behind(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("chunk", ascending=False)
        state, out = (np.zeros((3, 3)), np.zeros((3, 3, 3))), []
        for r in g.to_dict("records"):
            out.append({k: r[k] for k in _KEYS} | {"mean": state[0].ravel().tolist(), "cov": state[1].ravel().tolist()})
            em, gm, lm = np.array(r["e"]).reshape(3, 3, 3), np.array(r["g"]).reshape(3, 3), np.array(r["l"]).reshape(3, 3, 3)
            state = _ON(em, state[0]) + gm, em @ state[1] @ _T(em) + lm
        return pd.DataFrame(out)

    entering = entered
    mapped = spread(base).groupBy(*_KEYS).cogroup(spread(entering).groupBy(*_KEYS)).applyInPandas(maps, _KEY_SCHEMA + ", e array<double>, g array<double>, l array<double>")
    follow = stage(mapped.groupBy("track_id", "method").applyInPandas(behind, _ENTRY_SCHEMA), "behind").withColumnsRenamed({"mean": "mean_after", "cov": "cov_after"})

    def smoothed(key, g: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        g, e, p = g.sort_values("t"), e.iloc[0], PRESETS[key[1]]
        s = _run(g, e, p)
        f, xp, cp = _step(s, g, p)
        after = None if f is None else (np.array(e.mean_after).reshape(3, 3), np.array(e.cov_after).reshape(3, 3, 3), xp, cp, f)
        x, c = smoothing.backward(s, after)
        return pd.DataFrame({"track_id": key[0], "method": key[1], "t": g.t.to_numpy()} | {n: x[:, k % 3, k // 3] for k, n in enumerate(_STATES)} | {"nis": s.seen[:, 0], "noise_scale": s.seen[:, 1], "trace": np.einsum("naii->n", c)})

    schema = "track_id string, method string, t double, " + ", ".join(f"{c} double" for c in (*_STATES, "nis", "noise_scale", "trace"))
    return spread(base).groupBy(*_KEYS).cogroup(spread(entering.join(follow, _KEYS)).groupBy(*_KEYS)).applyInPandas(smoothed, schema)

