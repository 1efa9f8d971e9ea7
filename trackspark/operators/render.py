"""From states and coefficients to regular frames: native polynomial evaluation between neighbouring states."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackspark.functions import scalars as S
from trackspark.operators import timeseries
from trackspark.operators.splines import _bracket

POS, VEL, ACC, JERK = (tuple(f"{p}{c}" for c in "xyz") for p in ("", "v", "a", "j"))


def _quintic(a: Column, b: Column, c: str, h: Column, u: Column) -> tuple[Column, Column, Column, Column]:
    """Value and three derivatives of the quintic that meets position, velocity and acceleration of both states."""
    c0, c1, c2 = a[c], a[f"v{c}"] * h, 0.5 * a[f"a{c}"] * h * h
    d0, d1, d2 = b[c] - c0 - c1 - c2, b[f"v{c}"] * h - c1 - 2 * c2, b[f"a{c}"] * h * h - 2 * c2
    k = (c0, c1, c2, 10 * d0 - 4 * d1 + 0.5 * d2, -15 * d0 + 7 * d1 - d2, 6 * d0 - 3 * d1 + 0.5 * d2)
    out = []
    for order in range(4):
        total = F.lit(0.0)
        for n in range(5, order - 1, -1):
            factor = 1.0
            for m in range(order):
                factor *= n - m
            total = total * u + factor * k[n]
        out.append(total / F.pow(h, F.lit(order)) if order else total)
    return tuple(out)


def _constant(s: Column, c: str, d: Column) -> tuple[Column, Column, Column, Column]:
    return s[c] + s[f"v{c}"] * d + 0.5 * s[f"a{c}"] * d * d, s[f"v{c}"] + s[f"a{c}"] * d, s[f"a{c}"], F.lit(0.0)


def evaluate_states(states: DataFrame, queries: DataFrame, keys: list[str], hold_left: bool = False) -> DataFrame:
    """K3: position and three derivatives at queries(keys, t) from states(keys, t, x..az): a quintic between neighbours, constant
    acceleration beyond the ends; hold_left: constant acceleration from the state before, everywhere."""
    j = _bracket(states, queries, keys, [*POS, *VEL, *ACC])
    t, a, b = F.col("_t"), F.col("_a"), F.col("_b")
    h = b["t"] - a["t"]
    out = {}
    for c in "xyz":
        early, late, inside = _constant(b, c, t - b["t"]), _constant(a, c, t - a["t"]), _quintic(a, b, c, h, (t - a["t"]) / h)
        for k, name in enumerate((c, f"v{c}", f"a{c}", f"j{c}")):
            alone = b.isNull() | (h <= 0) if not hold_left else F.lit(True)
            out[name] = F.when(a.isNull(), early[k]).when(alone, late[k]).otherwise(inside[k])
    return j.select(*keys, t.alias("t"), *(v.alias(k) for k, v in out.items()))


def render_states(states: DataFrame, step: float = 0.25, keys: tuple[str, ...] = ("track_id", "method")) -> DataFrame:
    """K15 of filter states: W25's grid, K3's values; one segment a track."""
    known = states.where("t is not null")
    grid = timeseries.resample(known, list(keys), "t", step)
    return evaluate_states(known, grid, list(keys)).withColumn("segment", F.lit(0).cast("long"))


def with_structs(render: DataFrame, field_ft: float = 0.0) -> DataFrame:
    """Frames with position, velocity and acceleration structs."""
    return render.select(*(c for c in ("track_id", "method", "segment", "t") if c in render.columns), *(v.alias(k) for k, v in S.render_structs(F.lit(field_ft)).items()))


def densified(render: DataFrame, keys: list[str], step: float = 0.25) -> DataFrame:
    """W25 as a viewer has it: positions on the grid by a line, vectors held from the row on the left."""
    grid = timeseries.resample(render, keys, "t", step)
    j = _bracket(render, grid, keys, [*POS, *VEL])
    t, a, b = F.col("_t"), F.col("_a"), F.col("_b")
    share = F.when(b["t"] > a["t"], (t - a["t"]) / (b["t"] - a["t"])).otherwise(0.0)
    return j.select(*keys, t.alias("t"), *((a[c] + (b[c] - a[c]) * share).alias(c) for c in POS), *(a[c].alias(c) for c in VEL))


def viewer_segments(render: DataFrame, keys: list[str]) -> DataFrame:
    """IO9 and W21: runs of equal segment with first and last frame index and time."""
    return timeseries.label_runs(render, keys, "t", "segment").select(*keys, F.col("run").cast("long").alias("run"), F.col("label").alias("segment"), "first_index", "last_index", "t0", "t1", "n")


def next_far(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Of each point the index of the first later one more than `least` away, or the number of points.

    Boxes around 2^k points in a row are kept for each k; a box that lies within reach is passed whole, and a single point's box is
    the point itself, so nothing is passed wrongly. What a pass over all sizes leaves open is taken up by the next one.
    """
    n = len(x)
    boxes = [(x, x, y, y)]
    while 2 ** len(boxes) <= n:
        half, b = 2 ** (len(boxes) - 1), boxes[-1]
        boxes.append(tuple((np.minimum, np.maximum)[i % 2](b[i][:-half], b[i][half:]) for i in range(4)))
    at = np.arange(1, n + 1)
    left = np.arange(n)
    while len(left):
        before = at[left].copy()
        for k in range(len(boxes) - 1, -1, -1):
            own = left[at[left] + 2**k <= n]
            x0, x1, y0, y1 = (b[at[own]] for b in boxes[k])
            away = np.hypot(np.maximum(np.abs(x0 - x[own]), np.abs(x1 - x[own])), np.maximum(np.abs(y0 - y[own]), np.abs(y1 - y[own])))
            at[own[away <= least]] += 2**k
        left = left[(at[left] > before) & (at[left] < n)]
    return at


def neighbour_heading(points: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """Bearing in degrees to the first later point more than `least` metres away, else from the last earlier one, else 0.

    One group a key, of its own times and places; the search by doubling takes a few passes whatever the points do.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t", kind="stable")
        x, y, n = g.x.to_numpy(float), g.y.to_numpy(float), len(g)
        ahead, back = next_far(x, y, least), n - 1 - next_far(x[::-1], y[::-1], least)[::-1]
        to, start = np.minimum(ahead, n - 1), np.where(ahead < n, np.arange(n), np.maximum(back, 0))
        end = np.where(ahead < n, to, np.arange(n))
        known = (ahead < n) | (back >= 0)
        heading = np.degrees(np.arctan2(x[end] - x[start], y[end] - y[start])) % 360
        return g.assign(heading=np.where(known, heading, 0.0))

    return points.groupBy(*keys).applyInPandas(run, T.StructType([*points.schema.fields, T.StructField("heading", T.DoubleType())]))
