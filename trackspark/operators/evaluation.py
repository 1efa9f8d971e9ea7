"""Metrics of tracks and methods."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackspark.functions import scalars as S
from trackspark.operators import timeseries as T


def time_grid(samples: DataFrame, gap: float = 10.0) -> DataFrame:
    """E1."""
    w = Window.partitionBy("track_id").orderBy("t")
    s = samples.withColumn("dt", F.col("t") - F.lag("t").over(w))
    return s.groupBy("track_id").agg((F.max("t") - F.min("t")).alias("duration"), F.percentile("dt", 0.5).alias("median_dt"), F.percentile("dt", 0.95).alias("p95_dt"), F.count_if(F.col("dt") > gap).alias("n_gaps"))


def smoothness(samples: DataFrame) -> DataFrame:
    """Size of the acceleration that the reported velocity gives."""
    s = samples
    for c in ("vx", "vy", "vz"):
        s = T.sample_gradient(s, ["track_id"], "t", c, f"a_{c}")
    a = F.sqrt(F.col("a_vx") * F.col("a_vx") + F.col("a_vy") * F.col("a_vy") + F.col("a_vz") * F.col("a_vz"))
    return s.withColumn("a", a).groupBy("track_id").agg(T.rms(F.col("a")).alias("rms"), F.percentile("a", 0.95).alias("p95"), F.max("a").alias("most"))


def unwrapped_heading(samples: DataFrame) -> DataFrame:
    """Compass heading made continuous, and its rate in degrees a second."""
    w = Window.partitionBy("track_id").orderBy("t")
    h = samples.withColumn("h", F.degrees(S.direction(F.col("vx"), F.col("vy"))))
    d = h.withColumn("d", S.wrapped(F.col("h") - F.lag("h").over(w), F.lit(180.0)))
    total = F.first("h").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    return d.withColumns({"heading": total, "rate": F.col("d") / (F.col("t") - F.lag("t").over(w))})


def envelope_violations(samples: DataFrame, speed: float = 350.0, vertical: float = 35.0) -> DataFrame:
    """E13."""
    v = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))
    return samples.groupBy("track_id").agg(F.count_if(v > speed).alias("n_fast"), F.count_if(F.abs("vz") > vertical).alias("n_vertical"), F.count("*").alias("n"))


def curve(pairs: pd.DataFrame, which: int) -> np.ndarray:
    """All points of one curve of (which, t, x, y and z where there is one) in order of time."""
    return pairs[pairs.which == which].sort_values("t")[[c for c in ("x", "y", "z") if c in pairs]].dropna().to_numpy(float)


def diagonals(cost, a: np.ndarray, b: np.ndarray) -> float:
    """Last cell of a table whose cell (i, j) is cost(distance of a[i] and b[j], least of its three neighbours before); every point counts,
    and only three anti-diagonals are kept."""
    older, old = np.full(len(a) + 1, np.inf), np.full(len(a) + 1, np.inf)
    older[0] = 0
    for s in range(2, len(a) + len(b) + 1):
        i = np.arange(max(1, s - len(b)), min(len(a), s - 1) + 1)
        new = np.full(len(a) + 1, np.inf)
        new[i] = cost(np.sqrt(((a[i - 1] - b[s - i - 1]) ** 2).sum(1)), np.minimum(np.minimum(old[i - 1], old[i]), older[i - 1]))
        older, old = old, new
    return float(old[-1])


def hausdorff(pairs: DataFrame) -> DataFrame:
    """Largest distance from a point of curve 0 of (track_id, which, t, x, y, z) to its nearest of curve 1, the reverse, and the
    larger of both; of all points, in blocks of 512 by 4,096."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        a, b = (curve(g, k) for k in (0, 1))
        there, back = None, None
        if len(a) and len(b):
            nearest, back_ = np.full(len(a), np.inf), np.full(len(b), np.inf)
            for i in range(0, len(a), 512):
                for j in range(0, len(b), 4096):
                    d = ((a[i : i + 512, None] - b[None, j : j + 4096]) ** 2).sum(2)
                    nearest[i : i + 512] = np.minimum(nearest[i : i + 512], d.min(1))
                    back_[j : j + 4096] = np.minimum(back_[j : j + 4096], d.min(0))
            there, back = float(np.sqrt(nearest.max())), float(np.sqrt(back_.max()))
        return pd.DataFrame([{"track_id": g.track_id.iloc[0], "hausdorff": there, "reverse": back, "symmetric": there if there is None else max(there, back)}])

    return T.spread(pairs, "track_id").groupBy("track_id").applyInPandas(run, "track_id string, hausdorff double, reverse double, symmetric double")


def dtw_mean(pairs: DataFrame) -> DataFrame:
    """E5: mean cost of dynamic time warping of two curves of (track_id, which, t, x, y, z), of all their points; anti-diagonals in numpy."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        a, b = (curve(g, k) for k in (0, 1))
        return pd.DataFrame([{"track_id": g.track_id.iloc[0], "dtw": diagonals(np.add, a, b) / (len(a) + len(b)) if len(a) and len(b) else None}])

    return T.spread(pairs, "track_id").groupBy("track_id").applyInPandas(run, "track_id string, dtw double")


def score_methods(metrics: DataFrame) -> DataFrame:
    """metric(method, metric, value): each value over the median of the positive ones; a method's mean; rank, least first."""
    m = metrics.withColumn("value", F.abs("value"))
    part = Window.partitionBy("metric")
    stats = m.withColumns({"med": F.percentile(F.when(F.col("value") > 0, F.col("value")), 0.5).over(part), "n": F.count("*").over(part), "spread": F.max("value").over(part) - F.min("value").over(part)})
    s = stats.where("n >= 2 and spread > 1e-9 and med is not null").groupBy("method").agg(F.avg(F.col("value") / F.col("med")).alias("score"))
    return s.withColumn("place", F.rank().over(Window.orderBy(F.round("score", 9))).cast("long"))
