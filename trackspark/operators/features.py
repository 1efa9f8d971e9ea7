"""Motion features and labels of samples(track_id, t, x, y, z, vx, vy, vz)."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.functions import scalars as S
from trackspark.operators import timeseries as T


def motion_features(samples: DataFrame, k: int = 3) -> DataFrame:
    """M1: speed, energy height, mismatch of reported against position velocity, smoothed vertical rate."""
    s = samples.withColumn("speed", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")))
    for c in ("x", "y"):
        s = T.sample_gradient(s, ["track_id"], "t", c, f"d{c}")
    s = s.withColumns({
        "energy": F.col("z") + F.col("speed") * F.col("speed") / (2 * S.GRAVITY),
        "mismatch": F.sqrt(F.pow(F.col("dx") - F.col("vx"), 2) + F.pow(F.col("dy") - F.col("vy"), 2)),
    })
    return T.rolling_median(s, ["track_id"], ["t"], "vz", k, "vz_smooth")


def energy_labels(features: DataFrame, slow: float = 25.0, vertical: float = 1.0) -> DataFrame:
    """M4, its vertical part."""
    v = F.col("vz_smooth")
    return features.withColumn("label", F.when(F.col("speed") < slow, "ground_slow").when(v > vertical, "climb").when(v < -vertical, "descent").otherwise("level"))


def velocity_confidence(samples: DataFrame, keys: tuple[str, ...] = ("track_id",), gate: float = 55.0, vertical: float = 9.0, angle: float = 35.0, still: float = 3.0, near: float = 10.0) -> DataFrame:
    """Samples with `confidence`, how far a reported velocity agrees with the two-point slope of positions (W6), in 0 to 1.

    The product of gate / mismatch beyond the gate (0 beyond three gates), vertical / vertical mismatch, angle / angle between the
    directions (1 where either is below `still`), and 0 where the slope is below `still` or the nearer neighbour (W16) closer than
    `near` metres. 1 for a key of one row.
    """
    own, keys = samples.columns, list(keys)
    s = samples
    for c in "xyz":
        s = T.sample_gradient(s, keys, "t", c, f"_d{c}", 1e-9)
    s = T.neighbour_step(s, keys, "t", ["x", "y", "z"], "_near")
    square = lambda *c: reduce(lambda a, b: a + b, [x * x for x in c])
    off = [F.col(f"v{c}") - F.col(f"_d{c}") for c in "xyz"]
    s = s.withColumns({"_miss": F.sqrt(square(*off)), "_up": F.abs(off[2]), "_said": F.sqrt(square(F.col("vx"), F.col("vy"))), "_moved": F.sqrt(square(F.col("_dx"), F.col("_dy")))})
    cosine = (F.col("vx") * F.col("_dx") + F.col("vy") * F.col("_dy")) / F.greatest(F.col("_said") * F.col("_moved"), F.lit(1e-9))
    apart = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
    within = lambda limit, x: F.least(F.lit(1.0), F.lit(limit) / F.greatest(x, F.lit(limit)))
    slow = (F.col("_said") < still) | (F.col("_moved") < still)
    scale = F.when(F.col("_miss") > 3 * gate, 0.0).otherwise(within(gate, F.col("_miss"))) * within(vertical, F.col("_up")) * F.when(slow, 1.0).otherwise(within(angle, apart))
    held = F.when(F.col("_near").isNull(), 1.0).when((F.col("_moved") < still) | (F.col("_near") < near), 0.0).otherwise(scale)
    return s.withColumn("confidence", held).select(*own, "confidence")


def stabilize_labels(labelled: DataFrame, min_points: int, min_seconds: float, passes: int = 12) -> DataFrame:
    """Each pass merges the first run without support: into equal neighbours, else into the stronger side (ties: left).

    A grouped job on a track's runs, not its rows.
    """
    runs = T.label_runs(labelled, ["track_id"], "t", "label")

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        rows = g.sort_values("run").to_dict("records")
        for _ in range(passes):
            weak = next((i for i, r in enumerate(rows) if len(rows) > 1 and (r["n"] < min_points or r["duration"] < min_seconds)), None)
            if weak is None:
                break
            left, right = rows[weak - 1] if weak else None, rows[weak + 1] if weak + 1 < len(rows) else None
            strength = lambda r: -1.0 if r is None else r["duration"] + 0.25 * r["n"]
            rows[weak]["label"] = (left if strength(left) >= strength(right) else right)["label"]
            joined: list[dict] = []
            for r in rows:
                if joined and joined[-1]["label"] == r["label"]:
                    joined[-1] |= {"last_index": r["last_index"], "t1": r["t1"], "n": joined[-1]["n"] + r["n"], "duration": r["t1"] - joined[-1]["t0"]}
                else:
                    joined.append(dict(r))
            rows = joined
        return pd.DataFrame([r | {"run": i} for i, r in enumerate(rows)])[["track_id", "run", "label", "first_index", "last_index", "t0", "t1", "n"]]

    return runs.groupBy("track_id").applyInPandas(merge, "track_id string, run long, label string, first_index long, last_index long, t0 double, t1 double, n long")
