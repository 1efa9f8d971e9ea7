"""Quality of tracks, joins and methods: native aggregates and a few grouped metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackspark.functions import scalars as S
from trackspark.operators import timeseries as T
from trackspark.operators.evaluation import curve, diagonals


def motion_outliers(samples: DataFrame, floor: float = 1200.0, factor: float = 5.0) -> DataFrame:
    """F12, one pass: interior rows with two bad edges, and end rows whose edge is bad while the next is fine."""
    w = Window.partitionBy("track_id").orderBy("t")
    s = samples.withColumn("_v", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy") + F.col("vz") * F.col("vz")))
    step = F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) ** 2 for c in ("x", "y", "z")), F.lit(0.0))) / (F.col("t") - F.lag("t").over(w))
    limit = F.greatest(F.lit(floor), factor * F.greatest((F.col("_v") + F.lag("_v").over(w)) / 2, F.lit(1.0)))
    s = s.withColumn("_bad", step > limit)
    s = s.withColumns({"_next": F.lead("_bad").over(w), "_after": F.lead("_bad", 2).over(w), "_before": F.lag("_bad").over(w)})
    inner = F.col("_bad") & F.col("_next")
    first = F.col("_bad").isNull() & F.col("_next") & ~F.coalesce("_after", F.lit(False))
    last = F.col("_next").isNull() & F.col("_bad") & ~F.coalesce("_before", F.lit(False))
    return s.withColumn("outlier", F.coalesce(inner, F.lit(False)) | F.coalesce(first, F.lit(False)) | F.coalesce(last, F.lit(False))).drop("_v", "_bad", "_next", "_after", "_before")


def filter_motion_outliers(samples: DataFrame, passes: int = 4, least: int = 8, most: int | None = None, key: str = "track_id") -> DataFrame:
    """up to `passes` times: rows that motion_outliers() marks go, or where a track has none the single row with the worst step ratio
    above 1 (ties: the first); the worst first where more than `most` are marked, and never below `least` rows. Native; passes unrolled."""
    s = samples
    part = Window.partitionBy(key)
    for _ in range(passes):
        w = part.orderBy("t")
        m = motion_outliers(s).withColumn("_v", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy") + F.col("vz") * F.col("vz")))
        step = F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) ** 2 for c in ("x", "y", "z")), F.lit(0.0))) / (F.col("t") - F.lag("t").over(w))
        m = m.withColumn("_q", step / F.greatest(F.lit(1200.0), 5.0 * F.greatest((F.col("_v") + F.lag("_v").over(w)) / 2, F.lit(1.0))))
        m = m.withColumn("_worst", F.greatest(F.coalesce("_q", F.lit(0.0)), F.coalesce(F.lead("_q").over(w), F.lit(0.0))))
        m = m.withColumns({"_n": F.count("*").over(part), "_any": F.max("outlier").over(part), "_place": F.row_number().over(part.orderBy(F.desc("outlier"), F.desc("_worst"), "t"))})
        allowed = F.col("_n") - least if most is None else F.least(F.col("_n") - least, F.lit(most))
        goes = F.when(F.col("_any"), F.col("outlier") & (F.col("_place") <= allowed)).otherwise((F.col("_place") == 1) & (F.col("_worst") > 1) & (allowed >= 1))
        s = m.where(~F.coalesce(goes, F.lit(False))).select(*samples.columns)
    return s


def robust_standardize(df: DataFrame, keys: list[str], columns: list[str], clip: float = 50.0) -> DataFrame:
    """(x - median) / scale by key, clipped; NULL gives 0."""
    part = Window.partitionBy(*keys)
    df = df.withColumns({f"_m_{c}": F.percentile(c, 0.5).over(part) for c in columns})
    df = df.withColumns({f"_s_{c}": 1.4826 * F.percentile(F.abs(F.col(c) - F.col(f"_m_{c}")), 0.5).over(part) for c in columns} | {f"_d_{c}": F.stddev_pop(c).over(part) for c in columns})
    scale = lambda c: F.when(F.col(f"_s_{c}") > 1e-6, F.col(f"_s_{c}")).when(F.col(f"_d_{c}") > 1e-6, F.col(f"_d_{c}")).otherwise(1.0)
    z = {f"{c}_z": F.coalesce(F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.col(c) - F.col(f"_m_{c}")) / scale(c))), F.lit(0.0)) for c in columns}
    df = df.withColumns(z).drop(*(f"_{k}_{c}" for k in "msd" for c in columns))
    return df


def turn_labels(headings: DataFrame, deadband: float = 0.75, medium: float = 3.0, rapid: float = 7.0) -> DataFrame:
    """M5 before its stabilising: side and band of the turn from the rate of the compass heading."""
    r = F.col("rate")
    band = S.magnitude_band(r, medium, rapid)
    return headings.withColumn("turn", F.when(r.isNull() | (F.abs(r) < deadband), "straight").otherwise(F.concat_ws("_", F.lit("turn"), F.when(r > 0, "right").otherwise("left"), band)))


def huber_weight(features: DataFrame, gate: float = 50.0) -> DataFrame:
    """Gate / mismatch beyond the gate, 0 from three gates on."""
    m = F.col("mismatch")
    return features.withColumn("weight", F.when(m <= gate, 1.0).when(m > 3 * gate, 0.0).otherwise(gate / m))


def gap_honesty(render: DataFrame, gaps: DataFrame) -> DataFrame:
    """Share of each gap's whole seconds that rendered rows cover."""
    g = gaps.select(F.col("track_id").alias("g_track"), "a", "b")
    j = g.join(render, (F.col("track_id") == F.col("g_track")) & (F.col("t") > F.col("a")) & (F.col("t") < F.col("b")), "left")
    return j.groupBy(F.col("g_track").alias("track_id"), "a", "b").agg(F.count_distinct("t").alias("n_inside"))


def verify_continuity(segments: DataFrame) -> DataFrame:
    """Jumps between the end of a segment and the start of the next one of its track."""
    w = Window.partitionBy("track_id").orderBy("segment")
    return segments.withColumns({f"jump_{c}": F.abs(F.lead(f"first_{c}").over(w) - F.col(f"last_{c}")) for c in ("x", "vx")}).where("jump_x is not null")


def frechet(pairs: DataFrame) -> DataFrame:
    """Discrete Frechet distance of two curves of (track_id, which, t, x, y, z), of all their points; one group a track, anti-diagonals in numpy."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        a, b = (curve(g, k) for k in (0, 1))
        return pd.DataFrame([{"track_id": g.track_id.iloc[0], "frechet": diagonals(np.maximum, a, b) if len(a) and len(b) else None}])

    return T.spread(pairs, "track_id").groupBy("track_id").applyInPandas(run, "track_id string, frechet double")


def high_frequency_share(series: DataFrame, value: str, hertz: float = 0.4, least: int = 8) -> DataFrame:
    """Share of the spectrum's power at or above a frequency, at the median step; NULL for short series."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.dropna(subset=[value]).sort_values("t")
        out = None
        if len(g) >= least:
            dt = float(np.median(np.diff(g.t)))
            x = g[value].to_numpy()
            power = np.abs(np.fft.rfft(x - x.mean())) ** 2
            whole = power[1:].sum()
            out = float(power[np.fft.rfftfreq(len(x), dt) >= hertz].sum() / whole) if dt > 0 and whole > 0 else 0.0
        return pd.DataFrame([{"track_id": g.track_id.iloc[0] if len(g) else None, "share": out}])

    return series.groupBy("track_id").applyInPandas(run, "track_id string, share double")


def model_score(metrics: DataFrame) -> DataFrame:
    """E14 on two of its parts: weighted mean of the component scores that are known; loss = 100 - score."""
    parts = [(S.score_lower_is_better(F.col("accel_rms"), 2.2, 9.0, 60.0), 0.35), (S.score_lower_is_better(F.col("turn_p95"), 3.5, 15.0, 65.0), 0.25), (S.score_ratio_band(F.col("ratio"), 0.45, 1.25, 0.08, 2.8), 0.35)]
    score = S.weighted_score(parts)
    return metrics.withColumns({"score": score, "loss": 100 - score, "grade": S.score_interpretation(score)})
