"""Comparison of methods: a render (track_id, method, segment, t, x, y, z, vx, vy, vz, ax, ay, az) against raw samples.

All metrics are windows and aggregates on the keys of a render, track_id and method, so one shuffle on the track serves a
whole group of metrics and every (track, method) is independent of the others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.functions import scalars as S
from trackspark.operators import quality
from trackspark.operators import timeseries as T

KEYS = ["track_id", "method"]
POS, VEL, ACC, JERK, SNAP = (tuple(f"{p}{c}" for c in "xyz") for p in ("", "v", "a", "j", "s"))
# Fixed values of the metrics: limits of speed, vertical rate, acceleration, jerk, bank and turn rate; gaps, ends and airborne rows.
ENVELOPE = {"groundspeed": 350.0, "vertical_rate": 35.0, "accel": 20.0, "jerk": 20.0, "bank": 75.0, "turn_rate": 20.0}
LONG_GAP, END_WINDOW, MOVING, AIRBORNE_SPEED, AIRBORNE_Z = 10.0, 10.0, 5.0, 30.0, 30.0

#: Metric groups and weights of the comparison.
GROUPS = {
    "smoothness": (2.0, ("accel_rms", "accel_p95", "accel_max", "jerk_rms", "jerk_p95", "jerk_max", "hf_accel_ratio", "hf_jerk_ratio")),
    "dynamics": (1.0, ("curvature_rms", "curvature_p95", "turn_rate_p95", "bank_p95")),
    "position_fidelity": (2.0, ("horizontal_rmse", "horizontal_p95", "vertical_rmse", "vertical_p95", "position_rmse", "position_p95", "along_rmse", "cross_rmse")),
    "velocity_fidelity": (1.5, ("velocity_rmse", "speed_rmse", "angle_rmse")),
    "shape": (1.0, ("hausdorff", "symmetric", "dtw", "frechet")),
    "endpoints": (0.5, ("end_jerk_ratio", "end_accel_ratio")),
    "gaps": (0.5, ("gap_accel_p95", "gap_jerk_p95")),
    "trajectory_model": (2.0, ("loss",)),
    "envelope": (1.0, tuple(f"violations_{k}" for k in ENVELOPE)),
}


def norm(columns) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [F.col(c) * F.col(c) for c in columns]))


def interpolate_columns(series: DataFrame, queries: DataFrame, keys: list[str], time: str, columns) -> DataFrame:
    """J4 for several columns at once, each over its own known points: columns p_<name>; two sorts whatever the number of columns."""
    mean = series.groupBy(*keys, time).agg(*(F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.avg(c)).alias(c) for c in columns))  # a sum would make 0 of -0
    points = mean.select(*keys, F.col(time).alias("_t"), F.lit(0).alias("_q"), *(F.when(F.col(c).isNotNull(), F.struct(F.col(time).alias("t"), F.col(c).alias("v"))).alias(f"_p_{c}") for c in columns))
    both = queries.withColumns({"_t": F.col(time), "_q": F.lit(1)}).unionByName(points, allowMissingColumns=True)
    before = Window.partitionBy(*keys).orderBy("_t", "_q").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy(F.desc("_t"), "_q").rowsBetween(Window.unboundedPreceding, 0)
    b = both.withColumns({f"_a_{c}": F.last(f"_p_{c}", ignorenulls=True).over(before) for c in columns})
    b = b.withColumns({f"_b_{c}": F.last(f"_p_{c}", ignorenulls=True).over(after) for c in columns}).where("_q = 1")
    out = {}
    for c in columns:
        a, z = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        share = (F.col("_t") - a["t"]) / (z["t"] - a["t"])
        out[f"p_{c}"] = F.when(a.isNull() | z.isNull(), None).when(a["t"] == z["t"], a["v"]).otherwise(a["v"] + (z["v"] - a["v"]) * share)
    return b.select(*queries.columns, *(v.alias(k) for k, v in out.items()))


def gradients(df: DataFrame, keys: list[str], time: str, columns: dict[str, str], fill: bool = True) -> DataFrame:
    """W5 of several columns {value: out} in one window; NULLs are first filled by row position."""
    w = Window.partitionBy(*keys).orderBy(time)
    source = {c: c for c in columns}
    if fill:
        df = df.withColumn("_i", F.row_number().over(w))
        for c in columns:
            known = F.when(F.col(c).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(c).alias("v")))
            back = Window.partitionBy(*keys).orderBy(F.desc("_i"))
            df = df.withColumns({"_a": F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_b": F.last(known, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))})
            a, b = F.col("_a"), F.col("_b")
            between = a["v"] + (b["v"] - a["v"]) * (F.col("_i") - a["i"]) / (b["i"] - a["i"])
            df = df.withColumn(f"_f_{c}", F.coalesce(F.col(c), F.when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(between)))
            source[c] = f"_f_{c}"
    hs, hd = F.col(time) - F.lag(time).over(w), F.lead(time).over(w) - F.col(time)
    out = {}
    for c, name in columns.items():
        x = F.col(source[c])
        a, z = F.lag(source[c]).over(w), F.lead(source[c]).over(w)
        inner = (hs * hs * z + (hd * hd - hs * hs) * x - hd * hd * a) / (hs * hd * (hs + hd))
        out[name] = F.coalesce(inner, (z - x) / hd, (x - a) / hs)
    return df.withColumns(out).drop("_i", "_a", "_b", *(f"_f_{c}" for c in columns))


def motion(render: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Velocity and acceleration as given where a whole track has them, else differentiated for the whole track; jerk and snap.

    Columns vx..sz are the motion; g_vx..g_az what the render gave, fd_* the differentiated given values (for E16).
    """
    part = Window.partitionBy(*keys)
    r = render
    for c in (*VEL, *ACC):
        if c not in r.columns:
            r = r.withColumn(c, F.lit(None).cast("double"))
    r = r.withColumnsRenamed({c: f"g_{c}" for c in (*VEL, *ACC)})
    complete = lambda names: F.min(reduce(lambda a, b: a & b, [F.col(f"g_{c}").isNotNull() for c in names])).over(part)
    r = r.withColumns({"_v": complete(VEL), "_a": complete(ACC)}).withColumnsRenamed({"_v": "_has_v", "_a": "_has_a"})
    r = gradients(r, keys, "t", {p: f"fd_{v}" for p, v in zip(POS, VEL, strict=True)})
    r = gradients(r, keys, "t", {f"g_{v}": f"fd_{a}" for v, a in zip(VEL, ACC, strict=True)})
    r = r.withColumns({v: F.when(F.col("_has_v"), F.col(f"g_{v}")).otherwise(F.col(f"fd_{v}")) for v in VEL})
    r = gradients(r, keys, "t", {v: f"_d{a}" for v, a in zip(VEL, ACC, strict=True)}, fill=False)
    r = r.withColumns({a: F.when(F.col("_has_a"), F.col(f"g_{a}")).otherwise(F.col(f"_d{a}")) for a in ACC})
    r = gradients(r, keys, "t", dict(zip(ACC, JERK, strict=True)), fill=False)
    r = gradients(r, keys, "t", dict(zip(JERK, SNAP, strict=True)), fill=False)
    w = Window.partitionBy(*keys).orderBy("t")
    step = S.wrapped(F.col("_h") - F.lag("_h").over(w), F.pi())
    r = r.withColumn("_h", S.direction(F.col("vx"), F.col("vy"))).withColumn("_s", F.coalesce(step, F.lit(0.0)))
    r = r.withColumn("heading", F.first("_h").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = gradients(r, keys, "t", {"heading": "turn"}, fill=False)
    return r.drop("_has_v", "_has_a", "_h", "_s", *(f"_d{a}" for a in ACC))


def motion_metrics(m: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """E8 (but its spectrum), E10, E11, E13 and E17 of motion(), in one aggregate."""
    part = Window.partitionBy(*keys)
    speed, a, j, s = norm(VEL[:2]), norm(ACC), norm(JERK), norm(SNAP)
    m = m.withColumns({"_speed": speed, "_a": a, "_j": j, "_s": s, "_v": norm(VEL), "_first": F.min("t").over(part), "_last": F.max("t").over(part), "_rate": F.abs(F.degrees("turn"))})
    speed, a, j, s, rate = (F.col(f"_{c}") for c in ("speed", "a", "j", "s", "rate"))
    bank = F.abs(F.degrees(F.atan2(speed * F.radians(rate), F.lit(S.GRAVITY))))
    air = (speed >= AIRBORNE_SPEED) & (F.col("z").isNull() | (F.col("z") >= AIRBORNE_Z))
    high = (speed >= AIRBORNE_SPEED) | (F.col("z") >= AIRBORNE_Z)
    curve = F.when(air, F.radians(rate) / F.greatest(speed, F.lit(1e-9)))
    end = (F.col("t") <= F.col("_first") + END_WINDOW) | (F.col("t") >= F.col("_last") - END_WINDOW)
    ratio = lambda x: T.rms(F.when(end, x)) / F.nullif(T.rms(F.when(~end, x)), F.lit(0.0))
    calm = j / F.greatest(F.col("_v"), F.when(high, 35.0).otherwise(6.0))
    p = lambda x, q=0.95: F.percentile(x, q)
    over = {"groundspeed": speed, "vertical_rate": F.abs("vz"), "accel": a, "jerk": j, "bank": bank, "turn_rate": rate}
    return m.groupBy(*keys).agg(
        F.count("*").alias("n_frames"), T.rms(a).alias("accel_rms"), p(a).alias("accel_p95"), F.max(a).alias("accel_max"), T.rms(j).alias("jerk_rms"), p(j).alias("jerk_p95"), F.max(j).alias("jerk_max"),
        F.min(speed).alias("speed_min"), p(speed, 0.5).alias("speed_median"), p(speed).alias("speed_p95"), p(F.abs("vz")).alias("vertical_rate_p95"),
        T.rms(curve).alias("curvature_rms"), p(curve).alias("curvature_p95"), p(F.when(air, rate)).alias("turn_rate_p95"), p(F.when(air, bank)).alias("bank_p95"),
        ratio(a).alias("end_accel_ratio"), ratio(j).alias("end_jerk_ratio"), *(F.count_if(x > ENVELOPE[k]).alias(f"violations_{k}") for k, x in over.items()),
        p(rate).alias("turn_all_p95"), p(bank).alias("bank_all_p95"), T.rms(calm).alias("calm_rms"), p(calm).alias("calm_p95"), T.rms(s).alias("snap_rms"), p(s).alias("snap_p95"),
        p(j).alias("accel_variation_p95"),
    )


def spectrum_metrics(m: DataFrame) -> DataFrame:
    """Share of high frequencies in acceleration and jerk. One group a (track, method), its samples only."""
    series = m.select(F.to_json(F.struct(*KEYS)).alias("track_id"), *KEYS[1:], "t", norm(ACC).alias("a"), norm(JERK).alias("j"))
    a, j = (quality.high_frequency_share(series, c).withColumnRenamed("share", n) for c, n in (("a", "hf_accel_ratio"), ("j", "hf_jerk_ratio")))
    both = a.join(j, "track_id")
    return both.select(*(F.get_json_object("track_id", f"$.{k}").alias(k) for k in KEYS), "hf_accel_ratio", "hf_jerk_ratio")


def asked(samples: DataFrame, render: DataFrame, columns) -> DataFrame:
    """Samples beside each method's values at their times."""
    raw = samples.select("track_id", "t", *(F.col(c).alias(f"m_{c}") for c in columns))
    methods = render.select(*KEYS).distinct()
    return interpolate_columns(render, raw.join(methods, "track_id"), KEYS, "t", columns)


def position_metrics(samples: DataFrame, render: DataFrame) -> DataFrame:
    """E2 with A6: horizontal, vertical and spatial errors, and errors along and across the reported direction of moving rows."""
    q = asked(samples, render, (*POS, *VEL)).where("p_x is not null and p_y is not null and p_z is not null and m_x is not null and m_y is not null and m_z is not null")
    dx, dy, dz = (F.col(f"p_{c}") - F.col(f"m_{c}") for c in POS)
    h, v = F.sqrt(dx * dx + dy * dy), F.abs(dz)
    e, speed = F.sqrt(h * h + dz * dz), F.sqrt(F.col("m_vx") * F.col("m_vx") + F.col("m_vy") * F.col("m_vy"))
    moving = speed > MOVING
    along = F.when(moving, (dx * F.col("m_vx") + dy * F.col("m_vy")) / speed)
    cross = F.when(moving, (dy * F.col("m_vx") - dx * F.col("m_vy")) / speed)
    stats = lambda x, n: [T.rms(x).alias(f"{n}_rmse"), F.percentile(x, 0.5).alias(f"{n}_median"), F.percentile(x, 0.95).alias(f"{n}_p95"), F.max(x).alias(f"{n}_max")]
    return q.groupBy(*KEYS).agg(F.count("*").alias("n_compared"), *stats(h, "horizontal"), *stats(v, "vertical"), *stats(e, "position"), F.avg(dz).alias("vertical_mean"), T.rms(along).alias("along_rmse"), T.rms(cross).alias("cross_rmse"))


def velocity_metrics(samples: DataFrame, render: DataFrame) -> DataFrame:
    """Vector, speed, direction (of moving rows) and vertical errors of velocity."""
    q = asked(samples, render, VEL).where(" and ".join(f"p_{c} is not null and m_{c} is not null" for c in VEL))
    dx, dy, dz = (F.col(f"p_{c}") - F.col(f"m_{c}") for c in VEL)
    speed = lambda p: F.sqrt(F.col(f"{p}_vx") * F.col(f"{p}_vx") + F.col(f"{p}_vy") * F.col(f"{p}_vy"))
    angle = S.angle_diff_deg(*(F.degrees(S.direction(F.col(f"{p}_vx"), F.col(f"{p}_vy"))) for p in "pm"))
    return q.groupBy(*KEYS).agg(
        T.rms(F.sqrt(dx * dx + dy * dy)).alias("velocity_rmse"), T.rms(speed("p") - speed("m")).alias("speed_rmse"), T.rms(F.when(speed("m") > MOVING, angle)).alias("angle_rmse"),
        T.rms(dz).alias("vertical_velocity_rmse"), T.rms(F.sqrt(dx * dx + dy * dy + dz * dz)).alias("velocity_evidence_rmse"),
    )


def hard_gaps(samples: DataFrame, keys: list[str], time: str, absolute: float = LONG_GAP, relative: float | None = 5.0) -> DataFrame:
    """Keys, a, b of steps longer than max(absolute, relative * median positive step); relative None: only the absolute limit."""
    w = Window.partitionBy(*keys).orderBy(time)
    g = samples.select(*keys, F.col(time).alias("a"), F.lead(time).over(w).alias("b")).withColumn("_d", F.col("b") - F.col("a"))
    if relative is None:
        return g.where(F.col("_d") > absolute).drop("_d")
    median = F.percentile(F.when(F.col("_d") > 0, F.col("_d")), 0.5).over(Window.partitionBy(*keys))
    return g.withColumn("_m", F.coalesce(median, F.lit(1.0))).where(F.col("_d") > F.greatest(F.lit(absolute), relative * F.col("_m"))).drop("_d", "_m")


def in_gap(df: DataFrame, gaps: DataFrame, keys: list[str], time: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """Rows that lie strictly inside a gap (keys, a, b), with the gap's ends. Gaps of a key do not overlap, so the last gap that
    begins before a row decides: a union and a window instead of a range join."""
    marks = gaps.select(*keys, F.col("a").alias("_t"), F.lit(1).alias("_side"), F.struct("a", "b").alias("_g"))
    both = df.withColumns({"_t": F.col(time), "_side": F.lit(0)}).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_g", F.last("_g", ignorenulls=True).over(w)).where("_side = 0").where(F.col("_t") < F.col("_g.b"))
    return found.select(*df.columns, F.col("_g.a").alias("gap_a"), F.col("_g.b").alias("gap_b"))


def _each_method(gaps: DataFrame, render: DataFrame) -> DataFrame:
    return gaps.join(render.select(*KEYS).distinct(), "track_id")


def gap_behavior(samples: DataFrame, m: DataFrame) -> DataFrame:
    """Gaps of more than 10 s, frames inside them, and p95 of acceleration and jerk there; 0 where there are none."""
    gaps = _each_method(hard_gaps(samples, ["track_id"], "t", relative=None), m)
    inside = in_gap(m.select(*KEYS, "t", norm(ACC).alias("a"), norm(JERK).alias("j")), gaps, KEYS, "t")
    found = inside.groupBy(*KEYS).agg(F.count("*").alias("n"), F.percentile("a", 0.95).alias("pa"), F.percentile("j", 0.95).alias("pj"))
    count = gaps.groupBy(*KEYS).agg(F.count("*").alias("n_gaps"))
    zero = lambda c, t: F.coalesce(c, F.lit(0)).cast(t)
    return m.select(*KEYS).distinct().join(count, KEYS, "left").join(found, KEYS, "left").select(
        *KEYS, zero(F.col("n_gaps"), "long").alias("n_long_gaps"), zero(F.col("n"), "long").alias("n_gap_frames"), zero(F.col("pa"), "double").alias("gap_accel_p95"), zero(F.col("pj"), "double").alias("gap_jerk_p95")
    )


def gap_honesty(samples: DataFrame, render: DataFrame) -> DataFrame:
    """Mean share of each hard gap that rendered frames cover, at the render's median step; 0 without gaps."""
    w = Window.partitionBy(*KEYS).orderBy("t")
    step = render.select(*KEYS, (F.col("t") - F.lag("t").over(w)).alias("d")).where("d > 0").groupBy(*KEYS).agg(F.percentile("d", 0.5).alias("step"))
    gaps = _each_method(hard_gaps(samples, ["track_id"], "t"), render)
    inside = in_gap(render.select(*KEYS, "t"), gaps, KEYS, "t").groupBy(*KEYS, F.col("gap_a").alias("a")).agg(F.count("*").alias("n"))
    g = gaps.join(inside, [*KEYS, "a"], "left").join(step, KEYS, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    wanted = F.greatest(F.lit(1.0), (F.col("b") - F.col("a")) / F.greatest(F.coalesce("step", F.lit(1.0)), F.lit(1e-6)) - 1)
    found = g.groupBy(*KEYS).agg(F.count("*").alias("n_hard_gaps"), F.sum("n").alias("n_bridging"), F.avg(F.least(F.lit(1.0), F.col("n") / wanted)).alias("gap_coverage"))
    return render.select(*KEYS).distinct().join(found, KEYS, "left").select(*KEYS, *(F.coalesce(c, F.lit(0)).cast(t).alias(c) for c, t in (("n_hard_gaps", "long"), ("n_bridging", "long"), ("gap_coverage", "double"))))


def derivative_closure(m: DataFrame) -> DataFrame:
    """Velocity and acceleration as given against those differentiated from the render; NULL with fewer than three rows."""
    def stats(given, made, name):
        d = F.sqrt(reduce(lambda a, b: a + b, [(F.col(f"g_{c}") - F.col(f"{made}{c}")) ** 2 for c in given]))
        enough = F.count(d) >= 3
        return [F.when(enough, T.rms(d)).alias(f"{name}_closure_rmse"), F.when(enough, F.percentile(d, 0.95)).alias(f"{name}_closure_p95")]

    return m.groupBy(*KEYS).agg(*stats(VEL, "fd_", "velocity"), *stats(ACC, "fd_", "accel"))


def difference_evidence(samples: DataFrame, render: DataFrame) -> DataFrame:
    """The render's velocity against that of raw positions, away from gaps over max(10, 4 * median) s, and the ratio of
    the robust scales of their steps (speed and vertical), NULL with fewer than 8 rows."""
    raw = gradients(samples.where("x is not null and y is not null and z is not null").select("track_id", "t", *POS), ["track_id"], "t", dict(zip(POS, ("rx", "ry", "rz"), strict=True)), fill=False)
    w = Window.partitionBy("track_id").orderBy("t")
    raw = raw.withColumns({"_b": F.col("t") - F.lag("t").over(w), "_a": F.lead("t").over(w) - F.col("t")})
    limit = F.greatest(F.lit(LONG_GAP), 4 * F.coalesce(F.percentile(F.when(F.col("_b") > 0, F.col("_b")), 0.5).over(Window.partitionBy("track_id")), F.lit(1.0)))
    raw = raw.withColumn("near", F.coalesce(F.col("_b") > limit, F.lit(False)) | F.coalesce(F.col("_a") > limit, F.lit(False))).select("track_id", "t", "rx", "ry", "rz", "near")
    q = interpolate_columns(render, raw.join(render.select(*KEYS).distinct(), "track_id"), KEYS, "t", VEL).where("p_vx is not null and p_vy is not null and p_vz is not null and rx is not null")
    d = F.sqrt((F.col("p_vx") - F.col("rx")) ** 2 + (F.col("p_vy") - F.col("ry")) ** 2 + (F.col("p_vz") - F.col("rz")) ** 2)
    far = F.when(~F.col("near"), d)
    over = Window.partitionBy(*KEYS).orderBy("t")
    step = lambda c: c - F.lag(c).over(over)
    speed = lambda a, b: F.sqrt(F.col(a) * F.col(a) + F.col(b) * F.col(b))
    s = q.withColumns({"ms": speed("p_vx", "p_vy"), "rs": speed("rx", "ry"), "d": far})
    s = s.withColumns({"d_ms": step(F.col("ms")), "d_rs": step(F.col("rs")), "d_mz": step(F.col("p_vz")), "d_rz": step(F.col("rz"))})
    med = s.withColumns({f"m_{c}": F.percentile(f"d_{c}", 0.5).over(Window.partitionBy(*KEYS)) for c in ("ms", "rs", "mz", "rz")})
    scale = lambda c: F.when(1.4826 * (mad := F.percentile(F.abs(F.col(f"d_{c}") - F.col(f"m_{c}")), 0.5)) > 1.4826e-12, 1.4826 * mad).otherwise(F.stddev_pop(f"d_{c}"))
    ratio = lambda m, r: F.when((F.count("*") >= 8) & (scale(r) >= 1e-9), scale(m) / scale(r))
    return med.groupBy(*KEYS).agg(F.when(F.count("d") >= 3, T.rms(F.col("d"))).alias("difference_rmse"), ratio("ms", "rs").alias("speed_detail"), ratio("mz", "rz").alias("vertical_detail"))


def join_metrics(samples: DataFrame, m: DataFrame) -> DataFrame:
    """Closure of position and jumps of velocity and acceleration where the segment changes; joins across gaps are only counted."""
    w = Window.partitionBy(*KEYS).orderBy("t")
    lag = lambda c: F.lag(c).over(w)
    dt = F.greatest(F.col("t") - lag("t"), F.lit(1e-6))
    size = lambda f: F.sqrt(reduce(lambda a, b: a + b, [f(i) ** 2 for i in range(3)]))
    j = m.withColumns({
        "lo": lag("t"), "new": ~F.col("segment").eqNullSafe(lag("segment")) & lag("t").isNotNull(),
        "closure": size(lambda i: F.col(POS[i]) - lag(POS[i]) - 0.5 * (F.col(VEL[i]) + lag(VEL[i])) * dt), "dv": size(lambda i: F.col(VEL[i]) - lag(VEL[i])), "da": size(lambda i: F.col(ACC[i]) - lag(ACC[i])),
    }).where("new").select(*KEYS, "lo", "t", "closure", "dv", "da")
    gaps = _each_method(hard_gaps(samples, ["track_id"], "t"), m)
    # A step overlaps a gap when the last gap that begins before the step's end also ends after the step's begin
    marks = gaps.select(*KEYS, F.col("a").alias("_t"), F.lit(1).alias("_side"), F.col("b").alias("_b"))
    both = j.withColumns({"_t": F.col("t"), "_side": F.lit(0)}).unionByName(marks, allowMissingColumns=True)
    over = Window.partitionBy(*KEYS).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    k = both.withColumn("_b", F.last("_b", ignorenulls=True).over(over)).where("_side = 0")
    hard = (F.col("t") - F.col("lo") > LONG_GAP) | F.coalesce(F.col("_b") > F.col("lo"), F.lit(False))
    plain = lambda c: F.percentile(F.when(~hard, F.col(c)), 0.95)
    return k.groupBy(*KEYS).agg(F.count_if(~hard).alias("n_joins"), F.count_if(hard).alias("n_hard_joins"), plain("closure").alias("join_closure_p95"), plain("dv").alias("join_velocity_p95"), plain("da").alias("join_accel_p95"))


def locality_score(method: Column, n_segments: Column | None = None) -> Column:
    """By the family in a method's name, or its number of segments."""
    m = F.lower(method)
    local = m.contains("piecewise") | m.contains("segment")
    if n_segments is not None:
        local = local | F.coalesce(n_segments > 1, F.lit(False))
    return F.when(m.contains("kalman") & ~m.contains("boundary"), 25.0).when(m.contains("global") | m.contains("whole"), 30.0).when(local, 100.0).when(m.contains("spline"), 85.0).otherwise(55.0)


def model_score(metrics: DataFrame) -> DataFrame:
    """Ten component scores of a row of all metrics, their weighted mean, and the loss 100 - score."""
    low = lambda c, good, poor, default: S.score_lower_is_better(F.col(c), good, poor, default)
    band = lambda c, *limits: F.coalesce(S.score_ratio_band(F.col(c), *limits), F.lit(55.0))
    parts = {
        "position": (0.10, low("position_rmse", 12, 160, 65.0)), "velocity": (0.15, low("velocity_evidence_rmse", 2.5, 32, 55.0)), "difference": (0.13, low("difference_rmse", 4, 45, 55.0)),
        "closure": (0.12, S.weighted_score([(low("velocity_closure_rmse", 0.35, 8, 70.0), 0.55), (low("accel_closure_rmse", 0.5, 6, 70.0), 0.45)])),
        "smoothness": (0.18, S.weighted_score([(low("calm_p95", 0.012, 0.22, 60.0), 0.35), (low("snap_p95", 0.8, 12, 60.0), 0.25), (low("hf_jerk_ratio", 0.015, 0.40, 65.0), 0.25), (low("accel_variation_p95", 0.9, 7, 65.0), 0.15)])),
        "plausibility": (0.12, S.weighted_score([(low("accel_p95", 2.2, 9, 60.0), 0.35), (low("vertical_rate_p95", 12, 35, 70.0), 0.20), (low("turn_all_p95", 3.5, 15, 65.0), 0.25), (low("bank_all_p95", 35, 75, 70.0), 0.20)])),
        "detail": (0.10, S.weighted_score([(band("speed_detail", 0.45, 1.25, 0.08, 2.8), 0.35), (band("vertical_detail", 0.40, 1.35, 0.05, 3.0), 0.35), (low("hf_jerk_ratio", 0.02, 0.45, 65.0), 0.30)])),
        "joins": (0.06, S.weighted_score([(low("join_closure_p95", 4, 70, 85.0), 0.35), (low("join_velocity_p95", 1.5, 18, 85.0), 0.35), (low("join_accel_p95", 0.8, 10, 85.0), 0.30)])),
        "gaps": (0.03, low("gap_coverage", 0, 0.8, 100.0)), "locality": (0.01, locality_score(F.col("method"), F.col("n_segments"))),
    }
    m = metrics.withColumns({f"score_{k}": c for k, (_, c) in parts.items()})
    score = S.weighted_score([(F.col(f"score_{k}"), w) for k, (w, _) in parts.items()])
    return m.withColumns({"score": score, "loss": 100 - score, "grade": S.score_interpretation(score)})


def evaluate(samples: DataFrame, render: DataFrame, shapes: DataFrame | None = None, stage=lambda df, name: df) -> DataFrame:
    """All metrics of every (track, method) as one wide row. shapes: a table by track and method of E4 to E6, if wanted. stage(df, name):
    how the motion, which six tables read, is kept (a written table on a cluster).

    Metrics that a track cannot have are NULL; a track that has no sample keeps its row.
    """
    m = stage(motion(render), "motion")
    out = motion_metrics(m)
    segments = render.groupBy(*KEYS).agg(F.count_distinct("segment").alias("n_segments"))
    tables = (segments, spectrum_metrics(m), position_metrics(samples, render), velocity_metrics(samples, render), gap_behavior(samples, m), gap_honesty(samples, render), derivative_closure(m), difference_evidence(samples, render), join_metrics(samples, m))
    for t in (*tables, *([shapes] if shapes is not None else [])):
        out = out.join(t, KEYS, "left")
    return model_score(out)


def long_metrics(wide: DataFrame, names: list[str] | None = None) -> DataFrame:
    """track_id, method, metric, value of the known metrics of GROUPS, or of names."""
    wanted = [c for c in (names or [n for _, ns in GROUPS.values() for n in ns]) if c in wide.columns]
    typed = wide.select(*KEYS, *(F.col(c).cast("double").alias(c) for c in wanted))
    return typed.unpivot(KEYS, wanted, "metric", "value").where("value is not null")


def score_methods(metrics: DataFrame, keys: list[str], groups: dict = GROUPS) -> DataFrame:
    """metrics(keys, method, metric, value) -> group scores and the overall score of each method, least is best.

    A metric counts with two methods or more and a signal: not all about 0, and spread. A value is divided by the median of
    the positive absolute ones; a group is the mean of its metrics, the overall score the weighted mean of a method's groups.
    """
    spark = metrics.sparkSession
    table = F.broadcast(spark.createDataFrame([(n, g, w) for g, (w, ns) in groups.items() for n in ns], "metric string, metric_group string, weight double"))
    part = Window.partitionBy(*keys, "metric")
    m = metrics.join(table, "metric").withColumns({
        "_n": F.count("*").over(part), "_most": F.max(F.abs("value")).over(part), "_spread": F.max("value").over(part) - F.min("value").over(part),
        "_scale": F.percentile(F.when(F.abs("value") > 1e-12, F.abs("value")), 0.5).over(part),
    }).where("_n >= 2 and _most >= 1e-12 and _spread > 1e-9")
    g = m.groupBy(*keys, "method", "metric_group").agg(F.avg(F.col("value") / F.coalesce("_scale", F.lit(1.0))).alias("score"), F.count("*").alias("n_metrics"), F.max("weight").alias("weight"))
    whole = Window.partitionBy(*keys, "method")
    return g.withColumn("overall", F.sum(F.col("score") * F.col("weight")).over(whole) / F.sum("weight").over(whole))


def metric_winners(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Winner of each metric, its value, the second's and the margin; ties: the method's name."""
    w = Window.partitionBy(*keys, "metric").orderBy("value", "method")
    r = metrics.withColumns({"_r": F.row_number().over(w), "second": F.lead("value").over(w)})
    return r.where("_r = 1 and second is not null").select(*keys, "metric", F.col("method").alias("winner"), F.col("value").alias("best"), "second", (F.col("second") - F.col("value")).alias("margin"))


def rank(scores: DataFrame, keys: list[str], score: str, name: str = "method", descending: bool = False) -> DataFrame:
    """Place of each row by its score, least first or greatest first; ties: the name."""
    by = F.desc(score) if descending else F.asc(score)
    return scores.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(by, name)).cast("long"))


def dataset_weight(metric: Column | None, n_samples: Column, duration: Column) -> Column:
    """The chosen metric where it is positive, else the samples, else the duration, else 1."""
    positive = [F.when(c > 0, c.cast("double")) for c in (metric, n_samples, duration) if c is not None]
    return F.coalesce(*positive, F.lit(1.0))


def aggregate_dataset(metrics: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """metrics(keys, metric, value, weight) over flights: names *_count, violations_* and n_* are summed, names that end with _rmse or hold
    _rmse_ are a weighted RMS, the rest a weighted mean; only positive weights count."""
    x, w, name = F.col("value"), F.when(F.col(weight) > 0, F.col(weight)), F.col("metric")
    summed = name.endswith("_count") | name.startswith("violations_") | name.startswith("n_")
    g = metrics.groupBy(*keys, "metric").agg(
        F.sum("value").alias("_s"), (F.sum(w * x) / F.sum(w)).alias("_m"), F.sqrt(F.sum(w * x * x) / F.sum(w)).alias("_q"), F.count("*").alias("n_flights")
    )
    return g.select(*keys, "metric", "n_flights", F.when(summed, F.col("_s")).when(name.endswith("_rmse") | name.contains("_rmse_"), F.col("_q")).otherwise(F.col("_m")).alias("value"))


def common_texts(wide: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys and those text columns whose known values all agree within a key; NULL where they differ."""
    return wide.groupBy(*keys).agg(*(F.when(F.min(c) == F.max(c), F.min(c)).alias(c) for c in columns))


def weighted_metrics(wide: DataFrame, metric: str | None = None, names: list[str] | None = None) -> DataFrame:
    """A16 for A15: long_metrics() of evaluate() with the weight of each (track, method): the chosen metric, else compared rows, else 1."""
    w = dataset_weight(F.col(metric) if metric else None, F.col("n_compared"), F.lit(None).cast("double"))
    return long_metrics(wide, names).join(wide.select(*KEYS, w.alias("weight")), KEYS)


def selected_flights(table: DataFrame, wanted: list[str], keys: tuple[str, ...] = ("track_id", "icao")) -> DataFrame:
    """T5: rows whose track or address is wanted, in any case and without blanks at the ends; what nobody has is an error when read. The
    list is a parameter and small, so it is broadcast."""
    names = sorted({w.strip().upper() for w in wanted if w and w.strip()})
    asked = F.broadcast(table.sparkSession.createDataFrame([(n,) for n in names], "wanted string"))
    hit = reduce(lambda a, b: a | b, [F.upper(F.trim(k)) == F.col("wanted") for k in keys if k in table.columns])
    found = table.select(F.explode(F.array(*(F.upper(F.trim(k)) for k in keys if k in table.columns))).alias("has")).distinct()
    missing = asked.join(found, F.col("wanted") == F.col("has"), "left_anti").agg(F.array_join(F.array_sort(F.collect_list("wanted")), ", ").alias("_missing"))
    fine = F.when(F.col("_missing") == "", True).otherwise(F.raise_error(F.concat(F.lit("no flight "), F.col("_missing"))).cast("boolean"))
    return table.join(asked, hit, "left_semi").crossJoin(F.broadcast(missing)).where(fine).drop("_missing")


def method_coverage(metrics: DataFrame, flight: str = "track_id", weight: str | None = None) -> DataFrame:
    """Flights of each method, their share of all flights, their weight and ids."""
    per = metrics.groupBy("method", flight).agg((F.max(weight) if weight else F.lit(1.0)).alias("_w"))
    total = metrics.select(F.count_distinct(flight).alias("n_all"))
    g = per.groupBy("method").agg(F.count("*").alias("n_flights"), F.sum("_w").alias("weight"), F.array_sort(F.collect_set(flight)).alias("flights"))
    return g.crossJoin(F.broadcast(total)).withColumn("share", F.col("n_flights") / F.col("n_all"))


def require_all(metrics: DataFrame, name: str = "method", flight: str = "track_id") -> DataFrame:
    """rows of the methods that every flight has."""
    total = metrics.select(F.count_distinct(flight).alias("_all"))
    whole = metrics.groupBy(name).agg(F.count_distinct(flight).alias("_n")).join(F.broadcast(total), F.col("_n") == F.col("_all")).select(name)
    return metrics.join(whole, name, "left_semi")
