"""Keyed time series: as-of, interpolation, gradients, gaps and islands, robust statistics.

Every function takes the key columns and the time column by name and works on any table. One shuffle on the keys serves
all windows of a function; ties in time are broken by the caller's order columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def over(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by their keys over at least three tasks a core, before Python works on groups of them.

    Adaptive execution merges shuffle partitions by their bytes. Fits and filters cost far more a byte than native steps, so that whole jobs
    ended up in a task or two and their time did not fall with more cores; a number that is asked for is not merged.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), *keys)


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str, max_age: float | None = None, tie: str | None = None) -> DataFrame:
    """Left with the latest right value at or before its time, if not older than max_age; of equal times the least tie, or value.

    Union and a last-value window: one shuffle on the keys, no join, so no row count is multiplied.
    """
    first = right.groupBy(*keys, time).agg((F.min_by(value, tie) if tie else F.min(value)).alias("_v"))
    out_cols = left.columns
    r = first.select(*keys, F.col(time).alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(time).alias("t"), F.col("_v").alias("v")).alias("_r"))
    both = left.withColumns({"_t": F.col(time), "_side": F.lit(1)}).unionByName(r, allowMissingColumns=True)
    w = over(keys, ["_t", "_side"]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    age = F.col("_t") - F.col("_r.t")
    ok = age.isNotNull() if max_age is None else age <= max_age
    return found.select(*out_cols, F.when(ok, F.col("_r.v")).alias(f"asof_{value}"), F.when(ok, age).alias("age"))


def interpolate_at(series: DataFrame, queries: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Linear interpolation of the known points at the query times; NULL outside them."""
    s = series.where(F.col(value).isNotNull()).groupBy(*keys, time).agg(F.avg(value).alias("_v"))
    pts = s.select(*keys, F.col(time).alias("_t"), F.lit(0).alias("_q"), F.struct(F.col(time).alias("t"), F.col("_v").alias("v")).alias("_p"))
    out_cols = queries.columns
    both = queries.withColumns({"_t": F.col(time), "_q": F.lit(1)}).unionByName(pts, allowMissingColumns=True)
    before = over(keys, ["_t", "_q"]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy(*keys).orderBy(F.col("_t").desc(), "_q").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = both.withColumn("_a", F.last("_p", ignorenulls=True).over(before)).withColumn("_b", F.last("_p", ignorenulls=True).over(after)).where("_q = 1")
    t0, t1, v0, v1 = F.col("_a.t"), F.col("_b.t"), F.col("_a.v"), F.col("_b.v")
    y = F.when(t0.isNull() | t1.isNull(), None).when(t1 == t0, v0).otherwise(v0 + (v1 - v0) * (F.col("_t") - t0) / (t1 - t0))
    return b.select(*out_cols, y.alias(f"interp_{value}"))


def gradient(df: DataFrame, keys: list[str], time: str, value: str, out: str) -> DataFrame:
    """Second order on uneven steps, one-sided ends."""
    w = over(keys, [time])
    hs, hd = F.col(time) - F.lag(time).over(w), F.lead(time).over(w) - F.col(time)
    a, c = F.lag(value).over(w), F.lead(value).over(w)
    x = F.col(value)
    inner = (hs * hs * c + (hd * hd - hs * hs) * x - hd * hd * a) / (hs * hd * (hs + hd))
    return df.withColumn(out, F.coalesce(inner, (c - x) / hd, (x - a) / hs))


def sample_gradient(df: DataFrame, keys: list[str], time: str, value: str, out: str, floor: float = 1e-6) -> DataFrame:
    """Plain two-point differences."""
    w = over(keys, [time])
    a, c, ta, tc = F.lag(value).over(w), F.lead(value).over(w), F.lag(time).over(w), F.lead(time).over(w)
    x, t = F.col(value), F.col(time)
    step = lambda d: F.greatest(d, F.lit(floor))
    return df.withColumn(out, F.coalesce((c - a) / step(tc - ta), (c - x) / step(tc - t), (x - a) / step(t - ta)))


def rolling_median(df: DataFrame, keys: list[str], order: list[str], value: str, k: int, out: str) -> DataFrame:
    """Centred, cut short at the ends; k <= 1 is the identity."""
    if k <= 1:
        return df.withColumn(out, F.col(value))
    half = max(1, k // 2)
    return df.withColumn(out, F.percentile(value, 0.5).over(over(keys, order).rowsBetween(-half, half)))


def split_gaps(df: DataFrame, keys: list[str], time: str, absolute: float | None = 30.0, relative: float = 5.0) -> DataFrame:
    """Component number of each row; a gap is longer than max(absolute, relative * median positive step)."""
    w = over(keys, [time])
    stepped = df.withColumn("_dt", F.col(time) - F.lag(time).over(w))
    median = F.percentile(F.when(F.col("_dt") > 0, F.col("_dt")), 0.5).over(Window.partitionBy(*keys))
    limit = F.coalesce(relative * median, F.lit(0.0)) if absolute is None else F.greatest(F.lit(absolute), F.coalesce(relative * median, F.lit(0.0)))
    flagged = stepped.withColumn("_gap", F.when(F.col("_dt") > limit, 1).otherwise(0))
    return flagged.withColumn("component", F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_dt", "_gap")


def label_runs(df: DataFrame, keys: list[str], time: str, label: str) -> DataFrame:
    """Runs of equal labels: first and last index and time, duration, rows."""
    w = over(keys, [time])
    n = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_new", F.when(F.col(label).eqNullSafe(F.lag(label).over(w)), 0).otherwise(1))
    r = n.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return r.groupBy(*keys, "run").agg(
        F.first(label).alias("label"), F.min("_i").alias("first_index"), F.max("_i").alias("last_index"), F.min(time).alias("t0"), F.max(time).alias("t1"),
        (F.max(time) - F.min(time)).alias("duration"), F.count("*").alias("n"),
    )


def longest_run_above(df: DataFrame, keys: list[str], time: str, value: str, threshold: float) -> DataFrame:
    """First of the longest runs of strict exceedance."""
    runs = label_runs(df.withColumn("_above", F.col(value) > threshold), keys, time, "_above").where("label")
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "t0")
    return runs.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*keys, "t0", "t1", "n")


def chord_residual(df: DataFrame, keys: list[str], order: list[str], columns: list[str], half: int, out: str) -> DataFrame:
    """Distance to the chord between the rows `half` before and after, ends clamped."""
    w = over(keys, order)
    full = w.rowsBetween(-half, half)
    a = {c: F.first(c).over(full) for c in columns}
    b = {c: F.last(c).over(full) for c in columns}
    df = df.withColumns({f"_a{c}": a[c] for c in columns} | {f"_b{c}": b[c] for c in columns})
    d = {c: F.col(f"_b{c}") - F.col(f"_a{c}") for c in columns}
    e = {c: F.col(c) - F.col(f"_a{c}") for c in columns}
    dd, de, ee = (sum((p[c] * q[c] for c in columns[1:]), p[columns[0]] * q[columns[0]]) for p, q in ((d, d), (d, e), (e, e)))
    perpendicular = F.sqrt(F.greatest(ee - F.when(dd > 1e-12, de * de / dd).otherwise(0.0), F.lit(0.0)))
    return df.withColumn(out, perpendicular).drop(*[f"_a{c}" for c in columns], *[f"_b{c}" for c in columns])


def mad_scale(df: DataFrame, keys: list[str], value: str, floor: float = 1e-9) -> DataFrame:
    """A10: 1.4826 * MAD by key; the population deviation where that is degenerate, 0 where both are."""
    med = df.withColumn("_m", F.percentile(value, 0.5).over(Window.partitionBy(*keys)))
    out = med.groupBy(*keys).agg(F.first("_m").alias("median"), F.percentile(F.abs(F.col(value) - F.col("_m")), 0.5).alias("_mad"), F.stddev_pop(value).alias("_sd"))
    scale = F.when(1.4826 * F.col("_mad") > floor, 1.4826 * F.col("_mad")).when(F.col("_sd") > floor, F.col("_sd")).otherwise(0.0)
    return out.select(*keys, "median", scale.alias("scale"))


def weighted_quantile(df: DataFrame, keys: list[str], value: str, weight: str, q: float) -> DataFrame:
    """Least value whose cumulative share of the positive weights reaches q."""
    pos = df.where(F.col(weight) > 0).groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    part = Window.partitionBy(*keys)
    cum = pos.withColumn("_c", F.sum("_w").over(part.orderBy(value))).withColumn("_t", F.sum("_w").over(part))
    return cum.where(F.col("_c") >= q * F.col("_t")).groupBy(*keys).agg(F.min(value).alias(f"wq_{value}"))


def dominant_label(df: DataFrame, keys: list[str], label: str, empty: str = "energy_unknown") -> DataFrame:
    """Most frequent label and its share; ties: the least."""
    n = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("_n"))
    got = n.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("c"), F.col(label).alias("l"))).alias("_b"), F.sum("_n").alias("_t"))
    return df.select(*keys).distinct().join(got, keys, "left").select(*keys, F.coalesce("_b.l", F.lit(empty)).alias("label"), F.coalesce(-F.col("_b.c") / F.col("_t"), F.lit(0.0)).alias("share"))


def resample(df: DataFrame, keys: list[str], time: str, step: float) -> DataFrame:
    """t0 + i * step from first to last time; the last time is added where the grid misses it."""
    ends = df.groupBy(*keys).agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    n = F.floor((F.col("_b") - F.col("_a")) / step + 1e-9).cast("int")
    grid = F.transform(F.sequence(F.lit(0), n), lambda i: F.col("_a") + i * step)
    full = F.when(F.col("_a") + n * step < F.col("_b") - 1e-9, F.concat(grid, F.array("_b"))).otherwise(grid)
    return ends.select(*keys, F.explode(full).alias(time))


def linear_fill(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """NULLs by row position between known rows, both ends extended."""
    w = over(keys, order)
    i = df.withColumn("_i", F.row_number().over(w))
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(value).alias("v")))
    back = Window.partitionBy(*keys).orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)  # a growing frame, so each row is seen once
    i = i.withColumn("_a", F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.last(known, ignorenulls=True).over(back))
    a, b = F.col("_a"), F.col("_b")
    y = F.when(a.isNull(), b["v"]).when(b.isNull() | (a["i"] == b["i"]), a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * (F.col("_i") - a["i"]) / (b["i"] - a["i"]))
    return i.withColumn(out, y).drop("_i", "_a", "_b")


def downsample(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Rows at n evenly spread positions, rounded half to even; all rows where there are no more."""
    part = Window.partitionBy(*keys)
    i = df.withColumn("_i", F.row_number().over(part.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(part))
    j = F.rint(F.col("_i") * (n - 1) / (F.col("_n") - 1))
    hit = F.rint(j * (F.col("_n") - 1) / (n - 1)) == F.col("_i")
    return i.where((F.col("_n") <= n) | hit).drop("_i", "_n")


def rms(c: Column) -> Column:
    """A7."""
    return F.sqrt(F.avg(c * c))


def ratio(top: Column, low: Column) -> Column:
    """NULL on a zero or unknown denominator."""
    return top / F.nullif(low, F.lit(0.0))


def finite_stats(value: Column, name: str) -> list[Column]:
    """Rms, median, p95, least and largest of the finite values of a group; NULL where there are none."""
    x = F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)
    return [rms(x).alias(f"{name}_rms"), F.percentile(x, 0.5).alias(f"{name}_median"), F.percentile(x, 0.95).alias(f"{name}_p95"), F.min(x).alias(f"{name}_min"), F.max(x).alias(f"{name}_max")]


def weighted_stats(value: str, weight: str) -> list[Column]:
    """Mean and root mean square by positive weights."""
    w = F.when((F.col(weight) > 0) & F.col(value).isNotNull(), F.col(weight))
    return [(F.sum(w * F.col(value)) / F.sum(w)).alias("mean"), F.sqrt(F.sum(w * F.col(value) * F.col(value)) / F.sum(w)).alias("rms")]


def interval_to_sample(df: DataFrame, keys: list[str], time: str, value: str, out: str) -> DataFrame:
    """Values of the steps to the next row as values of rows: ends copied, inside the mean of both sides."""
    w = over(keys, [time])
    return df.withColumn(out, F.coalesce((F.lag(value).over(w) + F.col(value)) / 2, F.col(value), F.lag(value).over(w)))


def neighbour_step(df: DataFrame, keys: list[str], time: str, columns: list[str], out: str) -> DataFrame:
    """Distance to the nearer of the previous and the next row; NULL for a key's only row."""
    w = over(keys, [time])
    away = lambda f: F.sqrt(sum(((F.col(c) - f(c).over(w)) * (F.col(c) - f(c).over(w)) for c in columns), F.lit(0.0)))
    return df.withColumn(out, F.least(away(F.lag), away(F.lead)))


def direction_changes(df: DataFrame, keys: list[str], time: str, columns: list[str], cosine: float = -0.25) -> DataFrame:
    """How often, and how often a minute, neighbouring vectors point apart: cosine below the limit."""
    w = over(keys, [time])
    dot = sum((F.col(c) * F.lag(c).over(w) for c in columns), F.lit(0.0))
    size = F.sqrt(sum((F.col(c) ** 2 for c in columns), F.lit(0.0)))
    d = df.withColumn("_l", size).withColumns({"_d": dot, "_p": F.lag(size).over(w)})
    turned = (F.col("_l") * F.col("_p") > 1e-12) & (F.col("_d") / (F.col("_l") * F.col("_p")) < cosine)
    g = d.groupBy(*keys).agg(F.count_if(turned).alias("n_changes"), ((F.max(time) - F.min(time)) / 60).alias("_m"))
    return g.withColumn("changes_per_minute", ratio(F.col("n_changes"), F.col("_m"))).drop("_m")


def in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], time: str, bucket: float, tolerance: float = 1e-6) -> DataFrame:
    """Points with the number `nth` of the last interval (keys, nth, a, b) that holds them, both ends included, a later one first; NULL
    outside. Intervals are dealt to time buckets, so a long key meets only those that are near."""
    lo, hi = F.floor((F.col("a") - tolerance) / bucket), F.floor((F.col("b") + tolerance) / bucket)
    s = intervals.select(*(F.col(k).alias(f"_k_{k}") for k in keys), "nth", (F.col("a") - tolerance).alias("_lo"), (F.col("b") + tolerance).alias("_hi"), F.explode(F.sequence(lo, hi)).alias("_bucket"))
    p = points.withColumns({"_rid": F.monotonically_increasing_id(), "_b": F.floor(F.col(time) / bucket)})
    on = F.col("_b") == F.col("_bucket")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    j = p.join(s, on & F.col(time).between(F.col("_lo"), F.col("_hi")), "left")
    best = Window.partitionBy("_rid").orderBy(F.desc_nulls_last("nth"))
    return j.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(*points.columns, "nth")


def overlapping_intervals(left: DataFrame, right: DataFrame, keys: list[str], bucket: float, how: str = "left_semi") -> DataFrame:
    """Intervals (keys, a, b) of left that some of right overlaps (hi > a and lo < b), or with left_anti that none does; dealt to time buckets.

    Intervals are found again by their own values: an id of rows would be made anew on each side of the join, and other partitions give other ids.
    """
    deal = lambda df: df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("a") / bucket), F.floor(F.col("b") / bucket))))
    own = [*keys, "a", "b"]
    r = deal(right.select(*own)).select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("_bucket").alias("_k"))
    on = (F.col("_bucket") == F.col("_k")) & (F.col("b") > F.col("_a")) & (F.col("a") < F.col("_b"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    met = deal(left.select(*own)).join(r, on, "left_semi").select(*own).distinct()
    return left.join(met, own, how).select(*left.columns)
