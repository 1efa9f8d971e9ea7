"""Fits, sinks and the rest of the inventory's queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackspark.operators import segmentation, splines
from trackspark.operators import timeseries as T
from trackspark.plans.more_queries import _RUNS, labelled
from trackspark.plans.series_queries import TICKS, ticks
from trackspark.plans.track_queries import _FEATURES_SQL, EVENTS_SQL, SAMPLES_SQL, events, messages, rnd, rounded, samples
from trackspark.sources import files

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def components(spark, d):
    return T.split_gaps(samples(spark, d), ["track_id"], "t").withColumn("component", F.col("component").cast("int"))


@query("k1_smooth_cv")
def k1(spark, d):
    return splines.smooth_cv(components(spark, d))


@query("k4_fit_bsplines")
def k4(spark, d):
    return splines.fit_bsplines(components(spark, d), ("accurate", "balanced", "smooth"))


@query("k8_boundary_states")
def k8(spark, d):
    return splines.boundary_states(samples(spark, d), segmentation.transition_candidates(labelled(spark, d)).select("track_id", "sample_index"))


@query("k6_evaluate_hermite", SAMPLES_SQL + """, od as (select track_id, t, x, vx from s where i % 2 = 0), q as (select track_id, t from s where i % 2 = 1
), br as (select q.track_id, q.t, (select max_by(struct_pack(t := o.t, x := o.x, v := o.vx), o.t) from od o where o.track_id = q.track_id and o.t <= q.t) as a,
         (select min_by(struct_pack(t := o.t, x := o.x, v := o.vx), o.t) from od o where o.track_id = q.track_id and o.t >= q.t) as b from q
), u as (select *, b.t - a.t as h, (t - a.t) / (b.t - a.t) as u from br)
select track_id, t, """ + rnd("case when a is null then b.x + b.v * (t - b.t) when b is null then a.x + a.v * (t - a.t) else (2 * u * u * u - 3 * u * u + 1) * a.x + (u * u * u - 2 * u * u + u) * h * a.v + (-2 * u * u * u + 3 * u * u) * b.x + (u * u * u - u * u) * h * b.v end", 3) + " as x from u")
def k6(spark, d):
    s = samples(spark, d)
    return splines.evaluate_hermite(s.where("i % 2 = 0"), s.where("i % 2 = 1"), ["track_id"]).select("track_id", "t", rounded("x", 3).alias("x"))


@query("k18_holdout_split", SAMPLES_SQL + " select track_id, i, i % 7 = 3 as held_out from s")
def k18(spark, d):
    return samples(spark, d).select("track_id", "i", (F.col("i") % 7 == 3).alias("held_out"))


@query("m19_interval_weight", SAMPLES_SQL + """, sp as (select *, sqrt(vx * vx + vy * vy + vz * vz) as sd from s), iw as (select track_id, t, t - lag(t) over w as dt, (sd + lag(sd) over w) / 2 as mean from sp window w as (partition by track_id order by t))
select track_id, t, """ + rnd("1e5 * dt / greatest(mean * mean, 1e0)", 4) + " as interval_weight from iw")
def m19(spark, d):
    return splines.adaptive_interval_weight(samples(spark, d), ["track_id"], 1e5).select("track_id", "t", rounded("interval_weight", 4).alias("interval_weight"))


@query("m2_adaptive_deadbands", _FEATURES_SQL + """, me as (select track_id, quantile_cont(vz_s, 0.5) as med from h group by 1), ma as (select h.track_id, quantile_cont(abs(vz_s - med), 0.5) as mad from h join me using (track_id) group by 1)
select track_id, """ + rnd("greatest(1e0, 1e0 + 0.2e0 * 1.4826e0 * mad)") + " as vertical_deadband from ma")
def m2(spark, d):
    s = T.mad_scale(labelled(spark, d), ["track_id"], "vz_smooth", floor=-1.0)
    return s.select("track_id", rounded(F.greatest(F.lit(1.0), 1.0 + 0.2 * F.col("scale"))).alias("vertical_deadband"))


@query("m3_rough_air_score", _FEATURES_SQL + " select track_id, t, " + rnd("sqrt(pow(0.6e0 * least(mismatch, 500) / 50, 2) + pow(0.4e0 * vz_s / 5, 2))", 4) + " as rough from h")
def m3(spark, d):
    m = F.least(F.col("mismatch"), F.lit(500.0))
    return labelled(spark, d).select("track_id", "t", rounded(F.sqrt(F.pow(0.6 * m / 50, 2) + F.pow(0.4 * F.col("vz_smooth") / 5, 2)), 4).alias("rough"))


@query("m9_go_arounds", _RUNS + """, go as (select a.track_id, a.t0 as descent_at, b.t0 as climb_at from ru a join ru b on a.track_id = b.track_id and b.run > a.run and b.run <= a.run + 3 where a.label = 'descent' and b.label = 'climb' and a.n >= 4 and b.n >= 4)
select track_id, descent_at, min(climb_at) as climb_at from go group by 1, 2""")
def m9(spark, d):
    r = T.label_runs(labelled(spark, d), ["track_id"], "t", "label").where("n >= 4")
    a = r.where("label = 'descent'").select("track_id", "run", F.col("t0").alias("descent_at"))
    b = r.where("label = 'climb'").select(F.col("track_id").alias("b_track"), F.col("run").alias("b_run"), F.col("t0").alias("b_t0"))
    return a.join(b, (F.col("track_id") == F.col("b_track")) & (F.col("b_run") > F.col("run")) & (F.col("b_run") <= F.col("run") + 3)).groupBy("track_id", "descent_at").agg(F.min("b_t0").alias("climb_at"))


@query("w7_interval_to_sample", TICKS + ", iv as (select user_id, t, lead(v) over w - v as d from tk window w as (partition by user_id order by t)) select user_id, t, " + rnd("coalesce((lag(d) over w + d) / 2, d, lag(d) over w)", 5) + " as d from iv window w as (partition by user_id order by t)")
def w7(spark, d):
    w = Window.partitionBy("user_id").orderBy("t")
    iv = ticks(spark, d).withColumn("d", F.lead("v").over(w) - F.col("v"))
    return iv.select("user_id", "t", rounded(F.coalesce((F.lag("d").over(w) + F.col("d")) / 2, F.col("d"), F.lag("d").over(w)), 5).alias("d"))


@query("w12_hard_gaps", TICKS + """, g as (select user_id, t, lead(t) over (partition by user_id order by t) - t as dt from tk), m as (select user_id, greatest(10e0, 5 * quantile_cont(dt, 0.5)) as lim from g where dt > 0 group by 1)
select g.user_id, g.t, round(g.dt, 6) as gap from g join m using (user_id) where g.dt > lim""")
def w12(spark, d):
    w = Window.partitionBy("user_id").orderBy("t")
    g = ticks(spark, d).withColumn("gap", F.lead("t").over(w) - F.col("t"))
    limit = F.greatest(F.lit(10.0), 5 * F.percentile(F.when(F.col("gap") > 0, F.col("gap")), 0.5).over(Window.partitionBy("user_id")))
    return g.withColumn("l", limit).where("gap > l").select("user_id", "t", F.round("gap", 6).alias("gap"))


@query("w18_row_ids", EVENTS_SQL + " select raw_id, 'evt_' || lpad(cast(row_number() over (partition by track_id order by ts_utc, raw_id) as varchar), 6, '0') as event_name from e")
def w18(spark, d):
    w = Window.partitionBy("track_id").orderBy("ts_utc", "raw_id")
    return events(spark, d).select("raw_id", F.format_string("evt_%06d", F.row_number().over(w)).alias("event_name"))


@query("w23_direction_changes", SAMPLES_SQL + """, ac as (select track_id, t, vx - lag(vx) over w as ax, vy - lag(vy) over w as ay from s window w as (partition by track_id order by t)
), cs as (select track_id, t, ax * lag(ax) over w + ay * lag(ay) over w as dt, sqrt(ax * ax + ay * ay) * sqrt(pow(lag(ax) over w, 2) + pow(lag(ay) over w, 2)) as nn from ac window w as (partition by track_id order by t))
select track_id, count(*) filter (nn > 1e-9 and dt / nn < -0.25 - 1e-9) as n from cs group by 1""")
def w23(spark, d):
    w = Window.partitionBy("track_id").orderBy("t")
    a = samples(spark, d).withColumns({"ax": F.col("vx") - F.lag("vx").over(w), "ay": F.col("vy") - F.lag("vy").over(w)})
    c = a.withColumns({"dot": F.col("ax") * F.lag("ax").over(w) + F.col("ay") * F.lag("ay").over(w), "nn": F.sqrt(F.col("ax") ** 2 + F.col("ay") ** 2) * F.sqrt(F.lag("ax").over(w) ** 2 + F.lag("ay").over(w) ** 2)})
    return c.groupBy("track_id").agg(F.count_if((F.col("nn") > 1e-9) & (F.col("dot") / F.col("nn") < -0.25 - 1e-9)).alias("n"))


@query("j8_semi_join", "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_nationkey = 3)")
def j8(spark, d):
    o, c = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "customer"))
    return o.join(c.where("c_nationkey = 3"), o.o_custkey == c.c_custkey, "left_semi").select("o_orderkey")


@query("j10_neighbour_join", _RUNS + "select track_id, run, label, lead(label) over (partition by track_id order by run) as next_label from (select track_id, cast(run as bigint) as run, label from ru)")
def j10(spark, d):
    r = T.label_runs(labelled(spark, d), ["track_id"], "t", "label")
    return r.select("track_id", F.col("run").cast("long").alias("run"), "label", F.lead("label").over(Window.partitionBy("track_id").orderBy("run")).alias("next_label"))


@query("a6_position_error", SAMPLES_SQL + """, er as (select track_id, x - lag(x) over w - vx * (t - lag(t) over w) as ex, y - lag(y) over w - vy * (t - lag(t) over w) as ey from s window w as (partition by track_id order by t))
select track_id, """ + rnd("sqrt(avg(ex * ex + ey * ey))", 3) + " as rmse, " + rnd("quantile_cont(sqrt(ex * ex + ey * ey), 0.5)", 3) + " as median, " + rnd("max(sqrt(ex * ex + ey * ey))", 3) + " as most from er group by 1")
def a6(spark, d):
    w = Window.partitionBy("track_id").orderBy("t")
    dt = F.col("t") - F.lag("t").over(w)
    e = samples(spark, d).withColumns({"ex": F.col("x") - F.lag("x").over(w) - F.col("vx") * dt, "ey": F.col("y") - F.lag("y").over(w) - F.col("vy") * dt})
    n = F.sqrt(F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey"))
    return e.groupBy("track_id").agg(rounded(T.rms(n), 3).alias("rmse"), rounded(F.percentile(n, 0.5), 3).alias("median"), rounded(F.max(n), 3).alias("most"))


@query("a17_method_coverage", "select event_type, count(distinct user_id) as n_users, round(count(distinct user_id) / (select count(distinct user_id) from events), 6) as share from events group by 1")
def a17(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    total = e.select(F.count_distinct("user_id").alias("total"))
    return e.groupBy("event_type").agg(F.count_distinct("user_id").alias("n_users")).crossJoin(F.broadcast(total)).select("event_type", "n_users", F.round(F.col("n_users") / F.col("total"), 6).alias("share"))


@query("a23_approximate_quantiles")
def a23(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_suppkey").agg(F.percentile_approx("l_extendedprice", 0.5, 1000).alias("median"), F.approx_count_distinct("l_partkey").alias("n_parts"))


@query("e11_endpoint_artifacts", SAMPLES_SQL + """, en as (select *, min(t) over (partition by track_id) as ta, max(t) over (partition by track_id) as tb from s)
select track_id, """ + rnd("sqrt(avg(vz * vz) filter (t <= ta + 60 or t >= tb - 60)) / sqrt(avg(vz * vz) filter (t > ta + 60 and t < tb - 60))", 5) + " as ratio from en group by 1")
def e11(spark, d):
    p = Window.partitionBy("track_id")
    s = samples(spark, d).withColumns({"ta": F.min("t").over(p), "tb": F.max("t").over(p)})
    end = (F.col("t") <= F.col("ta") + 60) | (F.col("t") >= F.col("tb") - 60)
    return s.groupBy("track_id").agg(rounded(T.rms(F.when(end, F.col("vz"))) / T.rms(F.when(~end, F.col("vz"))), 5).alias("ratio"))


@query("e16_derivative_closure", _FEATURES_SQL + " select track_id, " + rnd("sqrt(avg(mismatch * mismatch))", 3) + " as closure_rmse, " + rnd("quantile_cont(mismatch, 0.95)", 3) + " as closure_p95 from h group by 1")
def e16(spark, d):
    return labelled(spark, d).groupBy("track_id").agg(rounded(T.rms(F.col("mismatch")), 3).alias("closure_rmse"), rounded(F.percentile("mismatch", 0.95), 3).alias("closure_p95"))


@query("io9_minimal_view", _RUNS + "select rr.track_id, cast(rr.run as bigint) as segment, count(*) as n_frames, min(rr.t) as t0, max(rr.t) as t1 from rr group by 1, 2")
def io9(spark, d):
    f = labelled(spark, d)
    w = Window.partitionBy("track_id").orderBy("t")
    seg = f.withColumn("_n", F.when(F.col("label").eqNullSafe(F.lag("label").over(w)), 0).otherwise(1)).withColumn("segment", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return files.minimal_view(seg).withColumn("segment", F.col("segment").cast("long"))


@query("io12_geojson")
def io12(spark, d):
    return files.to_geojson(messages(spark, d).select("track_id", F.col("ts_utc").alias("t"), "lat", "lon", (F.col("alt") * 0.3048).alias("alt_m")))
