"""Queries of quality, incremental decoding and joins on streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackspark.functions import scalars as S
from trackspark.operators import evaluation, quality, smoothing
from trackspark.operators import timeseries as T
from trackspark.plans.more_queries import _RUNS, _grad, labelled
from trackspark.plans.series_queries import TICKS, ticks
from trackspark.plans.track_queries import _FEATURES_SQL, MESSAGES_SQL, SAMPLES_SQL, messages, rnd, rounded, samples
from trackspark.streaming import streams

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query("f10_position_rows", MESSAGES_SQL + """ select raw_id from (select raw_id, row_number() over (partition by upper(icao), ts_utc, lat, lon, alt order by raw_id) as r from m where lat between -90 and 90 and lon between -180 and 180) where r = 1""")
def f10(spark, d):
    w = Window.partitionBy(F.upper("icao"), "ts_utc", "lat", "lon", "alt").orderBy("raw_id")
    return messages(spark, d).where("lat between -90 and 90 and lon between -180 and 180").withColumn("r", F.row_number().over(w)).where("r = 1").select("raw_id")


@query("f12_motion_outliers", SAMPLES_SQL + """, v as (select *, sqrt(vx * vx + vy * vy + vz * vz) as sp from s
), bd as (select track_id, t, sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2) + pow(z - lag(z) over w, 2)) / (t - lag(t) over w) > greatest(1200e0, 5 * greatest((sp + lag(sp) over w) / 2, 1e0)) as bad from v window w as (partition by track_id order by t)
), nx as (select *, lead(bad) over w as nxt, lead(bad, 2) over w as aft, lag(bad) over w as bef from bd window w as (partition by track_id order by t))
select track_id, t from nx where coalesce(bad and nxt, false) or (bad is null and coalesce(nxt and not coalesce(aft, false), false)) or (nxt is null and coalesce(bad and not coalesce(bef, false), false))""")
def f12(spark, d):
    return quality.motion_outliers(samples(spark, d)).where("outlier").select("track_id", "t")


@query("f13_repeated_times", MESSAGES_SQL + " select track_id, round_even(ts_utc, 0) as t, count(*) as n from m group by 1, 2 having count(*) > 1")
def f13(spark, d):
    """Seconds in which a track has more than one message: what unique_times() would refuse before keyframes are built."""
    m = messages(spark, d).select("track_id", S.bucket_time(F.col("ts_utc"), 1.0).alias("t"))
    return m.groupBy("track_id", "t").agg(F.count("*").alias("n")).where("n > 1")


@query("f14_min_support", "select user_id, count(*) as n from events group by 1 having count(*) >= 65")
def f14(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 65")


@query("f15_require_all", "select event_type from events group by 1 having count(distinct user_id) = (select count(distinct user_id) from events)")
def f15(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    total = e.select(F.count_distinct("user_id").alias("total"))
    return e.groupBy("event_type").agg(F.count_distinct("user_id").alias("n")).join(F.broadcast(total), F.col("n") == F.col("total")).select("event_type")


@query("a11_robust_standardize", TICKS + """, me as (select user_id, quantile_cont(v, 0.5) as med, stddev_pop(v) as sd from tk group by 1), ma as (select user_id, any_value(med) as med, any_value(sd) as sd, 1.4826e0 * quantile_cont(abs(v - med), 0.5) as mad from tk join me using (user_id) group by 1)
select tk.user_id, t, """ + rnd("coalesce(greatest(-50e0, least(50e0, (v - med) / case when mad > 1e-6 then mad when sd > 1e-6 then sd else 1e0 end)), 0e0)", 5) + " as v_z from tk join ma using (user_id)")
def a11(spark, d):
    return quality.robust_standardize(ticks(spark, d), ["user_id"], ["v"]).select("user_id", "t", rounded("v_z", 5).alias("v_z"))


@query("a16_dataset_weight", "select user_id, " + rnd("coalesce(nullif(greatest(sum(value) - 5000, 0), 0), nullif(cast(count(*) as double), 0), 1e0)", 3) + " as weight from events group by 1")
def a16(spark, d):
    g = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.sum("value").alias("m"), F.count("*").cast("double").alias("n"))
    return g.select("user_id", rounded(F.coalesce(F.nullif(F.greatest(F.col("m") - 5000, F.lit(0.0)), F.lit(0.0)), F.nullif("n", F.lit(0.0)), F.lit(1.0)), 3).alias("weight"))


_HEAD = SAMPLES_SQL + """, he as (select track_id, t, degrees(atan2(vx, vy)) as hd from s
), dl as (select *, hd - lag(hd) over w + 180 as raw, t - lag(t) over w as dt from he window w as (partition by track_id order by t)
), dw as (select *, (raw - 360e0 * floor(raw / 360e0) - 180) / dt as rate from dl)"""


@query("m5_turn_labels", _HEAD + """ select track_id, case when rate is null or abs(rate) < 0.75 then 'straight' else 'turn_' || case when rate > 0 then 'right' else 'left' end || '_' || case when abs(rate) >= 7 then 'rapid' when abs(rate) >= 3 then 'medium' else 'slow' end end as turn, count(*) as n from dw group by 1, 2""")
def m5(spark, d):
    return quality.turn_labels(evaluation.unwrapped_heading(samples(spark, d))).groupBy("track_id", "turn").agg(F.count("*").alias("n"))


@query("w17_cumulative_turn", _HEAD + """, tr as (select track_id, t, coalesce(rate, 0) * coalesce(dt, 0) as turned from dw)
select track_id, t, """ + rnd("sum(turned) over (partition by track_id order by t range between 20 preceding and 20 following)", 4) + " as turned from tr")
def w17(spark, d):
    w = Window.partitionBy("track_id").orderBy("t")
    h = evaluation.unwrapped_heading(samples(spark, d)).withColumn("turn", F.coalesce(F.col("rate"), F.lit(0.0)) * F.coalesce(F.col("t") - F.lag("t").over(w), F.lit(0.0)))
    around = Window.partitionBy("track_id").orderBy("t").rangeBetween(-20, 20)
    return h.select("track_id", "t", rounded(F.sum("turn").over(around), 4).alias("turned"))


@query("m18_huber_weight", _FEATURES_SQL + " select track_id, t, " + rnd("case when mismatch <= 50 then 1e0 when mismatch > 150 then 0e0 else 50 / mismatch end", 5) + " as weight from h")
def m18(spark, d):
    return quality.huber_weight(labelled(spark, d)).select("track_id", "t", rounded("weight", 5).alias("weight"))


@query("e9_high_frequency_share")
def e9(spark, d):
    return quality.high_frequency_share(samples(spark, d), "vz", 0.1)


@query("e6_frechet")
def e6(spark, d):
    s = samples(spark, d)
    r = smoothing.smooth_ca(s).where("error is null")
    return quality.frechet(s.select("track_id", F.lit(0).alias("which"), "t", "x", "y", "z").unionByName(r.select("track_id", F.lit(1).alias("which"), "t", "x", "y", "z")))


@query("e14_model_score", SAMPLES_SQL + f""", ac as (select track_id, sqrt(pow({_grad("vx")}, 2) + pow({_grad("vy")}, 2) + pow({_grad("vz")}, 2)) as a from s window w as (partition by track_id order by t)
), ag as (select track_id, sqrt(avg(a * a)) as accel_rms from ac group by 1
), p as (select *, greatest(0e0, least(100e0, 100 * (1 - (accel_rms - 2.2e0) / (9e0 - 2.2e0)))) as a from ag
), q as (select track_id, (0.35e0 * a + 0.25e0 * 65e0) / 0.6e0 as score from p)
select track_id, """ + rnd("score", 4) + " as score, " + rnd("100 - score", 4) + " as loss, case when score >= 85 then 'excellent' when score >= 70 then 'good' when score >= 50 then 'fair' else 'poor' end as grade from q")
def e14(spark, d):
    m = evaluation.smoothness(samples(spark, d)).select("track_id", F.col("rms").alias("accel_rms"), F.lit(None).cast("double").alias("turn_p95"), F.lit(None).cast("double").alias("ratio"))
    return quality.model_score(m).select("track_id", rounded("score", 4).alias("score"), rounded("loss", 4).alias("loss"), "grade")


@query("e19_gap_honesty", SAMPLES_SQL + """, gp as (select track_id, t as a, lead(t) over (partition by track_id order by t) as b from s), hg as (select * from gp where b - a > 30), al as (select distinct track_id, ts_utc as t from m where lat is not null)
select hg.track_id, a, b, count(distinct al.t) as n_inside from hg left join al on al.track_id = hg.track_id and al.t > a and al.t < b group by 1, 2, 3""")
def e19(spark, d):
    w = Window.partitionBy("track_id").orderBy("t")
    gaps = samples(spark, d).select("track_id", F.col("t").alias("a"), F.lead("t").over(w).alias("b")).where("b - a > 30")
    return quality.gap_honesty(messages(spark, d).where("lat is not null").select("track_id", F.col("ts_utc").alias("t")).distinct(), gaps)


@query("k20_verify_continuity", _RUNS + """, en as (select rr.track_id, rr.run, min_by(s.x, s.t) as first_x, max_by(s.x, s.t) as last_x, min_by(s.vx, s.t) as first_vx, max_by(s.vx, s.t) as last_vx from rr join s on s.track_id = rr.track_id and s.t = rr.t group by 1, 2
), jp as (select track_id, cast(run as bigint) as segment, abs(lead(first_x) over w - last_x) as jx, abs(lead(first_vx) over w - last_vx) as jv from en window w as (partition by track_id order by run))
select track_id, segment, """ + rnd("jx", 3) + " as jump_x, " + rnd("jv", 5) + " as jump_vx from jp where jx is not null")
def k20(spark, d):
    f = labelled(spark, d)
    w = Window.partitionBy("track_id").orderBy("t")
    seg = f.withColumn("_n", F.when(F.col("label").eqNullSafe(F.lag("label").over(w)), 0).otherwise(1)).withColumn("segment", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = seg.groupBy("track_id", F.col("segment").cast("long").alias("segment")).agg(*(g(c, "t").alias(f"{n}_{c}") for c in ("x", "vx") for g, n in ((F.min_by, "first"), (F.max_by, "last"))))
    return quality.verify_continuity(ends).select("track_id", "segment", rounded("jump_x", 3).alias("jump_x"), rounded("jump_vx", 5).alias("jump_vx"))


@query("d6_decoded_json", MESSAGES_SQL + " select raw_id, cast(json_extract_string(decoded_json, '$.velocity_raw[0]') as int) as gs from m where gs is not null")
def d6(spark, d):
    m = messages(spark, d).where("gs is not null").select("raw_id", F.to_json(F.struct(F.from_json(F.get_json_object("decoded_json", "$.velocity_raw"), "array<string>").alias("velocity_raw"))).alias("j"))
    return m.select("raw_id", F.get_json_object("j", "$.velocity_raw[0]").cast("int").alias("gs"))


@query("s2_malformed_rows", "select count(*) as n_good, (select count(*) from events where value <= 1 or value is null) as n_bad from events where value > 1")
def s2(spark, d):
    """Valid and malformed rows of a stream part into a count of each."""
    t = streams.run_to_table(streams.events_stream(spark, d))
    ok = F.coalesce(F.col("value") > 1, F.lit(False))
    return t.agg(F.count_if(ok).alias("n_good"), F.count_if(~ok).alias("n_bad"))


@query("s10_live_rule_join", """with r as (select user_id, min(ts) as a, max(ts) as b from events where event_type = 'purchase' group by 1)
select event_id, user_id as rule from events join r using (user_id) where ts between a and b""")
def s10(spark, d):
    """The whole stream joins a static table of rules, one a user: its window is from the first purchase to the last."""
    bought = spark.read.parquet(f"{d}/events.parquet").where("event_type = 'purchase'")
    rules = bought.groupBy(F.col("user_id").alias("rule")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return streams.run_to_table(streams.events_stream(spark, d).join(rules, F.expr("user_id = rule and ts between a and b")).select("event_id", "rule"))


@query("s11_stream_stream_join", """select a.event_id, b.event_id as other_id from events a join events b on a.user_id = b.user_id and b.ts between a.ts and a.ts + interval '1 hour' where a.event_type = 'error' and b.event_type = 'purchase'""")
def s11(spark, d):
    """Both sides have watermarks and a bound between their times, so state stays bounded."""
    a = streams.events_stream(spark, d).where("event_type = 'error'").select("event_id", F.col("user_id").alias("u"), F.col("ts").alias("t")).withWatermark("t", "2 hours")
    b = streams.events_stream(spark, d).where("event_type = 'purchase'").select(F.col("event_id").alias("other_id"), "user_id", "ts").withWatermark("ts", "2 hours")
    j = a.join(b, F.expr("u = user_id and ts between t and t + interval 1 hour"))
    return streams.run_to_table(j.select("event_id", "other_id"))


@query("w3_two_pass_medians", TICKS + ", md as (select user_id, quantile_cont(v, 0.5) as med from tk group by 1), ft as (select tk.* from tk join md using (user_id) where v <= med * 3) select user_id, " + rnd("quantile_cont(v, 0.5)", 7) + " as median_after, count(*) as n from ft group by 1")
def w3(spark, d):
    k = ticks(spark, d).withColumn("med", F.percentile("v", 0.5).over(Window.partitionBy("user_id"))).where("v <= med * 3")
    return k.groupBy("user_id").agg(rounded(F.percentile("v", 0.5), 7).alias("median_after"), F.count("*").alias("n"))


@query("e20_detail_ratio", SAMPLES_SQL + """, ds as (select track_id, abs(vz - lag(vz) over w) as a, abs(z - lag(z) over w) / (t - lag(t) over w) as b from s window w as (partition by track_id order by t))
select track_id, """ + rnd("avg(a) / nullif(avg(b), 0)", 5) + " as ratio from ds group by 1")
def e20(spark, d):
    w = Window.partitionBy("track_id").orderBy("t")
    s = samples(spark, d).select("track_id", F.abs(F.col("vz") - F.lag("vz").over(w)).alias("a"), (F.abs(F.col("z") - F.lag("z").over(w)) / (F.col("t") - F.lag("t").over(w))).alias("b"))
    return s.groupBy("track_id").agg(rounded(F.avg("a") / F.nullif(F.avg("b"), F.lit(0.0)), 5).alias("ratio"))


@query("e24_report_rows", TICKS + """, g as (select user_id, count(*) as n, cast(sum(cast(round(v * 10000) as bigint)) as bigint) as s, max(v) as most, min(v) as least from tk group by 1)
select user_id, metric, """ + rnd("value", 4) + " as value from (select user_id, ((2 * s + n) // (2 * n)) / 10000e0 as mean, most, least from g) unpivot (value for metric in (mean, most, least))")
def e24(spark, d):
    """The mean is that of whole ten-thousandths, rounded half up in whole numbers, so that the order of addition decides nothing."""
    s, n = F.sum(F.round(F.col("v") * 10000).cast("long")), F.count("*")
    g = ticks(spark, d).groupBy("user_id").agg(s.alias("s"), n.alias("n"), F.max("v").alias("most"), F.min("v").alias("least"))
    g = g.select("user_id", (F.expr("(2 * s + n) div (2 * n)") / 10000.0).alias("mean"), "most", "least")
    return g.unpivot("user_id", ["mean", "most", "least"], "metric", "value").withColumn("value", rounded("value", 4))
