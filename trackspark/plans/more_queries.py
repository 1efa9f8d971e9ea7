"""Segmentation, evaluation and decoding queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackspark.operators import decode, evaluation, features, segmentation, smoothing
from trackspark.operators import timeseries as T
from trackspark.plans.track_queries import _FEATURES_SQL, KEYFRAMES_SQL, MESSAGES_SQL, SAMPLES_SQL, messages, r6, rnd, rounded, samples

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def labelled(spark, d):
    return features.energy_labels(features.motion_features(samples(spark, d)))


_RUNS = _FEATURES_SQL + """, lb as (
  select track_id, t, case when speed < 25 then 'ground_slow' when vz_s > 1 then 'climb' when vz_s < -1 then 'descent' else 'level' end as label from h
), nr as (select *, row_number() over w - 1 as i, case when label is not distinct from lag(label) over w then 0 else 1 end as new from lb window w as (partition by track_id order by t)
), rr as (select *, sum(new) over (partition by track_id order by t rows unbounded preceding) as run from nr
), ru as (select track_id, run, any_value(label) as label, min(i) as first_index, min(t) as t0, count(*) as n from rr group by 1, 2
), ca as (select track_id, first_index, t0, lag(label) over w as from_label, label, n, lag(n) over w as from_n from ru window w as (partition by track_id order by run)
), cd as (select track_id, cast(first_index as bigint) as sample_index, t0 as t, from_label, label as to_label, 80e0 + 2e0 * least(n, from_n, 10) as score, from_label || '_to_' || label as reason from ca where from_label is not null)
"""


@query("m7_transition_candidates", _RUNS + "select * from cd")
def m7(spark, d):
    return segmentation.transition_candidates(labelled(spark, d))


@query("m8_boundary_sample", _RUNS + """, fi as (select track_id, t, mismatch, row_number() over (partition by track_id order by t) - 1 as i from h
), nb as (select cd.track_id, sample_index, fi.i, fi.t, row_number() over (partition by cd.track_id, sample_index order by round(0.45e0 * mismatch + 0.05e0 * abs(fi.i - sample_index), 6), abs(fi.i - sample_index), fi.i) as r
  from cd join fi on cd.track_id = fi.track_id and fi.i between sample_index - 6 and sample_index + 6)
select track_id, sample_index, cast(i as bigint) as chosen_index, t as chosen_t from nb where r = 1""")
def m8(spark, d):
    f = labelled(spark, d)
    return segmentation.choose_boundary_sample(segmentation.transition_candidates(f), f)


@query("u1_union_candidates", _RUNS + "select track_id, sample_index, t, score, to_label, reason as reasons from cd")
def u1(spark, d):
    c = segmentation.transition_candidates(labelled(spark, d)).select("track_id", "sample_index", "t", "score", "reason", "to_label")
    weaker = c.withColumn("score", F.col("score") - 5)
    return segmentation.union_candidates(c, weaker).withColumn("reasons", F.array_join("reasons", ","))


@query("m14_select_boundaries")
def m14(spark, d):
    return segmentation.select_boundaries(segmentation.transition_candidates(labelled(spark, d)))


@query("m15_build_segments", _RUNS + """, cu as (select track_id, i from (select track_id, unnest([min(i), max(i)]) as i from s group by 1) union select track_id, sample_index from cd
), se as (select track_id, row_number() over w - 1 as segment, i as first_index, lead(i) over w as last_index from cu window w as (partition by track_id order by i))
select track_id, segment, first_index, last_index from se where last_index is not null""")
def m15(spark, d):
    return segmentation.build_segments(samples(spark, d), segmentation.transition_candidates(labelled(spark, d)))


@query("a12_segment_features", _RUNS + """, cu as (select track_id, i from (select track_id, unnest([min(i), max(i)]) as i from s group by 1) union select track_id, sample_index from cd
), se as (select track_id, row_number() over w - 1 as segment, i as first_index, lead(i) over w as last_index from cu window w as (partition by track_id order by i))
select se.track_id, segment, count(*) as n, max(s.t) - min(s.t) as duration, """ + rnd("quantile_cont(s.vz, 0.5)") + " as median_vz, " + rnd("max(s.z)", 3) + " as top from se join s on s.track_id = se.track_id and s.i between first_index and last_index where last_index is not null group by 1, 2")
def a12(spark, d):
    s = samples(spark, d)
    return segmentation.segment_features(s, segmentation.build_segments(s, segmentation.transition_candidates(labelled(spark, d)))).select("track_id", "segment", "n", "duration", rounded("median_vz").alias("median_vz"), rounded("top", 3).alias("top"))


@query("w21_segments_from_labels", _RUNS + "select track_id, label, count(*) as n_runs, cast(max(n) as bigint) as longest from ru group by 1, 2")
def w21(spark, d):
    return T.label_runs(labelled(spark, d), ["track_id"], "t", "label").groupBy("track_id", "label").agg(F.count("*").alias("n_runs"), F.max("n").alias("longest"))


@query("e1_time_grid", SAMPLES_SQL + """, g as (select track_id, t, t - lag(t) over (partition by track_id order by t) as dt from s)
select track_id, max(t) - min(t) as duration, quantile_cont(dt, 0.5) as median_dt, """.replace(", g as", ", tg as") + rnd("quantile_cont(dt, 0.95)") + " as p95_dt, count(*) filter (dt > 10) as n_gaps from tg group by 1")
def e1(spark, d):
    return evaluation.time_grid(samples(spark, d)).withColumn("p95_dt", rounded("p95_dt"))


def _grad(c: str) -> str:
    return f"coalesce((lead({c}) over w - lag({c}) over w) / greatest(lead(t) over w - lag(t) over w, 1e-6), (lead({c}) over w - {c}) / greatest(lead(t) over w - t, 1e-6), ({c} - lag({c}) over w) / greatest(t - lag(t) over w, 1e-6))"


@query("e8_smoothness", SAMPLES_SQL + f""", ac as (select track_id, sqrt(pow({_grad("vx")}, 2) + pow({_grad("vy")}, 2) + pow({_grad("vz")}, 2)) as a from s window w as (partition by track_id order by t))
select track_id, """ + rnd("sqrt(avg(a * a))", 4) + " as rms, " + rnd("quantile_cont(a, 0.95)", 4) + " as p95, " + rnd("max(a)", 4) + " as most from ac group by 1")
def e8(spark, d):
    return evaluation.smoothness(samples(spark, d)).select("track_id", *(rounded(c, 4).alias(c) for c in ("rms", "p95", "most")))


@query("e10_unwrapped_heading", SAMPLES_SQL + """, he as (select track_id, t, degrees(atan2(vx, vy)) as hd from s
), dl as (select *, hd - lag(hd) over w + 180 as raw, t - lag(t) over w as dt, first_value(hd) over w as h0 from he window w as (partition by track_id order by t)
), dw as (select *, raw - 360e0 * floor(raw / 360e0) - 180 as d from dl)
select track_id, t, """ + rnd("h0 + coalesce(sum(d) over (partition by track_id order by t rows unbounded preceding), 0)", 4) + " as heading, " + rnd("d / dt", 4) + " as rate from dw")
def e10(spark, d):
    return evaluation.unwrapped_heading(samples(spark, d)).select("track_id", "t", rounded("heading", 4).alias("heading"), rounded("rate", 4).alias("rate"))


@query("e13_envelope_violations", SAMPLES_SQL + " select track_id, count(*) filter (sqrt(vx * vx + vy * vy) > 80) as n_fast, count(*) filter (abs(vz) > 4.5) as n_vertical, count(*) as n from s group by 1")
def e13(spark, d):
    return evaluation.envelope_violations(samples(spark, d), 80.0, 4.5)


@query("k21_median_baseline", SAMPLES_SQL + """, md as (select track_id, t, x, y, quantile_cont(x, 0.5) over f as mx, quantile_cont(y, 0.5) over f as my from s window f as (partition by track_id order by t rows between 2 preceding and 2 following))
select track_id, """ + rnd("sqrt(avg(pow(x - mx, 2) + pow(y - my, 2)))", 3) + " as rmse from md group by 1")
def k21(spark, d):
    s = samples(spark, d)
    for c in ("x", "y"):
        s = T.rolling_median(s, ["track_id"], ["t"], c, 5, f"m{c}")
    e = F.pow(F.col("x") - F.col("mx"), 2) + F.pow(F.col("y") - F.col("my"), 2)
    return s.groupBy("track_id").agg(rounded(F.sqrt(F.avg(e)), 3).alias("rmse"))


@query("e4_hausdorff")
def e4(spark, d):
    s = samples(spark, d)
    r = smoothing.smooth_ca(s).where("error is null")
    return evaluation.hausdorff(s.select("track_id", F.lit(0).alias("which"), "t", "x", "y", "z").unionByName(r.select("track_id", F.lit(1).alias("which"), "t", "x", "y", "z")))


@query("e5_dtw")
def e5(spark, d):
    s = samples(spark, d)
    r = smoothing.smooth_ca(s).where("error is null")
    return evaluation.dtw_mean(s.select("track_id", F.lit(0).alias("which"), "t", "x", "y", "z").unionByName(r.select("track_id", F.lit(1).alias("which"), "t", "x", "y", "z")))


_LONG = """with g as (select user_id % 7 as method, sqrt(avg(value * value)) as a, quantile_cont(value, 0.95) as b, max(value) as c from events group by 1
), l as (select method, unnest(['a', 'b', 'c']) as metric, unnest([a, b, c]) as value from g
), x as (select *, (select quantile_cont(value, 0.5) from l i where i.metric = l.metric and value > 0) as med from l
), sc as (select method, avg(abs(value) / med) as score from x group by 1)
select method, """


@query("a14_score_methods", _LONG + rnd("score") + " as score, cast(rank() over (order by round(score, 9)) as bigint) as place from sc")
def a14(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    g = e.groupBy((F.col("user_id") % 7).alias("method")).agg(T.rms(F.col("value")).alias("a"), F.percentile("value", 0.95).alias("b"), F.max("value").alias("c"))
    long_ = g.unpivot("method", ["a", "b", "c"], "metric", "value")
    return evaluation.score_methods(long_).select("method", rounded("score").alias("score"), "place")


@query("d1_frame_header", MESSAGES_SQL + ", fr as (select raw_id, '8d' || icao || lpad(to_hex(raw_id), 20, '0') as p from m) select raw_id, 17 as df, upper(substr(p, 3, 6)) as icao from fr")
def d1(spark, d):
    f = messages(spark, d).select("raw_id", F.concat(F.lit("8d"), F.col("icao"), F.lpad(F.hex(F.col("raw_id").cast("long")), 20, "0")).alias("payload_hex"))
    return decode.frame_header(f).select("raw_id", "df", "icao")


@query("d2_crc_remainder")
def d2(spark, d):
    f = messages(spark, d).select("raw_id", F.concat(F.lit("8d"), F.col("icao"), F.lpad(F.hex(F.col("raw_id").cast("long")), 20, "0")).alias("payload_hex"))
    return f.select("raw_id", decode.crc_remainder(F.col("payload_hex")).alias("remainder"))


@query("d3_pair_even_odd", MESSAGES_SQL + """ select raw_id, last_value(case when raw_id % 2 = 0 then raw_id end ignore nulls) over w as even_id, last_value(case when raw_id % 2 = 1 then raw_id end ignore nulls) over w as odd_id
from m where lat is not null window w as (partition by upper(icao), coalesce(alt, 0) < 200 order by raw_id rows unbounded preceding)""")
def d3(spark, d):
    f = messages(spark, d).where("lat is not null").select(F.col("raw_id").alias("id"), F.upper("icao").alias("icao"), (F.coalesce("alt", F.lit(0.0)) < 200).alias("surface"), (F.col("raw_id") % 2).alias("odd"))
    return decode.pair_even_odd(f).select(F.col("id").alias("raw_id"), "even_id", "odd_id")


@query("a18_continuity_summary", KEYFRAMES_SQL + """, j as (select track_id, event_kind, abs(vz - lag(vz) over (partition by track_id order by t)) as jump from kf where vz is not null
), bk as (select unnest(['position', 'position_velocity', 'velocity', 'go_around']) as bucket)
select bucket, count(jump) as n, """ + rnd("max(jump)", 5) + " as largest from bk left join j on j.event_kind = bk.bucket group by bucket")
def a18(spark, d):
    from trackspark.plans.track_queries import keyframes

    w = Window.partitionBy("track_id").orderBy("t")
    j = keyframes(spark, d).where("vz is not null").select("event_kind", F.abs(F.col("vz") - F.lag("vz").over(w)).alias("jump"))
    b = spark.createDataFrame([(x,) for x in ("position", "position_velocity", "velocity", "go_around")], "bucket string")
    return b.join(j, b.bucket == j.event_kind, "left").groupBy("bucket").agg(F.count("jump").alias("n"), rounded(F.max("jump"), 5).alias("largest"))
