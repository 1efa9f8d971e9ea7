"""Queries on surveillance messages: scalars, filters, keyframes, diagnostics, features. Each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackspark.functions import scalars as S
from trackspark.operators import features, prepare
from trackspark.operators import timeseries as T
from trackspark.sources import messages as M
from trackspark.sources.messages import MESSAGES_SQL

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def rounded(c, digits: int = 6):
    """Rounded, and never -0, so that engines agree on the text of a value."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.abs(c) < 0.5 * 10.0**-digits, 0.0).otherwise(S.round_half(c, digits))


def r6(*columns: str):
    return [rounded(c).alias(c) for c in columns]


def rnd(c: str, digits: int = 6) -> str:
    """rounded() in SQL."""
    return f"case when abs({c}) < {0.5 * 10.0**-digits:e} then 0e0 else round({c}, {digits}) end"


def messages(spark, d) -> DataFrame:
    """The derived messages: one pass over events, pruned to the columns that a query needs; nothing is kept."""
    return M.surveillance(spark, d)


def events(spark, d) -> DataFrame:
    return prepare.events(messages(spark, d), M.rule_table(spark, d))


def keyframes(spark, d) -> DataFrame:
    return prepare.build_keyframes(events(spark, d))


def samples(spark, d) -> DataFrame:
    return prepare.paired_samples(keyframes(spark, d))


EVENTS_SQL = MESSAGES_SQL + """, k as (
  select *, case when lat is not null and lon is not null and gs is not null and track is not null then 'position_velocity'
                 when lat is not null and lon is not null then 'position' when gs is not null and track is not null then 'velocity' else 'other' end as kind,
         gs * 0.514444e0 * sin(radians(track)) as ve, gs * 0.514444e0 * cos(radians(track)) as vn,
         cast(json_extract_string(decoded_json, '$.velocity_raw[2]') as double) * 0.3048e0 / 60e0 as vz, round_even(ts_utc, 0) as bucket from m
), e as (
  select * from k where crc_ok = 1 and ts_utc between 1704067200 and 1704068025 and kind <> 'other'
)"""
KEYFRAMES_SQL = EVENTS_SQL + """, g as (
  select track_id, bucket as t, avg(lat) as lat, avg(lon) as lon, avg(alt) filter (lat is not null) as alt, avg(ve) as ve, avg(vn) as vn, avg(vz) filter (ve is not null) as vz,
         count(lat) as n_position, count(ve) as n_velocity, list_sort(list(distinct kind)) as kinds from e group by track_id, bucket
), kf as (
  select *, case when list_contains(kinds, 'position_velocity') or (list_contains(kinds, 'position') and list_contains(kinds, 'velocity')) then 'position_velocity' else kinds[1] end as event_kind,
         lat is not null and alt is not null as full_position, ve is not null and vz is not null as full_velocity,
         lat is not null and alt is not null and ve is not null and vz is not null as paired,
         'kf_' || lpad(cast(row_number() over (partition by track_id order by t) as varchar), 6, '0') as keyframe_id from g
)"""
_N = "6378137e0 / sqrt(1 - 0.0066943799901413165e0 * sin(radians(lat)) * sin(radians(lat)))"
SAMPLES_SQL = KEYFRAMES_SQL + f""", ec as (
  select *, {_N} * cos(radians(lat)) * cos(radians(lon)) as ex, {_N} * cos(radians(lat)) * sin(radians(lon)) as ey, {_N} * (1 - 0.0066943799901413165e0) * sin(radians(lat)) as ez
  from kf where paired
), o as (
  select {_N} * cos(radians(lat)) * cos(radians(lon)) as ox, {_N} * cos(radians(lat)) * sin(radians(lon)) as oy, {_N} * (1 - 0.0066943799901413165e0) * sin(radians(lat)) as oz,
         sin(radians(lat)) as sa, cos(radians(lat)) as ca, sin(radians(lon)) as so, cos(radians(lon)) as co from (select 56.923611e0 as lat, 23.971111e0 as lon)
), s as (
  select track_id, t, round(-so * (ex - ox) + co * (ey - oy), 6) as x, round(-sa * co * (ex - ox) - sa * so * (ey - oy) + ca * (ez - oz), 6) as y,
         round((alt - 36e0) * 0.3048e0, 6) as z, round(ve, 6) as vx, round(vn, 6) as vy, round(vz, 6) as vz,
         row_number() over (partition by track_id order by t) - 1 as i from ec, o
)"""


@query("io7_load_report", MESSAGES_SQL + """
select count(*) as n, round(min(ts_utc), 3) as t_min, round(max(ts_utc), 3) as t_max, count(gs) as n_velocity, count(distinct upper(icao)) as n_icao from m""")
def io7(spark, d):
    return messages(spark, d).agg(F.count("*").alias("n"), F.round(F.min("ts_utc"), 3).alias("t_min"), F.round(F.max("ts_utc"), 3).alias("t_max"), F.count("gs").alias("n_velocity"), F.count_distinct(S.norm_icao(F.col("icao"))).alias("n_icao"))


@query("io1_read_messages", MESSAGES_SQL + " select raw_id, ts_utc, lat, lon from m where upper(icao) = '4B0001' and ts_utc between 1704067300 and 1704067500 and crc_ok = 1")
def io1(spark, d):
    return M.read_messages(messages(spark, d), "4b0001", M.EPOCH + 100, M.EPOCH + 300, True).select("raw_id", "ts_utc", "lat", "lon")


@query("p_kinematics", MESSAGES_SQL + """
select raw_id, upper(icao) as icao, """ + rnd("gs * 0.514444e0 * sin(radians(track))") + " as ve, " + rnd("gs * 0.514444e0 * cos(radians(track))") + """ as vn,
       cast(json_extract_string(decoded_json, '$.velocity_raw[2]') as double) as fpm, round(cast(json_extract_string(decoded_json, '$.velocity_raw[2]') as double) * 0.3048e0 / 60e0, 6) as vz,
       round((track - 350 + 180) - 360e0 * floor((track - 350 + 180) / 360e0) - 180, 6) as diff from m""")
def p_kinematics(spark, d):
    m = messages(spark, d)
    ve, vn = S.enu_velocity(F.col("gs"), F.col("track"))
    fpm = S.vertical_rate_fpm(F.col("decoded_json"))
    return m.select("raw_id", S.norm_icao(F.col("icao")).alias("icao"), rounded(ve).alias("ve"), rounded(vn).alias("vn"), fpm.alias("fpm"), F.round(S.fpm_to_mps(fpm), 6).alias("vz"), F.round(S.angle_diff_deg(F.col("track"), F.lit(350.0)), 6).alias("diff"))


@query("p_geometry", MESSAGES_SQL + f"""
select raw_id, round(2e0 * 6371.0088e0 * asin(sqrt(pow(sin(radians(lat - 56.923611e0) / 2), 2) + cos(radians(56.923611e0)) * cos(radians(lat)) * pow(sin(radians(lon - 23.971111e0) / 2), 2))), 6) as km,
       round({_N} * cos(radians(lat)) * cos(radians(lon)), 3) as ex, round({_N} * (1 - 0.0066943799901413165e0) * sin(radians(lat)), 3) as ez from m where lat is not null""")
def p_geometry(spark, d):
    m = messages(spark, d).where("lat is not null")
    x, _, z = S.geodetic_to_ecef(F.col("lat"), F.col("lon"))
    return m.select("raw_id", F.round(S.haversine_km(F.lit(S.REFERENCE_LAT), F.lit(S.REFERENCE_LON), F.col("lat"), F.col("lon")), 6).alias("km"), F.round(x, 3).alias("ex"), F.round(z, 3).alias("ez"))


@query("p10_round_trip")
def p10(spark, d):
    m = messages(spark, d).where("lat is not null")
    x, y = S.local_xy(F.col("lat"), F.col("lon"))
    return m.select("raw_id", S.xy_to_latlon(x, y).alias("back")).select("raw_id", F.round("back.lat", 6).alias("lat"), F.round("back.lon", 6).alias("lon"))


@query("p_flags", EVENTS_SQL + """
select raw_id, kind, round_even(ts_utc / 2e0, 0) * 2e0 as bucket2, lat is not null and lon is not null as position_xy, lat is not null and lon is not null and alt is not null as full_position,
       gs is not null and track is not null as horizontal_velocity,
       round(case when ts_utc between 1704067200 and 1704067202 then 0e0 else greatest((alt - 36e0) * 0.3048e0, 0e0) end, 6) as height from k""")
def p_flags(spark, d):
    m = messages(spark, d)
    pos, vel = F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.col("gs").isNotNull() & F.col("track").isNotNull()
    alt = F.col("alt")
    height = F.when(F.col("ts_utc").between(M.EPOCH, M.EPOCH + 2), 0.0).otherwise(F.when(alt.isNotNull(), F.greatest((alt - 36.0) * S.FT_TO_M, F.lit(0.0))).otherwise(0.0))
    return m.select("raw_id", S.event_kind(F.col("lat"), F.col("lon"), F.col("gs"), F.col("track")).alias("kind"), S.bucket_time(F.col("ts_utc"), 2.0).alias("bucket2"), pos.alias("position_xy"), (pos & alt.isNotNull()).alias("full_position"), vel.alias("horizontal_velocity"), F.round(height, 6).alias("height"))


@query("p_scores", """
select l_orderkey, l_linenumber, round(greatest(0e0, least(100e0, 100 * (1 - (l_quantity - 12) / 38e0))), 6) as low,
       round(case when q between 0.45 and 1.25 then 100 when q < 0.45 then greatest(0e0, 100 * (q - 0.08) / (0.45e0 - 0.08e0)) else greatest(0e0, 100 * (2.8e0 - q) / (2.8e0 - 1.25e0)) end, 6) as band,
       case when l_quantity >= 40 then 'rapid' when l_quantity >= 15 then 'medium' else 'slow' end as magnitude
from (select *, l_extendedprice / 40000e0 as q from lineitem)""")
def p_scores(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    q = F.col("l_extendedprice") / 40000.0
    return li.select("l_orderkey", "l_linenumber", F.round(S.score_lower_is_better(F.col("l_quantity"), 12, 50), 6).alias("low"), F.round(S.score_ratio_band(q, 0.45, 1.25, 0.08, 2.8), 6).alias("band"), S.magnitude_band(F.col("l_quantity"), 15, 40).alias("magnitude"))


@query("f5_rule_counts", EVENTS_SQL + """
select track_id, count(*) as n_icao, count(*) filter (crc_ok = 1) as n_crc, count(*) filter (crc_ok = 1 and kind <> 'other') as n_events,
       count(*) filter (crc_ok = 1 and kind <> 'other' and ts_utc between 1704067200 and 1704068025) as n_window from k group by track_id""")
def f5(spark, d):
    m = messages(spark, d)
    return prepare.rule_counts(m, M.rule_table(spark, d))


@query("f6_filter_radius", EVENTS_SQL + """
select track_id, count(*) as n from e where lat is null or 2e0 * 6371.0088e0 * asin(sqrt(pow(sin(radians(lat - 56.923611e0) / 2), 2) + cos(radians(56.923611e0)) * cos(radians(lat)) * pow(sin(radians(lon - 23.971111e0) / 2), 2))) <= 30 group by track_id""")
def f6(spark, d):
    return prepare.filter_radius(events(spark, d).withColumn("radius_km", F.lit(30.0))).groupBy("track_id").agg(F.count("*").alias("n"))


_DIAG = EVENTS_SQL + """, p as (
  select raw_id, track_id, ts_utc, ts_utc - lag(ts_utc) over w as dt,
         2e0 * 6371.0088e0 * asin(sqrt(pow(sin(radians(lat - lag(lat) over w) / 2), 2) + cos(radians(lag(lat) over w)) * cos(radians(lat)) * pow(sin(radians(lon - lag(lon) over w) / 2), 2))) as step_km
  from e where lat is not null window w as (partition by track_id order by ts_utc, raw_id)
), pd as (select *, case when dt > 0 then step_km / dt * 3600 end as speed_kmh from p)"""


@query("w1_position_diagnostics", _DIAG + " select raw_id, round(dt, 6) as dt, round(step_km, 6) as step_km, round(speed_kmh, 4) as speed_kmh from pd")
def w1(spark, d):
    p = prepare.position_diagnostics(events(spark, d))
    return p.select("raw_id", *r6("dt", "step_km"), F.round("speed_kmh", 4).alias("speed_kmh"))


@query("w2_velocity_diagnostics", EVENTS_SQL + """, v as (
  select raw_id, ts_utc - lag(ts_utc) over w as dt, sqrt(pow(ve - lag(ve) over w, 2) + pow(vn - lag(vn) over w, 2)) as dh, abs(vz - lag(vz) over w) as dv
  from e where ve is not null window w as (partition by track_id order by ts_utc, raw_id)
) select raw_id, round(dt, 6) as dt, round(dh, 6) as dh, round(dv, 6) as dv, round(case when dt > 0 then sqrt(dh * dh + dv * dv) / dt end, 5) as accel from v""")
def w2(spark, d):
    v = prepare.velocity_diagnostics(events(spark, d))
    return v.select("raw_id", *r6("dt", "dh", "dv"), F.round("accel", 5).alias("accel"))


@query("f7_filter_iqr", """
with q as (select l_suppkey, quantile_cont(l_extendedprice, 0.25) as a, quantile_cont(l_extendedprice, 0.75) as b, count(*) as n from lineitem group by 1)
select l_orderkey, l_linenumber from lineitem join q using (l_suppkey) where not (n >= 4 and b - a > 0 and l_extendedprice > b + 0.6e0 * (b - a))""")
def f7(spark, d):
    return prepare.filter_iqr(spark.read.parquet(f"{d}/lineitem.parquet"), ["l_suppkey"], "l_extendedprice", 0.6).select("l_orderkey", "l_linenumber")


@query("f8_trim_to_first_position", EVENTS_SQL + """
select raw_id from (select raw_id, bool_or(lat is not null) over (partition by track_id order by ts_utc, raw_id rows unbounded preceding) as seen from e) where seen""")
def f8(spark, d):
    return prepare.trim_to_first_position(events(spark, d)).select("raw_id")


@query("f16_dedupe_points", EVENTS_SQL + """
select raw_id from (select raw_id, row_number() over (partition by track_id, round_even(ts_utc, 3), round_even(lon, 8), round_even(lat, 8), round_even(alt, 2) order by ts_utc, raw_id) as r from e where lat is not null) where r = 1""")
def f16(spark, d):
    return prepare.dedupe_points(events(spark, d)).select("raw_id")


@query("f11_skip_reasons", KEYFRAMES_SQL + """
select case when not full_position then 'no full position' when not full_velocity then 'no full velocity' else 'used' end as skip_reason, count(*) as n from kf group by 1""")
def f11(spark, d):
    return prepare.skip_reasons(keyframes(spark, d))


@query("j1_rules_join", EVENTS_SQL + " select raw_id, track_id from k where ts_utc between 1704067200 and 1704068025")
def j1(spark, d):
    m = messages(spark, d)
    return prepare.join_rules(m, M.rule_table(spark, d)).select("raw_id", "track_id")


@query("a1_keyframes", KEYFRAMES_SQL + """
select track_id, keyframe_id, t, round(lat, 9) as lat, round(lon, 9) as lon, round(alt, 4) as alt, """ + ", ".join(f"{rnd(c)} as {c}" for c in ("ve", "vn", "vz")) + """, n_position, n_velocity, event_kind, paired from kf""")
def a1(spark, d):
    return keyframes(spark, d).select("track_id", "keyframe_id", "t", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), F.round("alt", 4).alias("alt"), *r6("ve", "vn", "vz"), "n_position", "n_velocity", "event_kind", "paired")


@query("a4_prepare_report", KEYFRAMES_SQL + """
select event_kind, count(*) as n, count(*) filter (paired) as n_paired, round(count(*) filter (paired) / count(*), 6) as share from kf group by event_kind""")
def a4(spark, d):
    return keyframes(spark, d).groupBy("event_kind").agg(F.count("*").alias("n"), F.count_if("paired").alias("n_paired"), F.round(F.count_if("paired") / F.count("*"), 6).alias("share"))


@query("a5_best_callsign", MESSAGES_SQL + """
select track_id, callsign, n from (select track_id, trim(callsign) as callsign, count(*) as n, row_number() over (partition by track_id order by count(*) desc, trim(callsign)) as r
from m where trim(callsign) <> '' group by 1, 2) where r = 1""")
def a5(spark, d):
    return prepare.best_callsign(messages(spark, d))


@query("a22_grouping_sets", KEYFRAMES_SQL + """
select track_id, event_kind, count(*) as n, round(max(vz), 6) as max_vz from kf group by grouping sets ((track_id), (event_kind), ())""")
def a22(spark, d):
    k = keyframes(spark, d)
    return k.groupingSets([["track_id"], ["event_kind"], []], "track_id", "event_kind").agg(F.count("*").alias("n"), F.round(F.max("vz"), 6).alias("max_vz"))


@query("w4_derive_acceleration", KEYFRAMES_SQL + """, v as (
  select track_id, t, t - lag(t) over w as dt, ve - lag(ve) over w as de, vn - lag(vn) over w as dn, vz - lag(vz) over w as dz
  from kf where ve is not null window w as (partition by track_id order by t)
) select track_id, t, """ + ", ".join(rnd(f"case when dt > 0 and dt <= 10 then d{c} / dt end") + f" as a{c}" for c in "enz") + """,
         case when dt is null then 'first' when dt <= 0 then 'no step' when dt > 10 then 'too long' else 'ok' end as status from v""")
def w4(spark, d):
    return prepare.derive_acceleration(keyframes(spark, d)).select("track_id", "t", *r6("ae", "an", "az"), "status")


@query("track_summary", KEYFRAMES_SQL + """, p as (
  select track_id, vz, paired, lat, lon, last_value(lat ignore nulls) over w as la, last_value(lon ignore nulls) over w as lo
  from kf window w as (partition by track_id order by t rows between unbounded preceding and 1 preceding)
) select track_id, count(*) as n_keyframes, round(avg(cast(paired as int)), 6) as paired_share,
         round(sum(2e0 * 6371.0088e0 * asin(sqrt(pow(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lon - lo) / 2), 2)))), 3) as path_km, round(max(vz), 6) as max_climb
from p group by track_id""")
def track_summary(spark, d):
    return prepare.track_summary(keyframes(spark, d))


@query("f11_paired_samples", SAMPLES_SQL + " select track_id, i, t, " + ", ".join([f"{rnd(c, 3)} as {c}" for c in "xyz"] + [f"{rnd(c)} as {c}" for c in ("vx", "vy", "vz")]) + " from s")
def f11_samples(spark, d):
    return samples(spark, d).select("track_id", "i", "t", *(rounded(c, 3).alias(c) for c in "xyz"), *r6("vx", "vy", "vz"))


@query("io15_reference_metadata", EVENTS_SQL + """
select track_id, round(min_by(lat, ts_utc * 1e6 + raw_id % 1000) , 5) as lat0, count(*) as n_positions from e where lat is not null group by track_id""")
def io15(spark, d):
    return events(spark, d).where("lat is not null").groupBy("track_id").agg(F.round(F.min_by("lat", F.col("ts_utc") * 1e6 + F.col("raw_id") % 1000), 5).alias("lat0"), F.count("*").alias("n_positions"))


_FEATURES_SQL = SAMPLES_SQL + """, fg as (
  select *, sqrt(vx * vx + vy * vy) as speed,
         coalesce((lead(x) over w - lag(x) over w) / greatest(lead(t) over w - lag(t) over w, 1e-6), (lead(x) over w - x) / greatest(lead(t) over w - t, 1e-6), (x - lag(x) over w) / greatest(t - lag(t) over w, 1e-6)) as dx,
         coalesce((lead(y) over w - lag(y) over w) / greatest(lead(t) over w - lag(t) over w, 1e-6), (lead(y) over w - y) / greatest(lead(t) over w - t, 1e-6), (y - lag(y) over w) / greatest(t - lag(t) over w, 1e-6)) as dy
  from s window w as (partition by track_id order by t)
), h as (
  select *, z + speed * speed / (2 * 9.80665e0) as energy, sqrt(pow(dx - vx, 2) + pow(dy - vy, 2)) as mismatch,
         quantile_cont(vz, 0.5) over (partition by track_id order by t rows between 1 preceding and 1 following) as vz_s from fg
)"""


@query("m1_motion_features", _FEATURES_SQL + " select track_id, t, round(speed, 5) as speed, round(energy, 4) as energy, round(mismatch, 4) as mismatch, " + rnd("vz_s") + " as vz_smooth from h")
def m1(spark, d):
    f = features.motion_features(samples(spark, d))
    return f.select("track_id", "t", F.round("speed", 5).alias("speed"), F.round("energy", 4).alias("energy"), F.round("mismatch", 4).alias("mismatch"), rounded("vz_smooth").alias("vz_smooth"))


@query("m4_energy_label", _FEATURES_SQL + """
select track_id, case when speed < 25 then 'ground_slow' when vz_s > 1 then 'climb' when vz_s < -1 then 'descent' else 'level' end as label, count(*) as n from h group by 1, 2""")
def m4(spark, d):
    return features.energy_labels(features.motion_features(samples(spark, d))).groupBy("track_id", "label").agg(F.count("*").alias("n"))


def _slope_sql(c: str) -> str:
    return f"coalesce((lead({c}) over w - lag({c}) over w) / greatest(lead(t) over w - lag(t) over w, 1e-9), (lead({c}) over w - {c}) / greatest(lead(t) over w - t, 1e-9), ({c} - lag({c}) over w) / greatest(t - lag(t) over w, 1e-9))"


CONFIDENCE_SQL = SAMPLES_SQL + ", q1 as (select *, " + ", ".join(f"{_slope_sql(c)} as d{c}" for c in "xyz") + """,
  sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2) + pow(z - lag(z) over w, 2)) as back, sqrt(pow(lead(x) over w - x, 2) + pow(lead(y) over w - y, 2) + pow(lead(z) over w - z, 2)) as ahead
  from s window w as (partition by track_id order by t)
), q2 as (select *, least(back, ahead) as near, sqrt(pow(vx - dx, 2) + pow(vy - dy, 2) + pow(vz - dz, 2)) as miss, abs(vz - dz) as up, sqrt(vx * vx + vy * vy) as said, sqrt(dx * dx + dy * dy) as moved from q1
), q3 as (select *, degrees(acos(greatest(-1e0, least(1e0, (vx * dx + vy * dy) / greatest(said * moved, 1e-9))))) as apart from q2
), cf as (select *, case when near is null then 1e0 when moved < 3 or near < 10 then 0e0 else
  case when miss > 165 then 0e0 else 55e0 / greatest(miss, 55e0) end * 9e0 / greatest(up, 9e0) * case when said < 3 or moved < 3 then 1e0 else 35e0 / greatest(apart, 35e0) end end as confidence from q3)"""


@query("m17_velocity_confidence", CONFIDENCE_SQL + " select track_id, t, " + rnd("confidence") + " as confidence from cf")
def m17(spark, d):
    return features.velocity_confidence(samples(spark, d)).select("track_id", "t", rounded("confidence").alias("confidence"))


@query("w16_neighbour_distance", CONFIDENCE_SQL + " select track_id, t, " + rnd("near", 4) + " as near from cf")
def w16(spark, d):
    return T.neighbour_step(samples(spark, d), ["track_id"], "t", ["x", "y", "z"], "near").select("track_id", "t", rounded("near", 4).alias("near"))


@query("w13_energy_runs", _FEATURES_SQL + """, lb as (
  select track_id, t, case when speed < 25 then 'ground_slow' when vz_s > 1 then 'climb' when vz_s < -1 then 'descent' else 'level' end as label from h
), n as (select *, row_number() over w - 1 as i, case when label is not distinct from lag(label) over w then 0 else 1 end as new from lb window w as (partition by track_id order by t)
), r as (select *, sum(new) over (partition by track_id order by t rows unbounded preceding) as run from n)
select track_id, cast(run as bigint) as run, any_value(label) as label, min(i) as first_index, max(i) as last_index, min(t) as t0, max(t) as t1, max(t) - min(t) as duration, count(*) as n from r group by track_id, run""")
def w13(spark, d):
    runs = T.label_runs(features.energy_labels(features.motion_features(samples(spark, d))), ["track_id"], "t", "label")
    return runs.withColumns({c: F.col(c).cast("long") for c in ("run", "first_index", "last_index")})


@query("w14_stabilized_labels")
def w14(spark, d):
    return features.stabilize_labels(features.energy_labels(features.motion_features(samples(spark, d))), min_points=4, min_seconds=6.0)


@query("k2_smooth_ca")
def k2(spark, d):
    from trackspark.operators import smoothing

    return smoothing.smooth_ca(samples(spark, d))


@query("e2_position_fidelity")
def e2(spark, d):
    from trackspark.operators import smoothing

    s = samples(spark, d)
    return smoothing.position_fidelity(s, smoothing.smooth_ca(s))
