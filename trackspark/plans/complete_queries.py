"""Queries of the regime, fit, render, comparison, decoding and stream operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackspark.functions import scalars as S
from trackspark.functions.tables import register_tables
from trackspark.operators import compare, decode, evaluation, fits, prepare, quality, regimes, render, scan, segment_scores, sketch, smoothing
from trackspark.operators import timeseries as T
from trackspark.plans.track_queries import EVENTS_SQL, KEYFRAMES_SQL, MESSAGES_SQL, SAMPLES_SQL, events, keyframes, messages, rnd, rounded, samples
from trackspark.sources import files
from trackspark.sources import messages as M
from trackspark.staging import new_path, staged
from trackspark.streaming import stateful, streams

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


_C = "over (partition by track_id, component order by t)"
COMPONENT_SQL = SAMPLES_SQL + """, sd as (select *, t - lag(t) over (partition by track_id order by t) as dt from s
), sm as (select *, quantile_cont(case when dt > 0 then dt end, 0.5) over (partition by track_id) as md from sd
), sc as (select * exclude (i), cast(sum(case when dt > greatest(30e0, coalesce(5 * md, 0)) then 1 else 0 end) over (partition by track_id order by t rows unbounded preceding) as int) as component from sm
), sn as (select *, count(*) over (partition by track_id, component) as nc from sc
), rw as (select * exclude (nc), row_number() """ + _C + """ - 1 as i from sn where nc >= 2
)"""


def _i2s(name: str) -> str:
    return f"coalesce(({name} + lead({name}) {_C}) / 2, lead({name}) {_C}, {name}, 0)"


def _sg(c: str) -> str:
    return f"coalesce((lead({c}) {_C} - lag({c}) {_C}) / greatest(lead(t) {_C} - lag(t) {_C}, 1e-6), (lead({c}) {_C} - {c}) / greatest(lead(t) {_C} - t, 1e-6), ({c} - lag({c}) {_C}) / greatest(t - lag(t) {_C}, 1e-6), 0)"


def _med(c: str, k: int = 1) -> str:
    return f"quantile_cont({c}, 0.5) over (partition by track_id, component order by t rows between {k} preceding and {k} following)"


_MEDIANS = {
    "heading_rate": "abs(rate)", "signed_heading_rate": "rate", "lateral_accel": "sp * rate", "abs_lateral_accel": "abs(sp * rate)", "speed": "sp", "vertical_rate": "vz", "abs_vertical_rate": "abs(vz)", "speed_accel": "sacc",
    "accel": "acc", "vertical_accel": "vacc", "energy_rate": "erate", "abs_energy_rate": "abs(erate)",
}
FEATURES_SQL = COMPONENT_SQL + f""", f1 as (select *, greatest(t - lag(t) {_C}, 1e-6) as d, sqrt(vx * vx + vy * vy) as sp, atan2(vy, vx) as hd,
  first_value(x) over ch as ax0, first_value(y) over ch as ay0, first_value(z) over ch as az0, last_value(x) over ch as bx0, last_value(y) over ch as by0, last_value(z) over ch as bz0
  from rw window ch as (partition by track_id, component order by t rows between 2 preceding and 2 following)
), f2 as (select *, hd - lag(hd) {_C} + pi() as hr, {", ".join(f"({c} - lag({c}) {_C}) / d as d{c}" for c in ("x", "y", "z", "vx", "vy", "vz"))}, z + sp * sp / (2 * 9.80665e0) as e from f1
), f3 as (select *, (hr - 2 * pi() * floor(hr / (2 * pi())) - pi()) / d as r0, sqrt(dvx * dvx + dvy * dvy + dvz * dvz) as a0 from f2
), f4 as (select *, {_i2s("r0")} as rate, {_i2s("a0")} as acc, {_i2s("dvz")} as vacc, {_i2s("dx")} as px, {_i2s("dy")} as py, {_i2s("dz")} as pz, {_sg("sp")} as sacc, {_sg("e")} as erate,
  pow(bx0 - ax0, 2) + pow(by0 - ay0, 2) + pow(bz0 - az0, 2) as dd, (bx0 - ax0) * (x - ax0) + (by0 - ay0) * (y - ay0) + (bz0 - az0) * (z - az0) as de, pow(x - ax0, 2) + pow(y - ay0, 2) + pow(z - az0, 2) as ee from f3
), f5 as (select track_id, component, i, t, x, y, z, vx, vy, vz, {", ".join(f"{_med(e)} as {n}" for n, e in _MEDIANS.items())}, e as energy_height, sqrt(pow(vx - px, 2) + pow(vy - py, 2) + pow(vz - pz, 2)) as mismatch,
  sqrt(greatest(ee - case when dd > 1e-12 then de * de / dd else 0 end, 0)) as residual, atan2(vz, greatest(sp, 1e-6)) as path_angle from f4)"""


def features(spark, d) -> DataFrame:
    return regimes.motion_features(regimes.component_rows(samples(spark, d)))


@query("m1_all_features", FEATURES_SQL + " select track_id, component, i, " + ", ".join(f"{rnd(c, 5)} as {c}" for c in regimes.FEATURES) + " from f5")
def m1(spark, d):
    return features(spark, d).select("track_id", "component", "i", *(rounded(c, 5).alias(c) for c in regimes.FEATURES))


_SCALES = {"er": "energy_rate", "vr": "vertical_rate", "sa": "speed_accel", "hr": "signed_heading_rate", "la": "lateral_accel"}
BANDS_SQL = FEATURES_SQL + ", bm as (select track_id, component, " + ", ".join(f"quantile_cont({c}, 0.5) as m_{k}" for k, c in _SCALES.items()) + """ from f5 group by 1, 2
), bs as (select track_id, component, """ + ", ".join(f"1.4826e0 * quantile_cont(abs({c} - m_{k}), 0.5) as s_{k}, stddev_pop({c}) as d_{k}" for k, c in _SCALES.items()) + """ from f5 join bm using (track_id, component) group by 1, 2
), bc as (select track_id, component, """ + ", ".join(f"case when s_{k} > 1e-9 then s_{k} when d_{k} > 1e-9 then d_{k} else 0 end as c_{k}" for k in _SCALES) + """ from bs
), bb as (select track_id, component, greatest(1e0, 0.2e0 * c_er) as energy_band, greatest(1e0, 0.2e0 * c_vr) as vertical_band, greatest(0.2e0, 0.2e0 * c_sa) as accel_band,
  greatest(radians(0.75e0), least(radians(3e0), case when c_hr > 0 then 0.2e0 * c_hr else radians(0.75e0) end)) as turn_band, greatest(0.5e0, least(1.25e0, case when c_la > 0 then 0.25e0 * c_la else 0.5e0 end)) as lateral_band from bc)"""


@query("m2_all_deadbands", BANDS_SQL + " select track_id, component, " + ", ".join(f"{rnd(c)} as {c}" for c in ("energy_band", "vertical_band", "accel_band", "turn_band", "lateral_band")) + " from bb")
def m2(spark, d):
    return regimes.adaptive_deadbands(features(spark, d)).select("track_id", "component", *(rounded(c).alias(c) for c in ("energy_band", "vertical_band", "accel_band", "turn_band", "lateral_band")))


ENERGY_SQL = BANDS_SQL + ", l1 as (select *, " + ", ".join(f"{_med(c, 2)} as s_{c}" for c in ("speed", "vertical_rate", "speed_accel", "energy_rate")) + """ from f5 join bb using (track_id, component)
), l2 as (select *, case when s_speed < 25 then 'ground_slow' when s_vertical_rate > vertical_band then 'climb' when s_vertical_rate < -vertical_band then 'descent' when s_speed_accel > accel_band then 'level_accel'
  when s_speed_accel < -accel_band then 'level_decel' when s_energy_rate > energy_band then 'energy_gain' when s_energy_rate < -energy_band then 'energy_loss' else 'energy_constant' end as energy from l1)"""


@query("m4_energy_states", ENERGY_SQL + " select track_id, component, i, energy from l2")
def m4(spark, d):
    return regimes.raw_labels(features(spark, d)).select("track_id", "component", "i", "energy")


def tracks(spark, d) -> dict[str, DataFrame]:
    rows = staged(regimes.component_rows(samples(spark, d)), "rows")
    f = staged(regimes.motion_features(rows), "features")
    labels = staged(regimes.regime_labels(regimes.raw_labels(f)), "labels")
    bands = staged(regimes.adaptive_deadbands(f), "bands")
    found = [regimes.transition_candidates(labels, f, kinds=("energy", "turn")), regimes.go_around_candidates(f, bands), regimes.vertical_reversal_candidates(f, bands), regimes.altitude_lobe_candidates(f, bands)]
    candidates = staged(regimes.union_candidates(*found), "candidates")
    boundaries = staged(regimes.select_boundaries(candidates, rows), "boundaries")
    return {"rows": rows, "features": f, "labels": labels, "candidates": candidates, "boundaries": boundaries, "segments": staged(regimes.build_segments(rows, boundaries), "segments")}


@query("m6_regimes")
def m6(spark, d):
    return regimes.regime_labels(regimes.raw_labels(features(spark, d))).groupBy("track_id", "component", "regime").agg(F.count("*").alias("n"))


@query("m16_segments")
def m16(spark, d):
    t = tracks(spark, d)
    return regimes.segment_features(t["features"], t["labels"], t["segments"])


@query("m7_m11_candidates")
def m7(spark, d):
    return tracks(spark, d)["candidates"]


_Z = ("energy_rate", "vertical_rate", "speed_accel", "heading_rate", "abs_lateral_accel", "residual", "mismatch", "accel", "vertical_accel")
_Z_SQL = ", zm as (select track_id, component, " + ", ".join(f"quantile_cont({c}, 0.5) as m_{c}" for c in _Z) + """ from f5 group by 1, 2
), zs as (select track_id, component, """ + ", ".join(f"max(m_{c}) as m_{c}, 1.4826e0 * quantile_cont(abs({c} - m_{c}), 0.5) as s_{c}, stddev_pop({c}) as d_{c}" for c in _Z) + """ from f5 join zm using (track_id, component) group by 1, 2
), zz as (select track_id, component, i, t, """ + ", ".join(f"abs(coalesce(greatest(-50e0, least(50e0, ({c} - m_{c}) / case when s_{c} > 1e-6 then s_{c} when d_{c} > 1e-6 then d_{c} else 1e0 end)), 0)) as z_{c}" for c in _Z) + " from f5 join zs using (track_id, component))"


def _either(*tokens: str) -> str:
    return "(" + " or ".join(f"contains(was, '{x}') or contains(now, '{x}')" for x in tokens) + ")"


_WEIGHED = ((("climb", "descent"), 10), (("energy_gain", "energy_loss"), 6), (("accel", "decel"), 4), (("rapid",), 3))


@query("m7_m8_energy_changes", ENERGY_SQL + _Z_SQL + """, c0 as (select track_id, component, i as st, count(*) over (partition by track_id, component) as nr, lag(energy) over (partition by track_id, component order by t) as was, energy as now from l2
), c1 as (select *, greatest(1, least(st, greatest(nr - 2, 1))) as s0 from c0 where was <> now
), c2 as (select c1.*, zz.* exclude (track_id, component), abs(i - s0) as away, round(0.45e0 * z_mismatch + 0.45e0 * z_residual + 0.20e0 * (z_accel + 0.5e0 * z_vertical_accel + 0.5e0 * z_speed_accel) + 0.05e0 * abs(i - s0), 9) as cost
  from c1 join zz on zz.track_id = c1.track_id and zz.component = c1.component and zz.i between greatest(1, st - 4, s0 - 6) and least(nr - 2, st + 3, s0 + 6)
), c3 as (select *, row_number() over (partition by track_id, component, st order by cost, away, i) as nth from c2)
select track_id, component, i, """ + rnd("80e0 + 2e0 * (4" + "".join(f" + case when {_either(*k)} then {v} else 0 end" for k, v in _WEIGHED) + ") + 0.7e0 * z_energy_rate + 0.6e0 * z_vertical_rate + 0.45e0 * z_speed_accel + 0.75e0 * z_heading_rate + 0.45e0 * z_abs_lateral_accel + 0.35e0 * z_residual", 4) + """ as score,
  concat_ws(',', 'energy_state_transition', 'regime_from_' || was, 'regime_to_' || now, case when i <> st then 'optimized_boundary_sample' end, """ + ", ".join(f"case when {_either(*k)} then '{v}' end" for k, v in ((("climb",), "climb_state_transition"), (("descent",), "descent_state_transition"), (("accel", "decel"), "speed_change_transition"))) + """) as reasons
from c3 where nth = 1""")
def m7_energy(spark, d):
    """Changes of the energy label as it stands before it is stabilised, each at the quietest row of its band."""
    f = staged(features(spark, d), "features")
    return _told(regimes.transition_candidates(regimes.raw_labels(f), f, kinds=("energy",)))


def _told(candidates: DataFrame) -> DataFrame:
    return candidates.select("track_id", "component", "i", rounded("score", 4).alias("score"), F.array_join("reasons", ",").alias("reasons"))


def _modes_sql(rate: str, gate: str) -> str:
    """Smoothed rows md with their vertical mode, and rn: the runs of modes with their medians."""
    return f"""{BANDS_SQL}, ma as (select *, {_med("z", 2)} as alt, count(*) over (partition by track_id, component) as nr from f5 join bb using (track_id, component)
), mb as (select *, {rate} as r0 from ma
), mc as (select track_id, component, i, t, nr, alt, vertical_band, {_med("r0", 2)} as rate, {_med("energy_rate", 2)} as er, {_med("speed_accel", 2)} as sa from mb
), me as (select *, case when rate >= {gate} then 'climb' when rate <= -{gate} then 'descent' else 'level' end as mode from mc
), mf as (select *, case when mode is not distinct from lag(mode) {_C} then 0 else 1 end as nw from me
), md as (select *, sum(nw) over (partition by track_id, component order by t rows unbounded preceding) as run from mf
), rn as (select track_id, component, run, min(mode) as mode, min(i) as i0, max(i) as i1, min(t) as t0, max(t) as t1, count(*) as n, max(nr) as nr, quantile_cont(alt, 0.5) as alt, quantile_cont(rate, 0.5) as rate,
  quantile_cont(er, 0.5) as er, quantile_cont(sa, 0.5) as sa from md group by 1, 2, 3)"""


def _turns_sql(runs: str, pairs: str) -> str:
    """pr: pairs of runs l and r; at: each with its extreme row from the end of l to the start of r."""
    fields = ("nth", "mode", "i0", "i1", "t0", "t1", "n", "nr", "alt", "rate", "er", "sa", "shelf")
    return f""", rs as ({runs}), rr as (select *, row_number() over (partition by track_id, component order by i0) as nth from rs
), pr as (select l.track_id, l.component, {", ".join(f"l.{c} as l_{c}, r.{c} as r_{c}" for c in fields)} from rr l join rr r on l.track_id = r.track_id and l.component = r.component where {pairs}
), ex as (select pr.*, md.i, md.alt, row_number() over (partition by pr.track_id, pr.component, l_i0, r_i0 order by case when l_mode = 'climb' then -md.alt else md.alt end, md.i) as best
  from pr join md on md.track_id = pr.track_id and md.component = pr.component and md.i between l_i1 and r_i0
), xt as (select *, case when l_mode = 'climb' then alt - l_alt else l_alt - alt end as bef, case when l_mode = 'climb' then alt - r_alt else r_alt - alt end as aft from ex where best = 1)"""


_PLACED = "greatest(1, least({}, l_nr - 2))"
_NEAR = "(r_i0 - l_i1 - 1 <= 8 and r_t0 - l_t1 <= 25)"
_SHAPE = "case when l_mode = 'climb' then 'local_altitude_maximum' else 'local_altitude_minimum' end"


@query("m9_go_around_places", _modes_sql("vertical_rate", "greatest(vertical_band, 0.75e0)") + _turns_sql("select *, 0e0 as shelf from rn", "l.mode = 'descent' and l.n >= 4 and l.t1 - l.t0 >= 6 and r.nth between l.nth + 1 and l.nth + 3") + f""", ft as (
  select *, r_mode = 'climb' and r_n >= 4 and r_t1 - r_t0 >= 6 and {_NEAR} as fit from xt
), fs as (select *, bool_or(r_mode = 'descent') over (partition by track_id, component, l_i0 order by r_nth) as halt, fit and greatest(bef, aft) >= 10 as good from ft where fit or r_mode = 'descent'
), fk as (select *, row_number() over (partition by track_id, component, l_i0 order by r_nth) as k from fs where good and not halt)
select track_id, component, {_PLACED.format("i")} as i, {rnd("60e0 + greatest(0, bef) + greatest(0, aft) + 2 * abs(r_rate) + greatest(0, r_er) + greatest(0, r_sa)", 4)} as score,
  'go_around_transition,vertical_mode_reversal_descent_to_climb,local_altitude_minimum' as reasons from fk where k = 1""")
def m9(spark, d):
    f = staged(features(spark, d), "features")
    return _told(regimes.go_around_candidates(f, regimes.adaptive_deadbands(f)))


@query("m10_vertical_reversals", _modes_sql(f"coalesce(0.5e0 * {_sg('alt')} + 0.5e0 * vertical_rate, {_sg('alt')})", "greatest(vertical_band, 0.75e0)") + _turns_sql("select *, 0e0 as shelf from rn where n >= 4 and t1 - t0 >= 6", "l.mode <> 'level' and r.nth between l.nth + 1 and l.nth + 3") + f""", fs as (
  select *, greatest(0, bef) + greatest(0, aft) as total, bool_or(r_mode = l_mode) over (partition by track_id, component, l_i0 order by r_nth) as halt from xt where {_NEAR} or r_mode = l_mode
), fk as (select *, row_number() over (partition by track_id, component, l_i0 order by r_nth) as k from fs where {_NEAR} and r_mode <> l_mode and total >= 25 and greatest(bef, aft) >= 12.5e0 and not halt
), fe as (select fk.track_id, fk.component, l_i0, quantile_cont(md.er, 0.5) as e from fk join md on md.track_id = fk.track_id and md.component = fk.component and md.i between l_i0 and r_i1 where k = 1 group by 1, 2, 3)
select track_id, component, {_PLACED.format("i")} as i, {rnd("55e0 + total + 2 * abs(l_rate) + 2 * abs(r_rate) + abs(e)", 4)} as score,
  'vertical_reversal_transition,vertical_mode_reversal_' || l_mode || '_to_' || r_mode || ',' || {_SHAPE} as reasons from fk join fe using (track_id, component, l_i0) where k = 1""")
def m10(spark, d):
    f = staged(features(spark, d), "features")
    return _told(regimes.vertical_reversal_candidates(f, regimes.adaptive_deadbands(f)))


_SHELF = "sum(case when mode = 'level' then t1 - t0 else 0 end) over (partition by track_id, component order by i0 rows unbounded preceding)"


@query("m11_altitude_lobes", _modes_sql(f"coalesce(0.75e0 * {_sg('alt')} + 0.25e0 * vertical_rate, {_sg('alt')})", "greatest(0.35e0, 0.5e0 * vertical_band)") + _turns_sql(f"select * from (select *, {_SHELF} as shelf from rn where n >= 8 and t1 - t0 >= 8) where mode <> 'level'", "r.nth = l.nth + 1 and l.mode <> r.mode") + f""", fk as (
  select *, greatest(0, bef) + greatest(0, aft) as total, {_PLACED.format("case when r_shelf - l_shelf >= 8 and r_i0 > l_i1 then r_i0 else i end")} as j from xt
), en as (select track_id, component, min(t) as a, max(t) as b, count(*) as m from md group by 1, 2)
select fk.track_id, fk.component, fk.j as i, {rnd("70e0 + total + 2 * abs(l_rate) + 2 * abs(r_rate)", 4)} as score, 'altitude_lobe_transition,altitude_lobe_' || l_mode || '_to_' || r_mode || ',' || {_SHAPE} || ',large_vertical_excursion' as reasons
from fk join en using (track_id, component) join md on md.track_id = fk.track_id and md.component = fk.component and md.i = fk.j
where total >= 35 and least(bef, aft) >= 12 and j >= 7 and m - j >= 8 and md.t - a >= 8 and b - md.t >= 8""")
def m11(spark, d):
    f = staged(features(spark, d), "features")
    return _told(regimes.altitude_lobe_candidates(f, regimes.adaptive_deadbands(f)))


def energy_runs(f: DataFrame) -> DataFrame:
    """Rows with the number of their run of equal energy labels."""
    w = Window.partitionBy(*regimes.COMPONENT).orderBy("t")
    new = regimes.raw_labels(f).withColumn("_new", F.when(F.col("energy").eqNullSafe(F.lag("energy").over(w)), 0).otherwise(1))
    return new.withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


_RUN_SQL = ENERGY_SQL + f""", e1 as (select *, case when energy is not distinct from lag(energy) {_C} then 0 else 1 end as nw from l2
), e2 as (select *, sum(nw) over (partition by track_id, component order by t rows unbounded preceding) as segment from e1)"""
_PARAMETERS = ("p_eta", "p_velocity", "p_spacing", "p_per_basis", "p_jerk", "p_accel_prior", "p_accel")
_POLICY_ROWS = ", ".join(
    f"('{preset}', '{name}', {'null' if eta[k] is None else float(eta[k])}, {velocity[k]}, {fits.POLICY['noisy'][1][k]}, {', '.join(map(str, rest))})"
    for k, preset in enumerate(fits.PRESETS) for name, (eta, velocity, *rest) in fits.POLICY.items()
)


@query("p31_policies", _RUN_SQL + """, sg as (select track_id, component, segment, min(energy) || case when median(heading_rate) > min(turn_band) then '__turn_left_slow' else '' end as regime, median(speed) as speed, median(mismatch) as miss from e2 group by 1, 2, 3
), hi as (select *, miss > greatest(10e0, 0.25e0 * greatest(speed, 1)) as high from sg
), po as (select *, case when regime = 'ground_slow' or speed < 25 then 'ground' when contains(regime, 'turn_') then 'transition' when high then 'noisy' when contains(regime, 'energy_gain') or contains(regime, 'energy_loss') then 'energy_change'
  when regime = 'energy_constant' then 'energy_constant' else 'steady' end as policy from hi
), pt(preset, policy, p_eta, p_velocity, noisy, p_spacing, p_per_basis, p_jerk, p_accel_prior, p_accel) as (values """ + _POLICY_ROWS + """)
select track_id, component, cast(segment as bigint) as segment, preset, policy, cast(case when high and policy not in ('ground', 'steady') then noisy else p_velocity end as double) as p_velocity, """
    + ", ".join(f"cast({c} as double) as {c}" for c in _PARAMETERS if c != "p_velocity") + " from po join pt using (policy)")
def p31(spark, d):
    """The smoothing parameters that each run of energy labels gets, for all presets; runs that turn more than their band say so in their label."""
    f = staged(features(spark, d), "features")
    half = lambda c: F.percentile(c, 0.5)
    turns = F.when(half("heading_rate") > F.min("turn_band"), "__turn_left_slow").otherwise("")
    s = energy_runs(f).groupBy(*regimes.COMPONENT, "segment").agg(
        F.concat(F.min("energy"), turns).alias("regime_label"), half("speed").alias("median_speed"), half("mismatch").alias("median_mismatch"), (F.max("t") - F.min("t")).alias("duration"), F.count("*").alias("n"),
    )
    s = staged(s, "runs")
    out = [fits.select_params(s, p).select("track_id", "component", "segment", F.lit(p).alias("preset"), "policy", *_PARAMETERS) for p in fits.PRESETS]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _line(c: str) -> str:
    return f"regr_slope({c}, u) as v{c}, regr_intercept({c}, u) as o{c}"


@query("k10_harmonized_joins", _RUN_SQL + f""", e3 as (select track_id, component, i, t - 1704067200 as u, t, x, y, z, vx, vy, vz, segment, nw from e2
), sr as (select * from e3 union all select * replace (segment - 1 as segment) from e3 where nw = 1 and segment > 1
), li as (select track_id, component, segment, min(i) as i0, max(i) as i1, {_line("x")}, {_line("y")}, {_line("z")} from sr group by 1, 2, 3 having count(*) >= 2
), re as (select track_id, component, segment, sqrt(avg(pow(x - ox - li.vx * u, 2) + pow(y - oy - li.vy * u, 2) + pow(z - oz - li.vz * u, 2))) as rmse from sr join li using (track_id, component, segment) group by 1, 2, 3
), lr as (select * from li join re using (track_id, component, segment)
), ar as (select *, {", ".join(f"({c} - lag({c}) {_C}) / (t - lag(t) {_C}) as s1{c}, (lead({c}) {_C} - {c}) / (lead(t) {_C} - t) as s2{c}, (lead({c}) {_C} - lag({c}) {_C}) / (lead(t) {_C} - lag(t) {_C}) as s3{c}, {_med('v' + c, 2)} as st{c}" for c in "xyz")},
  quantile_cont(sqrt(vx * vx + vy * vy + vz * vz), 0.5) over (partition by track_id, component order by t rows between 3 preceding and 3 following) as sp from e3
), jn as (select ar.*, 1 / (1 + l.rmse / 80) as lw, 1 / (1 + r.rmse / 80) as rw, {", ".join(f"l.v{c} as l{c}, r.v{c} as r{c}" for c in "xyz")} from lr l join lr r on l.track_id = r.track_id and l.component = r.component and l.i1 = r.i0
  join ar on ar.track_id = l.track_id and ar.component = l.component and ar.i = l.i1
), hv as (select track_id, component, i, sp, {", ".join(f"(lw * l{c} + rw * r{c} + 0.75e0 * st{c} + 0.10e0 * v{c} + coalesce(0.35e0 * list_median([s1{c}, s2{c}, s3{c}]), 0)) / (lw + rw + 0.85e0 + case when coalesce(s1{c}, s2{c}, s3{c}) is null then 0 else 0.35e0 end) as h{c}" for c in "xyz")} from jn
), hk as (select *, least(1e0, greatest(30e0, 2.5e0 * greatest(sp, 1e-6)) / greatest(sqrt(hx * hx + hy * hy + hz * hz), 1e-9)) as k from hv)
select track_id, component, i, {", ".join(f"{rnd(f'h{c} * k', 4)} as v{c}" for c in "xyz")} from hk""")
def k10(spark, d):
    """Joins of straight lines through the runs of energy labels, with the medians of five reported velocities as the shared state."""
    rows = staged(energy_runs(staged(features(spark, d), "features")).select(*regimes.COMPONENT, "i", "t", "x", "y", "z", "vx", "vy", "vz", "segment"), "runs")
    w = Window.partitionBy(*regimes.COMPONENT).orderBy("t")
    first = F.coalesce(F.lag("segment").over(w) != F.col("segment"), F.lit(False))
    own = rows.withColumn("_first", first).withColumn("segment", F.explode(F.when(F.col("_first"), F.array(F.col("segment"), F.col("segment") - 1)).otherwise(F.array("segment"))))
    own = own.withColumn("u", F.col("t") - M.EPOCH)
    key = [*regimes.COMPONENT, "segment"]
    lines = own.groupBy(*key).agg(F.min("i").alias("first"), F.max("i").alias("last"), *(g(c, "u").alias(f"{n}_{c}") for c in "xyz" for g, n in ((F.regr_slope, "v"), (F.regr_intercept, "o")))).where("last > first")
    miss = sum(((F.col(c) - F.col(f"o_{c}") - F.col(f"v_{c}") * F.col("u")) ** 2 for c in "xyz"), F.lit(0.0))
    lines = lines.withColumn("method", F.lit("line"))
    at = own.join(lines, key)
    told = at.groupBy(*key, "method").agg(F.sqrt(F.avg(miss)).alias("rmse"))
    residuals = at.select(*key, "method", "i", *(F.col(f"v_{c}").alias(f"v{c}") for c in "xyz"))
    states = rows.select(*regimes.COMPONENT, "i", *(F.percentile(f"v{c}", 0.5).over(w.rowsBetween(-2, 2)).alias(f"v{c}") for c in "xyz"))
    j = fits.joins(rows, residuals, told, lines.select(*key, "first", "last"))
    return fits.harmonized_velocities(j, states).select("track_id", "component", "i", *(rounded(f"v{c}", 4).alias(f"v{c}") for c in "xyz"))


@query("m12_m13_extra_candidates")
def m13(spark, d):
    f = staged(features(spark, d), "features")
    return regimes.union_candidates(regimes.spike_candidates(f), regimes.change_point_candidates(f))


@query("k3_k15_render")
def k15(spark, d):
    return render.render_states(smoothing.smooth_ca(samples(spark, d)), 1.0)


@query("k22_filter_diagnostics")
def k22(spark, d):
    return fits.filter_diagnostics(smoothing.smooth_ca(samples(spark, d), ("accurate", "balanced", "smooth")))


@query("p22_render_structs")
def p22(spark, d):
    return render.with_structs(render.render_states(smoothing.smooth_ca(samples(spark, d)), 2.0), 36.0)


def segmented(spark, d):
    t = tracks(spark, d)
    return t, regimes.in_segments(t["rows"], t["segments"])


@query("k13_method_variants")
def k13(spark, d):
    """All 24 methods, and the three whose weights are searched."""
    t, rows = segmented(spark, d)
    states = staged(fits.boundary_states(t["rows"], t["boundaries"]), "states")
    smooth = staged(smoothing.smooth_ca(t["rows"]), "filtered")
    return fits.fit_diagnostics(fits.fit_segments(staged(rows, "data"), fits.Methods().known, states, filtered=smooth))


@query("k7_searched_weights")
def k7(spark, d):
    f = fits.fit_segments(segmented(spark, d)[1], ["hermite_balanced", "searched_hermite_balanced"])
    return f.select(*fits.SEGMENT, "method", "loocv", "eta", "velocity_weight", "n_solves", "error")


@query("k2_scan")
def k2_scan(spark, d):
    """Every track in chunks of a hundred rows."""
    return scan.smooth_ca_scan(samples(spark, d), ("balanced",), 100, stage=staged)


@query("k12_component_fit")
def k12(spark, d):
    out = fits.component_fit(tracks(spark, d), "balanced", stage=staged)
    return fits.fit_diagnostics(out["fits"])


@query("k9_tuned_fits")
def k9(spark, d):
    t, rows = segmented(spark, d)
    params = fits.select_params(regimes.segment_features(t["features"], t["labels"], t["segments"]))
    return fits.tuned(rows, params).select(*fits.SEGMENT, "nth", "recipe", "rmse", "n_basis", "cost")


@query("w22_neighbour_heading", SAMPLES_SQL + """, nx as (select a.track_id, a.t, a.x, a.y, arg_min(struct_pack(x := b.x, y := b.y), b.t) filter (b.t > a.t) as f, arg_max(struct_pack(x := b.x, y := b.y), b.t) filter (b.t < a.t) as p
  from s a left join s b on b.track_id = a.track_id and sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) > 400 group by all
), hd as (select track_id, t, degrees(case when f is not null then atan2(f.x - x, f.y - y) when p is not null then atan2(x - p.x, y - p.y) else 0e0 end) as h from nx)
select track_id, t, """ + rnd("h - 360e0 * floor(h / 360e0)", 3) + " as heading from hd")
def w22(spark, d):
    """Bearings to the first point more than 400 m away, several rows ahead."""
    return render.neighbour_heading(samples(spark, d), ["track_id"], 400.0).select("track_id", "t", rounded("heading", 3).alias("heading"))


@query("k11_overlap_rows")
def k11(spark, d):
    t = tracks(spark, d)
    return fits.overlapping(t["rows"], t["segments"], 16.0).groupBy("track_id", "component", "segment", "guard").agg(F.count("*").alias("n"))


@query("k16_synthetic_gaps")
def k16(spark, d):
    return fits.synthetic_gap_plan(samples(spark, d))


@query("k17_deleted_gaps")
def k17(spark, d):
    s = staged(samples(spark, d), "samples")
    return fits.score_deleted(s, staged(fits.synthetic_gap_plan(s), "plan"), smoothing.smooth_ca)


@query("k18_segment_holdout")
def k18(spark, d):
    return fits.holdout_rollup(fits.segment_holdout(segmented(spark, d)[1]))


@query("k19_quality_of_fit")
def k19(spark, d):
    rows = segmented(spark, d)[1]
    f = staged(fits.fit_segments(rows), "fits")
    return fits.quality_of_fit(fits.fit_residuals(rows, f), fits.render_fits(f, 1.0))


@query("k20_continuity")
def k20(spark, d):
    t, rows = segmented(spark, d)
    return fits.verify_continuity(fits.fit_segments(rows, ["piecewise_balanced"], fits.boundary_states(t["rows"], t["boundaries"])))


def scored(spark, d) -> dict[str, DataFrame]:
    """Segments, fits, features, joins and scores of the samples, each a written table."""
    t, rows = segmented(spark, d)
    out = t | {"data": staged(rows, "data")}
    out["fits"] = staged(fits.fit_segments(out["data"]), "fits")
    out["traits"] = staged(regimes.segment_features(t["features"], t["labels"], t["segments"]), "traits")
    out["joins"] = staged(segment_scores.join_rows(t["boundaries"], t["segments"], fits.verify_continuity(out["fits"]), out["traits"]), "joins")
    return out


@query("e21_segment_scores")
def e21(spark, d):
    t = scored(spark, d)
    return segment_scores.segment_scores(t["data"], t["fits"], t["traits"])


@query("a18_event_and_regime_buckets")
def a18(spark, d):
    return segment_scores.continuity_summary(scored(spark, d)["joins"])


@query("j12_join_table")
def j12(spark, d):
    t = scored(spark, d)
    states = staged(fits.boundary_states(t["rows"], t["boundaries"]), "states")
    sides = staged(fits.joins(t["rows"], fits.fit_residuals(t["data"], t["fits"]), t["fits"], t["segments"]), "sides")
    return segment_scores.join_table(t["joins"], states, fits.harmonized_velocities(sides, states), sides)


@query("a21_segment_table")
def a21(spark, d):
    t = scored(spark, d)
    scores = segment_scores.segment_scores(t["data"], t["fits"], t["traits"])
    return segment_scores.segment_table(scores, t["segments"], t["fits"], fits.select_params(t["traits"]))


@query("a19_regime_scores")
def a19_regimes(spark, d):
    t = scored(spark, d)
    return segment_scores.regime_scores(segment_scores.segment_scores(t["data"], t["fits"], t["traits"]))


@query("a19_a21_trajectory_table")
def a19(spark, d):
    t = scored(spark, d)
    scores = staged(segment_scores.segment_scores(t["data"], t["fits"], t["traits"]), "scores")
    joins = segment_scores.join_scores(segment_scores.continuity_summary(t["joins"]))
    gaps = segment_scores.gap_scores(t["rows"], fits.render_fits(t["fits"], 1.0))
    return segment_scores.trajectory_table(scores, segment_scores.method_scores(scores, joins, gaps))


@query("e22_gap_scores", SAMPLES_SQL + """, vg as (select track_id, t as a, lead(t) over (partition by track_id order by t) as b from s
), vm as (select *, quantile_cont(case when b - a > 1e-6 then b - a end, 0.5) over (partition by track_id) as md from vg
), vp as (select track_id, a + margin as a, b - margin as b from (select *, least(greatest(md, 0.25e0), greatest((b - a) * 0.25e0, 0.25e0)) as margin from vm where b - a > greatest(30e0, 5 * md))
), ve as (select track_id, min(t) as t0, max(t) as t1, cast(floor((max(t) - min(t)) / 20e0 + 1e-9) as bigint) as n from s group by 1
), vr as (select track_id, t0 + k * 20e0 as t from (select *, unnest(generate_series(0, n)) as k from ve) union all select track_id, t1 from ve where t0 + n * 20e0 < t1 - 1e-9
), vi as (select p.track_id, p.a, count(r.t) as n from vp p left join vr r on r.track_id = p.track_id and r.t > p.a and r.t < p.b where p.b > p.a group by 1, 2
), vc as (select track_id, count(*) as n_gaps, count(*) filter (n > 0) as n_bridged, sum(n) as n_bridge_frames from vi group by 1
) select e.track_id, 'grid' as method, coalesce(n_gaps, 0) as n_gaps, coalesce(n_bridged, 0) as n_bridged, cast(coalesce(n_bridge_frames, 0) as bigint) as n_bridge_frames, """ + rnd("100e0 * (1 - coalesce(n_bridged, 0) / greatest(coalesce(n_gaps, 0), 1))") + """ as gap_score
from ve e left join vc c using (track_id) where e.t1 > e.t0""")
def e22(spark, d):
    s = samples(spark, d)
    grid = T.resample(s, ["track_id"], "t", 20.0).withColumn("method", F.lit("grid"))
    g = segment_scores.gap_scores(s, grid).where("gap_score is not null")
    return g.select("track_id", "method", "n_gaps", "n_bridged", "n_bridge_frames", rounded("gap_score").alias("gap_score"))


@query("m20_bad_segments")
def m20(spark, d):
    rows = segmented(spark, d)[1]
    return fits.bad_segments(fits.fit_residuals(rows, fits.fit_segments(rows, ["piecewise_smooth"])), "accurate")


def medians(spark, d) -> DataFrame:
    """A render without a smoother: running medians at the samples' own times, in one segment a minute."""
    s = samples(spark, d)
    for c in (*compare.POS, *compare.VEL):
        s = T.rolling_median(s, ["track_id"], ["t"], c, 5, f"_{c}")
    return s.select("track_id", F.lit("median").alias("method"), F.floor(F.col("t") / 60).cast("long").alias("segment"), "t", *(F.col(f"_{c}").alias(c) for c in (*compare.POS, *compare.VEL)))


def _m5(c: str) -> str:
    return f"quantile_cont({c}, 0.5) over (partition by track_id order by t rows between 2 preceding and 2 following) as p_{c}"


_MEDIAN_SQL = SAMPLES_SQL + ", rm as (select *, " + ", ".join(_m5(c) for c in (*compare.POS, *compare.VEL)) + " from s)"


@query("e2_position_metrics", _MEDIAN_SQL + """, pe as (select *, p_x - x as dx, p_y - y as dy, p_z - z as dz, sqrt(vx * vx + vy * vy) as sp from rm)
select track_id, 'median' as method, count(*) as n_compared, """ + rnd("sqrt(avg(dx * dx + dy * dy))", 3) + " as horizontal_rmse, " + rnd("quantile_cont(sqrt(dx * dx + dy * dy), 0.95)", 3) + " as horizontal_p95, " + rnd("sqrt(avg(dz * dz))", 3) + " as vertical_rmse, "
    + rnd("max(sqrt(dx * dx + dy * dy + dz * dz))", 3) + " as position_max, " + rnd("sqrt(avg(case when sp > 5 then pow((dx * vx + dy * vy) / sp, 2) end))", 3) + " as along_rmse, " + rnd("sqrt(avg(case when sp > 5 then pow((dy * vx - dx * vy) / sp, 2) end))", 3) + " as cross_rmse, "
    + rnd("avg(dz)", 3) + " as vertical_mean from pe group by 1")
def e2(spark, d):
    m = compare.position_metrics(samples(spark, d), medians(spark, d))
    return m.select("track_id", "method", "n_compared", *(rounded(c, 3).alias(c) for c in ("horizontal_rmse", "horizontal_p95", "vertical_rmse", "position_max", "along_rmse", "cross_rmse", "vertical_mean")))


@query("e3_velocity_metrics", _MEDIAN_SQL + """, ve as (select *, p_vx - vx as dx, p_vy - vy as dy, p_vz - vz as dz, degrees(atan2(p_vx, p_vy)) - degrees(atan2(vx, vy)) + 180 as ang, sqrt(vx * vx + vy * vy) as sp, sqrt(p_vx * p_vx + p_vy * p_vy) as ps from rm)
select track_id, 'median' as method, """ + rnd("sqrt(avg(dx * dx + dy * dy))", 4) + " as velocity_rmse, " + rnd("sqrt(avg(pow(ps - sp, 2)))", 4) + " as speed_rmse, " + rnd("sqrt(avg(case when sp > 5 then pow(ang - 360e0 * floor(ang / 360e0) - 180, 2) end))", 4) + " as angle_rmse, " + rnd("sqrt(avg(dz * dz))", 4) + " as vertical_velocity_rmse from ve group by 1")
def e3(spark, d):
    return compare.velocity_metrics(samples(spark, d), medians(spark, d)).select("track_id", "method", *(rounded(c, 4).alias(c) for c in ("velocity_rmse", "speed_rmse", "angle_rmse", "vertical_velocity_rmse")))


def _w5(c: str) -> str:
    lag, lead, hs, hd = f"lag({c}) over w", f"lead({c}) over w", "(t - lag(t) over w)", "(lead(t) over w - t)"
    return f"coalesce(({hs} * {hs} * {lead} + ({hd} * {hd} - {hs} * {hs}) * {c} - {hd} * {hd} * {lag}) / ({hs} * {hd} * ({hs} + {hd})), ({lead} - {c}) / {hd}, ({c} - {lag}) / {hs})"


_W = " window w as (partition by track_id order by t)"
_MOTION_SQL = SAMPLES_SQL + ", ma as (select *, " + ", ".join(f"{_w5('v' + c)} as a{c}" for c in "xyz") + " from s" + _W + "), mj as (select *, " + ", ".join(f"{_w5('a' + c)} as j{c}" for c in "xyz") + " from ma" + _W + """
), mh as (select *, sqrt(ax * ax + ay * ay + az * az) as a, sqrt(jx * jx + jy * jy + jz * jz) as j, sqrt(vx * vx + vy * vy) as sp, atan2(vx, vy) as h, atan2(vx, vy) - lag(atan2(vx, vy)) over w + pi() as hw, min(t) over (partition by track_id) as t0, max(t) over (partition by track_id) as t1 from mj""" + _W + """
), mu as (select *, coalesce(hw - 2 * pi() * floor(hw / (2 * pi())) - pi(), 0) as hs from mh
), mv as (select *, first_value(h) over (partition by track_id order by t) + sum(hs) over (partition by track_id order by t rows unbounded preceding) as heading from mu
), mw as (select *, abs(degrees(""" + _w5("heading") + """)) as rate, t <= t0 + 10 or t >= t1 - 10 as ends from mv""" + _W + """
), mx as (select *, abs(degrees(atan2(sp * radians(rate), 9.80665e0))) as bank, sp >= 30 and z >= 30 as air from mw)"""


@query("e8_e13_motion_metrics", _MOTION_SQL + " select track_id, " + ", ".join(f"{rnd(e, 3)} as {n}" for n, e in {
    "accel_rms": "sqrt(avg(a * a))", "accel_p95": "quantile_cont(a, 0.95)", "jerk_rms": "sqrt(avg(j * j))", "jerk_p95": "quantile_cont(j, 0.95)", "speed_median": "quantile_cont(sp, 0.5)", "vertical_rate_p95": "quantile_cont(abs(vz), 0.95)",
    "turn_rate_p95": "quantile_cont(case when air then rate end, 0.95)", "bank_p95": "quantile_cont(case when air then bank end, 0.95)", "end_accel_ratio": "sqrt(avg(case when ends then a * a end)) / nullif(sqrt(avg(case when not ends then a * a end)), 0)",
}.items()) + ", count(*) filter (sp > 350) as violations_groundspeed, count(*) filter (abs(vz) > 35) as violations_vertical_rate, count(*) filter (a > 20) as violations_accel, count(*) filter (j > 20) as violations_jerk, count(*) filter (bank > 75) as violations_bank, count(*) filter (rate > 20) as violations_turn_rate from mx group by 1")
def e8(spark, d):
    own = samples(spark, d).withColumns({"method": F.lit("raw"), "segment": F.lit(0)})
    m = compare.motion_metrics(compare.motion(own))
    return m.select("track_id", *(rounded(c, 3).alias(c) for c in ("accel_rms", "accel_p95", "jerk_rms", "jerk_p95", "speed_median", "vertical_rate_p95", "turn_rate_p95", "bank_p95", "end_accel_ratio")), *(f"violations_{k}" for k in compare.ENVELOPE))


@query("e16_closure_metrics", SAMPLES_SQL + ", cl as (select *, " + ", ".join(f"{_w5(c)} - v{c} as d{c}" for c in "xyz") + " from s" + _W + ") select track_id, 'raw' as method, " + rnd("sqrt(avg(dx * dx + dy * dy + dz * dz))", 3) + " as velocity_closure_rmse, " + rnd("quantile_cont(sqrt(dx * dx + dy * dy + dz * dz), 0.95)", 3) + " as velocity_closure_p95 from cl group by 1")
def e16(spark, d):
    own = samples(spark, d).withColumns({"method": F.lit("raw"), "segment": F.lit(0)})
    return compare.derivative_closure(compare.motion(own)).select("track_id", "method", rounded("velocity_closure_rmse", 3).alias("velocity_closure_rmse"), rounded("velocity_closure_p95", 3).alias("velocity_closure_p95"))


@query("w12_track_gaps", SAMPLES_SQL + """, g0 as (select track_id, t as a, lead(t) over w as b from s window w as (partition by track_id order by t)
), g1 as (select *, b - a as d, quantile_cont(case when b - a > 0 then b - a end, 0.5) over (partition by track_id) as md from g0) select track_id, a, b from g1 where d > greatest(10e0, 5 * md)""")
def w12(spark, d):
    return compare.hard_gaps(samples(spark, d), ["track_id"], "t")


def evaluated(spark, d) -> DataFrame:
    s = staged(samples(spark, d), "samples")
    smooth = render.render_states(smoothing.smooth_ca(s, ("accurate", "smooth")), 1.0).select(*compare.KEYS, "segment", "t", *compare.POS, *compare.VEL, *compare.ACC)
    both = smooth.unionByName(medians(spark, d).withColumns({c: F.lit(None).cast("double") for c in compare.ACC}))
    frames = staged(both, "render")
    pair = frames.select(F.concat_ws("\x1f", *compare.KEYS).alias("track_id"), F.lit(1).alias("which"), "t", *compare.POS)
    own = s.join(frames.select(*compare.KEYS).distinct(), "track_id").select(F.concat_ws("\x1f", *compare.KEYS).alias("track_id"), F.lit(0).alias("which"), "t", *compare.POS)
    curves = staged(own.unionByName(pair), "curves")
    shapes = evaluation.hausdorff(curves).join(evaluation.dtw_mean(curves), "track_id").join(quality.frechet(curves), "track_id")
    shapes = shapes.select(*(F.element_at(F.split("track_id", "\x1f"), k + 1).alias(c) for k, c in enumerate(compare.KEYS)), "hausdorff", "symmetric", "dtw", "frechet")
    return compare.evaluate(s, frames, shapes, staged)


@query("e14_e23_evaluation")
def e23(spark, d):
    return evaluated(spark, d)


@query("a14_a17_dataset")
def a17(spark, d):
    """Methods that every flight has, by the weighted means of their metrics, ranked."""
    wide = staged(evaluated(spark, d), "metrics")
    whole = compare.aggregate_dataset(compare.require_all(compare.weighted_metrics(wide)), ["method"], "weight")
    return compare.rank(compare.score_methods(whole.select(F.lit("all").alias("data"), "method", "metric", "value"), ["data"]).select("data", "method", "overall").distinct(), ["data"], "overall")


@query("a15_weighted_dataset", _MEDIAN_SQL + """, pe as (select track_id, count(*) as n, sqrt(avg(pow(p_x - x, 2) + pow(p_y - y, 2))) as h, avg(p_z - z) as v from rm group by 1), lm as (
  select unnest(['horizontal_rmse', 'vertical_mean', 'n_compared']) as metric, unnest([h, v, n]) as value, n as weight from pe)
select 'median' as method, metric, count(*) as n_flights, """ + rnd("case when metric = 'n_compared' then sum(value) when metric = 'horizontal_rmse' then sqrt(sum(weight * value * value) / sum(weight)) else sum(weight * value) / sum(weight) end", 3) + " as value from lm group by 2")
def a15(spark, d):
    wide = compare.position_metrics(samples(spark, d), medians(spark, d))
    g = compare.aggregate_dataset(compare.weighted_metrics(wide, None, ["horizontal_rmse", "vertical_mean", "n_compared"]), ["method"], "weight")
    return g.select("method", "metric", "n_flights", rounded("value", 3).alias("value"))


_MINUTES_SQL = _MEDIAN_SQL + """, rr as (select track_id, t, p_x as x, p_y as y, p_z as z, p_vx as vx, p_vy as vy, p_vz as vz, cast(floor(t / 60) as bigint) as segment from rm
), ra as (select *, """ + ", ".join(f"{_w5('v' + c)} as a{c}" for c in "xyz") + " from rr" + _W + "), rj as (select *, " + ", ".join(f"{_w5('a' + c)} as j{c}" for c in "xyz") + " from ra" + _W + """
), gg as (select track_id, t as a, lead(t) over (partition by track_id order by t) as b from s)"""


@query("e12_gap_behavior", _MINUTES_SQL + """, ga as (select * from gg where b - a > 10), mid as (select track_id, (a + b) / 2 as t, a, b from ga
), pt as (select ga.track_id, sqrt(ax * ax + ay * ay + az * az) as acc, sqrt(jx * jx + jy * jy + jz * jz) as jrk from ga join rj on rj.track_id = ga.track_id and rj.t > ga.a and rj.t < ga.b)
select tk.track_id, 'median' as method, coalesce((select count(*) from ga where ga.track_id = tk.track_id), 0) as n_long_gaps, coalesce((select count(*) from pt where pt.track_id = tk.track_id), 0) as n_gap_frames,
  """ + rnd("coalesce((select quantile_cont(acc, 0.95) from pt where pt.track_id = tk.track_id), 0)", 4) + " as gap_accel_p95, " + rnd("coalesce((select quantile_cont(jrk, 0.95) from pt where pt.track_id = tk.track_id), 0)", 4) + " as gap_jerk_p95 from (select distinct track_id from rr) tk")
def e12(spark, d):
    """Of samples every third of which is kept, so that the render of all has frames inside their gaps."""
    r = medians(spark, d)
    g = compare.gap_behavior(samples(spark, d), compare.motion(r.select(*compare.KEYS, "segment", "t", *compare.POS, *compare.VEL)))
    return g.select("track_id", "method", "n_long_gaps", "n_gap_frames", rounded("gap_accel_p95", 4).alias("gap_accel_p95"), rounded("gap_jerk_p95", 4).alias("gap_jerk_p95"))


def _mad_sql(c: str) -> str:
    return f"case when 1.4826e0 * quantile_cont(abs(d_{c} - m_{c}), 0.5) > 1.4826e-12 then 1.4826e0 * quantile_cont(abs(d_{c} - m_{c}), 0.5) else stddev_pop(d_{c}) end as s_{c}"


@query("e15_difference_evidence", _MEDIAN_SQL + ", rg as (select *, t - lag(t) over w as back, lead(t) over w - t as ahead, " + ", ".join(f"{_w5(c)} as r{c}" for c in "xyz") + " from rm" + _W + """
), rl as (select *, greatest(10e0, 4 * coalesce(quantile_cont(case when back > 0 then back end, 0.5) over (partition by track_id), 1)) as lim from rg
), rd as (select *, case when not (coalesce(back > lim, false) or coalesce(ahead > lim, false)) then sqrt(pow(p_vx - rx, 2) + pow(p_vy - ry, 2) + pow(p_vz - rz, 2)) end as d, sqrt(p_vx * p_vx + p_vy * p_vy) as ms, sqrt(rx * rx + ry * ry) as rs, p_vz as mz from rl
), re as (select *, """ + ", ".join(f"{c} - lag({c}) over w as d_{c}" for c in ("ms", "rs", "mz", "rz")) + " from rd" + _W + "), rf as (select *, " + ", ".join(f"quantile_cont(d_{c}, 0.5) over (partition by track_id) as m_{c}" for c in ("ms", "rs", "mz", "rz")) + """ from re
), rh as (select track_id, count(*) as n, case when count(d) >= 3 then sqrt(avg(d * d)) end as e, """ + ", ".join(_mad_sql(c) for c in ("ms", "rs", "mz", "rz")) + """ from rf group by 1)
select track_id, 'median' as method, """ + rnd("e", 4) + " as difference_rmse, " + rnd("case when n >= 8 and s_rs >= 1e-9 then s_ms / s_rs end", 4) + " as speed_detail, " + rnd("case when n >= 8 and s_rz >= 1e-9 then s_mz / s_rz end", 4) + " as vertical_detail from rh")
def e15(spark, d):
    g = compare.difference_evidence(samples(spark, d), medians(spark, d))
    return g.select("track_id", "method", *(rounded(c, 4).alias(c) for c in ("difference_rmse", "speed_detail", "vertical_detail")))


@query("w21_viewer_segments", _MINUTES_SQL + """, ri as (select *, row_number() over (partition by track_id order by t) - 1 as i from rr)
select track_id, 'median' as method, row_number() over (partition by track_id order by segment) as run, segment, cast(min(i) as bigint) as first_index, cast(max(i) as bigint) as last_index, min(t) as t0, max(t) as t1, count(*) as n from ri group by track_id, segment""")
def w21(spark, d):
    return render.viewer_segments(medians(spark, d), compare.KEYS).withColumns({c: F.col(c).cast("long") for c in ("first_index", "last_index")})


@query("w23_changes_per_minute", SAMPLES_SQL + """, dc as (select track_id, t, vx * lag(vx) over w + vy * lag(vy) over w + vz * lag(vz) over w as dp, sqrt(vx * vx + vy * vy + vz * vz) * sqrt(pow(lag(vx) over w, 2) + pow(lag(vy) over w, 2) + pow(lag(vz) over w, 2)) as nn from s window w as (partition by track_id order by t))
select track_id, count(*) filter (nn > 1e-12 and dp / nn < 0.9e0) as n_changes, """ + rnd("count(*) filter (nn > 1e-12 and dp / nn < 0.9e0) / nullif((max(t) - min(t)) / 60e0, 0)") + " as changes_per_minute from dc group by 1")
def w23(spark, d):
    """Velocities that turn by more than about 26 degrees from row to row."""
    g = T.direction_changes(samples(spark, d), ["track_id"], "t", list(compare.VEL), 0.9)
    return g.select("track_id", "n_changes", rounded("changes_per_minute").alias("changes_per_minute"))


@query("e18_join_metrics", _MINUTES_SQL + """, gl as (select *, quantile_cont(case when b - a > 0 then b - a end, 0.5) over (partition by track_id) as md from gg), hg as (select track_id, a, b from gl where b - a > greatest(10e0, 5 * coalesce(md, 1))
), jn as (select track_id, t, lag(t) over w as lo, segment <> lag(segment) over w as new, sqrt(""" + " + ".join(f"pow({c} - lag({c}) over w - 0.5e0 * (v{c} + lag(v{c}) over w) * greatest(t - lag(t) over w, 1e-6), 2)" for c in "xyz") + ") as cl, sqrt("
    + " + ".join(f"pow(v{c} - lag(v{c}) over w, 2)" for c in "xyz") + ") as dv, sqrt(" + " + ".join(f"pow(a{c} - lag(a{c}) over w, 2)" for c in "xyz") + """) as da from ra window w as (partition by track_id order by t)
), jh as (select *, t - lo > 10 or exists (select 1 from hg where hg.track_id = jn.track_id and hg.b > jn.lo and hg.a < jn.t) as hard from jn where new)
select track_id, 'median' as method, count(*) filter (not hard) as n_joins, count(*) filter (hard) as n_hard_joins, """ + ", ".join(rnd(f"quantile_cont({c}, 0.95) filter (not hard)", 4) + f" as {n}" for c, n in (("cl", "join_closure_p95"), ("dv", "join_velocity_p95"), ("da", "join_accel_p95"))) + " from jh group by 1")
def e18(spark, d):
    m = compare.motion(medians(spark, d))
    j = compare.join_metrics(samples(spark, d), m)
    return j.select("track_id", "method", "n_joins", "n_hard_joins", *(rounded(c, 4).alias(c) for c in ("join_closure_p95", "join_velocity_p95", "join_accel_p95")))


@query("e17_dynamic_metrics", _MOTION_SQL + ", sn as (select *, " + ", ".join(f"{_w5('j' + c)} as s{c}" for c in "xyz") + " from mx" + _W + """), so as (select *, sqrt(sx * sx + sy * sy + sz * sz) as snap, j / greatest(sqrt(vx * vx + vy * vy + vz * vz), case when sp >= 30 or z >= 30 then 35e0 else 6e0 end) as calm from sn)
select track_id, """ + ", ".join(f"{rnd(e, 4)} as {n}" for n, e in {"calm_rms": "sqrt(avg(calm * calm))", "calm_p95": "quantile_cont(calm, 0.95)", "snap_rms": "sqrt(avg(snap * snap))", "snap_p95": "quantile_cont(snap, 0.95)", "turn_all_p95": "quantile_cont(rate, 0.95)", "bank_all_p95": "quantile_cont(bank, 0.95)"}.items()) + " from so group by 1")
def e17(spark, d):
    own = samples(spark, d).withColumns({"method": F.lit("raw"), "segment": F.lit(0)})
    m = compare.motion_metrics(compare.motion(own))
    return m.select("track_id", *(rounded(c, 4).alias(c) for c in ("calm_rms", "calm_p95", "snap_rms", "snap_p95", "turn_all_p95", "bank_all_p95")))


def _quintic_sql(c: str) -> str:
    """Value, velocity and acceleration at share u of a step h between two states, of the quintic that meets both."""
    h = "(b.t - a.t)"
    c0, c1, c2 = f"a.{c}", f"a.v{c} * {h}", f"0.5e0 * a.a{c} * {h} * {h}"
    d0, d1, d2 = f"(b.{c} - ({c0}) - ({c1}) - ({c2}))", f"(b.v{c} * {h} - ({c1}) - 2 * ({c2}))", f"(b.a{c} * {h} * {h} - 2 * ({c2}))"
    c3, c4, c5 = f"(10 * {d0} - 4 * {d1} + 0.5e0 * {d2})", f"(-15 * {d0} + 7 * {d1} - {d2})", f"(6 * {d0} - 3 * {d1} + 0.5e0 * {d2})"
    value = f"({c0}) + ({c1}) * u + ({c2}) * u * u + {c3} * pow(u, 3) + {c4} * pow(u, 4) + {c5} * pow(u, 5)"
    slope = f"(({c1}) + 2 * ({c2}) * u + 3 * {c3} * u * u + 4 * {c4} * pow(u, 3) + 5 * {c5} * pow(u, 4)) / {h}"
    return f"{rnd(value, 3)} as {c}, {rnd(slope, 4)} as v{c}"


@query("k3_evaluated_states", SAMPLES_SQL + ", st as (select track_id, i, t - 1704067200 as t, x, y, z, vx, vy, vz, " + ", ".join(f"{_w5('v' + c)} as a{c}" for c in "xyz") + " from s" + _W + """
), ab as (select a.track_id, a, b, unnest([0.2371e0, 0.6113e0, 0.8717e0]) as u from st a join st b on b.track_id = a.track_id and b.i = a.i + 1)
select track_id, """ + rnd("a.t + u * (b.t - a.t)", 6) + " as t, " + ", ".join(_quintic_sql(c) for c in "xyz") + " from ab")
def k3(spark, d):
    """States of the samples with differentiated acceleration, at three places of each step; times from the epoch of the data, so that shares keep their digits."""
    s = samples(spark, d).withColumn("t", F.col("t") - M.EPOCH)
    s = compare.gradients(s, ["track_id"], "t", {f"v{c}": f"a{c}" for c in "xyz"}, fill=False)
    w = Window.partitionBy("track_id").orderBy("t")
    asked = s.select("track_id", F.col("t").alias("_a"), F.lead("t").over(w).alias("_b")).where("_b is not null")
    asked = asked.select("track_id", F.explode(F.transform(F.array(*map(F.lit, (0.2371, 0.6113, 0.8717))), lambda u: F.col("_a") + u * (F.col("_b") - F.col("_a")))).alias("t"))
    got = render.evaluate_states(s, asked, ["track_id"])
    return got.select("track_id", rounded("t").alias("t"), *(rounded(c, 3).alias(c) for c in compare.POS), *(rounded(c, 4).alias(c) for c in compare.VEL))


@query("x5_resampled", SAMPLES_SQL + """, sz as (select track_id, t - 1704067200 as t, x, z from s), ve as (select track_id, min(t) as t0, max(t) as t1, cast(floor((max(t) - min(t)) / 17.37e0 + 1e-9) as bigint) as n from sz group by 1
), vr as (select track_id, t0 + k * 17.37e0 as t from (select *, unnest(generate_series(0, n)) as k from ve) union all select track_id, t1 from ve where t0 + n * 17.37e0 < t1 - 1e-9
), ap as (select vr.track_id, vr.t, a.t as t_a, a.x as ax, a.z as az from vr asof join sz a on a.track_id = vr.track_id and vr.t >= a.t
), bp as (select ap.*, b.t as t_b, b.x as bx, b.z as bz from ap asof join sz b on b.track_id = ap.track_id and ap.t <= b.t)
select track_id, t, """ + rnd("case when t_b = t_a then ax else ax + (bx - ax) * (t - t_a) / (t_b - t_a) end", 6) + " as x, " + rnd("case when t_b = t_a then az else az + (bz - az) * (t - t_a) / (t_b - t_a) end", 6) + " as z from bp")
def x5(spark, d):
    """Tracks on a grid of 17.37 s by the table function, from SQL; times from the epoch of the data."""
    register_tables(spark)
    got = spark.sql("select * from resampled(table({rows}), 17.37d)", rows=samples(spark, d).select("track_id", (F.col("t") - M.EPOCH).alias("t"), "x", "z"))
    return got.select("track_id", "t", rounded("x").alias("x"), rounded("z").alias("z"))


@query("x5_spool_records", "select user_id // 10 as source, count(*) as n, cast(sum(event_id) as bigint) as events, count(*) filter (event_id % 2 = 1) as n_odd from events group by 1")
def x5_spool(spark, d):
    """Events as binary spools by source, read with LATERAL."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("source", F.floor(F.col("user_id") / 10))
    record = F.concat(F.lpad(F.hex("event_id"), 8, "0"), F.lit("000000000000"), F.lpad(F.hex(F.col("event_id") % 2), 2, "0"), F.lit("3208"), F.lpad(F.hex("event_id"), 16, "0"))
    spools = e.groupBy("source", F.floor(F.col("event_id") / 5000).alias("day")).agg(F.unhex(F.array_join(F.sort_array(F.collect_list(record)), "")).alias("content"))
    register_tables(spark)
    got = spark.sql("select source, s.* from {spools} as f, lateral spool_records(f.content) as s where not s.torn", spools=spools)
    return got.groupBy("source").agg(F.count("*").alias("n"), F.sum("ts_utc").alias("events"), F.count_if(F.col("signal") == 1).alias("n_odd"))


@query("a23_sketched_quantiles", "select distinct l_suppkey, unnest([0.1e0, 0.5e0, 0.99e0]) as q, true as within from lineitem where l_quantity > 0")
def a23(spark, d):
    """Weighted quantiles by summaries: whether the exact share of weight below and up to each is within 1 % of what was asked."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_extendedprice", "l_quantity")
    got = None
    for q in (0.1, 0.5, 0.99):
        one = sketch.weighted_quantile(li, ["l_suppkey"], "l_extendedprice", "l_quantity", q, approximate=True, entries=200).withColumn("q", F.lit(q))
        got = one if got is None else got.unionByName(one)
    j = li.join(got, "l_suppkey")
    share = lambda c: F.sum(F.when(c, F.col("l_quantity")).otherwise(0.0)) / F.sum("l_quantity")
    x, wanted = F.col("l_extendedprice"), F.col("wq_l_extendedprice")
    return j.groupBy("l_suppkey", "q").agg(share(x < wanted).alias("low"), share(x <= wanted).alias("high")).select("l_suppkey", "q", ((F.col("low") <= F.col("q") + 0.01) & (F.col("high") >= F.col("q") - 0.01)).alias("within"))


_METRIC = "select l_returnflag as data, cast(l_linenumber as varchar) as method, metric, avg(value) as value from (select l_returnflag, l_linenumber, unnest(['accel_rms', 'jerk_rms', 'dtw']) as metric, unnest([l_quantity, l_discount, l_tax]) as value from lineitem) group by all"


def line_metrics(spark, d) -> DataFrame:
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    g = li.groupBy(F.col("l_returnflag").alias("data"), F.col("l_linenumber").cast("string").alias("method")).agg(F.avg("l_quantity").alias("accel_rms"), F.avg("l_discount").alias("jerk_rms"), F.avg("l_tax").alias("dtw"))
    return g.unpivot(["data", "method"], ["accel_rms", "jerk_rms", "dtw"], "metric", "value")


@query("a14_group_scores", f"""with m as ({_METRIC}), w as (select *, value / quantile_cont(value, 0.5) over (partition by data, metric) as v, case when metric = 'dtw' then 'shape' else 'smoothness' end as metric_group from m
), g as (select data, method, metric_group, avg(v) as score, count(*) as n_metrics, case when metric_group = 'shape' then 1e0 else 2e0 end as weight from w group by all)
select data, method, metric_group, """ + rnd("score") + " as score, n_metrics, " + rnd("sum(score * weight) over (partition by data, method) / sum(weight) over (partition by data, method)") + " as overall from g")
def a14(spark, d):
    s = compare.score_methods(line_metrics(spark, d), ["data"])
    return s.select("data", "method", "metric_group", rounded("score").alias("score"), "n_metrics", rounded("overall").alias("overall"))


@query("w20_metric_winners", f"""with m as ({_METRIC}), r as (select *, row_number() over w as r, lead(value) over w as second from m window w as (partition by data, metric order by value, method))
select data, metric, method as winner, {rnd("value", 9)} as best, {rnd("second", 9)} as second, {rnd("second - value", 9)} as margin from r where r = 1""")
def w20(spark, d):
    return compare.metric_winners(line_metrics(spark, d), ["data"]).select("data", "metric", "winner", *(rounded(c, 9).alias(c) for c in ("best", "second", "margin")))


@query("a17_coverage", f"with m as ({_METRIC}) select method, count(distinct data) as n_flights, array_to_string(list_sort(list(distinct data)), ',') as flights, count(distinct data) / (select count(distinct data) from m) as share from m group by 1")
def a17_coverage(spark, d):
    return compare.method_coverage(line_metrics(spark, d), "data").select("method", "n_flights", F.array_join("flights", ",").alias("flights"), "share")


_REASON_SQL = " select *, case when l_linenumber = 1 then 'hard_gap_between' when l_linenumber = 2 then 'go_around_transition' when l_linenumber = 3 then 'surveillance_discontinuity' else 'energy_state_transition' end as r, case when l_quantity < 10 then 'ground_slow' when l_quantity < 25 then 'descent__turn_left_slow' else 'energy_constant' end as label from lineitem"


@query("p28_p29_policies", f"""with a as ({_REASON_SQL}), b as (select *, case when r like '%hard_gap%' then 'hard_gap' when r like '%go_around%' then 'go_around' when r like '%surveillance%' then 'surveillance_or_track_discontinuity' else 'normal_segment_join' end as event,
  case when label like '%ground%' or l_extendedprice / 500e0 < 20 then 'ground' when label like '%descent%' then 'approach_final' else 'airborne' end as bucket,
  case when l_extendedprice / 500e0 < 25 or label = 'ground_slow' then 'ground_slow' when l_partkey % 60 > greatest(20e0, 0.45e0 * greatest(l_extendedprice / 500e0, 1)) then label || '__surveillance_noisy' else label end as regime from a)
select event, r <> 'energy_state_transition' as parts, bucket, case bucket when 'ground' then 5e0 when 'approach_final' then 45e0 else 35e0 end as floor, regime, count(*) as n from b group by all""")
def p28(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    r = F.array(F.when(F.col("l_linenumber") == 1, "hard_gap_between").when(F.col("l_linenumber") == 2, "go_around_transition").when(F.col("l_linenumber") == 3, "surveillance_discontinuity").otherwise("energy_state_transition"))
    label = F.when(F.col("l_quantity") < 10, "ground_slow").when(F.col("l_quantity") < 25, "descent__turn_left_slow").otherwise("energy_constant")
    speed, no = F.col("l_extendedprice") / 500.0, F.lit(False)
    bucket = S.regime_bucket(label, speed)
    x = li.select(S.boundary_event_bucket(r, no).alias("event"), S.is_true_discontinuity(r, no).alias("parts"), bucket.alias("bucket"), S.speed_floor(bucket, F.lit("balanced")).alias("floor"), S.classify_regime(speed, (F.col("l_partkey") % 60).cast("double"), label).alias("regime"))
    return x.groupBy("event", "parts", "bucket", "floor", "regime").agg(F.count("*").alias("n"))


@query("p25_score_low", "select l_orderkey, l_linenumber, " + rnd("case when l_quantity <= 10 then 100e0 when l_quantity >= 40 then 0e0 else 100e0 * (40 - l_quantity) / 30e0 end") + " as score from lineitem")
def p25(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", rounded(S.score_low(F.col("l_quantity"), 10, 40)).alias("score"))


@query("p5_p20_motion_columns", MESSAGES_SQL + ", v as (select *, cast(json_extract_string(decoded_json, '$.velocity_raw[2]') as double) as fpm, gs * 0.514444e0 * sin(radians(track)) as e, gs * 0.514444e0 * cos(radians(track)) as n from m) select raw_id, fpm, " + rnd("fpm * 0.3048e0 / 60e0") + " as mps, " + rnd("degrees(atan2(e, n)) - 360e0 * floor(degrees(atan2(e, n)) / 360e0)", 4) + " as heading, " + rnd("lat + degrees(n / 6371000e0)", 7) + " as lat2 from v where gs is not null")
def p5(spark, d):
    m = messages(spark, d).where("gs is not null")
    e, n = S.enu_velocity(F.col("gs"), F.col("track"))
    none = F.lit(None).cast("double")
    fpm, mps = S.fill_vertical_rate(none, none, F.col("decoded_json"))
    lat, _ = S.offset_lat_lon(F.col("lat"), F.col("lon"), e, n)
    return m.select("raw_id", fpm.alias("fpm"), rounded(mps).alias("mps"), rounded(S.heading_from_velocity(e, n), 4).alias("heading"), rounded(lat, 7).alias("lat2"))


@query("x3_sql_functions", MESSAGES_SQL + " select raw_id, " + rnd("2e0 * 6371.0088e0 * asin(sqrt(pow(sin(radians(lat - 56.923611e0) / 2), 2) + cos(radians(56.923611e0)) * cos(radians(lat)) * pow(sin(radians(lon - 23.971111e0) / 2), 2)))") + " as km, round_even(ts_utc / 2e0, 0) * 2e0 as bucket from m where lat is not null")
def x3(spark, d):
    S.register_sql(spark)
    return messages(spark, d).where("lat is not null").select("raw_id", rounded(F.expr("haversine_km(56.923611D, 23.971111D, lat, lon)")).alias("km"), F.expr("bucket_time(ts_utc, 2D)").alias("bucket"))


@query("f11_all_checks", KEYFRAMES_SQL + """ select paired_first, case when paired_first and not paired then 'not paired' when not full_position then 'no full position' when not full_velocity then 'no full velocity' else 'used' end as skip_reason, count(*) as n
from kf, (select unnest([true, false]) as paired_first) group by 1, 2""")
def f11(spark, d):
    """With the flag asked first, and with each part asked for itself."""
    k = keyframes(spark, d)
    both = prepare.skip_reason(k).withColumn("paired_first", F.lit(True)).unionByName(prepare.skip_reason(k, False).withColumn("paired_first", F.lit(False)))
    return both.groupBy("paired_first", F.coalesce("skip_reason", F.lit("used")).alias("skip_reason")).agg(F.count("*").alias("n"))


_FILTERED_SQL = EVENTS_SQL + """, pp as (select *, last_value(case when lat is not null then struct_pack(t := ts_utc, la := lat, lo := lon) end ignore nulls) over w as p, last_value(case when ve is not null then struct_pack(t := ts_utc, e := ve, n := vn, z := vz) end ignore nulls) over w as q
  from e window w as (partition by track_id order by ts_utc, raw_id rows between unbounded preceding and 1 preceding)
), pd as (select *, case when lat is not null and ts_utc - p.t > 0 then 2e0 * 6371.0088e0 * asin(sqrt(pow(sin(radians(lat - p.la) / 2), 2) + cos(radians(p.la)) * cos(radians(lat)) * pow(sin(radians(lon - p.lo) / 2), 2))) / (ts_utc - p.t) * 3600 end as speed,
  case when ve is not null and ts_utc - q.t > 0 then sqrt(pow(ve - q.e, 2) + pow(vn - q.n, 2) + pow(coalesce(abs(vz - q.z), 0), 2)) / (ts_utc - q.t) end as accel,
  2e0 * 6371.0088e0 * asin(sqrt(pow(sin(radians(lat - 56.923611e0) / 2), 2) + cos(radians(56.923611e0)) * cos(radians(lat)) * pow(sin(radians(lon - 23.971111e0) / 2), 2))) as km from pp
), pq as (select track_id, quantile_cont(speed, 0.25) as s1, quantile_cont(speed, 0.75) as s3, count(speed) as sn, quantile_cont(accel, 0.25) as a1, quantile_cont(accel, 0.75) as a3, count(accel) as an from pd group by 1
), pb as (select pd.*, coalesce(km > 90, false) as o_distance, coalesce(sn >= 4 and s3 > s1 and speed > s3 + 3 * (s3 - s1), false) as o_speed, coalesce(an >= 4 and a3 > a1 and accel > a3 + 3 * (a3 - a1), false) as o_accel from pd join pq using (track_id))"""


@query("f7_kinematic_outliers", _FILTERED_SQL + " select raw_id from pb where not (o_speed or o_accel)")
def f7(spark, d):
    return prepare.filter_kinematic_outliers(events(spark, d)).select("raw_id")


@query("a4_outlier_report", _FILTERED_SQL + """ select track_id, test, count(*) filter (o) as n, count(*) filter (s) as denominator, """ + rnd("count(*) filter (o) / nullif(count(*) filter (s), 0)") + """ as fraction from (
  select track_id, unnest(['distance', 'speed', 'accel', 'any']) as test, unnest([o_distance, o_speed, o_accel, o_distance or o_speed or o_accel]) as o, unnest([lat is not null, lat is not null, ve is not null, true]) as s from pb) group by 1, 2""")
def a4_outliers(spark, d):
    return prepare.outlier_report(events(spark, d)).select("track_id", "test", "n", "denominator", rounded("fraction").alias("fraction"))


@query("a4_normalize_report", KEYFRAMES_SQL + """, ra as (select track_id, count(*) as n_raw from m group by 1), fb as (select track_id, count(*) as n_filtered, count(*) filter (kind = 'position') as n_position, count(*) filter (kind = 'velocity') as n_velocity, count(*) filter (kind = 'position_velocity') as n_position_velocity from e group by 1
), kc as (select track_id, count(*) as n_keyframes, count(*) filter (paired) as n_paired from kf group by 1)
select track_id, n_raw, coalesce(n_filtered, 0) as n_filtered, coalesce(n_position, 0) as n_position, coalesce(n_velocity, 0) as n_velocity, coalesce(n_position_velocity, 0) as n_position_velocity, coalesce(n_keyframes, 0) as n_keyframes, coalesce(n_paired, 0) as n_paired,
  """ + rnd("n_paired / nullif(n_keyframes, 0)") + " as paired_share from ra left join fb using (track_id) left join kc using (track_id)")
def a4_normalized(spark, d):
    ev = events(spark, d)
    r = prepare.normalize_report(messages(spark, d), ev, prepare.build_keyframes(ev))
    return r.withColumn("paired_share", rounded("paired_share"))


@query("w3_recomputed_diagnostics", _FILTERED_SQL + """, kp as (select *, max(lat is not null) over (partition by track_id order by ts_utc, raw_id rows unbounded preceding) as seen from pb where not (o_speed or o_accel)
), k2 as (select track_id, ts_utc, lat, lon, last_value(case when lat is not null then struct_pack(t := ts_utc, la := lat, lo := lon) end ignore nulls) over (partition by track_id order by ts_utc, raw_id rows between unbounded preceding and 1 preceding) as p2 from kp where seen
), k3 as (select track_id, case when ts_utc - p2.t > 0 then 2e0 * 6371.0088e0 * asin(sqrt(pow(sin(radians(lat - p2.la) / 2), 2) + cos(radians(p2.la)) * cos(radians(lat)) * pow(sin(radians(lon - p2.lo) / 2), 2))) / (ts_utc - p2.t) * 3600 end as speed from k2 where lat is not null)
select track_id, count(*) as n, """ + rnd("quantile_cont(speed, 0.5)", 4) + " as median_speed, " + rnd("max(speed)", 4) + " as most_speed from k3 group by 1")
def w3(spark, d):
    """Position diagnostics after the outliers of the first diagnostics and the rows before the first position are gone."""
    _, p, _ = prepare.prepared(events(spark, d))
    return p.groupBy("track_id").agg(F.count("*").alias("n"), rounded(F.percentile("speed_kmh", 0.5), 4).alias("median_speed"), rounded(F.max("speed_kmh"), 4).alias("most_speed"))


@query("t5_selected_flights", MESSAGES_SQL + ", al as (select distinct track_id, upper(icao) as icao from m) select track_id, icao from al where track_id in (select min(track_id) from al) or icao in (select max(icao) from al)")
def t5(spark, d):
    """The first track by its name, and the last one by its address."""
    table = staged(M.rule_table(spark, d).select("track_id", "icao"), "rules")
    first = table.agg(F.min("track_id").alias("a"), F.max("icao").alias("b")).first()
    return compare.selected_flights(table, [f" {first.a.lower()}", first.b])


def _pass_sql(n: int) -> str:
    """One pass of F12: rows r{n} -> r{n + 1}."""
    w, part = "over (partition by track_id order by t)", "partition by track_id"
    limit = f"greatest(1200e0, 5e0 * greatest((sp + lag(sp) {w}) / 2, 1e0))"
    return f""", pa{n} as (select *, sqrt(vx * vx + vy * vy + vz * vz) as sp, sqrt(pow(x - lag(x) {w}, 2) + pow(y - lag(y) {w}, 2) + pow(z - lag(z) {w}, 2)) / (t - lag(t) {w}) as step from r{n}
), pb{n} as (select *, step > {limit} as bad, step / {limit} as q from pa{n}
), pc{n} as (select *, lead(bad) {w} as nxt, lead(bad, 2) {w} as aft, lag(bad) {w} as bef, greatest(coalesce(q, 0), coalesce(lead(q) {w}, 0)) as worst from pb{n}
), pd{n} as (select *, coalesce(bad and nxt, false) or coalesce(bad is null and nxt and not coalesce(aft, false), false) or coalesce(nxt is null and bad and not coalesce(bef, false), false) as o from pc{n}
), pe{n} as (select *, count(*) over ({part}) as n, bool_or(o) over ({part}) as hit, row_number() over ({part} order by o desc, worst desc, t) as place from pd{n}
), r{n + 1} as (select track_id, t, x, y, z, vx, vy, vz, i from pe{n} where not case when hit then o and place <= n - 8 else place = 1 and worst > 1 and n - 8 >= 1 end)"""


@query("f12_filtered_samples", SAMPLES_SQL + ", r0 as (select * from s)" + "".join(map(_pass_sql, range(4))) + " select track_id, i, t, " + ", ".join(f"{rnd(c)} as {c}" for c in ("x", "y", "z", "vx", "vy", "vz")) + " from r4")
def f12(spark, d):
    return quality.filter_motion_outliers(samples(spark, d)).select("track_id", "i", "t", *(rounded(c).alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")))


_FLAT = {
    "lat": 9, "lon": 9, "x_m": 3, "y_m": 3, "distance_km": 6, "alt_ft": 4, "alt_m": 4, "height_m": 4, "height_shown_m": 4, "east_mps": 6, "north_mps": 6, "up_mps": 6, "vertical_rate_fpm": 4, "ground_speed": 6, "ground_speed_kt": 6,
    "reported_gs": 6, "track_deg": 5, "track_rad": 6, "acc_east": 6, "acc_north": 6, "acc_up": 6, "acc_horizontal": 6, "acc_vertical": 6, "acc_size": 6,
}
_PLAIN = (
    "track_id", "keyframe_id", "t_iso", "event_kind", "mixed_kind", "source_kinds", "event_kinds", "row_ids", "n_rows", "first_raw_id", "last_raw_id", "altitude_source", "on_ground", "field_ft", "height_reference", "height_reference_source",
    "has_vertical", "n_position", "n_velocity", "n_velocity_3d", "position_formed", "velocity_formed", "acc_source", "acc_observed", "full_position", "full_velocity", "paired",
)


@query("a3_flat_keyframes", KEYFRAMES_SQL + f""", rg as (select track_id, bucket as t, list(kind order by ts_utc, raw_id) as ks, list(raw_id order by raw_id) as ids, avg(gs) filter (ve is not null) as reported_gs, count(*) filter (ve is not null and vz is not null) as n_velocity_3d,
  avg(2e0 * 6371.0088e0 * asin(sqrt(pow(sin(radians(lat - 56.923611e0) / 2), 2) + cos(radians(56.923611e0)) * cos(radians(lat)) * pow(sin(radians(lon - 23.971111e0) / 2), 2)))) filter (lat is not null and lon is not null) as distance_km from e group by 1, 2
), kj as (select kf.*, rg.* exclude (track_id, t) from kf join rg using (track_id, t)
), kg as (select *, 6378137e0 / sqrt(1 - 0.0066943799901413165e0 * pow(sin(radians(lat)), 2)) as cu, 6378137e0 / sqrt(1 - 0.0066943799901413165e0 * pow(sin(radians(56.923611e0)), 2)) as cr, radians(56.923611e0) as la, radians(23.971111e0) as lo,
  lag(case when ve is not null then struct_pack(t := t, ve := ve, vn := vn, vz := vz) end ignore nulls) over (partition by track_id order by t) as p from kj
), kx as (select *, cu * cos(radians(lat)) * cos(radians(lon)) - cr * cos(la) * cos(lo) as gx, cu * cos(radians(lat)) * sin(radians(lon)) - cr * cos(la) * sin(lo) as gy, (1 - 0.0066943799901413165e0) * (cu * sin(radians(lat)) - cr * sin(la)) as gz,
  ve is not null and t - p.t > 0 and t - p.t <= 10 as near from kg
), ka as (select *, case when near then (ve - p.ve) / (t - p.t) end as ae, case when near then (vn - p.vn) / (t - p.t) end as an, case when near then (vz - p.vz) / (t - p.t) end as az, degrees(atan2(ve, vn)) as dg from kx
), fl as (select * exclude (kinds), strftime(to_timestamp(t) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') as t_iso, case when list_contains(ks, 'position_velocity') or list_contains(ks, 'position') and list_contains(ks, 'velocity') then 'position_velocity' else ks[1] end as mixed_kind,
  list_reduce(ks, lambda a, b: case when contains(',' || a || ',', ',' || b || ',') then a else a || ',' || b end) as source_kinds, cast(to_json(ks) as varchar) as event_kinds, cast(to_json(ids) as varchar) as row_ids, cast(len(ids) as int) as n_rows, ids[1] as first_raw_id, ids[-1] as last_raw_id,
  -sin(lo) * gx + cos(lo) * gy as x_m, -sin(la) * cos(lo) * gx - sin(la) * sin(lo) * gy + cos(la) * gz as y_m, alt as alt_ft, alt * 0.3048e0 as alt_m, (alt - 36e0) * 0.3048e0 as height_m, case when alt is not null then greatest((alt - 36e0) * 0.3048e0, 0e0) end as height_shown_m,
  case when n_position > 0 then case when alt is not null then 'reported' else 'missing' end end as altitude_source, case when n_position > 0 then false end as on_ground, 36e0 as field_ft, 'field' as height_reference, 'rule' as height_reference_source,
  ve as east_mps, vn as north_mps, vz as up_mps, vz / 0.3048e0 * 60 as vertical_rate_fpm, case when ve is not null then vz is not null end as has_vertical, sqrt(ve * ve + vn * vn) as ground_speed, sqrt(ve * ve + vn * vn) / 0.514444e0 as ground_speed_kt,
  dg - 360 * floor(dg / 360) as track_deg, radians(dg - 360 * floor(dg / 360)) as track_rad, case when n_position > 0 then 'mean of rows' end as position_formed, case when ve is not null then 'mean vector of rows' end as velocity_formed,
  ae as acc_east, an as acc_north, az as acc_up, sqrt(ae * ae + an * an) as acc_horizontal, abs(az) as acc_vertical, sqrt(ae * ae + an * an + coalesce(az * az, 0)) as acc_size,
  case when ve is null then null when p is null then 'first' when t - p.t > 10 then 'too long' else 'change of velocity' end as acc_source, false as acc_observed from ka)
select {", ".join(_PLAIN)}, {", ".join(f"{rnd(c, k)} as {c}" for c, k in _FLAT.items())} from fl""")
def a3(spark, d):
    """Every column of the flat keyframes but the time itself (t_iso has it) and the altitude before an override, as the rules have no window on the ground."""
    k = prepare.flatten_keyframes(keyframes(spark, d))
    degrees = F.degrees(S.direction(F.col("east_mps"), F.col("north_mps")))  # also of velocities that cancel out, as the SQL has it; P20 gives them none
    k = k.withColumn("track_deg", degrees - 360 * F.floor(degrees / 360)).withColumn("track_rad", F.radians("track_deg"))
    return k.select(*_PLAIN, *(rounded(c, n).alias(c) for c, n in _FLAT.items()))


@query("a4_stage_report", MESSAGES_SQL + """, g as (select * from m where crc_ok = 1) select * from (
select 0 as nth, 'read' as stage, count(*) as n, count(lat) as n_position, count(gs) as n_velocity, 1e0 as share from m union all
select 1, 'intact', count(*), count(lat), count(gs), count(*) / (select count(*) from m) from g)""")
def a4(spark, d):
    m = messages(spark, d)
    return prepare.stage_report(read=m, intact=m.where("crc_ok = 1"))


@query("io4_rule_messages", MESSAGES_SQL + " select raw_id from m where crc_ok = 1 and ts_utc between 1704067200 and 1704068025")
def io4(spark, d):
    m = messages(spark, d)
    return files.read_messages_for_rules(m, M.rule_table(spark, d), True, True).select("raw_id")


@query("io7_full_report", MESSAGES_SQL + " select source, count(*) as n, round(min(ts_utc), 3) as t_min, round(max(ts_utc), 3) as t_max, count(gs) as n_vertical_rate from (select *, 'MISSING' as source from m) group by grouping sets ((source), ())")
def io7(spark, d):
    return files.load_report(messages(spark, d)).select("source", "n", F.round("t_min", 3).alias("t_min"), F.round("t_max", 3).alias("t_max"), "n_vertical_rate")


@query("io15_metadata", KEYFRAMES_SQL + ", fk as (select track_id, min_by(struct_pack(a := lat, o := lon), t) as p, count(*) as n_positions from kf where lat is not null group by 1) select track_id, 'first_keyframe' as origin_source, " + rnd("p.a", 7) + " as lat0, " + rnd("p.o", 7) + " as lon0, 36e0 as field_ft, n_positions from fk")
def io15(spark, d):
    m = files.reference_metadata(keyframes(spark, d), M.rule_table(spark, d))
    return m.select("track_id", "origin_source", rounded("lat0", 7).alias("lat0"), rounded("lon0", 7).alias("lon0"), "field_ft", "n_positions")


def _zones_at(lat):
    return F.floor(2 * F.pi() / F.acos(1 - (1 - F.cos(F.pi() / 30)) / F.pow(F.cos(F.radians(lat)), F.lit(2))))


def frames(spark, d) -> DataFrame:
    """The messages as frames on the air, id and payload_hex: of each position and of each velocity one, with format 17 and its checksum.

    A fixture of the decoding queries: compact positions (17 bits, even or odd by the event's number), altitudes in steps of 25 ft,
    velocities as whole knots east and north, climb rates in steps of 64 ft a minute.
    """
    m = messages(spark, d).withColumn("odd", F.col("raw_id") % 2)
    shifted = lambda c, n: F.shiftleft(c.cast("long"), n)
    dlat = 360.0 / (60 - F.col("odd"))
    y = F.floor((1 << 17) * F.pmod(F.col("lat"), dlat) / dlat + 0.5)
    dlon = 360.0 / F.greatest(_zones_at(dlat * (y / (1 << 17) + F.floor(F.col("lat") / dlat))) - F.col("odd"), F.lit(1))
    x = F.floor((1 << 17) * F.pmod(F.col("lon"), dlon) / dlon + 0.5)
    steps = F.floor((F.coalesce("alt", F.lit(0.0)) + 1000) / 25)
    code = F.when(F.col("alt").isNull(), 0).otherwise(shifted(F.floor(steps / 16), 5) + 16 + steps % 16)
    place = shifted(F.lit(11), 51) + shifted(code, 36) + shifted(F.col("odd"), 34) + shifted(y % (1 << 17), 17) + (x % (1 << 17)).cast("long")
    e, n = F.round(F.col("gs") * F.sin(F.radians("track"))), F.round(F.col("gs") * F.cos(F.radians("track")))
    rate = F.round(F.get_json_object("decoded_json", "$.velocity_raw[2]").cast("double") / 64)
    part = lambda v, n: shifted(F.when(v < 0, 1).otherwise(0), n) + shifted(F.abs(v) + 1, n - 10)
    moved = shifted(F.lit(19), 51) + shifted(F.lit(1), 48) + part(e, 42) + part(n, 31) + shifted(F.when(rate < 0, 1).otherwise(0), 19) + shifted(F.abs(rate) + 1, 10)
    both = m.select("raw_id", "icao", F.explode(F.array(F.struct(F.lit(0).alias("kind"), place.alias("me")), F.struct(F.lit(1).alias("kind"), moved.alias("me")))).alias("x")).where("x.me is not null")
    body = both.select((F.col("raw_id") * 2 + F.col("x.kind")).alias("id"), F.concat(F.lit("8D"), F.upper("icao"), F.lpad(F.hex("x.me"), 14, "0")).alias("body"))
    parity = F.lpad(F.hex(decode.crc_remainder(F.concat("body", F.lit("000000")))), 6, "0")
    return body.select("id", F.concat("body", parity).alias("payload_hex"))


_SENT = MESSAGES_SQL + """, pv as (select *, gs * sin(radians(track)) as e, gs * cos(radians(track)) as n from m), fr as (
  select raw_id * 2 as id, upper(icao) as icao, 11 as tc, lat, lon, floor((alt + 1000) / 25) * 25 - 1000 as alt, null::double as gs, null::double as rate, raw_id % 2 as odd from pv where lat is not null
  union all select raw_id * 2 + 1, upper(icao), 19, null, null, null, sqrt(pow(round(e), 2) + pow(round(n), 2)), round(cast(json_extract_string(decoded_json, '$.velocity_raw[2]') as double) / 64) * 64, null from pv where gs is not null)"""


@query("d2_decoded_frames", _SENT + " select id, 17 as df, icao, tc, 1 as crc_ok, alt, case when lat is not null then true end as in_place, " + rnd("gs", 4) + " as gs, rate as vertical_rate from fr")
def d2(spark, d):
    """Frames decoded and placed by the reference point, as their ids are in no order of time; in_place: within 10 m of the position that was sent."""
    got = decode.resolve_position(decode.decode_frames(frames(spark, d)), S.REFERENCE_LAT, S.REFERENCE_LON, pairs=False)
    sent = messages(spark, d).where("lat is not null").select((F.col("raw_id") * 2).alias("id"), F.col("lat").alias("lat0"), F.col("lon").alias("lon0"))
    j = got.join(sent, "id", "left")
    near = F.when(F.col("lat0").isNotNull(), S.haversine_km(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0")) < 0.01)
    return j.select("id", "df", "icao", F.col("tc").cast("int").alias("tc"), "crc_ok", "alt", near.alias("in_place"), rounded("gs", 4).alias("gs"), "vertical_rate")


@query("d3_pairs_of_frames", _SENT + """ select id, max(case when odd = 0 then id end) over w as even_id, max(case when odd = 1 then id end) over w as odd_id from fr where odd is not null
window w as (partition by icao order by id rows unbounded preceding)""")
def d3(spark, d):
    f = decode.decode_frames(staged(frames(spark, d), "frames")).where("odd is not null")
    return decode.pair_even_odd(f).select("id", "even_id", "odd_id")


@query("d5_all_batches", _SENT + " select id, 17 as df, icao, tc from fr where id > 101")
def d5(spark, d):
    """The first frames are decoded; the rest comes in batches until none is left."""
    f = staged(frames(spark, d), "frames")
    batch = max(1000, f.count() // 4)
    return decode.decode_all(f, f.where("id <= 101").select("id"), batch, staged).select("id", "df", "icao", F.col("tc").cast("int").alias("tc"))


@query("d5_decode_incremental", _SENT + """ select id, 17 as df, icao, tc, 1 as crc_ok, alt, """ + rnd("gs", 4) + """ as gs, rate as vertical_rate from fr
where id > (select max(id) from fr where id <= (select avg(id) from fr))""")
def d5_one(spark, d):
    """The lower half of the ids is decoded already; every frame above the largest of them is decoded, with all its fields."""
    f = staged(frames(spark, d), "frames")
    known = f.join(F.broadcast(f.agg(F.avg("id").alias("middle"))), F.col("id") <= F.col("middle")).select("id")
    new = decode.decode_incremental(f, known)
    return new.select("id", "df", "icao", F.col("tc").cast("int").alias("tc"), "crc_ok", "alt", rounded("gs", 4).alias("gs"), "vertical_rate")


def _stream_of(df: DataFrame, name: str) -> DataFrame:
    """df as a stream: written files that are read as they come."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


@query("s5_stateful_pairs", _SENT + """, tm as (select fr.*, m.ts_utc from fr join m on m.raw_id = fr.id // 2), wm as (select epoch_ms(to_timestamp(max(ts_utc))) - 10000 as w from tm where odd is not null)
select id, max(case when odd = 0 then id end) over w as even_id, max(case when odd = 1 then id end) over w as odd_id from tm, wm where odd is not null and floor(ts_utc * 1000) <= wm.w
window w as (partition by icao order by ts_utc, id rows unbounded preceding)""")
def s5(spark, d):
    """Parity pairs of a stream of decoded frames, as far as the last watermark has come (10 s before the last frame)."""
    f = decode.decode_frames(frames(spark, d))
    at = messages(spark, d).select(F.col("raw_id").alias("m_id"), F.timestamp_micros(F.round(F.col("ts_utc") * 1e6).cast("long")).alias("ts"))
    timed = f.join(at, F.floor(F.col("id") / 2) == F.col("m_id")).select("id", "icao", "surface", "odd", "ts")
    with stateful.state_store(spark):
        return streams.run_to_table(stateful.paired_parity(_stream_of(timed, "frames"), "10 seconds"))


@query("s7_online_filter")
def s7(spark, d):
    with stateful.state_store(spark):
        return streams.run_to_table(stateful.filtered_online(_stream_of(samples(spark, d).select("track_id", "t", *compare.POS, *compare.VEL), "samples"), late="0 seconds"))


@query("s11_carried_forward", """with l as (select event_id as id, user_id as key, ts from events where event_type = 'error'), r as (select user_id as key, ts, min(value) as value from events where event_type = 'purchase' group by 1, 2),
wm as (select max(ts) as w from events where event_type in ('error', 'purchase')), j as (select l.*, r.ts as rts, r.value from l asof left join r on l.key = r.key and l.ts >= r.ts)
select id, case when epoch_us(ts) - epoch_us(rts) <= 172800000000 then value end as value, case when epoch_us(ts) - epoch_us(rts) <= 172800000000 then floor((epoch_us(ts) - epoch_us(rts)) / 1e6) end as age
from j, wm where ts < date_trunc('second', w)""")
def s11(spark, d):
    """Each error with the user's last purchase in the two days before it; rows of the last second, which the watermark may cut, are left out."""
    e = streams.events_stream(spark, d)
    side = lambda kind: e.where(F.col("event_type") == kind)
    left = side("error").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts")
    right = streams.events_stream(spark, d).where("event_type = 'purchase'").select(F.col("user_id").alias("key"), "ts", "value")
    with stateful.state_store(spark):
        got = streams.run_to_table(stateful.carried_forward(left, right, 172800.0, "0 seconds"))
    rows = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    last = rows.where("event_type in ('error', 'purchase')").agg(F.date_trunc("second", F.max("ts")).alias("w"))
    inside = rows.join(F.broadcast(last), F.col("ts") < F.col("w")).select(F.col("event_id").alias("id"))
    return got.join(inside, "id", "left_semi").select("id", "value", F.floor("age").cast("double").alias("age"))


@query("s2_quarantine", "select value > 1 and event_id % 7 <> 3 as good, count(*) as n from events group by 1")
def s2(spark, d):
    """Events as lines of JSON, of which every seventh arrives torn."""
    e = spark.read.parquet(f"{d}/events.parquet")
    line = F.to_json(F.struct("event_id", "value"))
    torn = e.withColumn("line", line).select(F.when(F.col("event_id") % 7 == 3, F.expr("substring(line, 1, length(line) - 1)")).otherwise(F.col("line")).alias("line"))
    path = new_path(spark, "quarantine")
    streams.quarantined(streams.parsed(_stream_of(torn, "lines"), "event_id long, value double"), F.col("value") > 1, f"{path}/good", f"{path}/bad", f"{path}/checkpoint")
    good, bad = spark.read.parquet(f"{path}/good"), spark.read.parquet(f"{path}/bad")
    return good.select(F.lit(True).alias("good")).unionByName(bad.select(F.lit(False).alias("good"))).groupBy("good").agg(F.count("*").alias("n"))


@query("s9_incremental_decode", _SENT + " select id, 17 as df, icao, tc from fr")
def s9(spark, d):
    """Frames of a stream decoded batch by batch, each batch a partition of the table."""
    f = frames(spark, d).withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("id")))
    out = streams.decode_new(_stream_of(f, "frames"), new_path(spark, "decoded"), lambda b: decode.decode_frames(b.drop("ts")).select("id", "df", "icao", F.col("tc").cast("int").alias("tc")))
    return out.select("id", "df", "icao", "tc")


@query("s10_rules_on_a_stream", MESSAGES_SQL + " select raw_id, track_id from m where ts_utc between 1704067200 and 1704068025")
def s10(spark, d):
    """Every message of the stream meets the rules of its own address and window, from the rule table of all tracks."""
    m = _stream_of(messages(spark, d), "messages")
    rules = staged(M.rule_table(spark, d), "rules")
    return streams.run_to_table(prepare.join_rules(m, rules).select("raw_id", "track_id"))
