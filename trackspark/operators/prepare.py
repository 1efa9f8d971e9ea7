"""Messages to events, keyframes and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.functions import scalars as S


def join_rules(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules are matched by address and inclusive window. No pass to count them: Spark broadcasts a rule table by its size, or at run time."""
    r = rules.withColumnsRenamed({"track_id": "rule_track", "icao": "rule_icao"})
    m = messages.drop("track_id")
    return m.join(r, (S.norm_icao(m["icao"]) == F.col("rule_icao")) & m["ts_utc"].between(F.col("t_first"), F.col("t_last"))).withColumnRenamed("rule_track", "track_id")


def allowed_kinds(events: Column) -> Column:
    """where positions and velocities are both allowed, so are rows that are both."""
    both = F.array_contains(events, "position") & F.array_contains(events, "velocity")
    return F.when(both, F.array_union(events, F.array(F.lit("position_velocity"), F.lit("mixed")))).otherwise(events)


def rule_counts(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """rows of each track after the filters on address, checksum, kind and window, in one pass."""
    r = rules.select(F.col("track_id").alias("rule_track"), "icao", "t_first", "t_last", "events").withColumnRenamed("icao", "rule_icao")
    kind = S.event_kind(F.col("lat"), F.col("lon"), F.col("gs"), F.col("track"))
    m = messages.drop("track_id").withColumn("kind", kind)
    j = m.join(r, S.norm_icao(m["icao"]) == F.col("rule_icao"))
    crc = F.col("crc_ok") == 1
    event = crc & F.array_contains(allowed_kinds(F.col("events")), F.col("kind"))
    window = event & F.col("ts_utc").between(F.col("t_first"), F.col("t_last"))
    return j.groupBy(F.col("rule_track").alias("track_id")).agg(F.count("*").alias("n_icao"), *(F.count_if(c).alias(n) for n, c in (("n_crc", crc), ("n_events", event), ("n_window", window))))


def events(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """Filtered messages with kind, ENU velocity, vertical rate and bucket."""
    j = join_rules(messages, rules).where("crc_ok = 1")
    ve, vn = S.enu_velocity(F.col("gs"), F.col("track"))
    e = j.withColumns({
        "kind": S.event_kind(F.col("lat"), F.col("lon"), F.col("gs"), F.col("track")), "ve": ve, "vn": vn,
        "vz": S.fpm_to_mps(S.vertical_rate_fpm(F.col("decoded_json"))), "bucket": F.rint(F.col("ts_utc") / F.col("q")) * F.col("q"),
    })
    return e.where(F.array_contains(allowed_kinds(F.col("events")), F.col("kind"))).drop("rule_icao", "events")


def filter_radius(ev: DataFrame, lat0: float = S.REFERENCE_LAT, lon0: float = S.REFERENCE_LON) -> DataFrame:
    """positions beyond the rule's radius go; rows without a position stay."""
    d = S.haversine_km(F.lit(lat0), F.lit(lon0), F.col("lat"), F.col("lon"))
    return ev.where(d.isNull() | (d <= F.col("radius_km")))


def filter_iqr(df: DataFrame, keys: list[str], value: str, k: float) -> DataFrame:
    """drops values above Q3 + k * IQR of their key; no limit with fewer than four values or no spread."""
    q = df.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"), F.count(value).alias("_n"))
    iqr = F.col("_q")[1] - F.col("_q")[0]
    limit = q.select(*keys, F.when((F.col("_n") >= 4) & (iqr > 0), F.col("_q")[1] + k * iqr).alias("_limit"))
    return df.join(limit, keys, "left").where(F.col("_limit").isNull() | F.col(value).isNull() | (F.col(value) <= F.col("_limit"))).drop("_limit")


def trim_to_first_position(ev: DataFrame) -> DataFrame:
    """F8: rows from the first one with a position on, in order of (time, raw_id)."""
    w = Window.partitionBy("track_id").orderBy("ts_utc", "raw_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ev.withColumn("_seen", F.max(F.col("lat").isNotNull() & F.col("lon").isNotNull()).over(w)).where("_seen").drop("_seen")


def position_diagnostics(ev: DataFrame) -> DataFrame:
    """Step from the previous row that has a position."""
    w = Window.partitionBy("track_id").orderBy("ts_utc", "raw_id").rowsBetween(Window.unboundedPreceding, -1)
    here = F.when(F.col("lat").isNotNull(), F.struct("ts_utc", "lat", "lon"))
    p = ev.withColumn("_p", F.last(here, ignorenulls=True).over(w)).where("lat is not null")
    dt = F.col("ts_utc") - F.col("_p.ts_utc")
    km = S.haversine_km(F.col("_p.lat"), F.col("_p.lon"), F.col("lat"), F.col("lon"))
    return p.withColumns({"dt": dt, "step_km": km, "speed_kmh": F.when(dt > 0, km / dt * 3600)}).drop("_p")


def velocity_diagnostics(ev: DataFrame) -> DataFrame:
    """Change from the previous row that has a velocity; a missing part counts as 0."""
    w = Window.partitionBy("track_id").orderBy("ts_utc", "raw_id").rowsBetween(Window.unboundedPreceding, -1)
    here = F.when(F.col("ve").isNotNull(), F.struct("ts_utc", "ve", "vn", "vz"))
    p = ev.withColumn("_p", F.last(here, ignorenulls=True).over(w)).where("ve is not null")
    dt = F.col("ts_utc") - F.col("_p.ts_utc")
    dh = F.sqrt(F.pow(F.col("ve") - F.col("_p.ve"), 2) + F.pow(F.col("vn") - F.col("_p.vn"), 2))
    dv = F.abs(F.col("vz") - F.col("_p.vz"))
    total = F.when(dh.isNull() & dv.isNull(), None).otherwise(F.sqrt(F.pow(F.coalesce(dh, F.lit(0.0)), 2) + F.pow(F.coalesce(dv, F.lit(0.0)), 2)))
    return p.withColumns({"dt": dt, "dh": dh, "dv": dv, "accel": F.when(dt > 0, total / dt)}).drop("_p")


def mean_by(value: Column, order: str) -> Column:
    """Mean of a group's known values, added one by one in that order; NULL where there are none."""
    values = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(order), value.alias("v")))))
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda total, x: total + x["v"]) / F.size(values))


def build_keyframes(ev: DataFrame) -> DataFrame:
    """A1: one row for each track and bucket. Means add their rows in order of raw_id, as a table is read, so that neither the order in which
    rows arrive nor the number of tasks decides their last digit, or the sign of velocities that cancel out."""
    pos, vel = F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.col("ve").isNotNull()
    mean = lambda c, where: mean_by(F.when(where, F.col(c)), "raw_id").alias(c)
    grounded = F.lit(False)
    ev = ev.withColumn("_told", F.col("alt"))
    if "ground_first" in ev.columns:  # P17
        grounded = F.coalesce(F.col("ts_utc").between(F.col("ground_first"), F.col("ground_last")), F.lit(False))
        ev = ev.withColumn("alt", S.on_ground_override(F.col("ts_utc"), F.col("alt"), F.col("field_ft"), F.col("ground_first"), F.col("ground_last")))
    k = ev.groupBy("track_id", F.col("bucket").alias("t")).agg(
        mean_by(F.when(vel, F.col("gs")), "raw_id").alias("reported_gs"), F.sort_array(F.collect_list("raw_id")).alias("raw_ids"), F.transform(F.sort_array(F.collect_list(F.struct("ts_utc", "raw_id", "kind"))), lambda x: x["kind"]).alias("event_kinds"),
        mean("lat", pos), mean("lon", pos), mean("alt", pos), mean("ve", vel), mean("vn", vel), mean("vz", vel),
        mean("_told", pos).alias("alt_reported"), F.max(pos & grounded).alias("on_ground"), F.count_if(vel & F.col("vz").isNotNull()).alias("n_velocity_3d"),
        mean_by(F.when(pos, S.haversine_km(F.lit(S.REFERENCE_LAT), F.lit(S.REFERENCE_LON), F.col("lat"), F.col("lon"))), "raw_id").alias("distance_km"),
        F.count_if(pos).alias("n_position"), F.count_if(vel).alias("n_velocity"), F.sort_array(F.collect_set("kind")).alias("kinds"), F.min("field_ft").alias("field_ft"),
    )
    full_p, full_v = F.col("lat").isNotNull() & F.col("alt").isNotNull(), F.col("ve").isNotNull() & F.col("vz").isNotNull()
    kind = F.when(F.array_contains("kinds", "position_velocity") | (F.array_contains("kinds", "position") & F.array_contains("kinds", "velocity")), "position_velocity").otherwise(F.col("kinds")[0])
    w = Window.partitionBy("track_id").orderBy("t")
    speed = F.sqrt(F.col("ve") * F.col("ve") + F.col("vn") * F.col("vn"))
    k = k.withColumns({"ground_speed": speed, "track_deg": S.heading_from_velocity(F.col("ve"), F.col("vn")), "source_kinds": unique_in_order(F.col("event_kinds")), "mixed_kind": aggregate_event_kind(F.col("event_kinds"))})
    return k.withColumns({"event_kind": kind, "full_position": full_p, "full_velocity": full_v, "paired": full_p & full_v, "keyframe_id": F.format_string("kf_%06d", F.row_number().over(w))})


def derive_acceleration(kf: DataFrame, max_dt: float = 10.0) -> DataFrame:
    """Change of velocity between neighbouring velocity keyframes, with a status for those that have none."""
    w = Window.partitionBy("track_id").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    v = kf.where("ve is not null").withColumn("_p", F.last(F.struct("t", "ve", "vn", "vz")).over(w))
    dt = F.col("t") - F.col("_p.t")
    ok = (dt > 0) & (dt <= max_dt)
    status = F.when(F.col("_p").isNull(), "first").when(dt <= 0, "no step").when(dt > max_dt, "too long").otherwise("ok")
    return v.withColumns({f"a{c}": F.when(ok, (F.col(f"v{c}") - F.col(f"_p.v{c}")) / dt) for c in "enz"} | {"status": status}).drop("_p")


def paired_samples(kf: DataFrame) -> DataFrame:
    """full keyframes as samples in local metres; index in order of time."""
    x, y = S.local_xy(F.col("lat"), F.col("lon"))
    s = kf.where("paired").select("track_id", "t", x.alias("x"), y.alias("y"), ((F.col("alt") - F.col("field_ft")) * S.FT_TO_M).alias("z"), F.col("ve").alias("vx"), F.col("vn").alias("vy"), F.col("vz"))
    rounded = s.select("track_id", "t", *(S.round_half(F.col(c), 6).alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")))
    return rounded.withColumn("i", (F.row_number().over(Window.partitionBy("track_id").orderBy("t")) - 1).cast("long"))


def unique_in_order(values: Column) -> Column:
    """A2 and U4: different values in the order in which they come first."""
    return F.array_distinct(values)


def aggregate_event_kind(kinds: Column) -> Column:
    """A2: position_velocity where both parts occur, the single kind, mixed, or unknown without any."""
    known = F.array_distinct(F.array_compact(kinds))
    both = F.array_contains(known, "position_velocity") | (F.array_contains(known, "position") & F.array_contains(known, "velocity"))
    return F.when(F.size(known) == 0, "unknown").when(F.coalesce(both, F.lit(False)), "position_velocity").when(F.size(known) == 1, F.get(known, F.lit(0))).otherwise("mixed")


def flatten_keyframes(kf: DataFrame, field_ft: str = "field_ft", max_dt: float = 10.0) -> DataFrame:
    """A3: keyframes as flat columns: ids and kinds (lists as JSON), position, heights and what they refer to, speeds, counts, how values
    were formed, flags, and the acceleration since the last keyframe with a velocity (W4), with where it comes from.

    alt_reported_ft is the mean altitude before the field's elevation replaced it (P17), NULL where it did not; a keyframe with no row of a
    kind has NULLs in that kind's columns. One window by track for the acceleration, nothing is joined.
    """
    x, y = S.local_xy(F.col("lat"), F.col("lon"))
    msl, height = S.field_height(F.col("alt"), F.col(field_ft))
    shown = S.field_height(F.col("alt"), F.col(field_ft), True)[1]
    w = Window.partitionBy("track_id").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    moves = F.col("ve").isNotNull()
    k = kf.withColumn("_p", F.last(F.when(moves, F.struct("t", "ve", "vn", "vz")), ignorenulls=True).over(w))
    dt = F.col("t") - F.col("_p.t")
    near = moves & (dt > 0) & (dt <= max_dt)
    k = k.withColumns({f"_a{c}": F.when(near, (F.col(f"v{c}") - F.col(f"_p.v{c}")) / dt) for c in "enz"})
    flat = F.sqrt(F.col("_ae") * F.col("_ae") + F.col("_an") * F.col("_an"))
    size = F.sqrt(F.col("_ae") * F.col("_ae") + F.col("_an") * F.col("_an") + F.coalesce(F.col("_az") * F.col("_az"), F.lit(0.0)))
    origin = F.when(moves, F.when(F.col("_p").isNull(), "first").when(dt <= 0, "no step").when(dt > max_dt, "too long").otherwise("change of velocity"))
    placed = F.col("n_position") > 0
    source = F.when(placed, F.when(F.col("on_ground"), "field elevation").when(F.col("alt").isNotNull(), "reported").otherwise("missing"))
    return k.select(
        "track_id", "keyframe_id", "t", S.iso_utc(F.col("t")).alias("t_iso"), "event_kind", "mixed_kind", F.array_join("source_kinds", ",").alias("source_kinds"), F.to_json("event_kinds").alias("event_kinds"), F.to_json("raw_ids").alias("row_ids"),
        F.size("raw_ids").alias("n_rows"), F.get("raw_ids", F.lit(0)).alias("first_raw_id"), F.element_at("raw_ids", -1).alias("last_raw_id"), "lat", "lon", x.alias("x_m"), y.alias("y_m"), F.when(placed, F.col("distance_km")).alias("distance_km"),
        F.col("alt").alias("alt_ft"), F.when(F.col("on_ground"), F.col("alt_reported")).alias("alt_reported_ft"), source.alias("altitude_source"), F.when(placed, F.col("on_ground")).alias("on_ground"), msl.alias("alt_m"), height.alias("height_m"),
        shown.alias("height_shown_m"), F.col(field_ft).alias("field_ft"), F.lit("field").alias("height_reference"), F.when(F.col(field_ft).isNotNull(), "rule").otherwise("none").alias("height_reference_source"),
        F.col("ve").alias("east_mps"), F.col("vn").alias("north_mps"), F.col("vz").alias("up_mps"), (F.col("vz") / S.FT_TO_M * 60).alias("vertical_rate_fpm"), F.when(moves, F.col("vz").isNotNull()).alias("has_vertical"),
        "ground_speed", (F.col("ground_speed") / S.KNOT_TO_MPS).alias("ground_speed_kt"), "reported_gs", "track_deg", F.radians("track_deg").alias("track_rad"), "n_position", "n_velocity", "n_velocity_3d",
        F.when(placed, "mean of rows").alias("position_formed"), F.when(moves, "mean vector of rows").alias("velocity_formed"), *(F.col(f"_a{c}").alias(n) for c, n in (("e", "acc_east"), ("n", "acc_north"), ("z", "acc_up"))),
        flat.alias("acc_horizontal"), F.abs("_az").alias("acc_vertical"), size.alias("acc_size"), origin.alias("acc_source"), F.lit(False).alias("acc_observed"), "full_position", "full_velocity", "paired",
    )


def drop_invalid_time(messages: DataFrame, time: str = "ts_utc") -> DataFrame:
    """rows without a finite time go; a table that then is empty is an error when it is read: the count that says so adds no row."""
    kept = messages.where(S.to_finite(F.col(time)).isNotNull())
    none = kept.groupBy().agg(F.count("*").alias("_n")).where(F.when(F.col("_n") > 0, False).otherwise(F.raise_error(F.lit("no row has a valid time")).cast("boolean")))
    return kept.unionByName(none.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in messages.schema)))


def position_rows(messages: DataFrame, icao: str | None = None, df: int | None = None, tc: tuple[int, int] | None = None) -> DataFrame:
    """rows of one address, downlink format and range of type codes with a position in range; the first of equal (time, lat, lon, alt)."""
    m = messages.where("lat between -90 and 90 and lon between -180 and 180")
    if icao is not None:
        m = m.where(S.norm_icao(F.col("icao")) == icao.upper())
    if df is not None:
        m = m.where(F.col("df") == df)
    if tc is not None:
        m = m.where(F.col("tc").between(*tc))
    w = Window.partitionBy(S.norm_icao(F.col("icao")), "ts_utc", "lat", "lon", "alt").orderBy("raw_id")
    return m.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def filter_kinematic_outliers(ev: DataFrame, k: Column | float = 3.0) -> DataFrame:
    """F7 on tracks: a row goes, once, when its speed from the previous position or its acceleration from the previous velocity is above
    Q3 + k * IQR of its track; tests with fewer than four values or no spread drop nothing. k may be a rule's column."""
    k = k if isinstance(k, Column) else F.lit(k)
    speed = position_diagnostics(ev).select("track_id", "raw_id", F.col("speed_kmh").alias("_speed"))
    accel = velocity_diagnostics(ev).select("track_id", "raw_id", F.col("accel").alias("_accel"))
    j = ev.join(speed, ["track_id", "raw_id"], "left").join(accel, ["track_id", "raw_id"], "left")
    part = Window.partitionBy("track_id")
    bad = F.lit(False)
    for c in ("_speed", "_accel"):
        q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).over(part)
        j = j.withColumns({f"{c}_q": q, f"{c}_n": F.count(c).over(part)})
        iqr = F.col(f"{c}_q")[1] - F.col(f"{c}_q")[0]
        bad = bad | F.coalesce((F.col(f"{c}_n") >= 4) & (iqr > 0) & (F.col(c) > F.col(f"{c}_q")[1] + k * iqr), F.lit(False))
    return j.where(~bad).select(*ev.columns)


def prepared(ev: DataFrame, k: float = 3.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """F7 on first diagnostics, F8, and both diagnostics again on what is left: rows, position and velocity diagnostics."""
    kept = trim_to_first_position(filter_kinematic_outliers(ev, k))
    return kept, position_diagnostics(kept), velocity_diagnostics(kept)


#: Checks of a keyframe in order, the first failure counts.
CHECKS = (
    ("not paired", "paired"), ("no full position", "full_position"), ("no full velocity", "full_velocity"), ("no objects", "lat is not null and ve is not null"), ("not three-dimensional", "alt is not null"),
    ("other frame", "coalesce(frame, 'local_enu') like 'local_enu%'"), ("no vertical rate", "vz is not null"),
)


def skip_reason(kf: DataFrame, require_paired: bool = True) -> DataFrame:
    """keyframes with skip_reason, NULL for those that make samples. A keyframe table without a frame column is in local_enu. Without
    require_paired the flag is not asked, so that each later check speaks for itself."""
    k = kf if "frame" in kf.columns else kf.withColumn("frame", F.lit("local_enu"))
    reason = F.lit(None).cast("string")
    finite = [S.to_finite(F.col(c)).isNotNull() for c in ("t", "lat", "lon", "alt", "ve", "vn", "vz")]
    whole = finite[0]
    for c in finite[1:]:
        whole = whole & c
    reason = F.when(~whole, "number not finite")
    for name, check in CHECKS[:0:-1] + CHECKS[:1] * require_paired:
        reason = F.when(~F.coalesce(F.expr(check), F.lit(False)), name).otherwise(reason)
    return k.withColumn("skip_reason", reason)


def unique_times(samples: DataFrame, keys: list[str], time: str = "t") -> DataFrame:
    """samples; a time that a key has twice is an error when they are read."""
    w = Window.partitionBy(*keys).orderBy(time)
    twice = F.coalesce(F.col(time) <= F.lag(time).over(w), F.lit(False))
    s = samples.withColumn("_twice", twice)
    fine = F.when(~F.col("_twice"), True).otherwise(F.raise_error(F.concat(F.lit("repeated time "), F.col(time).cast("string"))).cast("boolean"))
    return s.where(fine).drop("_twice")


def min_support(df: DataFrame, keys: list[str], least: int, fail: bool = False) -> DataFrame:
    """rows of keys with at least so many rows; fail: a key with fewer is an error."""
    n = F.count("*").over(Window.partitionBy(*keys))
    d = df.withColumn("_n", n)
    ok = F.col("_n") >= least
    return d.where(F.when(ok, True).otherwise(F.raise_error(F.lit("too few rows")).cast("boolean")) if fail else ok).drop("_n")


def problem_previews(df: DataFrame, keys: list[str], order: list[str], k: int = 10) -> DataFrame:
    """The first k rows of each key in a stable order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def stage_report(**stages: DataFrame) -> DataFrame:
    """A4: rows, position rows and velocity rows of each named stage of preparation, and the share of the first stage that is left."""
    out, first = None, next(iter(stages.values())).agg(F.count("*").alias("n_first"))
    for k, (name, df) in enumerate(stages.items()):
        one = df.agg(F.lit(k).alias("nth"), F.lit(name).alias("stage"), F.count("*").alias("n"), F.count("lat").alias("n_position"), F.count("gs").alias("n_velocity"))
        out = one if out is None else out.unionByName(one)
    return out.crossJoin(F.broadcast(first)).withColumn("share", F.col("n") / F.nullif("n_first", F.lit(0))).drop("n_first")


def outlier_report(ev: DataFrame, k: float = 3.0, lat0: float = S.REFERENCE_LAT, lon0: float = S.REFERENCE_LON) -> DataFrame:
    """A4: of each track and test (distance, speed, acceleration, any) the rows beyond its limit, those that it could see, and their share
    (NULL of none): F6's radius of the rule, and F7's Q3 + k * IQR, which need four values and a spread."""
    d = S.haversine_km(F.lit(lat0), F.lit(lon0), F.col("lat"), F.col("lon"))
    speed = position_diagnostics(ev).select("track_id", "raw_id", F.col("speed_kmh").alias("_speed"))
    accel = velocity_diagnostics(ev).select("track_id", "raw_id", F.col("accel").alias("_accel"))
    j = ev.withColumn("_distance", d).join(speed, ["track_id", "raw_id"], "left").join(accel, ["track_id", "raw_id"], "left")
    part = Window.partitionBy("track_id")
    bad = {"distance": F.coalesce(F.col("_distance") > F.col("radius_km"), F.lit(False))}
    for c in ("speed", "accel"):
        j = j.withColumns({f"_{c}_q": F.percentile(f"_{c}", F.array(F.lit(0.25), F.lit(0.75))).over(part), f"_{c}_n": F.count(f"_{c}").over(part)})
        iqr = F.col(f"_{c}_q")[1] - F.col(f"_{c}_q")[0]
        bad[c] = F.coalesce((F.col(f"_{c}_n") >= 4) & (iqr > 0) & (F.col(f"_{c}") > F.col(f"_{c}_q")[1] + k * iqr), F.lit(False))
    bad["any"] = bad["distance"] | bad["speed"] | bad["accel"]
    seen = {"distance": F.col("lat").isNotNull(), "speed": F.col("lat").isNotNull(), "accel": F.col("ve").isNotNull(), "any": F.lit(True)}
    tests = F.explode(F.array(*(F.struct(F.lit(n).alias("test"), bad[n].alias("out"), seen[n].alias("seen")) for n in bad)))
    g = j.select("track_id", tests.alias("x")).groupBy("track_id", "x.test").agg(F.count_if("x.out").alias("n"), F.count_if("x.seen").alias("denominator"))
    return g.withColumn("fraction", F.col("n") / F.nullif("denominator", F.lit(0)))


def normalize_report(raw: DataFrame, ev: DataFrame, kf: DataFrame) -> DataFrame:
    """A4: of each track the raw rows, the rows after the rule's filters, their kinds, and its keyframes, the paired ones, and the share of these."""
    kinds = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("position", "velocity", "position_velocity")]
    a, b = raw.groupBy("track_id").agg(F.count("*").alias("n_raw")), ev.groupBy("track_id").agg(F.count("*").alias("n_filtered"), *kinds)
    c = kf.groupBy("track_id").agg(F.count("*").alias("n_keyframes"), F.count_if("paired").alias("n_paired"))
    out = a.join(b, "track_id", "left").join(c, "track_id", "left").na.fill(0)
    return out.withColumn("paired_share", F.col("n_paired") / F.nullif("n_keyframes", F.lit(0)))


def skip_reasons(kf: DataFrame) -> DataFrame:
    """how many keyframes each check turns away first."""
    reason = F.when(~F.col("full_position"), "no full position").when(~F.col("full_velocity"), "no full velocity").otherwise("used")
    return kf.groupBy(reason.alias("skip_reason")).agg(F.count("*").alias("n"))


def dedupe_points(ev: DataFrame) -> DataFrame:
    """F16: the first row by (time, raw_id) of each rounded key."""
    key = [F.bround(c, d) for c, d in (("ts_utc", 3), ("lon", 8), ("lat", 8), ("alt", 2))]
    w = Window.partitionBy("track_id", *key).orderBy("ts_utc", "raw_id")
    return ev.where("lat is not null").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def best_callsign(messages: DataFrame) -> DataFrame:
    """A5: most frequent trimmed non-empty callsign; ties: the least."""
    c = messages.withColumn("callsign", F.trim("callsign")).where("callsign <> ''").groupBy("track_id", "callsign").agg(F.count("*").alias("n"))
    return c.groupBy("track_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "callsign")).alias("b")).select("track_id", F.col("b.callsign").alias("callsign"), (-F.col("b.m")).alias("n"))


def track_summary(kf: DataFrame) -> DataFrame:
    """Keyframes, share of paired ones, path length and steepest climb of each track."""
    w = Window.partitionBy("track_id").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    p = kf.withColumn("_p", F.last(F.when(F.col("lat").isNotNull(), F.struct("lat", "lon")), ignorenulls=True).over(w))
    step = S.haversine_km(F.col("_p.lat"), F.col("_p.lon"), F.col("lat"), F.col("lon"))
    return p.groupBy("track_id").agg(
        F.count("*").alias("n_keyframes"), F.round(F.avg(F.col("paired").cast("double")), 6).alias("paired_share"), F.round(F.sum(step), 3).alias("path_km"), F.round(F.max("vz"), 6).alias("max_climb"),
    )
