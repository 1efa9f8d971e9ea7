"""Column functions on telemetry: numbers, units, geometry, flags and scores. NULL in, NULL out unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
FT_TO_M = 0.3048
KNOT_TO_MPS = 0.514444
EARTH_KM = 6371.0088
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
WGS84_E2 = WGS84_F * (2 - WGS84_F)
REFERENCE_LAT, REFERENCE_LON = 56.923611, 23.971111
GRAVITY = 9.80665


def to_finite(c: Column) -> Column:
    """Number or NULL; text that is no number, NaN and infinities are NULL."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def round_half(c: Column, digits: int = 0) -> Column:
    """Halves away from zero, of the number scaled by ten to the digits, as SQL's round has it; -0 stays -0, so that directions of velocities do."""
    scale = F.lit(10.0**digits)
    return F.signum(c) * F.round(F.abs(c) * scale) / scale


def norm_icao(c: Column) -> Column:
    """P2."""
    return F.upper(c.cast("string"))


def vertical_rate_fpm(json: Column) -> Column:
    """Third item of velocity_raw, else the first of the named rates that is a number other than 0."""
    raw = F.get_json_object(json, "$.velocity_raw")
    listed = F.from_json(raw, "array<string>")
    named = [F.nullif(to_finite(F.get_json_object(json, f"$.{k}")), F.lit(0.0)) for k in ("vertical_rate_fpm", "baro_rate", "rocd")]
    return F.coalesce(F.when(F.size(listed) >= 3, to_finite(F.get(listed, F.lit(2)))), *named)


def fpm_to_mps(c: Column) -> Column:
    """P4."""
    return c * FT_TO_M / 60


def enu_velocity(gs_kt: Column, track_deg: Column) -> tuple[Column, Column]:
    """East and north metres a second of a compass track."""
    chi = F.radians(F.pmod(track_deg, F.lit(360.0)))
    return gs_kt * KNOT_TO_MPS * F.sin(chi), gs_kt * KNOT_TO_MPS * F.cos(chi)


def track_from_enu(east: Column, north: Column) -> Column:
    """Compass radians in [0, 2 pi); NULL without motion."""
    return F.when((F.abs(east) >= 1e-15) | (F.abs(north) >= 1e-15), F.pmod(F.atan2(east, north), F.lit(2) * F.pi()))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """P8."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def geodetic_to_ecef(lat: Column, lon: Column, h: Column | float = 0.0) -> tuple[Column, Column, Column]:
    """P9."""
    h = h if isinstance(h, Column) else F.lit(h)
    s, c = F.sin(F.radians(lat)), F.cos(F.radians(lat))
    n = WGS84_A / F.sqrt(1 - WGS84_E2 * s * s)
    return (n + h) * c * F.cos(F.radians(lon)), (n + h) * c * F.sin(F.radians(lon)), (n * (1 - WGS84_E2) + h) * s


def ecef_to_geodetic(x: Column, y: Column, z: Column) -> Column:
    """P10: struct(lat, lon, h) after eight fixed-point steps. The steps read x, y and z, which may be long expressions, as values."""

    def step(acc: Column, _: Column) -> Column:
        s = F.sin(acc["lat"])
        n = WGS84_A / F.sqrt(1 - WGS84_E2 * s * s)
        h = acc["p"] / F.greatest(F.cos(acc["lat"]), F.lit(1e-15)) - n
        return F.struct(F.atan2(acc["z"], acc["p"] * (1 - WGS84_E2 * n / (n + h))).alias("lat"), h.alias("h"), acc["p"].alias("p"), acc["z"].alias("z"))

    def solved(v: Column) -> Column:
        p = F.sqrt(v["x"] * v["x"] + v["y"] * v["y"])
        start = F.struct(F.atan2(v["z"], p * (1 - WGS84_E2)).alias("lat"), F.lit(0.0).alias("h"), p.alias("p"), v["z"].alias("z"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, step, lambda a: F.struct(F.degrees(a["lat"]).alias("lat"), F.degrees(F.atan2(v["y"], v["x"])).alias("lon"), a["h"].alias("h")))

    return F.transform(F.array(F.struct(x.alias("x"), y.alias("y"), z.alias("z"))), solved)[0]


def local_xy(lat: Column, lon: Column, lat0: float = REFERENCE_LAT, lon0: float = REFERENCE_LON) -> tuple[Column, Column]:
    """East and north metres on the tangent plane at the origin, both at altitude 0."""
    x, y, z = geodetic_to_ecef(lat, lon)
    x0, y0, z0 = geodetic_to_ecef(F.lit(lat0), F.lit(lon0))
    dx, dy, dz = x - x0, y - y0, z - z0
    sa, ca, so, co = F.sin(F.radians(F.lit(lat0))), F.cos(F.radians(F.lit(lat0))), F.sin(F.radians(F.lit(lon0))), F.cos(F.radians(F.lit(lon0)))
    return -so * dx + co * dy, -sa * co * dx - sa * so * dy + ca * dz


def xy_to_latlon(x: Column, y: Column, lat0: float = REFERENCE_LAT, lon0: float = REFERENCE_LON) -> Column:
    """local_xy() backwards, by P10."""
    x0, y0, z0 = geodetic_to_ecef(F.lit(lat0), F.lit(lon0))
    sa, ca, so, co = F.sin(F.radians(F.lit(lat0))), F.cos(F.radians(F.lit(lat0))), F.sin(F.radians(F.lit(lon0))), F.cos(F.radians(F.lit(lon0)))
    return ecef_to_geodetic(x0 - so * x - sa * co * y, y0 + co * x - sa * so * y, z0 + ca * y)


def bucket_time(t: Column, q: float = 1.0) -> Column:
    """Nearest multiple of q, halves to even."""
    if q <= 0:
        raise ValueError("the bucket must be positive")
    return F.rint(t / q) * q


def event_kind(lat: Column, lon: Column, gs: Column, track: Column) -> Column:
    """P15 with a rule: velocity needs both ground speed and track."""
    pos, vel = lat.isNotNull() & lon.isNotNull(), gs.isNotNull() & track.isNotNull()
    return F.when(pos & vel, "position_velocity").when(pos, "position").when(vel, "velocity").otherwise("other")


def direction(y: Column, x: Column) -> Column:
    """atan2 by the signs of zeros too, as SQL has it (Spark's takes -0 for 0): a rounded velocity that cancels out keeps the side it came from."""
    below = lambda c: (c < 0) | (c.cast("string") == "-0.0")
    return F.when((y == 0) & below(x), F.when(below(y), -F.pi()).otherwise(F.pi())).otherwise(F.atan2(y, x))


def wrapped(c: Column, half: Column) -> Column:
    """An angle less whole turns, by the floor of their number, as SQL has it: pmod() gives the other end for one just below half a turn back."""
    return c + half - 2 * half * F.floor((c + half) / (2 * half)) - half


def angle_diff_deg(a: Column, b: Column) -> Column:
    """Wrapped difference in [-180, 180]; the upper end only where a remainder just below 0 rounds up to the whole turn."""
    return wrapped(a - b, F.lit(180.0))


def lerp(a: Column, b: Column, w: Column) -> Column:
    """P20: one known side is kept."""
    return F.coalesce(a + (b - a) * w, a, b)


def offset_lat_lon(lat: Column, lon: Column, east: Column, north: Column) -> tuple[Column, Column]:
    """P20: small offsets in metres on a sphere."""
    return lat + F.degrees(north / 6371000.0), lon + F.degrees(east / (6371000.0 * F.greatest(F.abs(F.cos(F.radians(lat))), F.lit(1e-9))))


def score_lower_is_better(x: Column, good: float, poor: float, default: float | None = None) -> Column:
    """100 at good or below, 0 at poor or above; NULL gives the default."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * (1 - (x - good) / (poor - good))))
    return F.when(x.isNotNull(), s).otherwise(F.lit(default).cast("double"))


def score_ratio_band(x: Column, low_good: float, high_good: float, low_bad: float, high_bad: float) -> Column:
    """P24."""
    rising, falling = 100 * (x - low_bad) / (low_good - low_bad), 100 * (high_bad - x) / (high_bad - high_good)
    return F.when(x.isNotNull(), F.when(x.between(low_good, high_good), 100.0).when(x < low_good, F.greatest(F.lit(0.0), rising)).otherwise(F.greatest(F.lit(0.0), falling)))


def weighted_score(parts: list[tuple[Column, float]]) -> Column:
    """Mean of the parts that are known, weights renormalised."""
    top = reduce(lambda a, b: a + b, [F.coalesce(c * w, F.lit(0.0)) for c, w in parts])
    low = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts])
    return F.when(low > 0, top / low)


def magnitude_band(x: Column, medium: float, rapid: float) -> Column:
    """P27."""
    return F.when(F.abs(x) >= rapid, "rapid").when(F.abs(x) >= medium, "medium").when(x.isNotNull(), "slow")


def score_interpretation(x: Column) -> Column:
    """P30."""
    return F.when(x >= 85, "excellent").when(x >= 70, "good").when(x >= 50, "fair").when(x.isNotNull(), "poor")


def register_sql(spark) -> None:
    """The main scalars as SQL functions without Python."""
    spark.sql("create or replace temporary function fpm_to_mps(x double) returns double return x * 0.3048D / 60D")
    spark.sql("create or replace temporary function angle_diff_deg(a double, b double) returns double return pmod(a - b + 180D, 360D) - 180D")
    spark.sql("create or replace temporary function bucket_time(t double, q double) returns double return rint(t / q) * q")
    spark.sql(
        "create or replace temporary function haversine_km(a double, b double, c double, d double) returns double return "
        "2D * 6371.0088D * asin(sqrt(pow(sin(radians(c - a) / 2D), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(d - b) / 2D), 2)))"
    )


def vertical_rate_source(json: Column) -> Column:
    """What the list's sixth item says of the rate's source; NULL with fewer items."""
    listed = F.from_json(_velocity_list(json), "array<string>")
    return F.when(F.size(listed) >= 6, F.get(listed, F.lit(5)))


def _velocity_list(json: Column) -> Column:
    """The text of velocity_raw; a list that is itself encoded as text comes back decoded once by get_json_object."""
    return F.get_json_object(json, "$.velocity_raw")


def vertical_rate_columns(json: Column) -> dict[str, Column]:
    """Fpm, m/s, source and whether there is a rate."""
    fpm = vertical_rate_fpm(json)
    return {"vertical_rate_fpm": fpm, "vertical_rate_mps": fpm_to_mps(fpm), "vertical_rate_source": vertical_rate_source(json), "vertical_rate_available": fpm.isNotNull()}


def fill_vertical_rate(fpm: Column, mps: Column, json: Column) -> tuple[Column, Column]:
    """P5: fpm from m/s where it is missing, from JSON where that is missing too; then m/s from fpm."""
    full = F.coalesce(fpm, mps * 60 / FT_TO_M, vertical_rate_fpm(json))
    return full, F.coalesce(mps, fpm_to_mps(full))


def presence_flags(lat: Column, lon: Column, alt: Column, gs: Column, track: Column, rate: Column) -> dict[str, Column]:
    """Which parts of position and velocity a row has."""
    xy, hv = lat.isNotNull() & lon.isNotNull(), gs.isNotNull() & track.isNotNull()
    return {"position_xy": xy, "full_position": xy & alt.isNotNull(), "horizontal_velocity": hv, "vertical_velocity": rate.isNotNull(), "full_velocity": hv & rate.isNotNull()}


def source_event_kind(source: Column | None, lat: Column, lon: Column, gs: Column, track: Column, rate: Column) -> Column:
    """P15 without a rule: the source's own kind, trimmed and in lower case, else derived; a vertical rate alone is a velocity too."""
    pos, vel = lat.isNotNull() & lon.isNotNull(), (gs.isNotNull() & track.isNotNull()) | rate.isNotNull()
    derived = F.when(pos & vel, "position_velocity").when(pos, "position").when(vel, "velocity").otherwise("other")
    return derived if source is None else F.coalesce(F.lower(F.trim(source)), F.lit("none"))


def field_height(alt_ft: Column, field_ft: Column, clip: bool = False) -> tuple[Column, Column]:
    """Metres above sea level and above the field; the latter not below 0 when clipped for display, and NULL without an altitude."""
    height = (alt_ft - field_ft) * FT_TO_M
    return alt_ft * FT_TO_M, F.when(height.isNotNull(), F.greatest(height, F.lit(0.0))) if clip else height


def on_ground_override(t: Column, alt_ft: Column, field_ft: Column, first: Column, last: Column) -> Column:
    """The field's elevation inside the inclusive on-ground window, also where altitude is missing; no window changes nothing."""
    return F.when(F.coalesce(t.between(first, last), F.lit(False)), field_ft).otherwise(alt_ft)


def first_finite(*columns: Column) -> Column:
    """The first of the aliases that is a finite number."""
    return F.coalesce(*(to_finite(c) for c in columns))


def heading_from_velocity(east: Column, north: Column) -> Column:
    """P20: compass degrees in [0, 360); NULL below 1e-6 m/s."""
    return F.when(F.sqrt(east * east + north * north) >= 1e-6, F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0)))


def vector_end(x: Column, y: Column, z: Column, vx: Column, vy: Column, vz: Column, seconds: float, least: float = 0.0) -> Column:
    """Where a velocity or acceleration vector of so many seconds ends, stretched to a least length; NULL for a vector without length."""
    size = F.sqrt(vx * vx + vy * vy + vz * vz)
    k = F.greatest(F.lit(seconds), least / size)
    return F.when(size > 1e-12, F.struct((x + k * vx).alias("x"), (y + k * vy).alias("y"), (z + k * vz).alias("z")))


def render_structs(field_ft: Column, lat0: float = REFERENCE_LAT, lon0: float = REFERENCE_LON) -> dict[str, Column]:
    """Position, velocity and acceleration structs of rendered columns x..az."""
    x, y, z, e, n, u, ae, an, au = (F.col(c) for c in ("x", "y", "z", "vx", "vy", "vz", "ax", "ay", "az"))
    at, speed = xy_to_latlon(x, y, lat0, lon0), F.sqrt(e * e + n * n)
    msl = z + field_ft * FT_TO_M
    return {
        "position": F.struct(x.alias("x_m"), y.alias("y_m"), z.alias("z_m"), at["lat"].alias("lat"), at["lon"].alias("lon"), msl.alias("altitude_m_msl"), (msl / FT_TO_M).alias("altitude_ft_msl"), z.alias("height_m")),
        "velocity": F.struct(e.alias("east_mps"), n.alias("north_mps"), u.alias("up_mps"), speed.alias("ground_speed_mps"), (speed / KNOT_TO_MPS).alias("ground_speed_kt"), F.when(speed > 0, F.pmod(F.degrees(F.atan2(e, n)), F.lit(360.0))).alias("track_deg")),
        "acceleration": F.struct(ae.alias("east_mps2"), an.alias("north_mps2"), au.alias("up_mps2"), F.sqrt(ae * ae + an * an).alias("horizontal_mps2"), F.sqrt(ae * ae + an * an + au * au).alias("total_mps2")),
    }


def score_low(x: Column, soft: float, hard: float) -> Column:
    """P25: 100 up to soft, 0 from hard on, a line between; NULL stays NULL."""
    return F.when(x <= soft, 100.0).when(x >= hard, 0.0).when(x.isNotNull(), 100 * (hard - x) / (hard - soft))


def boundary_event_bucket(reasons: Column, hard_gap: Column) -> Column:
    """What kind of event a boundary is, by its reasons (an array); normal_segment_join where they are NULL."""
    text = F.lower(F.coalesce(F.array_join(reasons, " "), F.lit("")))
    has = lambda *x: reduce(lambda a, b: a | b, [text.contains(y) for y in x])
    return (
        F.when(F.coalesce(hard_gap, F.lit(False)) | has("hard_gap"), "hard_gap").when(has("go_around", "missed_approach"), "go_around")
        .when(has("surveillance", "track_discontinuity", "true_discontinuity"), "surveillance_or_track_discontinuity").otherwise("normal_segment_join")
    )


def is_true_discontinuity(reasons: Column, hard_gap: Column) -> Column:
    """Gaps, go-arounds and named discontinuities part a track; other boundaries join."""
    text = F.lower(F.coalesce(F.array_join(reasons, " "), F.lit("")))
    named = [text.contains(x) for x in ("hard_gap", "go_around", "missed_approach", "surveillance_discontinuity", "track_discontinuity", "true_discontinuity")]
    return reduce(lambda a, b: a | b, named, F.coalesce(hard_gap, F.lit(False)))


def regime_bucket(label: Column, speed: Column) -> Column:
    """P28."""
    text = F.lower(label)
    return F.when(text.contains("ground") | (F.coalesce(speed, F.lit(0.0)) < 20), "ground").when(text.contains("descent") | text.contains("approach") | text.contains("final"), "approach_final").when(label.isNotNull(), "airborne").otherwise("unknown")


#: Speed floors (m/s) by regime bucket: accurate, balanced, smooth.
SPEED_FLOORS = {"ground": (3.0, 5.0, 8.0), "approach_final": (35.0, 45.0, 55.0), "airborne": (25.0, 35.0, 45.0), "unknown": (20.0, 30.0, 40.0)}
_PRESETS = ("accurate", "balanced", "smooth")


def speed_floor(bucket: Column, preset: Column) -> Column:
    """An unknown preset counts as balanced."""
    out = F.lit(None).cast("double")
    for name, floors in SPEED_FLOORS.items():
        own = F.when(preset == "accurate", floors[0]).when(preset == "smooth", floors[2]).otherwise(floors[1])
        out = F.when(bucket == name, own).otherwise(out)
    return out


def classify_regime(speed: Column, mismatch: Column, dominant: Column) -> Column:
    """ground_slow, the dominant label, or that label marked as noisy where reported and position velocity part too far."""
    label = F.coalesce(dominant, F.lit("energy_unknown"))
    noisy = (F.coalesce(mismatch, F.lit(0.0)) > F.greatest(F.lit(20.0), 0.45 * F.greatest(F.coalesce(speed, F.lit(0.0)), F.lit(1.0)))) & ~label.contains("rough_air")
    return F.when((F.coalesce(speed, F.lit(0.0)) < 25) | (label == "ground_slow"), "ground_slow").when(noisy & (label == "energy_unknown"), "noisy_airborne").when(noisy, F.concat(label, F.lit("__surveillance_noisy"))).otherwise(label)


def iso_utc(t: Column) -> Column:
    """Unix seconds as ISO text in UTC, whatever the session's zone."""
    seconds = F.floor(t)
    return F.concat(F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
