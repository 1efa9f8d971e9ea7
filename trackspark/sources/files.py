"""Rule documents, spools, and the sinks."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackspark.functions import scalars as S
from trackspark.functions.tables import register_tables

RULE_SCHEMA = (
    "rules array<struct<track_id string, icao string, time_window struct<first_point_unix double, last_point_unix double>, "
    "field_elevation struct<value double, unit string>, boundary struct<value double, unit string>, outlier_multiplier struct<value double, unit string>, "
    "require_crc_ok boolean, allowed_events array<string>, keyframe_time_quantization_s double>>"
)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """IO5: rule documents as a table. Repeated ids, windows that end before they begin and unknown units are errors when read."""
    r = spark.read.schema(RULE_SCHEMA).json(path, multiLine=True).select(F.explode("rules").alias("r")).select("r.*")
    finite = lambda c: S.to_finite(F.col(c)).isNotNull()
    unit = lambda c, *units: F.coalesce(F.lower(f"{c}.unit").isin(*units), F.lit(True))
    ok = (
        F.col("track_id").isNotNull() & finite("time_window.first_point_unix") & finite("time_window.last_point_unix") & (F.col("time_window.first_point_unix") <= F.col("time_window.last_point_unix"))
        & unit("boundary", "km") & unit("outlier_multiplier", "iqr") & unit("field_elevation", "ft", "m") & F.coalesce(F.col("keyframe_time_quantization_s") > 0, F.lit(True))
    )
    one = r.groupBy("track_id").agg(F.count("*").alias("_n"))
    checked = r.join(one, "track_id")
    keep = F.when(F.coalesce(ok, F.lit(False)) & (F.col("_n") == 1), True).otherwise(F.raise_error(F.concat(F.lit("invalid rule "), F.coalesce("track_id", F.lit("?")))).cast("boolean"))
    defaults = {"require_crc_ok": F.lit(False), "keyframe_time_quantization_s": F.lit(1.0), "allowed_events": F.array(F.lit("position"), F.lit("velocity"))}
    height = F.col("field_elevation.value") * F.when(F.lower("field_elevation.unit") == "m", 1 / S.FT_TO_M).otherwise(1.0)
    return checked.where(keep).drop("_n").withColumns({k: F.coalesce(F.col(k), v) for k, v in defaults.items()} | {"field_ft": F.coalesce(height, F.lit(0.0)), "iqr_k": F.coalesce("outlier_multiplier.value", F.lit(3.0))})


def select_rules(rules: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """IO6: all rules, or those asked for by track id, else by an address that a single rule has. One that is missing, or an address of
    several rules, is an error when read; one asked for twice is warned of."""
    if not wanted:
        return rules
    if len({w.upper() for w in wanted}) < len(wanted):
        warnings.warn("a rule is asked for twice", stacklevel=2)
    asked = rules.sparkSession.createDataFrame([(w.upper(),) for w in dict.fromkeys(wanted)], "asked string")
    r = rules.withColumns({"_by_id": F.upper("track_id"), "_by_icao": F.upper("icao")})
    own = asked.join(r, F.col("asked") == F.col("_by_id")).withColumn("_how", F.lit(0))
    other = asked.join(r, F.col("asked") == F.col("_by_icao")).withColumn("_how", F.lit(1))
    j = asked.join(own.unionByName(other).withColumnRenamed("asked", "_asked"), F.col("asked") == F.col("_asked"), "left")
    w = Window.partitionBy("asked")
    j = j.withColumn("_least", F.min("_how").over(w)).where("_how is null or _how = _least").withColumn("_n", F.count("*").over(w))
    error = lambda text: F.raise_error(F.concat(F.lit(text), "asked")).cast("boolean")
    ok = F.when(F.col("_how").isNull(), error("no rule for ")).when((F.col("_how") == 1) & (F.col("_n") > 1), error("several rules for ")).otherwise(True)
    return j.where(ok).select(*rules.columns).distinct()


def read_messages_for_rules(messages: DataFrame, rules: DataFrame, push_time: bool = False, push_crc: bool = False) -> DataFrame:
    """IO4: messages of the rules' addresses; on request also only those inside some window of their address, and intact ones. The filters
    stand before any other work, so they reach the scan."""
    m = messages.where("crc_ok = 1") if push_crc else messages
    r = rules.select(F.upper("icao").alias("_icao"), *(["t_first", "t_last"] if push_time else [])).distinct()
    on = F.upper("icao") == F.col("_icao")
    return m.join(r, on & F.col("ts_utc").between(F.col("t_first"), F.col("t_last")) if push_time else on, "left_semi")


def find_message_table(spark: SparkSession, required: list[str], preferred: list[str] = (), database: str | None = None) -> str | None:
    """IO3: the table of the catalog that has most of the required columns (none: no table); ties by preferred names, then by name."""
    best = None
    for t in spark.catalog.listTables(database):
        have = {c.name.lower() for c in spark.catalog.listColumns(t.name, None if t.isTemporary else database)}
        n = sum(c.lower() in have for c in required)
        rank = (-n, list(preferred).index(t.name) if t.name in preferred else len(preferred), t.name)
        if n and (best is None or rank < best[0]):
            best = (rank, t.name)
    return best[1] if best else None


def load_report(messages: DataFrame, source: str = "source") -> DataFrame:
    """IO7: rows, first and last time, and rows with a vertical rate by source (MISSING where it is not known), and over all (source NULL)."""
    m = messages if source in messages.columns else messages.withColumn(source, F.lit(None).cast("string"))
    fpm = S.vertical_rate_fpm(F.col("decoded_json"))
    named = m.select(F.coalesce(F.col(source), F.lit("MISSING")).alias("source"), "ts_utc", fpm.alias("fpm"))
    return named.groupingSets([["source"], []], "source").agg(F.count("*").alias("n"), F.min("ts_utc").alias("t_min"), F.max("ts_utc").alias("t_max"), F.count("fpm").alias("n_vertical_rate"))


def split_events(keyframes: DataFrame, events: DataFrame, path: str) -> DataFrame:
    """IO10: writes keyframes without their events, and the events beside them; returns a row with both paths and raw_event_count."""
    keyframes.drop("events", "raw_ids", "event_kinds").write.mode("overwrite").parquet(f"{path}/main")
    events.write.mode("overwrite").parquet(f"{path}/events")
    spark = keyframes.sparkSession
    n = spark.read.schema(events.schema).parquet(f"{path}/events").agg(F.count("*").alias("raw_event_count"))
    return n.withColumns({"main": F.lit(f"{path}/main"), "events": F.lit(f"{path}/events")})


def write_csv(tables: dict[str, DataFrame], path: str) -> list[str]:
    """IO13: report tables as CSV folders with a header; lists and structs as JSON text."""
    out = []
    for name, df in tables.items():
        flat = df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes))
        flat.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
        out.append(f"{path}/{name}")
    return out


def reference_metadata(keyframes: DataFrame, rules: DataFrame, q: float = 1.0) -> DataFrame:
    """IO15: by track the frame, origin (the rule's, else the first keyframe with a position), field elevation, units and bucket."""
    first = keyframes.where("lat is not null and lon is not null").groupBy("track_id").agg(F.min_by(F.struct("lat", "lon"), "t").alias("at"), F.count("*").alias("n_positions"))
    have = set(rules.columns)
    told = [F.col(c) if c in have else F.lit(None).cast("double").alias(c) for c in ("origin_lat", "origin_lon", "field_ft", "q")]
    r = rules.select("track_id", F.struct(*told).alias("r")).groupBy("track_id").agg(F.min("r").alias("r")).select("track_id", "r.*")  # flights that share a track have a rule each
    j = first.join(r, "track_id", "left")
    own = F.col("origin_lat").isNotNull() & F.col("origin_lon").isNotNull()
    return j.select(
        "track_id", F.lit("horizontal_enu_plus_barometric_z").alias("frame"), F.when(own, F.col("origin_lat")).otherwise(F.col("at.lat")).alias("lat0"), F.when(own, F.col("origin_lon")).otherwise(F.col("at.lon")).alias("lon0"),
        F.when(own, "rule").otherwise("first_keyframe").alias("origin_source"), F.coalesce("field_ft", F.lit(0.0)).alias("field_ft"), F.lit("m").alias("unit"), F.coalesce("q", F.lit(q)).alias("bucket_s"), "n_positions",
    )




def read_spool(spark: SparkSession, path: str) -> DataFrame:
    """IO14: binary logs of (time 4 bytes, mlat 6, signal, type, length, payload), big-endian, as rows by the table function spool_records; a
    torn last record is left out. A task reads whole files."""
    register_tables(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return spark.sql("select path, s.* except (torn) from {files} as f, lateral spool_records(f.content) as s where not s.torn", files=files)


def write_tracks(df: DataFrame, path: str) -> DataFrame:
    """IO8: output by track and method, and its manifest as a table: times, methods, the default (the first of them), callsign where there is one."""
    df.write.mode("overwrite").partitionBy("track_id", "method").parquet(path)
    callsign = [F.max("callsign").alias("callsign")] if "callsign" in df.columns else [F.lit(None).cast("string").alias("callsign")]
    return df.groupBy("track_id").agg(F.min("method").alias("default_method"), *callsign, F.min("t").alias("t0"), F.max("t").alias("t1"), F.array_sort(F.collect_set("method")).alias("methods"), F.count("*").alias("n"))


def minimal_view(render: DataFrame) -> DataFrame:
    """IO9: per segment its rows, and first and last time."""
    return render.groupBy("track_id", "segment").agg(F.count("*").alias("n_frames"), F.min("t").alias("t0"), F.max("t").alias("t1"))


def point_features(points: DataFrame) -> DataFrame:
    """IO12: a feature for each point."""
    p = points.where("lat is not null and lon is not null")
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat", "alt_m").alias("coordinates")).alias("geometry"), F.struct("track_id", "t").alias("properties"))
    return p.select("track_id", "t", F.to_json(feature).alias("feature"))


def to_geojson(points: DataFrame) -> DataFrame:
    """IO12: a feature for each track: its points in order of time as a line, altitude in metres."""
    at = F.struct("t", "lon", "lat", F.col("alt_m"))
    ordered = F.transform(F.sort_array(F.collect_list(at)), lambda p: F.array(p["lon"], p["lat"], p["alt_m"]))
    line = points.where("lat is not null and lon is not null").groupBy("track_id").agg(ordered.alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), "coordinates").alias("geometry"), F.struct("track_id").alias("properties"))
    return line.select("track_id", F.to_json(feature).alias("feature"))


def read_keyframes_json(spark: SparkSession, path: str, schema: str, aliases: dict[str, list[str]] | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """IO11: nested keyframes flat; aliases {column: paths} take the first finite number of several fields; rows without t go; of repeated
    times of a key the mean of numbers and the least of others."""
    k = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("keyframes").alias("k")).select("k.*")
    for name, paths in (aliases or {}).items():
        k = k.withColumn(name, S.first_finite(*(F.col(p) for p in paths)))
    k = k.where("t is not null")
    by = [*keys, "t"]
    numbers = [c for c, t in k.dtypes if t == "double" and c not in by]
    others = [c for c, t in k.dtypes if t != "double" and c not in by and not t.startswith(("struct", "map"))]
    return k.groupBy(*by).agg(*(F.avg(c).alias(c) for c in numbers), *(F.min(c).alias(c) for c in others))
