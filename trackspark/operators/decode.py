"""Frames to fields: header, checksum and parity pairs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Generator polynomial of the 24-bit checksum of public 1090 MHz extended squitter frames.
GENERATOR = 0x1FFF409


def frame_header(frames: DataFrame) -> DataFrame:
    """Downlink format and, for frames of 7 or 14 bytes, the address in upper case."""
    df = F.shiftright(F.conv(F.substring("payload_hex", 1, 2), 16, 10).cast("int"), 3)
    sized = F.length("payload_hex").isin(14, 28)
    return frames.withColumns({"df": F.when(sized, df), "icao": F.when(sized, F.upper(F.substring("payload_hex", 3, 6)))})


def _powers() -> list[list[int]]:
    """The remainder of each byte value by the generator, by the number of bytes behind it, up to 13."""
    out = [list(range(256))]
    for _ in range(13):
        row = []
        for rest in out[-1]:
            for _ in range(8):
                rest = rest << 1 ^ (GENERATOR if rest >> 23 & 1 else 0)
            row.append(rest)
        out.append(row)
    return out


def crc_remainder(payload_hex: Column) -> Column:
    """Remainder of the whole frame by the generator; 0 where the frame is intact. Remainders add up bit by bit, so that of a frame of 7 or
    14 bytes is its bytes' own, looked up by value and place; other sizes go byte by byte. Without Python."""
    size = F.length(payload_hex) / 2
    powers = _powers()
    byte = lambda i: F.conv(payload_hex.substr(2 * i + 1, F.lit(2)), 16, 10).cast("int")

    def sized(n: int) -> Column:
        out = F.lit(0).cast("long")
        for i in range(n):
            out = out.bitwiseXOR(F.get(F.lit(powers[n - 1 - i]), byte(F.lit(i))).cast("long"))
        return out

    def step(acc: Column, i: Column) -> Column:
        """The byte joins at the end; the one that leaves at the front comes back as its remainder, three bytes on."""
        behind = F.shiftleft(acc.bitwiseAND(F.lit(0xFFFF)), 8).bitwiseOR(byte(i).cast("long"))
        return behind.bitwiseXOR(F.get(F.lit(powers[3]), F.shiftright(acc, 16).cast("int")).cast("long"))

    other = F.aggregate(F.sequence(F.lit(0), size.cast("int") - 1), F.lit(0).cast("long"), step)
    return F.when(size == 14, sized(14)).when(size == 7, sized(7)).when(size > 3, other)


def pair_even_odd(frames: DataFrame) -> DataFrame:
    """D3: the last even and the last odd frame of each address and surface flag up to each frame, itself included."""
    w = Window.partitionBy("icao", "surface").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda odd: F.last(F.when(F.col("odd") == odd, F.col("id")), ignorenulls=True).over(w)
    return frames.withColumns({"even_id": last(0), "odd_id": last(1)})


def bits(payload_hex: Column, first: int, n: int) -> Column:
    """Bits first .. first + n - 1 of a frame, counted from 1, as a number; n at most 48."""
    a, b = (first - 1) // 4, (first + n - 2) // 4
    value = F.conv(F.substring(payload_hex, a + 1, b - a + 1), 16, 10).cast("long")
    return F.shiftright(value, 4 * (b + 1) - (first + n - 1)).bitwiseAND(F.lit((1 << n) - 1))


def gray_altitude(gray: int) -> float | None:
    """Feet of an 11-bit altitude in reflected Gray code (D2 D4 A1 A2 A4 B1 B2 B4 C1 C2 C4): eight bits count steps of 500 ft, three the
    steps of 100 ft inside, which run backwards in odd steps. None for codes that no altitude has."""
    coarse, fine = gray >> 3, gray & 7
    for k in (4, 2, 1):
        coarse, fine = coarse ^ coarse >> k, fine ^ fine >> k
    if fine in (0, 5, 6):
        return None
    fine = 5 if fine == 7 else fine
    return coarse * 500.0 + (6 - fine if coarse % 2 else fine) * 100 - 1300


def coded_altitude(code: int) -> float | None:
    """Feet of a 12-bit code C1 A1 C2 A2 C4 A4 B1 Q B2 D2 B4 D4: with Q steps of 25 ft from -1000, else reflected Gray code; None for 0."""
    if code >> 4 & 1:
        return ((code >> 5) * 16 + (code & 15)) * 25.0 - 1000
    gray = 0
    for k in (2, 0, 10, 8, 6, 5, 3, 1, 11, 9, 7):
        gray = gray * 2 + (code >> k & 1)
    return gray_altitude(gray) if code else None


_UNKNOWN = -1e6


def altitude_feet(code: Column) -> Column:
    """coded_altitude() of a column, by a table of the 4096 codes that the rule makes."""
    table = F.array(*(F.lit(_UNKNOWN if (x := coded_altitude(c)) is None else x) for c in range(4096)))
    return F.nullif(F.get(table, code.cast("int")), F.lit(_UNKNOWN))


_LETTERS = "#ABCDEFGHIJKLMNOPQRSTUVWXYZ##### ###############0123456789######"


def decode_frames(frames: DataFrame) -> DataFrame:
    """Checksum, type code, callsign, altitude, raw position and velocity of frames(payload_hex); other formats keep NULL fields.

    Downlink formats 17 and 18 only. Altitude in feet: barometric codes in steps of 25 ft or, in Gray code, of 100 ft; metres of type codes
    20 to 22 converted. Velocity of subtypes 1 and 2: ground speed in knots, track in degrees, vertical rate in feet a minute. Position: the
    parity bit (odd) and the 17-bit coordinates; surface: type codes 5 to 8.
    """
    f = frame_header(frames)
    h = F.col("payload_hex")
    rest = crc_remainder(h)
    long_ = (F.length(h) == 28) & F.col("df").isin(17, 18)
    tc = F.when(long_, bits(h, 33, 5))
    f = f.withColumns({"crc": F.when(F.length(h).isin(14, 28), rest), "tc": tc})
    f = f.withColumn("crc_ok", F.when(F.col("crc").isNull(), None).when(F.col("crc") == 0, 1).otherwise(0))
    tc = F.col("tc")
    letters = F.concat(*(F.expr(f"substring('{_LETTERS}', cast(_c{k} + 1 as int), 1)") for k in range(8)))
    f = f.withColumns({f"_c{k}": bits(h, 41 + 6 * k, 6) for k in range(8)})
    code = bits(h, 41, 12)
    alt = F.when(tc.between(9, 18), altitude_feet(code)).when(tc.between(20, 22), code / 0.3048)
    moving = tc.isin(19) & bits(h, 38, 3).isin(1, 2)
    scale = F.when(bits(h, 38, 3) == 2, 4).otherwise(1)
    part = lambda sign, size: F.when(bits(h, size, 10) > 0, (bits(h, size, 10) - 1) * scale * F.when(bits(h, sign, 1) == 1, -1).otherwise(1))
    east, north = F.when(moving, part(46, 47)), F.when(moving, part(57, 58))
    rate = F.when(moving & (bits(h, 70, 9) > 0), (bits(h, 70, 9) - 1) * 64 * F.when(bits(h, 69, 1) == 1, -1).otherwise(1))
    place = tc.between(5, 8) | tc.between(9, 18) | tc.between(20, 22)
    f = f.withColumns({
        "callsign": F.when(tc.between(1, 4), F.nullif(F.trim(F.regexp_replace(letters, "#", "")), F.lit(""))), "alt": alt, "surface": F.when(place, tc.between(5, 8)), "odd": F.when(place, bits(h, 54, 1)),
        "cpr_lat": F.when(place, bits(h, 55, 17)), "cpr_lon": F.when(place, bits(h, 72, 17)), "gs": F.sqrt((east * east + north * north).cast("double")),
        "track": F.when((east != 0) | (north != 0), F.pmod(F.degrees(F.atan2(east.cast("double"), north.cast("double"))), F.lit(360.0))), "vertical_rate": rate.cast("double"),
    })
    return f.drop(*(f"_c{k}" for k in range(8)))


def _zones(lat: Column) -> Column:
    """Number of longitude zones at a latitude, of the public compact position format with 15 latitude zones."""
    inner = 1 - (1 - F.cos(F.pi() / 30)) / F.pow(F.cos(F.radians(F.abs(lat))), F.lit(2))
    return F.when(F.abs(lat) >= 87, F.when(F.abs(lat) > 87, 1).otherwise(2)).otherwise(F.floor(2 * F.pi() / F.acos(inner)))


def resolve_position(decoded: DataFrame, lat0: float, lon0: float, pairs: bool = True) -> DataFrame:
    """Lat and lon of frames from the last even and odd ones of the address (both zones must agree), else from the reference point
    within half a zone. Surface pairs leave a quarter of the globe open: of the latitudes a quarter apart north and south, and the four
    longitudes, the ones nearest the reference point are taken. Order: id. No age limit: frames of an address that come out of order,
    or far apart, are better placed without pairs, by the reference point alone (pairs=False)."""
    w = Window.partitionBy("icao", "surface").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    raw = F.struct("cpr_lat", "cpr_lon", "id")
    d = decoded.withColumns({f"_{n}": F.last(F.when(F.col("odd") == o, raw), ignorenulls=True).over(w) for n, o in (("even", 0), ("last_odd", 1))})
    full = float(1 << 17)
    y0, y1, x0, x1 = F.col("_even.cpr_lat") / full, F.col("_last_odd.cpr_lat") / full, F.col("_even.cpr_lon") / full, F.col("_last_odd.cpr_lon") / full
    j, late, surface = F.floor(59 * y0 - 60 * y1 + 0.5), F.col("odd") == 1, F.coalesce("surface", F.lit(False))
    span = F.when(surface, 90.0).otherwise(360.0)

    def latitude(zones: int, y: Column) -> Column:
        north = span / zones * (F.pmod(j, F.lit(zones)) + y)
        nearer = F.when(F.abs(north - lat0) <= F.abs(north - 90 - lat0), north).otherwise(north - 90)
        return F.when(surface, nearer).when(north >= 270, north - 360).otherwise(north)

    d = d.withColumns({"_lat0": latitude(60, y0), "_lat1": latitude(59, y1)})
    d = d.withColumns({"_lat": F.when(late, F.col("_lat1")).otherwise(F.col("_lat0")), "_z0": _zones(F.col("_lat0")), "_z1": _zones(F.col("_lat1"))})
    z = F.col("_z0")
    n = F.greatest(z - F.when(late, 1).otherwise(0), F.lit(1))
    m = F.floor(x0 * (z - 1) - x1 * z + 0.5)
    east = span / n * (F.pmod(m, n) + F.when(late, x1).otherwise(x0))
    quarter = east + 90 * F.rint((lon0 - east) / 90)
    lon = F.pmod(F.when(surface, quarter).otherwise(east) + 180, F.lit(360)) - 180
    pair = (F.col("_z0") == F.col("_z1")) & F.col("odd").isNotNull() & F.lit(pairs)
    dlat = span / (60 - F.col("odd"))
    y, x = F.col("cpr_lat") / full, F.col("cpr_lon") / full
    at = F.floor(lat0 / dlat) + F.floor(0.5 + (lat0 - dlat * F.floor(lat0 / dlat)) / dlat - y)
    near_lat = dlat * (at + y)
    dlon = span / F.greatest(_zones(near_lat) - F.col("odd"), F.lit(1))
    on = F.floor(lon0 / dlon) + F.floor(0.5 + (lon0 - dlon * F.floor(lon0 / dlon)) / dlon - x)
    d = d.withColumns({
        "lat": F.coalesce(F.when(pair, F.col("_lat")), near_lat), "lon": F.coalesce(F.when(pair, lon), dlon * (on + x)),
        "position_source": F.when(F.col("odd").isNull(), None).when(F.coalesce(pair, F.lit(False)), "pair").otherwise("reference"), "even_id": F.col("_even.id"), "odd_id": F.col("_last_odd.id"),
    })
    return d.drop("_even", "_last_odd", "_lat", "_lat0", "_lat1", "_z0", "_z1")


def decode_all(frames: DataFrame, decoded: DataFrame, batch: int, stage) -> DataFrame:
    """D5's loop: batches of the oldest `batch` frames that are not decoded yet, until none is left; the new rows of all batches.

    stage(df, name) keeps a batch (a written table on a cluster); the driver holds only how many batches there were.
    """
    known, out, nth = decoded.select("id"), None, 0
    while True:
        new = stage(decode_incremental(frames, known, batch), f"decoded-{nth}")
        if new.isEmpty():
            return new if out is None else out
        out = new if out is None else out.unionByName(new)
        known, nth = known.unionByName(new.select("id")), nth + 1


def nth_id(df: DataFrame, n: int, parts: int = 1024) -> int | None:
    """The n-th least id, None where there are fewer rows: counts of equal parts of the ids' range, then of that part alone, until a part is
    one id. No rows are ordered, and at most `parts` counts come to the driver at a time."""
    low, high = df.agg(F.min("id"), F.max("id")).first()
    while low is not None and low < high:
        width = -(-(high - low + 1) // parts)
        counts = df.where(F.col("id").between(low, high)).groupBy(F.expr(f"(id - ({low})) div {width}").alias("part")).count().collect()
        for part, size in sorted(counts):
            if size >= n:
                break
            n -= size
        else:
            return None
        low, high = low + part * width, min(high, low + (part + 1) * width - 1)
    return low


def decode_incremental(frames: DataFrame, decoded: DataFrame, batch: int | None = None) -> DataFrame:
    """Decoded fields of the frames (id) above the largest id in decoded that are not in it; batch: the oldest so many (and those that
    share the last id), one step of a loop."""
    last = decoded.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("_last"))
    new = frames.join(F.broadcast(last), F.col("id") > F.col("_last")).drop("_last").join(decoded.select("id"), "id", "left_anti")
    end = nth_id(new.select("id"), batch) if batch else None
    return decode_frames(new if end is None else new.where(F.col("id") <= end))


def decoded_json(decoded: DataFrame) -> DataFrame:
    """The decoded fields that are known as one JSON text, with velocity_raw [gs, track, rate, source]."""
    raw = F.when(F.col("gs").isNotNull(), F.array(*(F.col(c).cast("string") for c in ("gs", "track", "vertical_rate")), F.lit("GS")))
    return decoded.withColumn("decoded_json", F.to_json(F.struct("df", "icao", "tc", "callsign", "alt", "gs", "track", "vertical_rate", raw.alias("velocity_raw"))))
