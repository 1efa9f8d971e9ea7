"""Table functions in SQL, quantile summaries, decoding of public frames, and the small operators of reports."""

import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trackspark.functions.tables import register_tables, spool_records
from trackspark.operators import compare, decode, prepare, segment_scores, sketch
from trackspark.sources import files


def spool(*payloads):
    return b"".join(struct.pack(">I6sBBB", 100 + i, (7 + i).to_bytes(6, "big"), 9, 0x32, len(p)) + p for i, p in enumerate(payloads))


def test_spools_in_sql_with_torn_records(spark, tmp_path):
    whole = spool(b"abc", b"", b"x" * 200)
    assert [r[4:] for r in spool_records(whole)] == [(b"abc", False), (b"", False), (b"x" * 200, False)]
    assert list(spool_records(whole[:-5]))[-1][4:] == (b"x" * 195, True)
    assert list(spool_records(whole + b"\x00" * 4))[-1] == (None,) * 5 + (True,)
    register_tables(spark)
    table = spark.createDataFrame([("a", bytearray(whole[:-5])), ("b", None), ("c", bytearray(b"")), ("d", bytearray(spool(b"q")))], "name string, content binary")
    got = spark.sql("select name, s.* from {t} as f, lateral spool_records(f.content) as s", t=table).collect()
    assert sorted((r.name, r.ts_utc, r.mlat48, r.torn) for r in got) == [("a", 100, 7, False), ("a", 101, 8, False), ("a", 102, 9, True), ("d", 100, 7, False)]
    (tmp_path / "one.bin").write_bytes(whole + b"\x01")
    back = files.read_spool(spark, str(tmp_path)).collect()
    assert len(back) == 3 and bytes(back[0].payload) == b"abc" and back[0].beast_type == 0x32


def test_resampled_tables_in_sql(spark):
    register_tables(spark)
    rows = [("a", 1, 0.0, 0.0), ("a", 1, 4.0, 8.0), ("a", 1, 4.0, 99.0), ("a", 1, 5.0, None), ("a", 1, 7.5, 3.0), ("a", 1, None, 1.0), ("b", 2, 3.0, 7.0), (None, 3, 1.0, 1.0)]
    t = spark.createDataFrame(rows, "k string, n int, t double, x double")
    got = {(r.k, r.t): r.x for r in spark.sql("select * from resampled(table({t}), 2.0d)", t=t).collect()}
    assert got == {("a", 0.0): 0.0, ("a", 2.0): 4.0, ("a", 4.0): 8.0, ("a", 6.0): None, ("a", 7.5): 3.0, ("b", 3.0): 7.0, (None, 1.0): 1.0}
    for bad in ("select * from resampled(table({t}), 0.0d)", "select * from resampled(table(select k from {t}), 1.0d)", "select * from resampled(1, 1.0d)"):
        with pytest.raises(PySparkException):
            spark.sql(bad, t=t).collect()


def rank_error(values, weights, x, q):
    total = weights.sum()
    low, high = weights[values < x].sum() / total, weights[values <= x].sum() / total
    return max(low - q, q - high, 0.0)


@pytest.mark.parametrize("kind", ["even", "skewed", "few", "heavy"])
def test_summaries_keep_ranks(kind):
    rng = np.random.default_rng(5)
    values = {"skewed": rng.lognormal(0, 3, 50_000), "few": rng.integers(0, 5, 50_000).astype(float)}.get(kind, rng.uniform(0, 1, 50_000))
    weights = np.where(rng.random(50_000) < 0.001, 5000.0, 1.0) if kind == "heavy" else rng.uniform(0.1, 2, 50_000)
    v, w = sketch.summary(values, weights, 200)
    assert len(v) <= 401 and np.isclose(w.sum(), weights.sum()) and (np.diff(v) >= 0).all()
    for q in (0.01, 0.25, 0.5, 0.9, 0.99):
        assert rank_error(values, weights, v[min(np.searchsorted(np.cumsum(w), q * w.sum()), len(v) - 1)], q) <= 1 / 200


def test_sketched_quantiles_of_a_hot_key(spark, monkeypatch):
    rng = np.random.default_rng(7)
    key = np.where(rng.random(60_000) < 0.7, "hot", rng.choice(["a", "b"], 60_000))
    df = pd.DataFrame({"k": key, "n": 1, "v": rng.lognormal(0, 2, 60_000), "w": rng.choice([0.0, 1.0, 3.0], 60_000)})
    table = spark.createDataFrame(df).repartition(9)
    monkeypatch.setattr(sketch, "HELD", 3000)
    for q in (0.05, 0.5, 0.95):
        got = sketch.weighted_quantile(table, ["k", "n"], "v", "w", q, approximate=True, entries=300).toPandas()
        assert sorted(got.k) == ["a", "b", "hot"]
        for r in got.itertuples():
            own = df[(df.k == r.k) & (df.w > 0)]
            assert rank_error(own.v.to_numpy(), own.w.to_numpy(), r.wq_v, q) <= 0.01
    largest = sketch.summaries(table, ["k"], "v", "w", 300).agg(F.max(F.size("v"))).first()[0]
    assert largest <= 601  # whatever the key's rows
    exact = sketch.weighted_quantile(table, ["k"], "v", "w", 0.5).toPandas()
    for r in exact.itertuples():
        own = df[(df.k == r.k) & (df.w > 0)].sort_values("v")
        assert r.wq_v == own.v.iloc[np.searchsorted(own.w.cumsum(), 0.5 * own.w.sum())]
    odd = spark.createDataFrame([(None, 1.0, 1.0), ("x", None, 1.0), ("x", float("nan"), 1.0), ("y", 2.0, -1.0)], "k string, v double, w double")
    assert [tuple(r) for r in sketch.weighted_quantile(odd, ["k"], "v", "w", 0.5, approximate=True).collect()] == [(None, 1.0)]


@pytest.mark.parametrize("gray,feet", [
    ("00000000010", -1000), ("00000001010", -500), ("00000011011", -100), ("00000011010", 0), ("00000011110", 100), ("00000010011", 600), ("00000110010", 1000), ("00001001001", 5800),
    ("00011100100", 10300), ("01100011010", 32000), ("01110000100", 46300), ("01010101100", 50200), ("11011110100", 73200), ("10000000011", 126600), ("10000000001", 126700),
])
def test_gray_altitudes(gray, feet):
    assert decode.gray_altitude(int(gray, 2)) == feet


def test_altitude_codes(spark):
    code = lambda feet: (int((feet + 1000) / 25) >> 4 << 5) | 16 | (int((feet + 1000) / 25) & 15)
    steps = [decode.coded_altitude(code(x)) for x in (-1000, 38000, 50175)]
    assert steps == [-1000, 38000, 50175] and decode.coded_altitude(0) is None
    gray = sorted(x for c in range(4096) if not c >> 4 & 1 and (x := decode.coded_altitude(c)) is not None)
    assert len(gray) == len(set(gray)) == 1280 and set(np.diff(gray)) == {100.0}  # every hundred feet once
    got = spark.createDataFrame([(c,) for c in range(4096)], "c int").select("c", decode.altitude_feet(F.col("c")).alias("f")).collect()
    assert all(r.f == decode.coded_altitude(r.c) for r in got)


def test_public_surface_frames_are_placed_by_pair_and_reference(spark):
    f = spark.createDataFrame([(1, "8C4841753AAB238733C8CD4020B1"), (2, "8C4841753A8A35323FAEBDAC702D")], "id long, payload_hex string")
    d = decode.decode_frames(f)
    near = decode.resolve_position(d, 51.990, 4.375).where("id = 2").first()
    assert near.crc_ok == 1 and near.surface and near.position_source == "pair" and near.alt is None
    assert near.lat == pytest.approx(52.320607, abs=1e-6) and near.lon == pytest.approx(4.734735, abs=1e-6)
    far = decode.resolve_position(d, -37.0, -85.0).where("id = 2").first()  # the same pair seen from the other quarter
    assert far.lat == pytest.approx(52.320607 - 90, abs=1e-6) and abs(far.lon + 85) <= 45
    alone = decode.resolve_position(d, 51.990, 4.375, pairs=False).where("id = 2").first()
    assert alone.position_source == "reference" and alone.lat == pytest.approx(52.320607, abs=1e-5)


def test_reports_selection_and_scores(spark):
    flights = spark.createDataFrame([("A1", "4b0001"), ("B2", "4b0002"), ("C3", None)], "track_id string, icao string")
    assert sorted(r.track_id for r in compare.selected_flights(flights, [" a1", "4B0002", "A1"]).collect()) == ["A1", "B2"]
    with pytest.raises(PySparkException, match="no flight ZZ"):
        compare.selected_flights(flights, ["A1", "zz"]).collect()
    m = spark.createDataFrame([("a", "m", "x_count", 2.0, 1.0), ("b", "m", "x_count", 3.0, 3.0), ("a", "m", "v_rmse", 3.0, 1.0), ("b", "m", "v_rmse", 5.0, 3.0), ("a", "m", "not_rmsed", 1.0, 1.0), ("b", "m", "not_rmsed", 5.0, 3.0), ("c", "m", "not_rmsed", 9.0, 0.0)], "track_id string, method string, metric string, value double, weight double")
    got = {r.metric: r.value for r in compare.aggregate_dataset(m, ["method"], "weight").collect()}
    assert got == {"x_count": 5.0, "v_rmse": pytest.approx(np.sqrt((9 + 75) / 4)), "not_rmsed": 4.0}
    texts = spark.createDataFrame([("m", "u", "v"), ("m", "u", "w"), ("n", None, "z")], "method string, a string, b string")
    assert {r.method: (r.a, r.b) for r in compare.common_texts(texts, ["method"], ["a", "b"]).collect()} == {"m": ("u", None), "n": (None, "z")}
    whole = m.unionByName(m.withColumn("method", F.lit("n")).where("track_id = 'a'"))
    assert {r.method for r in compare.require_all(whole.where("metric = 'not_rmsed'")).collect()} == {"m"}
    s = spark.createDataFrame([("a", "m", "ground", 10.0, 5, 40.0), ("a", "m", "ground", 30.0, 5, 80.0), ("a", "m", None, 0.0, 4, 50.0)], "track_id string, method string, bucket string, duration double, n long, score double")
    assert {r.bucket: (r.n_segments, r.score) for r in segment_scores.regime_scores(s).collect()} == {"ground": (2, 70.0), "airborne": (0, None), "approach_final": (0, None), "unknown": (1, 50.0)}


def test_each_check_of_a_keyframe_can_fail_first(spark):
    base = {"paired": False, "full_position": True, "full_velocity": True, "lat": 1.0, "lon": 1.0, "ve": 1.0, "vn": 1.0, "alt": 1.0, "vz": 1.0, "frame": "local_enu", "t": 1.0}
    cases = {"used": {}, "no full position": {"full_position": False}, "no full velocity": {"full_velocity": False}, "no objects": {"lat": None}, "not three-dimensional": {"alt": None}, "other frame": {"frame": "ecef"}, "no vertical rate": {"vz": None}, "number not finite": {"vn": float("inf")}}
    k = spark.createDataFrame([base | c | {"name": n} for n, c in cases.items()], "name string, paired boolean, full_position boolean, full_velocity boolean, lat double, lon double, ve double, vn double, alt double, vz double, frame string, t double")
    assert all((r.skip_reason or "used") == r.name for r in prepare.skip_reason(k, require_paired=False).collect())
    assert {r.skip_reason for r in prepare.skip_reason(k).collect()} == {"not paired"}
