"""Streams with typed state and timers against batch operators, replayed batches, and the smoother as a scan."""

import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackspark import staging
from trackspark.operators import decode, scan, smoothing
from trackspark.operators import timeseries as T
from trackspark.streaming import stateful, streams

AXES = ["x", "y", "z", "vx", "vy", "vz"]
PARTS = 20


def noisy_tracks(n=200, seed=0, tracks=3):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(tracks):
        t = 1000 + np.cumsum(rng.choice([0.7, 1.3, 4.0], n))
        pos = np.stack([80 * t, 300 * np.sin(t / 20 + k), 600 + 2 * t], 1) + rng.normal(0, 10, (n, 3))
        vel = np.gradient(pos, t, axis=0) + rng.normal(0, 3, (n, 3))
        pos[n // 3 : n // 3 + 4] += 900  # outliers, so that the noise scales matter
        out.append(pd.DataFrame({"track_id": f"T{k}", "t": t} | {c: np.c_[pos, vel][:, j] for j, c in enumerate(AXES)}))
    return out


def files(frames, order, parts=PARTS, seed=0):
    """A folder of files in order of `order`, rows shuffled inside each."""
    path = tempfile.mkdtemp(prefix="spark-")
    whole = pd.concat(frames).sort_values(order)
    for i, at in enumerate(np.array_split(np.arange(len(whole)), parts)):
        name = f"{path}/f{i:03d}.parquet"
        whole.iloc[at].sample(frac=1, random_state=seed + i).to_parquet(name, index=False, coerce_timestamps="us")
        os.utime(name, (1e9 + i, 1e9 + i))
    return path


def stream(spark, path):
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def last_checkpoint(spark):
    base = staging.shared_dir(spark).removeprefix("file://")
    return max((f"{base}/{x}/checkpoint" for x in os.listdir(base) if x.startswith("stream-")), key=os.path.getmtime)


def state(spark, checkpoint, name):
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()


def test_online_filter_equals_the_batch_filter_with_constant_state(spark):
    tracks = noisy_tracks()
    short, clock = tracks[0].head(4).assign(track_id="short"), tracks[0].tail(1).assign(track_id="clock", t=90_000.0)
    path = files([*tracks, short, clock], "t", 40)
    with stateful.state_store(spark):
        got = streams.run_to_table(stateful.filtered_online(stream(spark, path), late="30 seconds")).toPandas()
        kept = state(spark, last_checkpoint(spark), "filter").count()
    assert kept == 0  # all tracks went silent, and the last row of the clock is the watermark's own
    for own in [*tracks, short]:
        f = smoothing.forward(own.t.to_numpy(), own[AXES[:3]].to_numpy(), own[AXES[3:]].to_numpy(), smoothing.PRESETS["balanced"])
        g = got[got.track_id == own.track_id.iloc[0]].sort_values("t")
        assert len(g) == len(own)
        assert np.allclose(g[["x", "y", "z", "ax", "ay", "az"]], np.c_[f.x[:, :, 0], f.x[:, :, 2]], rtol=0, atol=1e-9)


def test_state_of_the_filter_does_not_grow(spark):
    path = files(noisy_tracks(300, 3, 2), "t", 10)
    with stateful.state_store(spark):
        streams.run_to_table(stateful.filtered_online(stream(spark, path), late="1 seconds"))
        rows = state(spark, last_checkpoint(spark), "filter").select("value.*").collect()
    assert len(rows) == 2 and all(len(r.mean) == 9 and len(r.covariance) == 27 for r in rows)


def timed(rows):
    """(key columns..., seconds) -> a frame with ts."""
    return pd.DataFrame(rows).assign(ts=lambda d: pd.to_datetime("2024-01-01") + pd.to_timedelta(d.s, "s"))


def test_stream_pairs_equal_batch_pairs_and_silent_keys_go(spark):
    rng = np.random.default_rng(1)
    rows = timed([{"id": i, "icao": f"A{rng.integers(4)}", "surface": bool(rng.integers(2)), "odd": int(rng.integers(2)), "s": i * 2.0} for i in range(300)])
    silent = timed([{"id": 1000 + i, "icao": "GONE", "surface": False, "odd": i % 2, "s": float(i)} for i in range(3)])
    clock = timed([{"id": 9999, "icao": "Z", "surface": False, "odd": 0, "s": 700.0}])
    path = files([rows, silent, clock], "s")
    with stateful.state_store(spark):
        got = streams.run_to_table(stateful.paired_parity(stream(spark, path), "40 seconds", idle_seconds=400)).toPandas()
        left = {r.icao for r in state(spark, last_checkpoint(spark), "last").select("key.*").collect()}
    batch = decode.pair_even_odd(spark.createDataFrame(pd.concat([rows, silent]))).toPandas()
    want = {r.id: (r.even_id, r.odd_id) for r in batch.itertuples() if r.s <= 660}
    have = {r.id: (r.even_id, r.odd_id) for r in got.itertuples()}
    same = lambda a, b: all((pd.isna(x) and pd.isna(y)) or x == y for x, y in zip(a, b, strict=True))
    assert want.keys() == have.keys() and all(same(want[i], have[i]) for i in want)
    assert "GONE" not in left and "A0" in left


def test_carried_forward_equals_the_batch_join(spark):
    rng = np.random.default_rng(2)
    frame = timed([{"key": f"k{rng.integers(3)}", "id": i, "side": int(rng.random() < 0.6), "value": float(rng.integers(5)), "s": float(rng.integers(0, 1500))} for i in range(400)])
    clock = timed([{"key": "clock", "id": 9999, "side": 1, "value": 0.0, "s": 9000.0}])
    path = files([frame, clock], "s")
    s = stream(spark, path)
    with stateful.state_store(spark):
        got = streams.run_to_table(stateful.carried_forward(s.where("side = 1").select("key", "id", "ts"), stream(spark, path).where("side = 0").select("key", "ts", "value"), 60.0, "5 minutes")).toPandas()
    df = spark.createDataFrame(frame)
    want = T.asof_backward(df.where("side = 1"), df.where("side = 0").select("key", "s", "value"), ["key"], "s", "value", 60.0).toPandas()
    have = got[got.id != 9999].set_index("id").sort_index()
    want = want.set_index("id").sort_index()
    assert list(have.index) == list(want.index)  # each row of the left side once
    assert np.allclose(have.value, want.asof_value, equal_nan=True) and np.allclose(have.age, want.age, equal_nan=True) and want.age.isna().any() and want.age.notna().any()


class Handle:
    """State of one key in memory, with the number of calls that Spark would answer over a socket."""

    def __init__(self):
        self.values, self.timers, self.calls = {}, [], 0

    def getValueState(self, name, schema):  # noqa: N802
        return Value(self, name)

    getListState = getValueState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.append(at)


class Value:
    def __init__(self, handle, name):
        self.handle, self.name = handle, name

    def _call(self):
        self.handle.calls += 1
        return self.handle.values

    def exists(self):
        return self.name in self._call()

    def get(self):
        return self._call().get(self.name)

    def update(self, value):
        self._call()[self.name] = value

    put = update

    def clear(self):
        self._call().pop(self.name, None)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


def test_a_key_of_the_carry_forward_join_calls_its_state_a_few_times(spark):
    big = 2**53 + 1
    rows = pd.DataFrame({"side": [1, 0, 1, 0], "id": [big, 0, 7, 0], "us": [9_000_000, 5_000_000, 4_000_000, 5_000_000], "value": [np.nan, 2.0, np.nan, 1.0]}).assign(ts=lambda d: pd.to_datetime(d.us, unit="us"))
    frame = spark.createDataFrame([(0, 0, 0, 0.0, None)], "us long, side int, id long, value double, ts timestamp")
    p, handle = stateful._Carried(stateful._schema(frame, ["us", "side", "id", "value"]), 60_000, 60_000), Handle()
    p.init(handle)
    assert not list(p.handleInputRows(("k",), iter([rows.iloc[:3], rows.iloc[3:]]), Clock(0))) and handle.calls <= 3  # 6 before
    assert handle.timers == [4000]
    first = pd.concat(p.handleExpiredTimer(("k",), Clock(5000), None))
    assert first.id.tolist() == [7] and first.value.isna().all() and handle.timers == [4000, 9000]
    handle.calls = 0
    second = pd.concat(p.handleExpiredTimer(("k",), Clock(10_000), None))
    assert second.id.tolist() == [big] and second.value.tolist() == [1.0] and second.age.tolist() == [4.0]
    assert handle.calls <= 4 and handle.timers[-1] == 69_000
    assert not list(p.handleExpiredTimer(("k",), Clock(69_000), None)) and not handle.values  # silent for its idle time
    late = pd.DataFrame({"side": [1], "id": [3], "us": [np.nan], "value": [np.nan]})
    assert pd.concat(p.handleInputRows(("k",), iter([late]), Clock(80_000))).id.tolist() == [3]  # a row without a time finds nothing


def test_replayed_batches_add_nothing_and_corrupt_lines_are_kept_apart(spark, tmp_path):
    lines = ['{"id": 1, "v": 2.5}', '{"id": 2, "v": "x"}', '{"id": 3, "v": 0.5', "", '{"id": 4, "v": 3.0, "more": 1}', '{"id": 5}']
    spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1).write.parquet(f"{tmp_path}/in")
    rows = streams.parsed(spark.readStream.schema("line string").parquet(f"{tmp_path}/in"), "id long, v double")
    good, bad = f"{tmp_path}/good", f"{tmp_path}/bad"
    for again in range(2):  # the second run has no checkpoint of the first: all its batches are given again
        streams.quarantined(rows, F.col("v") > 1, good, bad, f"{tmp_path}/checkpoint{again}")
    assert sorted(r.id for r in spark.read.parquet(good).collect()) == [1, 4]
    left = spark.read.parquet(bad).collect()
    assert len(left) == 4 and {r.corrupt for r in left if r.corrupt} == {lines[1], lines[2]}
    sink = streams.batch_sink(f"{tmp_path}/table")
    batch = spark.createDataFrame([(1,), (2,)], "id long")
    for number in (0, 0, 1):
        sink(batch, number)
    assert spark.read.parquet(f"{tmp_path}/table").count() == 4


def test_incremental_decode_drops_redelivered_ids(spark, tmp_path):
    f = timed([{"id": i % 50, "s": float(i % 50)} for i in range(100)])
    path = files([f], "s", 4)
    out = streams.decode_new(stream(spark, path), f"{tmp_path}/decoded", lambda b: b.select("id"), "1 hour")
    assert sorted(r.id for r in out.collect()) == list(range(50))


@pytest.mark.parametrize("rows", [1, 7, 33, 1000])
def test_scan_equals_the_sequential_smoother(spark, rows):
    tracks = noisy_tracks(40 if rows == 1 else 150, 5, 1 if rows == 1 else 2)
    samples = spark.createDataFrame(pd.concat([*tracks, tracks[0].head(1).assign(track_id="one"), tracks[0].head(2).assign(track_id="two")]))
    got = scan.smooth_ca_scan(samples, ("balanced",), rows, stage=staging.staged).toPandas()
    want = smoothing.smooth_ca(samples).toPandas()
    columns = ["x", "y", "z", "vx", "vy", "vz", "ax", "ay", "az", "nis", "noise_scale", "trace"]
    a, b = (d.sort_values(["track_id", "t"])[columns].to_numpy() for d in (got, want))
    assert a.shape == b.shape and want.noise_scale.max() > 5
    assert np.abs(a - b).max() < 1e-6 and (np.abs(a - b) / np.maximum(np.abs(b), 1)).max() < 1e-9


def test_elements_combine_associatively():
    rng = np.random.default_rng(4)
    p = smoothing.PRESETS["smooth"]
    e = [scan.row_element(dt, rng.normal(0, 50, 3), rng.normal(0, 9, 3), s, p) for dt, s in ((0.5, 1.0), (2.0, 7.0), (1.0, 1.0))]
    left, right = scan.combined(scan.combined(e[0], e[1]), e[2]), scan.combined(e[0], scan.combined(e[1], e[2]))
    assert all(np.allclose(a, b, rtol=1e-8, atol=1e-9) for a, b in zip(left, right, strict=True))


def test_tables_of_a_query_are_freed(spark):
    base = staging.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(base))
    out = staging.alone(lambda: staging.staged(staging.staged(spark.range(5), "a").where("id > 1"), "b").where("id > 2"), "q")
    assert out.count() == 2 and len(set(os.listdir(base)) - before) == 1
