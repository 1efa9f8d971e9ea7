"""Stateful streams by key: rows wait until the watermark has passed them, then come in order of event time; silent keys are evicted.

Every processor keeps the rows of a key that the watermark has not passed, so at most those of the allowed lateness, and what it
remembers of the key, which has a fixed size (or, for the carry-forward join, is bounded by the age limit).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trackspark.operators import smoothing

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that typed state and timers need, for streams that start inside; the session's own setting comes back."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class InOrder(StatefulProcessor):
    """Gives a key's rows to take() in order of (us, `order`), nulls last, once the watermark has passed them; forgets a key `idle_ms` after its last row.

    columns: those of the input that are kept, numbers only; the first is `us`, the microseconds of event time. Subclasses set up their
    state in remember(), and may hold rows back. take() gets rows as tuples: a key has few at once, and frames of so few rows, like calls
    of the state, cost more than what is done with them. So rows that wait are one value of the state, and a key has one timer.
    """

    def __init__(self, columns: T.StructType, order: list[str], idle_ms: int):
        self.columns, self.idle_ms = columns, idle_ms
        self.order = [columns.names.index(c) for c in ("us", *order)]
        self.whole = [not isinstance(f.dataType, T.DoubleType) for f in columns]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", T.StructType([T.StructField("last_ms", T.LongType()), *(T.StructField(f.name, T.ArrayType(f.dataType)) for f in self.columns)]))
        self.remember(handle)

    def remember(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def take(self, key: tuple, rows: list[tuple], watermark_ms: int) -> pd.DataFrame | None:
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def _place(self, row: tuple) -> list[tuple]:
        return [(row[i] is None, row[i] or 0) for i in self.order]

    def _drain(self, key: tuple, new: list[pd.DataFrame], watermark_ms: int) -> Iterator[pd.DataFrame]:
        kept = self.waiting.get()
        last, rows = (kept[0], list(zip(*kept[1:], strict=True))) if kept else (-1, [])
        for frame in new:
            rows += zip(*(_plain(frame[c], whole) for c, whole in zip(self.columns.names, self.whole, strict=True)), strict=True)
        if not kept and not rows:  # the timer of a key that has gone
            return
        at = [-1 if r[0] is None else r[0] // 1000 for r in rows]  # rows without a time do not wait
        last = max([last, *at])
        rest = [r for r, ms in zip(rows, at, strict=True) if ms > watermark_ms]
        if len(rest) < len(rows):
            out = self.take(key, sorted((r for r, ms in zip(rows, at, strict=True) if ms <= watermark_ms), key=self._place), watermark_ms)
            if out is not None and len(out):
                yield out
        if not rest and last + self.idle_ms <= watermark_ms:
            out = self.close_key(key)
            if out is not None and len(out):
                yield out
            self.forget()
            if kept:
                self.waiting.clear()
            return
        self.handle.registerTimer(min(r[0] for r in rest) // 1000 if rest else last + self.idle_ms)
        self.waiting.update((last, *(map(list, zip(*rest, strict=True)) if rest else [[] for _ in self.columns])))

    def close_key(self, key: tuple) -> pd.DataFrame | None:
        """What a key still gives when it has been silent for so long."""
        return None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self._drain(key, list(rows), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._drain(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def _plain(values: pd.Series, whole: bool) -> list:
    """Python numbers; pandas has nulls as NaN, and whole numbers beside them as floats."""
    got = values.tolist()
    if whole and values.dtype.kind != "f":
        return got
    return [None if v is None or v != v else int(v) if whole else v for v in got]


def _schema(df: DataFrame, columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in df.select(*columns).schema])


class _Pairs(InOrder):
    def remember(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "even_id long, odd_id long")

    def take(self, key: tuple, rows: list[tuple], watermark_ms: int) -> pd.DataFrame:
        last = list(self.last.get() or (None, None))
        out = []
        for _, i, odd in rows:
            last[odd] = i
            out.append((i, last[0], last[1]))
        self.last.update(tuple(last))
        return pd.DataFrame(out, columns=["id", "even_id", "odd_id"]).astype({"even_id": "Int64", "odd_id": "Int64"})

    def forget(self) -> None:
        self.last.clear()


def paired_parity(frames: DataFrame, late: str = "10 minutes", idle_seconds: float = 7 * 86400) -> DataFrame:
    """D3 on a stream of decoded frames(id, icao, surface, odd, ts): the last even and odd id of each (address, surface), itself included,
    in order of (ts, id). State: two ids a key, which go when it has been silent for idle_seconds of event time."""
    f = frames.where("odd is not null").select("icao", F.coalesce("surface", F.lit(False)).alias("surface"), F.col("id").cast("long").alias("id"), F.col("odd").cast("int").alias("odd"), F.col("ts").cast("timestamp").alias("ts")).withColumn("us", F.unix_micros("ts")).withWatermark("ts", late)
    p = _Pairs(_schema(f, ["us", "id", "odd"]), ["id"], int(idle_seconds * 1000))
    return f.groupBy("icao", "surface").transformWithStateInPandas(p, "id long, even_id long, odd_id long", "Append", "EventTime")


class _Filter(InOrder):
    def __init__(self, columns: T.StructType, idle_ms: int, preset: str):
        super().__init__(columns, ["t"], idle_ms)
        self.preset = smoothing.PRESETS[preset]

    def remember(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("filter", "t double, mean array<double>, covariance array<double>")
        self.head = handle.getListState("head", "t double, x double, y double, z double, vx double, vy double, vz double")

    def take(self, key: tuple, rows: list[tuple], watermark_ms: int) -> pd.DataFrame | None:
        new = np.array(rows, float)[:, 1:]
        if not (kept := self.state.get()):  # the first acceleration is that of the first seven rows
            new = np.vstack([np.array([tuple(r) for r in self.head.get()], float).reshape(-1, 7), new])
            if len(new) < smoothing.HEAD:
                self.head.put([tuple(map(float, r)) for r in new])
                return None
            self.head.clear()
        return self._filtered(key, new, kept)

    def _filtered(self, key: tuple, new: np.ndarray, kept: tuple | None) -> pd.DataFrame:
        if kept:
            t, mean, covariance = kept
            start = (t, np.array(mean).reshape(3, 3), np.array(covariance).reshape(3, 3, 3))
        else:
            start = None
        out = smoothing.forward(new[:, 0], new[:, 1:4], new[:, 4:], self.preset, start)
        self.state.update((float(new[-1, 0]), out.x[-1].ravel().tolist(), out.c[-1].ravel().tolist()))
        return pd.DataFrame({"track_id": key[0], "t": new[:, 0]} | {c: out.x[:, j % 3, j // 3] for j, c in enumerate(_STATE)})

    def close_key(self, key: tuple) -> pd.DataFrame | None:
        if not self.head.exists():
            return None
        new = np.array([tuple(r) for r in self.head.get()], float).reshape(-1, 7)
        self.head.clear()
        return self._filtered(key, new, self.state.get())

    def forget(self) -> None:
        self.state.clear()
        self.head.clear()


_ROW = ["x", "y", "z", "vx", "vy", "vz"]
_STATE = [f"{a}{c}" for a in ("", "v", "a") for c in "xyz"]


def filtered_online(samples: DataFrame, preset: str = "balanced", late: str = "10 seconds", idle_seconds: float = 3600.0) -> DataFrame:
    """The forward half of the constant-acceleration filter (K2) on a stream of samples(track_id, t, x..vz), in order of t.

    State of a track: the last time, 9 numbers of the mean and 27 of the three axes' covariances, whatever its length; before that up
    to six first rows. A track of fewer than seven rows is given when it has been silent for idle_seconds, as is the end of its state.
    """
    s = samples.select("track_id", *(F.col(c).cast("double").alias(c) for c in ("t", *_ROW))).withColumn("us", (F.col("t") * 1e6).cast("long")).withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", late)
    p = _Filter(_schema(s, ["us", "t", *_ROW]), int(idle_seconds * 1000), preset)
    return s.groupBy("track_id").transformWithStateInPandas(p, "track_id string, t double, " + ", ".join(f"{c} double" for c in _STATE), "Append", "EventTime")


class _Carried(InOrder):
    def __init__(self, columns: T.StructType, idle_ms: int, age_ms: int):
        super().__init__(columns, ["side", "value"], idle_ms)
        self.age_us = age_ms * 1000

    def remember(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "us long, value double")

    def take(self, key: tuple, rows: list[tuple], watermark_ms: int) -> pd.DataFrame | None:
        last = before = self.last.get()
        ids, values, ages = [], [], []
        for us, side, i, value in rows:
            if side == 0:
                if us is not None and (last is None or last[0] < us):  # of equal times the first value counts
                    last = (us, value)
            else:
                near = last is not None and us is not None and us - last[0] <= self.age_us
                ids.append(i)
                values.append(last[1] if near else None)
                ages.append((us - last[0]) / 1e6 if near else None)
        if last is not before:
            self.last.update(last)
        return pd.DataFrame({"id": np.array(ids, np.int64), "value": np.array(values, float), "age": np.array(ages, float)}) if ids else None

    def forget(self) -> None:
        self.last.clear()


def carried_forward(left: DataFrame, right: DataFrame, age_seconds: float, late: str = "2 hours") -> DataFrame:
    """Each row of left(key, id, ts) once, with the latest value of right(key, ts, value) at or before its time and at most age_seconds
    old, and its age in seconds; NULLs where there is none. Of equal times of right the least value counts, as in J2.

    Both sides are one stream of rows in order of time, so a key remembers one value; it goes when the key has been silent for the age.
    """
    both = left.select("key", F.lit(1).alias("side"), F.col("id").cast("long").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.lit(None).cast("double").alias("value")).unionByName(
        right.select("key", F.lit(0).alias("side"), F.lit(0).cast("long").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
    ).withColumn("us", F.unix_micros("ts")).withWatermark("ts", late)
    p = _Carried(_schema(both, ["us", "side", "id", "value"]), int(age_seconds * 1000), int(age_seconds * 1000))
    return both.groupBy("key").transformWithStateInPandas(p, "id long, value double, age double", "Append", "EventTime")
