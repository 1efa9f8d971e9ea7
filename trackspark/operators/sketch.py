"""Weighted quantiles by mergeable summaries of fixed size, for tables whose exact windows would cost too much."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.operators import timeseries as T

#: Entries of a summary; a buffer of summaries holds up to BUFFERED times as many before it is cut down. Rows that a task holds over all keys.
ENTRIES, BUFFERED, HELD = 1000, 4, 1_000_000
#: Parts that a key's summaries are merged in before the last merge, so that a hot key meets in no single task.
PARTS = 32


def summary(values: np.ndarray, weights: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """At most 2 * entries + 1 weighted values in order for any number of them: a run of values of at most a part 1 / entries of the weight is
    one entry at its weighted median, and a value of more weight stays alone. A rank moves by at most half such a part."""
    order = np.argsort(values, kind="stable")
    v, w = values[order], weights[order]
    if len(v) <= entries:
        return v, w
    part = w.sum() / entries
    heavy = w > part
    # a run ends where a part is full, before and after each heavy value
    light = np.cumsum(np.where(heavy, 0.0, w)) - np.where(heavy, 0.0, w)
    run = np.floor(light / part).astype(np.int64)
    new = np.r_[True, (run[1:] != run[:-1]) | heavy[1:] | heavy[:-1]]
    first = np.flatnonzero(new)
    total = np.add.reduceat(w, first)
    cum = np.cumsum(w)
    middle = cum[first] - w[first] + total / 2
    at = np.minimum(np.searchsorted(cum, middle), np.r_[first[1:], len(v)] - 1)
    return v[at], total


class _Held:
    """Summaries by key with buffers of new values."""

    def __init__(self, entries: int):
        self.entries, self.parts, self.size = entries, {}, 0

    def add(self, key, values: np.ndarray, weights: np.ndarray) -> None:
        own = self.parts.setdefault(key, [[], [], 0])
        own[0].append(values)
        own[1].append(weights)
        own[2] += len(values)
        self.size += len(values)
        if own[2] > BUFFERED * self.entries:
            before = own[2]
            v, w = self.of(own)
            self.parts[key] = [[v], [w], len(v)]
            self.size += len(v) - before

    def of(self, own) -> tuple[np.ndarray, np.ndarray]:
        return summary(np.concatenate(own[0]), np.concatenate(own[1]), self.entries)

    def rows(self) -> Iterator[pa.RecordBatch]:
        made = [(k, *self.of(own)) for k, own in self.parts.items()]
        for a in range(0, len(made), 256):
            keys, values, weights = zip(*made[a : a + 256], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.list_(pa.float64())), pa.array(weights, pa.list_(pa.float64()))], ["key", "v", "w"])
        self.parts, self.size = {}, 0


def _first(batches: Iterable[pa.RecordBatch], entries: int) -> Iterator[pa.RecordBatch]:
    """Rows as they come -> a summary of each key for every HELD rows: the rows wait as columns, so that memory does not grow with the keys."""
    kept, n = [], 0
    for b in batches:
        kept.append(b)
        n += b.num_rows
        if n >= HELD:
            yield from _reduced(pa.Table.from_batches(kept), entries)
            kept, n = [], 0
    if n:
        yield from _reduced(pa.Table.from_batches(kept), entries)


def _reduced(rows: pa.Table, entries: int) -> Iterator[pa.RecordBatch]:
    keys = rows["key"].combine_chunks().dictionary_encode()
    codes, values, weights = keys.indices.to_numpy(), rows["v"].to_numpy(), rows["w"].to_numpy()
    order = np.argsort(codes, kind="stable")
    cuts = np.r_[np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0]), len(order)]
    for a in range(0, len(cuts) - 1, 256):
        own = [order[x:y] for x, y in zip(cuts[a : a + 256], cuts[a + 1 : a + 257], strict=False)]
        made = [summary(values[o], weights[o], entries) for o in own]
        names = keys.dictionary.take(pa.array([codes[o[0]] for o in own]))
        yield pa.RecordBatch.from_arrays([names, *(pa.array([m[k] for m in made], pa.list_(pa.float64())) for k in (0, 1))], ["key", "v", "w"])


def _merged(batches: Iterable[pa.RecordBatch], entries: int) -> Iterator[pa.RecordBatch]:
    """Summaries in order of key -> one for each key: one key is held at a time."""
    held, now = _Held(entries), None
    for b in batches:
        for key, v, w in zip(b.column("key").to_pylist(), b.column("v"), b.column("w"), strict=True):
            if key != now and held.parts:
                yield from held.rows()
            now = key
            held.add(key, v.values.to_numpy(), w.values.to_numpy())
    yield from held.rows()


_SCHEMA = "key string, v array<double>, w array<double>"


def summaries(df: DataFrame, keys: list[str], value: str, weight: str | None = None, entries: int = ENTRIES) -> DataFrame:
    """keys, v, w: one summary for each key of the rows with a value and a positive weight.

    A task reduces its rows before the shuffle; summaries of a key are merged in PARTS parts and then once more. No buffer grows with
    a key's rows: the rank of any value moves by about (number of merges) / (2 * entries) of the weight at most.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("key"), F.col(value).cast("double").alias("v"), w.alias("w")).where("v is not null and not isnan(v) and w > 0")
    made = rows.mapInArrow(lambda b: _first(b, entries), _SCHEMA).withColumn("part", F.pmod(F.xxhash64("v", "w"), F.lit(PARTS)))
    near = made.repartition("key", "part").sortWithinPartitions("key", "part").select("key", "v", "w").mapInArrow(lambda b: _merged(b, entries), _SCHEMA)
    whole = near.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: _merged(b, entries), _SCHEMA)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    return whole.select(F.from_json("key", fields).alias("k"), "v", "w").select("k.*", "v", "w")


def weighted_quantile(df: DataFrame, keys: list[str], value: str, weight: str, q: float, approximate: bool = False, entries: int = ENTRIES) -> DataFrame:
    """A9, and A23 where approximate is asked for: keys and wq_<value>, the least value whose cumulative share of the positive weights reaches q."""
    if not approximate:
        return T.weighted_quantile(df, keys, value, weight, q)
    s = summaries(df, keys, value, weight, entries)
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    walked = F.aggregate(
        F.arrays_zip("v", "w"), F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("double").alias("x")),
        lambda a, p: F.struct((a["c"] + p["w"]).alias("c"), F.when(a["x"].isNull() & (a["c"] + p["w"] >= q * F.col("_t")), p["v"]).otherwise(a["x"]).alias("x")),
    )
    return s.withColumn("_t", total).select(*keys, walked["x"].alias(f"wq_{value}"))
