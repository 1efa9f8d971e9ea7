"""Table functions for SQL: spool records of a binary value, and a track on a regular grid."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf

_RECORD = struct.Struct(">I6sBBB")


def spool_records(content: bytes) -> Iterator[tuple[int, int, int, int, bytes | None, bool]]:
    """IO14: records (time 4 bytes, mlat 6, signal, type, length, payload), big-endian: time, mlat, signal, type, payload, torn. A last record
    that is cut short is one row with torn true and what there is of its payload; fewer bytes than a head are a torn row of nulls."""
    at = 0
    while at + _RECORD.size <= len(content):
        ts, mlat, signal, kind, size = _RECORD.unpack_from(content, at)
        at += _RECORD.size
        payload = content[at : at + size]
        yield ts, int.from_bytes(mlat, "big"), signal, kind, payload, len(payload) < size
        at += size
    if at < len(content):
        yield None, None, None, None, None, True


class SpoolRecords:
    def eval(self, content: bytes):
        if content is not None:
            yield from spool_records(bytes(content))


@dataclass
class _Shape(AnalyzeResult):
    keys: tuple[str, ...] = ()
    numbers: tuple[str, ...] = ()


class Resampled:
    """resampled(TABLE(t), step): of each key of t its double columns on the grid first + k * step, and at the last time, by a line between
    neighbouring rows (W25, J4). The first double column is the time, columns of other types are the key; the function itself asks for
    the rows by key in order of time. Of equal times the first row counts, rows without a time are left out, and a NULL on either side
    gives NULL. Rows stream through: two are held.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, step: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("the first argument of resampled() is a table")
        if step.value is None or not float(step.value) > 0:
            raise ValueError("the step must be a positive constant")
        numbers = [f for f in table.dataType.fields if isinstance(f.dataType, T.DoubleType)]
        keys = [f for f in table.dataType.fields if not isinstance(f.dataType, T.DoubleType)]
        if not numbers or not keys:
            raise ValueError("the table needs a key and a time of type double")
        schema = T.StructType([*keys, *(T.StructField(f.name, T.DoubleType()) for f in numbers)])
        return _Shape(schema, partitionBy=[PartitioningColumn(f.name) for f in keys], orderBy=[OrderingColumn(numbers[0].name)], keys=tuple(f.name for f in keys), numbers=tuple(f.name for f in numbers))

    def __init__(self, shape: _Shape):
        self.shape, self.first, self.last, self.nth = shape, None, None, 0

    def eval(self, row: Row, step: float):
        values, step = [row[n] for n in self.shape.numbers], float(step)
        if values[0] is None or self.last is not None and values[0] <= self.last[0]:
            return
        if self.last is None:
            self.key, self.first, self.last = tuple(row[n] for n in self.shape.keys), values[0], values
        while (at := self.first + self.nth * step) <= values[0] + 1e-9:
            share = 0.0 if values[0] == self.last[0] else min((at - self.last[0]) / (values[0] - self.last[0]), 1.0)
            yield (*self.key, at, *(None if a is None or b is None else a + (b - a) * share for a, b in zip(self.last[1:], values[1:], strict=True)))
            self.nth += 1
            self.at = at
        self.last = values

    def terminate(self):
        if self.last is not None and self.last[0] > self.at + 1e-9:
            yield (*self.key, *self.last)


def register_tables(spark: SparkSession) -> None:
    """Registers spool_records(content), to be used with LATERAL, and resampled(TABLE(t), step) for SQL."""
    spark.udtf.register("spool_records", udtf(SpoolRecords, returnType="ts_utc long, mlat48 long, signal int, beast_type int, payload binary, torn boolean"))
    spark.udtf.register("resampled", udtf(Resampled))
