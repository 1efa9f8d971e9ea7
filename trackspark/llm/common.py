"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: anything between ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Rows that a Python task takes from an Arrow batch at once, and about the most characters of them.
SLICE_ROWS, SLICE_CHARS = 512, 4_000_000
#: Staged tables of so few rows, or items in lists, and bytes go to all tasks.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64_000_000


#: Bytes of an Arrow batch, about.
BATCH = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset: a new one in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


_meanwhile: list[list[DataFrame]] = []


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH bytes from here on: JVM and Python workers hold several at once beside the executor's heap."""
    try:
        if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_CONF)) > BATCH:
            spark.conf.set(_BATCH_CONF, BATCH)
    except PySparkException:  # a Spark without this setting
        pass


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: the lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    for tables in _meanwhile:
        tables.append(out)
    return out


def staged_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """staged() of what make() gives; the tables that were staged for it are deleted."""
    _meanwhile.append([])
    try:
        out = staged(make(), name)
    finally:
        tables = _meanwhile.pop()
    for t in tables:
        if t is not out:
            unstage(t)
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    spark, path = df.sparkSession, getattr(df, "_staged_path", None)
    if path:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def width(kind: T.DataType) -> int:
    """Bytes of a value, about: 8 of a number, 24 of a text or digest; of a list those of an item."""
    if isinstance(kind, T.StructType):
        return sum(width(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return width(kind.elementType)
    return 24 if isinstance(kind, T.StringType | T.BinaryType) else 8


def small(table: DataFrame, items: str | None = None) -> DataFrame:
    """A staged table, marked for broadcast where it has at most BROADCAST_ROWS rows, or items in its lists, and BROADCAST_BYTES;
    else Spark joins it by a shuffle. Texts and digests count as 24 bytes: tables with long ones are not for this."""
    n, in_lists = table.agg(F.count("*"), F.coalesce(F.sum(F.size(items)), F.lit(0)) if items else F.lit(0)).first()
    listed = width(table.schema[items].dataType) if items else 0
    size = n * (width(table.schema) - listed) + in_lists * listed
    return F.broadcast(table) if max(n, in_lists) <= BROADCAST_ROWS and size <= BROADCAST_BYTES else table


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into parts of bounded rows and, but for a single longer text, bounded characters."""
    for batch in batches:
        at = 0
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0))
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, ends[at] + SLICE_CHARS, "right")) - 1
            to = min(max(to, at + 1), at + SLICE_ROWS, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch; null is empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def word_bytes(batch: pa.RecordBatch, column: str = "text") -> Iterator[list[bytes]]:
    """Words of each text, A-Z in lower case, in UTF-8; bytes.split() parts at the same white space as WORD. Null: none."""
    for x in batch.column(column).cast(pa.binary()):
        yield x.as_buffer().to_pybytes().lower().split() if x.is_valid else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(31))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, in order; of the whole sequence where it is shorter; none without words."""
    if len(words) == 0:
        return words
    n = max(len(words) - k + 1, 1)
    out = np.full(n, min(k, len(words)), np.uint64)
    for j in range(min(k, len(words))):
        out = mixed(out ^ words[j : j + n]) + np.uint64(j + 1)
    return out


def crc32_fold(column: str, of: int, rest: int):
    """Rows whose crc32(column as text) mod `of` is `rest`."""
    return F.crc32(F.col(column).cast("string")) % of == rest
