"""Tables that end lineage: written to the folder that driver and executors share, read again, and deleted when nothing reads them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_meanwhile: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a new folder in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a table or a checkpoint; what is written there goes with the tables of alone()."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for made in _meanwhile:
        made.append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a written table, read again; used where a table is read many times."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make() gives; if it staged tables, its result is staged too and those tables are deleted."""
    _meanwhile.append([])
    try:
        out = make()
        if not _meanwhile[-1]:
            return out
        out = staged(out, name)
        kept = _meanwhile[-1].pop()
    finally:
        made = _meanwhile.pop()
    for path in made:
        delete(out.sparkSession, path)
    for outer in _meanwhile:  # what is deleted is no longer theirs
        outer[:] = [p for p in outer if p not in made or p == kept]
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
