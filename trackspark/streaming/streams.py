"""Structured Streaming versions. Each runs over a folder of files with availableNow and has the batch query's result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackspark.staging import new_path


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as an unbounded stream of files; event time in UTC.

    The files that are there are one micro-batch: they are read in order of their age, not of event time, so a watermark
    taken from some of them would drop rows of the others as late.
    """
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events[.]parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Drain the stream into a table in the shared folder, with its checkpoint beside it, and read the table."""
    spark = stream.sparkSession
    path = new_path(spark, "stream")
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/table")
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


def tumbling_counts(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and means by window and kind; a window is written once the watermark has passed it."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select("w.start", "event_type", "n", "mean")


def sliding_counts(stream: DataFrame, width: str = "6 hours", slide: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by kind over sliding windows."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")


def sessions(stream: DataFrame, gap: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of a user end with a gap."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("w.start", "w.end", "user_id", "n")


def deduplicated(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """S3: redelivered rows of an id are dropped while the watermark remembers it."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def batch_sink(path: str):
    """A foreachBatch function whose batches are partitions `batch=<number>` of the table at path, overwritten when a batch comes again: a
    retried or replayed batch adds nothing, and nothing that was written before is read."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def parsed(lines: DataFrame, schema: str, column: str = "line") -> DataFrame:
    """Text lines of JSON -> the fields of schema and `corrupt`, the line itself where it does not parse (fields that do are kept), else NULL."""
    fields = T._parse_datatype_string(schema)
    whole = T.StructType([*fields.fields, T.StructField("corrupt", T.StringType())])
    got = F.from_json(F.col(column), whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}).alias("_p")
    return lines.select(got).select("_p.*")


def quarantined(rows: DataFrame, valid, good: str, bad: str, checkpoint: str) -> None:
    """Drains a stream of parsed rows into two tables by batch: rows that parsed and for which `valid` (a column) is true, and the others
    with their corrupt line. A batch that is given again replaces itself in both."""
    ok = F.col("corrupt").isNull() & F.coalesce(valid, F.lit(False))
    sinks = batch_sink(good), batch_sink(bad)

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        sinks[0](batch.where(ok).drop("corrupt"), number)
        sinks[1](batch.where(~ok), number)
        batch.unpersist()

    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def decode_new(stream: DataFrame, path: str, decode, late: str = "1 hour") -> DataFrame:
    """decode(rows) of each micro-batch of a stream(id, ts, ...) as a partition of the table at path; the table itself is never read.

    Redelivered ids are dropped by the stream's own state while the watermark remembers them; a batch that is written again replaces itself.
    """
    spark = stream.sparkSession
    schema = decode(spark.createDataFrame([], stream.schema)).schema
    sink = batch_sink(path)
    once = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])
    once.writeStream.foreachBatch(lambda batch, number: sink(decode(batch), number)).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(path)
