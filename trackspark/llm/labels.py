"""Bounded labelled samples for the classifiers."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def held_out(fold: tuple[int, int]):
    """Rows whose crc32(doc_id as text) mod fold[0] is fold[1]; never for a null doc_id."""
    return F.coalesce(common.crc32_fold("doc_id", *fold), F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: tuple[int, int], most: int) -> tuple[list[str], np.ndarray]:
    """Texts and 0/1 labels of at most `most` labelled rows outside the held-out fold, those of least hash of the doc_id.

    The bound holds for the ids before the texts are joined, and of rows with one doc_id only the one with the least digest of
    its text is an example, so neither the broadcast nor what the driver gets grows with the input. Null labels are left
    out; of unlike labels of one doc_id the larger holds; null texts are empty; the order does not depend on Spark's.
    """
    ids = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(f"doc_id is not null and y is not null").where(~held_out(fold))
        .groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    known = {r.doc_id: r.y for r in ids.collect()}
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(i,) for i in known], "doc_id long")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(wanted), "doc_id")
    rows = own.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).collect()
    rows.sort(key=lambda r: xxhash.xxh3_64_intdigest(str(r.doc_id)))
    return [r.text for r in rows], np.array([known[r.doc_id] for r in rows], np.int64)
