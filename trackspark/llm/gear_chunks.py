"""Substring dedup by content-defined chunks.

A gear rolling hash over the bytes cuts each text where the hash of the last 32 bytes has its highest bits 0, so an insertion
moves only the cuts beside it. Chunks are deduplicated by digest: the first stays, the others are removed.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of a chunk at least and at most; a cut comes after 2 ** BITS more bytes on average.
LEAST, MOST, BITS = 48, 1024, 6
_PART = 1 << 22


def gear_table() -> np.ndarray:
    return (common.mixed(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(raw: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """hash[i] = sum of gear[raw[i - k]] << k over the last 32 bytes, modulo 2 ** 32, by doubling the span five times."""
    h = gear[raw]
    for span in (1, 2, 4, 8, 16):
        longer = h.copy()
        longer[span:] += h[:-span] << np.uint32(span)
        h = longer
    return h


def chunk_ends(text: bytes, gear: np.ndarray, least: int = LEAST, most: int = MOST, bits: int = BITS) -> list[int]:
    """Ends of the chunks of a text; an empty text has none."""
    n = len(text)
    raw = np.frombuffer(text, np.uint8)
    cuts: list[int] = []
    for a in range(0, n, _PART):  # long texts part by part, each with the 32 bytes before it
        low = max(0, a - 32)
        h = gear_hashes(raw[low : a + _PART], gear)[a - low :]
        cuts += (np.flatnonzero(h >> np.uint32(32 - bits) == 0) + (a + 1)).tolist()
    ends, at, i = [], 0, 0
    while n - at > least:
        i = bisect_left(cuts, at + least, i)
        end = min(cuts[i] if i < len(cuts) else n, at + most, n)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def _chunks(batches: Iterable[pa.RecordBatch], sizes: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    gear = gear_table()
    for part in common.slices(batches):
        row, nth, start, length, digest = [], [], [], [], []
        for d, x in enumerate(part.column("text").cast(pa.binary())):
            text = x.as_buffer().to_pybytes() if x.is_valid else b""
            at = 0
            for k, end in enumerate(chunk_ends(text, gear, *sizes)):
                row.append(d)
                nth.append(k)
                start.append(at)
                length.append(end - at)
                digest.append(hashlib.blake2b(text[at:end], digest_size=16).digest())
                at = end
        at = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id").take(at), part.column("tag").take(at), pa.array(nth, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(digest, pa.binary())],
            ["doc_id", "tag", "nth", "start", "length", "digest"],
        )


def cut_spans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans) -> doc_id, n_bytes, n_removed, n_spans, kept: what is left of each text in bytes."""
    for part in common.slices(batches):
        rows = []
        for x, spans in zip(part.column("text").cast(pa.binary()), part.column("spans").to_pylist(), strict=True):
            text = x.as_buffer().to_pybytes() if x.is_valid else b""
            kept, at, runs = [], 0, 0
            for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
                if a > at or runs == 0:
                    kept.append(text[at:a])
                    runs += 1
                at = max(at, b)
            left = b"".join([*kept, text[at:]])
            rows.append((len(text), len(text) - len(left), runs, left))
        n, removed, runs, left = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, removed, runs)), pa.array(left, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
        )


def tagged(docs: DataFrame) -> DataFrame:
    """doc_id, tag, text: the tag tells apart rows of one doc_id with different texts, alike in every run and plan."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), "text")


def beside(rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the row, (doc_id, tag); a null doc_id meets a null one."""
    other = table.withColumnsRenamed({"doc_id": "id_", "tag": "tag_"})
    return rows.join(other, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("tag") == F.col("tag_")), how).drop("id_", "tag_")


def chunk_dedup(docs: DataFrame, least: int = LEAST, most: int = MOST, bits: int = BITS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_chunks, n_shared, n_removed, n_spans, kept (bytes).

    Each chunk stays where it stands first, in order of (doc_id, start), and goes elsewhere, also in the same document;
    rows without doc_id come first, in order of a digest of their text; a text of any length is read part by part;
    n_shared: bytes of chunks that stand more than once, the first included. Null text is empty. A row that repeats doc_id
    and text whole is the same document and is treated alike. Only doc_id and text are read.

    Scale: a chunk travels as its digest and place. First and last places of a digest combine before the shuffle, and differ where
    it stands more than once, so no row is compared with another; the join back meets one row for each repeated digest, so a
    chunk that a third of the documents share only makes a partition that Spark splits. Texts meet their spans in a join on
    the document.
    """
    rows = tagged(docs)
    chunks = common.staged(rows.mapInArrow(lambda b: _chunks(b, (least, most, bits)), "doc_id long, tag long, nth int, start long, length int, digest binary"), "chunks")
    place = F.struct("doc_id", "tag", "start")
    often = chunks.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).select("digest", "first")
    shared = chunks.join(often, "digest").select("doc_id", "tag", "start", "length", (~place.eqNullSafe(F.col("first"))).alias("goes"))
    listed = shared.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end"), "goes")).alias("found"))
    spans = listed.select(
        "doc_id", "tag", F.aggregate("found", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("n_shared"),
        F.transform(F.filter("found", lambda x: x["goes"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("spans"),
    )
    counted = chunks.groupBy("doc_id", "tag").agg((F.max("nth") + 1).alias("n_chunks"))
    extra = beside(counted, spans, "left")
    joined = beside(rows, extra, "left").select("doc_id", "text", "spans", F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"), F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            for out in cut_spans([part]):
                yield out.append_column("n_chunks", part.column("n_chunks")).append_column("n_shared", part.column("n_shared"))

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, n_chunks long, n_shared long")


def op4_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup(common.read(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_chunks", "n_shared", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
