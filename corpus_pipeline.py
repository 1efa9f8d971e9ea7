"""Corpus pipeline: quality, near duplicates, repeated passages, benchmark items, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.llm import best_fit, byte_cnn, common, containment, jaccard_join, suffix_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network scores at its threshold or above. It is fitted on labelled rows of the table itself."""
    net = byte_cnn.train_quality(docs, common.read(spark, sf_dir, "labels"))
    return byte_cnn.with_quality(docs, net, "quality_score_").where(F.col("quality_score_") >= byte_cnn.THRESHOLD).drop("quality_score_")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, sets of 5-word shingles that link at 0.8 or more: that of least doc_id.

    Rows without doc_id come last. A row is known by doc_id and a digest of its text: rows of one id with unlike texts, or
    without id, are documents like others. Texts without words link with nothing; only repeated rows of one doc_id go.
    """
    found = common.staged_alone(lambda: jaccard_join.row_groups(docs, k=5, percent=80).select("doc_id", "tag", "first"), "groups")
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tag") == F.col("first.tag"))
    gone = common.staged(found.where(F.col("first").isNotNull() & ~own).select("doc_id", "tag").distinct(), "gone")
    again = found.where(F.col("first").isNull() & F.col("doc_id").isNotNull() | own).groupBy("doc_id", "tag").agg(F.count("*").alias("n"))
    again = common.staged(again.where("n > 1").select("doc_id", "tag"), "again")
    common.unstage(found)
    keyed = docs.withColumns({"id_": F.col("doc_id").cast("long"), "tag_": F.xxhash64("text")})

    def beside(rows: DataFrame, table: DataFrame, how: str) -> DataFrame:
        other = common.small(table).toDF("other_id_", "other_tag_")
        return rows.join(other, F.col("id_").eqNullSafe(F.col("other_id_")) & (F.col("tag_") == F.col("other_tag_")), how)

    kept = beside(keyed, gone, "left_anti")
    if not again.isEmpty():  # of rows that repeat whole, one stays
        kept = beside(kept, again, "left_anti").unionByName(beside(kept, again, "left_semi").dropDuplicates(["id_", "tag_"]))
    return kept.drop("id_", "tag_")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that strings of 200 bytes cover which stand more than once."""
    return suffix_dedup.without_repeats(docs)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return containment.decontaminated(docs, common.read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids and their places in sequences of at most 2048."""
    return best_fit.pack_documents(docs, best_fit.tokenizer_path())


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_items),
    ("best-fit packing", packing),
]

#: A network, and which tokens share a sequence, are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        docs = common.staged_alone(lambda stage=stage, before=before: stage(spark, before, sf_dir), name.replace(" ", "-"))
        common.unstage(before)
    return STAGES[-1][1](spark, docs, sf_dir)
