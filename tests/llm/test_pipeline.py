"""The pipeline's stages: each works on what its predecessor kept, and its decisions take effect."""

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{SF}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, SF)
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        kept[name] = docs
        if name != "best-fit packing":
            assert docs.columns == columns and docs.count() <= before.count()
            assert docs.select("doc_id").distinct().count() == docs.count()
    clean = labels.where("quality = 1").join(kept["quality classifier"], "doc_id", "left_semi").count()
    assert clean >= 0.95 * labels.where("quality = 1").count()
    near, cut = kept["n-gram Jaccard join"], kept["suffix-array dedup"]
    assert cut.count() == near.count()
    assert near.agg(F.sum(F.length("text"))).first()[0] >= cut.agg(F.sum(F.length("text"))).first()[0]
    assert cut.where("n_chars <> length(text)").count() == 0
    assert near.groupBy("text").count().where("count > 1").count() == 0
    packed = kept["best-fit packing"]
    assert packed.select("doc_id").distinct().count() == kept["benchmark decontamination"].count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_one_row_of_each_group_stays_with_null_and_reused_ids(spark):
    word = lambda a, n=40: " ".join(f"{a}{i}" for i in range(n))
    near = lambda a: word(a) + " more"
    rows = [
        (None, word("a")), (None, word("b")), (None, near("b")), (None, word("b")),  # unlike rows without id, and near copies
        (7, word("c")), (7, word("d")), (7, word("d")),  # one id: unlike texts, and a repeated row
        (3, word("e")), (8, near("e")), (8, word("f")), (None, word("e")),  # 8 loses only its near copy
        (5, word("g")), (5, near("g")),  # near copies of one id
        (None, None), (None, ""), (9, None), (9, None), (10, ""),
    ]
    kept = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id int, text string"), SF).collect()]
    text = lambda r: r[1] and r[1].removesuffix(" more")
    want = [(None, word("a")), (None, word("b")), (7, word("c")), (7, word("d")), (3, word("e")), (8, word("f")), (5, word("g")), (None, None), (None, ""), (9, None), (10, "")]
    assert sorted(str((r[0], text(r))) for r in kept) == sorted(map(str, want))
