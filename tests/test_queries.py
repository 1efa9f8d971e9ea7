import pytest
from duck import assert_same

from trackspark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, SF), registry.ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_writes_rows(spark, tmp_path, name):
    """Written whole, as a count alone would prune the columns."""
    registry.QUERIES[name](spark, SF).write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() > 0


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["s3_deduplicated", "s4_tumbling", "s6_sessions", "s8_sliding", "s11_stream_stream_join"])
def test_streams_of_many_unordered_files_equal_sql(spark, tmp_path, name):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(40).write.parquet(f"{tmp_path}/events.parquet")
    assert_same(registry.QUERIES[name](spark, str(tmp_path)), registry.ORACLE_SQL[name], SF)
