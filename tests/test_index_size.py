"""Files of a copy follow the memory of its rows, not only the table's compressed bytes."""

from rowloom.sources.table import Table


def test_a_well_compressed_table_is_sorted_in_bounded_tasks(spark, tmp_path):
    spark.range(2_000_000, numPartitions=2).selectExpr("id % 10 as k", "'x' as flag").write.parquet(str(tmp_path / "t"))
    t = Table(spark, str(tmp_path / "t"), "parquet", state_dir=str(tmp_path / "state"))
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    t.create_index(["k"])
    sizes = [r["count"] for r in spark.read.parquet(t.index_path("k")).groupBy("_metadata.file_path").count().collect()]
    assert max(sizes) < 1_000_000 and sum(sizes) == 2_000_000
    assert t.find().where({"k": 3}).explain()["index"] == "k" and t.find().where({"k": 3}).count() == 200_000
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == split


def test_a_composite_key_of_few_values_too(spark, tmp_path):
    spark.range(2_000_000, numPartitions=2).selectExpr("id % 2 as k", "'x' as flag").write.parquet(str(tmp_path / "t"))
    t = Table(spark, str(tmp_path / "t"), "parquet", state_dir=str(tmp_path / "state"))
    t.create_index([["k", "flag"]])
    sizes = [r["count"] for r in spark.read.parquet(t.index_path(["k", "flag"])).groupBy("_metadata.file_path").count().collect()]
    assert max(sizes) < 1_000_000 and sum(sizes) == 2_000_000 and t.find().where({"k": 1, "flag": "x"}).count() == 1_000_000
