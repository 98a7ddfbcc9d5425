import json

import pytest
from pyspark.sql import functions as F

from tracklore.plans import sinks

DDL = "name string, at int, note string"
ROWS = [("a/b", 1, "x"), ("a/b", 2, None), ("100%+1", 3, "é\n"), (None, 4, "n"), ("", 5, "e"), ("plain é", None, None)]


def folders(path):
    return {f.name: sorted(line for file in f.glob("*.json") for line in file.read_text().splitlines())
            for f in path.iterdir() if "=" in f.name}


def test_folders_are_those_of_spark_and_read_back_without_listing(spark, tmp_path):
    """tasks write and read the folders themselves."""
    rows = spark.createDataFrame(ROWS, DDL)
    rows.write.partitionBy("name").json(str(tmp_path / "spark"))
    sinks.write_partitioned_json(rows, f"file:{tmp_path}/own", "name", ["at"])
    assert folders(tmp_path / "own") == folders(tmp_path / "spark")
    back = sinks.read_partitioned_json(spark, str(tmp_path / "own"), "name", DDL)
    assert back.schema.simpleString() == rows.schema.simpleString()
    expected = sorted(((r[0] or None, *r[1:]) for r in ROWS), key=str)
    assert sorted((tuple(r) for r in back.collect()), key=str) == expected
    (tmp_path / "own" / "name=stray").mkdir()
    (tmp_path / "own" / "name=stray" / "x.json").write_text('{"at": 9}\n')
    assert back.count() == len(ROWS)


@pytest.mark.parametrize("mode", ["dynamic", "static"])
def test_folders_are_replaced_as_spark_replaces_them(spark, tmp_path, mode):
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
    try:
        path = str(tmp_path / "out")
        many = spark.range(3_000).select((F.col("id") % 300).alias("k"), F.col("id").alias("v"))
        sinks.write_partitioned_json(many, path, "k", ["v"])
        assert sinks.read_partitioned_json(spark, path, "k", "k bigint, v bigint").exceptAll(many).isEmpty()
        again = spark.createDataFrame([(7, -1), (1_000, -2)], "k bigint, v bigint")
        sinks.write_partitioned_json(again, path, "k", ["v"])
        kept = many.where("k <> 7").unionByName(again) if mode == "dynamic" else again
        back = sinks.read_partitioned_json(spark, path, "k", "k bigint, v bigint")
        assert back.exceptAll(kept).isEmpty() and back.count() == kept.count()
        assert spark.read.schema("v bigint, k bigint").json(path).select("k", "v").exceptAll(kept).isEmpty()
        found = folders(tmp_path / "out")
        assert [json.loads(line) for line in found["k=7"]] == [{"v": -1}] and len(found) == (301 if mode == "dynamic" else 2)
        sinks.write_partitioned_json(again.limit(0), str(tmp_path / "none"), "k")
        assert sinks.read_partitioned_json(spark, str(tmp_path / "none"), "k", "k bigint, v bigint").isEmpty()
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
