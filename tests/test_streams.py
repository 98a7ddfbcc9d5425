"""Streams over files that arrive in several runs, with restarts from the checkpoint."""

import json

import pytest

from tracklore.streaming import streams as s

DDL = "raw_hash string, n long"


def land(folder, name, hashes):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"raw_hash": h, "n": i}) for i, h in enumerate(hashes)))


def run(spark, tmp_path):
    stream = s.file_stream(spark, str(tmp_path / "in"), DDL, "*.json", "json")
    s.stream_ingest(stream, str(tmp_path / "store"), str(tmp_path / "log"))
    return sorted(r.raw_hash for r in spark.read.parquet(str(tmp_path / "store")).collect())


def test_each_hash_is_stored_once_over_restarts(spark, tmp_path):
    land(tmp_path / "in", "a.json", ["a", "b", "a", "c"])
    assert run(spark, tmp_path) == ["a", "b", "c"]
    assert run(spark, tmp_path) == ["a", "b", "c"], "a restart without new files adds nothing"
    land(tmp_path / "in", "b.json", ["c", "d", "d"])
    land(tmp_path / "in", "c.json", ["a", "e"])
    assert run(spark, tmp_path) == ["a", "b", "c", "d", "e"]


def test_a_failed_batch_is_done_again(spark, tmp_path):
    land(tmp_path / "in", "a.json", ["a", "b"])
    run(spark, tmp_path)
    land(tmp_path / "in", "b.json", ["b", "x"])
    stream = s.file_stream(spark, str(tmp_path / "in"), DDL, "*.json", "json")
    from pyspark.sql import functions as F

    failing = stream.withColumn("n", F.when(F.col("raw_hash") == "x", F.raise_error(F.lit("lost"))).otherwise(F.col("n")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        s.stream_ingest(failing, str(tmp_path / "store"), str(tmp_path / "log"))
    assert run(spark, tmp_path) == ["a", "b", "x"]


def test_a_batch_does_not_read_the_store(spark, tmp_path):
    land(tmp_path / "in", "a.json", [str(i) for i in range(500)])
    run(spark, tmp_path)
    land(tmp_path / "in", "b.json", ["new", "7"])
    stream = s.file_stream(spark, str(tmp_path / "in"), DDL, "*.json", "json").dropDuplicates(["raw_hash"])
    with s._state_store(spark):
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "store")).option(
            "checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        query.awaitTermination()
    progress = [p for p in query.recentProgress if p["numInputRows"]]
    assert [p["numInputRows"] for p in progress] == [2]
    assert progress[-1]["stateOperators"][0]["numRowsUpdated"] == 1 and progress[-1]["stateOperators"][0]["numRowsTotal"] == 501
