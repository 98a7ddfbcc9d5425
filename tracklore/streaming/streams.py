"""Structured Streaming variants of ingest, counts, sessions and de-duplication."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

LATE = "1 hour"
SESSION_GAP = "1 hour"


def file_stream(spark: SparkSession, folder: str, schema: str, pattern: str = "*", kind: str = "parquet") -> DataFrame:
    """Files of a folder as a stream; a large backlog arrives in bounded batches."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 1000)
    return reader.format(kind).load(folder)


def _run(writer: DataStreamWriter, checkpoint: str) -> None:
    """Everything available now, then stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


#: State in files beside the heap, written as changes: a batch loads and writes the keys it meets, not all of them.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """Settings for a query that starts within; a checkpoint keeps those it was begun with."""
    before = {key: spark.conf.get(key, None) for key in STATE_STORE}
    try:
        for key, value in STATE_STORE.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def stream_ingest(rows: DataFrame, store: str, checkpoint: str) -> None:
    """Append rows whose `raw_hash` has not been stored yet; one of several new rows with the same hash.

    The hashes are keyed state, spread over the shuffle partitions of the first run: a batch looks up its own hashes only,
    however many were stored before, and never reads the store. State, offsets and the sink's log are one transaction per
    batch, so a run that fails and starts again from the checkpoint adds each hash once.
    """
    with _state_store(rows.sparkSession):
        append_parquet(rows.dropDuplicates(["raw_hash"]), store, checkpoint)


def hourly_counts(events: DataFrame, ts: str = "ts", late: str = LATE) -> DataFrame:
    """Plays per tumbling hour."""
    return (
        events.withColumn("ts", F.col(ts).cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", "1 hour").alias("w"))
        .agg(F.count("*").alias("plays"))
        .select(F.col("w.start").alias("hour_start"), "plays")
    )


def stream_hourly_counts(events: DataFrame, sink: str, checkpoint: str, late: str = LATE) -> None:
    """Updated windows per batch; `latest_counts` reads the last value of each."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    _run(hourly_counts(events, late=late).writeStream.outputMode("update").foreachBatch(write), checkpoint)


def latest_counts(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(sink).groupBy("hour_start").agg(F.max_by("plays", "batch_id").alias("plays"))


def sessions(events: DataFrame, keys: list[str], gap: str = SESSION_GAP, late: str = LATE) -> DataFrame:
    """Plays per session; a pause of exactly the gap already ends one, unlike in the batch operator."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(*keys, F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("plays"))
        .select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "plays")
    )


def append_parquet(rows: DataFrame, sink: str, checkpoint: str) -> None:
    """Exactly-once append through the file sink's log."""
    _run(rows.writeStream.outputMode("append").format("parquet").option("path", sink), checkpoint)


def stream_sessions(events: DataFrame, keys: list[str], sink: str, checkpoint: str) -> None:
    """Sessions once the watermark has passed their end."""
    append_parquet(sessions(events, keys), sink, checkpoint)


def dedupe(events: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    """First event per key among those not further apart than `late`."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def stream_dedupe(events: DataFrame, keys: list[str], sink: str, checkpoint: str, late: str = LATE) -> None:
    append_parquet(dedupe(events, keys, late), sink, checkpoint)
