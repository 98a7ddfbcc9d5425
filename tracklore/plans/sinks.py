"""Writing reports. Small aggregates become one file; per-entity output is partitioned, never looped over."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracklore.session import cut_lineage, exists


def write_small_json(df: DataFrame, path: str, order: list[Column] | None = None) -> None:
    """One JSON-lines file for a table whose size the calendar or a limit bounds."""
    rows = df.orderBy(*order) if order else df
    rows.coalesce(1).write.mode("overwrite").json(path)


#: Characters that a folder name spells in hex, as Spark does, and the folder of a null key.
_HEX = {chr(c): f"%{c:02X}" for c in [*range(1, 32), 127, *map(ord, "\"#%'*/:=?\\{[]^")]}
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"
#: Table of the files below a path, which readers of the path do not see, and files that are read by one task.
FILES, TASK_FILES = "_files", 20_000


def _file_system(path: str) -> tuple[fs.FileSystem, str] | None:
    """The file system that tasks can use without the JVM, and the path in it."""
    try:
        return fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, OSError):
        return None


def _folder(key: str) -> Column:
    """Folder of a row, spelled as Spark spells it."""
    text, names = F.col(key).cast("string"), F.create_map(*[F.lit(x) for pair in _HEX.items() for x in pair])
    letters = F.transform(F.split(text, ""), lambda c: F.coalesce(names[c], c))
    spelled = F.when(text.rlike("[" + "".join(f"\\x{ord(c):02x}" for c in _HEX) + "]"), F.array_join(letters, "")).otherwise(text)
    return F.concat(F.lit(f"{key}="), F.when(F.coalesce(text, F.lit("")) == "", NULL_FOLDER).otherwise(spelled))


def _files(path: str, job: str, fresh: bool):
    """(folder, line), sorted by folder -> (folder, file) of the files written. A task that runs again writes the same names."""
    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _file_system(path)
        name, current, out, done = f"part-{TaskContext.get().partitionId():05d}-{job}.json", None, None, []
        for batch in batches:
            for folder, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if folder != current:
                    if out is not None:
                        out.close()
                    current, place = folder, f"{root}/{folder}"
                    store.create_dir(place)
                    if not fresh:
                        old = store.get_file_info(fs.FileSelector(place))
                        for file in old:
                            if not file.base_name.endswith(f"-{job}.json"):
                                store.delete_file(file.path)
                    out = store.open_output_stream(f"{place}/{name}")
                    done.append(folder)
                out.write(line.encode() + b"\n")
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string()), pa.array([name] * len(done), pa.string())], ["folder", "file"])
            done = []
        if out is not None:
            out.close()

    return files


def write_partitioned_json(df: DataFrame, path: str, key: str, order: list[str] | None = None) -> None:
    """One folder per key. Rows are spread by key and order, so a heavy key is written by several tasks.

    Tasks write straight into the folders and list their files in a table beside them: Spark's own writer creates and moves
    each of them through Hadoop's file system, several milliseconds a folder. It writes where only the JVM reaches the path.
    Folders that are there already are replaced as Spark replaces them: all, or with dynamic overwrite those of these keys.
    """
    order, spark = order or [], df.sparkSession
    rows = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    found = _file_system(path)
    if found is None:
        rows.write.mode("overwrite").partitionBy(key).json(path)
        return
    store, root = found
    fresh = store.get_file_info(root).type == fs.FileType.NotFound
    if not fresh and spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() != "dynamic":
        store.delete_dir(root)
        fresh = True
    store.create_dir(root)
    lines = rows.select(_folder(key).alias("folder"), F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("line"))
    written = lines.mapInArrow(_files(path, uuid.uuid4().hex, fresh), "folder string, file string")
    # Files of folders that stay are listed too; a folder of these keys has no file but those just written.
    if not fresh and exists(spark, f"{path}/{FILES}"):
        listed = spark.read.parquet(f"{path}/{FILES}")
        new = cut_lineage(written)
        written = listed.join(new, "folder", "left_anti").unionByName(new)
        written = cut_lineage(written)
    elif not fresh:
        cut_lineage(written)
        return
    written.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/{FILES}")


def _lines(path: str):
    """(folder, file) -> (folder, line)."""
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _file_system(path)
        for batch in batches:
            for folder, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_stream(f"{root}/{folder}/{file}") as stream:
                    text = stream.read().decode().split("\n")[:-1]
                yield pa.RecordBatch.from_arrays([pa.array([folder] * len(text), pa.string()), pa.array(text, pa.string())], ["folder", "line"])

    return lines


def read_partitioned_json(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """The rows below a path that `write_partitioned_json` wrote, with the columns of `schema`, the key among them.

    Files are opened by the tasks that their table gives them, so the driver lists no folder.
    """
    if _file_system(path) is None or not exists(spark, f"{path}/{FILES}"):
        return spark.read.schema(schema).json(path)
    files = spark.read.parquet(f"{path}/{FILES}")
    tasks = max(files.count() // TASK_FILES, spark.sparkContext.defaultParallelism)
    lines = files.repartition(tasks).mapInArrow(_lines(path), "folder string, line string")
    rows = lines.select("folder", F.from_json("line", schema).alias("r"))
    value = F.expr(f"substring(folder, {len(key) + 2})")
    value = F.when(value != NULL_FOLDER, F.url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))))
    fields = StructType.fromDDL(schema)
    return rows.select(*[value.cast(f.dataType).alias(key) if f.name == key else F.col("r")[f.name].alias(f.name) for f in fields])


def export_summaries(tables: dict[str, DataFrame], folder: str) -> None:
    """summary, monthly, hourly, weekday, top artists and geography, one file each; empty ones are left out."""
    for name, df in tables.items():
        if not df.isEmpty():
            write_small_json(df, f"{folder}/{name}")


# The tables that leave the warehouse; the play fact is not among them.
SLIM_TABLES = [
    "canonical_artists", "canonical_albums", "canonical_tracks", "canonical_track_artists", "canonical_track_albums",
    "artist_analytics", "album_analytics", "track_analytics", "artist_genres", "monthly_summary",
    "hourly_distribution", "weekday_distribution", "geographic_analytics", "discovery_context", "listening_eras",
]


def export_slim(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """Parquet copy of the dimension and analytics tables that exist; returns their names."""
    chosen = [name for name in SLIM_TABLES if name in tables]
    for name in chosen:
        tables[name].write.mode("overwrite").parquet(f"{folder}/{name}")
    return chosen


def overview_json(overview: DataFrame, exported_at: Column | None = None) -> DataFrame:
    """Nested shape of the overview report."""
    def entity(kind: str) -> Column:
        fields = [F.col(f"top_{kind}_{field}").alias(field) for field in ("id", "label", "plays")]
        return F.when(F.col(f"top_{kind}_id").isNotNull(), F.struct(*fields)).alias(f"top_{kind}")

    flat = [c for c in overview.columns if not c.startswith("top_")]
    stamp = F.current_timestamp() if exported_at is None else exported_at
    return overview.select(*flat, *[entity(kind) for kind in ("artist", "album", "track")], stamp.alias("exported_at"))
