"""Session settings shared by jobs, tests and the bench."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app: str = "tracklore", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> None:
    """Make a session built elsewhere usable: date parts on UTC, this package importable on the executors."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    context = spark.sparkContext
    if not getattr(context, "_tracklore_shipped", False):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        target = os.path.join(tempfile.mkdtemp(prefix="tracklore-"), "tracklore")
        context.addPyFile(shutil.make_archive(target, "zip", root, "tracklore"))
        context._tracklore_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can read: the one the cluster names, or a temporary one on a local master."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        # On a cluster a machine-local path would be unreadable from the other executors.
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="tracklore-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, for tables a job writes and reads back."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path names."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()).exists(place)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder; survives the loss of executors.

    A written table is computed once, where `checkpoint()` computes its input twice, and it carries no inferred
    constraints along, which pile up over the rounds of an iterative job.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stage_path = path
    return stored


def discard(*stages: DataFrame) -> None:
    """Removes tables that `cut_lineage` stored, once nothing that is still to run reads them."""
    for stage in stages:
        context = stage.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(stage._stage_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
