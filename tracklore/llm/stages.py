"""Storing intermediate tables of an operator."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from tracklore import session

#: Files of a stored table per core, if its input has fewer; shuffles may have far more partitions than a small table
#: needs files.
FILES_PER_CORE = 4


def store(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, in as many files at most as its input has; see `cut_lineage`."""
    least = FILES_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    return session.cut_lineage(df.coalesce(max(least, len(df.inputFiles()))))


def discard(*tables: DataFrame) -> None:
    """Removes stored tables that nothing reads any more, and has Spark drop the shuffle files of plans that are gone.

    Shuffle files go when the driver's garbage collector finds their plans unreachable, which a driver with little to do
    may put off until the disks are full.
    """
    session.discard(*tables)
    gc.collect()
    SparkSession.getActiveSession().sparkContext._jvm.System.gc()
