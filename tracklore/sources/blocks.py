"""Positions in text files that Spark reads in blocks: running totals over a file without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tracklore.session import cut_lineage

BLOCK = ["source_file", "block"]
#: Places of a block that one window holds; a reader that does not split a file gives all of it as one block.
CHUNK_PLACES = 100_000


def read_pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(source_file, block, place, piece): the text of all files below `path`, cut at a separator, which is left out.

    A block is what one task reads of a file; `place` orders the pieces of a block.
    """
    return spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), F.col("value").alias("piece"))


def with_running(rows: DataFrame, **values: Column) -> DataFrame:
    """Adds for each value its sum over all earlier rows of the file, this one left out.

    Values are added up per chunk of a block first, those sums over the chunks of a file, one row each, which are stored;
    within a chunk a window does the rest. Windows of several calls share one shuffle by chunk and one sort. Places are
    whole numbers, and a chunk spans `CHUNK_PLACES` of them, so a window stays small where a whole file is one block.
    """
    chunk = [*BLOCK, "_chunk"]
    cut = rows.withColumn("_chunk", F.floor(F.col("place") / CHUNK_PLACES))
    sums = cut.groupBy(*chunk).agg(*(F.sum(value).alias(f"_{name}") for name, value in values.items()))
    earlier = W.Window.partitionBy("source_file").orderBy("block", "_chunk").rowsBetween(W.Window.unboundedPreceding, -1)
    before = cut_lineage(sums.select(*chunk, *(F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}") for name in values)))
    here = W.Window.partitionBy(*chunk).orderBy("place").rowsBetween(W.Window.unboundedPreceding, -1)
    ran = cut.select("*", *(F.coalesce(F.sum(value).over(here), F.lit(0)).alias(name) for name, value in values.items()))
    added = ran.join(before, chunk).withColumns({name: F.col(name) + F.col(f"_{name}") for name in values})
    return added.drop("_chunk", *(f"_{name}" for name in values))


def with_number(rows: DataFrame, number: str) -> DataFrame:
    """Adds the number of each row in its file, from 1, for rows (source_file, block, place, ...)."""
    numbered = with_running(rows, **{number: F.lit(1)})
    return numbered.withColumn(number, F.col(number) + 1)
