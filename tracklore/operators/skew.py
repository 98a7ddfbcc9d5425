"""Joins and rankings that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tracklore.session import cut_lineage

DEFAULT_SALTS = 8


def salted_join(
    big: DataFrame, small: DataFrame, keys: list[str], spread: Column, how: str = "inner", salts: int = DEFAULT_SALTS
) -> DataFrame:
    """Equi-join of a skewed side with a side that is unique per key.

    Rows of one hot key go to `salts` tasks by `spread`; the unique side is repeated once per salt. The repeated rows are
    merged, never broadcast: Spark's estimate comes from compressed files and the driver would hold every row once per salt.
    """
    salted_big = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    salted_small = small.crossJoin(small.sparkSession.range(salts).select(F.col("id").cast("int").alias("_salt")))
    return salted_big.join(salted_small.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def global_rank(df: DataFrame, measure: str, id_column: str, rank_column: str = "rank") -> DataFrame:
    """1-based position by (measure desc, id asc) without moving all rows to one task.

    Rows are range-partitioned by (measure, id), so entities with equal measures spread out too. The partitioned
    rows are stored, which fixes their ranges; rank = rows in earlier ranges + position within the range. The one
    unpartitioned window runs over as many rows as there are ranges.
    """
    order = [F.desc(measure), F.asc(id_column)]
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.Window.orderBy("_range")) - F.col("_n")
    offsets = sizes.select("_range", before.alias("_before"))
    position = F.row_number().over(W.Window.partitionBy("_range").orderBy(*order))
    return (
        ranged.withColumn("_position", position)
        .join(offsets, "_range")
        .withColumn(rank_column, F.col("_before") + F.col("_position"))
        .drop("_range", "_position", "_before")
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key. The `= 1` filter makes Spark prune map-side before the shuffle
    (WindowGroupLimit), so copies of a hot key do not meet in one task."""
    position = F.row_number().over(W.Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_position", position).where("_position = 1").drop("_position")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    position = F.row_number().over(W.Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, position).where(F.col(rank) <= k)


def single_value(df: DataFrame) -> Column:
    """One-row, one-column aggregate as a scalar subquery; replaces a cross join with a global total."""
    return df.scalar()
