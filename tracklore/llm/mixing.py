"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracklore.llm.stages import store

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (3, 1, 2)
SHARE, MOST_COPIES, SEED = 1.5, 2, 7


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, source_column: str, size_column: str, weights=WEIGHTS, share: float = SHARE,
                   most: int = MOST_COPIES) -> DataFrame:
    """Per source: (source, source_size, target).

    Sources by code point, null last, take the weights in turn and divide `share` times the total size. No target
    exceeds `most` times its source's size; the excess goes to the others by weight. With the sources in the order of
    (cap / weight), those before the first whose share by weight fits under its cap are full, and it and all later ones
    get that share. One row per source is ordered in one task; documents never are.
    """
    sizes = sized.groupBy(F.col(source_column).alias("source")).agg(F.sum(size_column).cast("long").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(turn, F.lit(len(weights))) + 1).cast("int"))
    caps = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    per_weight = (F.lit(share) * F.sum("source_size").over(everything) - before) / left
    fits = F.when(F.col("per_weight") <= F.col("cap") / F.col("weight"), F.struct("place", "per_weight"))
    return (
        caps.withColumn("per_weight", per_weight)
        .withColumn("place", F.row_number().over(by_cap))
        .withColumn("_level", F.min(fits).over(everything)["per_weight"])
        .select("source", "source_size", F.least(F.col("cap").cast("double"),
                F.coalesce(F.col("_level") * F.col("weight"), F.col("cap").cast("double"))).alias("target"))
    )


def _placed(packed: DataFrame) -> DataFrame:
    """Adds `_rank`, the 1-based place of a row in its source by (size, id).

    Rows are range-partitioned, so a source with a third of all rows lies in many tasks; the stored rows fix the
    ranges, and a row's place is the number of rows of its source in earlier ranges plus its place in its range.
    """
    ranged = store(
        packed.repartitionByRange("_source", "_size", "_id").withColumn("_range", F.spark_partition_id())
    )
    counts = ranged.groupBy("_source", "_range").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("_source").orderBy("_range")) - F.col("_n")
    offsets = counts.select(F.col("_source").alias("_s"), F.col("_range").alias("_r"), earlier.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range", "_source").orderBy("_size", "_id"))
    return (
        ranged.withColumn("_place", place)
        .join(offsets, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
        .withColumn("_rank", F.col("_before") + F.col("_place"))
    )


def mix_sources(docs: DataFrame, size: Column, id_column: str = "doc_id", source_column: str = "source",
                weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """All rows of `docs` as (doc struct, size, source_size, target, copies).

    Every document of a source expects target / source_size copies. In the order of (size, id) these add up along the
    source; one offset per source, drawn from `seed` and its name, shifts the sums, and a document is emitted once per
    whole number crossed. Ordered by size, the emitted words differ from the target by no more than about the largest
    document. `copies` is 0 to `most`; rows of size 0 may get copies, which add no words. Null sources form one source,
    null ids come first among equal sizes; equal rows are placed next to each other. Reruns agree.
    An empty table gives an empty result. Columns of any name are kept inside `doc`. `docs` is evaluated twice.
    """
    packed = docs.select(
        F.struct("*").alias("doc"), F.col(id_column).alias("_id"), F.col(source_column).alias("_source"), size.alias("_size")
    )
    placed = _placed(packed)
    targets = source_targets(placed, "_source", "_size", weights, share, most)
    name = F.concat_ws("|", F.lit(str(seed)), F.when(F.col("_source").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), "_source")))
    offset = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = placed.join(targets, F.col("_source").eqNullSafe(F.col("source")))
    sums = joined.withColumn("_offset", offset).withColumn("_each", expected)
    copies = F.floor(F.col("_offset") + F.col("_each") * F.col("_rank")) - F.floor(
        F.col("_offset") + F.col("_each") * (F.col("_rank") - 1))
    return sums.select("doc", F.col("_size").alias("size"), "source_size", "target", copies.cast("long").alias("copies"))


def emit_copies(mixed: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it was drawn."""
    drawn = mixed.where("copies > 0").select("doc", F.explode(F.expr("sequence(1L, copies)")).alias("_copy"))
    return drawn.select("doc.*")
