"""Global shuffle into shards in two passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracklore.session import cut_lineage

SHARDS, SEED, BUCKET_BYTES = 8, 11, 8 << 20
#: Buckets that one task holds; it fills all of them before it shuffles the first. A task's memory is several times their
#: bytes, so executors with more memory take larger buckets (a parameter) and fewer tasks.
BUCKETS_A_TASK = 4


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus 1; null counts as empty."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shuffle_into_shards(docs: DataFrame, key: list[Column], size: Column, shards: int = SHARDS, seed: int = SEED,
                        bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows of `docs` as (doc struct, law, shard, slot, grown_shard).

    First pass: rows scatter uniformly by a seeded hash of `key` into buckets of about `bucket_bytes`, whose number
    follows the total size. Second pass: each bucket is shuffled in memory (`shuffle` is a Fisher-Yates shuffle). The
    buckets one after the other are the shuffled order; its g-th row is in shard g mod `shards`, at slot g div `shards`.
    The result follows from the rows and the seed: partitions are as many as the buckets need, whatever the session says,
    and the buckets of a partition are taken in order. So the law is `rows`: counts are at most one apart and slots have
    no gaps; `grown_shard` is null. Rows whose `key` is equal share a bucket and are all kept. Nulls are keys like others,
    an empty table gives an empty result, and columns of any name are kept inside `doc`.
    """
    hashed = F.xxhash64(F.lit(seed), *key)
    packed = docs.select(F.struct("*").alias("doc"), hashed.alias("_hash"), size.alias("_size"))
    total = docs.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    scattered = cut_lineage(packed.withColumn("_bucket", F.pmod("_hash", F.lit(buckets))))
    counts = scattered.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")
    offsets = counts.select("_bucket", before.alias("_before"))
    # Sorted first, so that the shuffled order does not hang on the order in which rows arrived. The random numbers are
    # seeded by partition, so the number of partitions is fixed here and the aggregate keeps them.
    dealt = scattered.repartition(-(-buckets // BUCKETS_A_TASK), "_bucket")
    filled = dealt.groupBy("_bucket").agg(F.sort_array(F.collect_list(F.struct("_hash", "doc"))).alias("_rows"))
    shuffled = filled.sortWithinPartitions("_bucket").select(
        "_bucket", F.posexplode(F.shuffle("_rows", F.lit(seed))).alias("_place", "_row")).join(offsets, "_bucket")
    return shuffled.select(
        F.col("_row.doc").alias("doc"), F.lit("rows").alias("law"),
        F.pmod(F.col("_before") + F.col("_place"), F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"(_before + _place) div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order within each file."""
    rows = sharded.select("doc.*", "shard", "slot")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
