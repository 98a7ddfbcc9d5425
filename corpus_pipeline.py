"""From raw documents to training shards: five stages, each stored as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklore.llm import decontamination, mixing, ngram_join, shards, toxicity
from tracklore.session import cut_lineage, prepare


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not score as toxic."""
    fitted = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs, fitted).where("predicted = 0").select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group that similar five-word shingle sets link."""
    return ngram_join.keep_one_per_group(docs, words=5, percent=80)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in windows of benchmark items."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources draws them."""
    return mixing.emit_copies(mixing.mix_sources(docs, mixing.word_count(F.col("text"))))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shuffled corpus: the columns of documents with the shard and the slot of each row."""
    size = shards.text_size(F.col("text"))
    key = [F.col("doc_id"), F.xxhash64("text")]
    return shards.shuffle_into_shards(docs, key, size).select("doc.*", "law", "shard", "slot")


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("benchmark passages", drop_benchmark_passages),
    ("mix", mix),
    ("shards", shard),
]
#: The first stage learns its model by gradient steps, which SQL cannot express; the tests have brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
