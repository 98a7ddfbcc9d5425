"""Approximate search: a table of queries against entity names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklore.functions.similarity import substring_errors
from tracklore.operators.enrich import GRAM, grams
from tracklore.operators.skew import salted_join, top_per_key

THRESHOLD = 0.3
# Results per kind of entity.
LIMITS = {"artist": 5, "album": 5, "track": 10}


def allowed_errors(query: Column, threshold: float = THRESHOLD) -> Column:
    return F.floor(F.length(query) * F.lit(threshold) + 1e-9).cast("int")


def _pieces(query: Column, threshold: float) -> Column:
    """Cut into one piece more than errors are allowed, so that one piece survives any allowed set of errors."""
    count = allowed_errors(query, threshold) + 1
    cut = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.substring(
            query,
            (F.floor(i * F.length(query) / count) + 1).cast("int"),
            (F.floor((i + 1) * F.length(query) / count) - F.floor(i * F.length(query) / count)).cast("int"),
        ),
    )
    # Names are indexed by pieces of up to GRAM letters; the start of a longer piece survives with it.
    return F.array_distinct(F.transform(cut, lambda piece: F.substring(piece, 1, GRAM)))


def search_kind(queries: DataFrame, kind: str, rows: DataFrame, keys: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """Best hits of every query among rows (id, keys...): the lowest share of wrong letters in any key."""
    limit = LIMITS[kind]
    words = queries.select("query", F.lower("query").alias("needle")).where("needle <> ''").distinct()
    texts = rows.select("id", F.explode(F.array(*[F.lower(k) for k in keys])).alias("text")).where("text <> ''").distinct()
    # Equal names are compared once; no query can show more than `limit` of them.
    holders = top_per_key(texts, ["text"], [F.asc("id")], limit, "place").drop("place")
    index = holders.select("text").distinct().select(
        "text", F.explode(F.array_distinct(F.concat(*[grams(F.col("text"), n) for n in range(1, GRAM + 1)]))).alias("gram")
    )
    wanted = words.select("query", "needle", F.explode(_pieces(F.col("needle"), threshold)).alias("gram"))
    candidates = salted_join(index, wanted, ["gram"], F.col("text")).select("query", "needle", "text").distinct()
    scored = candidates.withColumn("errors", substring_errors("needle", "text")).where(
        F.col("errors") <= allowed_errors(F.col("needle"), threshold)
    )
    hits = scored.join(holders, "text").groupBy("query", "id").agg(
        F.min(F.struct("errors", F.length("text").alias("size"))).alias("hit"), F.first("needle").alias("needle")
    )
    order = [F.asc("hit.errors"), F.asc("hit.size"), F.asc("id")]
    best = top_per_key(hits, ["query"], order, limit)
    return best.select(
        "query", F.lit(kind).alias("kind"), "rank", "id",
        F.round(F.col("hit.errors") / F.length("needle"), 6).alias("score"),
    )


def fuzzy_lookup(
    queries: DataFrame, artists: DataFrame, albums: DataFrame, tracks: DataFrame, threshold: float = THRESHOLD
) -> DataFrame:
    """Up to 5 artists, 5 albums and 10 tracks per query."""
    return (
        search_kind(queries, "artist", artists, ["name"], threshold)
        .unionByName(search_kind(queries, "album", albums, ["title", "artist_name"], threshold))
        .unionByName(search_kind(queries, "track", tracks, ["title", "artist_name"], threshold))
    )
