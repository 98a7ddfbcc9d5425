"""JSONL dumps of artists, release groups and recordings, reshaped to lookup tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklore import schema

DUMP_SCHEMAS = {
    "artist": schema.MB_ARTIST_DDL,
    "release-group": schema.MB_RELEASE_GROUP_DDL,
    "recording": schema.MB_RECORDING_DDL,
}


def read_dump(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """Lookup table of one entity. Lines that do not parse are skipped, the first line per id stays."""
    lines = spark.read.text(path).select(
        F.struct(
            F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
        ).alias("position"),
        F.col("value"),
    )
    return parse_dump(lines, entity)


def parse_dump(lines: DataFrame, entity: str) -> DataFrame:
    parsed = lines.select("position", F.from_json("value", DUMP_SCHEMAS[entity]).alias("r"))
    label = "name" if entity == "artist" else "title"
    named = parsed.where((F.col("r.id") != "") & (F.col(f"r.{label}") != ""))
    # min_by combines map-side, so a hot id costs one row per input partition.
    first = named.groupBy(F.col("r.id").alias("mbid")).agg(F.min_by("r", "position").alias("r"))
    return TRANSFORMS[entity](first.select("r.*"))


def _tags(column: Column | str) -> Column:
    tagged = F.transform(
        column,
        lambda t: F.struct(t["name"].alias("name"), F.coalesce(t["count"], F.lit(0).cast("bigint")).alias("count")),
    )
    return F.when(F.size(tagged) > 0, tagged)


def artist_table(dump: DataFrame) -> DataFrame:
    return dump.select(
        F.col("id").alias("mbid"),
        "name",
        F.col("`sort-name`").alias("sort_name"),
        "country",
        "type",
        "disambiguation",
        _tags("tags").alias("tags"),
    )


def release_group_table(dump: DataFrame) -> DataFrame:
    credit = F.col("`artist-credit`")
    return dump.select(
        F.col("id").alias("mbid"),
        "title",
        F.col("`primary-type`").alias("type"),
        F.col("`first-release-date`").alias("first_release_date"),
        F.when(F.size(credit) > 0, credit).alias("artist_credit"),
        _tags("tags").alias("tags"),
    )


def recording_table(dump: DataFrame) -> DataFrame:
    """Keeps all releases, flattened with their release group."""
    releases = F.transform(
        "releases",
        lambda r: F.struct(
            r["id"].alias("release_mbid"),
            r["title"].alias("release_title"),
            r["release-group"]["id"].alias("release_group_mbid"),
            r["release-group"]["title"].alias("release_group_title"),
            r["release-group"]["primary-type"].alias("release_group_type"),
            r["date"].alias("date"),
        ),
    )
    return dump.select(
        F.col("id").alias("mbid"),
        "title",
        F.col("length").alias("length_ms"),
        F.col("`artist-credit`").alias("artist_credit"),
        F.when(F.size(releases) > 0, releases).alias("releases"),
    )


TRANSFORMS = {"artist": artist_table, "release-group": release_group_table, "recording": recording_table}


def import_status(tables: dict[str, DataFrame], imported_at: Column) -> DataFrame:
    """(entity_type, imported_at, record_count)."""
    rows = None
    for entity, table in tables.items():
        row = table.agg(F.count("*").alias("record_count")).select(
            F.lit(entity).alias("entity_type"), imported_at.alias("imported_at"), "record_count"
        )
        rows = row if rows is None else rows.unionByName(row)
    return rows
