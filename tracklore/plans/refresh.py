"""Computing all analytics tables at once, and bringing stored ones up to date after new plays."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tracklore.functions.timeparts import year_month
from tracklore.operators import linkage, metrics, resolve
from tracklore.schema import PLAYS_DDL
from tracklore.session import cut_lineage

BUCKETS = 64


def analytics_tables(plays: DataFrame, tracks: DataFrame, as_of: Column | None = None) -> dict[str, DataFrame]:
    """Every analytics table, lazily. `tracks` has (id, album_id)."""
    daily = metrics.artist_daily(plays)
    return {
        "artist_analytics": metrics.artist_analytics(plays, as_of),
        "album_analytics": metrics.album_analytics(plays, tracks),
        "track_analytics": metrics.track_analytics(plays),
        "monthly_summary": metrics.monthly_summary(plays),
        "hourly_distribution": metrics.hourly_distribution(plays),
        "weekday_distribution": metrics.weekday_distribution(plays),
        "discovery_context": metrics.discovery_context(daily),
        "geographic_analytics": metrics.geographic(plays),
    }


def resolve_and_link(raw: DataFrame, threshold: float | None = resolve.FUZZY_THRESHOLD) -> dict[str, DataFrame]:
    """Raw plays of all sources to dimensions, aliases and linked, de-duplicated plays."""
    artists, artist_aliases = resolve.resolve_artists(resolve.distinct_raw_artists(raw), threshold)
    albums, album_aliases = resolve.resolve_albums(resolve.distinct_raw_albums(raw), artist_aliases, threshold)
    tracks, track_aliases = resolve.resolve_tracks(
        resolve.distinct_raw_tracks(raw), artist_aliases, album_aliases, threshold
    )
    linked = resolve.link_plays(raw, artist_aliases, track_aliases)
    empty = F.lit(None).cast("bigint")
    plays = linked.select(
        F.xxhash64("source", "record_id").alias("play_id"), "track_id", "album_id", "artist_id", "ts", "duration_ms",
        empty.alias("ms_played"), "source", "country", F.lit(None).cast("string").alias("region"),
        F.lit(None).cast("string").alias("city"), F.lit(False).alias("is_duplicate"), empty.alias("duplicate_of"),
    )
    return {
        "artists": artists, "albums": albums, "tracks": tracks, "artist_aliases": artist_aliases,
        "album_aliases": album_aliases, "track_aliases": track_aliases,
        "plays": linkage.dedupe_mark(cut_lineage(plays)),
    }


# --- incremental -------------------------------------------------------------------------
#
# A store holds plays and, for each of eight small aggregates, the part that every batch adds to them. Parts of one key
# merge by sum, minimum or maximum, so a refresh reads the batch and the parts in the folders it touches, never old plays.
# All folders of a batch carry its name and are replaced as a whole: a refresh that broke off is simply run again.

#: Aggregate -> (what its folders are split by, how its measures merge); the other columns are its key.
PARTS = {
    "artist_day": ("artist_id", {"plays": "sum", "duration_ms": "sum"}),
    "artist_track": ("artist_id", {"plays": "sum"}),
    "track_year": (
        "track_id",
        {"first_play_date": "min", "last_play_date": "max", "plays": "sum", "total_duration_ms": "sum"}
        | {part: "sum" for part in metrics.DAYPARTS},
    ),
    "album_track": (
        "album_id",
        {"first_play_date": "min", "last_play_date": "max", "total_plays": "sum", "total_duration_ms": "sum"},
    ),
    "album_slot": ("album_id", {"lo": "min", "hi": "max", "plays": "sum"}),
    "month": ("year_month", {"plays": "sum", "ms": "sum"}),
    "day_hour": (None, {"plays": "sum"}),
    "place": (None, {"total_plays": "sum", "first_play_date": "min", "last_play_date": "max"}),
}
MERGE = {"sum": F.sum, "min": F.min, "max": F.max}
#: Stored table -> the aggregates it is made of, all split in the same way.
TABLES = {
    "artist_measures": ("artist_day", "artist_track"),
    "track_analytics": ("track_year",),
    "album_basic": ("album_track",),
    "album_session_sizes": ("album_slot",),
    "month_totals": ("month",),
}

#: Analytics table -> the stored tables and aggregates it is read from.
ANALYTICS = {
    "artist_analytics": ("artist_measures", "day_hour"),
    "album_analytics": ("album_basic", "album_session_sizes"),
    "track_analytics": ("track_analytics",),
    "monthly_summary": ("month_totals", "artist_measures"),
    "hourly_distribution": ("day_hour",),
    "weekday_distribution": ("day_hour",),
    "discovery_context": ("artist_day",),
    "geographic_analytics": ("place",),
}


def _aggregate(name: str, plays: DataFrame) -> DataFrame:
    make = {
        "artist_day": metrics.artist_days,
        "artist_track": metrics.artist_track_counts,
        "track_year": metrics.track_years,
        "album_track": lambda rows: metrics.entity_tracks(rows.where("album_id is not null"), "album_id"),
        "album_slot": metrics.album_slots,
        "month": metrics.month_entities,
        "day_hour": metrics.day_hours,
        "place": metrics.geographic,
    }
    return make[name](plays)


def _needed(analytics: Iterable[str]) -> tuple[list[str], list[str]]:
    """Aggregates and stored tables behind these analytics tables."""
    parts, tables = set(), set()
    for wanted in analytics:
        for name in ANALYTICS[wanted]:
            if name in TABLES:
                tables.add(name)
                parts.update(TABLES[name])
            else:
                parts.add(name)
    return sorted(parts), sorted(tables)


def _derive(table: str, parts: list[DataFrame]) -> DataFrame:
    if table == "artist_measures":
        return metrics.artist_measures(*parts)
    make = {
        "track_analytics": metrics.track_measures,
        "album_basic": metrics.album_totals,
        "album_session_sizes": lambda slots: metrics.session_sizes(metrics.slot_sessions(slots)),
        "month_totals": metrics.month_totals,
    }
    return make[table](*parts)


def _split(key: str | None, buckets: int) -> Column:
    """Folder of a row: its month, or one of `buckets` by hash, as text so that no reader takes it for a date."""
    if key is None:
        return F.lit("all")
    if key == "year_month":
        return F.concat(F.lit("m"), F.coalesce(key, F.lit("")))
    return F.concat(F.lit("b"), F.pmod(F.xxhash64(key), F.lit(buckets)).cast("string"))


def _write(df: DataFrame, path: str, *folders: str) -> None:
    """Replace the touched folders. Rebalancing gives few files, and several tasks to a heavy folder, in one pass."""
    rows = df.hint("rebalance", *folders)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path)


def _read(spark: SparkSession, path: str, columns: StructType, folders: list[str]) -> DataFrame:
    """With the schema given, so a store without a single row reads as empty."""
    schema = StructType([*columns.fields, *[StructField(f, StringType()) for f in folders]])
    return spark.read.schema(schema).parquet(path)


def _columns(spark: SparkSession, name: str) -> StructType:
    return _aggregate(name, spark.createDataFrame([], PLAYS_DDL)).schema


def _merged(spark: SparkSession, store: str, name: str, folders: list[str] | None = None) -> DataFrame:
    """An aggregate over all batches, or over those folders of it."""
    columns = _columns(spark, name)
    parts = _read(spark, f"{store}/parts/{name}", columns, ["folder", "batch"])
    if folders is not None:
        parts = parts.where(F.col("folder").isin(folders))
    measures = PARTS[name][1]
    keys = [c for c in columns.names if c not in measures]
    return parts.groupBy(*keys).agg(*[MERGE[how](c).cast(columns[c].dataType).alias(c) for c, how in measures.items()])


def incremental_refresh(
    new_plays: DataFrame, store: str, batch: str, analytics: Iterable[str] = tuple(ANALYTICS), buckets: int = BUCKETS
) -> None:
    """Add a batch of plays and bring the stored tables up to date.

    `batch` names it: the same batch again replaces what it wrote, another name adds to it. Plays come with their
    duplicate marks, and a play of an earlier batch does not change; a correction means running its batch again with the
    same days and entities in it. `analytics` names the tables the store serves. It and `buckets` stay the same for the
    life of a store; choose buckets so that those of artists fit a few tasks. Null artists, albums, tracks and places
    count where the tables computed from all plays count them. An empty batch changes nothing.
    """
    spark = new_plays.sparkSession
    if not batch or "/" in batch or "=" in batch:
        raise ValueError(f"not a name for a batch: {batch!r}")
    for place in ("country", "region", "city"):
        if place not in new_plays.columns:
            new_plays = new_plays.withColumn(place, F.lit(None).cast("string"))
    parts, tables = _needed(analytics)
    _write(new_plays.withColumns({"year_month": year_month(), "batch": F.lit(batch)}), f"{store}/plays", "batch", "year_month")
    # Read back from the store: the aggregates then do not compute the batch once each.
    plays = _read(spark, f"{store}/plays", new_plays.schema, ["batch", "year_month"]).where(F.col("batch") == batch)
    touched = {}
    for name in parts:
        path, part = f"{store}/parts/{name}", _aggregate(name, plays)
        folder = _split(PARTS[name][0], buckets)
        _write(part.withColumns({"folder": folder, "batch": F.lit(batch)}), path, "folder", "batch")
        # At most `buckets` names, or as many as the batch has months.
        mine = _read(spark, path, part.schema, ["folder", "batch"]).where(F.col("batch") == batch)
        touched[name] = [row[0] for row in mine.select("folder").distinct().collect()]
    for table in tables:
        names = TABLES[table]
        folders = sorted({f for name in names for f in touched[name]})
        rows = _derive(table, [_merged(spark, store, name, folders) for name in names])
        _write(rows.withColumn("folder", _split(PARTS[names[0]][0], buckets)), f"{store}/tables/{table}", "folder")


def compact(
    spark: SparkSession, store: str, target: str, analytics: Iterable[str] = tuple(ANALYTICS), buckets: int = BUCKETS
) -> None:
    """The aggregates of a store with all batches merged into one, and its tables, as a new store beside it.

    A reader moves to `target` when it is complete; the old store is not changed, so breaking off harms nothing.
    Plays stay where they are: refreshes and readers need none of them. The number of buckets may change here.
    """
    parts, tables = _needed(analytics)
    for name in parts:
        rows = _merged(spark, store, name).withColumns(
            {"folder": _split(PARTS[name][0], buckets), "batch": F.lit("compacted")}
        )
        _write(rows, f"{target}/parts/{name}", "folder", "batch")
    for table in tables:
        names = TABLES[table]
        rows = _derive(table, [_merged(spark, target, name) for name in names])
        _write(rows.withColumn("folder", _split(PARTS[names[0]][0], buckets)), f"{target}/tables/{table}", "folder")


def _stored(spark: SparkSession, store: str, table: str) -> DataFrame:
    nothing = [spark.createDataFrame([], _columns(spark, name)) for name in TABLES[table]]
    columns = _derive(table, nothing).schema
    return _read(spark, f"{store}/tables/{table}", columns, ["folder"]).drop("folder")


def read_table(
    spark: SparkSession, store: str, table: str, tracks: DataFrame | None = None, as_of: Column | None = None
) -> DataFrame:
    """An analytics table of a store, equal to the one computed from all plays at once.

    What depends on today, on the list of tracks (`tracks`: id, album_id) or on other artists is added here, from the
    stored measures and aggregates.
    """
    if table == "artist_analytics":
        last = _merged(spark, store, "day_hour").agg(F.max("d").alias("d")).scalar()
        measures = _stored(spark, store, "artist_measures")
        return measures.withColumn("days_since_last_play", F.datediff(last if as_of is None else as_of, "last_play_date"))
    if table == "album_analytics":
        if tracks is None:
            raise ValueError("album_analytics needs the tracks")
        basic = _stored(spark, store, "album_basic")
        totals = basic.select("album_id", F.col("total_plays").alias("plays"))
        sized = _stored(spark, store, "album_session_sizes")
        rates = metrics.completion_share(totals, sized, metrics.album_track_count(tracks))
        return basic.join(rates, "album_id", "left")
    if table == "track_analytics":
        return _stored(spark, store, "track_analytics")
    if table == "monthly_summary":
        firsts = _stored(spark, store, "artist_measures").select(year_month("first_play_date").alias("year_month"))
        return metrics.with_discoveries(_stored(spark, store, "month_totals"), firsts)
    if table == "hourly_distribution":
        return metrics.hours_of(_merged(spark, store, "day_hour"))
    if table == "weekday_distribution":
        return metrics.weekdays_of(_merged(spark, store, "day_hour"))
    if table == "discovery_context":
        return metrics.discovery_context(_merged(spark, store, "artist_day").drop("duration_ms"))
    if table == "geographic_analytics":
        return _merged(spark, store, "place")
    raise ValueError(f"no such table: {table}")
