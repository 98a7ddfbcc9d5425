"""Play facts and dimensions derived from the test tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklore.session import prepare


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- plays from orders: years of history, whole days --------------------------------------


def order_plays(spark: SparkSession, folder: str, places: bool = False) -> DataFrame:
    items, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    joined = items.join(orders, items["l_orderkey"] == orders["o_orderkey"])
    country = region = city = F.lit(None).cast("string")
    if places:
        customer, nation, area = (table(spark, folder, t) for t in ("customer", "nation", "region"))
        joined = (
            joined.join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(area, F.col("n_regionkey") == F.col("r_regionkey"))
        )
        country = F.nullif("r_name", F.lit("EUROPE"))
        region = F.nullif("n_name", F.lit("NATION_7"))
        city = F.nullif("c_mktsegment", F.lit("BUILDING"))
    quantity = F.col("l_quantity")
    return joined.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("play_id"),
        F.col("l_partkey").alias("track_id"),
        F.nullif("l_suppkey", F.lit(0).cast("bigint")).alias("album_id"),
        F.nullif("o_custkey", F.lit(0).cast("bigint")).alias("artist_id"),
        F.col("o_orderdate").alias("ts"),
        F.when(F.col("l_linenumber") != 7, F.round(quantity * 1000).cast("bigint")).alias("duration_ms"),
        F.when(F.col("l_linenumber") != 6, F.round(quantity * 900).cast("bigint")).alias("ms_played"),
        F.lit("spotify").alias("source"),
        country.alias("country"),
        region.alias("region"),
        city.alias("city"),
        (F.col("l_returnflag") == "R").alias("is_duplicate"),
    )


ORDER_PLAYS = """
plays AS (
  SELECT l_orderkey * 8 + l_linenumber AS play_id, l_partkey AS track_id, nullif(l_suppkey, 0) AS album_id,
         nullif(o_custkey, 0) AS artist_id, o_orderdate AS ts, CAST(o_orderdate AS DATE) AS d,
         strftime(o_orderdate, '%Y-%m') AS ym,
         coalesce(CASE WHEN l_linenumber <> 7 THEN CAST(round(l_quantity * 1000) AS BIGINT) END,
                  CASE WHEN l_linenumber <> 6 THEN CAST(round(l_quantity * 900) AS BIGINT) END, 0) AS ms,
         nullif(r_name, 'EUROPE') AS country, nullif(n_name, 'NATION_7') AS region,
         nullif(c_mktsegment, 'BUILDING') AS city, l_returnflag = 'R' AS is_duplicate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
clean AS (SELECT * FROM plays WHERE NOT is_duplicate)"""


# --- plays from events: one month with times of day, several sources ----------------------

SOURCES = {"view": "spotify", "purchase": "apple_music", "click": "lastfm", "signup": "manual", "error": "other"}


def event_plays(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    source = F.coalesce(*[F.when(F.col("event_type") == kind, name) for kind, name in SOURCES.items()])
    ms = F.round(F.col("value") * 1000).cast("bigint")
    return events.select(
        F.col("event_id").alias("play_id"),
        k.alias("track_id"),
        F.nullif(k % 7, F.lit(0)).cast("bigint").alias("album_id"),
        (k % 20).alias("artist_id"),
        F.col("ts"),
        F.when(F.col("event_id") % 10 != 0, ms).alias("duration_ms"),
        ms.alias("ms_played"),
        source.alias("source"),
        F.lit(None).cast("string").alias("country"),
        F.lit(None).cast("string").alias("region"),
        F.lit(None).cast("string").alias("city"),
        F.lit(False).alias("is_duplicate"),
    )


EVENT_PLAYS = """
plays AS (
  SELECT event_id AS play_id, k AS track_id, nullif(k % 7, 0) AS album_id, k % 20 AS artist_id, ts,
         CAST(ts AS DATE) AS d,
         CASE WHEN event_id % 10 <> 0 THEN ms END AS duration_ms, ms AS ms_played, ms,
         CASE event_type WHEN 'view' THEN 'spotify' WHEN 'purchase' THEN 'apple_music' WHEN 'click' THEN 'lastfm'
              WHEN 'signup' THEN 'manual' WHEN 'error' THEN 'other' END AS source, FALSE AS is_duplicate
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
               CAST(round(value * 1000) AS BIGINT) AS ms FROM events)),
clean AS (SELECT * FROM plays WHERE NOT is_duplicate)"""


# --- dimensions --------------------------------------------------------------------------


def artists(spark: SparkSession, folder: str) -> DataFrame:
    customer, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.lower("c_name").alias("sort_name"),
        F.col("n_name").alias("country"),
        F.col("c_mktsegment").alias("artist_type"),
    )


def albums(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("title"),
        F.nullif("s_nationkey", F.lit(3)).cast("bigint").alias("artist_id"),
        F.lit("Album").alias("album_type"),
        (F.lit(1980) + F.col("s_nationkey")).cast("int").alias("release_year"),
    )


def tracks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("title"),
        F.col("p_partkey").alias("artist_id"),
        F.nullif("p_size", F.lit(9)).cast("bigint").alias("album_id"),
        F.round(F.col("p_retailprice") * 100).cast("bigint").alias("duration_ms"),
    )


def artist_genres(spark: SparkSession, folder: str) -> DataFrame:
    """Two genres per artist where a part with the same key exists, one otherwise."""
    customer, part = table(spark, folder, "customer"), table(spark, folder, "part")
    first = customer.select(F.col("c_custkey").alias("artist_id"), F.col("c_mktsegment").alias("genre"),
                            F.lit(0.9).alias("confidence"))
    second = part.join(customer, F.col("p_partkey") == F.col("c_custkey"), "left_semi").select(
        F.col("p_partkey").alias("artist_id"), F.col("p_type").alias("genre"), F.lit(0.5).alias("confidence")
    )
    return first.unionByName(second)


DIMENSIONS = """
artists AS (SELECT c_custkey AS id, c_name AS name, lower(c_name) AS sort_name, n_name AS country,
                   c_mktsegment AS artist_type FROM customer JOIN nation ON c_nationkey = n_nationkey),
albums AS (SELECT s_suppkey AS id, s_name AS title, CAST(nullif(s_nationkey, 3) AS BIGINT) AS artist_id,
                  'Album' AS album_type, CAST(1980 + s_nationkey AS INTEGER) AS release_year FROM supplier),
tracks AS (SELECT p_partkey AS id, p_name AS title, p_partkey AS artist_id,
                  CAST(nullif(p_size, 9) AS BIGINT) AS album_id,
                  CAST(round(p_retailprice * 100) AS BIGINT) AS duration_ms FROM part),
artist_genres AS (SELECT c_custkey AS artist_id, c_mktsegment AS genre, 0.9::DOUBLE AS confidence FROM customer
                  UNION ALL
                  SELECT p_partkey, p_type, 0.5::DOUBLE FROM part
                  WHERE p_partkey IN (SELECT c_custkey FROM customer))"""


# --- raw plays with messy names, from two sources ------------------------------------------
# Names come from parts; the row key picks one of several ways in which real exports spell the same name.

ARTIST_VARIANTS = """CASE {key} % 8 WHEN 0 THEN {name} WHEN 1 THEN upper({name}) WHEN 2 THEN concat('the ', {name})
    WHEN 3 THEN concat({name}, ' & ', {other}) WHEN 4 THEN concat('  ', replace({name}, ' ', '   '), ' ')
    WHEN 5 THEN replace({name}, 'e', 'é') WHEN 6 THEN replace({name}, 'l', 'll')
    ELSE concat({name}, ' Featuring ', {other}) END"""
ALBUM_VARIANTS = """CASE {key} % 5 WHEN 0 THEN {name} WHEN 1 THEN concat({name}, ' (Deluxe Edition)')
    WHEN 2 THEN concat({name}, ' [UK Import]') WHEN 3 THEN NULL ELSE concat({name}, ' - Single') END"""
TRACK_VARIANTS = """CASE {key} % 7 WHEN 0 THEN {name} WHEN 1 THEN concat({name}, ' (feat. ', {other}, ')')
    WHEN 2 THEN concat({name}, ' (Radio Edit)') WHEN 3 THEN concat({name}, ' (Live at Venue)')
    WHEN 4 THEN concat({name}, ' - 2011 Remastered') WHEN 5 THEN upper({name})
    ELSE concat({name}, ' (with ', {other}, ' x ', {name}, ') [Bonus]') END"""


def _names(key: str) -> str:
    artist = ARTIST_VARIANTS.format(key=key, name="p_name", other="p_type")
    album = ALBUM_VARIANTS.format(key=key, name="concat(p_type, ' ', p_brand)")
    track = TRACK_VARIANTS.format(key=key, name="concat(lower(p_type), ' song')", other="p_brand")
    return (
        f"CASE WHEN {key} % 97 <> 0 THEN {artist} END AS artist_name, {album} AS album_name, "
        f"CASE WHEN {key} % 89 <> 0 THEN {track} END AS track_name"
    )


HISTORY_SQL = f"""SELECT 'spotify' AS source, o_orderkey AS record_id, o_orderdate AS ts, {_names("o_orderkey")},
    CAST(round(o_totalprice) AS BIGINT) AS duration_ms, o_orderstatus AS country
    FROM orders JOIN part ON p_partkey = o_custkey"""
SCROBBLES_SQL = f"""SELECT 'lastfm' AS source, event_id AS record_id, ts, {_names("event_id")},
    CAST(floor(value) AS BIGINT) * 1000 AS duration_ms, CAST(NULL AS VARCHAR(1)) AS country
    FROM events JOIN part ON p_partkey = user_id"""
RAW_PLAYS = f"""
history AS ({HISTORY_SQL}),
scrobbles AS ({SCROBBLES_SQL}),
raw AS (SELECT * FROM history UNION ALL SELECT * FROM scrobbles)"""


def _from_sql(spark: SparkSession, folder: str, sql: str, names: list[str]) -> DataFrame:
    return spark.sql(
        sql.replace("VARCHAR(1)", "STRING").replace("FROM orders", "FROM {orders}")
        .replace("FROM events", "FROM {events}").replace("JOIN part", "JOIN {part}"),
        **{name: table(spark, folder, name) for name in names},
    )


def raw_history(spark: SparkSession, folder: str) -> DataFrame:
    return _from_sql(spark, folder, HISTORY_SQL, ["orders", "part"])


def raw_scrobbles(spark: SparkSession, folder: str) -> DataFrame:
    return _from_sql(spark, folder, SCROBBLES_SQL, ["events", "part"])


def raw_plays(spark: SparkSession, folder: str) -> DataFrame:
    return raw_history(spark, folder).unionByName(raw_scrobbles(spark, folder))
