"""Registered streaming queries: the streams read the test tables as files and run until the backlog is done."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklore.catalog import names
from tracklore.catalog import tables as t
from tracklore.catalog.ingest import FIRST, HISTORY, _payloads
from tracklore.catalog.metrics import (
    ALBUM_BASIC, ARTIST_ANALYTICS, CONTEXT, DAILY, GEO, HOURLY, MONTHLY_SUMMARY, SLEEPERS, TRACK_BASIC, TRACK_YEARLY, WEEKDAY,
    WITH_ORDERS,
)
from tracklore.catalog.registry import query
from tracklore.operators import ingest, linkage
from tracklore.plans import refresh
from tracklore.session import scratch_path
from tracklore.sources import history
from tracklore.streaming import streams as s

EVENTS_DDL = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _events(spark, d):
    t.table(spark, d, "events")
    return s.file_stream(spark, d, EVENTS_DDL, "events.parquet")


def _paths(spark, name):
    return scratch_path(spark, name), scratch_path(spark, f"{name}-log")


@query("stream_ingest", f"WITH {HISTORY},{FIRST} SELECT raw_hash FROM firsts")
def _(spark, d):
    """Two runs over growing input: the second finds the files of the first again and adds only what is new."""
    landing, log = _paths(spark, "landing")
    store = scratch_path(spark, "store")
    rows = _payloads(spark, d)
    for part in ("source_file <> 'again.json'", "source_file = 'again.json'"):
        rows.where(part).write.mode("append").json(landing)
        stream = s.file_stream(spark, landing, "source_file string, source_row bigint, payload string", "*.json", "json")
        classified = ingest.classify_history(history.parse_history(stream)).where("row_status = 'ok'")
        s.stream_ingest(classified.select("source_file", "source_row", "raw_hash"), store, log)
    return spark.read.parquet(store).select("raw_hash")


@query("stream_hourly_counts", "SELECT epoch(date_trunc('hour', ts))::BIGINT AS hour_start, count(*) AS plays FROM events GROUP BY 1")
def _(spark, d):
    sink, log = _paths(spark, "hourly")
    s.stream_hourly_counts(_events(spark, d), sink, log)
    counts = s.latest_counts(spark, sink)
    return counts.select(F.unix_seconds("hour_start").alias("hour_start"), "plays")


@query(
    "stream_sessions",
    """WITH g AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 3600000000 THEN 1 ELSE 0 END
      AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    n AS (SELECT user_id, us, sum(b) OVER (PARTITION BY user_id ORDER BY us) AS sid FROM g),
    sess AS (SELECT user_id, min(us) AS start_us, max(us) + 3600000000 AS end_us, count(*) AS plays FROM n GROUP BY user_id, sid)
    SELECT user_id, start_us, end_us, plays FROM sess WHERE end_us // 1000 <= (SELECT max(epoch_us(ts)) // 1000 - 3600000 FROM events)""",
)
def _(spark, d):
    sink, log = _paths(spark, "sessions")
    s.stream_sessions(_events(spark, d).select("user_id", "ts"), ["user_id"], sink, log)
    done = spark.read.parquet(sink)
    return done.select(
        "user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "plays"
    )


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type, props FROM events")
def _(spark, d):
    """Keys that repeat only within the widest possible lateness, so each is kept once."""
    sink, log = _paths(spark, "deduped")
    keys = ["user_id", "event_type", "props"]
    s.stream_dedupe(_events(spark, d).select("ts", *keys), keys, sink, log, late="60 days")
    return spark.read.parquet(sink).select(*keys)


SPLIT = "timestamp_ntz '2001-01-15 00:00:00'"


def _refreshed(spark, d, table):
    """Two batches, the later one first; they meet within a month."""
    store = scratch_path(spark, "store")
    plays = t.order_plays(spark, d, places=table == "geographic_analytics")
    for batch, rows in (("late", f"ts >= {SPLIT}"), ("early", f"ts < {SPLIT}")):
        refresh.incremental_refresh(plays.where(rows), store, batch, [table], buckets=8)
    return refresh.read_table(spark, store, table, t.tracks(spark, d))


@query("incremental_refresh", f"{WITH_ORDERS},{MONTHLY_SUMMARY} SELECT * FROM monthly_summary")
def _(spark, d):
    return _refreshed(spark, d, "monthly_summary")


@query("incremental_refresh_artists", f"{WITH_ORDERS},{ARTIST_ANALYTICS} SELECT * FROM artist_analytics")
def _(spark, d):
    return _refreshed(spark, d, "artist_analytics")


@query(
    "incremental_refresh_tracks",
    f"""{WITH_ORDERS},{TRACK_YEARLY},{SLEEPERS},{TRACK_BASIC}
    SELECT * FROM track_basic LEFT JOIN sleepers USING (track_id)""",
)
def _(spark, d):
    return _refreshed(spark, d, "track_analytics")


HOUR_SESSIONS = f"""
hs AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY album_id ORDER BY ts) > 3600000000
                      THEN 1 ELSE 0 END AS b FROM clean WHERE album_id IS NOT NULL),
hn AS (SELECT album_id, track_id, sum(b) OVER (PARTITION BY album_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM hs),
hd AS (SELECT album_id, sid, count(DISTINCT coalesce(track_id, -1)) AS n FROM hn GROUP BY ALL),
sizes AS (SELECT album_id, count(*) AS tracks FROM dim_tracks WHERE album_id IS NOT NULL GROUP BY 1),
complete AS (SELECT album_id, count(*) AS c FROM hd JOIN sizes USING (album_id) WHERE 5 * n >= 4 * tracks GROUP BY 1),
rates AS (SELECT album_id, CASE WHEN coalesce(tracks, 0) < 3 OR total_plays < tracks THEN 0.0::DOUBLE
    ELSE round(coalesce(c, 0)::DOUBLE / greatest(total_plays // tracks, 1), 3) END AS completion_rate
    FROM album_basic LEFT JOIN sizes USING (album_id) LEFT JOIN complete USING (album_id))"""


@query(
    "incremental_refresh_albums",
    f"""{WITH_ORDERS},{ALBUM_BASIC},dim_tracks AS (WITH {t.DIMENSIONS} SELECT * FROM tracks),{HOUR_SESSIONS}
    SELECT * FROM album_basic LEFT JOIN rates USING (album_id)""",
)
def _(spark, d):
    """Sessions with the usual pause of one hour."""
    return _refreshed(spark, d, "album_analytics")


@query("incremental_refresh_hours", f"{WITH_ORDERS},{HOURLY} SELECT * FROM hourly")
def _(spark, d):
    return _refreshed(spark, d, "hourly_distribution")


@query("incremental_refresh_weekdays", f"{WITH_ORDERS},{WEEKDAY} SELECT * FROM weekday")
def _(spark, d):
    return _refreshed(spark, d, "weekday_distribution")


@query("incremental_refresh_context", f"{WITH_ORDERS},{DAILY},{CONTEXT} SELECT * FROM context")
def _(spark, d):
    return _refreshed(spark, d, "discovery_context")


@query("incremental_refresh_places", f"{WITH_ORDERS},{GEO} SELECT * FROM geo")
def _(spark, d):
    return _refreshed(spark, d, "geographic_analytics")


# Plays that came through resolution with fuzzy names and linking, and their clusters: ids are (source, record_id).
LINKED_PLAYS = f"""{names.RESOLVED},{names.LINKED},
lp AS MATERIALIZED (SELECT source || ':' || record_id AS play_id, source, artist_slug, track_slug, album_slug, epoch_us(ts) AS us, ts,
         nullif(duration_ms, 0) AS dur, duration_ms FROM linked),
near AS (SELECT a.play_id AS a_id, b.play_id AS b_id, b.us - a.us AS diff, coalesce(a.album_slug = b.album_slug, FALSE) AS same_album,
                coalesce(abs(a.dur - b.dur) <= greatest(a.dur, b.dur) * 0.1::DOUBLE, FALSE) AS same_dur
         FROM lp a JOIN lp b ON a.track_slug = b.track_slug AND a.artist_slug = b.artist_slug AND a.source <> b.source
              AND (a.us < b.us OR (a.us = b.us AND a.play_id < b.play_id)) AND b.us - a.us <= 120000000),
merges AS MATERIALIZED (SELECT a_id, b_id FROM near WHERE CASE WHEN diff = 0 THEN 50 WHEN diff <= 30000000 THEN 40 WHEN diff <= 60000000 THEN 30
    ELSE 20 END + 30 + CASE WHEN same_album THEN 10 ELSE 0 END + CASE WHEN same_dur THEN 10 ELSE 0 END >= 70),
links AS (SELECT a_id AS x, b_id AS y FROM merges UNION ALL SELECT b_id, a_id FROM merges),
reach AS (SELECT DISTINCT x, x AS y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
clusters AS (SELECT x, min(y) AS cluster FROM reach GROUP BY x),
ranked AS (SELECT cluster, source, row_number() OVER (PARTITION BY cluster ORDER BY CASE source WHEN 'spotify' THEN 4
      WHEN 'apple_music' THEN 3 WHEN 'lastfm' THEN 2 WHEN 'manual' THEN 1 ELSE 0 END DESC, dur IS NULL, us) AS place
   FROM clusters JOIN lp ON x = play_id)"""


@query(
    "full_refresh",
    f"""WITH RECURSIVE {LINKED_PLAYS},
    kept AS (SELECT strftime(lp.ts, '%Y-%m') AS ym, coalesce(duration_ms, 0) AS ms, artist_slug, track_slug, album_slug
      FROM lp LEFT JOIN (SELECT x, row_number() OVER (PARTITION BY cluster ORDER BY CASE source WHEN 'spotify' THEN 4
      WHEN 'apple_music' THEN 3 WHEN 'lastfm' THEN 2 WHEN 'manual' THEN 1 ELSE 0 END DESC, dur IS NULL, us) AS place
      FROM clusters JOIN lp ON x = play_id) c ON c.x = lp.play_id WHERE coalesce(place, 1) = 1),
    firsts AS (SELECT ym, count(*) AS n FROM (SELECT artist_slug, min(ym) AS ym FROM kept GROUP BY 1) GROUP BY 1),
    tops AS (SELECT ym, max(n) AS n FROM (SELECT ym, artist_slug, count(*) AS n FROM kept GROUP BY 1, 2) GROUP BY 1)
    SELECT k.ym AS year_month, count(*) AS total_plays, CAST(sum(ms) AS BIGINT) AS total_duration_ms,
      count(DISTINCT artist_slug) AS unique_artists, count(DISTINCT (artist_slug, album_slug)) FILTER (album_slug IS NOT NULL) AS unique_albums,
      count(DISTINCT (artist_slug, track_slug)) AS unique_tracks, coalesce(any_value(firsts.n), 0) AS new_artists_discovered,
      any_value(tops.n) AS top_artist_plays, round(count(DISTINCT artist_slug)::DOUBLE / count(*), 4) AS fragmentation_score
    FROM kept k LEFT JOIN firsts USING (ym) LEFT JOIN tops USING (ym) GROUP BY k.ym""",
)
def _(spark, d):
    """Raw plays of both sources to the monthly summary: resolve, link, mark duplicates, aggregate. The top artist, an id
    that SQL lacks, is left out; its plays are there."""
    built = refresh.resolve_and_link(t.raw_plays(spark, d))
    tables = refresh.analytics_tables(built["plays"], built["tracks"].withColumnRenamed("track_id", "id"))
    return tables["monthly_summary"].drop("top_artist_id")


@query(
    "dedupe_linked_plays",
    f"""WITH RECURSIVE {LINKED_PLAYS},
    sizes AS (SELECT cluster, count(*) - 1 AS merged, any_value(source) FILTER (place = 1) AS source FROM ranked GROUP BY cluster)
    SELECT source, CAST(sum(merged) AS BIGINT) AS merged FROM sizes GROUP BY source UNION ALL SELECT 'all', count(*) FROM lp""",
)
def _(spark, d):
    """Merged plays by the source of the winner, for plays that came through resolution and linking."""
    plays = refresh.resolve_and_link(t.raw_plays(spark, d))["plays"]
    return linkage.merge_winners(plays).unionByName(
        plays.groupBy(F.lit("all").alias("source")).agg(F.count("*").alias("merged"))
    )
