"""Registered reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklore.catalog import metrics as mx
from tracklore.catalog import tables as t
from tracklore.catalog.registry import query
from tracklore.operators import metrics as m
from tracklore.operators import skew
from tracklore.operators.enrich import artist_top_genres
from tracklore.plans import reports as r
from tracklore.plans import sinks
from tracklore.session import scratch_path

WITH = mx.WITH_ORDERS + "," + t.DIMENSIONS
SUMMARY = f"{WITH},{mx.MONTHLY_SUMMARY}"
TOTALS = f"{WITH},{mx.ARTIST_BASIC}"
TIMELINE = f"""{SUMMARY},
timeline AS (SELECT s.*, a.name AS top_artist_name, round(total_duration_ms / 3600000.0::DOUBLE, 1) AS duration_hours
             FROM monthly_summary s LEFT JOIN artists a ON a.id = top_artist_id)"""


def _summary(spark, d):
    return m.monthly_summary(t.order_plays(spark, d))


def _totals(spark, d):
    return m.entity_basic(t.order_plays(spark, d), "artist_id")


def _timeline(spark, d):
    return r.report_timeline(_summary(spark, d), t.artists(spark, d))


# --- overview and time -------------------------------------------------------------------

TOP = "(SELECT {col} FROM {table} JOIN {dim} ON id = {key} ORDER BY total_plays DESC, {key} LIMIT 1)"


def _top(kind: str, label: str) -> str:
    columns = {"id": "id", "label": label, "plays": "total_plays"}
    return ", ".join(
        TOP.format(col=column, table=f"{kind}_basic", dim=f"{kind}s", key=f"{kind}_id") + f" AS top_{kind}_{name}"
        for name, column in columns.items()
    )


@query(
    "report_overview",
    f"""{TOTALS},{mx.ALBUM_BASIC},{mx.TRACK_BASIC} SELECT CAST(sum(total_plays) AS BIGINT) AS total_plays,
    CAST(sum(total_duration_ms) AS BIGINT) AS total_duration_ms, min(first_play_date) AS first_play,
    max(last_play_date) AS last_play, round(sum(total_duration_ms) / 3600000.0::DOUBLE, 1) AS total_hours,
    (SELECT count(*) FROM artists) AS total_artists, (SELECT count(*) FROM albums) AS total_albums,
    (SELECT count(*) FROM tracks) AS total_tracks, {_top('artist', 'name')}, {_top('album', 'title')}, {_top('track', 'title')}
    FROM artist_basic""",
)
def _(spark, d):
    plays = t.order_plays(spark, d)
    return r.report_overview(
        m.entity_basic(plays, "artist_id"), m.album_basic(plays), m.track_basic(plays),
        t.artists(spark, d), t.albums(spark, d), t.tracks(spark, d),
    )


def _top_sql(kind: str, label: str, artist: str, join: str = "") -> str:
    return f"""SELECT b.{kind}_id AS id, x.{label} AS label, {artist} AS artist_name, b.total_plays AS plays
    FROM {kind}_basic b JOIN {kind}s x ON x.id = b.{kind}_id {join} ORDER BY b.total_plays DESC, b.{kind}_id LIMIT 1"""


OWNER = "LEFT JOIN artists a ON a.id = x.artist_id"


@query(
    "top_entity",
    f"""{TOTALS},{mx.ALBUM_BASIC},{mx.TRACK_BASIC} SELECT 'artist' AS kind, * FROM ({_top_sql('artist', 'name', 'x.name')})
    UNION ALL SELECT 'album', * FROM ({_top_sql('album', 'title', 'a.name', OWNER)})
    UNION ALL SELECT 'track', * FROM ({_top_sql('track', 'title', 'a.name', OWNER)})""",
)
def _(spark, d):
    plays, artists = t.order_plays(spark, d), t.artists(spark, d)
    found = {
        "artist": r.top_entity(m.entity_basic(plays, "artist_id"), artists, "artist_id"),
        "album": r.top_entity(m.album_basic(plays), t.albums(spark, d), "album_id", artists),
        "track": r.top_entity(m.track_basic(plays), t.tracks(spark, d), "track_id", artists),
    }
    rows = [df.select(F.lit(kind).alias("kind"), "*") for kind, df in found.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("report_timeline", f"{TIMELINE} SELECT * FROM timeline")
def _(spark, d):
    return _timeline(spark, d)


@query(
    "timeline_artists",
    f"{WITH},{mx.MONTHLY} SELECT m.*, a.name AS artist_name FROM monthly m JOIN artists a ON a.id = m.artist_id",
)
def _(spark, d):
    return r.timeline_artists(m.artist_monthly(t.order_plays(spark, d)), t.artists(spark, d))


@query(
    "timeline_top_artists",
    f"""{WITH},{mx.MONTHLY}, ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY year_month ORDER BY plays DESC, artist_id)
    AS INTEGER) AS place FROM monthly) SELECT r.*, a.name AS artist_name FROM ranked r JOIN artists a ON a.id = r.artist_id
    WHERE place <= 20""",
)
def _(spark, d):
    return r.timeline_artists(m.artist_monthly(t.order_plays(spark, d)), t.artists(spark, d), 20)


@query(
    "report_temporal",
    f"""{mx.WITH_EVENTS},{mx.HOURLY},{mx.WEEKDAY} SELECT
    (SELECT hour FROM hourly ORDER BY total_plays DESC, hour LIMIT 1) AS peak_hour,
    (SELECT round(sum(total_plays) FILTER (hour >= 22 OR hour < 4)::DOUBLE / sum(total_plays), 3) FROM hourly) AS night_owl_score,
    (SELECT weekday FROM weekday ORDER BY total_plays DESC, weekday LIMIT 1) AS peak_day,
    (SELECT round(sum(total_plays) FILTER (weekday IN (0, 6))::DOUBLE / sum(total_plays), 3) FROM weekday)
      AS weekend_warrior_score""",
)
def _(spark, d):
    plays = t.event_plays(spark, d)
    return r.report_temporal(m.hourly_distribution(plays), m.weekday_distribution(plays))


# --- genres ------------------------------------------------------------------------------


@query(
    "report_genres",
    f"""{TOTALS}, j AS (SELECT genre, g.artist_id, total_plays, total_duration_ms FROM artist_genres g
      JOIN artist_basic b ON b.artist_id = g.artist_id)
    SELECT genre, count(DISTINCT artist_id) AS artist_count, CAST(sum(total_plays) AS BIGINT) AS plays,
    CAST(sum(total_duration_ms) AS BIGINT) AS duration_ms,
    round(sum(total_plays)::DOUBLE / (SELECT sum(total_plays) FROM j), 4) AS percentage FROM j GROUP BY 1""",
)
def _(spark, d):
    return r.report_genres(t.artist_genres(spark, d), _totals(spark, d))


@query(
    "genre_top_artists",
    f"""{TOTALS}, j AS (SELECT genre, g.artist_id, total_plays, CAST(row_number() OVER (PARTITION BY genre
      ORDER BY total_plays DESC, g.artist_id) AS INTEGER) AS rank FROM artist_genres g JOIN artist_basic b ON b.artist_id = g.artist_id)
    SELECT genre, rank, artist_id, name, total_plays AS plays FROM j JOIN artists ON id = artist_id WHERE rank <= 5""",
)
def _(spark, d):
    return r.genre_top_artists(t.artist_genres(spark, d), _totals(spark, d), t.artists(spark, d))


@query(
    "artist_top_genres",
    f"""WITH {t.DIMENSIONS} SELECT * FROM (SELECT artist_id, genre, confidence, CAST(row_number() OVER (
      PARTITION BY artist_id ORDER BY confidence DESC, genre) AS INTEGER) AS rank FROM artist_genres) WHERE rank <= 5""",
)
def _(spark, d):
    return artist_top_genres(t.artist_genres(spark, d))


# --- discoveries -------------------------------------------------------------------------

FIRSTS = f"""{TOTALS},
months AS (SELECT strftime(first_play_date, '%Y-%m') AS year_month, count(*) AS count FROM artist_basic GROUP BY 1)"""


@query(
    "report_discoveries",
    f"""{FIRSTS} SELECT CAST(sum(count) AS BIGINT) AS total_discoveries, count(DISTINCT year_month[:4]) AS years_active,
    round(sum(count)::DOUBLE / count(DISTINCT year_month[:4]), 1) AS avg_per_year,
    (SELECT year_month FROM months ORDER BY count DESC, year_month LIMIT 1) AS peak_month,
    (SELECT max(count) FROM months) AS peak_month_count FROM months""",
)
def _(spark, d):
    return r.discovery_totals(_totals(spark, d))


@query("discoveries_by_month", f"{FIRSTS} SELECT * FROM months")
def _(spark, d):
    return r.discoveries_by_month(_totals(spark, d))


@query(
    "discoveries_by_year",
    f"{TOTALS} SELECT CAST(year(first_play_date) AS INTEGER) AS year, count(*) AS count FROM artist_basic GROUP BY 1",
)
def _(spark, d):
    return r.discoveries_by_year(_totals(spark, d))


@query(
    "report_discoveries_detailed",
    f"""{TOTALS}, y AS (SELECT CAST(year(first_play_date) AS INTEGER) AS year, artist_id, first_play_date, total_plays,
      CAST(row_number() OVER (PARTITION BY year(first_play_date) ORDER BY total_plays DESC, artist_id) AS INTEGER) AS rank
      FROM artist_basic)
    SELECT year, rank, artist_id, name, first_play_date, total_plays AS plays FROM y JOIN artists ON id = artist_id
    WHERE rank <= 10""",
)
def _(spark, d):
    return r.discoveries_top_of_year(_totals(spark, d), t.artists(spark, d))


@query(
    "recent_discoveries",
    f"""{TOTALS} SELECT artist_id, first_play_date, total_plays AS plays, name FROM artist_basic JOIN artists ON id = artist_id
    WHERE first_play_date >= DATE '1997-03-01' - INTERVAL 24 MONTH""",
)
def _(spark, d):
    return r.recent_discoveries(_totals(spark, d), t.artists(spark, d), F.lit("1997-03-01").cast("date"))


@query(
    "last_50_discoveries",
    f"""{TOTALS} SELECT artist_id, first_play_date, total_plays AS plays, name FROM (
      SELECT * FROM artist_basic ORDER BY first_play_date DESC, artist_id DESC LIMIT 50) JOIN artists ON id = artist_id""",
)
def _(spark, d):
    return r.recent_discoveries(_totals(spark, d), t.artists(spark, d), last=r.RECENT)


GATEWAY = f"""{TOTALS},{mx.DAILY},{mx.CONTEXT},
gate AS (SELECT context_artist_id AS artist_id, count(*) AS discoveries_triggered FROM context WHERE context_type = 'before'
         GROUP BY 1),
gateways AS (SELECT artist_id, discoveries_triggered, total_plays AS plays, name FROM gate JOIN artist_basic USING (artist_id)
             JOIN artists ON id = artist_id)"""


def _gateways(spark, d, top=None):
    plays = t.order_plays(spark, d)
    context = m.discovery_context(m.artist_daily(plays))
    return r.gateway_artists(context, m.entity_basic(plays, "artist_id"), t.artists(spark, d), top)


@query("gateway_artists", f"{GATEWAY} SELECT * FROM gateways")
def _(spark, d):
    return _gateways(spark, d)


@query("gateway_artists_top_20", f"{GATEWAY} SELECT * FROM gateways ORDER BY discoveries_triggered DESC, artist_id LIMIT 20")
def _(spark, d):
    return _gateways(spark, d, r.GATEWAYS)


# --- geography and lists -----------------------------------------------------------------


@query(
    "report_geography",
    f"{mx.WITH_ORDERS},{mx.GEO} SELECT country, region, city, total_plays AS plays, first_play_date, last_play_date FROM geo",
)
def _(spark, d):
    return r.report_geography(m.geographic(t.order_plays(spark, d, places=True)))


@query(
    "report_artist_monthly",
    f"{WITH},{mx.MONTHLY} SELECT m.*, a.name AS artist_name FROM monthly m JOIN artists a ON a.id = m.artist_id",
)
def _(spark, d):
    return r.report_artist_monthly(m.artist_monthly(t.order_plays(spark, d)), t.artists(spark, d))


DETAIL = f"""{TOTALS},{mx.MONTHLY},
yearly AS (SELECT artist_id, CAST(year_month[:4] AS INTEGER) AS year, sum(plays) AS plays FROM monthly GROUP BY 1, 2),
pm AS (SELECT artist_id, year_month AS peak_month FROM (SELECT *, row_number() OVER (PARTITION BY artist_id
         ORDER BY plays DESC, year_month) AS rn FROM monthly) WHERE rn = 1),
py AS (SELECT artist_id, year AS peak_year FROM (SELECT *, row_number() OVER (PARTITION BY artist_id
         ORDER BY plays DESC, year) AS rn FROM yearly) WHERE rn = 1),
detail AS (SELECT b.artist_id, total_plays AS plays, round(total_duration_ms / 3600000.0::DOUBLE, 1) AS duration_hours,
             unique_tracks_played AS unique_tracks, first_play_date, last_play_date, name, country, artist_type AS type,
             peak_month, peak_year
           FROM artist_basic b JOIN artists a ON a.id = b.artist_id LEFT JOIN pm USING (artist_id) LEFT JOIN py USING (artist_id))"""


def _detail(spark, d):
    plays = t.order_plays(spark, d)
    monthly = m.artist_monthly(plays)
    return r.report_artist_detail(m.entity_basic(plays, "artist_id"), monthly, t.artists(spark, d)), monthly


@query("report_artist_detail", f"{DETAIL} SELECT * FROM detail")
def _(spark, d):
    return _detail(spark, d)[0]


@query(
    "report_artist_detail_files",
    f"{DETAIL}, n AS (SELECT artist_id, count(*) AS months FROM monthly GROUP BY 1) "
    "SELECT artist_id, name, plays, months FROM detail JOIN n USING (artist_id)",
)
def _(spark, d):
    """Nested files in folders per artist, read back."""
    detail, monthly = _detail(spark, d)
    path = scratch_path(spark, "artists")
    sinks.write_partitioned_json(r.artist_detail_nested(detail, monthly), path, "artist_id")
    written = "artist_id bigint, name string, plays bigint, monthly_timeline array<struct<year_month: string>>"
    back = sinks.read_partitioned_json(spark, path, "artist_id", written)
    return back.select("artist_id", "name", "plays", F.size("monthly_timeline").cast("bigint").alias("months"))


@query(
    "search_index_artists",
    f"""{TOTALS} SELECT id, name, sort_name, coalesce(total_plays, 0) AS plays FROM artists LEFT JOIN artist_basic
    ON artist_id = id""",
)
def _(spark, d):
    return r.search_index_artists(t.artists(spark, d), _totals(spark, d))


@query(
    "search_index_albums",
    f"""{TOTALS},{mx.ALBUM_BASIC} SELECT x.id, title, a.id AS artist_id, a.name AS artist_name, coalesce(total_plays, 0) AS plays
    FROM albums x LEFT JOIN artists a ON a.id = x.artist_id LEFT JOIN album_basic ON album_id = x.id""",
)
def _(spark, d):
    return r.search_index_albums(t.albums(spark, d), t.artists(spark, d), m.album_basic(t.order_plays(spark, d)))


INDEX_ARTISTS = f"""{TOTALS}, g AS (SELECT artist_id, string_agg(genre, '|' ORDER BY confidence DESC, genre) AS genres
  FROM artist_genres GROUP BY 1),
index_artists AS (SELECT id, name, country, artist_type AS type, total_plays AS plays, total_duration_ms AS duration_ms,
  round(total_duration_ms / 3600000.0::DOUBLE, 1) AS duration_hours, unique_tracks_played AS unique_tracks,
  first_play_date AS first_play, last_play_date AS last_play, coalesce(genres, '') AS genres
  FROM artist_basic b JOIN artists ON id = b.artist_id LEFT JOIN g ON g.artist_id = b.artist_id)"""


def _index_artists(spark, d):
    listed = r.index_artists(_totals(spark, d), t.artists(spark, d), t.artist_genres(spark, d))
    return listed.withColumn("genres", F.array_join("genres", "|"))


@query("index_artists", f"{INDEX_ARTISTS} SELECT * FROM index_artists")
def _(spark, d):
    return _index_artists(spark, d)


@query("list_page", f"{INDEX_ARTISTS} SELECT id, name, plays FROM index_artists ORDER BY plays DESC, id LIMIT 50 OFFSET 100")
def _(spark, d):
    return r.list_page(_index_artists(spark, d), "plays", page=3).select("id", "name", "plays")


@query("list_page_by_name", f"{INDEX_ARTISTS} SELECT id, name, plays FROM index_artists ORDER BY name, id LIMIT 50 OFFSET 50")
def _(spark, d):
    return r.list_page(_index_artists(spark, d), "name", ascending=True, page=2).select("id", "name", "plays")


@query(
    "index_albums",
    f"""{WITH},{mx.ALBUM_BASIC} SELECT x.id, title, release_year, album_type, a.id AS artist_id, a.name AS artist_name,
    total_plays AS plays, total_duration_ms AS duration_ms, round(total_duration_ms / 3600000.0::DOUBLE, 1) AS duration_hours,
    unique_tracks_played AS unique_tracks, first_play_date AS first_play, last_play_date AS last_play
    FROM album_basic JOIN albums x ON x.id = album_id LEFT JOIN artists a ON a.id = x.artist_id""",
)
def _(spark, d):
    plays = t.order_plays(spark, d)
    analytics = m.album_analytics(plays, t.tracks(spark, d))
    return r.index_albums(analytics, t.albums(spark, d), t.artists(spark, d)).drop("completion_rate")


@query(
    "index_tracks",
    f"""{WITH},{mx.TRACK_BASIC} SELECT x.id, x.title, x.duration_ms, a.id AS artist_id, a.name AS artist_name, b.id AS album_id,
    b.title AS album_title, total_plays AS plays, total_duration_ms, round(total_duration_ms / 3600000.0::DOUBLE, 1) AS total_hours,
    first_play_date AS first_play, last_play_date AS last_play
    FROM track_basic JOIN tracks x ON x.id = track_id LEFT JOIN artists a ON a.id = x.artist_id
    LEFT JOIN albums b ON b.id = x.album_id""",
)
def _(spark, d):
    totals = m.track_basic(t.order_plays(spark, d))
    return r.index_tracks(totals, t.tracks(spark, d), t.albums(spark, d), t.artists(spark, d))


@query(
    "artist_rank",
    f"{TOTALS} SELECT artist_id, total_plays, row_number() OVER (ORDER BY total_plays DESC, artist_id) AS rank FROM artist_basic",
)
def _(spark, d):
    return skew.global_rank(_totals(spark, d).select("artist_id", "total_plays"), "total_plays", "artist_id")


# --- years -------------------------------------------------------------------------------

LED = f"""{TIMELINE},
led AS (SELECT CAST(year_month[:4] AS INTEGER) AS year, top_artist_id, any_value(top_artist_name) AS top_artist_name,
               CAST(sum(top_artist_plays) AS BIGINT) AS top_artist_plays FROM timeline GROUP BY 1, 2),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY top_artist_plays DESC, top_artist_id) AS rn FROM led)
         WHERE rn = 1)"""


STORY = f"""{LED},{mx.TRACK_BASIC},
seen AS (SELECT track_id, total_plays, CAST(year(first_play_date) AS INTEGER) AS year FROM track_basic
         UNION SELECT track_id, total_plays, CAST(year(last_play_date) AS INTEGER) FROM track_basic),
toptrack AS (SELECT year, track_id, total_plays, title FROM (SELECT *, row_number() OVER (PARTITION BY year
               ORDER BY total_plays DESC, track_id) AS rn FROM seen) JOIN tracks ON id = track_id WHERE rn = 1),
years AS (SELECT CAST(year_month[:4] AS INTEGER) AS year, CAST(sum(total_plays) AS BIGINT) AS plays,
            sum(total_duration_ms) AS ms, CAST(sum(new_artists_discovered) AS BIGINT) AS discoveries FROM timeline GROUP BY 1),
story AS (SELECT year, plays, CAST(round(ms / 3600000.0::DOUBLE) AS BIGINT) AS hours,
            CAST(round(ms / 3600000.0::DOUBLE / 24) AS BIGINT) AS days, discoveries, top_artist_id, top_artist_name,
            top_artist_plays, track_id AS top_track_id, title AS top_track_title, total_plays AS top_track_plays
          FROM years LEFT JOIN best USING (year) LEFT JOIN toptrack USING (year))"""


def _story(spark, d):
    totals = m.track_basic(t.order_plays(spark, d))
    return r.report_story(_summary(spark, d), totals, t.artists(spark, d), t.tracks(spark, d))


@query("report_story", f"{STORY} SELECT * FROM story")
def _(spark, d):
    return _story(spark, d)


@query(
    "story_slides",
    f"""{STORY} SELECT year, CAST(0 AS INTEGER) AS place, 'intro' AS slide, 'intro' AS kind, concat('Your ', year, ' in Music') AS title,
      'Let''s look back at the year' AS detail FROM story
    UNION ALL SELECT year, 1, 'total-plays', 'stat', CAST(plays AS VARCHAR), 'songs played' FROM story
    UNION ALL SELECT year, 2, 'listening-time', 'stat', CAST(hours AS VARCHAR), concat('That''s ', days, ' days of non-stop listening')
      FROM story
    UNION ALL SELECT year, 3, 'top-artist', 'artist', 'Your #1 Artist', top_artist_name FROM story
    UNION ALL SELECT year, 4, 'discoveries', 'stat', CAST(discoveries AS VARCHAR), 'new artists discovered' FROM story
    UNION ALL SELECT year, 5, 'top-track', 'track', 'Your Top Track', top_track_title FROM story WHERE top_track_id IS NOT NULL
    UNION ALL SELECT year, CASE WHEN top_track_id IS NULL THEN 5 ELSE 6 END, 'outro', 'outro', concat('That was your ', year),
      'Here''s to more music ahead' FROM story""",
)
def _(spark, d):
    return r.story_slides(_story(spark, d))


@query(
    "year_rollup_timeline",
    f"""{LED}, y AS (SELECT CAST(year_month[:4] AS INTEGER) AS year, CAST(sum(total_plays) AS BIGINT) AS plays,
      round(sum(duration_hours), 1) AS hours, CAST(sum(new_artists_discovered) AS BIGINT) AS discoveries,
      max(unique_artists) AS unique_artists FROM timeline GROUP BY 1)
    SELECT y.*, top_artist_id, top_artist_plays FROM y LEFT JOIN best USING (year)""",
)
def _(spark, d):
    return r.year_rollup_timeline(_summary(spark, d))


@query(
    "year_rollup_story",
    f"""{LED}, y AS (SELECT CAST(year_month[:4] AS INTEGER) AS year, CAST(sum(total_plays) AS BIGINT) AS plays,
      CAST(round(sum(duration_hours)) AS BIGINT) AS hours, CAST(sum(new_artists_discovered) AS BIGINT) AS discoveries,
      count(DISTINCT top_artist_name) AS unique_artists FROM timeline GROUP BY 1),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY top_artist_plays DESC, top_artist_name) AS r2
          FROM led WHERE top_artist_name IS NOT NULL) WHERE r2 = 1)
    SELECT y.*, top_artist_name, top_artist_plays FROM y LEFT JOIN b USING (year)""",
)
def _(spark, d):
    return r.year_rollup_story(_timeline(spark, d))


YEARS = f"""{SUMMARY}, y AS (SELECT CAST(year_month[:4] AS INTEGER) AS year, CAST(sum(total_plays) AS BIGINT) AS plays
  FROM monthly_summary GROUP BY 1)"""
MONTH_PEAK = """(SELECT year_month FROM monthly_summary ORDER BY total_plays DESC, year_month LIMIT 1) AS peak_month,
    (SELECT max(total_plays) FROM monthly_summary) AS peak_month_plays"""
YEAR_PEAK = "(SELECT year FROM y ORDER BY plays DESC, year LIMIT 1) AS peak_year, (SELECT max(plays) FROM y) AS peak_year_plays"
ACTIVE = "(SELECT max(year) - min(year) FROM y) AS years_active"


@query("busiest_year", f"{YEARS} SELECT {MONTH_PEAK}, {ACTIVE}, {YEAR_PEAK}")
def _(spark, d):
    return r.busiest(_summary(spark, d))


@query("peak_month", f"{YEARS} SELECT {MONTH_PEAK}")
def _(spark, d):
    return r.busiest(_summary(spark, d)).select("peak_month", "peak_month_plays")


@query("peak_year", f"{YEARS} SELECT {YEAR_PEAK}")
def _(spark, d):
    return r.busiest(_summary(spark, d)).select("peak_year", "peak_year_plays")


@query("years_active", f"{YEARS} SELECT {ACTIVE}")
def _(spark, d):
    return r.busiest(_summary(spark, d)).select("years_active")


@query(
    "year_calendar_fill",
    f"""{SUMMARY} SELECT year, CAST(month AS INTEGER) AS month, format('{{:04d}}-{{:02d}}', year, month) AS year_month,
    coalesce(total_plays, 0) AS plays FROM (SELECT DISTINCT CAST(year_month[:4] AS INTEGER) AS year FROM monthly_summary) y
    CROSS JOIN range(1, 13) AS r(month) LEFT JOIN monthly_summary s ON s.year_month = format('{{:04d}}-{{:02d}}', year, month)""",
)
def _(spark, d):
    return r.year_calendar_fill(_summary(spark, d))


@query(
    "month_ratios",
    f"""{TIMELINE} SELECT year_month, CAST(round(total_plays / 30.0::DOUBLE) AS BIGINT) AS plays_per_day,
    CASE WHEN duration_hours > 0 THEN CAST(round(total_plays / duration_hours) AS BIGINT) ELSE 0 END AS plays_per_hour,
    CAST(round(unique_tracks::DOUBLE / total_plays * 100) AS BIGINT) AS unique_track_pct,
    CAST(round(duration_hours * 60 / total_plays) AS BIGINT) AS minutes_per_play,
    round(total_plays::DOUBLE / unique_tracks, 1) AS plays_per_track,
    CAST(round(top_artist_plays::DOUBLE / total_plays * 100) AS BIGINT) AS top_artist_pct FROM timeline""",
)
def _(spark, d):
    return r.month_ratios(_timeline(spark, d))


@query(
    "artist_ratios",
    f"""{TOTALS}, y AS (SELECT *, CAST(year(last_play_date) - year(first_play_date) AS INTEGER) AS n FROM artist_basic)
    SELECT artist_id, n AS years_listening, CAST(round(total_plays::DOUBLE / greatest(n, 1)) AS BIGINT) AS plays_per_year,
    CAST(round(round(total_duration_ms / 3600000.0::DOUBLE, 1) / greatest(n, 1)) AS BIGINT) AS hours_per_year,
    CAST(round(total_plays::DOUBLE / nullif(unique_tracks_played, 0)) AS BIGINT) AS plays_per_track FROM y""",
)
def _(spark, d):
    return r.artist_ratios(_totals(spark, d))


# --- exports -----------------------------------------------------------------------------


@query(
    "export_summary_json",
    f"""{mx.WITH_ORDERS},{mx.WEEKDAY},{mx.MONTHLY_SUMMARY} SELECT 'monthly' AS file, count(*) AS rows FROM monthly_summary
    UNION ALL SELECT 'weekday', count(*) FROM weekday UNION ALL SELECT 'summary', 1""",
)
def _(spark, d):
    """Writes the summary files and counts what can be read back."""
    plays = t.order_plays(spark, d)
    folder = scratch_path(spark, "summary")
    tables = {
        "summary": m.summary_overview(plays),
        "monthly": m.monthly_summary(plays),
        "weekday": m.weekday_distribution(plays),
        "geographic": m.geographic(plays),
    }
    sinks.export_summaries(tables, folder)
    files = [name for name in tables if name != "geographic"]  # these plays carry no place
    counts = [
        spark.read.json(f"{folder}/{name}").agg(F.count("*").alias("rows")).select(F.lit(name).alias("file"), "rows")
        for name in files
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(
    "export_slim",
    f"""{TOTALS},{mx.MONTHLY_SUMMARY} SELECT 'canonical_artists' AS name, count(*) AS rows FROM artists
    UNION ALL SELECT 'canonical_albums', count(*) FROM albums UNION ALL SELECT 'canonical_tracks', count(*) FROM tracks
    UNION ALL SELECT 'artist_genres', count(*) FROM artist_genres UNION ALL SELECT 'artist_analytics', count(*) FROM artist_basic
    UNION ALL SELECT 'monthly_summary', count(*) FROM monthly_summary""",
)
def _(spark, d):
    plays = t.order_plays(spark, d)
    folder = scratch_path(spark, "slim")
    names = sinks.export_slim(
        {
            "plays": plays, "canonical_artists": t.artists(spark, d), "canonical_albums": t.albums(spark, d),
            "canonical_tracks": t.tracks(spark, d), "artist_genres": t.artist_genres(spark, d),
            "artist_analytics": m.artist_analytics(plays), "monthly_summary": m.monthly_summary(plays),
        },
        folder,
    )
    counts = [
        spark.read.parquet(f"{folder}/{name}").agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        for name in names
    ]
    result = counts[0]
    for count in counts[1:]:
        result = result.unionByName(count)
    return result
