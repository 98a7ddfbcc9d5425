"""Registered metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklore.catalog import tables as t
from tracklore.catalog.registry import query
from tracklore.functions import timeparts
from tracklore.operators import metrics as m
from tracklore.operators import skew

WITH_ORDERS = "WITH" + t.ORDER_PLAYS
WITH_EVENTS = "WITH" + t.EVENT_PLAYS

AS_OF = "(SELECT max(d) FROM clean)"
ARTIST_BASIC = """
artist_basic AS (
  SELECT artist_id, min(d) AS first_play_date, max(d) AS last_play_date, count(*) AS total_plays,
         CAST(sum(ms) AS BIGINT) AS total_duration_ms, count(DISTINCT track_id) AS unique_tracks_played,
         CAST(date_diff('day', max(d), (SELECT max(d) FROM clean)) AS INTEGER) AS days_since_last_play
  FROM clean WHERE artist_id IS NOT NULL GROUP BY artist_id)"""
MONTHLY = """
monthly AS (SELECT artist_id, ym AS year_month, count(*) AS plays, CAST(sum(ms) AS BIGINT) AS duration_ms
            FROM clean WHERE artist_id IS NOT NULL GROUP BY ALL)"""
DAILY = """
daily AS (SELECT artist_id, d AS play_date, count(*) AS plays FROM clean WHERE artist_id IS NOT NULL GROUP BY ALL)"""
TRACK_COUNTS = """
track_counts AS (SELECT artist_id, track_id, count(*) AS plays FROM clean
                 WHERE artist_id IS NOT NULL AND track_id IS NOT NULL GROUP BY ALL)"""
TRACK_YEARLY = """
track_yearly AS (SELECT track_id, CAST(year(d) AS INTEGER) AS year, count(*) AS plays FROM clean
                 WHERE track_id IS NOT NULL GROUP BY ALL)"""
BINGE = """
binge AS (SELECT artist_id, round(sum(plays) / 30.0::DOUBLE, 3) AS binge_score
          FROM (SELECT *, min(play_date) OVER (PARTITION BY artist_id) AS f FROM daily)
          WHERE play_date <= f + 30 GROUP BY artist_id)"""
PEAK = """
peak AS (SELECT artist_id, CAST(year_month || '-01' AS DATE) AS peak_period_start,
                last_day(CAST(year_month || '-01' AS DATE)) AS peak_period_end
         FROM (SELECT *, row_number() OVER (PARTITION BY artist_id ORDER BY plays DESC, year_month) AS rn FROM monthly)
         WHERE rn = 1)"""
TIER = """
tier AS (SELECT artist_id,
                CASE WHEN s <= 5 THEN 'one-and-done' WHEN span < 30 THEN 'phase' WHEN n <= 1 THEN 'phase'
                     WHEN 100 * (n * ss - s * s) < 64 * s * s THEN 'constant' ELSE 'seasonal' END AS loyalty_tier
         FROM (SELECT artist_id, count(*) AS n, sum(plays) AS s, sum(plays * plays) AS ss FROM monthly GROUP BY 1)
              JOIN (SELECT artist_id, max(play_date) - min(play_date) + 1 AS span FROM daily GROUP BY 1)
              USING (artist_id))"""
DEEP_CUTS = """
deep AS (SELECT artist_id, CASE WHEN count(*) <= 5 THEN 0.0::DOUBLE
                ELSE round(sum(CASE WHEN rn > 5 THEN plays ELSE 0 END)::DOUBLE / sum(plays), 3) END AS deep_cuts_ratio
         FROM (SELECT *, row_number() OVER (PARTITION BY artist_id ORDER BY plays DESC, track_id) AS rn
               FROM track_counts) GROUP BY artist_id)"""
HALF_LIFE = """
half AS (SELECT artist_id, CAST(min(CASE WHEN 2 * running >= total THEN play_date END) - min(play_date) AS INTEGER)
                AS discovery_half_life
         FROM (SELECT *, sum(plays) OVER (PARTITION BY artist_id ORDER BY play_date) AS running,
                      sum(plays) OVER (PARTITION BY artist_id) AS total FROM daily) GROUP BY artist_id)"""
SLEEPERS = """
sleepers AS (SELECT track_id, s >= 10 AND n >= 2 AND 2 * hi * n < 5 * s AND 10 * lo * n >= 3 * s AS is_sleeper
             FROM (SELECT track_id, count(*) AS n, sum(plays) AS s, max(plays) AS hi, min(plays) AS lo
                   FROM track_yearly GROUP BY track_id))"""
ARTIST_ANALYTICS = ",".join([ARTIST_BASIC, MONTHLY, DAILY, TRACK_COUNTS, BINGE, PEAK, TIER, DEEP_CUTS, HALF_LIFE]) + """,
artist_analytics AS (
  SELECT b.*, peak_period_start, peak_period_end, binge_score, loyalty_tier,
         coalesce(deep_cuts_ratio, 0.0::DOUBLE) AS deep_cuts_ratio, discovery_half_life
  FROM artist_basic b LEFT JOIN peak USING (artist_id) LEFT JOIN binge USING (artist_id)
       LEFT JOIN tier USING (artist_id) LEFT JOIN deep USING (artist_id) LEFT JOIN half USING (artist_id))"""
TRACK_BASIC = """
track_basic AS (
  SELECT track_id, min(d) AS first_play_date, max(d) AS last_play_date, count(*) AS total_plays,
         CAST(sum(ms) AS BIGINT) AS total_duration_ms,
         count(*) FILTER (hour(ts) BETWEEN 6 AND 11) AS morning_plays,
         count(*) FILTER (hour(ts) BETWEEN 12 AND 17) AS afternoon_plays,
         count(*) FILTER (hour(ts) BETWEEN 18 AND 21) AS evening_plays,
         count(*) FILTER (hour(ts) >= 22 OR hour(ts) < 6) AS night_plays
  FROM clean WHERE track_id IS NOT NULL GROUP BY track_id)"""
ALBUM_BASIC = """
album_basic AS (
  SELECT album_id, min(d) AS first_play_date, max(d) AS last_play_date, count(*) AS total_plays,
         CAST(sum(ms) AS BIGINT) AS total_duration_ms, count(DISTINCT track_id) AS unique_tracks_played
  FROM clean WHERE album_id IS NOT NULL GROUP BY album_id)"""
MONTHLY_SUMMARY = """
firsts AS (SELECT ym, count(*) AS n FROM (SELECT artist_id, min(ym) AS ym FROM clean WHERE artist_id IS NOT NULL
           GROUP BY 1) GROUP BY 1),
tops AS (SELECT ym, artist_id, n FROM (
           SELECT ym, artist_id, count(*) AS n,
                  row_number() OVER (PARTITION BY ym ORDER BY count(*) DESC, artist_id) AS rn
           FROM clean WHERE artist_id IS NOT NULL GROUP BY 1, 2) WHERE rn = 1),
monthly_summary AS (
  SELECT c.ym AS year_month, count(*) AS total_plays, CAST(sum(ms) AS BIGINT) AS total_duration_ms,
         count(DISTINCT c.artist_id) AS unique_artists, count(DISTINCT album_id) AS unique_albums,
         count(DISTINCT track_id) AS unique_tracks, coalesce(any_value(firsts.n), 0) AS new_artists_discovered,
         any_value(tops.artist_id) AS top_artist_id, any_value(tops.n) AS top_artist_plays,
         round(count(DISTINCT c.artist_id)::DOUBLE / count(*), 4) AS fragmentation_score
  FROM clean c LEFT JOIN firsts ON firsts.ym = c.ym LEFT JOIN tops ON tops.ym = c.ym GROUP BY c.ym)"""


# --- basics ------------------------------------------------------------------------------


@query("artist_basic", WITH_ORDERS + "," + ARTIST_BASIC + "SELECT * FROM artist_basic")
def _(spark, d):
    return m.artist_basic(t.order_plays(spark, d))


@query("album_basic", WITH_ORDERS + "," + ALBUM_BASIC + "SELECT * FROM album_basic")
def _(spark, d):
    return m.album_basic(t.order_plays(spark, d))


@query("track_basic", WITH_ORDERS + "," + TRACK_BASIC + "SELECT * FROM track_basic")
def _(spark, d):
    return m.track_basic(t.order_plays(spark, d))


@query("track_dayparts", WITH_EVENTS + "," + TRACK_BASIC + "SELECT * FROM track_basic")
def _(spark, d):
    return m.track_basic(t.event_plays(spark, d))


@query("artist_monthly", WITH_ORDERS + "," + MONTHLY + "SELECT * FROM monthly")
def _(spark, d):
    return m.artist_monthly(t.order_plays(spark, d))


@query("artist_daily", WITH_ORDERS + "," + DAILY + "SELECT * FROM daily")
def _(spark, d):
    return m.artist_daily(t.order_plays(spark, d))


@query("track_yearly", WITH_ORDERS + "," + TRACK_YEARLY + "SELECT * FROM track_yearly")
def _(spark, d):
    return m.track_yearly(t.order_plays(spark, d))


@query("artist_track_counts", WITH_ORDERS + "," + TRACK_COUNTS + "SELECT * FROM track_counts")
def _(spark, d):
    return m.artist_track_counts(t.order_plays(spark, d))


# --- artist behaviour --------------------------------------------------------------------


@query("binge_score", f"{WITH_ORDERS},{DAILY},{BINGE} SELECT * FROM binge")
def _(spark, d):
    return m.binge_score(m.artist_daily(t.order_plays(spark, d)))


@query("peak_period", f"{WITH_ORDERS},{MONTHLY},{PEAK} SELECT * FROM peak")
def _(spark, d):
    return m.peak_period(m.artist_monthly(t.order_plays(spark, d)))


@query("loyalty_tier", f"{WITH_ORDERS},{MONTHLY},{DAILY},{TIER} SELECT * FROM tier")
def _(spark, d):
    plays = t.order_plays(spark, d)
    return m.loyalty_tier(m.artist_monthly(plays), m.artist_daily(plays))


@query("deep_cuts_ratio", f"{WITH_ORDERS},{TRACK_COUNTS},{DEEP_CUTS} SELECT * FROM deep")
def _(spark, d):
    return m.deep_cuts_ratio(m.artist_track_counts(t.order_plays(spark, d)))


@query("discovery_half_life", f"{WITH_ORDERS},{DAILY},{HALF_LIFE} SELECT * FROM half")
def _(spark, d):
    return m.discovery_half_life(m.artist_daily(t.order_plays(spark, d)))


@query("artist_analytics", f"{WITH_ORDERS},{ARTIST_ANALYTICS} SELECT * FROM artist_analytics")
def _(spark, d):
    return m.artist_analytics(t.order_plays(spark, d))


@query(
    "artist_trend",
    f"""{WITH_ORDERS},{MONTHLY},
    s AS (SELECT artist_id, count(*) AS n, sum(plays) FILTER (rn <= 2) AS r, sum(plays) FILTER (rn > 2) AS o
          FROM (SELECT *, row_number() OVER (PARTITION BY artist_id ORDER BY year_month DESC) AS rn FROM monthly)
          GROUP BY 1)
    SELECT artist_id, CASE WHEN n < 4 THEN 'stable' WHEN 10 * r * (n - 2) > 26 * o THEN 'up'
                           WHEN 10 * r * (n - 2) < 14 * o THEN 'down' ELSE 'stable' END AS trend FROM s""",
)
def _(spark, d):
    return m.artist_trend(m.artist_monthly(t.order_plays(spark, d)))


# --- albums ------------------------------------------------------------------------------

COMPLETION_GAP = 21_600
EVENT_ALBUMS = """
ev AS (SELECT user_id AS album_id, event_type AS track, ts FROM events),
gaps AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY album_id ORDER BY ts)
                             > 21600000000 THEN 1 ELSE 0 END AS b FROM ev),
sess AS (SELECT album_id, track, sum(b) OVER (PARTITION BY album_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid
         FROM gaps),
sessions AS (SELECT album_id, CAST(sid AS BIGINT) AS session_no, count(DISTINCT track) AS distinct_tracks
             FROM sess GROUP BY ALL)"""


def _album_events(spark, d):
    """Users as albums of five tracks, one per event type."""
    return t.table(spark, d, "events").select(
        F.col("user_id").alias("album_id"),
        F.xxhash64("event_type").alias("track_id"),
        "ts",
        F.lit(False).alias("is_duplicate"),
        F.lit(0).cast("bigint").alias("duration_ms"),
        F.lit(0).cast("bigint").alias("ms_played"),
    )


def _album_tracks(spark, d):
    return t.table(spark, d, "events").select(
        F.col("user_id").alias("album_id"), F.xxhash64("event_type").alias("id")
    ).distinct()


@query("album_sessions", f"WITH {EVENT_ALBUMS} SELECT * FROM sessions")
def _(spark, d):
    return m.album_sessions(_album_events(spark, d), COMPLETION_GAP)


@query(
    "completion_rate",
    f"""WITH {EVENT_ALBUMS},
    sizes AS (SELECT album_id, count(DISTINCT track) AS n FROM ev GROUP BY 1),
    totals AS (SELECT album_id, count(*) AS plays FROM ev GROUP BY 1),
    done AS (SELECT album_id, count(*) AS c FROM sessions JOIN sizes USING (album_id)
             WHERE 5 * distinct_tracks >= 4 * n GROUP BY 1)
    SELECT album_id, CASE WHEN n < 3 OR plays < n THEN 0.0::DOUBLE
           ELSE round(coalesce(c, 0)::DOUBLE / greatest(plays // n, 1), 3) END AS completion_rate
    FROM totals LEFT JOIN sizes USING (album_id) LEFT JOIN done USING (album_id)""",
)
def _(spark, d):
    sizes = m.album_track_count(_album_tracks(spark, d))
    return m.completion_rate(_album_events(spark, d), sizes, COMPLETION_GAP)


@query(
    "album_track_count",
    f"WITH {t.DIMENSIONS} SELECT album_id, count(*) AS track_count FROM tracks WHERE album_id IS NOT NULL GROUP BY 1",
)
def _(spark, d):
    return m.album_track_count(t.tracks(spark, d))


# --- tracks ------------------------------------------------------------------------------


@query("is_sleeper", f"{WITH_ORDERS},{TRACK_YEARLY},{SLEEPERS} SELECT * FROM sleepers")
def _(spark, d):
    return m.sleepers(m.track_yearly(t.order_plays(spark, d)))


@query(
    "track_analytics",
    f"""{WITH_ORDERS},{TRACK_YEARLY},{SLEEPERS},{TRACK_BASIC}
    SELECT * FROM track_basic LEFT JOIN sleepers USING (track_id)""",
)
def _(spark, d):
    return m.track_analytics(t.order_plays(spark, d))


# --- time patterns -----------------------------------------------------------------------


@query("monthly_summary", f"{WITH_ORDERS},{MONTHLY_SUMMARY} SELECT * FROM monthly_summary")
def monthly_summary(spark, d):
    return m.monthly_summary(t.order_plays(spark, d))


@query("monthly_new_artists", f"{WITH_ORDERS},{MONTHLY_SUMMARY} SELECT ym AS year_month, n AS new_artists FROM firsts")
def _(spark, d):
    return m.monthly_new_artists(t.order_plays(spark, d))


@query(
    "monthly_top_artist",
    f"""{WITH_ORDERS},{MONTHLY_SUMMARY}
    SELECT ym AS year_month, artist_id AS top_artist_id, n AS top_artist_plays FROM tops""",
)
def _(spark, d):
    return m.monthly_top_artist(m.artist_monthly(t.order_plays(spark, d)))


HOURLY = """
hourly AS (SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS total_plays,
                  round(count(*)::DOUBLE / (SELECT count(DISTINCT d) FROM clean), 3) AS avg_plays_per_day
           FROM clean GROUP BY 1)"""
WEEKDAY = """
weekday AS (SELECT CAST(dayofweek(d) AS INTEGER) AS weekday, count(*) AS total_plays,
                   round(count(*)::DOUBLE / (SELECT count(DISTINCT strftime(d, '%Y-%W')) FROM clean), 3)
                   AS avg_plays_per_week
            FROM clean GROUP BY 1)"""


@query("hourly_distribution", f"{WITH_EVENTS},{HOURLY} SELECT * FROM hourly")
def _(spark, d):
    return m.hourly_distribution(t.event_plays(spark, d))


@query("weekday_distribution", f"{WITH_ORDERS},{WEEKDAY} SELECT * FROM weekday")
def _(spark, d):
    return m.weekday_distribution(t.order_plays(spark, d))


# --- discovery ---------------------------------------------------------------------------

CONTEXT = """
firstday AS (SELECT artist_id, min(play_date) AS f FROM daily GROUP BY 1),
around AS (SELECT f.artist_id AS discovered_artist_id, p.artist_id AS context_artist_id,
                  CASE WHEN p.play_date < f THEN 'before' ELSE 'after' END AS context_type,
                  CAST(sum(plays) AS BIGINT) AS play_count
           FROM firstday f JOIN daily p ON p.play_date BETWEEN f - 7 AND f + 7 AND p.artist_id <> f.artist_id
           GROUP BY ALL),
context AS (SELECT discovered_artist_id, context_artist_id, context_type, play_count FROM (
              SELECT *, row_number() OVER (PARTITION BY discovered_artist_id, context_type
                                           ORDER BY play_count DESC, context_artist_id) AS rn FROM around)
            WHERE rn <= 5)"""


@query("discovery_context", f"{WITH_ORDERS},{DAILY},{CONTEXT} SELECT * FROM context")
def _(spark, d):
    return m.discovery_context(m.artist_daily(t.order_plays(spark, d)))


# --- geography and summaries -------------------------------------------------------------

GEO = """
geo AS (SELECT country, region, city, count(*) AS total_plays, min(d) AS first_play_date, max(d) AS last_play_date
        FROM clean WHERE country IS NOT NULL GROUP BY ALL)"""


@query("geographic", f"{WITH_ORDERS},{GEO} SELECT * FROM geo")
def _(spark, d):
    return m.geographic(t.order_plays(spark, d, places=True))


@query(
    "summary_overview",
    f"""{WITH_ORDERS} SELECT count(*) AS total_plays, round(sum(ms)::DOUBLE / 3600000, 1) AS total_hours_listened,
    count(DISTINCT artist_id) AS unique_artists, count(DISTINCT album_id) AS unique_albums,
    count(DISTINCT track_id) AS unique_tracks, min(d) AS first_play_date, max(d) AS last_play_date FROM clean""",
)
def _(spark, d):
    return m.summary_overview(t.order_plays(spark, d))


@query(
    "loyalty_distribution",
    f"{WITH_ORDERS},{MONTHLY},{DAILY},{TIER} SELECT loyalty_tier, count(*) AS artists FROM tier GROUP BY 1",
)
def _(spark, d):
    plays = t.order_plays(spark, d)
    return m.loyalty_distribution(m.loyalty_tier(m.artist_monthly(plays), m.artist_daily(plays)))


@query(
    "ghost_artists",
    f"""{WITH_ORDERS},{ARTIST_BASIC} SELECT count(*) FILTER (
    date_diff('day', last_play_date, DATE '2002-06-01') > 365 AND total_plays >= 10) AS ghost_artists
    FROM artist_basic""",
)
def _(spark, d):
    return m.ghost_artists(m.artist_basic(t.order_plays(spark, d), F.lit("2002-06-01").cast("date")))


@query(
    "sleeper_count",
    f"{WITH_ORDERS},{TRACK_YEARLY},{SLEEPERS} SELECT count(*) FILTER (is_sleeper) AS sleeper_tracks FROM sleepers",
)
def _(spark, d):
    return m.sleeper_count(m.sleepers(m.track_yearly(t.order_plays(spark, d))))


@query("plays_by_day", f"{WITH_ORDERS} SELECT d AS play_date, count(*) AS play_count FROM plays GROUP BY 1")
def _(spark, d):
    return m.plays_by_day(t.order_plays(spark, d))


@query(
    "artist_first_last",
    f"""{WITH_ORDERS} SELECT artist_id, min(d) AS first_play, max(d) AS last_play, count(*) AS total_plays
    FROM plays WHERE artist_id IS NOT NULL GROUP BY 1""",
)
def _(spark, d):
    seen = m.artist_first_last(t.order_plays(spark, d))
    return seen.withColumn("first_play", F.to_date("first_play")).withColumn("last_play", F.to_date("last_play"))


@query(
    "db_stats",
    f"""{WITH_ORDERS} SELECT count(*) AS total_plays, count(*) FILTER (NOT is_duplicate) AS clean_plays,
    min(d) AS first_date, max(d) AS last_date, (SELECT count(*) FROM customer) AS artists,
    (SELECT count(*) FROM supplier) AS albums, (SELECT count(*) FROM part) AS tracks FROM plays""",
)
def _(spark, d):
    dims = (t.table(spark, d, name) for name in ("customer", "supplier", "part"))
    return m.db_stats(t.order_plays(spark, d), *dims)


@query("plays_by_source", f"{WITH_EVENTS} SELECT source, count(*) AS plays FROM plays GROUP BY 1")
def _(spark, d):
    return m.plays_by_source(t.event_plays(spark, d))


# --- ranking -----------------------------------------------------------------------------


@query(
    "entity_rank",
    f"""{WITH_ORDERS},{TRACK_BASIC}
    SELECT track_id, total_plays, row_number() OVER (ORDER BY total_plays DESC, track_id) AS rank FROM track_basic""",
)
def _(spark, d):
    plays = m.track_basic(t.order_plays(spark, d)).select("track_id", "total_plays")
    return skew.global_rank(plays, "total_plays", "track_id")


@query(
    "top_artists",
    f"""{WITH_ORDERS},{ARTIST_BASIC},{MONTHLY},{DAILY},{TIER},{t.DIMENSIONS}
    SELECT artist_id, name, total_plays, loyalty_tier FROM artist_basic JOIN tier USING (artist_id)
    JOIN artists ON id = artist_id ORDER BY total_plays DESC, artist_id LIMIT 10""",
)
def _(spark, d):
    return _top_artists(spark, d, 10)


@query(
    "top_artists_100",
    f"""{WITH_ORDERS},{ARTIST_BASIC},{MONTHLY},{DAILY},{TIER},{t.DIMENSIONS}
    SELECT artist_id, name, total_plays, loyalty_tier FROM artist_basic JOIN tier USING (artist_id)
    JOIN artists ON id = artist_id ORDER BY total_plays DESC, artist_id LIMIT 100""",
)
def _(spark, d):
    return _top_artists(spark, d, 100)


def _top_artists(spark, d, n):
    plays = t.order_plays(spark, d)
    monthly, daily = m.artist_monthly(plays), m.artist_daily(plays)
    totals = monthly.groupBy("artist_id").agg(F.sum("plays").alias("total_plays"))
    names = t.artists(spark, d).select(F.col("id").alias("artist_id"), "name")
    return (
        totals.join(m.loyalty_tier(monthly, daily), "artist_id")
        .join(names, "artist_id")
        .orderBy(F.desc("total_plays"), "artist_id")
        .limit(n)
        .select("artist_id", "name", "total_plays", "loyalty_tier")
    )


# --- scalar function projections ---------------------------------------------------------


@query(
    "time_parts",
    """SELECT event_id, CAST(ts AS DATE) AS d, strftime(ts, '%Y-%m') AS ym, CAST(hour(ts) AS INTEGER) AS hour,
    CAST(dayofweek(ts) AS INTEGER) AS weekday, strftime(ts, '%Y-%W') AS week,
    CASE WHEN hour(ts) BETWEEN 6 AND 11 THEN 'morning' WHEN hour(ts) BETWEEN 12 AND 17 THEN 'afternoon'
         WHEN hour(ts) BETWEEN 18 AND 21 THEN 'evening' ELSE 'night' END AS daypart,
    CASE WHEN hour(ts) >= 5 AND hour(ts) < 12 THEN 'Morning Person' WHEN hour(ts) >= 12 AND hour(ts) < 17
         THEN 'Afternoon Listener' WHEN hour(ts) >= 17 AND hour(ts) < 21 THEN 'Evening Vibes'
         ELSE 'Night Owl' END AS label FROM events""",
)
def _(spark, d):
    return t.table(spark, d, "events").select(
        "event_id",
        timeparts.day().alias("d"),
        timeparts.year_month().alias("ym"),
        timeparts.hour().alias("hour"),
        timeparts.weekday().alias("weekday"),
        timeparts.week_label().alias("week"),
        timeparts.daypart(timeparts.hour()).alias("daypart"),
        timeparts.listener_label(timeparts.hour()).alias("label"),
    )


@query(
    "format_duration",
    """WITH x AS (SELECT o_orderkey, CAST(round(o_totalprice * 1000) AS BIGINT) AS ms FROM orders),
    p AS (SELECT *, ms // 1000 AS s FROM x)
    SELECT o_orderkey, round(ms / 3600000.0::DOUBLE, 1) AS hours,
    CASE WHEN s >= 86400 THEN format('{}d {}h', s // 86400, (s // 3600) % 24)
         WHEN s >= 3600 THEN format('{}h {}m', s // 3600, (s // 60) % 60)
         WHEN s >= 60 THEN format('{}m {}s', s // 60, s % 60) ELSE format('{}s', s) END AS text FROM p""",
)
def _(spark, d):
    ms = F.round(F.col("o_totalprice") * 1000).cast("bigint")
    return t.table(spark, d, "orders").select(
        "o_orderkey", timeparts.ms_to_hours(ms).alias("hours"), timeparts.format_duration(ms).alias("text")
    )
