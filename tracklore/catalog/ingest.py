"""Registered source, ingest and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklore.catalog import tables as t
from tracklore.catalog.registry import query
from tracklore.operators import ingest as i
from tracklore.session import cut_lineage, scratch_path, shared_folder
from tracklore.sources import history as h

# --- streaming history rows derived from events -------------------------------------------

HISTORY = """
hist AS (
  SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'not-a-timestamp' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS ts_text,
         CASE WHEN event_id % 50 <> 0 THEN epoch(date_trunc('second', ts))::BIGINT END AS secs,
         CASE WHEN event_id % 20 <> 3 THEN CAST(round(value * 1000) AS BIGINT) END AS ms_played,
         concat('C', user_id % 5) AS conn_country,
         CASE WHEN event_id % 13 <> 0 THEN concat('Track ', user_id % 40) END AS track,
         CASE WHEN event_id % 11 <> 0 THEN concat('Artist ', user_id) END AS artist,
         CASE WHEN event_id % 6 = 0 THEN '' ELSE concat('Album ', user_id % 7) END AS album,
         CASE WHEN event_id % 17 <> 0 THEN concat('uri:', user_id) END AS uri,
         CASE event_type WHEN 'error' THEN 'Episode' WHEN 'signup' THEN '' END AS episode,
         CASE WHEN event_id % 9 = 0 THEN 0 WHEN event_id % 9 <> 1 THEN event_id * 1000000 END AS offline_ms,
         CASE event_id % 3 WHEN 1 THEN TRUE WHEN 2 THEN FALSE END AS shuffle
  FROM events),
seen AS (SELECT concat('part-', event_id % 3, '.json') AS source_file, * FROM hist
         UNION ALL SELECT 'again.json', * FROM hist WHERE event_id % 5 = 0),
status AS (SELECT *, CASE WHEN secs IS NULL THEN 'invalid' WHEN coalesce(episode, '') <> '' THEN 'podcast'
                         WHEN coalesce(ms_played, 0) < 30000 THEN 'short' ELSE 'ok' END AS row_status,
                  nullif(concat_ws('|', CASE WHEN coalesce(track, '') = '' THEN 'missing_track_name' END,
                         CASE WHEN coalesce(artist, '') = '' THEN 'missing_artist_name' END,
                         CASE WHEN coalesce(album, '') = '' THEN 'missing_album_name' END,
                         CASE WHEN coalesce(uri, '') = '' THEN 'missing_track_uri' END), '') AS flags FROM seen)"""


def _payloads(spark, d):
    """(source_file, source_row, payload): a fifth of the rows arrives a second time in another file."""
    e = t.table(spark, d, "events")
    key = F.col("event_id")

    def unless(test, value):
        return F.when(~test, value)

    fields = {
        "ts": F.when(key % 50 == 0, "not-a-timestamp").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        "ms_played": unless(key % 20 == 3, F.round(F.col("value") * 1000).cast("bigint")),
        "conn_country": F.concat(F.lit("C"), F.col("user_id") % 5),
        "master_metadata_track_name": unless(key % 13 == 0, F.concat(F.lit("Track "), F.col("user_id") % 40)),
        "master_metadata_album_artist_name": unless(key % 11 == 0, F.concat(F.lit("Artist "), "user_id")),
        "master_metadata_album_album_name": F.when(key % 6 == 0, "").otherwise(
            F.concat(F.lit("Album "), F.col("user_id") % 7)
        ),
        "spotify_track_uri": unless(key % 17 == 0, F.concat(F.lit("uri:"), "user_id")),
        "episode_name": F.when(F.col("event_type") == "error", "Episode").when(F.col("event_type") == "signup", ""),
        "offline_timestamp": F.when(key % 9 == 0, F.lit(0).cast("bigint")).when(key % 9 != 1, key * 1_000_000),
        "shuffle": F.when(key % 3 == 1, True).when(key % 3 == 2, False),
    }
    row = F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})
    rows = e.select(
        F.concat(F.lit("part-"), key % 3, F.lit(".json")).alias("source_file"),
        key.alias("source_row"),
        row.alias("payload"),
    )
    return rows.unionByName(rows.where("source_row % 5 = 0").withColumn("source_file", F.lit("again.json")))


def _classified(spark, d):
    return i.classify_history(h.parse_history(_payloads(spark, d)))


@query(
    "ingest_validate_ts",
    f"WITH {HISTORY} SELECT source_file, event_id AS source_row, secs FROM seen",
)
def _(spark, d):
    rows = h.parse_history(_payloads(spark, d))
    return rows.select("source_file", "source_row", F.unix_seconds(i.utc_timestamp("ts")).alias("secs"))


@query("filter_podcasts", f"WITH {HISTORY} SELECT source_file, event_id AS source_row FROM seen WHERE coalesce(episode, '') = ''")
def _(spark, d):
    return h.parse_history(_payloads(spark, d)).where(~i.is_podcast()).select("source_file", "source_row")


@query("filter_short", f"WITH {HISTORY} SELECT source_file, event_id AS source_row FROM seen WHERE coalesce(ms_played, 0) >= 30000")
def _(spark, d):
    return h.parse_history(_payloads(spark, d)).where(~i.is_short()).select("source_file", "source_row")


@query("row_status", f"WITH {HISTORY} SELECT source_file, event_id AS source_row, row_status FROM status")
def _(spark, d):
    return _classified(spark, d).select("source_file", "source_row", "row_status")


@query("metadata_flags", f"WITH {HISTORY} SELECT source_file, event_id AS source_row, flags FROM status")
def _(spark, d):
    return _classified(spark, d).select("source_file", "source_row", F.array_join("metadata_flags", "|").alias("flags"))


@query(
    "offline_ts",
    f"""WITH {HISTORY} SELECT source_file, event_id AS source_row, nullif(offline_ms, 0) // 1000 AS offline_secs,
    CAST(shuffle AS INTEGER) AS shuffle FROM seen""",
)
def _(spark, d):
    rows = h.parse_history(_payloads(spark, d))
    offline = F.unix_seconds(i.offline_timestamp())
    return rows.select("source_file", "source_row", offline.alias("offline_secs"), i.bool_to_int("shuffle").alias("shuffle"))


@query(
    "bool_to_int",
    f"WITH {HISTORY} SELECT CAST(shuffle AS INTEGER) AS shuffle, count(*) AS n FROM seen GROUP BY 1",
)
def _(spark, d):
    rows = h.parse_history(_payloads(spark, d)).select(i.bool_to_int("shuffle").alias("shuffle"))
    return rows.groupBy("shuffle").agg(F.count("*").alias("n"))


def _json(column: str, key: str) -> str:
    return f"""'"{key}":' || coalesce('"' || CAST({column} AS VARCHAR) || '"', 'null')"""


HASHED = "sha256('{' || " + " || ',' || ".join(
    _json(column, key)
    for key, column in [
        ("conn_country", "conn_country"), ("episode_name", "episode"), ("master_metadata_album_album_name", "album"),
        ("master_metadata_album_artist_name", "artist"), ("master_metadata_track_name", "track"),
        ("ms_played", "ms_played"), ("offline_timestamp", "offline_ms"), ("shuffle", "shuffle"),
        ("spotify_track_uri", "uri"), ("ts", "ts_text"),
    ]
) + " || '}')"


@query("content_hash", f"WITH {HISTORY} SELECT source_file, event_id AS source_row, {HASHED} AS raw_hash FROM seen")
def _(spark, d):
    return _payloads(spark, d).select("source_file", "source_row", i.content_hash().alias("raw_hash"))


FIRST = f"""
hashed AS (SELECT *, {HASHED} AS raw_hash FROM status),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY raw_hash ORDER BY source_file, event_id) AS rn
           FROM hashed WHERE row_status = 'ok') WHERE rn = 1)"""


@query("dedupe_exact_rows", f"WITH {HISTORY},{FIRST} SELECT source_file, event_id AS source_row, raw_hash FROM firsts")
def _(spark, d):
    return i.accepted_history(_classified(spark, d)).select("source_file", "source_row", "raw_hash")


@query(
    "dedupe_against_store",
    f"""WITH {HISTORY},{FIRST} SELECT source_file, event_id AS source_row FROM firsts WHERE raw_hash NOT IN (
    SELECT raw_hash FROM hashed WHERE source_file = 'part-0.json')""",
)
def _(spark, d):
    rows = _classified(spark, d)
    stored = rows.where("source_file = 'part-0.json'")
    return i.accepted_history(rows, stored).select("source_file", "source_row")


@query("ingest_quarantine", f"WITH {HISTORY} SELECT source_file, event_id AS source_row FROM status WHERE row_status = 'invalid'")
def _(spark, d):
    return i.rejected_history(_classified(spark, d)).select("source_file", "source_row")


@query(
    "ingest_report",
    f"""WITH {HISTORY},{FIRST} SELECT count(DISTINCT source_file) AS files_processed, count(*) AS records_seen,
    (SELECT count(*) FROM firsts) AS inserted, count(*) FILTER (row_status = 'podcast') AS skipped_podcasts,
    count(*) FILTER (row_status = 'short') AS skipped_short, count(*) FILTER (row_status = 'invalid') AS invalid_records,
    count(*) FILTER (row_status = 'ok') - (SELECT count(*) FROM firsts) AS duplicate_rows,
    (SELECT count(*) FROM firsts WHERE flags IS NOT NULL) AS metadata_flagged,
    min(secs) FILTER (row_status = 'ok') AS start_secs, max(secs) FILTER (row_status = 'ok') AS end_secs FROM hashed""",
)
def _(spark, d):
    report = i.history_report(_classified(spark, d))
    return report.select(
        *[c for c in report.columns if c not in ("start_ts", "end_ts")],
        F.unix_seconds("start_ts").alias("start_secs"),
        F.unix_seconds("end_ts").alias("end_secs"),
    )


@query(
    "sample_first_n",
    f"""WITH {HISTORY},{FIRST} SELECT secs, track, artist, source_file FROM firsts ORDER BY source_file, event_id LIMIT 3""",
)
def _(spark, d):
    accepted = i.accepted_history(_classified(spark, d)).withColumns({
        "secs": F.unix_seconds("play_ts"),
        "track": F.col("master_metadata_track_name"),
        "artist": F.col("master_metadata_album_artist_name"),
    })
    return i.sample_rows(accepted, ["secs", "track", "artist"])


@query(
    "computation_log",
    """WITH days AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events)
    SELECT 'play_days' AS computation_type, count(*) AS entities_processed, DATE '2024-01-01' AS started_at,
    DATE '2024-01-02' AS completed_at, 'completed' AS status FROM days""",
)
def _(spark, d):
    days = t.table(spark, d, "events").select(F.to_date("ts").alias("d")).distinct()
    return i.computation_log(days, "play_days", F.to_date(F.lit("2024-01-01")), F.to_date(F.lit("2024-01-02")))


# --- scrobbles ---------------------------------------------------------------------------

SCROBBLES = """
scrob AS (
  SELECT event_id, CASE WHEN event_id % 40 = 7 THEN 'bad' WHEN event_id % 4 = 1 THEN NULL
                        ELSE CAST(epoch(date_trunc('hour', ts))::BIGINT AS VARCHAR) END AS uts_text,
         CASE WHEN event_id % 40 = 7 THEN 'not a date' WHEN event_id % 8 = 5 THEN strftime(date_trunc('hour', ts), '%-d %b %Y, %H:%M')
              ELSE strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%SZ') END AS time_text,
         CASE WHEN event_id % 3 = 0 THEN concat('ARTIST ', user_id % 25) ELSE concat('Artist ', user_id % 25) END AS artist,
         CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'N/A' ELSE concat('Album ', user_id % 7) END AS album,
         concat('Track ', user_id % 2) AS track, epoch(date_trunc('hour', ts))::BIGINT AS hour_secs
  FROM events),
timed AS (SELECT *, CASE WHEN event_id % 40 <> 7 THEN hour_secs END AS secs,
                 coalesce(CAST(TRY_CAST(uts_text AS BIGINT) AS VARCHAR), time_text) AS k1, lower(artist) AS k2,
                 lower(track) AS k3, coalesce(trim(album), '') = '' AS album_missing FROM scrob),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k1, k2, k3 ORDER BY event_id) AS rn FROM timed WHERE secs IS NOT NULL)"""


def _scrobbles(spark, d):
    """CSV-shaped text columns with one row position per event."""
    e = t.table(spark, d, "events")
    key, hour, user = F.col("event_id"), F.date_trunc("hour", F.col("ts").cast("timestamp")), F.col("user_id")
    bad = key % 40 == 7
    raw = e.select(
        F.when(bad, "bad").when(key % 4 != 1, F.unix_seconds(hour).cast("string")).alias("uts"),
        F.when(bad, "not a date").when(key % 8 == 5, F.date_format(hour, "d MMM yyyy, HH:mm")).otherwise(
            F.date_format(hour, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        ).alias("utc_time"),
        F.concat(F.when(key % 3 == 0, "ARTIST ").otherwise("Artist "), user % 25).alias("artist"),
        F.when(key % 5 == 1, "  ").when(key % 5 == 2, "N/A").when(key % 5 > 2, F.concat(F.lit("Album "), user % 7)).alias("album"),
        F.concat(F.lit("Track "), user % 2).alias("track"),
        F.lit("240").alias("duration"),
        key.alias("line"),
    )
    position = F.struct(F.lit("scrobbles.csv").alias("source_file"), F.lit(0).cast("bigint").alias("block"), F.col("line"))
    columns = {c: F.col(c) for c in raw.columns if c != "line"}
    fields = [h._pick(columns, field).alias(field) for field in h.SCROBBLE_ALIASES]
    payload = F.to_json(F.struct(*sorted(columns)))
    return raw.select(position.alias("position"), payload.alias("payload"), *fields, F.lit("scrobbles.csv").alias("source_file"))


@query("ingest_epoch_or_text_ts", f"WITH {SCROBBLES} SELECT event_id, secs FROM timed")
def _(spark, d):
    rows = i.classify_scrobbles(_scrobbles(spark, d))
    return rows.select(F.col("position.line").alias("event_id"), F.unix_seconds("play_ts").alias("secs"))


@query("flag_album_missing", f"WITH {SCROBBLES} SELECT event_id, album_missing FROM timed")
def _(spark, d):
    rows = i.classify_scrobbles(_scrobbles(spark, d))
    return rows.select(F.col("position.line").alias("event_id"), "album_missing")


@query("dedupe_scrobble_key", f"WITH {SCROBBLES} SELECT event_id FROM ranked WHERE rn = 1")
def _(spark, d):
    kept = i.dedupe_scrobbles(i.classify_scrobbles(_scrobbles(spark, d)))
    return kept.select(F.col("position.line").alias("event_id"))


@query("flag_scrobble_key", f"WITH {SCROBBLES} SELECT event_id, rn > 1 AS duplicate_in_run FROM ranked")
def _(spark, d):
    kept = i.dedupe_scrobbles(i.classify_scrobbles(_scrobbles(spark, d)), drop=False)
    return kept.select(F.col("position.line").alias("event_id"), "duplicate_in_run")


@query(
    "scrobble_report",
    f"""WITH {SCROBBLES} SELECT CAST(1 AS BIGINT) AS files_processed, (SELECT count(*) FROM timed) AS records_seen,
    count(*) FILTER (rn = 1) AS inserted, (SELECT count(*) FROM timed WHERE secs IS NULL) AS invalid_records,
    count(*) FILTER (rn = 1 AND album_missing) AS missing_album, count(*) FILTER (rn > 1) AS duplicates_flagged,
    count(*) FILTER (rn > 1) AS duplicates_skipped, min(secs) AS start_secs, max(secs) AS end_secs FROM ranked""",
)
def _(spark, d):
    report = i.scrobble_report(i.classify_scrobbles(_scrobbles(spark, d)))
    return report.select(
        *[c for c in report.columns if c not in ("start_ts", "end_ts")],
        F.unix_seconds("start_ts").alias("start_secs"),
        F.unix_seconds("end_ts").alias("end_secs"),
    )


@query(
    "positional_hash",
    """WITH lines AS (SELECT concat('f', user_id % 2) AS source_file, concat('row ', user_id % 30) AS payload FROM events),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY source_file, payload) AS occurrence FROM lines)
    SELECT *, sha256(concat_ws('|', source_file, CAST(occurrence AS VARCHAR), payload)) AS raw_hash FROM numbered""",
)
def _(spark, d):
    user = F.col("user_id")
    lines = t.table(spark, d, "events").select(
        F.concat(F.lit("f"), user % 2).alias("source_file"), F.concat(F.lit("row "), user % 30).alias("payload")
    )
    return i.positional_hash(lines)


def _scrobble_file(spark, d, path):
    """One CSV file of all scrobbles in the order of their events; the columns are those of `_scrobbles`."""
    rows = _scrobbles(spark, d).select(F.col("uts").cast("string").alias("uts"), F.col("artist_name").alias("artist"),
                                       F.col("track_name").alias("track"), F.col("position.line").alias("source"))
    # Sorted in many tasks and stored, in order; the one task of the file only copies.
    shared_folder(spark)
    rows.orderBy("source").checkpoint().coalesce(1).write.option("header", True).csv(path)


@query(
    "positional_hash_lines",
    f"""WITH {SCROBBLES} SELECT event_id, row_number() OVER (ORDER BY event_id) AS source_row FROM scrob""",
)
def _(spark, d):
    """The number of each record in its file, which its hash is made of."""
    path = scratch_path(spark, "numbered")
    _scrobble_file(spark, d, path)
    return i.with_positional_hash(h.read_csv_scrobbles(spark, path)).select(F.col("application").cast("bigint").alias("event_id"), "source_row")


@query(
    "scrobble_reingest",
    f"""WITH {SCROBBLES} SELECT event_id, run FROM scrob, (SELECT CAST(unnest([1, 3]) AS INTEGER) AS run)""",
)
def _(spark, d):
    """Three ingests of a growing folder: the second finds nothing new, the third the rows of one more file, though equal."""
    path = scratch_path(spark, "landing")
    stored = None
    for run in (1, 2, 3):
        if run != 2:
            _scrobble_file(spark, d, f"{path}/part={run}")
        hashed = i.with_positional_hash(h.read_csv_scrobbles(spark, f"{path}/*"))
        new = cut_lineage(i.new_scrobbles(hashed, stored).select(
            F.col("application").cast("bigint").alias("event_id"), F.lit(run).alias("run"), "raw_hash"))
        stored = new if stored is None else stored.unionByName(new)
    return stored.select("event_id", "run")


# --- files -------------------------------------------------------------------------------


@query(
    "scan_json_history",
    f"""WITH {HISTORY} SELECT offline_ms AS record, ms_played, artist, row_status FROM status
    WHERE source_file <> 'again.json' AND (event_id // 500) % 7 <> 3""",
)
def _(spark, d):
    """Writes exports of 500 rows each, some wrapped, some broken, with stray elements, and reads them back."""
    rows = _payloads(spark, d).where("source_file <> 'again.json'")
    chunk = F.floor(F.col("source_row") / 500)
    bodies = rows.groupBy(chunk.alias("chunk")).agg(
        F.array_join(F.array_sort(F.collect_list("payload")), ",").alias("body"),
    )
    listed = F.concat(F.lit("["), "body", F.lit(', 17, "stray"]'))
    text = (
        F.when(F.col("chunk") % 7 == 3, F.concat(F.lit("["), "body"))
        .when(F.col("chunk") % 2 == 1, F.concat(F.lit('{"version": 2, "plays": '), listed, F.lit("}")))
        .otherwise(listed)
    )
    path = scratch_path(spark, "exports")
    bodies.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    scanned = i.classify_history(h.parse_history(h.read_json_history(spark, path)))
    return scanned.select(
        F.col("offline_timestamp").alias("record"),
        "ms_played",
        F.col("master_metadata_album_artist_name").alias("artist"),
        "row_status",
    )


@query(
    "scan_csv_scrobbles",
    f"""WITH {SCROBBLES} SELECT event_id, TRY_CAST(uts_text AS BIGINT) AS uts, time_text AS utc_time, artist AS artist_name,
    nullif(trim(album), '') AS album_name, track AS track_name, CAST(240 AS BIGINT) AS duration_seconds FROM scrob""",
)
def _(spark, d):
    """Writes two CSV exports under different headers and reads them back."""
    rows = _scrobbles(spark, d)
    first, second = scratch_path(spark, "scrobbles"), scratch_path(spark, "scrobbles")
    shared = ["utc_time", "artist_name", "album_name", "track_name"]
    key = F.col("position.line")
    values = rows.select(F.col("uts").cast("string").alias("uts"), *shared, key.alias("event_id"))
    options = {"header": True, "escape": '"', "emptyValue": ""}
    values.where("event_id % 2 = 0").select(
        F.col("uts").alias(" UTS "), "utc_time", F.col("artist_name").alias("Artist"), F.col("album_name").alias("album"),
        F.col("track_name").alias("track"), F.lit("240").alias("duration_seconds"), F.col("event_id").alias("application"),
    ).write.options(**options).csv(first)
    values.where("event_id % 2 = 1").select(
        F.col("uts").alias("timestamp"), F.col("utc_time").alias("date"), F.col("artist_name").alias("band"), "album_name",
        F.col("track_name").alias("song"), F.lit("240.0").alias("duration"), F.col("event_id").alias("source"),
    ).write.options(**options).csv(second)
    scanned = h.read_csv_scrobbles(spark, first, second)
    return scanned.select(
        F.col("application").cast("bigint").alias("event_id"), "uts", *shared, "duration_seconds"
    )
