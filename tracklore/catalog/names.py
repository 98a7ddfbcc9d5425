"""Registered name-cleaning, resolution and linking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklore.catalog import sql_text as sx
from tracklore.catalog import tables as t
from tracklore.catalog.registry import query
from tracklore.functions import similarity, text
from tracklore.operators import resolve as r
from tracklore.session import cut_lineage

WITH_RAW = "WITH" + t.RAW_PLAYS

# --- cleaning over whole columns ---------------------------------------------------------


@query("clean_whitespace", f"SELECT doc_id, {sx.squeeze('text')} AS cleaned FROM documents")
def _(spark, d):
    return t.table(spark, d, "documents").select("doc_id", text.squeeze("text").alias("cleaned"))


@query("clean_artist", f"{WITH_RAW} SELECT source, record_id, {sx.clean_artist('artist_name')} AS cleaned FROM raw")
def _(spark, d):
    return t.raw_plays(spark, d).select("source", "record_id", text.clean_artist("artist_name").alias("cleaned"))


@query(
    "case_fold_caps",
    f"SELECT p_partkey, {sx.fold_capitals('label')} AS folded FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN "
    "concat(p_type, '/', p_brand) WHEN 1 THEN concat(p_type, '/', upper(p_name), '''S ', p_size) ELSE p_name END "
    "AS label FROM part)",
)
def _(spark, d):
    label = F.expr(
        "CASE p_partkey % 3 WHEN 0 THEN concat(p_type, '/', p_brand) "
        "WHEN 1 THEN concat(p_type, '/', upper(p_name), '\\'S ', p_size) ELSE p_name END"
    )
    return t.table(spark, d, "part").select("p_partkey", text.fold_capitals(label).alias("folded"))


PARTS = f"""
cleaned AS (SELECT source, record_id, artist_name, {sx.clean_artist('artist_name')} AS c FROM raw
            WHERE artist_name IS NOT NULL),
folded AS (SELECT *, {sx.fold_capitals('c')} AS f FROM cleaned),
parts AS (SELECT source, record_id, artist_name, {sx.split_collaboration('f')} AS parts FROM folded)"""


@query("split_collaborations", f"{WITH_RAW},{PARTS} SELECT source, record_id, array_to_string(parts, '|') AS parts FROM parts")
def _(spark, d):
    raw = t.raw_plays(spark, d).where("artist_name is not null")
    parts = text.split_collaboration(text.fold_capitals(text.clean_artist("artist_name")))
    return raw.select("source", "record_id", F.array_join(parts, "|").alias("parts"))


# Overrides as a table: one name becomes two artists, another one artist.
OVERRIDES = """SELECT 'artists' AS kind, raw, replacement FROM (
    SELECT p_name AS raw, {array}(concat(p_name, ' One'), concat(p_name, ' Two')) AS replacement
    FROM {part} WHERE p_name LIKE 'red %' GROUP BY p_name)"""


@query(
    "artist_parts",
    f"{WITH_RAW},{PARTS}, manual AS ({OVERRIDES.format(array='list_value', part='part')}), joined AS ("
    "SELECT artist_name, coalesce(replacement, parts) AS p FROM (SELECT DISTINCT artist_name, parts FROM parts) "
    "LEFT JOIN manual ON raw = artist_name) SELECT artist_name, CAST(i - 1 AS INTEGER) AS position, p[i] AS name "
    "FROM (SELECT artist_name, p, unnest(range(1, len(p) + 1)) AS i FROM joined)",
)
def _(spark, d):
    overrides = spark.sql(OVERRIDES.replace("{array}", "array"), part=t.table(spark, d, "part"))
    names, manual = r.with_override(r.distinct_raw_artists(t.raw_plays(spark, d)), "artist_name", "artists", overrides)
    return names.select("artist_name", F.posexplode(text.artist_parts("artist_name", manual)).alias("position", "name"))


FEATURED_STAGES, FEATURED_TABLE = sx.featured_stages("raw", "track_name", "feat")
FEATURED = ",\n".join(FEATURED_STAGES)


@query(
    "extract_featured",
    f"{WITH_RAW}, {FEATURED} SELECT source, record_id, clean_title, array_to_string(featured, '|') AS featured, is_live "
    f"FROM {FEATURED_TABLE}",
)
def _(spark, d):
    parts = text.split_featured("track_name")
    return t.raw_plays(spark, d).withColumn("f", parts).select(
        "source", "record_id", "f.clean_title", F.array_join("f.featured", "|").alias("featured"), "f.is_live"
    )


ALBUM = (
    f"stripped AS (SELECT *, {sx.strip_all('album_name', text.ALBUM_SUFFIXES)} AS s FROM raw WHERE album_name IS NOT NULL), "
    f"albums_clean AS (SELECT *, {sx.fold_capitals('s')} AS title FROM stripped)"
)
TRACK = (
    f"{FEATURED}, tstripped AS (SELECT *, {sx.strip_all('clean_title', text.TRACK_SUFFIXES)} AS ts_ FROM {FEATURED_TABLE} "
    f"WHERE track_name IS NOT NULL), tracks_clean AS (SELECT *, {sx.fold_capitals('ts_')} AS title FROM tstripped)"
)


@query("canonical_album_title", f"{WITH_RAW}, {ALBUM} SELECT source, record_id, title FROM albums_clean")
def _(spark, d):
    raw = t.raw_plays(spark, d).where("album_name is not null")
    return raw.select("source", "record_id", text.canonical_album("album_name").alias("title"))


@query("canonical_track_title", f"{WITH_RAW}, {TRACK} SELECT source, record_id, title FROM tracks_clean")
def _(spark, d):
    raw = t.raw_plays(spark, d).where("track_name is not null")
    return raw.select("source", "record_id", text.canonical_track("track_name").alias("title"))


@query("slug", f"SELECT doc_id, {sx.slug('text')} AS slug FROM documents")
def _(spark, d):
    return t.table(spark, d, "documents").select("doc_id", text.slug("text").alias("slug"))


# --- similarity --------------------------------------------------------------------------

NAME_PAIRS = f"""
names AS (SELECT p_name, min(p_partkey) AS id, {sx.matching_form('p_name')} AS form FROM part GROUP BY p_name),
coded AS MATERIALIZED (SELECT *, {sx.metaphone('form')} AS code FROM names),
pairs AS (SELECT a.p_name AS target, b.id AS candidate_id, b.p_name AS candidate, a.form AS a, b.form AS b, a.code AS ca, b.code AS cb
          FROM coded a JOIN coded b ON a.p_name <> b.p_name)"""
LEVENSHTEIN_RATIO = "round(1 - levenshtein(target, candidate)::DOUBLE / greatest(length(target), length(candidate)), 9)"
FUZZY = f"round({sx.fuzzy_score('a', 'b', 'ca', 'cb')}, 9)"
#: Names are matched from here on; well below the threshold for names of people and titles, as part names share words.
PART_THRESHOLD = 0.6


def _part_names(spark, d):
    return t.table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id"))


def _part_matches(spark, d, threshold=PART_THRESHOLD):
    """Different part names with a fuzzy score of at least the threshold."""
    names = cut_lineage(_part_names(spark, d))
    found = r.matches(names.select(F.col("p_name").alias("target")),
                      names.select(F.col("id").alias("candidate_id"), F.col("p_name").alias("candidate")), threshold)
    return found.where("target <> candidate")


def _levenshtein_pairs(spark, d):
    """Different names whose Levenshtein ratio is at least PART_THRESHOLD: 1 - e / longest >= t bounds the ratio of
    insertions and deletions, d <= 2 e, by 1 - 2 (1 - t) longest / (len a + len b) >= 1 - 2 (1 - t) / (1 + t), since the
    shorter one has at least t times the letters of the longer one. That ratio finds them, as similar_names does."""
    ratio = 1 - 2 * (1 - PART_THRESHOLD) / (1 + PART_THRESHOLD)
    return _part_matches(spark, d, ratio * 0.8 - 1e-9)


def _levenshtein_ratio():
    longest = F.greatest(F.length("target"), F.length("candidate"))
    return F.round(1 - F.levenshtein("target", "candidate") / longest, 9)


@query("fuzzy_score_levenshtein",
       f"WITH {NAME_PAIRS} SELECT target, candidate, {LEVENSHTEIN_RATIO} AS score FROM pairs WHERE {LEVENSHTEIN_RATIO} >= {PART_THRESHOLD}")
def _(spark, d):
    scored = _levenshtein_pairs(spark, d).select("target", "candidate", _levenshtein_ratio().alias("score"))
    return scored.where(F.col("score") >= PART_THRESHOLD)


@query("fuzzy_score", f"WITH {NAME_PAIRS} SELECT target, candidate, {FUZZY} AS score FROM pairs WHERE {FUZZY} >= {PART_THRESHOLD}")
def _(spark, d):
    return _part_matches(spark, d).select("target", "candidate", F.round("score", 9).alias("score"))


def _best_of(score):
    return f"""WITH {NAME_PAIRS}, s AS (SELECT *, {score} AS score FROM pairs)
    SELECT target, candidate_id, candidate, score FROM (SELECT *, row_number() OVER (
      PARTITION BY target ORDER BY score DESC, candidate_id) AS rn FROM s WHERE score >= {PART_THRESHOLD}) WHERE rn = 1"""


@query("best_match_levenshtein", _best_of(LEVENSHTEIN_RATIO))
def _(spark, d):
    return r.best_match(_levenshtein_pairs(spark, d).drop("score"), _levenshtein_ratio(), PART_THRESHOLD)


@query("best_match", _best_of(FUZZY))
def _(spark, d):
    return r.best_match(_part_matches(spark, d).drop("score"), F.round(similarity.fuzzy_score("target", "candidate"), 9), PART_THRESHOLD)


@query("metaphone", f"SELECT doc_id, {sx.metaphone('text')} AS code FROM documents")
def _(spark, d):
    return t.table(spark, d, "documents").select("doc_id", similarity.metaphone("text").alias("code"))


# --- distinct names ----------------------------------------------------------------------


@query("distinct_raw_artists", f"{WITH_RAW} SELECT DISTINCT artist_name FROM raw WHERE artist_name IS NOT NULL")
def _(spark, d):
    return r.distinct_raw_artists(t.raw_history(spark, d), t.raw_scrobbles(spark, d))


@query(
    "distinct_raw_albums",
    f"""{WITH_RAW} SELECT DISTINCT artist_name, album_name FROM raw
    WHERE artist_name IS NOT NULL AND album_name IS NOT NULL""",
)
def _(spark, d):
    return r.distinct_raw_albums(t.raw_history(spark, d), t.raw_scrobbles(spark, d))


@query(
    "distinct_raw_tracks",
    f"""{WITH_RAW} SELECT DISTINCT artist_name, coalesce(album_name, '') AS album_name, track_name FROM raw
    WHERE artist_name IS NOT NULL AND track_name IS NOT NULL""",
)
def _(spark, d):
    return r.distinct_raw_tracks(t.raw_history(spark, d), t.raw_scrobbles(spark, d))


# --- resolution: by slug alone it has a SQL equivalent ------------------------------------

ARTISTS_BY_SLUG = f"""
exploded AS (SELECT artist_name AS raw_name, CAST(i - 1 AS INTEGER) AS position, parts[i] AS name FROM (
  SELECT artist_name, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT DISTINCT artist_name, parts FROM parts))),
slugged AS (SELECT *, {sx.entity_slug('name')} AS slug FROM exploded),
artist_aliases AS (
  SELECT raw_name, position, name, slug,
         first_value(name) OVER w AS canonical,
         CASE WHEN row_number() OVER w = 1 THEN 'new_canonical' ELSE 'exact_match' END AS method
  FROM slugged WINDOW w AS (PARTITION BY slug ORDER BY encode(raw_name), position)),
first_alias AS (SELECT raw_name, slug AS artist FROM artist_aliases WHERE position = 0)"""
ALBUMS_BY_SLUG = f"""
{ALBUM},
album_names AS (SELECT DISTINCT artist_name, album_name, title, {sx.entity_slug('title')} AS slug FROM albums_clean
                WHERE artist_name IS NOT NULL),
album_aliases AS (
  SELECT artist_name, album_name, n.slug, artist, first_value(title) OVER w AS canonical,
         CASE WHEN row_number() OVER w = 1 THEN 'new_canonical' ELSE 'exact_match' END AS method
  FROM album_names n LEFT JOIN first_alias ON raw_name = artist_name
  WINDOW w AS (PARTITION BY artist, n.slug ORDER BY encode(artist_name), encode(album_name)))"""
TRACKS_BY_SLUG = f"""
{TRACK},
track_names AS (SELECT DISTINCT artist_name, coalesce(album_name, '') AS album_name, track_name, title,
                       {sx.entity_slug('title')} AS slug FROM tracks_clean WHERE artist_name IS NOT NULL),
album_first AS (SELECT album_name, artist, slug AS album FROM (
                  SELECT *, row_number() OVER (PARTITION BY album_name, artist ORDER BY encode(artist_name)) AS rn
                  FROM album_aliases) WHERE rn = 1),
track_aliases AS (
  SELECT artist_name, n.album_name, track_name, n.slug, f.artist, album, first_value(title) OVER w AS canonical,
         CASE WHEN row_number() OVER w = 1 THEN 'new_canonical' ELSE 'exact_match' END AS method
  FROM track_names n LEFT JOIN first_alias f ON raw_name = artist_name
       LEFT JOIN album_first b ON b.album_name = n.album_name AND b.artist = f.artist
  WINDOW w AS (PARTITION BY f.artist, n.slug ORDER BY encode(artist_name), encode(n.album_name), encode(track_name)))"""
BY_SLUG = ",".join([t.RAW_PLAYS, PARTS, ARTISTS_BY_SLUG, ALBUMS_BY_SLUG, TRACKS_BY_SLUG])


def _artists(spark, d, threshold):
    return r.resolve_artists(r.distinct_raw_artists(t.raw_plays(spark, d)), threshold)


def _albums(spark, d, aliases, threshold):
    return r.resolve_albums(r.distinct_raw_albums(t.raw_plays(spark, d)), aliases, threshold)


def _everything(spark, d, threshold):
    artists, artist_aliases = _artists(spark, d, threshold)
    albums, album_aliases = _albums(spark, d, artist_aliases, threshold)
    raw_tracks = r.distinct_raw_tracks(t.raw_plays(spark, d))
    tracks, track_aliases = r.resolve_tracks(raw_tracks, artist_aliases, album_aliases, threshold)
    return artists, artist_aliases, albums, album_aliases, tracks, track_aliases


@query(
    "resolve_artists_by_slug",
    f"WITH {t.RAW_PLAYS},{PARTS},{ARTISTS_BY_SLUG} SELECT raw_name, position, name, slug, canonical, method FROM artist_aliases",
)
def _(spark, d):
    artists, aliases = _artists(spark, d, None)
    named = aliases.join(artists.select("artist_id", F.col("name").alias("canonical")), "artist_id")
    return named.select("raw_name", "position", "name", "slug", "canonical", "method")


@query(
    "resolve_albums_by_slug",
    f"WITH {t.RAW_PLAYS},{PARTS},{ARTISTS_BY_SLUG},{ALBUMS_BY_SLUG} SELECT artist_name, album_name, slug, canonical, method "
    "FROM album_aliases",
)
def _(spark, d):
    albums, aliases = _albums(spark, d, _artists(spark, d, None)[1], None)
    named = aliases.join(albums.select("album_id", F.col("title").alias("canonical")), "album_id")
    return named.select("artist_name", "album_name", "slug", "canonical", "method")


@query(
    "resolve_tracks_by_slug",
    f"WITH {BY_SLUG} SELECT artist_name, album_name, track_name, slug, canonical, album IS NOT NULL AS has_album, method "
    "FROM track_aliases",
)
def _(spark, d):
    *_rest, tracks, aliases = _everything(spark, d, None)
    named = aliases.join(tracks.select("track_id", F.col("title").alias("canonical")), "track_id")
    return named.select(
        "artist_name", "album_name", "track_name", "slug", "canonical",
        F.col("album_id").isNotNull().alias("has_album"), "method",
    )


# With fuzzy matching: every pair of names of a scope is scored in SQL, and the names are read one after the other.
ARTISTS_FUZZY = f"""
exploded AS (SELECT artist_name AS raw_name, CAST(i - 1 AS INTEGER) AS position, parts[i] AS name FROM (
  SELECT artist_name, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT DISTINCT artist_name, parts FROM parts))),
artist_mentions AS MATERIALIZED (SELECT *, {sx.entity_slug('name')} AS slug, 1 AS scope, row_number() OVER (ORDER BY encode(raw_name), position) AS place
  FROM exploded),
{sx.election('artist', 'artist_mentions', r.FUZZY_THRESHOLD)},
artist_aliases AS MATERIALIZED (SELECT raw_name, position, name, slug, leader, confidence, CASE WHEN leader <> slug THEN 'fuzzy_match'
    WHEN row_number() OVER (PARTITION BY slug ORDER BY place) = 1 THEN 'new_canonical' ELSE 'exact_match' END AS method
  FROM artist_mentions JOIN artist_elected USING (scope, slug)),
artist_names AS (SELECT slug AS leader, name AS canonical FROM artist_aliases WHERE method = 'new_canonical'),
first_alias AS (SELECT raw_name, leader AS artist FROM artist_aliases WHERE position = 0)"""
ALBUMS_FUZZY = f"""
{ALBUM},
album_names AS (SELECT DISTINCT artist_name, album_name, title AS name, {sx.entity_slug('title')} AS slug FROM albums_clean
                WHERE artist_name IS NOT NULL),
album_mentions AS MATERIALIZED (SELECT n.*, artist AS scope, row_number() OVER (ORDER BY encode(artist_name), encode(album_name)) AS place
  FROM album_names n LEFT JOIN first_alias ON raw_name = artist_name),
{sx.election('album', 'album_mentions', r.FUZZY_THRESHOLD)},
album_aliases AS MATERIALIZED (SELECT artist_name, album_name, name, slug, scope AS artist, leader, confidence, CASE WHEN leader <> slug THEN 'fuzzy_match'
    WHEN row_number() OVER (PARTITION BY scope, slug ORDER BY place) = 1 THEN 'new_canonical' ELSE 'exact_match' END AS method
  FROM album_mentions JOIN album_elected USING (scope, slug))"""
TRACKS_FUZZY = f"""
{TRACK},
track_names AS (SELECT DISTINCT artist_name, coalesce(album_name, '') AS album_name, track_name, title AS name,
                       {sx.entity_slug('title')} AS slug FROM tracks_clean WHERE artist_name IS NOT NULL),
album_first AS (SELECT album_name, artist, leader AS album FROM album_aliases
  QUALIFY row_number() OVER (PARTITION BY album_name, artist ORDER BY encode(artist_name)) = 1),
track_mentions AS MATERIALIZED (SELECT n.*, artist AS scope,
    row_number() OVER (ORDER BY encode(artist_name), encode(n.album_name), encode(track_name)) AS place
  FROM track_names n LEFT JOIN first_alias ON raw_name = artist_name),
{sx.election('track', 'track_mentions', r.FUZZY_THRESHOLD)},
track_aliases AS MATERIALIZED (SELECT artist_name, m.album_name, track_name, name, m.slug, m.scope AS artist, leader, confidence, album,
    CASE WHEN leader <> m.slug THEN 'fuzzy_match'
    WHEN row_number() OVER (PARTITION BY m.scope, m.slug ORDER BY place) = 1 THEN 'new_canonical' ELSE 'exact_match' END AS method
  FROM track_mentions m JOIN track_elected e ON e.scope = m.scope AND e.slug = m.slug
       LEFT JOIN album_first b ON b.album_name = m.album_name AND b.artist = m.scope)"""
ARTISTS_RESOLVED = ",".join([t.RAW_PLAYS, PARTS, ARTISTS_FUZZY])
ALBUMS_RESOLVED = ",".join([ARTISTS_RESOLVED, ALBUMS_FUZZY])
RESOLVED = ",".join([ALBUMS_RESOLVED, TRACKS_FUZZY])


def _slugs(dimension, id_column, name):
    return dimension.select(id_column, F.col("slug").alias(name))


@query(
    "resolve_artists",
    f"""WITH {ARTISTS_RESOLVED} SELECT raw_name, position, name, canonical, round(confidence, 9) AS confidence, method
    FROM artist_aliases JOIN artist_names USING (leader)""",
)
def _(spark, d):
    artists, aliases = _artists(spark, d, r.FUZZY_THRESHOLD)
    named = aliases.join(artists.select("artist_id", F.col("name").alias("canonical")), "artist_id")
    return named.select("raw_name", "position", "name", "canonical", F.round("confidence", 9).alias("confidence"), "method")


@query(
    "resolve_albums",
    f"""WITH {ALBUMS_RESOLVED} SELECT artist_name, album_name, slug, artist, leader AS album, round(confidence, 9) AS confidence, method
    FROM album_aliases""",
)
def _(spark, d):
    artists, artist_aliases = _artists(spark, d, r.FUZZY_THRESHOLD)
    albums, aliases = _albums(spark, d, artist_aliases, r.FUZZY_THRESHOLD)
    named = aliases.join(_slugs(artists, "artist_id", "artist"), "artist_id").join(_slugs(albums, "album_id", "album"), "album_id")
    return named.select("artist_name", "album_name", "slug", "artist", "album", F.round("confidence", 9).alias("confidence"), "method")


@query(
    "resolve_tracks",
    f"""WITH {RESOLVED} SELECT artist_name, album_name, track_name, slug, artist, leader AS track, album, round(confidence, 9) AS confidence,
    method FROM track_aliases""",
)
def _(spark, d):
    artists, _aa, albums, _ba, tracks, aliases = _everything(spark, d, r.FUZZY_THRESHOLD)
    named = (aliases.join(_slugs(artists, "artist_id", "artist"), "artist_id").join(_slugs(tracks, "track_id", "track"), "track_id")
             .join(_slugs(albums, "album_id", "album"), "album_id", "left"))
    return named.select("artist_name", "album_name", "track_name", "slug", "artist", "track", "album",
                        F.round("confidence", 9).alias("confidence"), "method")


@query(
    "ambiguous_matches",
    f"""WITH {ARTISTS_RESOLVED} SELECT raw_name, name, canonical AS match, round(confidence, 9) AS confidence
    FROM artist_aliases JOIN artist_names USING (leader) WHERE method = 'fuzzy_match' AND confidence < {r.AMBIGUOUS_BELOW}""",
)
def _(spark, d):
    artists, aliases = _artists(spark, d, r.FUZZY_THRESHOLD)
    named = r.ambiguous_matches(aliases).join(artists.select("artist_id", F.col("name").alias("match")), "artist_id")
    return named.select("raw_name", "name", "match", F.round("confidence", 9).alias("confidence"))


@query(
    "resolution_stats",
    f"""WITH {RESOLVED}, s AS (
      SELECT 'artists' AS kind, (SELECT count(DISTINCT artist_name) FROM raw) AS processed, method, confidence FROM artist_aliases
      UNION ALL SELECT 'albums', (SELECT count(*) FROM album_names), method, confidence FROM album_aliases
      UNION ALL SELECT 'tracks', (SELECT count(*) FROM track_names), method, confidence FROM track_aliases)
    SELECT kind, processed, count(*) FILTER (method = 'new_canonical') AS canonical_created,
           count(*) AS aliases_created, count(*) FILTER (method = 'fuzzy_match' AND confidence < {r.AMBIGUOUS_BELOW}) AS ambiguous_matches
    FROM s GROUP BY ALL""",
)
def _(spark, d):
    raw = t.raw_plays(spark, d)
    _a, artist_aliases, _b, album_aliases, _t, track_aliases = _everything(spark, d, r.FUZZY_THRESHOLD)
    return (
        r.resolution_stats("artists", r.distinct_raw_artists(raw), artist_aliases)
        .unionByName(r.resolution_stats("albums", r.distinct_raw_albums(raw), album_aliases))
        .unionByName(r.resolution_stats("tracks", r.distinct_raw_tracks(raw), track_aliases))
    )


LINKED = """
choice AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_name, artist ORDER BY album IS NULL,
             encode(artist_name), encode(album_name)) AS rn FROM track_aliases WHERE artist IS NOT NULL) WHERE rn = 1),
linked AS (SELECT raw.source, raw.record_id, raw.ts, raw.duration_ms, raw.country, c.artist AS artist_slug,
                  c.album AS album_slug, c.leader AS track_slug
           FROM raw JOIN first_alias f ON f.raw_name = raw.artist_name
                JOIN choice c ON c.track_name = raw.track_name AND c.artist = f.artist)"""


@query(
    "link_plays",
    f"""WITH {RESOLVED},{LINKED} SELECT source, record_id, epoch_us(ts) AS us, duration_ms, artist_slug, album_slug,
    track_slug FROM linked""",
)
def _(spark, d):
    artists, artist_aliases, albums, _album_aliases, tracks, track_aliases = _everything(spark, d, r.FUZZY_THRESHOLD)
    linked = r.link_plays(t.raw_plays(spark, d), artist_aliases, track_aliases)
    return (
        linked.join(artists.select("artist_id", F.col("slug").alias("artist_slug")), "artist_id")
        .join(albums.select("album_id", F.col("slug").alias("album_slug")), "album_id", "left")
        .join(tracks.select("track_id", F.col("slug").alias("track_slug")), "track_id")
        .select("source", "record_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "duration_ms",
                "artist_slug", "album_slug", "track_slug")
    )


@query(
    "link_plays_again",
    f"WITH {RESOLVED},{LINKED} SELECT source, record_id FROM linked WHERE source = 'lastfm'",
)
def _(spark, d):
    """A second run links only what is new: history is linked first, scrobbles arrive later."""
    _artists_, artist_aliases, *_rest, track_aliases = _everything(spark, d, r.FUZZY_THRESHOLD)
    first = r.link_plays(t.raw_history(spark, d), artist_aliases, track_aliases)
    again = r.link_plays(t.raw_plays(spark, d), artist_aliases, track_aliases, first)
    return again.select("source", "record_id")


@query(
    "backfill_location",
    f"""{WITH_RAW} SELECT source, record_id, country FROM raw""",
)
def _(spark, d):
    raw = t.raw_plays(spark, d)
    plays = raw.withColumn("country", F.when(F.col("record_id") % 3 == 0, F.col("country")))
    return r.backfill_location(plays, raw).select("source", "record_id", "country")
