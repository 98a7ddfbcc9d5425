"""Registered encyclopedia queries. The encyclopedia is derived from the same tables, with gaps and other spellings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklore.catalog import sql_text as sx
from tracklore.catalog import tables as t
from tracklore.catalog.registry import query
from tracklore.operators import enrich as e
from tracklore.session import scratch_path
from tracklore.sources import encyclopedia as x

# Statements below run in both engines; the placeholders differ: list building, lambdas and number formats.
TAGS = {
    "duck": "list_transform(range(1, 2 + {key} % 14), lambda i: {{'name': CASE WHEN i = 3 THEN '' ELSE concat(CASE WHEN i % 2 = 0 "
            "THEN 'tag ' ELSE 'Tag ' END, ({key} + i) % 30) END, 'count': i}})",
    "spark": "transform(sequence(1L, 1 + {key} % 14), i -> named_struct('name', CASE WHEN i = 3 THEN '' ELSE concat(CASE WHEN "
             "i % 2 = 0 THEN 'tag ' ELSE 'Tag ' END, ({key} + i) % 30) END, 'count', i))",
}
PADDED = {"duck": "format('Customer#{{:09d}}', {key})", "spark": "format_string('Customer#%09d', {key})"}
CREDIT = {
    "duck": "[{{'name': {name}, 'artist': {{'id': 'x', 'name': {name}}}}}]",
    "spark": "array(named_struct('name', {name}, 'artist', named_struct('id', 'x', 'name', {name})))",
}


def _tables(engine: str) -> dict[str, str]:
    def tags(key):
        return TAGS[engine].format(key=key)

    def credit(name):
        return CREDIT[engine].format(name=name)

    def padded(key):
        return PADDED[engine].format(key=key)

    if engine == "duck":
        def release(p, n, kind):
            return (f"{{'id': concat('rel-{n}-', {p}), 'title': concat('Album ', {p} % 50), 'date': concat(1980 + {p} % 40, '-01-0{n}'), "
                    f"'release-group': {{'id': CASE WHEN {p} % 4 <> 0 THEN concat('rg-', {p} % 300) END, 'title': concat('Album ', {p} % 50), "
                    f"'primary-type': {kind}}}}}")
        releases = "[" + release("p_partkey", 1, "CASE WHEN p_partkey % 2 = 0 THEN 'Album' ELSE 'Single' END") + ", " + release(
            "p_partkey", 2, "'Album'") + "]"
    else:
        def release(p, n, kind):
            return (f"named_struct('id', concat('rel-{n}-', {p}), 'title', concat('Album ', {p} % 50), 'date', concat(1980 + {p} % 40, '-01-0{n}'), "
                    f"'release-group', named_struct('id', CASE WHEN {p} % 4 <> 0 THEN concat('rg-', {p} % 300) END, 'title', "
                    f"concat('Album ', {p} % 50), 'primary-type', {kind}))")
        releases = "array(" + release("p_partkey", 1, "CASE WHEN p_partkey % 2 = 0 THEN 'Album' ELSE 'Single' END") + ", " + release(
            "p_partkey", 2, "'Album'") + ")"
    return {
        "our_artists": f"""SELECT c_custkey AS artist_id,
            CASE WHEN c_custkey % 25 = 7 THEN {padded('c_custkey - 6')} ELSE c_name END AS name,
            CASE WHEN c_custkey % 10 = 1 THEN concat('mb-', c_custkey) END AS mbid,
            CASE WHEN c_custkey % 3 = 0 THEN n_name END AS country,
            CASE WHEN c_custkey % 4 = 0 THEN 'Person' END AS artist_type
            FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey""",
        "dump_artists": f"""SELECT concat('mb-', c_custkey) AS id,
            CASE c_custkey % 8 WHEN 0 THEN upper(c_name) WHEN 2 THEN concat(c_name, ' Band')
                 WHEN 3 THEN concat('Nobody ', c_custkey) WHEN 6 THEN concat(c_name, ' Orchestra of the Valley')
                 ELSE c_name END AS name,
            lower(c_name) AS sort_name, CASE WHEN c_custkey % 5 <> 0 THEN n_name END AS country,
            CASE WHEN c_mktsegment = 'BUILDING' THEN 'Group' ELSE 'Person' END AS type,
            CASE WHEN c_custkey % 6 = 0 THEN 'the other one' END AS disambiguation, {tags('c_custkey')} AS tags
            FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey""",
        "our_albums": """SELECT s_suppkey AS album_id, s_name AS title, replace(lower(s_name), '#', '-') AS slug,
            CAST(s_nationkey AS BIGINT) AS artist_id, CASE WHEN s_suppkey % 2 = 0 THEN concat('rg-', s_suppkey) END AS mbid,
            CASE WHEN s_suppkey % 5 = 0 THEN '1999-01-01' END AS release_date FROM {supplier}""",
        "dump_groups": f"""SELECT concat('rg-', s_suppkey) AS id, upper(s_name) AS title, 'Album' AS primary_type,
            CASE WHEN s_suppkey % 3 <> 0 THEN concat(2000 + s_suppkey % 20, '-05-05') END AS first_release_date,
            {credit("concat('Band ', s_nationkey)")} AS artist_credit, {tags('s_suppkey')} AS tags FROM {{supplier}}""",
        "our_tracks": """SELECT p_partkey AS track_id, p_name AS title, p_partkey AS artist_id,
            CASE WHEN p_size > 40 THEN CAST(p_size AS BIGINT) END AS album_id,
            CAST(NULL AS VARCHAR(9)) AS recording_mbid FROM {part}""",
        "dump_recordings": f"""SELECT concat('rec-', p_partkey) AS id, upper(p_name) AS title,
            CAST(p_size * 1000 AS BIGINT) AS length,
            {credit(f"CASE p_partkey % 3 WHEN 0 THEN {padded('p_partkey')} WHEN 1 THEN concat({padded('p_partkey')}, ' Jr') ELSE 'Someone' END")}
            AS artist_credit, CASE WHEN p_partkey % 7 <> 0 THEN {releases} END AS releases FROM {{part}}""",
    }


BASE = ["customer", "nation", "supplier", "part"]


def _plain(sql: str) -> str:
    for name in BASE:
        sql = sql.replace("{" + name + "}", name)
    return sql


CTES = ",\n".join(f"{name} AS ({_plain(sql)})" for name, sql in _tables("duck").items())
MB = f"""{CTES},
mb_artists AS (SELECT id AS mbid, name, country, type, disambiguation, tags FROM dump_artists),
score AS (
  SELECT a.name, m.mbid, m.name AS found, least(2.0::DOUBLE * length(a.name) / (length(a.name) + length(m.name))
           * (CASE WHEN coalesce(disambiguation, '') <> '' THEN 0.95::DOUBLE ELSE 1.0::DOUBLE END)
           * (CASE WHEN type = 'Group' THEN 1.02::DOUBLE ELSE 1.0::DOUBLE END), 1.0::DOUBLE) AS confidence,
         lower(a.name) = lower(m.name) AS exact
  FROM (SELECT DISTINCT name FROM our_artists WHERE mbid IS NULL) a
       JOIN mb_artists m ON contains(lower(m.name), lower(a.name))),
exact_hit AS (SELECT name, min(mbid) AS mbid FROM score WHERE exact GROUP BY 1),
close AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY length(found), mbid) AS place FROM score
          WHERE name NOT IN (SELECT name FROM exact_hit)) WHERE place <= 5),
matches AS (SELECT name, mbid, confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY confidence DESC, mbid) AS rn FROM (
    SELECT name, mbid, confidence FROM score WHERE exact
    UNION ALL SELECT name, mbid, confidence FROM close)) WHERE rn = 1 AND confidence >= 0.8),
found AS (SELECT artist_id, m.mbid AS new_mbid FROM our_artists a JOIN matches m ON m.name = a.name WHERE a.mbid IS NULL),
matched AS (SELECT artist_id, mbid AS new_mbid FROM our_artists
            WHERE mbid IS NOT NULL AND (country IS NULL OR artist_type IS NULL) UNION ALL SELECT * FROM found),
allowed AS (SELECT artist_id, new_mbid FROM matched LEFT JOIN (
              SELECT mbid AS new_mbid, artist_id AS owner FROM our_artists WHERE mbid IS NOT NULL) USING (new_mbid)
            LEFT JOIN (SELECT new_mbid, min(artist_id) AS f FROM found GROUP BY 1) USING (new_mbid)
            WHERE artist_id = coalesce(owner, f)),
enriched AS (SELECT a.artist_id, a.name, coalesce(a.mbid, new_mbid) AS mbid, coalesce(a.country, m.country) AS country,
                    coalesce(a.artist_type, m.type) AS artist_type
             FROM our_artists a LEFT JOIN allowed w ON w.artist_id = a.artist_id LEFT JOIN mb_artists m ON m.mbid = new_mbid)"""


def _tag_sql(owners: str, key: str, keep: int) -> str:
    return f"""SELECT {key}, tag, name, score FROM (
      SELECT *, row_number() OVER (PARTITION BY {key}, tag ORDER BY place) AS rn FROM (
        SELECT {key}, place, tags[place].name AS name, tags[place].count AS score, lower(trim(tags[place].name)) AS tag
        FROM (SELECT {key}, tags, unnest(range(1, least(len(tags), {keep}) + 1)) AS place FROM {owners}))
      WHERE name <> '') WHERE rn = 1"""


ARTIST_TAGS = _tag_sql("(SELECT artist_id, tags FROM matched JOIN mb_artists ON mbid = new_mbid)", "artist_id", 10)


def _derived(spark, d, name):
    sql = _tables("spark")[name].replace("VARCHAR(9)", "STRING")
    used = [b for b in BASE if "{" + b + "}" in sql]
    return spark.sql(sql, **{b: t.table(spark, d, b) for b in used})


def _dump(spark, d, name):
    """Derived rows under the dump's own field names."""
    renames = {
        "sort_name": "sort-name", "primary_type": "primary-type", "first_release_date": "first-release-date",
        "artist_credit": "artist-credit",
    }
    return _derived(spark, d, name).withColumnsRenamed(renames)


def _mb_artists(spark, d):
    return x.artist_table(_dump(spark, d, "dump_artists"))


def _mb_groups(spark, d):
    return x.release_group_table(_dump(spark, d, "dump_groups"))


def _mb_recordings(spark, d):
    return x.recording_table(_dump(spark, d, "dump_recordings"))


def _artists(spark, d):
    return _derived(spark, d, "our_artists")


# --- reading the dump --------------------------------------------------------------------


def _tag_text(column="tags"):
    return F.array_join(F.transform(column, lambda g: F.concat(g["name"], F.lit("="), g["count"])), "|")


TAG_TEXT = "array_to_string(list_transform(tags, lambda g: concat(g.name, '=', g.count)), '|')"


@query("scan_jsonl_encyclopedia", f"WITH {CTES} SELECT id AS mbid, name, sort_name, country, type, disambiguation FROM dump_artists")
def _(spark, d):
    """Writes a dump with broken lines, rows without a name and repeated ids, and reads it back."""
    rows = _dump(spark, d, "dump_artists")
    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    good = rows.select(line.alias("value"))
    path = scratch_path(spark, "dump")
    again = rows.select(F.to_json(F.struct("id", F.lit("zz later").alias("name"))).alias("value"))
    broken = rows.select(F.concat(F.lit('{"id": "'), "id", F.lit('", "name": ')).alias("value"))
    unnamed = rows.select(F.concat(F.lit('{"id": "x'), "id", F.lit('"}')).alias("value"))
    good.unionByName(broken).unionByName(unnamed).unionByName(again).coalesce(1).write.text(path)
    table = x.read_dump(spark, path, "artist")
    return table.select("mbid", "name", "sort_name", "country", "type", "disambiguation")


@query(
    "transform_mb_artist",
    f"WITH {CTES} SELECT id AS mbid, name, sort_name, country, type, disambiguation, {TAG_TEXT} AS tags FROM dump_artists",
)
def _(spark, d):
    return _mb_artists(spark, d).withColumn("tags", _tag_text())


@query(
    "transform_mb_release_group",
    f"""WITH {CTES} SELECT id AS mbid, title, primary_type AS type, first_release_date,
    artist_credit[1].artist.name AS credit, {TAG_TEXT} AS tags FROM dump_groups""",
)
def _(spark, d):
    return _mb_groups(spark, d).select(
        "mbid", "title", "type", "first_release_date", F.col("artist_credit")[0]["artist"]["name"].alias("credit"),
        _tag_text().alias("tags"),
    )


@query(
    "transform_mb_recording",
    f"""WITH {CTES} SELECT id AS mbid, title, length AS length_ms, coalesce(len(releases), 0)::INTEGER AS n,
    releases[2].id AS release_mbid, releases[2]."release-group".id AS release_group_mbid,
    releases[1]."release-group"."primary-type" AS first_type, releases[1].date AS first_date FROM dump_recordings""",
)
def _(spark, d):
    releases = F.col("releases")
    return _mb_recordings(spark, d).select(
        "mbid", "title", "length_ms", F.coalesce(F.size(F.filter(releases, lambda r: F.lit(True))), F.lit(0)).alias("n"),
        F.get(releases, F.lit(1))["release_mbid"].alias("release_mbid"),
        F.get(releases, F.lit(1))["release_group_mbid"].alias("release_group_mbid"),
        F.get(releases, F.lit(0))["release_group_type"].alias("first_type"),
        F.get(releases, F.lit(0))["date"].alias("first_date"),
    )


@query(
    "import_status",
    f"""WITH {CTES} SELECT 'artist' AS entity_type, DATE '2024-01-01' AS imported_at, count(*) AS record_count FROM dump_artists
    UNION ALL SELECT 'release-group', DATE '2024-01-01', count(*) FROM dump_groups
    UNION ALL SELECT 'recording', DATE '2024-01-01', count(*) FROM dump_recordings""",
)
def _(spark, d):
    tables = {"artist": _mb_artists(spark, d), "release-group": _mb_groups(spark, d), "recording": _mb_recordings(spark, d)}
    return x.import_status(tables, F.to_date(F.lit("2024-01-01")))


# --- candidates and lookups --------------------------------------------------------------


@query(
    "enrich_candidates",
    f"""WITH {CTES} SELECT 'artist' AS kind, artist_id AS id FROM our_artists
      WHERE mbid IS NULL OR country IS NULL OR artist_type IS NULL
    UNION ALL SELECT 'album', album_id FROM our_albums WHERE mbid IS NULL OR release_date IS NULL
    UNION ALL SELECT 'track', track_id FROM our_tracks t JOIN our_artists a ON a.artist_id = t.artist_id WHERE album_id IS NULL""",
)
def _(spark, d):
    artists = _artists(spark, d)
    found = {
        "artist": e.artist_candidates(artists).select(F.col("artist_id").alias("id")),
        "album": e.album_candidates(_derived(spark, d, "our_albums")).select(F.col("album_id").alias("id")),
        "track": e.track_candidates(_derived(spark, d, "our_tracks"), artists).select(F.col("track_id").alias("id")),
    }
    rows = [df.select(F.lit(kind).alias("kind"), "id") for kind, df in found.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    "enrich_candidates_first_50",
    f"""WITH {CTES} SELECT artist_id FROM our_artists WHERE mbid IS NULL OR country IS NULL OR artist_type IS NULL
    ORDER BY artist_id LIMIT 50""",
)
def _(spark, d):
    return e.artist_candidates(_artists(spark, d), 50).select("artist_id")


@query("lookup_artist_exact", f"WITH {MB} SELECT * FROM exact_hit")
def _(spark, d):
    names = _artists(spark, d).where("mbid is null").select("name").distinct()
    return e.lookup_artist_exact(names, _mb_artists(spark, d))


@query("lookup_artist_contains", f"WITH {MB} SELECT name, mbid, found AS found_name, CAST(place AS INTEGER) AS place FROM close")
def _(spark, d):
    names = _artists(spark, d).where("mbid is null").select("name").distinct()
    return e.lookup_artist_contains(names, _mb_artists(spark, d))


@query("lookup_by_mbid", f"WITH {MB} SELECT artist_id, mbid, m.name AS found FROM our_artists JOIN mb_artists m USING (mbid)")
def _(spark, d):
    wanted = _artists(spark, d).select("artist_id", "mbid")
    return e.lookup_by_mbid(wanted, _mb_artists(spark, d)).select("artist_id", "mbid", F.col("name").alias("found"))


@query(
    "lookup_release_group",
    f"""WITH {CTES}, asked AS (SELECT title, CASE WHEN album_id % 2 = 0 THEN concat('and ', artist_id) END AS artist_name
      FROM our_albums)
    SELECT a.title, a.artist_name, min(id) AS mbid FROM asked a JOIN dump_groups g ON lower(g.title) = lower(a.title)
      AND (a.artist_name IS NULL OR contains(lower(artist_credit[1].artist.name), lower(a.artist_name))) GROUP BY 1, 2""",
)
def _(spark, d):
    asked = _derived(spark, d, "our_albums").select(
        "title", F.when(F.col("album_id") % 2 == 0, F.concat(F.lit("and "), "artist_id")).alias("artist_name")
    )
    return e.lookup_titled(asked, _mb_groups(spark, d))


RECORDING = f"""
asked AS (SELECT DISTINCT t.title, a.name AS artist_name FROM our_tracks t JOIN our_artists a ON a.artist_id = t.artist_id
          WHERE t.album_id IS NULL),
credits AS (SELECT id AS mbid, lower(title) AS title, lower(artist_credit[1].artist.name) AS credit, releases FROM dump_recordings),
rec AS (SELECT title, artist_name, mbid FROM (
  SELECT a.title, a.artist_name, c.mbid, row_number() OVER (PARTITION BY a.title, a.artist_name
           ORDER BY credit <> lower(artist_name), mbid) AS rn
  FROM asked a JOIN credits c ON c.title = lower(a.title) AND contains(credit, lower(a.artist_name))) WHERE rn = 1),
rec_score AS (SELECT a.title, a.artist_name, c.mbid AS recording_mbid, releases,
    least((1.0::DOUBLE * 0.6::DOUBLE + 2.0::DOUBLE * length(artist_name) / (length(artist_name) + length(credit)) * 0.4::DOUBLE)
      * 1.05::DOUBLE, 1.0::DOUBLE) AS confidence
  FROM asked a JOIN credits c ON c.title = lower(a.title) AND contains(credit, lower(a.artist_name)) AND len(releases) > 0),
rec_best AS (SELECT title, artist_name, recording_mbid, confidence,
    coalesce(list_filter(releases, lambda r: r."release-group"."primary-type" = 'Album')[1], releases[1]) AS release
  FROM (SELECT * FROM rec_score QUALIFY row_number() OVER (PARTITION BY title, artist_name
    ORDER BY confidence DESC, recording_mbid) = 1) WHERE confidence >= 0.7)"""


@query("lookup_recording", f"WITH {MB},{RECORDING} SELECT * FROM rec")
def _(spark, d):
    asked = e.track_candidates(_derived(spark, d, "our_tracks"), _artists(spark, d))
    return e.lookup_titled(asked, _mb_recordings(spark, d))


@query("score_artist_match", f"WITH {MB} SELECT name, mbid, round(confidence, 9) AS confidence FROM matches")
def _(spark, d):
    names = _artists(spark, d).where("mbid is null").select("name").distinct()
    scored = e.score_artist_matches(names, _mb_artists(spark, d))
    return scored.withColumn("confidence", F.round("confidence", 9))


@query(
    "score_recording_match",
    f"""WITH {MB},{RECORDING} SELECT title, artist_name, recording_mbid, round(confidence, 9) AS confidence,
    release.id AS release_mbid FROM rec_best""",
)
def _(spark, d):
    asked = e.track_candidates(_derived(spark, d, "our_tracks"), _artists(spark, d))
    return e.score_recording_matches(asked, _mb_recordings(spark, d)).select(
        "title", "artist_name", "recording_mbid", F.round("confidence", 9).alias("confidence"), "release.release_mbid"
    )


# --- jobs --------------------------------------------------------------------------------


@query("enrich_artists", f"WITH {MB} SELECT * FROM enriched")
def _(spark, d):
    return e.enrich_artists(_artists(spark, d), _mb_artists(spark, d))[0]


@query("enrich_artist_tags", f"WITH {MB} {ARTIST_TAGS}")
def _(spark, d):
    return e.enrich_artists(_artists(spark, d), _mb_artists(spark, d))[1].select("artist_id", "tag", "name", "score")


@query(
    "enrich_albums",
    f"""WITH {CTES} SELECT album_id, title, slug, artist_id, mbid, CASE WHEN mbid IS NOT NULL AND release_date IS NULL
    THEN first_release_date ELSE release_date END AS release_date
    FROM our_albums a LEFT JOIN (SELECT id, first_release_date FROM dump_groups) g ON g.id = a.mbid""",
)
def _(spark, d):
    return e.enrich_albums(_derived(spark, d, "our_albums"), _mb_groups(spark, d))[0]


@query(
    "enrich_album_tags",
    f"WITH {CTES} " + _tag_sql(
        "(SELECT album_id, tags FROM our_albums a JOIN dump_groups g ON g.id = a.mbid WHERE release_date IS NULL)", "album_id", 10
    ),
)
def _(spark, d):
    tags = e.enrich_albums(_derived(spark, d, "our_albums"), _mb_groups(spark, d))[1]
    return tags.select("album_id", "tag", "name", "score")


MISSING = f"""{RECORDING},
todo AS (SELECT track_id, t.title, a.artist_id, a.name AS artist_name FROM our_tracks t JOIN our_artists a ON a.artist_id = t.artist_id
         WHERE album_id IS NULL),
mfound AS (SELECT track_id, artist_id, recording_mbid, release.title AS album_title, release."release-group".id AS rg,
                  release.date AS release_date, {sx.slug('release.title')} AS album_slug
           FROM todo JOIN rec_best USING (title, artist_name)),
mplaced AS (SELECT m.*, coalesce(g.album_id, s.album_id) AS existing,
                   coalesce(rg, concat(m.artist_id, '/', album_slug)) AS fresh
            FROM mfound m LEFT JOIN (SELECT mbid, min(album_id) AS album_id FROM our_albums WHERE mbid IS NOT NULL GROUP BY 1) g
                 ON g.mbid = rg
                 LEFT JOIN (SELECT slug, artist_id, min(album_id) AS album_id FROM our_albums GROUP BY 1, 2) s
                 ON s.slug = album_slug AND s.artist_id = m.artist_id)"""


def _missing(spark, d):
    return e.find_missing_albums(
        _derived(spark, d, "our_tracks"), _artists(spark, d), _derived(spark, d, "our_albums"), _mb_recordings(spark, d)
    )


@query("find_missing_albums", f"WITH {MB},{MISSING} SELECT track_id, recording_mbid, existing FROM mplaced")
def _(spark, d):
    updates, created = _missing(spark, d)
    fresh = created.select("album_id", F.lit(True).alias("fresh"))
    existing = F.when(F.col("fresh").isNull(), F.col("album_id"))
    return updates.join(fresh, "album_id", "left").select("track_id", "recording_mbid", existing.alias("existing"))


@query(
    "find_missing_albums_created",
    f"""WITH {MB},{MISSING} SELECT album_title AS title, album_slug AS slug, artist_id, rg AS mbid, release_date FROM (
      SELECT *, row_number() OVER (PARTITION BY fresh ORDER BY track_id) AS rn FROM mplaced WHERE existing IS NULL) WHERE rn = 1""",
)
def _(spark, d):
    return _missing(spark, d)[1].drop("album_id")


TAGGED = "artist_id % 2 = 0"


@query(
    "enrich_genres",
    f"WITH {MB} " + _tag_sql(
        f"(SELECT artist_id, tags FROM enriched JOIN mb_artists USING (mbid) WHERE artist_id NOT IN ("
        f"SELECT artist_id FROM ({ARTIST_TAGS}) WHERE {TAGGED}))", "artist_id", 15,
    ),
)
def _(spark, d):
    """Tags of every second artist were lost; they come back from the encyclopedia, up to fifteen each."""
    artists, tags = e.enrich_artists(_artists(spark, d), _mb_artists(spark, d))
    found = e.enrich_genres(artists, tags.where(TAGGED), _mb_artists(spark, d))
    return found.select("artist_id", "tag", "name", "score")


@query("tag_dim", f"WITH {MB}, a AS ({ARTIST_TAGS}) SELECT tag, arg_min(name, (artist_id * 100 + score)) AS name FROM a GROUP BY 1")
def _(spark, d):
    tags = e.enrich_artists(_artists(spark, d), _mb_artists(spark, d))[1]
    return e.tag_dim(tags, ["artist_id", "score"])


MAPPING = "CASE CAST(split_part(tag, ' ', 2) AS INTEGER) % 4 WHEN 0 THEN 'rock' WHEN 1 THEN 'jazz' WHEN 2 THEN 'folk' END"


@query(
    "artist_genres",
    f"""WITH {MB}, a AS ({ARTIST_TAGS}), m AS (SELECT DISTINCT tag, {MAPPING} AS genre, {MAPPING} = 'rock' AS is_primary FROM a)
    SELECT artist_id, genre, max(score) AS score, max(is_primary) AS is_primary FROM a JOIN m USING (tag)
    WHERE genre IS NOT NULL GROUP BY 1, 2""",
)
def _(spark, d):
    tags = e.enrich_artists(_artists(spark, d), _mb_artists(spark, d))[1]
    genre = F.expr(MAPPING)
    mapping = tags.select("tag", genre.alias("genre"), (genre == "rock").alias("is_primary")).distinct()
    return e.artist_genres(tags, mapping.where("genre is not null"))


# --- cache and status --------------------------------------------------------------------

CACHE = """
cache AS (SELECT 'artist' AS entity_type, CAST(user_id AS VARCHAR) AS entity_id,
                 sha256(concat_ws(':', 'artist', CAST(user_id AS VARCHAR), event_type)) AS params_hash,
                 concat('r', event_id) AS response_json, ts AS fetched_at, ts + INTERVAL 10 DAY AS expires_at, event_id FROM events),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_type, entity_id, params_hash
             ORDER BY fetched_at DESC, response_json DESC) AS rn FROM cache) WHERE rn = 1)"""


def _cache(spark, d):
    ev = t.table(spark, d, "events")
    entity = F.lit("artist")
    owner = F.col("user_id").cast("string")
    return ev.select(
        entity.alias("entity_type"), owner.alias("entity_id"),
        e.cache_key(entity, owner, F.col("event_type")).alias("params_hash"),
        F.concat(F.lit("r"), "event_id").alias("response_json"), F.col("ts").cast("timestamp").alias("fetched_at"),
        (F.col("ts") + F.expr("INTERVAL 10 DAYS")).cast("timestamp").alias("expires_at"),
    )


@query("cache_upsert", f"WITH {CACHE} SELECT entity_id, params_hash, response_json FROM latest")
def _(spark, d):
    cache = _cache(spark, d)
    early = F.col("fetched_at") < F.lit("2024-01-20").cast("timestamp")
    stored = e.cache_upsert(cache.where("false"), cache.where(early).drop("expires_at"))
    return e.cache_upsert(stored, cache.where(~early).drop("expires_at")).select("entity_id", "params_hash", "response_json")


@query(
    "cache_lookup_ttl",
    f"""WITH {CACHE} SELECT entity_id, params_hash, CASE WHEN expires_at >= TIMESTAMP '2024-02-05 00:00:00' THEN response_json END
    AS response_json, expires_at >= TIMESTAMP '2024-02-05 00:00:00' AS hit FROM latest""",
)
def _(spark, d):
    from tracklore.operators.skew import first_per_key

    keys = ["entity_type", "entity_id", "params_hash"]
    cache = first_per_key(_cache(spark, d), keys, [F.desc("fetched_at"), F.desc("response_json")])
    found = e.cache_lookup(cache.select(keys), cache, F.to_timestamp(F.lit("2024-02-05 00:00:00")))
    return found.select("entity_id", "params_hash", "response_json", "hit")


@query(
    "enrichment_status",
    f"""WITH {MB}, a AS ({ARTIST_TAGS}), {CACHE},
    c AS (SELECT count(*) AS n, count(mbid) AS m FROM enriched), b AS (SELECT count(*) AS n, count(mbid) AS m, count(release_date) AS r
      FROM our_albums), k AS (SELECT count(*) AS n, count(album_id) AS m FROM our_tracks)
    SELECT 'artists' AS kind, 'total' AS measure, n::DOUBLE AS value FROM c
    UNION ALL SELECT 'artists', 'with_mbid', m FROM c UNION ALL SELECT 'artists', 'coverage_pct', round(m::DOUBLE / n * 100, 1) FROM c
    UNION ALL SELECT 'artists', 'with_tags', count(DISTINCT artist_id) FROM a
    UNION ALL SELECT 'albums', 'total', n FROM b UNION ALL SELECT 'albums', 'with_mbid', m FROM b
    UNION ALL SELECT 'albums', 'with_release_date', r FROM b UNION ALL SELECT 'albums', 'coverage_pct', round(m::DOUBLE / n * 100, 1) FROM b
    UNION ALL SELECT 'tracks', 'total', n FROM k UNION ALL SELECT 'tracks', 'with_album', m FROM k
    UNION ALL SELECT 'tracks', 'with_mbid', 0 FROM k UNION ALL SELECT 'tracks', 'coverage_pct', round(m::DOUBLE / n * 100, 1) FROM k
    UNION ALL SELECT 'tags', 'total', count(DISTINCT tag) FROM a UNION ALL SELECT 'cache', 'entries', count(*) FROM cache""",
)
def _(spark, d):
    artists, tags = e.enrich_artists(_artists(spark, d), _mb_artists(spark, d))
    return e.enrichment_status(
        artists, _derived(spark, d, "our_albums"), _derived(spark, d, "our_tracks"), tags,
        e.tag_dim(tags, ["artist_id", "score"]), _cache(spark, d),
    )


@query(
    "recent_enrichments",
    """SELECT event_type AS enrichment_type, CASE WHEN value > 50 THEN 'success' ELSE 'failed' END AS status, count(*) AS count
    FROM events WHERE ts > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAY GROUP BY 1, 2""",
)
def _(spark, d):
    log = t.table(spark, d, "events").select(
        F.col("event_type").alias("enrichment_type"), F.when(F.col("value") > 50, "success").otherwise("failed").alias("status"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )
    return e.recent_enrichments(log, F.to_timestamp(F.lit("2024-01-30 00:00:00")))
