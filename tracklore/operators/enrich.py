"""Filling in artists, albums and tracks from a bulk encyclopedia, as joins instead of one lookup per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklore.functions.similarity import indel_ratio
from tracklore.functions.text import slug, strip
from tracklore.operators.skew import first_per_key, salted_join, top_per_key

ARTIST_ACCEPT = 0.8
RECORDING_ACCEPT = 0.7
CONTAINS_LIMIT = 5
ARTIST_TAGS, GENRE_TAGS = 10, 15
CACHE_DAYS = 30
GRAM = 3


# --- candidates --------------------------------------------------------------------------


def _limited(df: DataFrame, key: str, limit: int | None) -> DataFrame:
    return df if limit is None else df.orderBy(key).limit(limit)


def artist_candidates(artists: DataFrame, limit: int | None = None) -> DataFrame:
    return _limited(artists.where("mbid is null or country is null or artist_type is null"), "artist_id", limit)


def album_candidates(albums: DataFrame, limit: int | None = None) -> DataFrame:
    return _limited(albums.where("mbid is null or release_date is null"), "album_id", limit)


def track_candidates(tracks: DataFrame, artists: DataFrame, limit: int | None = None) -> DataFrame:
    """Tracks without an album whose artist is known."""
    names = artists.select("artist_id", F.col("name").alias("artist_name"))
    open_tracks = tracks.where("album_id is null and artist_id is not null").select("track_id", "title", "artist_id")
    return _limited(salted_join(open_tracks, names, ["artist_id"], F.col("track_id")), "track_id", limit)


def untagged_artists(artists: DataFrame, artist_tags: DataFrame, limit: int | None = None) -> DataFrame:
    return _limited(artists.where("mbid is not null").join(artist_tags, "artist_id", "left_anti"), "artist_id", limit)


# --- lookups -----------------------------------------------------------------------------


def grams(text: Column, size: int | Column) -> Column:
    size = F.lit(size) if isinstance(size, int) else size
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (size - 1), F.lit(1)))
    grams = F.transform(starts, lambda at: F.substring(text, at, size))
    return F.when(F.length(text) >= size, grams).otherwise(F.array().cast("array<string>"))


def contains_pairs(queries: DataFrame, corpus: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Pairs where `text` of the corpus contains `needle` of a query; both carry lower-case text and their ids.

    A text that contains the needle contains all pieces of the needle. Pieces have the largest power of two of letters
    that fits the needle, so more than half of it, and each query is looked up under its rarest piece only. Texts are
    indexed by pieces of the sizes that queries have. `scope` columns must be equal as well.
    """
    scope = scope or []
    asked = queries.where(F.col("needle") != "")
    size = F.pow(F.lit(2), F.floor(F.log2(F.length("needle").cast("double")))).cast("int")
    sizes = asked.agg(F.collect_set(size)).scalar()
    sized = corpus.withColumn("_size", F.explode(sizes))
    pieces = sized.select(*corpus.columns, F.explode(F.array_distinct(F.transform(
        grams(F.col("text"), F.col("_size")), lambda piece: F.xxhash64(piece)))).alias("gram"))
    wanted = asked.withColumn("gram", F.explode(F.array_distinct(F.transform(
        grams(F.col("needle"), size), lambda piece: F.xxhash64(piece)))))
    frequency = pieces.groupBy(*scope, "gram").agg(F.count("*").alias("_n"))
    query_columns = queries.columns
    rarest = (
        wanted.join(frequency.hint("merge"), [*scope, "gram"])
        .groupBy(*query_columns)
        .agg(F.min(F.struct("_n", "gram")).alias("_rare"))
        .select(*query_columns, F.col("_rare.gram").alias("gram"))
    )
    kept = [c for c in corpus.columns if c not in scope]
    # Exploded rows are not in Spark's estimate of a size; without the hint it would broadcast the index.
    right = pieces.select(*scope, "gram", *kept).hint("merge")
    joined = salted_join(right, rarest, [*scope, "gram"], F.xxhash64("text"))
    return joined.where(F.col("text").contains(F.col("needle"))).drop("gram")


def lookup_artist_exact(names: DataFrame, mb_artists: DataFrame) -> DataFrame:
    """(name, mbid) by case-insensitive equality, lowest mbid."""
    index = mb_artists.groupBy(F.lower("name").alias("_key")).agg(F.min("mbid").alias("mbid"))
    return salted_join(names.select("name", F.lower("name").alias("_key")), index, ["_key"], F.col("name")).drop("_key")


def lookup_artist_contains(names: DataFrame, mb_artists: DataFrame, limit: int = CONTAINS_LIMIT) -> DataFrame:
    """Names without an exact hit -> up to `limit` encyclopedia artists whose name contains them, closest first."""
    exact = mb_artists.select(F.lower("name").alias("_key"))
    open_names = names.withColumn("_key", F.lower("name")).join(exact, "_key", "left_anti")
    queries = open_names.select(F.col("name").alias("query"), F.col("_key").alias("needle")).distinct()
    corpus = mb_artists.select("mbid", F.col("name").alias("found"), F.lower("name").alias("text"))
    pairs = contains_pairs(queries, corpus)
    order = [F.length("found").asc(), F.asc("mbid")]
    return top_per_key(pairs, ["query"], order, limit, "place").select(
        F.col("query").alias("name"), "mbid", F.col("found").alias("found_name"), "place"
    )


def lookup_by_mbid(wanted: DataFrame, table: DataFrame) -> DataFrame:
    return wanted.join(table, "mbid")


def _credited(credit: Column) -> Column:
    """Lower-case names in an artist credit."""
    names = F.transform(credit, lambda c: F.lower(F.coalesce(c["artist"]["name"], c["name"])))
    return F.coalesce(F.filter(names, lambda n: n.isNotNull()), F.array().cast("array<string>"))


def titled_candidates(wanted: DataFrame, table: DataFrame) -> DataFrame:
    """(title, artist_name, mbid): entries of equal title ignoring case whose credit contains the artist.

    Without an artist the title decides. A credit equal to the artist beats every credit that contains it, so of those
    only the lowest mbid is kept, and only artists without one go through `contains_pairs`, which gives all: equality is
    an equi-join on title and credit, so popular titles do not pair up with each other.
    """
    asked = wanted.select("title", "artist_name").distinct().withColumns(
        {"_title": F.lower("title"), "_artist": F.lower("artist_name")}
    )
    entries = table.select(F.lower("title").alias("_title"), "mbid", _credited(F.col("artist_credit")).alias("_credits"))
    by_title = entries.groupBy("_title").agg(F.min("mbid").alias("mbid"))
    no_artist = salted_join(asked.where("artist_name is null"), by_title, ["_title"], F.col("title"))
    credits = entries.select("_title", "mbid", F.explode("_credits").alias("_artist")).distinct()
    by_credit = credits.groupBy("_title", "_artist").agg(F.min("mbid").alias("mbid"))
    equal = asked.join(by_credit, ["_title", "_artist"])
    rest = asked.where("artist_name is not null").join(by_credit, ["_title", "_artist"], "left_anti")
    queries = rest.select("title", "artist_name", "_title", F.col("_artist").alias("needle"))
    corpus = credits.join(rest.select("_title"), "_title", "left_semi").withColumnRenamed("_artist", "text")
    contained = contains_pairs(queries, corpus, ["_title"])
    columns = ["title", "artist_name", "mbid"]
    return no_artist.select(columns).unionByName(equal.select(columns)).unionByName(contained.select(columns)).distinct()


def lookup_titled(wanted: DataFrame, table: DataFrame) -> DataFrame:
    """(title, artist_name, mbid): the candidate of lowest mbid for each request."""
    return titled_candidates(wanted, table).groupBy("title", "artist_name").agg(F.min("mbid").alias("mbid"))


# --- scores ------------------------------------------------------------------------------


def artist_match_score(ratio: Column, disambiguation: Column | str, kind: Column | str) -> Column:
    disambiguation, kind = (F.col(c) if isinstance(c, str) else c for c in (disambiguation, kind))
    score = ratio * F.when(F.coalesce(disambiguation, F.lit("")) != "", 0.95).otherwise(1.0)
    return F.least(score * F.when(kind == "Group", 1.02).otherwise(1.0), F.lit(1.0))


def score_artist_matches(names: DataFrame, mb_artists: DataFrame, accept: float = ARTIST_ACCEPT) -> DataFrame:
    """(name, mbid, confidence): the best of all equal or containing artists, if good enough; ties to the lowest mbid."""
    equal = mb_artists.select(F.lower("name").alias("_key"), "mbid")
    exact = names.select("name", F.lower("name").alias("_key")).join(equal, "_key").select("name", "mbid")
    fallback = lookup_artist_contains(names, mb_artists).select("name", "mbid")
    facts = mb_artists.select("mbid", F.col("name").alias("_found"), "disambiguation", "type")
    found = exact.unionByName(fallback).join(facts, "mbid")
    ratio = indel_ratio(F.lower("name"), F.lower("_found"))
    scored = found.withColumn("_ratio", ratio).withColumn(
        "confidence", artist_match_score(F.col("_ratio"), "disambiguation", "type")
    )
    best = scored.groupBy("name").agg(F.min(F.struct((-F.col("confidence")).alias("neg"), "mbid")).alias("_best"))
    return best.select("name", F.col("_best.mbid").alias("mbid"), (-F.col("_best.neg")).alias("confidence")).where(
        F.col("confidence") >= accept
    )


def score_recording_matches(
    tracks: DataFrame, mb_recordings: DataFrame, accept: float = RECORDING_ACCEPT
) -> DataFrame:
    """(title, artist_name, recording_mbid, confidence, release) for tracks found in the encyclopedia.

    Every recording with a release is scored; the best wins, ties go to the lowest mbid. `release` is its first release
    that belongs to a studio album, or the first one if none does.
    """
    mb_recordings = mb_recordings.where(F.size("releases") > 0)
    hits = titled_candidates(tracks, mb_recordings)
    facts = mb_recordings.select("mbid", F.col("title").alias("_title"), "artist_credit", "releases")
    rows = hits.join(facts, "mbid").withColumn("_credit", F.explode_outer(_credited(F.col("artist_credit"))))
    rows = rows.withColumn("_title_ratio", indel_ratio(F.lower("title"), F.lower("_title"))).withColumn(
        "_artist_ratio", F.coalesce(indel_ratio(F.lower("artist_name"), "_credit"), F.lit(0.0))
    )
    best = rows.groupBy("title", "artist_name", "mbid").agg(
        F.max("_title_ratio").alias("_t"), F.max("_artist_ratio").alias("_a"), F.first("releases").alias("releases")
    )
    confidence = F.least((F.col("_t") * 0.6 + F.col("_a") * 0.4) * F.lit(1.05), F.lit(1.0))
    rank = F.struct(-F.col("confidence"), "mbid")
    best = best.withColumn("confidence", confidence).groupBy("title", "artist_name").agg(
        F.min_by(F.struct("mbid", "confidence", "releases"), rank).alias("_best")).select("title", "artist_name", "_best.*")
    studio = F.filter("releases", lambda r: r["release_group_type"] == "Album")
    release = F.coalesce(F.get(studio, F.lit(0)), F.get("releases", F.lit(0)))
    return best.select(
        "title", "artist_name", F.col("mbid").alias("recording_mbid"), "confidence", release.alias("release"),
    ).where((F.col("confidence") >= accept) & F.col("release").isNotNull())


# --- jobs --------------------------------------------------------------------------------


def _tag_rows(owners: DataFrame, key: str, keep: int) -> DataFrame:
    """(key, tag, name, score) of the first tags; the first mention of a tag wins."""
    tags = owners.select(key, F.posexplode(F.slice("tags", 1, keep)).alias("place", "t")).where("t.name <> ''")
    named = tags.select(key, "place", F.col("t.name").alias("name"), F.col("t.count").alias("score")).withColumn(
        "tag", F.lower(strip("name"))
    )
    return first_per_key(named, [key, "tag"], [F.col("place")]).drop("place")


def _keep_existing(new: DataFrame, existing: DataFrame | None, keys: list[str]) -> DataFrame:
    return new if existing is None else new.join(existing.select(keys), keys, "left_anti")


def enrich_artists(
    artists: DataFrame, mb_artists: DataFrame, existing_tags: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(artists, new tags): missing mbid, country and type filled, never overwritten.

    An mbid belongs to one artist. An artist that would take one that another artist has, or that an artist with a
    lower id takes, keeps its row as it is.
    """
    todo = artist_candidates(artists)
    known = todo.where("mbid is not null").select("artist_id", F.col("mbid").alias("new_mbid"))
    unknown = todo.where("mbid is null").select("artist_id", "name")
    scored = score_artist_matches(unknown.select("name").distinct(), mb_artists)
    found = salted_join(unknown, scored.select("name", F.col("mbid").alias("new_mbid")), ["name"], F.col("artist_id"))
    matched = known.unionByName(found.select("artist_id", "new_mbid"))
    facts = mb_artists.select(
        F.col("mbid").alias("new_mbid"), F.col("country").alias("new_country"), F.col("type").alias("new_type"), "tags"
    )
    filled = matched.join(facts, "new_mbid")
    owners = artists.where("mbid is not null").select(F.col("mbid").alias("new_mbid"), F.col("artist_id").alias("_owner"))
    first = found.groupBy("new_mbid").agg(F.min("artist_id").alias("_first"))
    allowed = (
        filled.join(owners, "new_mbid", "left")
        .join(first, "new_mbid", "left")
        .where("artist_id = coalesce(_owner, _first)")
        .select("artist_id", "new_mbid", "new_country", "new_type")
    )
    updated = artists.join(allowed, "artist_id", "left").select(
        *[c for c in artists.columns if c not in ("mbid", "country", "artist_type")],
        F.coalesce("mbid", "new_mbid").alias("mbid"),
        F.coalesce("country", "new_country").alias("country"),
        F.coalesce("artist_type", "new_type").alias("artist_type"),
    )
    tags = _keep_existing(_tag_rows(filled, "artist_id", ARTIST_TAGS), existing_tags, ["artist_id", "tag"])
    return updated, tags


def enrich_albums(
    albums: DataFrame, mb_release_groups: DataFrame, existing_tags: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(albums, new tags): the release date of albums that have an mbid but lack the date."""
    facts = mb_release_groups.select("mbid", F.col("first_release_date").alias("_date"), "tags")
    found = album_candidates(albums).where("mbid is not null").select("album_id", "mbid").join(facts, "mbid")
    dates = found.where("_date <> ''").select("album_id", "_date")
    updated = albums.join(dates, "album_id", "left").select(
        *[c for c in albums.columns if c != "release_date"], F.coalesce("_date", "release_date").alias("release_date")
    )
    return updated, _keep_existing(_tag_rows(found, "album_id", ARTIST_TAGS), existing_tags, ["album_id", "tag"])


def find_missing_albums(
    tracks: DataFrame, artists: DataFrame, albums: DataFrame, mb_recordings: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(track updates, new albums). The album is found by release-group id, else by slug and artist, else created."""
    todo = track_candidates(tracks, artists)
    matches = score_recording_matches(todo.select("title", "artist_name"), mb_recordings)
    found = todo.join(matches, ["title", "artist_name"]).select(
        "track_id", "artist_id", "recording_mbid", "confidence",
        F.col("release.release_title").alias("album_title"),
        F.col("release.release_group_mbid").alias("rg_mbid"),
        F.col("release.date").alias("release_date"),
    ).withColumn("album_slug", slug("album_title"))
    by_mbid = albums.where("mbid is not null").groupBy(F.col("mbid").alias("rg_mbid")).agg(F.min("album_id").alias("_by_mbid"))
    by_title = albums.groupBy(F.col("slug").alias("album_slug"), "artist_id").agg(F.min("album_id").alias("_by_title"))
    placed = salted_join(found, by_mbid, ["rg_mbid"], F.col("track_id"), "left")
    placed = salted_join(placed, by_title, ["album_slug", "artist_id"], F.col("track_id"), "left")
    fresh_id = F.when(F.col("rg_mbid").isNotNull(), F.xxhash64(F.lit("release-group"), "rg_mbid")).otherwise(
        F.xxhash64(F.lit("album"), "artist_id", "album_slug")
    )
    placed = placed.withColumn("_existing", F.coalesce("_by_mbid", "_by_title")).withColumn(
        "album_id", F.coalesce("_existing", fresh_id)
    )
    created = placed.where("_existing is null").groupBy("album_id").agg(
        F.min(F.struct("track_id", "album_title", "album_slug", "artist_id", "rg_mbid", "release_date")).alias("f")
    )
    new_albums = created.select(
        "album_id", F.col("f.album_title").alias("title"), F.col("f.album_slug").alias("slug"),
        F.col("f.artist_id").alias("artist_id"), F.col("f.rg_mbid").alias("mbid"), F.col("f.release_date").alias("release_date"),
    )
    return placed.select("track_id", "album_id", "recording_mbid", "confidence"), new_albums


def enrich_genres(artists: DataFrame, artist_tags: DataFrame, mb_artists: DataFrame) -> DataFrame:
    """Tags for artists that have an mbid but no tag yet."""
    owners = untagged_artists(artists, artist_tags).select("artist_id", "mbid").join(mb_artists.select("mbid", "tags"), "mbid")
    return _tag_rows(owners, "artist_id", GENRE_TAGS)


def tag_dim(tag_rows: DataFrame, order: list[str]) -> DataFrame:
    """(tag, name): one row per normalised tag with its first spelling."""
    return tag_rows.groupBy("tag").agg(F.min_by("name", F.struct(*order)).alias("name"))


def artist_genres(artist_tags: DataFrame, genre_mapping: DataFrame) -> DataFrame:
    """Canonical genres of an artist; mapping is (tag, genre, is_primary)."""
    mapped = salted_join(artist_tags, genre_mapping, ["tag"], F.col("artist_id"))
    return mapped.groupBy("artist_id", "genre").agg(
        F.max("score").alias("score"), F.max("is_primary").alias("is_primary")
    )


def artist_top_genres(genres: DataFrame, n: int = 5) -> DataFrame:
    return top_per_key(genres, ["artist_id"], [F.desc("confidence"), F.asc("genre")], n)


# --- lookup cache ------------------------------------------------------------------------


def cache_key(entity: Column, query: Column, params: Column) -> Column:
    return F.sha2(F.concat_ws(":", entity, query, params), 256)


def cache_lookup(requests: DataFrame, cache: DataFrame, as_of: Column) -> DataFrame:
    """Requests with their cached response; NULL when there is none or it has expired."""
    keys = ["entity_type", "entity_id", "params_hash"]
    live = cache.where(F.col("expires_at").isNull() | (F.col("expires_at") >= as_of))
    hits = requests.join(live.select(*keys, "response_json"), keys, "left")
    return hits.withColumn("hit", F.col("response_json").isNotNull())


def cache_upsert(cache: DataFrame, fetched: DataFrame, days: int = CACHE_DAYS) -> DataFrame:
    """Latest response per key."""
    keys = ["entity_type", "entity_id", "params_hash"]
    fresh = fetched.withColumn("expires_at", F.col("fetched_at") + F.make_interval(days=F.lit(days)))
    rows = cache.unionByName(fresh.select(cache.columns))
    return first_per_key(rows, keys, [F.desc("fetched_at"), F.desc("response_json")])


# --- status ------------------------------------------------------------------------------


def _pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole * 100, 1)).otherwise(F.lit(0.0))


def coverage(df: DataFrame, kind: str, marks: dict[str, str], pct: str) -> DataFrame:
    """(kind, measure, value) rows: total, one count per mark, and one coverage percentage."""
    counted = df.agg(
        F.count("*").alias("total"), *[F.count_if(F.expr(test)).alias(name) for name, test in marks.items()]
    )
    value = {"total": F.col("total"), **{name: F.col(name) for name in marks}}
    pairs = [F.struct(F.lit(name).alias("measure"), v.cast("double").alias("value")) for name, v in value.items()]
    pairs.append(F.struct(F.lit("coverage_pct").alias("measure"), _pct(F.col(pct), F.col("total")).alias("value")))
    return counted.select(F.lit(kind).alias("kind"), F.inline(F.array(*pairs)))


def enrichment_status(
    artists: DataFrame, albums: DataFrame, tracks: DataFrame, artist_tags: DataFrame, tags: DataFrame, cache: DataFrame
) -> DataFrame:
    with_tags = artist_tags.agg(F.count_distinct("artist_id").cast("double").alias("value")).select(
        F.lit("artists").alias("kind"), F.lit("with_tags").alias("measure"), "value"
    )
    rows = (
        coverage(artists, "artists", {"with_mbid": "mbid is not null"}, "with_mbid")
        .unionByName(with_tags)
        .unionByName(coverage(
            albums, "albums", {"with_mbid": "mbid is not null", "with_release_date": "release_date is not null"}, "with_mbid"
        ))
        .unionByName(coverage(
            tracks, "tracks", {"with_album": "album_id is not null", "with_mbid": "recording_mbid is not null"}, "with_album"
        ))
    )
    for kind, measure, table in (("tags", "total", tags), ("cache", "entries", cache)):
        rows = rows.unionByName(
            table.agg(F.count("*").cast("double").alias("value")).select(
                F.lit(kind).alias("kind"), F.lit(measure).alias("measure"), "value"
            )
        )
    return rows


def recent_enrichments(log: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    recent = log.where(F.col("created_at") > as_of - F.make_interval(days=F.lit(days)))
    return recent.groupBy("enrichment_type", "status").agg(F.count("*").alias("count"))
