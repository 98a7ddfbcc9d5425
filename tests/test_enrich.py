import datetime as dt
import json
import random

from pyspark.sql import functions as F

from tracklore.operators import enrich as e
from tracklore.operators.skew import salted_join
from tracklore.operators import search
from tracklore.sources import encyclopedia as x

CREDIT = "array<struct<name: string, artist: struct<id: string, name: string>>>"


def test_contains_pairs_equal_plain_search(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randrange(0, 12))) for _ in range(300)]
    needles = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(40)]
    queries = spark.createDataFrame([(i, n) for i, n in enumerate(needles)], "qid int, needle string")
    corpus = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "cid int, text string")
    got = sorted((r["qid"], r["cid"]) for r in e.contains_pairs(queries, corpus).collect())
    assert got == sorted((q, c) for q, n in enumerate(needles) for c, t in enumerate(texts) if n in t)


def test_dump_lines(spark, tmp_path):
    lines = ['{"id": "a", "name": "First", "tags": [{"name": "rock"}]}', "{broken", '{"id": "b"}', '{"name": "no id"}',
             '{"id": "a", "name": "Second"}']
    (tmp_path / "artist.jsonl").write_text("\n".join(lines))
    rows = x.read_dump(spark, str(tmp_path), "artist").collect()
    assert [(r["mbid"], r["name"]) for r in rows] == [("a", "First")]
    assert rows[0]["tags"][0]["count"] == 0


def artists(spark, *rows):
    return spark.createDataFrame(rows, "artist_id bigint, name string, mbid string, country string, artist_type string")


def mb(spark, *rows):
    ddl = "mbid string, name string, sort_name string, country string, type string, disambiguation string, " \
          "tags array<struct<name: string, count: bigint>>"
    return spark.createDataFrame(rows, ddl)


def test_artists_fill_only_gaps_and_respect_ids(spark):
    ours = artists(
        spark, (1, "Radiohead", None, None, "Person"), (2, "radiohead", None, None, None), (3, "Other", "m3", None, None),
        (4, "Unheard", None, None, None),
    )
    theirs = mb(
        spark, ("m1", "RADIOHEAD", None, "GB", "Group", None, [("Rock", 9), ("rock ", 1), ("", 3)]), ("m3", "Zzz", None, "SE", "Person", None, None)
    )
    updated, tags = e.enrich_artists(ours, theirs)
    rows = {r["artist_id"]: (r["mbid"], r["country"], r["artist_type"]) for r in updated.collect()}
    assert rows == {1: ("m1", "GB", "Person"), 2: (None, None, None), 3: ("m3", "SE", "Person"), 4: (None, None, None)}
    assert sorted((r["artist_id"], r["tag"], r["name"], r["score"]) for r in tags.collect()) == [
        (1, "rock", "Rock", 9), (2, "rock", "Rock", 9)
    ]
    none = e.enrich_artists(ours, theirs, tags)[1]
    assert none.count() == 0


def test_track_without_album_gains_one(spark):
    ours = artists(spark, (1, "Radiohead", "m", "GB", "Group"))
    tracks = spark.createDataFrame([(7, "Airbag", 1, None), (8, "Lucky", 1, None), (9, "Nope", 1, None)],
                                   "track_id bigint, title string, artist_id bigint, album_id bigint")
    albums = spark.createDataFrame([], "album_id bigint, title string, slug string, artist_id bigint, mbid string, release_date string")
    release = [("r1", "OK Computer", "rg1", "OK Computer", "Album", "1997")]
    ddl = f"mbid string, title string, length_ms bigint, artist_credit {CREDIT}, releases array<struct<release_mbid: string, " \
          "release_title: string, release_group_mbid: string, release_group_title: string, release_group_type: string, date: string>>"
    credit = [("Radiohead", ("m", "Radiohead"))]
    recordings = spark.createDataFrame(
        [("c1", "AIRBAG", 1, credit, [("r0", "Live", None, "Live", "Live", "2001"), *release]), ("c2", "Lucky", 1, credit, release)], ddl
    )
    updates, created = e.find_missing_albums(tracks, ours, albums, recordings)
    rows = {r["track_id"]: r for r in updates.collect()}
    new = created.collect()
    assert sorted(rows) == [7, 8] and len(new) == 1
    assert new[0]["mbid"] == "rg1" and new[0]["title"] == "OK Computer"
    assert {r["album_id"] for r in rows.values()} == {new[0]["album_id"]}
    again = e.find_missing_albums(tracks, ours, created.select(albums.columns), recordings)
    assert again[1].count() == 0


def recordings_with_late_album(spark):
    """Two recordings, as dump lines: eight singles, then a studio album; a recording without releases."""
    group = {"id": "rg", "title": "t", "primary-type": "Single"}
    releases = [{"id": f"r{i}", "title": "Single", "date": "1997", "release-group": group} for i in range(8)]
    releases.append({"id": "r8", "title": "OK Computer", "date": "1998", "release-group": {**group, "id": "rg8", "primary-type": "Album"}})
    credit = [{"name": "Radiohead", "artist": {"id": "m", "name": "Radiohead"}}]
    lines = [json.dumps({"id": "c1", "title": "Airbag", "artist-credit": credit, "releases": releases}),
             json.dumps({"id": "c0", "title": "Airbag", "artist-credit": credit, "releases": []})]
    rows = spark.createDataFrame(list(enumerate(lines)), "position long, value string")
    return x.parse_dump(rows, "recording")


def test_missing_album_may_be_a_late_release(spark):
    recordings = recordings_with_late_album(spark)
    assert {r["mbid"]: r["releases"] and [p["release_mbid"] for p in r["releases"]] for r in recordings.collect()} == {
        "c1": [f"r{i}" for i in range(9)], "c0": None}
    tracks = spark.createDataFrame([(7, "Airbag", 1, None)], "track_id bigint, title string, artist_id bigint, album_id bigint")
    albums = spark.createDataFrame([], "album_id bigint, title string, slug string, artist_id bigint, mbid string, release_date string")
    ours = artists(spark, (1, "Radiohead", "m", "GB", "Group"))
    updates, created = e.find_missing_albums(tracks, ours, albums, recordings)
    assert [(r["track_id"], r["recording_mbid"]) for r in updates.collect()] == [(7, "c1")]
    assert [(r["title"], r["mbid"], r["release_date"]) for r in created.collect()] == [("OK Computer", "rg8", "1998")]


def test_recording_match_takes_its_release_from_all(spark):
    tracks = spark.createDataFrame([("airbag", "Radiohead")], "title string, artist_name string")
    found = e.score_recording_matches(tracks, recordings_with_late_album(spark)).collect()
    assert [(r["recording_mbid"], r["confidence"], r["release"]["release_mbid"]) for r in found] == [("c1", 1.0, "r8")]


def test_cache_round_trip(spark):
    keys = "entity_type string, entity_id string, params_hash string"
    cache = spark.createDataFrame([], f"{keys}, response_json string, fetched_at timestamp, expires_at timestamp")
    now = dt.datetime(2024, 1, 1)
    fetched = spark.createDataFrame([("artist", "a", "h", "{}", now), ("artist", "a", "h", "{1}", now + dt.timedelta(days=1))],
                                    f"{keys}, response_json string, fetched_at timestamp")
    stored = e.cache_upsert(cache, fetched)
    asked = spark.createDataFrame([("artist", "a", "h"), ("artist", "b", "h")], keys)
    hits = {r["entity_id"]: r["response_json"] for r in e.cache_lookup(asked, stored, F.lit(dt.datetime(2024, 1, 20))).collect()}
    assert hits == {"a": "{1}", "b": None}
    late = e.cache_lookup(asked, stored, F.lit(dt.datetime(2024, 2, 20))).where("hit").count()
    assert late == 0


def test_search_finds_misspelled_names(spark):
    rows = spark.createDataFrame([(1, "Radiohead"), (2, "Portishead"), (3, "Nirvana")], "id bigint, name string")
    titled = spark.createDataFrame([(5, "OK Computer", "Radiohead"), (6, "Dummy", None)], "id bigint, title string, artist_name string")
    queries = spark.createDataFrame([("radiohed",), ("DUMY",), ("zzzzzz",), ("",)], "query string")
    hits = {(r["query"], r["kind"], r["id"]) for r in search.fuzzy_lookup(queries, rows, titled, titled).collect()}
    assert ("radiohed", "artist", 1) in hits and ("radiohed", "album", 5) in hits and ("DUMY", "track", 6) in hits
    assert not {h for h in hits if h[0] in ("zzzzzz", "")}


def test_best_of_all_candidates_wins(spark):
    theirs = mb(spark, ("m1", "Genesis", None, None, "Person", "poet", None), ("m2", "GENESIS", None, None, "Group", None, None))
    best = e.score_artist_matches(spark.createDataFrame([("Genesis",)], "name string"), theirs).collect()
    assert [(r["mbid"], r["confidence"]) for r in best] == [("m2", 1.0)]
    release = [("r1", "OK", "g", "OK", "Album", "1997")]
    ddl = f"mbid string, title string, length_ms bigint, artist_credit {CREDIT}, releases array<struct<release_mbid: string, " \
          "release_title: string, release_group_mbid: string, release_group_title: string, release_group_type: string, date: string>>"
    rows = [("c1", "Song", 1, [("Ann", ("a", "Ann"))], None), ("c2", "Song", 1, [("Ann", ("a", "Ann"))], release),
            ("d1", "Tune", 1, [("Bob and the Long Band", ("b", "Bob and the Long Band"))], release),
            ("d2", "Tune", 1, [("Bob & Co", ("b", "Bob & Co"))], release)]
    asked = spark.createDataFrame([("Song", "Ann"), ("Tune", "Bob")], "title string, artist_name string")
    found = e.score_recording_matches(asked, spark.createDataFrame(rows, ddl)).collect()
    assert sorted((r["title"], r["recording_mbid"]) for r in found) == [("Song", "c2"), ("Tune", "d2")]


def _joins(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_salts_and_pieces_count_in_what_is_broadcast(spark, tmp_path):
    """Rows that Spark's estimate left out, salts and pieces, were broadcast through the driver."""
    spark.range(200_000).selectExpr("id AS k", "concat('name ', id) AS text").write.parquet(str(tmp_path / "small"))
    small = spark.read.parquet(str(tmp_path / "small"))
    big = spark.range(3_000_000).select((F.col("id") % 7).alias("k"), "id")
    assert "BroadcastHashJoin" not in _joins(salted_join(big, small, ["k"], F.col("id")))
    assert salted_join(big.limit(21), small, ["k"], F.col("id")).count() == 21
    needles = small.select(F.col("k").alias("q"), F.col("text").alias("needle"))
    assert "BroadcastHashJoin" not in _joins(e.contains_pairs(needles, small.withColumnRenamed("k", "c")))


def test_contains_pairs_of_every_length(spark):
    texts = ["a", "ab", "abc", "abcd", "abcdefgh", "xabcdefghy", "abcdefghi", "", "bcde", "the abcd"]
    queries = spark.createDataFrame(list(enumerate(texts)), "q int, needle string")
    corpus = spark.createDataFrame(list(enumerate(texts)), "c int, text string")
    found = sorted((r["q"], r["c"]) for r in e.contains_pairs(queries, corpus).collect())
    assert found == [(q, c) for q, n in enumerate(texts) for c, text in enumerate(texts) if n and n in text]
    assert e.contains_pairs(queries.where("needle = ''"), corpus).isEmpty()


def test_salted_rows_are_merged_whatever_their_estimated_size(spark, tmp_path):
    """titles of few bytes on disk were repeated per salt and sent through the driver."""
    spark.range(1000).selectExpr("id AS k", "'a title' AS title").write.parquet(str(tmp_path / "titles"))
    titles = spark.read.parquet(str(tmp_path / "titles"))
    big = spark.range(3_000_000).select((F.col("id") % 7).alias("k"), "id")
    for how in ("inner", "left"):
        assert "SortMergeJoin" in _joins(salted_join(big, titles, ["k"], F.col("id"), how))
