"""A store brought up to date batch by batch against the tables computed from all plays at once."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tracklore.operators import metrics
from tracklore.plans import refresh
from tracklore.schema import PLAYS_DDL

TRACKS = [(track, 1 + track % 4) for track in range(1, 13)]


def make_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        track = rng.choice([None, *range(1, 13)])
        when = dt.datetime(2022, 1, 1) + dt.timedelta(seconds=rng.randrange(90 * 86400))
        artist = rng.choice([None, 1, 1, 1, 2, 3, 4, 5])
        album = None if track is None else 1 + track % 4
        country = rng.choice([None, "NO", "SE"])
        rows.append((i, track, album, artist, when, rng.choice([None, 1000 * i]), rng.choice([None, 700]), "spotify",
                     country, country and rng.choice([None, "x"]), None, rng.random() < 0.1, None))
    return rows


def sorted_rows(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_batches_equal_all_at_once(spark, tmp_path):
    rows = make_rows(7, 300)
    tracks = spark.createDataFrame(TRACKS, "id bigint, album_id bigint").cache()
    store = str(tmp_path / "store")
    # Out of order, and one run twice.
    for name, part in (("b", rows[120:]), ("a", rows[:120]), ("b", rows[120:])):
        refresh.incremental_refresh(spark.createDataFrame(part, PLAYS_DDL), store, name, buckets=2)
    refresh.compact(spark, store, f"{store}-2", buckets=1)
    for table, expected in refresh.analytics_tables(spark.createDataFrame(rows, PLAYS_DDL), tracks).items():
        want = sorted_rows(expected, expected.columns)
        assert want
        for place in (store, f"{store}-2"):
            got = sorted_rows(refresh.read_table(spark, place, table, tracks), expected.columns)
            assert got == want, (table, place)


def test_a_refresh_reads_no_old_plays_and_only_touched_folders(spark, tmp_path):
    store, rows = str(tmp_path / "store"), make_rows(3, 120)
    known = [r for r in rows if r[3] is not None]
    for name in ("a", "b"):
        part = spark.createDataFrame([r for r in known if (r[3] == 1) == (name == "b")], PLAYS_DDL)
        refresh.incremental_refresh(part, store, name, ["track_analytics", "artist_analytics"], buckets=64)
    folder = "b%d" % spark.range(1).select(F.pmod(F.xxhash64(F.lit(1).cast("bigint")), F.lit(64))).first()[0]
    files = list((tmp_path / "store/tables/artist_measures").glob("folder=*"))
    newest = max(files, key=lambda f: f.stat().st_mtime)
    assert newest.name == f"folder={folder}" and len(files) == 5
    plan = refresh._merged(spark, store, "artist_day", [folder])._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*folder", plan) and "/plays" not in plan


def test_empty_store_and_names(spark, tmp_path):
    empty = spark.createDataFrame([], PLAYS_DDL)
    store = str(tmp_path / "store")
    few = ["track_analytics", "monthly_summary", "geographic_analytics"]
    refresh.incremental_refresh(empty, store, "a", few)
    tracks = spark.createDataFrame([], "id bigint, album_id bigint")
    for table in few:
        assert refresh.read_table(spark, store, table, tracks).count() == 0
    with pytest.raises(ValueError):
        refresh.incremental_refresh(empty, store, "a/b")
    with pytest.raises(ValueError):
        refresh.read_table(spark, store, "other")


def test_completion_counts_plays_of_unknown_tracks(spark):
    rows = [(i, None, 1, 1, dt.datetime(2022, 1, 1, i), 1, None, "x", None, None, None, False, None) for i in range(6)]
    plays = spark.createDataFrame(rows, PLAYS_DDL)
    sizes = spark.createDataFrame([(1, 3)], "album_id bigint, track_count bigint")
    assert metrics.completion_rate(plays, sizes).first()["completion_rate"] == 0.0
