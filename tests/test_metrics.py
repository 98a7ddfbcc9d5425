import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracklore.catalog import tables as t
from tracklore.operators import metrics as m
from tracklore.operators.skew import global_rank, salted_join

DDL = (
    "play_id bigint, track_id bigint, album_id bigint, artist_id bigint, ts timestamp_ntz, duration_ms bigint, "
    "ms_played bigint, source string, is_duplicate boolean, country string, region string, city string"
)


def play(i, when, artist=1, track=1, album=1, ms=210_000, source="spotify", duplicate=False):
    return (i, track, album, artist, dt.datetime.fromisoformat(when), ms, None, source, duplicate, "US", None, None)


@pytest.fixture(scope="module")
def seed(spark):
    times = ["2023-01-15 10:00", "2023-01-15 10:05", "2023-01-20 14:00", "2023-02-10 20:00", "2023-02-11 08:00", "2023-03-05 23:00"]
    rows = [play(i, when, track=1 + i % 2) for i, when in enumerate(times)]
    rows += [play(6 + i, when, 2, 3, None, 180_000, "lastfm") for i, when in enumerate(["2023-01-25 15:00", "2023-04-01 12:00"])]
    rows.append(play(9, "2023-01-15 10:00", duplicate=True))
    return spark.createDataFrame(rows, DDL)


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_seed_totals(seed):
    summary = m.summary_overview(seed).first()
    assert (summary["total_plays"], summary["unique_artists"], summary["unique_tracks"]) == (8, 2, 3)
    artists = by(m.artist_analytics(seed, F.lit("2024-04-01").cast("date")), "artist_id")
    assert artists[1]["total_plays"] == 6 and artists[1]["first_play_date"] == dt.date(2023, 1, 15)
    assert artists[1]["peak_period_start"] == dt.date(2023, 1, 1) and artists[1]["peak_period_end"] == dt.date(2023, 1, 31)
    assert artists[1]["loyalty_tier"] == "constant" and artists[2]["loyalty_tier"] == "one-and-done"
    assert artists[1]["binge_score"] == 0.167 and artists[1]["discovery_half_life"] == 5
    assert artists[2]["days_since_last_play"] == 366
    months = by(m.monthly_summary(seed), "year_month")
    assert months["2023-01"]["total_plays"] == 4 and months["2023-01"]["new_artists_discovered"] == 2
    assert months["2023-01"]["top_artist_id"] == 1 and months["2023-04"]["new_artists_discovered"] == 0
    assert by(m.album_basic(seed), "album_id")[1]["total_plays"] == 6


def test_dayparts_sum_to_total(seed):
    for row in m.track_analytics(seed).collect():
        parts = [row[f"{p}_plays"] for p in ("morning", "afternoon", "evening", "night")]
        assert sum(parts) == row["total_plays"] and row["is_sleeper"] is False


def test_one_and_done(spark):
    plays = spark.createDataFrame([play(i, f"2023-01-0{i} 10:00", ms=None) for i in (1, 2, 3)], DDL)
    row = m.artist_analytics(plays).first()
    assert row["loyalty_tier"] == "one-and-done" and row["total_duration_ms"] == 0 and row["deep_cuts_ratio"] == 0.0


def test_completion_needs_a_pause_longer_than_the_gap(spark):
    rows = [play(i, f"2023-01-01 {10 + i}:00", track=i) for i in range(4)]  # pauses of exactly one hour
    plays = spark.createDataFrame(rows, DDL)
    assert [r["distinct_tracks"] for r in m.album_sessions(plays).collect()] == [4]
    late = spark.createDataFrame([*rows, play(9, "2023-01-01 14:00:01", track=9)], DDL)
    assert sorted(r["distinct_tracks"] for r in m.album_sessions(late).collect()) == [1, 4]
    sizes = spark.createDataFrame([(1, 4)], "album_id bigint, track_count bigint")
    assert m.completion_rate(late, sizes).first()["completion_rate"] == 1.0


def test_sessions_match_a_plain_scan(spark):
    import random

    rng = random.Random(5)
    start = dt.datetime(2023, 1, 1)
    rows = []
    for i in range(3000):
        album = rng.choice([1, 1, 1, 1, 2, 3, 4])
        when = start + dt.timedelta(seconds=rng.randrange(0, 4_000_000))
        rows.append((i, rng.choice([None, 1, 2, 3, 4, 5]), album, 1, when, 1, 1, "s", False, None, None, None))
    plays = spark.createDataFrame(rows, DDL)
    expected = []
    for album in (1, 2, 3, 4):
        seen, last = set(), None
        for when, track in sorted(((r[4], r[1] or -1) for r in rows if r[2] == album), key=lambda x: x[0]):
            if last and (when - last).total_seconds() > 3600:
                expected.append((album, len(seen)))
                seen = set()
            seen.add(track)
            last = when
        expected.append((album, len(seen)))
    got = [(r["album_id"], r["distinct_tracks"]) for r in m.album_sessions(plays).collect()]
    assert sorted(got) == sorted(expected)


def test_properties_on_generated_tables(spark, sf):
    plays = t.order_plays(spark, sf)
    summary = m.monthly_summary(plays)
    artists = m.artist_analytics(plays)
    new = summary.agg(F.sum("new_artists_discovered")).first()[0]
    assert new == artists.count()
    bad = artists.where("discovery_half_life > datediff(last_play_date, first_play_date) or days_since_last_play < 0")
    assert bad.count() == 0
    context = m.discovery_context(m.artist_daily(plays))
    assert context.where("discovered_artist_id = context_artist_id").count() == 0
    assert context.groupBy("discovered_artist_id", "context_type").count().where("count > 5").count() == 0


def test_global_rank_with_ties_and_wide_ids(spark):
    rows = [((i * 7_000_000_000_000_003) % 2**62, i % 3) for i in range(300)]
    ranked = global_rank(spark.createDataFrame(rows, "id bigint, n bigint"), "n", "id").collect()
    expected = {row: k for k, row in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert {(r["id"], r["n"]): r["rank"] for r in ranked} == expected


def test_salted_join_equals_plain_join(spark):
    big = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"))
    small = spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_anti"):
        left = sorted(map(str, salted_join(big, small, ["k"], F.col("id"), how).select("id").collect()))
        assert left == sorted(map(str, big.join(small, "k", how).select("id").collect()))
