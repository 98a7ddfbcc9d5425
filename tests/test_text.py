import pytest
from pyspark.sql import functions as F

from tracklore.functions import text, timeparts


def apply(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn("x").alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [("RADIOHEAD", "Radiohead"), ("THE BEATLES", "The Beatles"), ("A", "A"), ("radiohead", "radiohead"),
     ("AC/DC", "Ac/Dc"), ("R.E.M.", "R.E.M."), ("OK", "OK"), ("1975", "1975"), ("ÉTOILE", "Étoile")],
)
def test_capitals(spark, raw, expected):
    assert apply(spark, raw, text.fold_capitals) == expected


@pytest.mark.parametrize(
    ("raw", "count"),
    [("Artist A & Artist B", 2), ("Artist A and Artist B", 2), ("Artist A x Artist B", 2), ("Artist A vs Artist B", 2),
     ("Artist A vs. Artist B", 2), ("Artist A, Artist B", 1), ("Artist A AND B X C", 3), ("Sandy", 1)],
)
def test_collaborations(spark, raw, count):
    assert len(apply(spark, raw, text.split_collaboration)) == count


@pytest.mark.parametrize(
    ("raw", "clean", "names", "live"),
    [
        ("Song Name (feat. Artist B)", "Song Name", ["Artist B"], False),
        ("Song Name (featuring Artist B)", "Song Name", ["Artist B"], False),
        ("Song Name (with Artist B)", "Song Name", ["Artist B"], False),
        ("Song Name [ft. Artist B]", "Song Name", ["Artist B"], False),
        ("Song (feat. Artist B & Artist C)", "Song", ["Artist B", "Artist C"], False),
        ("Song Name (Live at Venue)", "Song Name (Live at Venue)", [], True),
        ("Lively Song", "Lively Song", [], True),
        ("Song featuring Someone", "Song", ["Someone"], False),
        (None, "", [], False),
    ],
)
def test_featured(spark, raw, clean, names, live):
    row = apply(spark, raw, text.split_featured)
    assert (row["clean_title"], row["featured"], row["is_live"]) == (clean, names, live)


@pytest.mark.parametrize(
    "raw",
    ["OK Computer (Deluxe Edition)", "OK Computer [UK]", "OK Computer (Remastered)", "OK Computer - Single",
     "OK Computer (20th Anniversary Edition)", "OK Computer (Expanded Edition)", "OK Computer [Japan Bonus Tracks]"],
)
def test_album_titles(spark, raw):
    assert apply(spark, raw, text.canonical_album) == "OK Computer"


@pytest.mark.parametrize(
    ("raw", "expected"),
    [("Song (Radio Edit)", "Song"), ("Song (Album Version)", "Song"), ("Song (Instrumental)", "Song"),
     ("Song (Remix)", "Song (Remix)"), ("Song (Live at Venue)", "Song (Live at Venue)"),
     ("Song - 2011 Remastered", "Song"), ("Song - Remaster", "Song"), ("SONG (feat. X)", "Song")],
)
def test_track_titles(spark, raw, expected):
    assert apply(spark, raw, text.canonical_track) == expected


@pytest.mark.parametrize(
    ("raw", "expected"),
    [("Sigur Rós", "sigur-ros"), ("  Mötley   Crüe!", "motley-crue"), ("Straße", "strasse"), ("10,000 Maniacs", "10000-maniacs"),
     ("Łódź Ørsted", "lodz-orsted"), ("???", ""), ("AC/DC", "ac-dc")],
)
def test_slug(spark, raw, expected):
    assert apply(spark, raw, text.slug) == expected


def test_entity_slug_keeps_non_latin_names_apart(spark):
    assert apply(spark, "東京", text.entity_slug) != apply(spark, "大阪", text.entity_slug)


def test_blank_is_null(spark):
    assert apply(spark, " \t ", text.squeeze) is None
    assert apply(spark, "A  Featuring\tB Feat. C", text.clean_artist) == "A feat. B feat. C"


@pytest.mark.parametrize(
    ("ms", "expected"), [(500, "0s"), (61_000, "1m 1s"), (3_660_000, "1h 1m"), (90_000_000, "1d 1h"), (59_999, "59s")]
)
def test_durations(spark, ms, expected):
    row = spark.createDataFrame([(ms,)], "x bigint").select(timeparts.format_duration("x").alias("y")).first()
    assert row["y"] == expected


def test_week_label_follows_monday_weeks(spark):
    import datetime

    days = [datetime.date(2019, 12, 25) + datetime.timedelta(days=i) for i in range(900)]
    rows = spark.createDataFrame([(d,) for d in days], "d date").select("d", timeparts.week_label("d").alias("w")).collect()
    assert all(r["w"] == r["d"].strftime("%Y-%W") for r in rows)


def test_hours_of_nothing(spark):
    assert spark.range(1).select(timeparts.ms_to_hours(F.lit(None).cast("bigint")).alias("h")).first()["h"] == 0.0


def test_slugs_of_other_scripts(spark):
    names = {
        "Кино": "kino", "Земфира": "zemfira", "Щука Ёж": "shchuka-iozh", "Объект": "obekt", "ЮЛИЯ": "iuliia", "Вопли Видоплясова": "vopli-vidopliasova",
        "Βαγγέλης": "baggelis", "Ψυχή": "psychi", "ΘΕΟΣ": "theos", "さくら": "sakura", "サクラ": "sakura", "きゃりーぱみゅぱみゅ": "kyaripamyupamyu",
        "ジャズ": "jazu", "ロック": "rokku", "ファイル": "fairu", "ちょっと": "chotto", "Björk": "bjork", "東京": "",
    }
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.slug("n").alias("s"))
    assert {r.n: r.s for r in rows.collect()} == names
