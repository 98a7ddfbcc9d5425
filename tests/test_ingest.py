import datetime as dt
import json
import random

from pyspark.sql import functions as F

from tracklore.operators import ingest
from tracklore.sources import history


def play(**changes):
    row = {
        "ts": "2022-01-01T00:00:00Z", "platform": "ios", "ms_played": 215000, "conn_country": "US",
        "master_metadata_track_name": "Eclipse", "master_metadata_album_artist_name": "Twin Shadow",
        "master_metadata_album_album_name": "Forget", "spotify_track_uri": "uri:1", "shuffle": False,
        "offline_timestamp": None,
    }
    return {**row, **changes}


ROWS = [
    play(),
    play(ts="2022-01-01T00:10:00Z", ms_played=5000),
    play(ts="2022-01-01T00:20:00Z", master_metadata_track_name=None, episode_name="Podcast", episode_show_name="Show"),
    play(ts="2022-01-02T05:30:00Z", master_metadata_track_name="Midnight City", master_metadata_album_artist_name=None),
    play(ts="2022-01-03T15:15:30Z", master_metadata_track_name=None, master_metadata_album_album_name=None,
         spotify_track_uri=None, master_metadata_album_artist_name="Unknown Mortal Orchestra"),
    play(ts="not-a-timestamp"),
]


def read(spark, folder):
    return ingest.classify_history(history.parse_history(history.read_json_history(spark, str(folder))))


def test_history_counters(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(ROWS))
    report = ingest.history_report(read(spark, tmp_path)).first()
    assert (report["files_processed"], report["records_seen"], report["inserted"]) == (1, 6, 3)
    assert (report["skipped_short"], report["skipped_podcasts"], report["invalid_records"]) == (1, 1, 1)
    assert report["duplicate_rows"] == 0 and report["metadata_flagged"] == 2
    samples = ingest.sample_rows(ingest.accepted_history(read(spark, tmp_path)), ["ts", "master_metadata_track_name"]).collect()
    assert [r["master_metadata_track_name"] for r in samples] == ["Eclipse", "Midnight City", None]


def test_file_shapes(spark, tmp_path):
    (tmp_path / "empty.json").write_text("[]")
    (tmp_path / "wrapped.json").write_text(json.dumps({"plays": [play(), 3, "x", None]}))
    (tmp_path / "other.json").write_text(json.dumps({"rows": [play()]}))
    (tmp_path / "broken.json").write_text('[{"ts": "2022')
    rows = history.read_json_history(spark, str(tmp_path)).collect()
    assert [r["source_row"] for r in rows] == [1]


def test_same_row_in_two_files_counts_once(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([play(), play(extra=1)]))
    (tmp_path / "b.json").write_text(json.dumps([dict(reversed(play().items()))]))
    classified = read(spark, tmp_path)
    assert ingest.accepted_history(classified).count() == 2
    assert ingest.history_report(classified).first()["duplicate_rows"] == 1
    assert ingest.accepted_history(classified, classified.select("raw_hash")).count() == 0


CSV = """uts,utc_time,artist,artist_mbid,album,album_mbid,track,track_mbid,duration_seconds,application
1640995200,"1 Jan 2022, 00:00","Bayonne","m1","Temporary Time","m2","Right Thing","m3",240,spotify
1640997000,"1 Jan 2022, 00:30","Portishead","m4","","","Mysterons","m5",0,desktop
1641000600,"1 Jan 2022, 01:30","Various Artists","","N/A","","Compilation Track","",210,ios
1640995200,"2022-01-01T00:00:00Z","Bayonne","m1","Temporary Time","m2","Right Thing","m3",240,spotify
,"2022-01-01T03:30:00Z","No Timestamp","","Unknown Album","","Unknown Track","",,web
bad_timestamp,"not a date","Malformed Artist","","","","Bad Row","",,unknown
"""


def test_scrobble_counters(spark, tmp_path):
    (tmp_path / "recent.csv").write_text("﻿" + CSV, encoding="utf-8")
    rows = ingest.classify_scrobbles(history.read_csv_scrobbles(spark, str(tmp_path)))
    report = ingest.scrobble_report(rows).first()
    assert (report["records_seen"], report["inserted"], report["invalid_records"]) == (6, 4, 1)
    assert (report["missing_album"], report["duplicates_flagged"], report["duplicates_skipped"]) == (1, 1, 1)
    kept = ingest.dedupe_scrobbles(rows).orderBy("position").collect()
    assert [r["track_name"] for r in kept] == ["Right Thing", "Mysterons", "Compilation Track", "Unknown Track"]
    assert kept[1]["album_name"] is None and kept[2]["album_name"] == "N/A"
    assert kept[3]["play_ts"] == dt.datetime(2022, 1, 1, 3, 30)
    flagged = ingest.dedupe_scrobbles(rows, drop=False)
    assert flagged.count() == 5 and flagged.where("duplicate_in_run").count() == 1
    assert ingest.scrobble_report(rows, drop=False).first()["inserted"] == 5


def test_header_aliases_and_zone(spark, tmp_path):
    (tmp_path / "x.csv").write_text('Timestamp,Date,Band,Album_Name,Song,Duration,Source\n,"2 Jan 2022, 01:00",B,,S,1.5,app\n')
    rows = history.read_csv_scrobbles(spark, str(tmp_path))
    row = ingest.classify_scrobbles(rows, "Europe/Berlin").first()
    assert (row["artist_name"], row["track_name"], row["duration_seconds"]) == ("B", "S", 1)
    assert row["play_ts"] == dt.datetime(2022, 1, 2, 0, 0)


def test_offset_times(spark):
    rows = spark.createDataFrame([(None, "2022-01-01T03:30:00+02:00"), (0, "x")], "e bigint, t string")
    seconds = [r["s"] for r in rows.select(F.unix_seconds(ingest.scrobble_timestamp("e", "t", "Asia/Tokyo")).alias("s")).collect()]
    assert seconds == [1641000600, 0]


def test_text_times(spark):
    texts = ["Jan 1, 2022 10:00 AM", "2022/01/01 10:00", "01/01/2022 10:00", "Sat, 01 Jan 2022 10:00:00 +0000", "1 Jan 2022 10:00",
             "20220101T100000", "20220101T100000Z", "Saturday, 1 Jan 2022, 10:00", "2022-01-01 10:00:00", "Jan 1, 2022 10:00", "soon", None]
    rows = spark.createDataFrame([(None, t) for t in texts], "e bigint, t string")
    seconds = [r["s"] for r in rows.select(F.unix_seconds(ingest.scrobble_timestamp("e", "t")).alias("s")).collect()]
    assert seconds == [1641031200] * 10 + [None, None]


def test_ordinary_spellings_of_dates(spark):
    ten, midnight = 1641031200, 1640995200
    texts = {
        "Jan 1 2022 10:00": ten, "1 January 2022 10:00": ten, "January 1, 2022 10:00 AM": ten, "01.02.2022 10:00": ten + 86400,
        "2022-01-01 10:00 PM": ten + 12 * 3600, "2022-01-01T10:00+0000": ten, "Jan 1, 2022": midnight, "1/1/2022": midnight,
        "1/1/22 10:00": ten, "01 Jan 2022, 10:00:00": ten, "2022/01/01": midnight, "1/1/2022 10:00 AM": ten,
        "Sat Jan  1 10:00:00 2022": ten, "13/01/2022 10:00": ten + 12 * 86400, "1st of Jan 2022 at 10:00": ten, "2022-1-1 10:00": ten,
        "Sat, 1 Jan 2022 12:00 am": midnight, "1 Jan 2022 10:00 +0200": ten - 7200, "10:00 1 Jan 2022 UTC": ten, "2022 Jan 1": midnight,
        "Jan 32 2022": None, "10:00": None, "1 Foo 2022": None, "1/2": None, "13/13/2022": None, "1 Jan 2022 25:00": None,
        "1 Jan 2022 13:00 pm": None, "": None,
    }
    rows = spark.createDataFrame([(None, t) for t in texts], "e bigint, t string")
    got = {r["t"]: r["s"] for r in rows.select("t", F.unix_seconds(ingest.scrobble_timestamp("e", "t")).alias("s")).collect()}
    assert got == texts
    berlin = rows.select("t", F.unix_seconds(ingest.scrobble_timestamp("e", "t", "Europe/Berlin")).alias("s"))
    local = {r["t"]: r["s"] for r in berlin.collect()}
    assert local["Jan 1, 2022"] == midnight - 3600 and local["1 Jan 2022 10:00 +0200"] == ten - 7200


def test_blank_in_header_and_brackets_in_names(spark, tmp_path):
    (tmp_path / "a[1].csv").write_text("uts,artist,track\n1,A,S\n")
    (tmp_path / "b{x}.csv").write_text("uts,artist,track \n2,B,T\n")
    (tmp_path / "c*.csv").write_text("uts,artist,track\n3,C,U\n")
    rows = history.read_csv_scrobbles(spark, str(tmp_path)).orderBy("uts").collect()
    assert [(r["uts"], r["artist_name"], r["track_name"]) for r in rows] == [(1, "A", "S"), (2, "B", "T"), (3, "C", "U")]


def json_value(rng, depth=0):
    kind = rng.randrange(6)
    if kind == 0:
        return rng.choice(["a}b", "{x", '"q"', "\\", "[]", "é日", '"},{"', '\\"}', "\n"])
    if kind == 1 and depth < 3:
        return {rng.choice("abc}{"): json_value(rng, depth + 1) for _ in range(rng.randrange(3))}
    if kind == 2 and depth < 3:
        return [json_value(rng, depth + 1) for _ in range(rng.randrange(3))]
    return rng.choice(["s", 7, None])


def json_object(rng):
    return {rng.choice(["ts", "k}", "n"]) + str(i): json_value(rng) for i in range(rng.randrange(5))}


def test_json_files_in_blocks(spark, tmp_path):
    """Blocks of 300 bytes against a JSON parser: nested values, braces in strings, lists under other names, broken files."""
    rng, expected = random.Random(4), {}
    for n in range(30):
        rows = [json_object(rng) if rng.random() < 0.75 else json_value(rng) for _ in range(rng.randrange(25))]
        kind = rng.randrange(5)
        body = {2: {"meta": json_value(rng), "other": [json_object(rng)] * 2, "plays": rows, "tail": [json_object(rng)]},
                3: {"plays": rows}, 4: {"rows": rows}}.get(kind, rows)
        text = json.dumps(body, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))
        broken = rng.random() < 0.15 and len(text) > 10
        text = text[: rng.randrange(5, len(text) - 1)] if broken else text
        (tmp_path / f"f{n}.json").write_text(("\ufeff" if rng.random() < 0.2 else "") + text, encoding="utf-8")
        expected[f"f{n}.json"] = [] if broken or kind == 4 else [r for r in rows if isinstance(r, dict)]
    settings = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = history.read_json_history(spark, str(tmp_path)).orderBy("source_file", "source_row").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = {name: [] for name in expected}
    for r in found:
        got[r["source_file"].split("/")[-1]].append(json.loads(r["payload"]))
    assert got == expected


def test_reingest_adds_nothing_and_keeps_equal_rows_of_other_files(spark, tmp_path):
    text = "uts,artist,track\n1,A,S\n1,A,S\n2,\"B\nC\",T\n"
    (tmp_path / "a.csv").write_text(text)

    def read():
        return ingest.with_positional_hash(history.read_csv_scrobbles(spark, str(tmp_path)))

    stored = {r["raw_hash"] for r in read().collect()}
    known = spark.createDataFrame([(h,) for h in stored], "raw_hash string")
    assert len(stored) == 3 and ingest.new_scrobbles(read(), known).count() == 0
    (tmp_path / "b.csv").write_text(text)
    (tmp_path / "0.csv").write_text("uts,artist,track\n9,Z,Z\n")
    new = ingest.new_scrobbles(read(), known).collect()
    assert sorted((r["source_file"][-5:], r["source_row"], r["uts"]) for r in new) == [("0.csv", 1, 9), ("b.csv", 1, 1), ("b.csv", 2, 1), ("b.csv", 3, 2)]
    everything = read()
    assert everything.select("raw_hash").distinct().count() == 7


def test_headers_may_differ_below_one_path(spark, tmp_path):
    (tmp_path / "a b.csv").write_text("uts,artist,track\n1,A,S\n2,B,T\n")
    (tmp_path / "b.csv").write_text("Song,Band,Timestamp\nU,C,3\n")
    (tmp_path / "c.csv").write_text("uts,artist,track\n4,D,V\n")
    rows = history.read_csv_scrobbles(spark, str(tmp_path)).orderBy("uts").collect()
    assert [(r["uts"], r["artist_name"], r["track_name"]) for r in rows] == [(1, "A", "S"), (2, "B", "T"), (3, "C", "U"), (4, "D", "V")]


def test_positional_hashes_are_stable_and_distinct(spark):
    lines = spark.createDataFrame([("f", "a")] * 3 + [("f", "b"), ("g", "a")], "source_file string, payload string")
    first = {r["raw_hash"] for r in ingest.positional_hash(lines).collect()}
    again = {r["raw_hash"] for r in ingest.positional_hash(lines.repartition(3)).collect()}
    assert len(first) == 5 and first == again


def test_a_file_that_is_one_block_is_numbered_in_chunks(spark, tmp_path, monkeypatch):
    """one window, so one task, held all records of a file that readers do not split."""
    from tracklore.sources import blocks

    monkeypatch.setattr(blocks, "CHUNK_PLACES", 10)
    places = [*range(25), 40, 41, 2_000_000]
    rows = spark.createDataFrame([("f", 0, p) for p in places] + [("f", 9, 3), ("g", 0, 7), (None, 0, 1)], "source_file string, block long, place long")
    numbered = blocks.with_number(rows, "n")
    assert numbered.columns == ["source_file", "block", "place", "n"]
    got = {(r.source_file, r.block, r.place): r.n for r in numbered.collect()}
    assert got == {**{("f", 0, p): i for i, p in enumerate(places, 1)}, ("f", 9, 3): len(places) + 1, ("g", 0, 7): 1}
    window = numbered._jdf.queryExecution().optimizedPlan().toString().split("windowspecdefinition(")[1]
    assert "_chunk" in window.split("specifiedwindowframe")[0]


def test_the_one_file_of_scrobbles_is_only_copied_by_its_task(spark, tmp_path, monkeypatch):
    """the task that writes the file sorted all of it."""
    from tracklore.catalog import ingest as queries

    plans = []
    stored = type(spark.range(1)).checkpoint
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda df, *a, **k: plans.append(df.explain) or stored(df, *a, **k))
    rows = spark.createDataFrame([(i, dt.datetime(2024, 1, 1, i % 24), i % 5) for i in range(40, 0, -1)], "event_id long, ts timestamp_ntz, user_id long")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    queries._scrobble_file(spark, str(tmp_path), str(tmp_path / "csv"))
    assert len(plans) == 1
    files = list((tmp_path / "csv").glob("*.csv"))
    lines = files[0].read_text().splitlines()
    assert len(files) == 1 and [int(line.rsplit(",", 1)[1]) for line in lines[1:]] == list(range(1, 41))
