import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklore.operators import forests
from tracklore.operators import linkage as k

DDL = (
    "play_id bigint, track_id bigint, album_id bigint, artist_id bigint, ts timestamp, duration_ms bigint, "
    "ms_played bigint, source string, is_duplicate boolean, duplicate_of bigint"
)
START = dt.datetime(2022, 1, 1)


def play(i, seconds, duration, source, track=1, album=1, artist=1):
    return (i, track, album, artist, START + dt.timedelta(seconds=seconds), duration, None, source, False, None)


def seed(**last):
    rows = [
        play(0, 0, 210_000, "spotify"), play(1, 25, 205_000, "lastfm"), play(2, 300, 210_000, "apple_music"),
    ]
    return [*rows, play(3, 365, last.get("duration", 200_000), "lastfm", album=last.get("album", 1))]


def scores(spark, rows, **options):
    plays = spark.createDataFrame(rows, DDL)
    pairs = k.play_pairs(k.classified_pairs(plays, **options), plays).collect()
    return {(r["play_a_id"], r["play_b_id"]): (r["score"], r["decision"]) for r in pairs}


def test_seed_scores(spark):
    assert scores(spark, seed()) == {(0, 1): (90, "merge"), (2, 3): (70, "merge")}
    assert scores(spark, seed(duration=260_000, album=None)) == {(0, 1): (90, "merge"), (2, 3): (50, "review")}
    apart = [play(0, 0, 1, "spotify", track=1), play(1, 10, 1, "lastfm", track=2)]
    assert scores(spark, apart) == {} and scores(spark, apart[:0] or [apart[0]]) == {}


def test_seed_marks_and_reports(spark):
    plays = spark.createDataFrame(seed(), DDL)
    marked = k.dedupe_mark(plays)
    rows = {r["play_id"]: r for r in marked.collect()}
    assert [rows[i]["duplicate_of"] for i in range(4)] == [None, 0, None, 2]
    assert rows[1]["dedupe_confidence"] == 90 and rows[3]["dedupe_winner_source"] == "apple_music"
    assert rows[1]["dedupe_notes"] == "within_30s, same_canonical_track, same_album, duration_match"
    assert k.undo_count(marked).first()["plays_reset"] == 2
    assert k.dedupe_undo(marked).where("is_duplicate or dedupe_notes is not null").count() == 0
    queue = k.review_queue(k.classified_pairs(plays), plays)
    assert k.dedupe_report(marked, queue).first().asDict() == {
        "total_plays": 4, "duplicates_marked": 2, "flagged_for_review": 0
    }


def test_titles_pair_different_tracks(spark):
    rows = [play(0, 0, 100, "spotify", track=1, album=None), play(1, 10, 100, "lastfm", track=2, album=None)]
    titles = spark.createDataFrame([(1, "Paranoid Android"), (2, "Paranoid Androit")], "track_id bigint, title string")
    assert scores(spark, rows, titles=titles) == {(0, 1): (70, "merge")}
    other = spark.createDataFrame([(1, "Paranoid Android"), (2, "Creep")], "track_id bigint, title string")
    assert scores(spark, rows, titles=other) == {}


def test_review_decisions(spark):
    rows = seed(duration=260_000, album=None)
    plays = spark.createDataFrame(rows, DDL)
    queue = k.review_queue(k.classified_pairs(plays), plays)
    ddl = "play_a_id bigint, play_b_id bigint, decision string"
    for decision, duplicate, pending in (("merge", 2, 0), ("keep_both", None, 0), (None, None, 1)):
        decisions = spark.createDataFrame([(2, 3, decision)], ddl)
        updated, resolved = k.review_apply(plays, queue, decisions)
        assert {r["play_id"]: r["duplicate_of"] for r in updated.collect()}[3] == duplicate
        assert k.review_status(resolved).first()["pending"] == pending


# --- against a plain loop ----------------------------------------------------------------


def plain_marks(rows, window=60):
    """Every pair of plays, best first; clusters merge under the better leader."""
    info = {r[0]: r for r in rows}

    def length(r):
        return r[5] or r[6] or None

    def standing(i):
        r = info[i]
        return (-k.SOURCE_PRIORITY.get(r[7], 0), length(r) is None, r[4], i)

    edges = []
    for a, b in itertools.combinations(rows, 2):
        if (a[1], a[3]) != (b[1], b[3]) or a[7] == b[7]:
            continue
        gap = abs((a[4] - b[4]).total_seconds())
        if gap > 120:
            continue
        score = 50 if gap == 0 else 40 if gap <= 30 else 30 if gap <= window else 20
        score += 30 + (10 if a[2] is not None and a[2] == b[2] else 0)
        la, lb = length(a), length(b)
        score += 10 if la and lb and abs(la - lb) <= max(la, lb) * 0.1 else 0
        if score >= 70:
            edges.append((-score, gap, a[0], b[0]))
    leader = {i: i for i in info}

    def top(i):
        while leader[i] != i:
            i = leader[i]
        return i

    lost = {}
    for score, _gap, a, b in sorted(edges):
        ends = sorted({top(a), top(b)}, key=standing)
        if len(ends) == 2:
            leader[ends[1]] = ends[0]
            lost[ends[1]] = -score
    return {i: (top(i), score) for i, score in lost.items()}


def random_rows(seed_value, n, span, copies):
    rng = random.Random(seed_value)
    rows, sources = [], [*k.SOURCE_PRIORITY, "other"]
    for _ in range(n):
        row = play(0, rng.randrange(span), rng.choice([None, 0, 100, 105, 150]), rng.choice(sources),
                   track=rng.choice([1, 1, 1, 2]), album=rng.choice([None, 1, 2]))
        rows += [row] * (rng.randrange(1, copies + 1))
    rng.shuffle(rows)
    return [(i, *row[1:]) for i, row in enumerate(rows)]


@pytest.mark.parametrize(
    ("n", "span", "copies", "small"), [(150, 20_000, 1, 2_000), (150, 3_000, 3, 2_000), (120, 2_500, 2, 3), (60, 60, 2, 0)]
)
def test_marks_equal_plain_loop(spark, n, span, copies, small):
    rows = random_rows(n + span, n, span, copies)
    marked = k.dedupe_mark(spark.createDataFrame(rows, DDL), small=small).where("is_duplicate").collect()
    got = {r["play_id"]: (r["duplicate_of"], r["dedupe_confidence"]) for r in marked}
    expected = plain_marks(rows)
    assert {i: w for i, (w, _s) in got.items()} == {i: w for i, (w, _s) in expected.items()}
    # Which of two equal edges absorbs a play is open, their score is not when no tie is involved.
    assert sorted(s for _w, s in got.values()) == sorted(s for _w, s in expected.values())
    winners = {w for w, _s in got.values()}
    assert not winners & set(got), "a duplicate never points at a duplicate"


def test_hot_play_with_many_copies(spark):
    """A third of all plays are copies of one report; pairs stay few."""
    copies = [play(i, 0, 100, "spotify") for i in range(3000)]
    rest = [play(3000 + i, 10_000 + 500 * i, 100, "lastfm", track=2 + i % 50) for i in range(6000)]
    plays = spark.createDataFrame([*copies, *rest, play(9_999, 20, 100, "lastfm")], DDL)
    pairs = k.classified_pairs(plays)
    assert pairs.count() == 1
    marked = k.dedupe_mark(plays).where("is_duplicate")
    assert marked.count() == 3000 and marked.where("duplicate_of <> 0").count() == 0
    stats = k.dedupe_stats(plays, pairs, k.dedupe_mark(plays)).first()
    assert stats["pairs_scored"] == 3000 and stats["duplicates_merged"] == 3000


def test_one_endless_session_settles_in_rounds(spark):
    rows = [play(i, 20 * i, 100, ["spotify", "lastfm", "manual"][i % 3]) for i in range(90)]
    plays = spark.createDataFrame(rows, DDL)
    edges = k.merge_edges(k.classified_pairs(plays))
    assert edges.select("session_key").distinct().count() == 1
    rounds = {r["report_id"]: r["winner_id"] for r in k.absorb(edges).collect()}
    batch = {r["report_id"]: r["winner_id"] for r in k.settle_clusters(edges, 10**9).collect()}
    assert rounds == batch and set(rounds.values()) == {0} and len(rounds) == 89


def test_empty(spark):
    plays = spark.createDataFrame([], DDL)
    assert k.dedupe_mark(plays).count() == 0
    assert k.dedupe_stats(plays, k.classified_pairs(plays), k.dedupe_mark(plays)).first().asDict() == {
        "plays_considered": 0, "pairs_scored": 0, "duplicates_merged": 0, "flagged_for_review": 0
    }
    assert plays.where(F.col("is_duplicate")).count() == 0


def test_first_reviews_are_those_of_the_whole_queue(spark):
    """the limit is applied before plays are joined; copies and gaps leave the same first rows."""
    rows = [play(i, i % 40 * 7, 1000 + i % 3 * 900, ("spotify", "lastfm", "manual")[i % 3], album=None) for i in range(120)]
    plays = spark.createDataFrame([*rows, *[(1000 + r[0], *r[1:]) for r in rows[:30]]], DDL)
    pairs = k.classified_pairs(plays)
    whole = [r[:] for r in k.review_export(k.review_queue(pairs, plays), plays).collect()]
    assert len(whole) > 50
    for limit in (1, 7, 50, len(whole) + 5):
        assert [r[:] for r in k.review_export(k.review_queue(pairs, plays, limit), plays, limit).collect()] == whole[:limit]
    gone = plays.where("play_id % 4 <> 1")
    left = [r[:] for r in k.review_export(k.review_queue(pairs, plays), gone).collect()]
    assert [r[:] for r in k.review_export(k.review_queue(pairs, plays), gone, 9).collect()] == left[:9]


def outcome(lost):
    return sorted(tuple(r) for r in lost.collect())


@pytest.mark.parametrize(("n", "span", "copies"), [(400, 3_000, 1), (300, 300, 2)])
def test_deciding_pairs_settle_like_all_pairs(spark, monkeypatch, n, span, copies):
    """Few pairs give the clusters, scores and notes of all of them."""
    monkeypatch.setattr(forests, "HELD_PAIRS", 500)
    plays = spark.createDataFrame(random_rows(7 * n + span, n, span, copies), DDL)
    whole = k.cut_lineage(k.classified_pairs(plays).where("decision = 'merge'"))
    few = k.cut_lineage(k.classified_pairs(plays, deciding=True))
    assert sorted(few.columns) == sorted(whole.columns) and few.select(whole.columns).exceptAll(whole).count() == 0
    reports = k.reports(plays).count()
    assert few.count() < 2 * reports and whole.count() > 2 * few.count()
    expected = outcome(k.settle_clusters(k.merge_edges(whole), 10**9))
    assert outcome(k.absorb(k.merge_edges(few), 10**9 if copies > 1 else 40)) == expected
    if copies == 1:
        return
    marked = k.dedupe_mark(plays).where("is_duplicate").select("play_id", "dedupe_confidence", "dedupe_notes")
    monkeypatch.setattr(k, "_deciding_pairs", lambda side, *_: whole)
    assert outcome(marked) == outcome(
        k.dedupe_mark(plays).where("is_duplicate").select("play_id", "dedupe_confidence", "dedupe_notes"))


def test_deciding_pairs_of_many_blocks_over_many_years(spark):
    """times of all blocks, one after the other, pass 64 bits; pairs are still those of each block alone."""
    year, sources = 31_557_600, ("spotify", "lastfm", "manual")
    rows = [play(10 * t + i, year * (t % 900) + 20 * i, 100, sources[i], track=t) for t in range(900) for i in range(3)]
    plays = spark.createDataFrame([*rows, *[play(9_000 + t, year * t, 100, "spotify", track=1_000 + t) for t in range(900)]], DDL)
    whole = k.classified_pairs(plays).where("decision = 'merge'")
    few = k.cut_lineage(k.classified_pairs(plays, deciding=True))
    assert few.where("a_track_id <> b_track_id or diff_us > 120000000").isEmpty()
    assert outcome(k.settle_clusters(k.merge_edges(few))) == outcome(k.settle_clusters(k.merge_edges(whole)))
    assert few.count() == 2 * 900


def test_blocks_with_too_many_edges_wait(spark, monkeypatch):
    rows = [play(i, 20 * i, 100, ["spotify", "lastfm", "manual"][i % 3]) for i in range(60)]
    rows += [play(60 + i, 600, 100 + 50 * i, ["spotify", "lastfm"][i % 2]) for i in range(30)]
    edges = k.merge_edges(k.classified_pairs(spark.createDataFrame(rows, DDL)))
    expected = outcome(k.settle_clusters(edges, 10**9))
    monkeypatch.setattr(k, "MOST_BLOCK_EDGES", 100)
    assert outcome(k.absorb(edges, 30)) == expected


def test_hash_pair_is_that_of_spark(spark):
    rows = [(0, 1), (-5, 2**62), (None, 3), (3, None), (123456789012, -1)]
    got = forests.hash_pair(*(np.array([r[i] or 0 for r in rows]) for i in (0, 1)),
                            *(np.array([r[i] is not None for r in rows]) for i in (0, 1)))
    spark_rows = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a bigint, b bigint")
    assert got.tolist() == [r[0] for r in spark_rows.orderBy("i").select(F.xxhash64("a", "b")).collect()]
