"""Registered record-linkage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklore.catalog import sql_text as sx
from tracklore.catalog import tables as t
from tracklore.catalog.registry import query
from tracklore.operators import linkage as k

PAIRS = t.EVENT_PLAYS + """,
lp AS (SELECT *, epoch_us(ts) AS us, coalesce(nullif(duration_ms, 0), nullif(ms_played, 0)) AS dur FROM plays
       WHERE track_id IS NOT NULL AND artist_id IS NOT NULL),
p0 AS (SELECT a.play_id AS a_id, b.play_id AS b_id, a.track_id, b.us - a.us AS diff,
              coalesce(a.album_id = b.album_id, FALSE) AS same_album,
              coalesce(abs(a.dur - b.dur) <= greatest(a.dur, b.dur) * 0.1::DOUBLE, FALSE) AS same_dur
       FROM lp a JOIN lp b ON a.track_id = b.track_id AND a.artist_id = b.artist_id AND a.source <> b.source
            AND (a.us < b.us OR (a.us = b.us AND a.play_id < b.play_id)) AND b.us - a.us <= 120000000),
pairs AS (SELECT least(a_id, b_id) AS play_a_id, greatest(a_id, b_id) AS play_b_id,
                 CAST(CASE WHEN diff = 0 THEN 50 WHEN diff <= 30000000 THEN 40 WHEN diff <= 60000000 THEN 30 ELSE 20 END
                      + 30 + CASE WHEN same_album THEN 10 ELSE 0 END + CASE WHEN same_dur THEN 10 ELSE 0 END AS INTEGER)
                 AS score,
                 concat_ws(', ', CASE WHEN diff = 0 THEN 'exact_timestamp' WHEN diff <= 30000000 THEN 'within_30s'
                                 WHEN diff <= 60000000 THEN 'within_60s' ELSE 'within_120s' END,
                           'same_canonical_track', CASE WHEN same_album THEN 'same_album' END,
                           CASE WHEN same_dur THEN 'duration_match' END) AS reason
          FROM p0),
classified AS (SELECT *, CASE WHEN score >= 70 THEN 'merge' WHEN score >= 50 THEN 'review' END AS decision FROM pairs),
queue AS (SELECT play_a_id, play_b_id, score AS confidence, reason, FALSE AS resolved FROM classified
          WHERE decision = 'review'),
links AS (SELECT play_a_id AS x, play_b_id AS y FROM classified WHERE decision = 'merge'
          UNION ALL SELECT play_b_id, play_a_id FROM classified WHERE decision = 'merge'),
reach AS (SELECT DISTINCT x, x AS y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
marks AS (SELECT x AS play_id, w AS duplicate_of, ws FROM (
            SELECT reach.x, lp.play_id AS w, lp.source AS ws, row_number() OVER (PARTITION BY reach.x ORDER BY
                     CASE source WHEN 'spotify' THEN 4 WHEN 'apple_music' THEN 3 WHEN 'lastfm' THEN 2
                                 WHEN 'manual' THEN 1 ELSE 0 END DESC, dur IS NULL, us, play_id) AS rn
            FROM reach JOIN lp ON lp.play_id = reach.y) WHERE rn = 1 AND x <> w)"""
WITH = "WITH RECURSIVE " + PAIRS


def _dense(sql: str) -> str:
    """Fewer, busier tracks, so that clusters of several edges appear."""
    return sql.replace("k AS track_id", "k % 10 AS track_id").replace("k % 20 AS artist_id", "k % 10 AS artist_id")


def _dense_plays(spark, d):
    return t.event_plays(spark, d).withColumns({"track_id": F.col("track_id") % 10, "artist_id": F.col("track_id") % 10})


def _pairs(spark, d):
    return k.classified_pairs(t.event_plays(spark, d))


@query("dedupe_pairs", f"{WITH} SELECT play_a_id, play_b_id FROM classified")
def _(spark, d):
    plays = t.event_plays(spark, d)
    return k.play_pairs(k.report_pairs(plays), plays).select("play_a_id", "play_b_id")


@query("dedupe_score", f"{WITH} SELECT play_a_id, play_b_id, score, reason FROM classified")
def _(spark, d):
    plays = t.event_plays(spark, d)
    return k.play_pairs(_pairs(spark, d), plays).select("play_a_id", "play_b_id", "score", "reason")


@query("dedupe_classify", _dense(f"{WITH} SELECT play_a_id, play_b_id, score, reason, decision FROM classified"))
def _(spark, d):
    plays = _dense_plays(spark, d)
    listed = k.play_pairs(k.classified_pairs(plays), plays)
    return listed.select("play_a_id", "play_b_id", "score", "reason", "decision")


@query("dedupe_clusters", _dense(f"{WITH} SELECT play_id, duplicate_of FROM marks"))
def _(spark, d):
    lost = k.settle_clusters(k.merge_edges(k.classified_pairs(_dense_plays(spark, d), deciding=True)))
    return lost.select(F.col("report_id").alias("play_id"), F.col("winner_id").alias("duplicate_of"))


@query("dedupe_clusters_distributed", _dense(f"{WITH} SELECT play_id, duplicate_of FROM marks"))
def _(spark, d):
    """The rounds that long sessions go through, run on every session."""
    lost = k.absorb(k.merge_edges(k.classified_pairs(_dense_plays(spark, d), deciding=True)))
    return lost.select(F.col("report_id").alias("play_id"), F.col("winner_id").alias("duplicate_of"))


@query(
    "dedupe_mark",
    _dense(f"""{WITH} SELECT lp.play_id, marks.play_id IS NOT NULL AS is_duplicate, duplicate_of,
    ws AS dedupe_winner_source FROM lp LEFT JOIN marks ON marks.play_id = lp.play_id"""),
)
def _(spark, d):
    marked = k.dedupe_mark(_dense_plays(spark, d))
    return marked.select("play_id", "is_duplicate", "duplicate_of", "dedupe_winner_source")


@query("dedupe_review_queue", f"{WITH} SELECT * FROM queue")
def _(spark, d):
    return k.review_queue(_pairs(spark, d), t.event_plays(spark, d))


@query(
    "dedupe_stats",
    f"""{WITH} SELECT (SELECT count(*) FROM lp) AS plays_considered, (SELECT count(*) FROM classified) AS pairs_scored,
    (SELECT count(*) FROM marks) AS duplicates_merged, (SELECT count(*) FROM queue) AS flagged_for_review""",
)
def _(spark, d):
    plays, pairs = t.event_plays(spark, d), _pairs(spark, d)
    return k.dedupe_stats(plays, pairs, k.dedupe_mark(plays))


@query("dedupe_merge_winners", _dense(f"{WITH} SELECT ws AS source, count(*) AS merged FROM marks GROUP BY 1"))
def _(spark, d):
    return k.merge_winners(k.dedupe_mark(_dense_plays(spark, d)))


@query(
    "dedupe_report",
    f"""{WITH} SELECT (SELECT count(*) FROM plays) AS total_plays, (SELECT count(*) FROM marks) AS duplicates_marked,
    (SELECT count(*) FROM queue) AS flagged_for_review""",
)
def _(spark, d):
    plays = t.event_plays(spark, d)
    return k.dedupe_report(k.dedupe_mark(plays), k.review_queue(_pairs(spark, d), plays))


REVIEW_EXPORT = """ SELECT confidence, reason, play_a_id, a.source AS source_a, epoch_us(a.ts) AS us_a,
    a.duration_ms AS duration_a, play_b_id, b.source AS source_b, epoch_us(b.ts) AS us_b, b.duration_ms AS duration_b
    FROM queue JOIN plays a ON a.play_id = play_a_id JOIN plays b ON b.play_id = play_b_id"""


def _export(spark, d, plays, limit=None):
    listed = k.review_export(k.review_queue(k.classified_pairs(plays), plays, limit), plays, limit)
    sides = [
        column
        for end in "ab"
        for column in (
            F.col(f"play_{end}.id").alias(f"play_{end}_id"),
            F.col(f"play_{end}.source").alias(f"source_{end}"),
            F.unix_micros(F.col(f"play_{end}.timestamp").cast("timestamp")).alias(f"us_{end}"),
            F.col(f"play_{end}.duration_ms").alias(f"duration_{end}"),
        )
    ]
    return listed.select("confidence", "reason", *sides)


@query("dedupe_review_export", WITH + REVIEW_EXPORT)
def _(spark, d):
    return _export(spark, d, t.event_plays(spark, d))


@query(
    "dedupe_review_export_100",
    _dense(WITH + REVIEW_EXPORT + " ORDER BY confidence DESC, play_a_id, play_b_id LIMIT 100"),
)
def _(spark, d):
    return _export(spark, d, _dense_plays(spark, d), 100)


# Decisions by the pair's ids: a third merged, a third kept, a third left open.
DECIDE = "CASE (play_a_id + play_b_id) % 3 WHEN 0 THEN 'merge' WHEN 1 THEN 'keep_both' END"
DECISIONS = f"decisions AS (SELECT play_a_id, play_b_id, {DECIDE} AS decision FROM queue)"


def _review(spark, d):
    plays = t.event_plays(spark, d).withColumn("duplicate_of", F.lit(None).cast("bigint"))
    queue = k.review_queue(k.classified_pairs(plays), plays)
    return plays, queue, queue.select("play_a_id", "play_b_id", F.expr(DECIDE).alias("decision"))


@query(
    "review_apply",
    f"""{WITH}, {DECISIONS} SELECT play_id, w IS NOT NULL AS is_duplicate, w AS duplicate_of FROM plays LEFT JOIN (
    SELECT play_b_id AS play_id, max(play_a_id) AS w FROM decisions WHERE decision = 'merge' GROUP BY 1)
    USING (play_id)""",
)
def _(spark, d):
    updated, _queue = k.review_apply(*_review(spark, d))
    return updated.select("play_id", "is_duplicate", "duplicate_of")


@query(
    "review_resolved",
    f"{WITH}, {DECISIONS} SELECT play_a_id, play_b_id, decision IS NOT NULL AS resolved FROM decisions",
)
def _(spark, d):
    _plays, queue = k.review_apply(*_review(spark, d))
    return queue.select("play_a_id", "play_b_id", "resolved")


@query(
    "review_counts",
    f"{WITH}, {DECISIONS} SELECT count(decision) AS applied, count(*) - count(decision) AS skipped FROM decisions",
)
def _(spark, d):
    return k.review_counts(_review(spark, d)[2])


@query("review_status", f"{WITH}, {DECISIONS} SELECT count(*) - count(decision) AS pending FROM decisions")
def _(spark, d):
    return k.review_status(k.review_apply(*_review(spark, d))[1])


@query("dedupe_undo", f"{WITH} SELECT count(*) AS plays_reset FROM marks")
def _(spark, d):
    return k.undo_count(k.dedupe_mark(t.event_plays(spark, d)))


@query("dedupe_undo_plays", f"{WITH} SELECT play_id, FALSE AS is_duplicate, NULL::BIGINT AS duplicate_of FROM plays")
def _(spark, d):
    return k.dedupe_undo(k.dedupe_mark(t.event_plays(spark, d))).select("play_id", "is_duplicate", "duplicate_of")


FUZZY_TITLES = t.EVENT_PLAYS + f""",
lp AS (SELECT *, epoch_us(ts) AS us, coalesce(nullif(duration_ms, 0), nullif(ms_played, 0)) AS dur FROM plays
       WHERE track_id IS NOT NULL AND artist_id IS NOT NULL),
titled AS (SELECT lp.*, coalesce(p_name, '') AS title FROM lp LEFT JOIN part ON p_partkey = track_id),
near AS (SELECT a.play_id AS a_id, b.play_id AS b_id, b.us - a.us AS diff, a.track_id = b.track_id AS same_track,
                a.title AS a_title, b.title AS b_title, coalesce(a.album_id = b.album_id, FALSE) AS same_album,
                coalesce(abs(a.dur - b.dur) <= greatest(a.dur, b.dur) * 0.1::DOUBLE, FALSE) AS same_dur
         FROM titled a JOIN titled b ON a.artist_id = b.artist_id AND a.source <> b.source
              AND (a.us < b.us OR (a.us = b.us AND a.play_id < b.play_id)) AND b.us - a.us <= 120000000),
alike AS (SELECT *, CASE WHEN a_title <> '' AND b_title <> '' THEN {sx.ratio('a_title', 'b_title')} ELSE 0 END AS ratio FROM near),
scored AS (SELECT *, CAST(CASE WHEN diff = 0 THEN 50 WHEN diff <= 30000000 THEN 40 WHEN diff <= 60000000 THEN 30 ELSE 20 END
                + CASE WHEN same_track THEN 30 ELSE 20 END + CASE WHEN same_album THEN 10 ELSE 0 END
                + CASE WHEN same_dur THEN 10 ELSE 0 END AS INTEGER) AS score,
              concat_ws(', ', CASE WHEN diff = 0 THEN 'exact_timestamp' WHEN diff <= 30000000 THEN 'within_30s'
                              WHEN diff <= 60000000 THEN 'within_60s' ELSE 'within_120s' END,
                        CASE WHEN same_track THEN 'same_canonical_track' ELSE printf('fuzzy_track_%.2f', ratio) END,
                        CASE WHEN same_album THEN 'same_album' END, CASE WHEN same_dur THEN 'duration_match' END) AS reason
           FROM alike WHERE same_track OR ratio >= {k.TITLE_THRESHOLD})"""


@query(
    "dedupe_fuzzy_titles",
    f"""WITH {FUZZY_TITLES} SELECT least(a_id, b_id) AS play_a_id, greatest(a_id, b_id) AS play_b_id, score, reason,
    CASE WHEN score >= 70 THEN 'merge' WHEN score >= 50 THEN 'review' END AS decision FROM scored""",
)
def _(spark, d):
    """Artist-wide pairing by title instead of by track."""
    titles = t.tracks(spark, d).select(F.col("id").alias("track_id"), "title")
    plays = t.event_plays(spark, d)
    pairs = k.play_pairs(k.classified_pairs(plays, titles=titles), plays)
    return pairs.select("play_a_id", "play_b_id", "score", "reason", "decision")
