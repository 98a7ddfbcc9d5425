"""Finding the same play reported by two sources.

Plays that agree in everything a score looks at (track, artist, album, time, durations, source) form one *report*
with a number of copies. Copies of one source never pair with each other, so pairs are built between reports: a third
of all rows being copies of one play costs one report, not a quadratic set of pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tracklore.functions.similarity import indel_ratio
from tracklore.functions.timeparts import micros
from tracklore.operators import forests
from tracklore.operators.skew import DEFAULT_SALTS, salted_join
from tracklore.session import cut_lineage

# Which source wins, and what a pair of plays scores.
SOURCE_PRIORITY = {"spotify": 4, "apple_music": 3, "lastfm": 2, "manual": 1}
WINDOW_SECONDS = 60
WIDEST_SECONDS = 120
CLOSE_SECONDS = 30
POINTS = {"exact": 50, "close": 40, "window": 30, "wide": 20, "track": 30, "fuzzy": 20, "album": 10, "duration": 10}
MERGE_SCORE = 70
REVIEW_SCORE = 50
DURATION_TOLERANCE = 0.10
TITLE_THRESHOLD = 0.9

SECOND = 1_000_000
DEDUPE_COLUMNS = ["dedupe_confidence", "dedupe_notes", "dedupe_winner_source"]
REPORT_KEYS = ["artist_id", "track_id", "album_id", "us", "source", "duration_ms", "ms_played"]


def linkable(plays: DataFrame) -> DataFrame:
    return plays.where("track_id is not null and artist_id is not null").withColumn("us", micros())


def reports(plays: DataFrame) -> DataFrame:
    """One row per distinct report: `report_id` is its lowest play id, `copies` its number of plays."""
    known = F.coalesce(F.nullif("duration_ms", F.lit(0)), F.nullif("ms_played", F.lit(0)))
    return (
        linkable(plays)
        .groupBy(*REPORT_KEYS)
        .agg(F.min("play_id").alias("report_id"), F.count("*").alias("copies"))
        .withColumn("dur", known)
    )


# --- pairs -------------------------------------------------------------------------------


def report_pairs(
    plays: DataFrame, window_seconds: int = WINDOW_SECONDS, titles: DataFrame | None = None, deciding: bool = False,
    duration_tolerance: float = DURATION_TOLERANCE
) -> DataFrame:
    """Pairs of reports of one artist from different sources, close in time, the earlier one first.

    Time is cut into slots as wide as the widest distance, so partners sit in the same or the next slot, and the
    join is an equi-join on (artist, track, slot): a popular track is spread over its slots. `session_key` names
    the run of slots without a longer pause, which no pair crosses. With `titles` (track_id, title) the track
    leaves the key, so different tracks of an artist can pair by title. A list of all pairs is what this reports;
    its length is the number of reports that really lie that close. With `deciding` and without titles only those pairs
    are listed that can settle a cluster, at most about two a report: see `_deciding_pairs`.
    """
    widest = max(window_seconds, WIDEST_SECONDS) * SECOND
    scope = ["artist_id"] if titles is not None else ["artist_id", "track_id"]
    keys = [*scope, "slot"]
    side = reports(plays).withColumn("slot", F.floor(F.col("us") / widest))
    if titles is not None:
        side = salted_join(side, titles.select("track_id", "title"), ["track_id"], F.col("report_id"), "left")
    side = cut_lineage(side)  # read four times below; the plays behind it only once
    in_time = W.Window.partitionBy(*scope).orderBy("slot")
    sessions = (
        side.groupBy(*keys)
        .agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
        .withColumn("starts", F.coalesce((F.col("lo") - F.lag("hi").over(in_time) > widest).cast("int"), F.lit(0)))
        .select(*keys, F.xxhash64(*scope, F.sum("starts").over(in_time)).alias("session_key"))
    )
    fields = [c for c in side.columns if c not in keys]
    if deciding and titles is None:
        return _deciding_pairs(side.join(sessions, keys), scope, fields, widest, window_seconds, duration_tolerance)
    a = side.select(*keys, *[F.col(c).alias(f"a_{c}") for c in fields])
    b = side.withColumn("slot", F.explode(F.array(F.col("slot") - 1, F.col("slot")))).select(
        *keys, *[F.col(c).alias(f"b_{c}") for c in fields]
    )
    distance = F.col("b_us") - F.col("a_us")
    earlier = (distance > 0) | ((distance == 0) & (F.col("a_report_id") < F.col("b_report_id")))
    near = earlier & (distance <= widest)
    # Name the partner's source in the key: a dense run of one source then meets other sources only, and the
    # candidates stay within a small factor of the pairs.
    partners = b.select(*keys, "b_source").distinct()
    # Reports carry their session into the pairs: the pairs, which can be many times the reports, are not shuffled for it.
    asking = a.join(sessions, keys).join(partners, keys).where("a_source <> b_source")
    pairs = asking.join(b, [*keys, "b_source"]).where(near).withColumn("diff_us", distance)
    if titles is None:
        pairs = pairs.withColumn("a_track_id", F.col("track_id")).withColumn("b_track_id", F.col("track_id"))
    pairs = pairs.withColumns({"a_artist_id": F.col("artist_id"), "b_artist_id": F.col("artist_id")})
    return pairs.drop("slot", "artist_id", "track_id")


#: Slots of a block of time, whose last slot meets the first of the next block, and reports of a task.
BLOCK_SLOTS, TASK_REPORTS = 8, 100_000


def _deciding_pairs(
    side: DataFrame, scope: list[str], fields: list[str], widest: int, window_seconds: int, tolerance: float
) -> DataFrame:
    """Of the merging pairs of each (scope, block of slots) those of a minimum spanning forest under the order of
    `merge_edges`, and the first pair of each report with copies.

    Clusters come from taking pairs in that order, and a pair whose reports earlier pairs connect changes nothing, so
    winners, confidence and notes are those of all pairs. A report meets every partner within `widest` in its task, which
    never holds or sends them all.
    """
    close, window = CLOSE_SECONDS * SECOND, window_seconds * SECOND

    def merging(diff, same_album, off, longer, timed):
        """The score of a pair, 0 where it does not merge."""
        bands = [diff == 0, diff <= close, diff <= window, diff <= WIDEST_SECONDS * SECOND]
        points = np.select(bands, [POINTS[name] for name in ("exact", "close", "window", "wide")], -1000)
        score = points + POINTS["track"] + POINTS["album"] * same_album
        score = score + POINTS["duration"] * (timed & (off <= longer * tolerance))
        return np.where(score >= MERGE_SCORE, score, 0)

    placed = side.where("us is not null and source is not null").withColumn(
        "_places", F.expr(f"if(pmod(slot, {BLOCK_SLOTS}) = 0, array(0, 1), array(0))"))
    placed = placed.withColumn("_back", F.explode("_places")).select(
        *scope, F.expr(f"floor(slot / {BLOCK_SLOTS}) - _back").cast("bigint").alias("block"),
        (F.col("_back") > 0).alias("halo"), "session_key", *fields)
    batches = side.count() // TASK_REPORTS + 1
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    columns = [*scope, "session_key"]
    ddl = ", ".join([*[f"{c} {kinds[c]}" for c in columns], *[f"{end}_{c} {kinds[c]}" for end in "ab" for c in fields],
                     "diff_us bigint"])
    work = forests.deciding_pairs(scope, fields, widest, merging)
    batch = F.pmod(F.xxhash64(*scope, "block"), F.lit(batches)).alias("batch")
    found = placed.groupBy(batch).applyInArrow(work, ddl)
    found = found.withColumns({f"{end}_{c}": F.col(c) for end in "ab" for c in scope})
    return found.drop(*scope)


def score_pairs(
    pairs: DataFrame,
    window_seconds: int = WINDOW_SECONDS,
    duration_tolerance: float = DURATION_TOLERANCE,
    title_threshold: float = TITLE_THRESHOLD,
) -> DataFrame:
    """Adds `score` and `reason`; pairs that fail on time or title disappear."""
    diff = F.col("diff_us")
    same_album = F.coalesce(F.col("a_album_id") == F.col("b_album_id"), F.lit(False))
    off = F.abs(F.col("a_dur") - F.col("b_dur"))
    same_duration = F.coalesce(off <= F.greatest("a_dur", "b_dur") * F.lit(duration_tolerance), F.lit(False))
    bands = [
        (diff == 0, POINTS["exact"], "exact_timestamp"),
        (diff <= CLOSE_SECONDS * SECOND, POINTS["close"], "within_30s"),
        (diff <= window_seconds * SECOND, POINTS["window"], f"within_{window_seconds}s"),
        (diff <= WIDEST_SECONDS * SECOND, POINTS["wide"], "within_120s"),
    ]
    time_points = F.coalesce(*[F.when(test, points) for test, points, _ in bands])
    time_label = F.coalesce(*[F.when(test, label) for test, _, label in bands])
    track_points, track_label = F.lit(POINTS["track"]), F.lit("same_canonical_track")
    scored = pairs.where(time_points.isNotNull())
    if "a_title" in pairs.columns:
        same_track = F.col("a_track_id") == F.col("b_track_id")
        a, b = F.coalesce("a_title", F.lit("")), F.coalesce("b_title", F.lit(""))
        titled = (a != "") & (b != "")
        # Levenshtein never exceeds the insert/delete distance, so this JVM test drops no match before the UDF.
        plausible = F.levenshtein(a, b) <= (F.length(a) + F.length(b)) * F.lit(1 - title_threshold) + 1e-9
        scored = scored.where(same_track | (titled & plausible)).withColumn("similarity", indel_ratio(a, b))
        scored = scored.where(same_track | (F.col("similarity") >= title_threshold))
        track_points = F.when(same_track, POINTS["track"]).otherwise(POINTS["fuzzy"])
        fuzzy_label = F.format_string("fuzzy_track_%.2f", F.col("similarity"))
        track_label = F.when(same_track, "same_canonical_track").otherwise(fuzzy_label)
    extras = [(same_album, POINTS["album"], "same_album"), (same_duration, POINTS["duration"], "duration_match")]
    score = time_points + track_points
    for test, points, _ in extras:
        score = score + F.when(test, points).otherwise(0)
    reason = F.concat_ws(", ", time_label, track_label, *[F.when(test, label) for test, _, label in extras])
    return scored.withColumn("score", score.cast("int")).withColumn("reason", reason)


def classify_pairs(scored: DataFrame) -> DataFrame:
    decision = F.when(F.col("score") >= MERGE_SCORE, "merge").when(F.col("score") >= REVIEW_SCORE, "review")
    return scored.withColumn("decision", decision)


def classified_pairs(plays: DataFrame, window_seconds: int = WINDOW_SECONDS, titles: DataFrame | None = None,
                     deciding: bool = False, **options: float) -> DataFrame:
    tolerance = options.get("duration_tolerance", DURATION_TOLERANCE)
    pairs = report_pairs(plays, window_seconds, titles, deciding, tolerance)
    return classify_pairs(score_pairs(pairs, window_seconds, **options))


def _same_report(left: DataFrame, right: DataFrame, prefix: str) -> Column:
    condition = F.lit(True)
    for key in REPORT_KEYS:
        condition = condition & left[key].eqNullSafe(right[f"{prefix}_{key}"])
    return condition


def play_pairs(pairs: DataFrame, plays: DataFrame) -> DataFrame:
    """Report pairs spelled out as play pairs, ids in order. Only lists for people need this form."""
    rows = linkable(plays).select("play_id", *REPORT_KEYS)
    result = cut_lineage(pairs)
    copied = result.agg(*[F.max(F.col(f"{end}_copies") > 1).alias(end) for end in "ab"]).first()
    for end in "ab":
        # Reports with one copy are already plays; only the others look up their copies.
        single = result.where(F.col(f"{end}_copies") == 1).withColumn(f"{end}_id", F.col(f"{end}_report_id"))
        if copied[end]:
            several = result.where(F.col(f"{end}_copies") > 1)
            members = rows.withColumnRenamed("play_id", f"{end}_id")
            spelled = several.join(members, _same_report(members, several, end)).select(*several.columns, f"{end}_id")
            single = single.unionByName(spelled)
        result = single
    return result.withColumn("play_a_id", F.least("a_id", "b_id")).withColumn("play_b_id", F.greatest("a_id", "b_id"))


# --- clusters ----------------------------------------------------------------------------


def source_rank(source: Column) -> Column:
    return F.coalesce(*[F.when(source == name, rank) for name, rank in SOURCE_PRIORITY.items()], F.lit(0))


def _standing(end: str) -> Column:
    """Ascending order of preference as winner: source, has a duration, earliest, lowest id."""
    return F.struct(
        (-source_rank(F.col(f"{end}_source"))).alias("source"),
        F.col(f"{end}_dur").isNull().cast("int").alias("duration"),
        F.col(f"{end}_us").alias("us"),
        F.col(f"{end}_report_id").alias("id"),
    )


def merge_edges(pairs: DataFrame) -> DataFrame:
    """Edges of the duplicate graph under a total order `w`: score desc, distance asc, then a hash of the ids.

    The hash makes the order among equals look random, which keeps the number of rounds in `absorb` logarithmic.
    """
    order = F.struct(
        (-F.col("score")).alias("score"),
        F.col("diff_us"),
        F.xxhash64("a_report_id", "b_report_id").alias("tie"),
        F.col("a_report_id").alias("a"),
        F.col("b_report_id").alias("b"),
    )
    return pairs.where("decision = 'merge'").select(
        "session_key", _standing("a").alias("a"), _standing("b").alias("b"), order.alias("w"), "reason"
    )


CLUSTER_DDL = "report_id bigint, winner_id bigint, score int, reason string"


#: Edges that a block of time is planned for and may have.
BLOCK_EDGES, MOST_BLOCK_EDGES = 50_000, 1_000_000


def _flat(end: str, fields: list[str]) -> list[Column]:
    return [F.col(f"{end}.{f}").alias(f"{end}_{f}") for f in fields]


def _nested(end: str, fields: list[str]) -> Column:
    return F.struct(*[F.col(f"{end}_{f}").alias(f) for f in fields]).alias(end)


def _block_round(current: DataFrame, edges: int, lo: int, hi: int, block_edges: int) -> tuple[DataFrame, DataFrame]:
    """(losses, remaining edges) after clusters settled within blocks of time.

    A node belongs to the block of its own time; an edge goes to the blocks of both its ends, so a block sees all edges
    of its nodes. Edges between blocks come back once from each side, with the leader of that side. Blocks with too many
    edges for a task wait.
    """
    width = max((hi - lo + 1) * block_edges // edges, 1)
    placed = current.withColumns({f"{end}_block": F.expr(f"({end}.us - {lo}) div {width}") for end in "ab"})
    both = F.array_distinct(F.array("a_block", "b_block"))
    sizes = placed.select(F.explode(both).alias("block")).groupBy("block").count()
    heavy = [row["block"] for row in sizes.where(F.col("count") > MOST_BLOCK_EDGES).collect()]
    light = F.filter(both, lambda block: ~block.isin(heavy)) if heavy else both
    placed = placed.withColumn("_blocks", light)
    sent = placed.withColumn("block", F.explode("_blocks")).select(
        "block", "edge", "reason", *[(F.col(f"{end}_block") == F.col("block")).alias(f"{end}_in") for end in "ab"],
        *_flat("a", forests.STANDING), *_flat("b", forests.STANDING), *_flat("w", forests.ORDER))
    kinds = {f.name: f.dataType.simpleString() for f in sent.schema.fields}
    order = [f"w_{f}" for f in forests.ORDER]
    node = [f"{{}}_{f} {kinds[f'a_{f}']}" for f in forests.STANDING]
    ddl = ", ".join(["kind int, edge bigint", *[f.format(name) for name in ("a", "b", "top") for f in node],
                     *[f"{c} {kinds[c]}" for c in order], "reason string"])
    done = sent.groupBy("block").applyInArrow(forests.settle_blocks, ddl)
    done = cut_lineage(done.select(
        "kind", "edge", *[_nested(end, forests.STANDING) for end in ("a", "b", "top")], _nested("w", forests.ORDER), "reason"))
    lost = done.where("kind = 0").select(
        F.col("a").alias("me"), F.struct("w", F.col("b").alias("other"), "reason").alias("e"), "top")
    def side(kind: int, end: str) -> Column:
        return F.min(F.when(F.col("kind") == kind, F.col(end)))

    # A side whose block waited sends nothing; then the other side has that end as it was.
    between = done.where("kind > 1").groupBy("edge", "w").agg(
        F.coalesce(side(2, "a"), side(3, "a")).alias("a"), F.coalesce(side(3, "b"), side(2, "b")).alias("b"),
        F.min("reason").alias("reason"))
    columns = ["edge", "a", "b", "w", "reason"]
    left = done.where("kind = 1").select(*columns).unionByName(between.select(*columns))
    return lost, left.unionByName(placed.where(F.size("_blocks") == 0).select(*columns)) if heavy else left


def absorb(edges: DataFrame, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """Cluster winner of every losing report, with the score and reason of the edge on which it lost.

    Same outcome as taking edges in order and merging clusters under the better leader, without any cluster in one
    place. A cluster looks at its first edge in order: if the leader on the other side is better, this is exactly
    where its own leader loses, whatever the other side did before. All clusters do so at once, edge ends are
    renamed to the leaders that remain, and the rest repeats.

    First this happens within blocks of time, as often as it can, for nodes whose edges are all there; with fewer edges
    left blocks get wider. Once that no longer takes a fifth of the edges away, rounds over all edges do the rest.
    """
    current = cut_lineage(edges.select("a", "b", "w", "reason", F.xxhash64("a", "b").alias("edge")))
    rounds, losses, before = [], [], None
    while True:
        seen = current.agg(F.count("*").alias("n"), F.min(F.least("a.us", "b.us")).alias("lo"),
                           F.max(F.greatest("a.us", "b.us")).alias("hi")).first()
        if not seen["n"] or (before and seen["n"] > 0.8 * before):
            break
        before = seen["n"]
        lost, left = _block_round(current, seen["n"], seen["lo"], seen["hi"], block_edges)
        rounds.append(lost)
        current = cut_lineage(left)
    current = current.drop("edge")
    while seen["n"]:
        ends = current.select(F.col("a").alias("me"), F.col("b").alias("other"), "w", "reason").unionByName(
            current.select(F.col("b").alias("me"), F.col("a").alias("other"), "w", "reason")
        )
        first = ends.groupBy("me").agg(F.min(F.struct("w", "other", "reason")).alias("e"))
        lost = cut_lineage(first.where(F.col("e.other") < F.col("me")))
        if lost.isEmpty():
            break
        losses.append(lost)
        leaders = _top(lost.select(F.col("me").alias("node"), F.col("e.other").alias("up")))
        renamed = _rename(_rename(current, leaders, "a"), leaders, "b")
        current = cut_lineage(renamed.where(F.col("a.id") != F.col("b.id")))
    settled = None
    if losses:
        links = losses[0]
        for lost in losses[1:]:
            links = links.unionByName(lost)
        winners = _top(links.select(F.col("me").alias("node"), F.col("e.other").alias("up")))
        settled = cut_lineage(links.join(winners.withColumnRenamed("node", "me"), "me").select("me", "e", "up"))
    for lost in reversed(rounds):
        ended = lost.withColumnRenamed("top", "up")
        if settled is not None:
            later = settled.select(F.col("me").alias("up"), F.col("up").alias("higher"))
            ended = salted_join(ended, later, ["up"], F.col("me"), "left")
            ended = settled.unionByName(ended.select("me", "e", F.coalesce("higher", "up").alias("up")))
        settled = ended if lost is rounds[0] else cut_lineage(ended.select("me", "e", "up"))
    if settled is None:
        return edges.sparkSession.createDataFrame([], CLUSTER_DDL)
    return settled.select(
        F.col("me.id").alias("report_id"),
        F.col("up.id").alias("winner_id"),
        (-F.col("e.w.score")).alias("score"),
        F.col("e.reason").alias("reason"),
    )


def _top(links: DataFrame) -> DataFrame:
    """Follow node -> up to the end by pointer doubling. Links go to a better leader, so there are no cycles."""
    while True:
        above = links.select(F.col("node").alias("up"), F.col("up").alias("higher"))
        step = cut_lineage(salted_join(links, above, ["up"], F.col("node"), "left"))
        links = step.select("node", F.coalesce("higher", "up").alias("up"))
        if step.where("higher is not null").isEmpty():
            return links


def _rename(edges: DataFrame, leaders: DataFrame, end: str) -> DataFrame:
    """Replace one edge end by its leader. A hub may own many edges, so the lookup is salted by the edge."""
    lookup = leaders.select(F.col("node").alias(end), F.col("up").alias("_up"))
    joined = salted_join(edges, lookup, [end], F.struct("w.a", "w.b"), "left")
    return joined.withColumn(end, F.coalesce("_up", end)).drop("_up")


SMALL_SESSION_EDGES = 2_000
EDGES_PER_BATCH = 50_000


def settle_clusters(edges: DataFrame, small: int = SMALL_SESSION_EDGES) -> DataFrame:
    """Clusters of all sessions: one edge in SQL, up to `small` edges in memory, more through `absorb`.

    No edge leaves its session, so sessions settle independently and the three ways give the same result.
    """
    edges = cut_lineage(edges)
    sizes = edges.groupBy("session_key").agg(F.count("*").alias("n"))
    sized = salted_join(edges, sizes, ["session_key"], F.struct("w.a", "w.b"))
    better, worse = F.least("a", "b"), F.greatest("a", "b")
    settled = sized.where("n = 1").select(
        worse["id"].alias("report_id"), better["id"].alias("winner_id"), (-F.col("w.score")).alias("score"), "reason"
    )
    totals = sizes.agg(
        F.count_if(F.col("n") > small).alias("large"), F.sum(F.when(F.col("n").between(2, small), F.col("n"))).alias("e")
    ).first()
    if totals["e"]:
        # Whole sessions are batched by hash, so a batch holds about EDGES_PER_BATCH edges.
        batches = 1 + totals["e"] // EDGES_PER_BATCH
        flat = sized.where(F.col("n").between(2, small)).select(
            F.pmod(F.xxhash64("session_key"), F.lit(batches)).alias("batch"),
            *[F.col(f"{end}.{f}").alias(f"{end}_{f}") for end in "ab" for f in ("source", "duration", "us", "id")],
            *[F.col(f"w.{f}").alias(f"w_{f}") for f in ("score", "diff_us", "tie", "a", "b")],
            "reason",
        )
        settled = settled.unionByName(flat.groupBy("batch").applyInPandas(_settle_batch, CLUSTER_DDL))
    if totals["large"]:
        settled = settled.unionByName(absorb(sized.where(F.col("n") > small)))
    return settled


def _settle_batch(edges: pd.DataFrame) -> pd.DataFrame:
    """Edges in order; each one joins two clusters under the better leader."""
    standing: dict[int, tuple] = {}
    for end in "ab":
        columns = [f"{end}_{f}" for f in ("source", "duration", "us", "id")]
        standing.update({row[3]: row for row in edges[columns].itertuples(index=False, name=None)})
    leader = {node: node for node in standing}

    def top(node: int) -> int:
        while leader[node] != node:
            leader[node] = leader[leader[node]]
            node = leader[node]
        return node

    ordered = edges.sort_values(["w_score", "w_diff_us", "w_tie", "w_a", "w_b"])
    lost = {}
    for a, b, score, reason in zip(ordered["a_id"], ordered["b_id"], ordered["w_score"], ordered["reason"]):
        ends = sorted({top(a), top(b)}, key=standing.__getitem__)
        if len(ends) == 2:
            leader[ends[1]] = ends[0]
            lost[ends[1]] = (-score, reason)
    rows = [(node, top(node), score, reason) for node, (score, reason) in lost.items()]
    return pd.DataFrame(rows, columns=["report_id", "winner_id", "score", "reason"])


def dedupe_mark(
    plays: DataFrame, window_seconds: int = WINDOW_SECONDS, small: int = SMALL_SESSION_EDGES, **options
) -> DataFrame:
    """Plays with duplicate columns set from scratch: flag, winner, confidence, notes and the winner's source."""
    pairs = cut_lineage(classified_pairs(plays, window_seconds, deciding=True, **options).where("decision = 'merge'"))
    lost = cut_lineage(settle_clusters(merge_edges(pairs), small))
    marks = lost.select(
        F.col("report_id").alias("play_id"),
        F.col("winner_id").alias("duplicate_of"),
        F.col("score").alias("dedupe_confidence"),
        F.col("reason").alias("dedupe_notes"),
    )
    if not pairs.where("a_copies > 1 or b_copies > 1").isEmpty():
        marks = marks.unionByName(_copy_marks(plays, pairs, lost))
    sources = plays.select(F.col("play_id").alias("duplicate_of"), F.col("source").alias("dedupe_winner_source"))
    marks = salted_join(marks, sources, ["duplicate_of"], F.col("play_id"))
    kept = [c for c in plays.columns if c not in ("is_duplicate", "duplicate_of", *DEDUPE_COLUMNS)]
    return plays.select(*kept).join(marks, "play_id", "left").select(
        *kept, F.col("duplicate_of").isNotNull().alias("is_duplicate"), "duplicate_of", *DEDUPE_COLUMNS
    )


def _copy_marks(plays: DataFrame, merges: DataFrame, lost: DataFrame) -> DataFrame:
    """Marks of the further copies of a report that has a partner.

    Every copy of a report has the same edges. Its lead loses when the cluster meets a better leader; the copies
    lose on the report's first edge already, because they rank behind their own lead.
    """
    ends = None
    for end in "ab":
        side = merges.where(F.col(f"{end}_copies") > 1).select(
            *[F.col(f"{end}_{key}").alias(f"t_{key}") for key in REPORT_KEYS],
            F.col(f"{end}_report_id").alias("report_id"),
            F.struct((-F.col("score")).alias("neg_score"), "diff_us", "reason").alias("edge"),
        )
        ends = side if ends is None else ends.unionByName(side)
    first = ends.groupBy("report_id", *[f"t_{key}" for key in REPORT_KEYS]).agg(F.min("edge").alias("edge"))
    targets = first.join(lost.select("report_id", "winner_id"), "report_id", "left").withColumn(
        "t_salt", F.explode(F.sequence(F.lit(0), F.lit(DEFAULT_SALTS - 1)))
    )
    rows = linkable(plays).withColumn("salt", F.pmod(F.xxhash64("play_id"), F.lit(DEFAULT_SALTS)).cast("int"))
    matched = rows.join(targets, _same_report(rows, targets, "t") & (rows["salt"] == targets["t_salt"]))
    return matched.where("play_id <> report_id").select(
        "play_id",
        F.coalesce("winner_id", "report_id").alias("duplicate_of"),
        (-F.col("edge.neg_score")).alias("dedupe_confidence"),
        F.col("edge.reason").alias("dedupe_notes"),
    )


# --- review and reports ------------------------------------------------------------------


def review_queue(pairs: DataFrame, plays: DataFrame, first: int | None = None) -> DataFrame:
    """Play pairs for a person to decide. Replaces the pending queue on every run.

    With `first`, a queue that starts with the same so many play pairs, most confident first, then lowest ids. The first
    play pair of two reports is that of their lowest ids, so reports are ranked by it before copies are spelled out.
    """
    wanted = pairs.where("decision = 'review'")
    if first is not None:
        ids = F.least("a_report_id", "b_report_id"), F.greatest("a_report_id", "b_report_id")
        known = wanted.where("a_report_id is not null and b_report_id is not null")
        wanted = known.orderBy(F.desc("score"), *ids).limit(first)
    listed = play_pairs(wanted, plays)
    return listed.select(
        "play_a_id", "play_b_id", F.col("score").alias("confidence"), "reason", F.lit(False).alias("resolved")
    )


def dedupe_stats(plays: DataFrame, pairs: DataFrame, marked: DataFrame) -> DataFrame:
    spelled = F.col("a_copies") * F.col("b_copies")
    counted = pairs.agg(
        F.coalesce(F.sum(spelled), F.lit(0)).cast("bigint").alias("pairs_scored"),
        F.coalesce(F.sum(F.when(F.col("decision") == "review", spelled)), F.lit(0)).cast("bigint").alias(
            "flagged_for_review"
        ),
    )
    return counted.select(
        linkable(plays).agg(F.count("*").alias("n")).scalar().alias("plays_considered"),
        "pairs_scored",
        marked.agg(F.count_if("is_duplicate").alias("n")).scalar().alias("duplicates_merged"),
        "flagged_for_review",
    )


def merge_winners(marked: DataFrame) -> DataFrame:
    return (
        marked.where("is_duplicate and dedupe_winner_source is not null")
        .groupBy(F.col("dedupe_winner_source").alias("source"))
        .agg(F.count("*").alias("merged"))
    )


def dedupe_report(marked: DataFrame, queue: DataFrame) -> DataFrame:
    return marked.agg(
        F.count("*").alias("total_plays"), F.count_if("is_duplicate").alias("duplicates_marked")
    ).select("*", review_status(queue).scalar().alias("flagged_for_review"))


def review_status(queue: DataFrame) -> DataFrame:
    return queue.agg(F.count_if(~F.col("resolved")).alias("pending"))


def review_export(queue: DataFrame, plays: DataFrame, limit: int | None = None) -> DataFrame:
    """Unresolved pairs with both plays as structs, most confident first."""
    def side(end: str) -> DataFrame:
        return plays.select(
            F.col("play_id").alias(f"play_{end}_id"),
            F.struct(F.col("play_id").alias("id"), "source", F.col("ts").alias("timestamp"), "duration_ms").alias(
                f"play_{end}"
            ),
        )

    order = [F.desc("confidence"), F.asc("play_a_id"), F.asc("play_b_id")]

    def listed(pairs: DataFrame) -> DataFrame:
        return pairs.join(side("a"), "play_a_id").join(side("b"), "play_b_id").orderBy(*order)

    pending = queue.where("not resolved")
    if limit is None:
        return listed(pending).select("confidence", "reason", "play_a", "play_b")
    # The first pairs are taken before plays are joined, so the rest of the queue is not shuffled for it. Pairs whose plays
    # are not there leave a gap; then more pairs are taken.
    taken = max(limit, 1)
    while True:
        first = cut_lineage(pending.orderBy(*order).limit(taken))
        found = cut_lineage(listed(first).limit(limit))
        if first.count() < taken or found.count() >= limit:
            return found.orderBy(*order).select("confidence", "reason", "play_a", "play_b")
        taken *= 8


def review_apply(plays: DataFrame, queue: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plays, queue) after decisions (play_a_id, play_b_id, decision): `merge` marks b as a duplicate of a,
    `keep_both` only resolves, NULL changes nothing."""
    taken = decisions.where("decision in ('merge', 'keep_both')")
    merged = (
        taken.where("decision = 'merge'")
        .groupBy(F.col("play_b_id").alias("play_id"))
        .agg(F.max("play_a_id").alias("_winner"))
    )
    updated = plays.join(merged, "play_id", "left").select(
        *[c for c in plays.columns if c not in ("is_duplicate", "duplicate_of")],
        (F.col("is_duplicate") | F.col("_winner").isNotNull()).alias("is_duplicate"),
        F.coalesce("_winner", "duplicate_of").alias("duplicate_of"),
    )
    done = taken.select("play_a_id", "play_b_id").distinct().withColumn("_done", F.lit(True))
    resolved = F.col("resolved") | F.coalesce("_done", F.lit(False))
    return updated, queue.join(done, ["play_a_id", "play_b_id"], "left").withColumn("resolved", resolved).drop("_done")


def review_counts(decisions: DataFrame) -> DataFrame:
    return decisions.agg(
        F.count_if(F.col("decision").isin("merge", "keep_both")).alias("applied"),
        F.count_if(F.coalesce("decision", F.lit("")) == "").alias("skipped"),
    )


def dedupe_undo(marked: DataFrame) -> DataFrame:
    """Plays without duplicate marks."""
    set_columns = [c for c in ("duplicate_of", *DEDUPE_COLUMNS) if c in marked.columns]
    cleared = {c: F.lit(None).cast(marked.schema[c].dataType) for c in set_columns}
    return marked.withColumns({"is_duplicate": F.lit(False), **cleared})


def undo_count(marked: DataFrame) -> DataFrame:
    return marked.agg(F.count_if(F.col("is_duplicate") | F.col("duplicate_of").isNotNull()).alias("plays_reset"))
