"""Behavioural metrics over the play fact.

Every metric starts from a small per-(entity, period) aggregate that Spark combines map-side, so a play-heavy artist
never meets in one task; windows run only over such aggregates, whose group size is bounded by calendar length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tracklore.functions.timeparts import day, effective_ms, hour, micros, week_label, weekday, year_month
from tracklore.operators.skew import salted_join, top_per_key
from tracklore.session import cut_lineage

BINGE_DAYS = 30
DEEP_CUT_TRACKS = 5
SESSION_GAP_SECONDS = 3600
SLEEPER_MIN_PLAYS = 10
CONTEXT_DAYS = 7
CONTEXT_ARTISTS = 5
GHOST_IDLE_DAYS = 365
GHOST_MIN_PLAYS = 10


def clean(plays: DataFrame) -> DataFrame:
    return plays.where(~F.col("is_duplicate"))


def latest_day(plays: DataFrame) -> Column:
    """Default `as_of`: the last day in the data, as a scalar subquery."""
    return clean(plays).agg(F.max(day()).alias("d")).scalar()


def _total(column: str) -> Column:
    return F.sum(column).cast("bigint")


# --- basics ------------------------------------------------------------------------------


def entity_tracks(plays: DataFrame, entity: str) -> DataFrame:
    """First and last day, plays and milliseconds per (artist or album, track)."""
    return (
        clean(plays)
        .groupBy(entity, "track_id")
        .agg(
            F.min(day()).alias("first_play_date"),
            F.max(day()).alias("last_play_date"),
            F.count("*").alias("total_plays"),
            F.sum(effective_ms()).alias("total_duration_ms"),
        )
    )


def entity_basic(plays: DataFrame, entity: str) -> DataFrame:
    """First and last day, plays, milliseconds and distinct tracks per artist or album."""
    return _entity_totals(entity_tracks(plays.where(F.col(entity).isNotNull()), entity), entity)


def _entity_totals(per_track: DataFrame, entity: str) -> DataFrame:
    return per_track.groupBy(entity).agg(
        F.min("first_play_date").alias("first_play_date"),
        F.max("last_play_date").alias("last_play_date"),
        _total("total_plays").alias("total_plays"),
        _total("total_duration_ms").alias("total_duration_ms"),
        F.count("track_id").alias("unique_tracks_played"),
    )


def artist_basic(plays: DataFrame, as_of: Column | None = None) -> DataFrame:
    """The last day comes from the same aggregate, so the fact is read once; plays without an artist count for it."""
    tracks = entity_tracks(plays, "artist_id")
    if as_of is None:
        tracks = cut_lineage(tracks)
        as_of = tracks.agg(F.max("last_play_date").alias("d")).scalar()
    basic = _entity_totals(tracks.where("artist_id is not null"), "artist_id")
    return basic.withColumn("days_since_last_play", F.datediff(as_of, "last_play_date"))


def album_basic(plays: DataFrame) -> DataFrame:
    return entity_basic(plays, "album_id")


def album_totals(album_tracks: DataFrame) -> DataFrame:
    """`album_basic` from (album, track) counts."""
    return _entity_totals(album_tracks.where("album_id is not null"), "album_id")


DAYPARTS = ("morning_plays", "afternoon_plays", "evening_plays", "night_plays")


def track_years(plays: DataFrame) -> DataFrame:
    """First and last day, plays, milliseconds and plays by part of the day per (track, year)."""
    h = hour()
    return (
        clean(plays)
        .where("track_id is not null")
        .groupBy("track_id", F.year("ts").alias("year"))
        .agg(
            F.min(day()).alias("first_play_date"),
            F.max(day()).alias("last_play_date"),
            F.count("*").alias("plays"),
            F.sum(effective_ms()).alias("total_duration_ms"),
            F.count_if(h.between(6, 11)).alias("morning_plays"),
            F.count_if(h.between(12, 17)).alias("afternoon_plays"),
            F.count_if(h.between(18, 21)).alias("evening_plays"),
            F.count_if((h >= 22) | (h < 6)).alias("night_plays"),
        )
    )


def _year_totals() -> list[Column]:
    return [
        F.min("first_play_date").alias("first_play_date"),
        F.max("last_play_date").alias("last_play_date"),
        _total("plays").alias("total_plays"),
        _total("total_duration_ms").alias("total_duration_ms"),
        *[_total(part).alias(part) for part in DAYPARTS],
    ]


def track_basic(plays: DataFrame) -> DataFrame:
    return track_years(plays).groupBy("track_id").agg(*_year_totals())


# --- per-period counts -------------------------------------------------------------------


def artist_monthly(plays: DataFrame) -> DataFrame:
    return (
        clean(plays)
        .where("artist_id is not null")
        .groupBy("artist_id", year_month().alias("year_month"))
        .agg(F.count("*").alias("plays"), F.sum(effective_ms()).alias("duration_ms"))
    )


def artist_daily(plays: DataFrame) -> DataFrame:
    return (
        clean(plays)
        .where("artist_id is not null")
        .groupBy("artist_id", day().alias("play_date"))
        .agg(F.count("*").alias("plays"))
    )


def track_yearly(plays: DataFrame) -> DataFrame:
    return (
        clean(plays)
        .where("track_id is not null")
        .groupBy("track_id", F.year("ts").alias("year"))
        .agg(F.count("*").alias("plays"))
    )


def artist_track_counts(plays: DataFrame) -> DataFrame:
    return (
        clean(plays)
        .where("artist_id is not null and track_id is not null")
        .groupBy("artist_id", "track_id")
        .agg(F.count("*").alias("plays"))
    )


# --- artist behaviour --------------------------------------------------------------------


def binge_score(daily: DataFrame) -> DataFrame:
    """Plays in the first 31 days over 30."""
    first = F.min("play_date").over(W.Window.partitionBy("artist_id"))
    within = F.col("play_date") <= F.date_add("first_day", BINGE_DAYS)
    return (
        daily.withColumn("first_day", first)
        .where(within)
        .groupBy("artist_id")
        .agg(F.round(F.sum("plays") / F.lit(float(BINGE_DAYS)), 3).alias("binge_score"))
    )


def peak_period(monthly: DataFrame) -> DataFrame:
    """First and last day of the busiest month; the earliest one on a tie."""
    best = monthly.groupBy("artist_id").agg(
        F.min(F.struct((-F.col("plays")).alias("neg"), F.col("year_month"))).alias("best")
    )
    start = F.to_date(F.concat("best.year_month", F.lit("-01")))
    return best.select("artist_id", start.alias("peak_period_start"), F.last_day(start).alias("peak_period_end"))


def loyalty_tier(monthly: DataFrame, daily: DataFrame) -> DataFrame:
    """One-and-done, phase, constant or seasonal, by span and spread of the active months.

    cv < 0.8 is tested as 100 (n*sum(x^2) - sum(x)^2) < 64 sum(x)^2, which stays in whole numbers.
    """
    months = monthly.groupBy("artist_id").agg(
        F.count("*").alias("n"),
        F.sum("plays").alias("s"),
        F.sum(F.col("plays").cast("decimal(38,0)") * F.col("plays")).alias("ss"),
    )
    span = daily.groupBy("artist_id").agg(
        (F.datediff(F.max("play_date"), F.min("play_date")) + 1).alias("span_days")
    )
    total = F.col("s").cast("decimal(38,0)")
    steady = 100 * (F.col("n") * F.col("ss") - total * total) < 64 * total * total
    tier = (
        F.when(F.col("s") <= 5, "one-and-done")
        .when(F.col("span_days") < 30, "phase")
        .when(F.col("n") <= 1, "phase")
        .when(steady, "constant")
        .otherwise("seasonal")
    )
    return months.join(span, "artist_id").select("artist_id", tier.alias("loyalty_tier"))


def deep_cuts_ratio(track_counts: DataFrame) -> DataFrame:
    """Share of plays outside the five most played tracks; 0 up to five tracks."""
    totals = track_counts.groupBy("artist_id").agg(F.count("*").alias("tracks"), F.sum("plays").alias("all_plays"))
    top = (
        top_per_key(track_counts, ["artist_id"], [F.desc("plays"), F.asc("track_id")], DEEP_CUT_TRACKS)
        .groupBy("artist_id")
        .agg(F.sum("plays").alias("top_plays"))
    )
    ratio = F.when(F.col("tracks") <= DEEP_CUT_TRACKS, F.lit(0.0)).otherwise(
        F.round((F.col("all_plays") - F.col("top_plays")) / F.col("all_plays"), 3)
    )
    return totals.join(top, "artist_id").select("artist_id", ratio.alias("deep_cuts_ratio"))


def discovery_half_life(daily: DataFrame) -> DataFrame:
    """Days from the first day to the first day on which half of all plays is reached."""
    per_artist = W.Window.partitionBy("artist_id")
    running = F.sum("plays").over(per_artist.orderBy("play_date").rowsBetween(W.Window.unboundedPreceding, 0))
    marked = daily.select(
        "artist_id",
        "play_date",
        running.alias("running"),
        F.sum("plays").over(per_artist).alias("total"),
    )
    reached = F.when(2 * F.col("running") >= F.col("total"), F.col("play_date"))
    return marked.groupBy("artist_id").agg(
        F.datediff(F.min(reached), F.min("play_date")).alias("discovery_half_life")
    )


def artist_analytics(plays: DataFrame, as_of: Column | None = None) -> DataFrame:
    """All artist measures in one row.

    The fact is read twice, once per artist and day and once per artist and track. Both aggregates are stored, since
    every branch wants other columns of them and Spark would otherwise read the fact again for each.
    """
    today = latest_day(plays) if as_of is None else as_of
    measures = artist_measures(cut_lineage(artist_days(plays)), cut_lineage(artist_track_counts(plays)))
    return measures.withColumn("days_since_last_play", F.datediff(today, "last_play_date"))


def artist_days(plays: DataFrame) -> DataFrame:
    """Plays and milliseconds per (artist, day)."""
    return (
        clean(plays)
        .where("artist_id is not null")
        .groupBy("artist_id", day().alias("play_date"))
        .agg(F.count("*").alias("plays"), F.sum(effective_ms()).alias("duration_ms"))
    )


def artist_measures(daily: DataFrame, tracks: DataFrame) -> DataFrame:
    """All artist measures that do not depend on today, from (artist, day) and (artist, track) counts."""
    monthly = daily.groupBy("artist_id", F.date_format("play_date", "yyyy-MM").alias("year_month")).agg(
        _total("plays").alias("plays")
    )
    basic = daily.groupBy("artist_id").agg(
        F.min("play_date").alias("first_play_date"),
        F.max("play_date").alias("last_play_date"),
        _total("plays").alias("total_plays"),
        _total("duration_ms").alias("total_duration_ms"),
    )
    distinct_tracks = tracks.groupBy("artist_id").agg(F.count("*").alias("unique_tracks_played"))
    result = basic.join(distinct_tracks, "artist_id", "left")
    for part in (
        peak_period(monthly),
        binge_score(daily),
        loyalty_tier(monthly, daily),
        deep_cuts_ratio(tracks),
        discovery_half_life(daily),
    ):
        result = result.join(part, "artist_id", "left")
    return result.na.fill({"deep_cuts_ratio": 0.0, "unique_tracks_played": 0})


def artist_trend(monthly: DataFrame) -> DataFrame:
    """Mean of the last two active months against the mean of the earlier ones, +-30 %."""
    recency = F.row_number().over(W.Window.partitionBy("artist_id").orderBy(F.desc("year_month")))
    recent = F.col("recency") <= 2
    sums = (
        monthly.withColumn("recency", recency)
        .groupBy("artist_id")
        .agg(
            F.count("*").alias("months"),
            F.sum(F.when(recent, F.col("plays"))).alias("recent"),
            F.sum(F.when(~recent, F.col("plays"))).alias("older"),
        )
    )
    # change > 0.3  <=>  10 * recent/2 > 13 * older/(months-2), in whole numbers
    left, right = 10 * F.col("recent") * (F.col("months") - 2), 2 * F.col("older")
    trend = (
        F.when(F.col("months") < 4, "stable")
        .when(left > 13 * right, "up")
        .when(left < 7 * right, "down")
        .otherwise("stable")
    )
    return sums.select("artist_id", trend.alias("trend"))


# --- album completion --------------------------------------------------------------------


def album_track_count(tracks: DataFrame) -> DataFrame:
    return tracks.where("album_id is not null").groupBy("album_id").agg(F.count("*").alias("track_count"))


def album_sessions(plays: DataFrame, gap_seconds: int = SESSION_GAP_SECONDS) -> DataFrame:
    """(album_id, session_no, distinct_tracks): plays split where the pause exceeds the gap.

    Time is cut into slots as wide as the gap, so a pause longer than the gap always crosses slots. Slot minima and
    maxima then place every session break, and the ordering window sees one row per album and slot, however many
    plays an album has.
    """
    return slot_sessions(album_slots(plays, gap_seconds), gap_seconds)


def album_slots(plays: DataFrame, gap_seconds: int = SESSION_GAP_SECONDS) -> DataFrame:
    """First and last microsecond and plays per (album, time slot, track); a track that is not known counts as one."""
    slot = F.floor(F.col("us") / (gap_seconds * 1_000_000)).alias("slot")
    return (
        clean(plays)
        .where("album_id is not null")
        .select("album_id", F.coalesce("track_id", F.lit(-1)).alias("track_id"), micros().alias("us"))
        .groupBy("album_id", slot, "track_id")
        .agg(F.min("us").alias("lo"), F.max("us").alias("hi"), F.count("*").alias("plays"))
    )


def slot_sessions(slots: DataFrame, gap_seconds: int = SESSION_GAP_SECONDS) -> DataFrame:
    """`album_sessions` from slots as wide as the gap."""
    bounds = slots.groupBy("album_id", "slot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    by_time = W.Window.partitionBy("album_id").orderBy("slot")
    starts = (F.col("lo") - F.lag("hi").over(by_time) > gap_seconds * 1_000_000).cast("int")
    numbered = bounds.withColumn("starts", F.coalesce(starts, F.lit(0))).select(
        "album_id", "slot", F.sum("starts").over(by_time).alias("session_no")
    )
    return (
        slots.select("album_id", "slot", "track_id")
        .join(numbered, ["album_id", "slot"])
        .select("album_id", "session_no", "track_id")
        .distinct()
        .groupBy("album_id", "session_no")
        .agg(F.count("*").alias("distinct_tracks"))
    )


def session_sizes(sessions: DataFrame) -> DataFrame:
    """Sessions of an album by how many of its tracks they hold."""
    return sessions.groupBy("album_id", "distinct_tracks").agg(F.count("*").alias("sessions"))


def completion_rate(plays: DataFrame, track_counts: DataFrame, gap_seconds: int = SESSION_GAP_SECONDS) -> DataFrame:
    """Sessions covering at least 80 % of the album over the number of full listens its plays allow."""
    slots = cut_lineage(album_slots(plays, gap_seconds))  # totals and sessions both come from the slots
    totals = slots.groupBy("album_id").agg(_total("plays").alias("plays"))
    return completion_share(totals, session_sizes(slot_sessions(slots, gap_seconds)), track_counts)


def completion_share(totals: DataFrame, sized: DataFrame, track_counts: DataFrame) -> DataFrame:
    """`completion_rate` from (album, plays) and the sizes of its sessions."""
    sizes = track_counts.select("album_id", "track_count")
    complete = (
        sized.join(sizes, "album_id")
        .where(5 * F.col("distinct_tracks") >= 4 * F.col("track_count"))
        .groupBy("album_id")
        .agg(F.sum("sessions").alias("completed"))
    )
    known = totals.join(sizes, "album_id", "left").join(complete, "album_id", "left")
    tracks, done = F.coalesce("track_count", F.lit(0)), F.coalesce("completed", F.lit(0))
    possible = F.greatest(F.floor(F.col("plays") / tracks), F.lit(1))
    rate = F.when((tracks < 3) | (F.col("plays") < tracks), F.lit(0.0)).otherwise(F.round(done / possible, 3))
    return known.select("album_id", rate.alias("completion_rate"))


def album_analytics(plays: DataFrame, tracks: DataFrame, gap_seconds: int = SESSION_GAP_SECONDS) -> DataFrame:
    return album_basic(plays).join(completion_rate(plays, album_track_count(tracks), gap_seconds), "album_id", "left")


# --- tracks ------------------------------------------------------------------------------


def _spread() -> list[Column]:
    return [
        F.count("*").alias("n"), F.sum("plays").alias("s"), F.max("plays").alias("hi"), F.min("plays").alias("lo")
    ]


def _is_sleeper() -> Column:
    n, s = F.col("n"), F.col("s")
    even = (2 * F.col("hi") * n < 5 * s) & (10 * F.col("lo") * n >= 3 * s)
    return ((s >= SLEEPER_MIN_PLAYS) & (n >= 2) & even).alias("is_sleeper")


def sleepers(yearly: DataFrame) -> DataFrame:
    """Played at least ten times over two or more years, no year above 2.5 times or below 0.3 of the mean."""
    return yearly.groupBy("track_id").agg(*_spread()).select("track_id", _is_sleeper())


def track_analytics(plays: DataFrame) -> DataFrame:
    return track_measures(track_years(plays))


def track_measures(years: DataFrame) -> DataFrame:
    """`track_analytics` from (track, year) counts: totals and spread in one aggregate."""
    rows = years.groupBy("track_id").agg(*_year_totals(), *_spread())
    return rows.withColumn("is_sleeper", _is_sleeper()).drop("n", "s", "hi", "lo")


# --- time patterns -----------------------------------------------------------------------


def monthly_new_artists(plays: DataFrame) -> DataFrame:
    """Artists by the month of their first play; replaces a cumulative set difference."""
    return (
        artist_monthly(plays)
        .groupBy("artist_id")
        .agg(F.min("year_month").alias("year_month"))
        .groupBy("year_month")
        .agg(F.count("*").alias("new_artists"))
    )


def monthly_top_artist(monthly: DataFrame) -> DataFrame:
    """Most played artist per month, lowest id on a tie. A struct minimum combines map-side."""
    best = monthly.groupBy("year_month").agg(
        F.min(F.struct((-F.col("plays")).alias("neg"), F.col("artist_id"))).alias("best")
    )
    return best.select(
        "year_month",
        F.col("best.artist_id").alias("top_artist_id"),
        (-F.col("best.neg")).alias("top_artist_plays"),
    )


def month_entities(plays: DataFrame) -> DataFrame:
    """Plays and milliseconds per (month, artist, album, track)."""
    return (
        clean(plays)
        .groupBy(year_month().alias("year_month"), "artist_id", "album_id", "track_id")
        .agg(F.count("*").alias("plays"), F.sum(effective_ms()).alias("ms"))
    )


def month_totals(entities: DataFrame) -> DataFrame:
    """Totals, distinct entities, top artist and fragmentation per month, from `month_entities`."""
    totals = entities.groupBy("year_month").agg(
        _total("plays").alias("total_plays"),
        _total("ms").alias("total_duration_ms"),
        F.count_distinct("artist_id").alias("unique_artists"),
        F.count_distinct("album_id").alias("unique_albums"),
        F.count_distinct("track_id").alias("unique_tracks"),
    )
    return totals.join(monthly_top_artist(_month_artists(entities)), "year_month", "left").withColumn(
        "fragmentation_score", F.round(F.col("unique_artists") / F.col("total_plays"), 4)
    )


def _month_artists(entities: DataFrame) -> DataFrame:
    known = entities.where("artist_id is not null")
    return known.groupBy("year_month", "artist_id").agg(F.sum("plays").alias("plays"))


def with_discoveries(months: DataFrame, firsts: DataFrame) -> DataFrame:
    """Adds the artists whose first month it is; `firsts` has one year_month per artist."""
    found = firsts.groupBy("year_month").agg(F.count("*").alias("new_artists_discovered"))
    number = F.coalesce("new_artists_discovered", F.lit(0)).cast("bigint").alias("new_artists_discovered")
    return months.join(found, "year_month", "left").select(
        "year_month", "total_plays", "total_duration_ms", "unique_artists", "unique_albums", "unique_tracks", number,
        "top_artist_id", "top_artist_plays", "fragmentation_score",
    )


def monthly_summary(plays: DataFrame) -> DataFrame:
    """Totals, distinct entities, discoveries, top artist and fragmentation per month.

    Plays collapse to (month, artist, album, track) once; what follows reads that stored aggregate, not the fact.
    """
    entities = cut_lineage(month_entities(plays))
    firsts = entities.where("artist_id is not null").groupBy("artist_id").agg(F.min("year_month").alias("year_month"))
    return with_discoveries(month_totals(entities), firsts)


def day_hours(plays: DataFrame) -> DataFrame:
    """Plays per (day, hour); as many rows as the calendar has hours."""
    return clean(plays).groupBy(day().alias("d"), hour().alias("hour")).agg(F.count("*").alias("plays"))


def hourly_distribution(plays: DataFrame) -> DataFrame:
    return hours_of(cut_lineage(day_hours(plays)))


def hours_of(per_hour: DataFrame) -> DataFrame:
    days = per_hour.agg(F.count_distinct("d").alias("n")).scalar()
    return (
        per_hour.groupBy("hour")
        .agg(_total("plays").alias("total_plays"))
        .withColumn("avg_plays_per_day", F.round(F.col("total_plays") / days, 3))
    )


def weekday_distribution(plays: DataFrame) -> DataFrame:
    return weekdays_of(cut_lineage(day_hours(plays)))


def weekdays_of(per_hour: DataFrame) -> DataFrame:
    weeks = per_hour.agg(F.count_distinct(week_label("d")).alias("n")).scalar()
    return (
        per_hour.groupBy(weekday("d").alias("weekday"))
        .agg(_total("plays").alias("total_plays"))
        .withColumn("avg_plays_per_week", F.round(F.col("total_plays") / weeks, 3))
    )


# --- discovery ---------------------------------------------------------------------------


def discovery_context(daily: DataFrame, days: int = CONTEXT_DAYS, top: int = CONTEXT_ARTISTS) -> DataFrame:
    """Most played other artists in the week before, and in the eight days from, each artist's first day.

    All artists discovered on one day share that day's ranking, so it is computed per day, one place longer than
    needed, and each artist then drops itself. Nothing is paired per (discovered, other) artist.
    """
    first = daily.groupBy("artist_id").agg(F.min("play_date").alias("first_day"))
    discovery_days = first.select(F.col("first_day").alias("day")).distinct()
    offsets = F.explode(F.sequence(F.lit(-days), F.lit(days)))
    around = (
        daily.withColumn("shift", offsets)
        .select(
            F.date_add("play_date", F.col("shift")).alias("day"),
            # day = play_date + shift, so a positive shift is a play before the discovery day
            F.when(F.col("shift") > 0, "before").otherwise("after").alias("context_type"),
            F.col("artist_id").alias("context_artist_id"),
            "plays",
        )
        .join(discovery_days, "day", "left_semi")
        .groupBy("day", "context_type", "context_artist_id")
        .agg(_total("plays").alias("play_count"))
    )
    order = [F.desc("play_count"), F.asc("context_artist_id")]
    ranked = top_per_key(around, ["day", "context_type"], order, top + 1, "place")
    # Many artists may share one first day (a bulk import), so that side is spread over several tasks.
    by_day = first.withColumnRenamed("first_day", "day")
    linked = salted_join(by_day, ranked, ["day"], F.col("artist_id")).where("context_artist_id <> artist_id")
    kept = top_per_key(linked, ["artist_id", "context_type"], [F.asc("place")], top)
    return kept.select(
        F.col("artist_id").alias("discovered_artist_id"), "context_artist_id", "context_type", "play_count"
    )


# --- geography and summaries -------------------------------------------------------------


def geographic(plays: DataFrame) -> DataFrame:
    return (
        clean(plays)
        .where("country is not null")
        .groupBy("country", "region", "city")
        .agg(
            F.count("*").alias("total_plays"),
            F.min(day()).alias("first_play_date"),
            F.max(day()).alias("last_play_date"),
        )
    )


def summary_overview(plays: DataFrame) -> DataFrame:
    combos = (
        clean(plays)
        .groupBy("artist_id", "album_id", "track_id")
        .agg(
            F.count("*").alias("plays"),
            F.sum(effective_ms()).alias("ms"),
            F.min(day()).alias("first_day"),
            F.max(day()).alias("last_day"),
        )
    )
    return combos.agg(
        _total("plays").alias("total_plays"),
        F.round(F.sum("ms") / F.lit(3600000), 1).alias("total_hours_listened"),
        F.count_distinct("artist_id").alias("unique_artists"),
        F.count_distinct("album_id").alias("unique_albums"),
        F.count_distinct("track_id").alias("unique_tracks"),
        F.min("first_day").alias("first_play_date"),
        F.max("last_day").alias("last_play_date"),
    )


def loyalty_distribution(tiers: DataFrame) -> DataFrame:
    return tiers.where("loyalty_tier is not null").groupBy("loyalty_tier").agg(F.count("*").alias("artists"))


def ghost_artists(artists: DataFrame) -> DataFrame:
    idle = (F.col("days_since_last_play") > GHOST_IDLE_DAYS) & (F.col("total_plays") >= GHOST_MIN_PLAYS)
    return artists.agg(F.count_if(idle).alias("ghost_artists"))


def sleeper_count(tracks: DataFrame) -> DataFrame:
    return tracks.agg(F.count_if("is_sleeper").alias("sleeper_tracks"))


def plays_by_day(plays: DataFrame) -> DataFrame:
    """Over all plays, duplicates included."""
    return plays.groupBy(day().alias("play_date")).agg(F.count("*").alias("play_count"))


def artist_first_last(plays: DataFrame) -> DataFrame:
    """Over all plays, duplicates included."""
    return (
        plays.where("artist_id is not null")
        .groupBy("artist_id")
        .agg(F.min("ts").alias("first_play"), F.max("ts").alias("last_play"), F.count("*").alias("total_plays"))
    )


def db_stats(plays: DataFrame, artists: DataFrame, albums: DataFrame, tracks: DataFrame) -> DataFrame:
    totals = plays.agg(
        F.count("*").alias("total_plays"),
        F.count_if(~F.col("is_duplicate")).alias("clean_plays"),
        F.min(day()).alias("first_date"),
        F.max(day()).alias("last_date"),
    )
    return totals.select(
        "*",
        *[
            table.agg(F.count("*").alias("n")).scalar().alias(name)
            for name, table in (("artists", artists), ("albums", albums), ("tracks", tracks))
        ],
    )


def plays_by_source(plays: DataFrame) -> DataFrame:
    return plays.groupBy("source").agg(F.count("*").alias("plays"))
