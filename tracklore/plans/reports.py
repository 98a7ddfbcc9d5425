"""Report tables. Every report is flat; nesting happens only where a sink writes it.

Reports read the analytics tables (one row per entity or month), not the play fact. `artists`, `albums` and `tracks`
are dimensions keyed by `id`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklore.functions.timeparts import ms_to_hours
from tracklore.operators.skew import salted_join, top_per_key

GENRE_TOP = 5
YEAR_TOP = 10
RECENT = 50
GATEWAYS = 20


def _total(column: str | Column) -> Column:
    return F.sum(column).cast("bigint")


def _named(df: DataFrame, names: DataFrame, key: str, label: str, how: str = "inner") -> DataFrame:
    """Adds the name of the entity behind `key` as `label`."""
    lookup = names.select(F.col("id").alias(key), F.col(names.columns[1]).alias(label))
    return df.join(lookup, key, how)


def first_by(df: DataFrame, order: list[Column], columns: list[str]) -> DataFrame:
    """The first row, as a top-k of one."""
    return df.orderBy(*order).limit(1).select(*columns)


# --- overview ----------------------------------------------------------------------------


def top_entity(totals: DataFrame, dimension: DataFrame, key: str, artists: DataFrame | None = None) -> DataFrame:
    """(id, label, artist_name, plays) of the most played entity."""
    label = dimension.columns[1]
    fields = [F.col("id").alias(key), F.col(label).alias("label")]
    if artists is not None:
        fields.append(F.col("artist_id").alias("_artist"))
    best = totals.join(dimension.select(*fields), key).orderBy(F.desc("total_plays"), key).limit(1)
    if artists is None:
        best = best.withColumn("artist_name", F.col("label"))
    else:
        best = best.join(artists.select(F.col("id").alias("_artist"), F.col("name").alias("artist_name")), "_artist", "left")
    return best.select(F.col(key).alias("id"), "label", "artist_name", F.col("total_plays").alias("plays"))


def report_overview(
    artist_totals: DataFrame, album_totals: DataFrame, track_totals: DataFrame,
    artists: DataFrame, albums: DataFrame, tracks: DataFrame,
) -> DataFrame:
    """One row: totals from the artist table (plays without an artist stay out), sizes, dates, top entities."""
    totals = artist_totals.agg(
        F.coalesce(_total("total_plays"), F.lit(0)).alias("total_plays"),
        F.coalesce(_total("total_duration_ms"), F.lit(0)).alias("total_duration_ms"),
        F.min("first_play_date").alias("first_play"),
        F.max("last_play_date").alias("last_play"),
    )
    sizes = {"total_artists": artists, "total_albums": albums, "total_tracks": tracks}
    tops = {
        "top_artist": top_entity(artist_totals, artists, "artist_id"),
        "top_album": top_entity(album_totals, albums, "album_id", artists),
        "top_track": top_entity(track_totals, tracks, "track_id", artists),
    }
    return totals.select(
        "*",
        ms_to_hours("total_duration_ms").alias("total_hours"),
        *[table.agg(F.count("*").alias("n")).scalar().alias(name) for name, table in sizes.items()],
        *[
            top.select(column).scalar().alias(f"{name}_{column}")
            for name, top in tops.items()
            for column in ("id", "label", "plays")
        ],
    )


# --- time --------------------------------------------------------------------------------


def report_timeline(monthly_summary: DataFrame, artists: DataFrame) -> DataFrame:
    named = monthly_summary.withColumnRenamed("top_artist_id", "artist_id")
    return (
        _named(named, artists, "artist_id", "top_artist_name", "left")
        .withColumnRenamed("artist_id", "top_artist_id")
        .withColumn("duration_hours", ms_to_hours("total_duration_ms"))
    )


def timeline_artists(artist_monthly: DataFrame, artists: DataFrame, top_n: int | None = None) -> DataFrame:
    """Every artist of every month, most played first by `place` when limited."""
    rows = artist_monthly
    if top_n is not None:
        rows = top_per_key(rows, ["year_month"], [F.desc("plays"), F.asc("artist_id")], top_n, "place")
    return _named(rows, artists, "artist_id", "artist_name")


def report_temporal(hourly: DataFrame, weekday: DataFrame) -> DataFrame:
    """One row: busiest hour and weekday, share of night and weekend plays."""
    def share(test: Column) -> Column:
        return F.round(F.sum(F.when(test, F.col("total_plays")).otherwise(0)) / F.sum("total_plays"), 3)

    def peak(column: str) -> Column:
        return F.min(F.struct((-F.col("total_plays")).alias("neg"), column))[column]

    night = (F.col("hour") >= 22) | (F.col("hour") < 4)
    by_hour = hourly.agg(peak("hour").alias("peak_hour"), share(night).alias("night_owl_score"))
    by_day = weekday.agg(
        peak("weekday").alias("peak_day"), share(F.col("weekday").isin(0, 6)).alias("weekend_warrior_score")
    )
    return by_hour.select(
        "peak_hour", "night_owl_score", *[by_day.select(c).scalar().alias(c) for c in by_day.columns]
    )


# --- genres ------------------------------------------------------------------------------


def report_genres(artist_genres: DataFrame, artist_totals: DataFrame) -> DataFrame:
    """Artists, plays and share per genre; an artist with several genres counts in each."""
    joined = artist_genres.select("artist_id", "genre").join(
        artist_totals.select("artist_id", "total_plays", "total_duration_ms"), "artist_id"
    )
    # One row per (genre, artist) first: a genre holding a third of all artists stays spread out.
    per_artist = joined.groupBy("genre", "artist_id").agg(
        _total("total_plays").alias("plays"), _total("total_duration_ms").alias("ms")
    )
    genres = per_artist.groupBy("genre").agg(
        F.count("*").alias("artist_count"), _total("plays").alias("plays"), _total("ms").alias("duration_ms")
    )
    whole = joined.agg(_total("total_plays").alias("n")).scalar()
    return genres.withColumn("percentage", F.round(F.col("plays") / whole, 4))


def genre_top_artists(artist_genres: DataFrame, artist_totals: DataFrame, artists: DataFrame) -> DataFrame:
    joined = artist_genres.select("artist_id", "genre").join(artist_totals.select("artist_id", "total_plays"), "artist_id")
    best = top_per_key(joined, ["genre"], [F.desc("total_plays"), F.asc("artist_id")], GENRE_TOP)
    return _named(best, artists, "artist_id", "name").select(
        "genre", "rank", "artist_id", "name", F.col("total_plays").alias("plays")
    )


# --- discoveries -------------------------------------------------------------------------


def discovery_totals(artist_totals: DataFrame) -> DataFrame:
    """One row: discoveries, active years, average per year, busiest month (earliest on a tie)."""
    months = discoveries_by_month(artist_totals)
    best = F.min(F.struct((-F.col("count")).alias("neg"), "year_month"))
    return months.agg(
        _total("count").alias("total_discoveries"),
        F.count_distinct(F.substring("year_month", 1, 4)).alias("years_active"),
        F.round(F.sum("count") / F.count_distinct(F.substring("year_month", 1, 4)), 1).alias("avg_per_year"),
        best["year_month"].alias("peak_month"),
        (-best["neg"]).alias("peak_month_count"),
    )


def discoveries_by_month(artist_totals: DataFrame) -> DataFrame:
    return artist_totals.groupBy(F.date_format("first_play_date", "yyyy-MM").alias("year_month")).agg(
        F.count("*").alias("count")
    )


def discoveries_by_year(artist_totals: DataFrame) -> DataFrame:
    return artist_totals.groupBy(F.year("first_play_date").alias("year")).agg(F.count("*").alias("count"))


def discoveries_top_of_year(artist_totals: DataFrame, artists: DataFrame) -> DataFrame:
    rows = artist_totals.select("artist_id", "first_play_date", "total_plays", F.year("first_play_date").alias("year"))
    best = top_per_key(rows, ["year"], [F.desc("total_plays"), F.asc("artist_id")], YEAR_TOP)
    return _named(best, artists, "artist_id", "name").select(
        "year", "rank", "artist_id", "name", "first_play_date", F.col("total_plays").alias("plays")
    )


def recent_discoveries(
    artist_totals: DataFrame, artists: DataFrame, as_of: Column | None = None, last: int | None = None
) -> DataFrame:
    """Artists first played within two years of `as_of`, or the `last` newest ones."""
    rows = artist_totals.select("artist_id", "first_play_date", F.col("total_plays").alias("plays"))
    if as_of is not None:
        rows = rows.where(F.col("first_play_date") >= F.add_months(as_of, -24))
    if last is not None:
        rows = rows.orderBy(F.desc("first_play_date"), F.desc("artist_id")).limit(last)
    return _named(rows, artists, "artist_id", "name")


def gateway_artists(context: DataFrame, artist_totals: DataFrame, artists: DataFrame, top: int | None = None) -> DataFrame:
    """Artists by how many discoveries they preceded."""
    counts = (
        context.where("context_type = 'before'")
        .groupBy(F.col("context_artist_id").alias("artist_id"))
        .agg(F.count("*").alias("discoveries_triggered"))
        .join(artist_totals.select("artist_id", F.col("total_plays").alias("plays")), "artist_id")
    )
    if top is not None:
        counts = counts.orderBy(F.desc("discoveries_triggered"), "artist_id").limit(top)
    return _named(counts, artists, "artist_id", "name")


# --- geography ---------------------------------------------------------------------------


def report_geography(geographic: DataFrame) -> DataFrame:
    return geographic.withColumnRenamed("total_plays", "plays").orderBy(
        F.desc("plays"), "country", F.asc_nulls_first("region"), F.asc_nulls_first("city")
    )


# --- artists, albums, tracks --------------------------------------------------------------


def report_artist_monthly(artist_monthly: DataFrame, artists: DataFrame) -> DataFrame:
    return _named(artist_monthly, artists, "artist_id", "artist_name")


def artist_yearly(artist_monthly: DataFrame) -> DataFrame:
    return artist_monthly.groupBy("artist_id", F.substring("year_month", 1, 4).cast("int").alias("year")).agg(
        _total("plays").alias("plays"), _total("duration_ms").alias("duration_ms")
    )


def report_artist_detail(artist_totals: DataFrame, artist_monthly: DataFrame, artists: DataFrame) -> DataFrame:
    """Per artist: totals with peak month and year, the earliest one on a tie."""
    def peak(rows: DataFrame, column: str, name: str) -> DataFrame:
        best = F.min(F.struct((-F.col("plays")).alias("neg"), column))
        return rows.groupBy("artist_id").agg(best[column].alias(name))

    facts = artists.select(F.col("id").alias("artist_id"), "name", "country", F.col("artist_type").alias("type"))
    return (
        artist_totals.select(
            "artist_id", F.col("total_plays").alias("plays"), ms_to_hours("total_duration_ms").alias("duration_hours"),
            F.col("unique_tracks_played").alias("unique_tracks"), "first_play_date", "last_play_date",
        )
        .join(facts, "artist_id")
        .join(peak(artist_monthly, "year_month", "peak_month"), "artist_id", "left")
        .join(peak(artist_yearly(artist_monthly), "year", "peak_year"), "artist_id", "left")
    )


def artist_detail_nested(detail: DataFrame, artist_monthly: DataFrame) -> DataFrame:
    """Adds both timelines as sorted arrays; a group holds one row per calendar month at most."""
    def timeline(rows: DataFrame, key: str, name: str) -> DataFrame:
        return rows.groupBy("artist_id").agg(F.array_sort(F.collect_list(F.struct(key, "plays", "duration_ms"))).alias(name))

    return detail.join(timeline(artist_monthly, "year_month", "monthly_timeline"), "artist_id").join(
        timeline(artist_yearly(artist_monthly), "year", "yearly_timeline"), "artist_id"
    )


def search_index_artists(artists: DataFrame, artist_totals: DataFrame) -> DataFrame:
    plays = artist_totals.select(F.col("artist_id").alias("id"), "total_plays")
    return artists.select("id", "name", "sort_name").join(plays, "id", "left").select(
        "id", "name", "sort_name", F.coalesce("total_plays", F.lit(0)).alias("plays")
    )


def search_index_albums(albums: DataFrame, artists: DataFrame, album_totals: DataFrame) -> DataFrame:
    plays = album_totals.select(F.col("album_id").alias("id"), "total_plays")
    named = _with_artist(albums.select("id", "title", "artist_id"), artists)
    return named.join(plays, "id", "left").select(
        "id", "title", "artist_id", "artist_name", F.coalesce("total_plays", F.lit(0)).alias("plays")
    )


def _with_artist(rows: DataFrame, artists: DataFrame) -> DataFrame:
    """Artist id and name, both NULL where the artist is unknown. One artist may own a large share of the rows."""
    names = artists.select(F.col("id").alias("artist_id"), F.col("name").alias("artist_name"))
    joined = salted_join(rows, names, ["artist_id"], F.col("id"), "left")
    return joined.withColumn("artist_id", F.when(F.col("artist_name").isNotNull(), F.col("artist_id")))


def index_artists(artist_totals: DataFrame, artists: DataFrame, genres: DataFrame) -> DataFrame:
    """`genres` holds the best five per artist by confidence."""
    best = top_per_key(genres, ["artist_id"], [F.desc("confidence"), F.asc("genre")], GENRE_TOP, "place")
    listed = best.groupBy("artist_id").agg(F.array_sort(F.collect_list(F.struct("place", "genre"))).alias("g")).select(
        "artist_id", F.col("g.genre").alias("genres")
    )
    facts = artists.select(F.col("id").alias("artist_id"), "name", "country", F.col("artist_type").alias("type"))
    return artist_totals.join(facts, "artist_id").join(listed, "artist_id", "left").select(
        F.col("artist_id").alias("id"), "name", "country", "type", F.col("total_plays").alias("plays"),
        F.col("total_duration_ms").alias("duration_ms"), ms_to_hours("total_duration_ms").alias("duration_hours"),
        F.col("unique_tracks_played").alias("unique_tracks"), F.col("first_play_date").alias("first_play"),
        F.col("last_play_date").alias("last_play"), F.coalesce("genres", F.array().cast("array<string>")).alias("genres"),
    )


def index_albums(album_analytics: DataFrame, albums: DataFrame, artists: DataFrame) -> DataFrame:
    named = _with_artist(albums.select("id", "title", "release_year", "album_type", "artist_id"), artists)
    return album_analytics.withColumnRenamed("album_id", "id").join(named, "id").select(
        "id", "title", "release_year", "album_type", "artist_id", "artist_name", F.col("total_plays").alias("plays"),
        F.col("total_duration_ms").alias("duration_ms"), ms_to_hours("total_duration_ms").alias("duration_hours"),
        F.col("unique_tracks_played").alias("unique_tracks"), F.col("first_play_date").alias("first_play"),
        F.col("last_play_date").alias("last_play"), "completion_rate",
    )


def index_tracks(track_totals: DataFrame, tracks: DataFrame, albums: DataFrame, artists: DataFrame) -> DataFrame:
    titles = albums.select(F.col("id").alias("album_id"), F.col("title").alias("album_title"))
    named = salted_join(_with_artist(tracks, artists), titles, ["album_id"], F.col("id"), "left")
    return track_totals.withColumnRenamed("track_id", "id").join(named, "id").select(
        "id", "title", "duration_ms", "artist_id", "artist_name",
        F.when(F.col("album_title").isNotNull(), F.col("album_id")).alias("album_id"), "album_title",
        F.col("total_plays").alias("plays"), "total_duration_ms", ms_to_hours("total_duration_ms").alias("total_hours"),
        F.col("first_play_date").alias("first_play"), F.col("last_play_date").alias("last_play"),
    )


SORTS = {"plays": "plays", "hours": "duration_hours", "name": "name", "first": "first_play"}


def list_page(rows: DataFrame, sort: str = "plays", ascending: bool = False, page: int = 1, size: int = 50) -> DataFrame:
    """One page of a sorted list; ids break ties, so pages never overlap."""
    column = F.col(SORTS[sort])
    ordered = rows.orderBy(column.asc_nulls_last() if ascending else column.desc_nulls_last(), F.col("id"))
    return ordered.offset((page - 1) * size).limit(size)


# --- years -------------------------------------------------------------------------------


def _year(column: str = "year_month") -> Column:
    return F.substring(column, 1, 4).cast("int")


def _year_top_artist(monthly_summary: DataFrame) -> DataFrame:
    """Artist with the most plays summed over the months it led."""
    led = monthly_summary.where("top_artist_id is not null").groupBy(_year().alias("year"), "top_artist_id").agg(
        _total("top_artist_plays").alias("plays")
    )
    best = led.groupBy("year").agg(F.min(F.struct((-F.col("plays")).alias("neg"), "top_artist_id")).alias("b"))
    return best.select("year", F.col("b.top_artist_id").alias("top_artist_id"), (-F.col("b.neg")).alias("top_artist_plays"))


def report_story(
    monthly_summary: DataFrame, track_totals: DataFrame, artists: DataFrame, tracks: DataFrame
) -> DataFrame:
    """Year in review. The top track is the all-time favourite among tracks first or last played in that year."""
    years = monthly_summary.groupBy(_year().alias("year")).agg(
        _total("total_plays").alias("plays"), _total("total_duration_ms").alias("ms"),
        _total("new_artists_discovered").alias("discoveries"),
    ).where("plays > 0")
    seen = F.explode(F.array_distinct(F.array(F.year("first_play_date"), F.year("last_play_date"))))
    best = track_totals.select("track_id", "total_plays", seen.alias("year")).groupBy("year").agg(
        F.min(F.struct((-F.col("total_plays")).alias("neg"), "track_id")).alias("b")
    )
    top_track = best.select("year", F.col("b.track_id").alias("track_id"), (-F.col("b.neg")).alias("top_track_plays"))
    titled = _named(top_track, tracks, "track_id", "top_track_title").withColumnRenamed("track_id", "top_track_id")
    top_artist = _named(
        _year_top_artist(monthly_summary).withColumnRenamed("top_artist_id", "artist_id"), artists, "artist_id", "top_artist_name"
    ).withColumnRenamed("artist_id", "top_artist_id")
    hours = F.col("ms") / 3_600_000
    return years.join(top_artist, "year", "left").join(titled, "year", "left").select(
        "year", "plays", F.round(hours).cast("bigint").alias("hours"), F.round(hours / 24).cast("bigint").alias("days"),
        "discoveries", "top_artist_id", "top_artist_name", "top_artist_plays", "top_track_id", "top_track_title",
        "top_track_plays",
    )


# Order, kinds and texts of the slides of a year.
SLIDES = [
    ("intro", "intro", "concat('Your ', year, ' in Music')", "'Let''s look back at the year'"),
    ("total-plays", "stat", "cast(plays as string)", "'songs played'"),
    ("listening-time", "stat", "cast(hours as string)", "concat('That''s ', days, ' days of non-stop listening')"),
    ("top-artist", "artist", "'Your #1 Artist'", "top_artist_name"),
    ("discoveries", "stat", "cast(discoveries as string)", "'new artists discovered'"),
    ("top-track", "track", "'Your Top Track'", "top_track_title"),
    ("outro", "outro", "concat('That was your ', year)", "'Here''s to more music ahead'"),
]


def story_slides(story: DataFrame) -> DataFrame:
    """(year, place, slide, kind, title, detail): the slides in order; years without a top track skip its slide."""
    slides = F.array(*[
        F.when(
            F.lit(slide != "top-track") | F.col("top_track_id").isNotNull(),
            F.struct(F.lit(slide).alias("slide"), F.lit(kind).alias("kind"), F.expr(title).alias("title"),
                     F.expr(detail.replace("''", "\\'")).alias("detail")),
        )
        for slide, kind, title, detail in SLIDES
    ])
    shown = F.filter(slides, lambda s: s.isNotNull())
    return story.select("year", F.posexplode(shown).alias("place", "s")).select("year", "place", "s.*")


def year_rollup_timeline(monthly_summary: DataFrame) -> DataFrame:
    """Hours are sums of the months' rounded hours, artists the largest month."""
    years = monthly_summary.groupBy(_year().alias("year")).agg(
        _total("total_plays").alias("plays"),
        F.round(F.sum(ms_to_hours("total_duration_ms").cast("decimal(20,1)")), 1).cast("double").alias("hours"),
        _total("new_artists_discovered").alias("discoveries"),
        F.max("unique_artists").alias("unique_artists"),
    )
    return years.join(_year_top_artist(monthly_summary), "year", "left")


def year_rollup_story(timeline: DataFrame) -> DataFrame:
    """Artists are the distinct names that led a month."""
    years = timeline.groupBy(_year().alias("year")).agg(
        _total("total_plays").alias("plays"),
        F.round(F.sum(F.col("duration_hours").cast("decimal(20,1)"))).cast("bigint").alias("hours"),
        _total("new_artists_discovered").alias("discoveries"),
        F.count_distinct("top_artist_name").alias("unique_artists"),
    )
    led = timeline.where("top_artist_name is not null").groupBy(_year().alias("year"), "top_artist_name").agg(
        _total("top_artist_plays").alias("n")
    )
    best = led.groupBy("year").agg(F.min(F.struct((-F.col("n")).alias("neg"), "top_artist_name")).alias("b"))
    top = best.select("year", F.col("b.top_artist_name").alias("top_artist_name"), (-F.col("b.neg")).alias("top_artist_plays"))
    return years.where("plays > 0").join(top, "year", "left")


def busiest(monthly_summary: DataFrame) -> DataFrame:
    """One row: busiest month, busiest year, and years between first and last month."""
    month = F.min(F.struct((-F.col("total_plays")).alias("neg"), "year_month"))
    years = monthly_summary.groupBy(_year().alias("year")).agg(_total("total_plays").alias("plays"))
    year = years.agg(F.min(F.struct((-F.col("plays")).alias("neg"), "year")).alias("b"))
    return monthly_summary.agg(
        month["year_month"].alias("peak_month"), (-month["neg"]).alias("peak_month_plays"),
        (F.max(_year()) - F.min(_year())).alias("years_active"),
    ).select(
        "*", year.select("b.year").scalar().alias("peak_year"), year.select(-F.col("b.neg")).scalar().alias("peak_year_plays")
    )


def year_calendar_fill(monthly_summary: DataFrame) -> DataFrame:
    """All twelve months of every active year; months without plays have 0."""
    months = monthly_summary.select(_year().alias("year")).distinct().select(
        "year", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month")
    )
    label = F.format_string("%04d-%02d", "year", "month")
    return months.withColumn("year_month", label).join(
        monthly_summary.select("year_month", "total_plays"), "year_month", "left"
    ).select("year", "month", "year_month", F.coalesce("total_plays", F.lit(0)).alias("plays"))


def month_ratios(timeline: DataFrame) -> DataFrame:
    plays, hours = F.col("total_plays"), F.col("duration_hours")
    def whole(value: Column) -> Column:
        return F.round(value).cast("bigint")

    return timeline.select(
        "year_month",
        whole(plays / 30).alias("plays_per_day"),
        F.when(hours > 0, whole(plays / hours)).otherwise(F.lit(0)).alias("plays_per_hour"),
        whole(F.col("unique_tracks") / plays * 100).alias("unique_track_pct"),
        whole(hours * 60 / plays).alias("minutes_per_play"),
        F.round(plays / F.col("unique_tracks"), 1).alias("plays_per_track"),
        whole(F.col("top_artist_plays") / plays * 100).alias("top_artist_pct"),
    )


def artist_ratios(artist_totals: DataFrame) -> DataFrame:
    years = F.year("last_play_date") - F.year("first_play_date")
    whole = F.greatest(years, F.lit(1))
    return artist_totals.select(
        "artist_id", years.alias("years_listening"), F.round(F.col("total_plays") / whole).cast("bigint").alias("plays_per_year"),
        F.round(ms_to_hours("total_duration_ms") / whole).cast("bigint").alias("hours_per_year"),
        F.round(F.col("total_plays") / F.nullif("unique_tracks_played", F.lit(0))).cast("bigint").alias("plays_per_track"),
    )
