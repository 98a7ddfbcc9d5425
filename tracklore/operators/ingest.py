"""Row validation, filtering and exact de-duplication at ingest.

Rows get one `row_status` column instead of passing through a chain of filters, so the counters of the ingest
report and the accepted rows come from the same expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklore.functions.text import let, squeeze
from tracklore.operators.skew import first_per_key, salted_join
from tracklore.sources.blocks import with_number

MIN_SECONDS = 30
# Flag per field that may be missing.
METADATA_FIELDS = {
    "missing_track_name": "master_metadata_track_name",
    "missing_artist_name": "master_metadata_album_artist_name",
    "missing_album_name": "master_metadata_album_album_name",
    "missing_track_uri": "spotify_track_uri",
}
#: Compact times, which have no separators to take apart.
COMPACT_TIME_FORMATS = ["yyyyMMdd'T'HHmmss", "yyyyMMdd'T'HHmmssX", "yyyyMMdd"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH_NAME = "(january|february|march|april|may|june|july|august|september|october|november|december|sept|" + "|".join(MONTHS) + r")\b\.?"
WEEKDAY = r"\b(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday|mon|tues|tue|wed|thurs|thur|thu|fri|sat|sun)\b\.?"
CLOCK = r"\b(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?(?:\s*([ap])\.?m\b\.?)?"
ZONE = r"(?:\s*([+-])(\d{2}):?(\d{2})|\s*\b(z|utc|gmt))\s*$"
SAMPLE_ROWS = 3


# --- column expressions ------------------------------------------------------------------


def utc_timestamp(text: Column | str) -> Column:
    """ISO time, naive means UTC; NULL when it does not parse."""
    return F.try_to_timestamp(text)


def spelled_time(text: Column | str) -> Column:
    """struct(time, offset): the time as written and seconds east of UTC or NULL, of a date in ordinary spelling; NULL
    time if any part is not understood.

    Weekday, clock, zone and month name are recognised wherever they stand and taken out; what is left must be the
    numbers of the date. Beside a month name the number of four digits or above 31 is the year, the last one if there is
    none. Three numbers are year, month, day if the first has four digits, else month, day, year, or day, month, year if
    the first cannot be a month. Years of two digits are those from 1969 to 2068. A date without a clock is midnight.
    """
    lower = F.lower(F.col(text) if isinstance(text, str) else text)
    # A letter between date and clock stands for a blank.
    plain = F.regexp_replace(F.regexp_replace(lower, r"(\d)t(\d)", "$1 $2"), WEEKDAY, " ")
    return let(plain, lambda p: let(F.struct(p.alias("p"), p.rlike(CLOCK).alias("timed")), _clock_apart))


def _clock_apart(t: Column) -> Column:
    plain, timed = t["p"], t["timed"]
    date = F.when(timed, F.regexp_replace(F.regexp_replace(plain, ZONE, " "), CLOCK, " ")).otherwise(plain)
    parts = F.struct(
        plain.alias("plain"), timed.alias("timed"), date.alias("date"),
        *(F.when(timed, F.regexp_extract(plain, CLOCK, i)).alias(name) for i, name in enumerate(("hour", "minute", "second", "fraction", "half"), 1)),
        *(F.when(timed, F.regexp_extract(plain, ZONE, i)).alias(name) for i, name in enumerate(("sign", "hours", "minutes", "utc"), 1)),
        F.substring(F.regexp_extract(date, r"(?<![a-z])" + MONTH_NAME, 1), 1, 3).alias("month"),
        F.regexp_replace(F.regexp_replace(date, r"(?<![a-z])" + MONTH_NAME, " "), r"\b(\d{1,2})(?:st|nd|rd|th)\b|\b(?:of|at)\b", "$1 ").alias("rest"))
    return let(parts, lambda p: let(F.regexp_extract_all(p["rest"], F.lit(r"\d+"), F.lit(0)), lambda digits: _time_of(p, digits)))


def _time_of(t: Column, digits: Column) -> Column:
    month = F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), t["month"]), F.lit(0)).cast("int")
    clean = t["rest"].rlike(r"^[\s,./-]*(?:\d{1,4}[\s,./-]*){2,3}$")
    size = F.size(digits)

    def number(i: int) -> Column:
        return F.get(digits, F.lit(i)).try_cast("int")

    def long(i: int) -> Column:
        return F.length(F.get(digits, F.lit(i))) == 4

    def year(i: int) -> Column:
        return number(i) + F.when(long(i), 0).when(F.length(F.get(digits, F.lit(i))) <= 2, F.when(number(i) < 69, 2000).otherwise(1900))

    first_year, day_first = long(0) | (number(0) > 31), number(0) > 12
    named = F.struct(F.when(first_year, year(0)).otherwise(year(1)).alias("y"), month.alias("m"), F.when(first_year, number(1)).otherwise(number(0)).alias("d"))
    ordered = F.struct(number(0).alias("y"), number(1).alias("m"), number(2).alias("d"))
    placed = F.struct(year(2).alias("y"), F.when(day_first, number(1)).otherwise(number(0)).alias("m"),
                      F.when(day_first, number(0)).otherwise(number(1)).alias("d"))
    day = F.when(clean & month.isNotNull() & (size == 2), named).when(
        clean & month.isNull() & (size == 3), F.when(long(0), ordered).otherwise(placed))
    hour = t["hour"].try_cast("int")
    hour = F.when(t["half"] == "", hour).when(hour.between(1, 12), hour % 12 + F.when(t["half"] == "p", 12).otherwise(0))
    second = F.coalesce(F.nullif(t["second"], F.lit("")).try_cast("int"), F.lit(0)) + F.concat(F.lit("0."), t["fraction"], F.lit("0")).try_cast("decimal(16,6)")
    clock = [F.when(t["timed"], x).otherwise(0) for x in (hour, t["minute"].try_cast("int"), second)]
    east = (t["hours"].try_cast("long") * 3600 + t["minutes"].try_cast("long") * 60) * F.when(t["sign"] == "-", -1).otherwise(1)
    offset = F.when(t["utc"] != "", F.lit(0).cast("long")).when(t["hours"] != "", east)
    time = let(day, lambda d: F.try_make_timestamp(d["y"], d["m"], d["d"], clock[0], clock[1], clock[2].cast("decimal(16,6)")))
    return F.struct(time.alias("time"), offset.alias("offset"))


def scrobble_timestamp(epoch: Column | str, text: Column | str, zone: str = "UTC") -> Column:
    """Epoch seconds win; otherwise text, read in `zone` unless it carries an offset. ISO times, compact ones, and dates
    in ordinary spelling (`spelled_time`)."""
    text = F.col(text) if isinstance(text, str) else text
    epoch = F.col(epoch) if isinstance(epoch, str) else epoch
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})\s*$") & (text.contains(":") | text.rlike(r"^\s*\d{8}T"))
    # A clock alone would be a time of today.
    known = F.coalesce(F.when(text.rlike(r"^\s*[+-]?\d{4}"), F.try_to_timestamp(text)), *[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in COMPACT_TIME_FORMATS])
    read = let(known, lambda k: F.when(zoned, k).otherwise(F.to_utc_timestamp(k, zone)))
    spelled = let(spelled_time(text), lambda s: F.when(
        s["offset"].isNotNull(), F.timestamp_micros(F.unix_micros(s["time"]) - s["offset"] * 1_000_000)).otherwise(F.to_utc_timestamp(s["time"], zone)))
    return F.coalesce(F.timestamp_seconds(epoch), read, spelled)


def filled(text: Column | str) -> Column:
    """Neither NULL nor empty."""
    return F.coalesce((F.col(text) if isinstance(text, str) else text) != "", F.lit(False))


def is_podcast() -> Column:
    return filled("episode_name") | filled("episode_show_name") | filled("spotify_episode_uri")


def is_short(min_seconds: int = MIN_SECONDS) -> Column:
    return F.coalesce("ms_played", F.lit(0)) < min_seconds * 1000


def metadata_flags() -> Column:
    marks = F.array(*[F.when(~filled(column), F.lit(flag)) for flag, column in METADATA_FIELDS.items()])
    present = F.filter(marks, lambda mark: mark.isNotNull())
    return F.when(F.size(present) > 0, present)


def album_missing(album: Column | str = "album_name") -> Column:
    return squeeze(album).isNull()


def offline_timestamp(epoch_ms: Column | str = "offline_timestamp") -> Column:
    return F.timestamp_millis(F.nullif(epoch_ms, F.lit(0).cast("bigint")))


def bool_to_int(flag: Column | str) -> Column:
    return (F.col(flag) if isinstance(flag, str) else flag).cast("int")


def content_hash(payload: Column | str = "payload") -> Column:
    """SHA-256 over the row's fields in key order, whatever order the file has."""
    fields = F.array_sort(F.map_entries(F.from_json(payload, "map<string,string>")))
    return F.sha2(F.to_json(F.map_from_entries(fields)), 256)


def row_status(valid: Column, skip_podcasts: bool = True, min_seconds: int = MIN_SECONDS) -> Column:
    """invalid, then podcast, then short; what is left is ok."""
    return (
        F.when(~valid, "invalid")
        .when(F.lit(skip_podcasts) & is_podcast(), "podcast")
        .when(is_short(min_seconds), "short")
        .otherwise("ok")
    )


# --- streaming history -------------------------------------------------------------------


def classify_history(rows: DataFrame, skip_podcasts: bool = True, min_seconds: int = MIN_SECONDS) -> DataFrame:
    timed = rows.withColumn("play_ts", utc_timestamp("ts"))
    return timed.select(
        "*",
        row_status(F.col("play_ts").isNotNull(), skip_podcasts, min_seconds).alias("row_status"),
        metadata_flags().alias("metadata_flags"),
        content_hash().alias("raw_hash"),
    )


def accepted_history(classified: DataFrame, known_hashes: DataFrame | None = None) -> DataFrame:
    """First row per content hash, minus hashes that are already stored."""
    ok = classified.where("row_status = 'ok'")
    fresh = first_per_key(ok, ["raw_hash"], [F.col("source_file"), F.col("source_row")])
    return fresh if known_hashes is None else fresh.join(known_hashes.select("raw_hash"), "raw_hash", "left_anti")


def rejected_history(classified: DataFrame) -> DataFrame:
    """Quarantine: rows with no usable time."""
    return classified.where("row_status = 'invalid'").select("source_file", "source_row", "payload")


def history_report(classified: DataFrame) -> DataFrame:
    """One row of counters. Copies collapse per hash before the total."""
    per_hash = classified.groupBy("row_status", "raw_hash").agg(
        F.count("*").alias("n"),
        F.min("play_ts").alias("first_ts"),
        F.max("play_ts").alias("last_ts"),
        F.max(F.col("metadata_flags").isNotNull().cast("int")).alias("flagged"),
    )
    ok = F.col("row_status") == "ok"
    counters = per_hash.agg(
        _total("n").alias("records_seen"),
        F.count_if(ok).alias("inserted"),
        _total(F.when(F.col("row_status") == "podcast", F.col("n"))).alias("skipped_podcasts"),
        _total(F.when(F.col("row_status") == "short", F.col("n"))).alias("skipped_short"),
        _total(F.when(F.col("row_status") == "invalid", F.col("n"))).alias("invalid_records"),
        _total(F.when(ok, F.col("n") - 1)).alias("duplicate_rows"),
        _total(F.when(ok, F.col("flagged"))).alias("metadata_flagged"),
        F.min(F.when(ok, F.col("first_ts"))).alias("start_ts"),
        F.max(F.when(ok, F.col("last_ts"))).alias("end_ts"),
    )
    files = classified.agg(F.count_distinct("source_file").alias("n"))
    return counters.select(files.scalar().alias("files_processed"), "*")


def _total(value: Column | str) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")


def sample_rows(accepted: DataFrame, columns: list[str], n: int = SAMPLE_ROWS) -> DataFrame:
    """First rows in file order (a top-k, not a full sort)."""
    return accepted.orderBy("source_file", "source_row").limit(n).select(*columns, "source_file")


# --- scrobbles ---------------------------------------------------------------------------


def classify_scrobbles(rows: DataFrame, zone: str = "UTC") -> DataFrame:
    """Adds time, status, flags and the de-duplication key."""
    return rows.withColumn("play_ts", scrobble_timestamp("uts", "utc_time", zone)).select(
        "*",
        F.when(F.col("play_ts").isNull(), "invalid").otherwise("ok").alias("row_status"),
        album_missing().alias("album_missing"),
        F.struct(
            F.coalesce(F.nullif("uts", F.lit(0)).cast("string"), "utc_time", F.lit("")).alias("time"),
            F.lower(F.coalesce("artist_name", F.lit(""))).alias("artist"),
            F.lower(F.coalesce("track_name", F.lit(""))).alias("track"),
        ).alias("scrobble_key"),
    )


def dedupe_scrobbles(classified: DataFrame, drop: bool = True) -> DataFrame:
    """First row per scrobble key in file order; the others go, or stay flagged with `drop=False`."""
    ok = classified.where("row_status = 'ok'")
    if drop:
        return first_per_key(ok, ["scrobble_key"], [F.col("position")]).withColumn("duplicate_in_run", F.lit(False))
    # Only keys that repeat are looked up again, and a hot key is spread over several tasks.
    repeated = (
        ok.groupBy("scrobble_key")
        .agg(F.min("position").alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1")
        .drop("_n")
    )
    marked = salted_join(ok, repeated, ["scrobble_key"], F.col("position"), "left")
    return marked.withColumn(
        "duplicate_in_run", F.coalesce(F.col("position") != F.col("_first"), F.lit(False))
    ).drop("_first")


def positional_hash(rows: DataFrame) -> DataFrame:
    """Hash of file, occurrence and payload, so only a re-read of the same file repeats it.

    Spark has no line numbers. Equal rows of a file are interchangeable, so numbering the copies of each payload
    gives the same set of hashes on every read. Copies are counted first and numbered in chunks, which never
    brings one payload's copies together.
    """
    chunk = 10_000
    counted = rows.groupBy("source_file", "payload").agg(F.count("*").alias("copies"))
    chunks = counted.withColumn("first", F.explode(F.expr(f"sequence(1, copies, {chunk})")))
    return chunks.select(
        "source_file",
        "payload",
        F.explode(F.expr(f"sequence(first, least(copies, first + {chunk - 1}))")).alias("occurrence"),
    ).withColumn("raw_hash", F.sha2(F.concat_ws("|", "source_file", F.col("occurrence").cast("string"), "payload"), 256))


def with_positional_hash(rows: DataFrame) -> DataFrame:
    """Adds source_row, the number of each record in its file, and raw_hash of file, number and payload.

    Only a re-read of the same file repeats a hash; equal rows of a file and of other files keep theirs apart. Numbers are
    counts of the records before, added up over the blocks of a file, so no file has to fit into a task.
    """
    placed = rows.withColumns({"source_file": F.col("position.source_file"), "block": F.col("position.block"), "place": F.col("position.line")})
    numbered = with_number(placed, "source_row").drop("block", "place")
    return numbered.withColumn("raw_hash", F.sha2(F.concat_ws("|", "source_file", F.col("source_row").cast("string"), "payload"), 256))


def new_scrobbles(hashed: DataFrame, known_hashes: DataFrame | None = None) -> DataFrame:
    """Rows of `with_positional_hash` whose hash is not stored yet: a second ingest of the same files adds nothing."""
    return hashed if known_hashes is None else hashed.join(known_hashes.select("raw_hash"), "raw_hash", "left_anti")


def scrobble_report(classified: DataFrame, drop: bool = True) -> DataFrame:
    """One row of counters."""
    per_key = classified.groupBy("row_status", "scrobble_key").agg(
        F.count("*").alias("n"),
        F.min("play_ts").alias("first_ts"),
        F.max("play_ts").alias("last_ts"),
        F.count_if("album_missing").alias("n_missing"),
        F.min_by("album_missing", "position").cast("int").alias("first_missing"),
    )
    ok = F.col("row_status") == "ok"
    kept = F.lit(1) if drop else F.col("n")
    missing = F.col("first_missing") if drop else F.col("n_missing")
    counters = per_key.agg(
        _total("n").alias("records_seen"),
        _total(F.when(ok, kept)).alias("inserted"),
        _total(F.when(~ok, F.col("n"))).alias("invalid_records"),
        _total(F.when(ok, missing)).alias("missing_album"),
        _total(F.when(ok, F.col("n") - 1)).alias("duplicates_flagged"),
        _total(F.when(ok, F.col("n") - kept)).alias("duplicates_skipped"),
        F.min(F.when(ok, F.col("first_ts"))).alias("start_ts"),
        F.max(F.when(ok, F.col("last_ts"))).alias("end_ts"),
    )
    files = classified.agg(F.count_distinct("source_file").alias("n"))
    return counters.select(files.scalar().alias("files_processed"), "*")


# --- run log -----------------------------------------------------------------------------


def computation_log(result: DataFrame, kind: str, started_at: Column, completed_at: Column) -> DataFrame:
    """One log row per finished job, to append to the run log."""
    return result.agg(F.count("*").alias("entities_processed")).select(
        F.lit(kind).alias("computation_type"),
        "entities_processed",
        started_at.alias("started_at"),
        completed_at.alias("completed_at"),
        F.lit("completed").alias("status"),
    )
