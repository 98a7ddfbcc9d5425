"""Raw exports: JSON streaming history and CSV scrobbles."""

from __future__ import annotations

import csv
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tracklore.functions.text import strip
from tracklore.schema import STREAMING_HISTORY_DDL
from tracklore.session import cut_lineage
from tracklore.sources.blocks import BLOCK, read_pieces, with_running


# JSON text cut at closing braces: a string or what is left of one, other text, and the rest of a string a piece begins in.
_STRING = r'"(?:\\.|[^"\\])*(?:"|$)'
_OTHER = r'[^"{}\[\]]'
_REST_OF_STRING = r'^(?:\\.|[^"\\])*(?:"|$)'


def read_json_history(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, source_row, payload): one row per JSON object of every export file.

    A file holds a list of objects, or an object with such a list under `plays`; source_row numbers its objects. Elements
    stay raw text here so that the content hash covers fields the schema does not know. A file that ends within a
    string, a list or an object, or with an element that does not parse, gives no rows; what stands between elements is
    not checked.

    No file is one row or one task: Spark reads it in blocks of pieces that end with a closing brace. Whether a piece
    begins inside a string follows from the quotes before it, its depth from the braces and brackets outside strings,
    its element from the elements that ended before: three running totals over the blocks of a file.
    """
    return json_elements(read_pieces(spark, path, "}"))


def _depths(brackets: Column, depth: Column) -> Column:
    """The depth before the first bracket and after each one."""
    step = lambda done, c: F.concat(done, F.array(F.element_at(done, -1) + F.when(c.isin("{", "["), 1).otherwise(-1)))
    letters = F.filter(F.split(brackets, ""), lambda c: c != "")
    return F.aggregate(letters, F.array(depth.cast("int")), step)


def _behind(n: Column) -> Column:
    """Pattern of a text up to and with its n-th bracket outside strings."""
    return F.concat(F.lit(rf"^(?:(?:{_STRING}|{_OTHER})*[{{}}\[\]]){{"), n.cast("string"), F.lit("}"))


def json_elements(pieces: DataFrame) -> DataFrame:
    """The elements of JSON files cut at closing braces, (source_file, block, place, piece); see `read_json_history`.

    An object ends with the closing brace behind a piece if that brings the file back to the depth of its list. It begins
    in the last piece that has been at this depth, behind the last bracket that led there.
    """
    clean = pieces.withColumn("piece", F.when(F.col("block") == 0, F.regexp_replace("piece", "^\ufeff", "")).otherwise(F.col("piece")))
    quotes = F.length(F.regexp_replace("piece", r'\\.|[^"]', ""))
    quoted = with_running(clean, quotes=quotes)
    inside = F.col("quotes") % 2 == 1
    own = F.when(inside, F.regexp_replace("piece", _REST_OF_STRING, "")).otherwise(F.col("piece"))
    # The brace behind a piece counts unless it stands in a string. Behind the last piece there may be none.
    measured = quoted.withColumns({"own": own, "closes": ((F.col("quotes") + quotes) % 2 == 0).cast("int")}).withColumn(
        "brackets", F.regexp_replace(F.regexp_replace("own", _STRING, ""), r"[^\[\]{}]", ""))
    opened = 2 * F.length(F.regexp_replace("brackets", r"[\]}]", "")) - F.length("brackets") - F.col("closes")

    # A file is a list from its first visible letter on, or else wraps one: its objects end at depth 1 or 2.
    upto = W.Window.partitionBy("source_file").orderBy("block").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    visible = clean.where(F.col("piece").rlike(r"\S")).groupBy(*BLOCK).agg(F.min_by("piece", "place").alias("_first"))
    starts = clean.select(*BLOCK).distinct().join(visible, BLOCK, "left").select(
        *BLOCK, F.when(strip(F.first("_first", True).over(upto)).startswith("["), 1).otherwise(2).alias("level"))
    deep = with_running(measured, depth=opened).join(cut_lineage(starts), BLOCK).withColumn("depths", _depths(F.col("brackets"), F.col("depth")))
    deep = deep.withColumn("end_depth", F.element_at("depths", -1))
    ends = ((F.col("closes") == 1) & (F.col("end_depth") - 1 == F.col("level"))).cast("int")
    n = F.size("depths")
    at_level = n - F.array_position(F.reverse("depths"), F.col("level"))  # 0 or more brackets lead there, n if it never is
    opens = F.transform(F.slice("depths", 1, F.greatest(n - 1, F.lit(0))), lambda x, i: (x == 1) & (F.get("depths", i + 1) == 2))
    opening = n - 1 - F.array_position(F.reverse(opens), True)  # brackets before the last one from depth 1 to 2
    name = F.concat(_behind(F.col("opening")), F.lit(rf'(?:{_STRING}|{_OTHER})*?"((?:\\.|[^"\\])*)"\s*:\s*\['))
    parts = cut_lineage(
        with_running(deep.withColumn("ends", ends), element=F.col("ends"))
        .withColumn("opening", F.when((F.col("level") == 2) & F.array_contains(opens, True), opening))
        .withColumn("from", F.when(F.array_contains("depths", F.col("level")), at_level)).select(
            *BLOCK, "place", "piece", "closes", "level", "end_depth", "ends", "element",
            F.when(F.col("opening").isNotNull(), F.call_function("regexp_extract", F.col("own"), name, F.lit(1))).alias("key"),
            F.when(F.col("from").isNotNull(), F.regexp_replace("own", F.concat(_behind(F.col("from")), F.lit(rf"(?:{_STRING}|{_OTHER})*")), F.lit(""))).alias("begin")))

    order = F.struct("block", "place")
    first = parts.where("begin is not null").groupBy("source_file", "element").agg(
        F.max(order).alias("start"), F.max_by("begin", order).alias("begin"))
    # An element has few pieces, one for each object and each brace in it.
    texts = parts.groupBy("source_file", "element").agg(
        F.array_sort(F.collect_list(F.struct("block", "place", "piece"))).alias("pieces"), F.max("ends").alias("whole"), F.max("level").alias("level"))
    later = lambda p: (p["block"] > F.col("start.block")) | ((p["block"] == F.col("start.block")) & (p["place"] > F.col("start.place")))
    more = F.transform(F.filter("pieces", later), lambda p: p["piece"])
    objects = texts.where("whole = 1").join(first, ["source_file", "element"]).select(
        "source_file", "element", "level", F.concat(F.array_join(F.concat(F.array("begin"), more), "}"), F.lit("}")).alias("payload"))

    # Of a wrapping object only the list under `plays` counts. What opens at depth 1 begins a list or ends the last one.
    marks = parts.where("key is not null").groupBy("source_file", F.col("element").alias("from")).agg(F.max_by("key", order).alias("key"))
    until = F.lead("from").over(W.Window.partitionBy("source_file").orderBy("from"))
    lists = marks.withColumn("until", until).where("key = 'plays'").select(F.col("source_file").alias("_file"), "from", "until")
    in_list = (F.col("source_file") == F.col("_file")) & (F.col("element") >= F.col("from")) & (F.col("until").isNull() | (F.col("element") < F.col("until")))
    listed = objects.where("level = 1").unionByName(objects.where("level = 2").join(lists, in_list, "left_semi")).where("payload like '{%'")

    last = parts.groupBy("source_file").agg(F.max_by(F.struct("closes", "end_depth"), order).alias("end"), F.max("level").alias("level"))
    open_end = (F.col("end.closes") == 0) | ~((F.col("end.end_depth") == 0) | ((F.col("level") == 2) & (F.col("end.end_depth") == 1)))
    broken = last.where(open_end).select("source_file").unionByName(
        listed.where(F.try_parse_json("payload").isNull()).select("source_file")).distinct()
    return listed.join(broken, "source_file", "left_anti").select(
        "source_file", (F.col("element") + 1).cast("bigint").alias("source_row"), "payload")


def parse_history(rows: DataFrame) -> DataFrame:
    """Typed columns next to the raw payload."""
    parsed = rows.withColumn("r", F.from_json("payload", STREAMING_HISTORY_DDL))
    return parsed.select("source_file", "source_row", "payload", "r.*")


# Accepted header names per field, first non-blank wins.
SCROBBLE_ALIASES = {
    "uts": ["uts", "timestamp", "unix_timestamp"],
    "utc_time": ["utc_time", "datetime", "date"],
    "artist_name": ["artist", "artist_name", "band"],
    "artist_mbid": ["artist_mbid"],
    "album_name": ["album", "album_name"],
    "album_mbid": ["album_mbid"],
    "track_name": ["track", "track_name", "song"],
    "track_mbid": ["track_mbid"],
    "duration_seconds": ["duration_seconds", "duration"],
    "application": ["application", "source", "scrobbler"],
}
INTEGER_FIELDS = {"uts", "duration_seconds"}


def read_csv_scrobbles(spark: SparkSession, *paths: str) -> DataFrame:
    """Scrobbles with position columns. Files may have different headers; those with equal ones are read together."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    parts = [reader.schema(_columns(header)).csv(files) for path in paths for header, files in files_by_header(spark, path)]
    return reduce(DataFrame.unionByName, [resolve_scrobble_header(part) for part in parts])


def _columns(header: str) -> str:
    """Schema of files with this first line; its names may be quoted, empty or repeated."""
    names = []
    for i, name in enumerate(next(csv.reader([header.replace("\ufeff", "")]), [])):
        names.append(name if name.strip() and name.strip().lower() not in {n.strip().lower() for n in names} else f"_c{i}")
    return ", ".join(f"`{name.replace('`', '``')}` string" for name in names)


def files_by_header(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """(first line, files) of the files below `path` that have the same one; `path` itself if all have.

    Only first lines and file names reach the driver, which lists the files anyway.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), F.col("value").alias("header"))
    first = lines.where("block = 0 AND trim(header) <> ''").groupBy("file").agg(F.min_by("header", "line").alias("header"))
    groups = first.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header").collect()
    if len(groups) <= 1:
        return [(groups[0]["header"] if groups else "uts", [path])]
    jvm = spark.sparkContext._jvm
    # The metadata names files as encoded addresses; readers take names as patterns.
    names = [[jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)).toString() for f in g["files"]] for g in groups]
    return [(g["header"], [re.sub(r"([\\[\]{}*?])", r"\\\1", name) for name in group]) for g, group in zip(groups, names)]


def resolve_scrobble_header(raw: DataFrame) -> DataFrame:
    names = {c.replace("\ufeff", "").strip().lower(): c for c in raw.columns}
    raw_columns = {name: F.col(f"`{column}`") for name, column in names.items()}
    payload = F.to_json(F.struct(*[raw_columns[name].alias(name) for name in sorted(names)]))
    fields = [_pick(raw_columns, field).alias(field) for field in SCROBBLE_ALIASES]
    position = F.struct(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    return raw.select(position.alias("position"), payload.alias("payload"), *fields).withColumn(
        "source_file", F.col("position.source_file")
    )


def _pick(columns: dict[str, Column], field: str) -> Column:
    present = [F.nullif(strip(columns[a]), F.lit("")) for a in SCROBBLE_ALIASES[field] if a in columns]
    text = F.coalesce(*present) if present else F.lit(None).cast("string")
    return text.try_cast("double").try_cast("bigint") if field in INTEGER_FIELDS else text
