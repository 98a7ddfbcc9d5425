"""Registered search query."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklore.catalog import tables as t
from tracklore.catalog.registry import query
from tracklore.operators import search

# Every distinct part name, misspelled, is a query; parts, their types and brands are what is searched.
KINDS = {
    "artist": ("SELECT min(p_partkey) AS id, p_name AS name FROM part GROUP BY p_name", ["name"], 5),
    "album": (
        "SELECT min(p_partkey) AS id, concat(p_name, ' ', p_type) AS title, p_brand AS artist_name FROM part "
        "GROUP BY p_name, p_type, p_brand", ["title", "artist_name"], 5,
    ),
    "track": ("SELECT p_partkey AS id, p_name AS title, p_brand AS artist_name FROM part", ["title", "artist_name"], 10),
}
QUERY_TEXT = "replace(replace(p_name, 'e', ''), 'ol', 'lo')"


def _kind_sql(kind: str) -> str:
    rows, keys, limit = KINDS[kind]
    texts = " UNION ".join(f"SELECT id, lower({key}) AS text FROM ({rows})" for key in keys)
    return f"""
t_{kind} AS ({texts}),
s_{kind} AS (SELECT query, text, min(levenshtein(query, substring(text, i, n))) AS errors
  FROM q, (SELECT DISTINCT text FROM t_{kind}), range(1, 60) AS a(i), range(0, 40) AS b(n)
  WHERE i <= length(text) AND n BETWEEN length(query) - k AND length(query) + k AND i + n - 1 <= length(text) GROUP BY 1, 2),
h_{kind} AS (SELECT query, id, arg_min(errors, errors * 1000 + length(text)) AS errors,
               min(errors * 1000 + length(text)) AS best FROM s_{kind} JOIN t_{kind} USING (text)
             WHERE errors <= CAST(floor(length(query) * 0.3::DOUBLE + 1e-9) AS INTEGER) GROUP BY 1, 2),
r_{kind} AS (SELECT query, '{kind}' AS kind, CAST(row_number() OVER (PARTITION BY query ORDER BY best, id) AS INTEGER) AS rank,
               id, round(errors::DOUBLE / length(query), 6) AS score FROM h_{kind} QUALIFY rank <= {limit})"""


@query(
    "fuzzy_lookup",
    f"""WITH q AS (SELECT DISTINCT {QUERY_TEXT} AS query, CAST(floor(length({QUERY_TEXT}) * 0.3::DOUBLE + 1e-9) AS INTEGER) AS k
    FROM part), {_kind_sql('artist')}, {_kind_sql('album')}, {_kind_sql('track')}
    SELECT * FROM r_artist UNION ALL SELECT * FROM r_album UNION ALL SELECT * FROM r_track""",
)
def _(spark, d):
    part = t.table(spark, d, "part")
    queries = part.select(F.expr(QUERY_TEXT).alias("query")).distinct()
    rows = {kind: spark.sql(sql.replace("FROM part", "FROM {part}"), part=part) for kind, (sql, _k, _n) in KINDS.items()}
    return search.fuzzy_lookup(queries, rows["artist"], rows["album"], rows["track"])
