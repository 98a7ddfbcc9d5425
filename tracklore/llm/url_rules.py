"""URL verdicts from pattern rules that are found through their rarest literal token."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES_DDL = "rule string, pattern string, tokens array<string>, verdict string, tier int, length int"
TOKEN_BREAK = "[^0-9A-Za-z]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Address rules (verdict, host, path) of the registered query.
ADDRESS_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Words that block a host when one of its labels, split at hyphens, is the word.
BLOCKED_HOST_WORDS = ["ads", "adult", "bets", "casino", "pills", "spam"]


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c == "/" else "\\" + c for c in text)


def address_rule(verdict: str, host: str, path: str) -> tuple:
    """Rule for a host, all its subdomains and the paths that start with `path`; the longest rule wins.

    The literal tokens are those the pattern delimits on both sides; the open end of the path is none.
    """
    words = [w for w in host.replace("-", ".").split(".") if w] + [w for w in path.split("/")[1:-1] if w.isalnum()]
    return (host + path, f"^(?:[^/]*\\.)?{_quoted(host)}{_quoted(path)}", words, verdict, 0, len(host + path))


def host_word_rule(word: str, verdict: str = "block") -> tuple:
    """Rule for a word among the labels of a host; decides only where no address rule fits."""
    return (word, f"^(?:[^/]*[.-])?{_quoted(word)}[.-]", [word], verdict, 1, len(word))


def rule_table(spark: SparkSession, rules: Iterable[tuple]) -> DataFrame:
    rows = list(rules)
    if any(not row[2] for row in rows):
        raise ValueError("every rule needs a literal token")
    return spark.createDataFrame(rows, RULES_DDL)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no `://`."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _addresses(urls: DataFrame, url_column: str) -> DataFrame:
    host, path = url_parts(F.col(url_column))
    return urls.select(host.alias("host"), path.alias("path")).distinct()


def _exploded(addresses: DataFrame) -> DataFrame:
    words = F.array_distinct(F.split(F.concat("host", "path"), TOKEN_BREAK))
    return addresses.select("host", "path", F.explode(words).alias("token")).where("token <> ''")


def index_rules(urls: DataFrame, rules: DataFrame, url_column: str = "url") -> DataFrame:
    """Each rule under the literal token that the fewest distinct addresses have (ties: the smaller token)."""
    literals = rules.select("rule", "tier", F.explode("tokens").alias("token"))
    seen = (
        _exploded(_addresses(urls, url_column))
        .join(literals.select("token").distinct(), "token", "left_semi")
        .groupBy("token").agg(F.count("*").alias("n"))
    )
    rarest = (
        literals.join(seen, "token", "left")
        .groupBy("rule", "tier").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token"))["token"].alias("token"))
    )
    return rules.join(rarest, ["rule", "tier"])


def judge_urls(urls: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url",
               default: str = "allow") -> DataFrame:
    """Verdict per row of `urls`: (id, host, path, rule, verdict, pattern_rule).

    The tokens of an address fetch the rules indexed under them, and only those run their regular expression. The
    lowest tier decides, in it the longest rule, then `block` before `allow`, then the smaller rule text. `rule` is the
    winning address rule (tier 0) or null, `pattern_rule` the rule of a higher tier that decided instead. Null and
    malformed URLs have an empty host and path, fit no rule and get `default`. Rows with equal URLs are judged once and
    all kept; other columns of `urls` are not read. An empty table gives an empty result.
    """
    indexed = index_rules(urls, rules, url_column)
    fits = (
        _exploded(_addresses(urls, url_column)).join(indexed, "token")
        .where(F.expr("rlike(concat(host, path), pattern)"))
    )
    rank = F.struct("tier", -F.col("length"), F.col("verdict") != "block", "rule", "verdict")
    best = fits.groupBy("host", "path").agg(F.min(rank).alias("_best"))
    host, path = url_parts(F.col(url_column))
    rows = urls.select(F.col(id_column), host.alias("host"), path.alias("path"))
    return rows.join(best, ["host", "path"], "left").select(
        id_column, "host", "path",
        F.when(F.col("_best.tier") == 0, F.col("_best.rule")).alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
        F.when(F.col("_best.tier") > 0, F.col("_best.rule")).alias("pattern_rule"),
    )
