"""Pairs of names whose fuzzy score reaches a threshold between 0 and 1, found without comparing all pairs.

The score of different names is 0.8 * ratio + 0.2 if they sound alike, where ratio = 1 - d / (len a + len b) and d counts
insertions and deletions, or at least 0.9 if they differ by a leading "the". So a pair reaches threshold t in one of
four ways, and each way is an equi-join of its own:

* equal names;
* a leading "the": the name without it;
* equal sound, and a ratio of at least (t - 0.2) / 0.8: the sound, then length and Levenshtein bounds;
* a ratio of at least t / 0.8, possible up to t = 0.8: segments. If at most D letters are inserted or deleted, one of D + 1
  segments of the shorter name stands unchanged in the longer one, moved by no more letters than can have been inserted
  or deleted in front of it. The longer name looks its substrings up at these places only. Where D + 1 segments do not
  fit into the shorter name, which takes low thresholds or short names, all names of both lengths meet.

Nothing that reaches the threshold is lost; what the joins let through is scored, in batches, by the ratio itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklore.functions.similarity import fuzzy_score, metaphone
from tracklore.functions.text import matching_form

SOUND_WEIGHT = 0.2
#: Slack for bounds computed in floating point; a pair let through too much is scored anyway.
SLACK = 1e-9


def with_forms(names: DataFrame, name: str = "name") -> DataFrame:
    """Adds `form`, the folded name that scores compare, and `code`, its sound."""
    return names.withColumn("form", matching_form(name)).withColumn("code", metaphone("form"))


def most_edits(ratio: float, total: Column) -> Column:
    """Insertions and deletions that two names of `total` letters may differ by at this ratio or a higher one."""
    return F.floor((1 - ratio) * total + SLACK).cast("int")


def _near(ratio: float) -> Column:
    """Bounds that are cheap in the JVM: fewer letters differ in length, or by Levenshtein's count, than by insertions and deletions."""
    edits = most_edits(ratio, F.length("l_form") + F.length("r_form"))
    return (F.abs(F.length("l_form") - F.length("r_form")) <= edits) & (F.levenshtein("l_form", "r_form") <= edits)


def _lengths(ratio: float, longest: int, shorter: bool) -> Column:
    """Lengths of the other names, not shorter (or not longer) ones, with which the ratio can be reached."""
    n = F.length("form")
    if shorter:
        least = F.ceil(n * ratio / (2 - ratio) - SLACK).cast("int") if ratio > 0 else F.lit(1)
        return F.sequence(F.greatest(least, F.lit(1)), n)
    most = F.floor(n * (2 - ratio) / ratio + SLACK).cast("int") if ratio > 0 else F.lit(longest)
    return F.sequence(n, F.greatest(F.least(most, F.lit(longest)), n))


def _segments(names: DataFrame, ratio: float, longest: int) -> DataFrame:
    """(key, id, form): a key per length of the longer name and segment of this, the shorter one."""
    n = F.length("form")
    pairs = names.where("form <> ''").withColumn("_m", F.explode(_lengths(ratio, longest, False))).withColumn("_l", n)
    cut = pairs.withColumn("_k", most_edits(ratio, F.col("_l") + F.col("_m")) + 1)
    placed = cut.withColumn("_i", F.explode(F.when(F.col("_k") > F.col("_l"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_k") - 1))))
    start = F.floor(F.col("_i") * F.col("_l") / F.col("_k")).cast("int")
    stop = F.floor((F.col("_i") + 1) * F.col("_l") / F.col("_k")).cast("int")
    piece = F.when(F.col("_k") > F.col("_l"), F.lit("")).otherwise(F.substring("form", start + 1, stop - start))
    return placed.select(F.xxhash64("scope", "_l", "_m", "_i", piece).alias("key"), "id", "form")


def _substrings(names: DataFrame, ratio: float, longest: int) -> DataFrame:
    """(key, id, form): a key per length of the shorter name, segment of it, and place of this name where it may stand."""
    m = F.length("form")
    pairs = names.where("form <> ''").withColumn("_l", F.explode(_lengths(ratio, longest, True))).withColumn("_m", m)
    cut = pairs.withColumn("_k", most_edits(ratio, F.col("_l") + F.col("_m")) + 1)
    placed = cut.withColumn("_i", F.explode(F.when(F.col("_k") > F.col("_l"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_k") - 1))))
    start = F.floor(F.col("_i") * F.col("_l") / F.col("_k")).cast("int")
    size = F.floor((F.col("_i") + 1) * F.col("_l") / F.col("_k")).cast("int") - start
    more = F.col("_m") - F.col("_l")
    first = F.greatest(start - F.floor((F.col("_k") - 1 - more) / 2).cast("int"), F.lit(0))
    last = F.least(start + F.floor((F.col("_k") - 1 + more) / 2).cast("int"), F.col("_m") - size)
    whole = F.col("_k") > F.col("_l")
    at = placed.withColumn("_size", size).withColumn(
        "_at", F.explode(F.when(whole, F.array(F.lit(0))).when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
    piece = F.when(F.col("_k") > F.col("_l"), F.lit("")).otherwise(F.substring("form", F.col("_at") + 1, F.col("_size")))
    return at.select(F.xxhash64("scope", "_l", "_m", "_i", piece).alias("key"), "id", "form").distinct()


def _side(df: DataFrame, side: str) -> DataFrame:
    return df.select("scope", F.col("id").alias(f"{side}_id"), F.col("form").alias(f"{side}_form"), "code")


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float, keep: Column | None = None) -> DataFrame:
    """(l_id, r_id, score) of all pairs within a scope whose score is at least `threshold`; each pair once.

    Both sides are (scope, id, form, code) as `with_forms` makes them, ids unique within a side; names of the same scope
    meet, a null scope meets nothing. Empty forms score 0. `keep` is a condition on l_id and r_id that is tested before
    pairs are scored. With a threshold of 0 the result is all pairs; the work is otherwise that of the four joins.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("a threshold is between 0 and 1")
    sides = _side(left, "l"), _side(right, "r")
    columns = ["l_id", "r_id", "l_form", "r_form"]
    equal = sides[0].join(sides[1].drop("code"), (sides[0]["scope"] == sides[1]["scope"]) & (F.col("l_form") == F.col("r_form"))).select(*columns)
    found = [equal]
    for a, b in (("l", "r"), ("r", "l")):
        with_the, bare = sides["lr".index(a)], sides["lr".index(b)].where(~F.col(f"{b}_form").startswith("the ")).drop("code")
        with_the = with_the.where(F.col(f"{a}_form").startswith("the ")).withColumn(f"{b}_form", F.expr(f"substring({a}_form, 5)"))
        found.append(with_the.drop("code").join(bare, ["scope", f"{b}_form"]).select(*columns))
    sounding = sides[0].where("code <> ''").join(sides[1].where("code <> ''"), ["scope", "code"])
    found.append(sounding.where(_near(max((threshold - SOUND_WEIGHT) / (1 - SOUND_WEIGHT), 0.0))).select(*columns))
    ratio = threshold / (1 - SOUND_WEIGHT)
    if ratio <= 1:
        longest = max([side.agg(F.max(F.length("form"))).first()[0] or 1 for side in (left, right)])
        short, long = _segments(left, ratio, longest), _substrings(right, ratio, longest)
        named = lambda df, side: df.select("key", F.col("id").alias(f"{side}_id"), F.col("form").alias(f"{side}_form"))
        found.append(named(short, "l").join(named(long, "r"), "key").where(_near(ratio)).select(*columns))
        short, long = _segments(right, ratio, longest), _substrings(left, ratio, longest)
        found.append(named(short, "r").join(named(long, "l"), "key").where(_near(ratio)).select(*columns))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    if keep is not None:
        pairs = pairs.where(keep)
    score = fuzzy_score("l_form", "r_form")
    return pairs.distinct().withColumn("score", score).where(F.col("score") >= threshold).select("l_id", "r_id", "score")
