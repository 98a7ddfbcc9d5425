"""Raw names to canonical artists, albums and tracks, and raw plays to canonical plays.

Names are read in sorted order and each new name joins the best earlier canonical name that is similar enough, or
becomes canonical itself. Instead of one loop over all names, names first collapse to one representative per slug. With
a threshold above 0.8 only names that sound alike are compared, as nothing else can reach it but pairs that differ by a
leading "the"; with a lower one the similar pairs come from a join that loses none (`similar_names`).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklore.functions.similarity import fuzzy_score, fuzzy_similarity, metaphone
from tracklore.functions.text import artist_parts, canonical_album, canonical_track, entity_slug, matching_form
from tracklore.operators.similar_names import SOUND_WEIGHT, similar_pairs, with_forms
from tracklore.operators.skew import salted_join, top_per_key
from tracklore.session import cut_lineage, discard

FUZZY_THRESHOLD = 0.85
AMBIGUOUS_BELOW = 0.95


# --- distinct names ----------------------------------------------------------------------


def _union(sources: tuple[DataFrame, ...], columns: list[Column], keep: str) -> DataFrame:
    parts = [s.where(keep).select(*columns) for s in sources]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.distinct()


def distinct_raw_artists(*sources: DataFrame) -> DataFrame:
    return _union(sources, [F.col("artist_name")], "artist_name is not null")


def distinct_raw_albums(*sources: DataFrame) -> DataFrame:
    return _union(
        sources, [F.col("artist_name"), F.col("album_name")], "artist_name is not null and album_name is not null"
    )


def distinct_raw_tracks(*sources: DataFrame) -> DataFrame:
    album = F.coalesce("album_name", F.lit("")).alias("album_name")
    return _union(
        sources,
        [F.col("artist_name"), album, F.col("track_name")],
        "artist_name is not null and track_name is not null",
    )


# --- overrides ---------------------------------------------------------------------------


def with_override(names: DataFrame, column: str, kind: str, overrides: DataFrame | None) -> tuple[DataFrame, Column | None]:
    """Adds the manual replacement list of a raw name; overrides are (kind, raw, replacement array)."""
    if overrides is None:
        return names, None
    table = overrides.where(F.col("kind") == kind).select(F.col("raw").alias(column), F.col("replacement").alias("_manual"))
    return names.join(table, column, "left"), F.col("_manual")


# --- choosing canonical names ------------------------------------------------------------

BLOCK_LIMIT = 1_000
ROWS_PER_BATCH = 20_000
ELECTION_DDL = "scope bigint, slug string, leader string, confidence double"


def elect(reps: DataFrame, threshold: float | None = FUZZY_THRESHOLD, block_limit: int = BLOCK_LIMIT) -> DataFrame:
    """(scope, slug, leader, confidence) for representatives (scope, slug, name, ord).

    `scope` limits who may match whom (NULL: slugs only), `ord` is the reading order. A leader has itself as leader.
    """
    alone = reps.select("scope", "slug", F.col("slug").alias("leader"), F.lit(1.0).alias("confidence"))
    if threshold is None:
        return alone
    if threshold <= 1 - SOUND_WEIGHT:
        return _elect_by_pairs(reps, threshold)
    blocked = cut_lineage(_blocks(reps))
    sizes = blocked.groupBy("block").agg(F.count("*").alias("n"))
    sized = salted_join(blocked, sizes, ["block"], F.col("slug"))
    totals = sizes.agg(
        F.count_if(F.col("n") > block_limit).alias("large"),
        F.sum(F.when(F.col("n").between(2, block_limit), F.col("n"))).alias("rows"),
    ).first()
    result = sized.where("n = 1").select(
        "scope", "slug", F.col("slug").alias("leader"), F.lit(1.0).alias("confidence")
    )
    if totals["rows"]:
        batches = 1 + totals["rows"] // ROWS_PER_BATCH
        rows = sized.where(F.col("n").between(2, block_limit)).withColumn(
            "batch", F.pmod(F.xxhash64("block"), F.lit(batches))
        )

        def settle(batch: pd.DataFrame) -> pd.DataFrame:
            return pd.concat([_elect_block(block, threshold) for _, block in batch.groupby("block")])

        result = result.unionByName(rows.groupBy("batch").applyInPandas(settle, ELECTION_DDL))
    if totals["large"]:
        large = sized.where(F.col("n") > block_limit).drop("n")
        result = result.unionByName(_elect_large(large, threshold, block_limit))
    return result


def _blocks(reps: DataFrame) -> DataFrame:
    """Adds `form`, `code` and `block`; names that can match share a block.

    The block is scope and sound, without a leading "the". A name without any sound can only match its own "the"
    variant, whose sound is that of "the" alone; it joins that block if the variant exists and stays alone otherwise.
    """
    formed = reps.withColumn("form", matching_form("name")).withColumn("code", metaphone("form"))
    silent = F.col("code") == ""
    variants = (
        formed.where((F.col("code") == "0") & F.col("form").startswith("the "))
        .select("scope", F.expr("substring(form, 5)").alias("form"), F.lit(True).alias("has_variant"))
        .distinct()
    )
    sound = F.when(F.col("code") == "0", F.col("code")).otherwise(F.regexp_replace("code", "^0 ", ""))
    key = (
        F.when(~silent, F.concat(F.lit("s:"), sound))
        .when(F.col("has_variant"), F.lit("s:0"))
        .otherwise(F.concat(F.lit("n:"), F.col("slug")))
    )
    joined = salted_join(formed, variants, ["scope", "form"], F.col("slug"), "left")
    return joined.withColumn("block", F.xxhash64("scope", key)).drop("has_variant")


def _elect_block(block: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Names in reading order; each joins its best earlier leader or becomes one."""
    leaders: list[tuple] = []
    rows = []
    for row in sorted(block.itertuples(index=False), key=lambda r: tuple(r.ord)):
        best, best_score = None, 0.0
        for leader in leaders:
            if leader.scope != row.scope:
                continue
            score = fuzzy_similarity(row.form, leader.form, row.code, leader.code)
            if score >= threshold and score > best_score:
                best, best_score = leader, score
        if best is None:
            leaders.append(row)
            rows.append((row.scope, row.slug, row.slug, 1.0))
        else:
            rows.append((row.scope, row.slug, best.slug, best_score))
    return pd.DataFrame(rows, columns=["scope", "slug", "leader", "confidence"])


def _elect_large(members: DataFrame, threshold: float, batch: int) -> DataFrame:
    """Blocks too large for one task, `batch` undecided names per block and round.

    Undecided names have no similar leader so far, so the first `batch` of them decide among themselves. Their new
    leaders are then compared with all later names of the block. Only leaders are ever compared with the rest.
    """
    state = cut_lineage(members.withColumn("best", F.lit(None).cast(_BEST_DDL)).withColumn("leads", F.lit(False)))
    schema = "block bigint, slug string"

    def first_leaders(rows: pd.DataFrame) -> pd.DataFrame:
        decided = _elect_block(rows, threshold)
        chosen = decided[decided["slug"] == decided["leader"]]
        return pd.DataFrame({"block": rows["block"].iloc[0], "slug": chosen["slug"]})

    while True:
        open_names = state.where("best is null and not leads")
        head = top_per_key(open_names, ["block"], [F.col("ord")], batch, "place").drop("place", "best")
        chosen = cut_lineage(head.groupBy("block").applyInPandas(first_leaders, schema))
        if chosen.isEmpty():
            break
        leaders = state.join(chosen, ["block", "slug"], "left_semi").select(
            "block", F.col("slug").alias("l_slug"), F.col("form").alias("l_form"), F.col("ord").alias("l_ord")
        )
        # Distance bounds rule out most pairs inside the JVM before the UDF scores the rest.
        lengths = F.length("form") + F.length("l_form")
        bound = F.floor((1 - (threshold - SOUND_WEIGHT) / (1 - SOUND_WEIGHT)) * lengths + 1e-9).cast("int")
        article = F.abs(F.length("form") - F.length("l_form")) == 4
        pairs = salted_join(state.select("block", "slug", "form", "ord"), leaders, ["block"], F.col("slug")).where(
            (F.col("l_ord") < F.col("ord")) & ((F.levenshtein("form", "l_form") <= bound) | article)
        )
        found = (
            pairs.withColumn("score", fuzzy_score("form", "l_form"))
            .where(F.col("score") >= threshold)
            .groupBy("block", "slug")
            .agg(F.min(F.struct((-F.col("score")).alias("neg"), "l_ord", "l_slug")).alias("_found"))
        )
        joined = state.join(found, ["block", "slug"], "left").join(
            chosen.withColumn("_leads", F.lit(True)), ["block", "slug"], "left"
        )
        state = cut_lineage(
            joined.select(
                *[c for c in state.columns if c not in ("best", "leads")],
                F.least("best", "_found").alias("best"),
                (F.col("leads") | F.coalesce("_leads", F.lit(False))).alias("leads"),
            )
        )
    return state.select(
        "scope",
        "slug",
        F.when(F.col("leads"), F.col("slug")).otherwise(F.col("best.l_slug")).alias("leader"),
        F.when(F.col("leads"), F.lit(1.0)).otherwise(-F.col("best.neg")).alias("confidence"),
    )


def _elect_by_pairs(reps: DataFrame, threshold: float) -> DataFrame:
    """The election over the similar pairs of all names, decided in rounds.

    A name whose earlier similar names are all followers leads, one with an earlier similar leader follows. Each round
    decides every name that it can from those decided so far; there are as many rounds as the longest chain of names that
    wait for one another, not one per name. Names without a similar earlier one lead from the start and never wait.
    """
    names = cut_lineage(with_forms(reps).withColumn("id", F.struct("scope", "slug")))
    order = names.select("id", "ord")
    found = similar_pairs(names, names, threshold, F.col("l_id") != F.col("r_id")).where("score > 0")  # 0 is no match
    edges = cut_lineage(
        found.join(order.select(F.col("id").alias("l_id"), F.col("ord").alias("l_ord")), "l_id")
        .join(order.select(F.col("id").alias("r_id"), F.col("ord").alias("r_ord")), "r_id")
        .where("l_ord < r_ord").select("l_id", "l_ord", "r_id", "score"))
    waiting = edges.select(F.col("r_id").alias("id")).distinct()
    decided = cut_lineage(order.select("id").join(waiting, "id", "left_anti").withColumn("leads", F.lit(True)))
    while True:
        status = decided.select(F.col("id").alias("l_id"), F.col("leads").alias("l_leads"))
        open_edges = edges.join(decided.select(F.col("id").alias("r_id")), "r_id", "left_anti").join(status, "l_id", "left")
        seen = open_edges.groupBy(F.col("r_id").alias("id")).agg(
            F.coalesce(F.bool_or("l_leads"), F.lit(False)).alias("_led"), F.bool_or(F.col("l_leads").isNull()).alias("_waits"))
        new = cut_lineage(seen.where("_led or not _waits").select("id", (~F.col("_led")).alias("leads")))
        if new.isEmpty():
            break
        merged = cut_lineage(decided.unionByName(new))
        discard(decided, new)
        decided = merged
    leaders = decided.where("leads").select(F.col("id").alias("l_id"))
    best = edges.join(leaders, "l_id", "left_semi").join(decided.where("not leads").select(F.col("id").alias("r_id")), "r_id", "left_semi").groupBy(
        "r_id").agg(F.min(F.struct((-F.col("score")).alias("neg"), "l_ord", F.col("l_id.slug").alias("slug"))).alias("best"))
    follow = best.select("r_id.scope", "r_id.slug", F.col("best.slug").alias("leader"), (-F.col("best.neg")).alias("confidence"))
    lead = decided.where("leads").select("id.scope", "id.slug", F.col("id.slug").alias("leader"), F.lit(1.0).alias("confidence"))
    return lead.unionByName(follow)


_BEST_DDL = "struct<neg: double, l_ord: array<string>, l_slug: string>"


def representatives(mentions: DataFrame) -> DataFrame:
    """First mention of each slug within its scope; min_by combines map-side."""
    return mentions.groupBy("scope", "slug").agg(
        F.min_by("name", "ord").alias("name"), F.min("ord").alias("ord")
    )


def _aliases(mentions: DataFrame, reps: DataFrame, election: DataFrame) -> DataFrame:
    """Mentions with their leader slug, confidence and how they matched."""
    # NULL scopes must meet too. Scopes are hashes, so 0 is free to stand for NULL.
    owner = F.coalesce("scope", F.lit(0)).alias("_owner")
    firsts = reps.select(owner, "slug", F.col("ord").alias("first"))
    decided = election.select(owner, "slug", "leader", "confidence").join(firsts, ["_owner", "slug"])
    joined = salted_join(mentions.select("*", owner), decided, ["_owner", "slug"], F.col("ord")).drop("_owner")
    method = (
        F.when(F.col("leader") != F.col("slug"), "fuzzy_match")
        .when(F.col("ord") == F.col("first"), "new_canonical")
        .otherwise("exact_match")
    )
    return joined.withColumn("method", method).drop("first")


def resolve_artists(
    raw_names: DataFrame, threshold: float | None = FUZZY_THRESHOLD, overrides: DataFrame | None = None,
    block_limit: int = BLOCK_LIMIT,
) -> tuple[DataFrame, DataFrame]:
    """(artists, aliases). A raw name has one alias per credited artist, in order of `position`."""
    names, manual = with_override(raw_names, "artist_name", "artists", overrides)
    mentions = names.select(
        F.col("artist_name").alias("raw_name"),
        F.posexplode(artist_parts("artist_name", manual)).alias("position", "name"),
    ).select(
        "raw_name",
        "position",
        "name",
        entity_slug("name").alias("slug"),
        F.lit(1).cast("bigint").alias("scope"),
        F.array("raw_name", F.lpad(F.col("position").cast("string"), 9, "0")).alias("ord"),
    )
    # Cleaning a name costs dozens of regular expressions; it is done once and stored.
    mentions = cut_lineage(mentions)
    reps = cut_lineage(representatives(mentions))
    election = elect(reps, threshold, block_limit)
    aliases = cut_lineage(_aliases(mentions, reps, election))
    artist_id = F.xxhash64(F.lit("artist"), "leader")
    artists = aliases.where("method = 'new_canonical'").select(
        F.xxhash64(F.lit("artist"), "slug").alias("artist_id"), "name", "slug"
    )
    return artists, aliases.select(
        "raw_name", "position", "name", "slug", artist_id.alias("artist_id"), "confidence", "method"
    )


def first_artist(aliases: DataFrame) -> DataFrame:
    """raw artist name -> artist; a collaboration counts for its first artist."""
    return aliases.where("position = 0").select(F.col("raw_name").alias("artist_name"), "artist_id")


def _titles(names: DataFrame, artist_aliases: DataFrame, ord_columns: list[str]) -> DataFrame:
    ord_column = F.array(*ord_columns).alias("ord")
    return salted_join(names, first_artist(artist_aliases), ["artist_name"], F.array(*ord_columns), "left").select(
        *names.columns, F.col("artist_id").alias("scope"), ord_column
    )


def resolve_albums(
    raw_albums: DataFrame, artist_aliases: DataFrame, threshold: float | None = FUZZY_THRESHOLD,
    overrides: DataFrame | None = None, block_limit: int = BLOCK_LIMIT,
) -> tuple[DataFrame, DataFrame]:
    """(albums, aliases) within each artist. Albums without an artist match by slug only and may be shared."""
    names, manual = with_override(raw_albums, "album_name", "albums", overrides)
    title = canonical_album("album_name", None if manual is None else manual[0])
    named = names.select("artist_name", "album_name", title.alias("name"))
    mentions = _titles(named, artist_aliases, ["artist_name", "album_name"]).withColumn("slug", entity_slug("name"))
    mentions = cut_lineage(mentions)
    reps = cut_lineage(representatives(mentions))
    ownerless = reps.where("scope is null")
    # An artist's album whose slug was already read without an artist is that album.
    shared = ownerless.select("slug", F.col("ord").alias("_seen"))
    owned = reps.where("scope is not null").join(shared, "slug", "left")
    taken = owned.where(F.col("_seen") < F.col("ord")).select("scope", "slug")
    free = owned.where("_seen is null or not (_seen < ord)").drop("_seen")
    election = elect(free, threshold, block_limit).unionByName(elect(ownerless, None))
    aliases = _aliases(mentions.join(taken, ["scope", "slug"], "left_anti"), reps, election)
    columns = ["artist_name", "album_name", "slug", "scope", "leader", "confidence", "method"]
    borrowed = mentions.join(taken, ["scope", "slug"], "left_semi").select(
        "name", "artist_name", "album_name", "slug", "scope", F.col("slug").alias("leader"),
        F.lit(1.0).alias("confidence"), F.lit("exact_match").alias("method"), F.lit(None).cast("bigint").alias("_owner"),
    )
    every = aliases.select("name", *columns, F.col("scope").alias("_owner")).unionByName(borrowed)
    resolved = cut_lineage(every.select(
        "artist_name", "album_name", "name", "slug", F.col("scope").alias("artist_id"),
        F.xxhash64(F.lit("album"), "_owner", "leader").alias("album_id"), "confidence", "method",
    ))
    return _canonical(resolved, ["album_id"]), resolved.drop("name")


def _canonical(aliases: DataFrame, columns: list[str]) -> DataFrame:
    """The alias that created a canonical title is its row in the dimension."""
    return aliases.where("method = 'new_canonical'").select(
        *columns, F.col("name").alias("title"), "slug", "artist_id"
    )


def resolve_tracks(
    raw_tracks: DataFrame, artist_aliases: DataFrame, album_aliases: DataFrame,
    threshold: float | None = FUZZY_THRESHOLD, overrides: DataFrame | None = None, block_limit: int = BLOCK_LIMIT,
) -> tuple[DataFrame, DataFrame]:
    """(tracks, aliases) within each artist; an alias also knows the album its raw row named."""
    names, manual = with_override(raw_tracks, "track_name", "tracks", overrides)
    title = canonical_track("track_name", None if manual is None else manual[0])
    named = names.select("artist_name", "album_name", "track_name", title.alias("name"))
    order = ["artist_name", "album_name", "track_name"]
    mentions = _titles(named, artist_aliases, order).withColumn("slug", entity_slug("name"))
    mentions = cut_lineage(mentions)
    reps = cut_lineage(representatives(mentions))
    with_artist = elect(reps.where("scope is not null"), threshold, block_limit)
    election = with_artist.unionByName(elect(reps.where("scope is null"), None))
    aliases = _aliases(mentions, reps, election)
    albums = album_aliases.groupBy("album_name", F.col("artist_id").alias("scope")).agg(
        F.min_by("album_id", "artist_name").alias("album_id")
    )
    placed = salted_join(aliases, albums, ["album_name", "scope"], F.col("ord"), "left")
    resolved = cut_lineage(placed.select(
        "artist_name", "album_name", "track_name", "name", "slug", F.col("scope").alias("artist_id"),
        F.xxhash64(F.lit("track"), "scope", "leader").alias("track_id"), "album_id", "confidence", "method",
    ))
    return _canonical(resolved, ["track_id", "album_id"]), resolved.drop("name")


# --- reports on resolution ---------------------------------------------------------------


def ambiguous_matches(aliases: DataFrame) -> DataFrame:
    return aliases.where((F.col("method") == "fuzzy_match") & (F.col("confidence") < AMBIGUOUS_BELOW))


def resolution_stats(kind: str, raw_names: DataFrame, aliases: DataFrame) -> DataFrame:
    uncertain = (F.col("method") == "fuzzy_match") & (F.col("confidence") < AMBIGUOUS_BELOW)
    counted = aliases.agg(
        F.count_if(F.col("method") == "new_canonical").alias("canonical_created"),
        F.count("*").alias("aliases_created"),
        F.count_if(uncertain).alias("ambiguous_matches"),
    )
    processed = raw_names.agg(F.count("*").alias("n")).scalar()
    return counted.select(F.lit(kind).alias("kind"), processed.alias("processed"), "*")


def best_match(pairs: DataFrame, score: Column, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """Best candidate per target among pairs (target, candidate_id, candidate); lowest id on a tie."""
    return _best(pairs.withColumn("score", score).where(F.col("score") >= threshold))


def _best(scored: DataFrame) -> DataFrame:
    best = scored.groupBy("target").agg(
        F.min(F.struct((-F.col("score")).alias("neg"), "candidate_id", "candidate")).alias("best")
    )
    return best.select(
        "target", F.col("best.candidate_id").alias("candidate_id"), F.col("best.candidate").alias("candidate"),
        (-F.col("best.neg")).alias("score"),
    )


def matches(targets: DataFrame, candidates: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """(target, candidate_id, candidate, score) of all names that reach the threshold, for targets (target) and
    candidates (candidate_id, candidate); found by a join that compares only names which can reach it."""
    everywhere = F.lit(1).cast("long").alias("scope")
    left = with_forms(targets.select("target").distinct(), "target").select(everywhere, F.col("target").alias("id"), "form", "code")
    right = with_forms(candidates.select("candidate_id", "candidate").distinct(), "candidate").select(
        everywhere, F.struct("candidate_id", "candidate").alias("id"), "form", "code")
    return similar_pairs(left, right, threshold).select(
        F.col("l_id").alias("target"), F.col("r_id.candidate_id").alias("candidate_id"), F.col("r_id.candidate").alias("candidate"), "score")


def best_matches(targets: DataFrame, candidates: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """The best of the `matches` of each target, lowest id on a tie; targets with none above 0 are left out."""
    return _best(matches(targets, candidates, threshold).where("score > 0"))


# --- linking plays -----------------------------------------------------------------------


def track_choice(track_aliases: DataFrame) -> DataFrame:
    """One alias per (raw title, artist): with an album if there is one, then the first read."""
    order = F.struct(F.col("album_id").isNull().cast("int").alias("no_album"), "artist_name", "album_name")
    return track_aliases.where("artist_id is not null").groupBy("track_name", "artist_id").agg(
        F.min_by(F.struct("track_id", "album_id"), order).alias("_choice")
    )


def link_plays(
    raw: DataFrame, artist_aliases: DataFrame, track_aliases: DataFrame, existing: DataFrame | None = None
) -> DataFrame:
    """Raw plays (source, record_id, names, ...) with artist, album and track; plays without a track are left out.

    Plays already linked, by (source, record_id), are not linked again.
    """
    rows = raw.where("track_name is not null and artist_name is not null")
    if existing is not None:
        rows = rows.join(existing.select("source", "record_id"), ["source", "record_id"], "left_anti")
    known = salted_join(rows, first_artist(artist_aliases), ["artist_name"], F.col("record_id"))
    linked = salted_join(known, track_choice(track_aliases), ["track_name", "artist_id"], F.col("record_id"))
    return linked.select(
        *[F.col(c) for c in raw.columns if c not in ("artist_name", "album_name", "track_name")],
        "artist_id",
        F.col("_choice.album_id").alias("album_id"),
        F.col("_choice.track_id").alias("track_id"),
    )


def backfill_location(plays: DataFrame, raw: DataFrame) -> DataFrame:
    """Fill a missing country from the raw row the play came from."""
    places = raw.select("source", "record_id", F.col("country").alias("_country"))
    return (
        plays.join(places, ["source", "record_id"], "left")
        .withColumn("country", F.coalesce("country", "_country"))
        .drop("_country")
    )
