import random

import pytest
from pyspark.sql import functions as F

from tracklore.functions.similarity import fuzzy_similarity
from tracklore.operators import resolve as r
from tracklore.operators.similar_names import similar_pairs, with_forms

RAW = "source string, record_id bigint, artist_name string, album_name string, track_name string, country string"


def plain_election(names, threshold):
    """Names in sorted order against every earlier leader, whatever it sounds like."""
    leaders, out = [], {}
    for name in sorted(names):
        best, score = None, 0.0
        for leader in leaders:
            s = fuzzy_similarity(name, leader)
            if s >= threshold and s > score:
                best, score = leader, s
        if best is None:
            leaders.append(name)
        out[name] = (best or name, score if best else 1.0)
    return out


def misspelled(seed, n):
    rng = random.Random(seed)
    bases = ["radiohead", "the national", "nirvana", "portishead", "massive attack", "boards of canada", "1975", "knife"]
    out = {"the 1975", "1975", "the knife", "why", "the why", "東京", "the the", "the"}
    for _ in range(n):
        name = rng.choice(bases)
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(len(name))
            name = rng.choice([name[:at] + name[at:][1:], name[:at] + name[at] + name[at:], name[:at] + rng.choice("aehy") + name[at:]])
        out.add(("the " if rng.random() < 0.2 and not name.startswith("the ") else "") + name.strip())
    return sorted({x for x in out if x})


@pytest.mark.parametrize(("threshold", "limit"), [(0.85, 1_000), (0.85, 4), (0.9, 2), (0.81, 7)])
def test_election_equals_plain_loop(spark, threshold, limit):
    names = misspelled(int(threshold * 100) + limit, 150)
    rows = [(1, name, name, [name]) for name in names]
    reps = spark.createDataFrame(rows, "scope bigint, slug string, name string, ord array<string>")
    got = {x["slug"]: (x["leader"], x["confidence"]) for x in r.elect(reps, threshold, limit).collect()}
    expected = plain_election(names, threshold)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in expected.items()}
    assert all(abs(got[k][1] - expected[k][1]) < 1e-12 for k in expected)


def test_scopes_do_not_mix(spark):
    rows = [(s, "abd", "abd", [str(s)]) for s in (1, 2)] + [(2, "abdd", "abdd", ["3"])]
    reps = spark.createDataFrame(rows, "scope bigint, slug string, name string, ord array<string>")
    got = {(x["scope"], x["slug"]): x["leader"] for x in r.elect(reps).collect()}
    assert got == {(1, "abd"): "abd", (2, "abd"): "abd", (2, "abdd"): "abd"}


@pytest.mark.parametrize("threshold", [0.8, 0.72, 0.6, 0.4, 0.0])
def test_low_thresholds_equal_plain_loop(spark, threshold):
    names = misspelled(int(threshold * 100), 70) + ["x", "xy"]
    rows = [(s, name, name, [name]) for s in (1, 2) for name in names[s:]]
    reps = spark.createDataFrame(rows, "scope bigint, slug string, name string, ord array<string>")
    got = {(x["scope"], x["slug"]): (x["leader"], round(x["confidence"], 12)) for x in r.elect(reps, threshold).collect()}
    assert got == {
        (s, name): (leader, round(score, 12)) for s in (1, 2) for name, (leader, score) in plain_election(names[s:], threshold).items()
    }


@pytest.mark.parametrize("threshold", [0.0, 0.35, 0.55, 0.75, 0.8, 0.85, 0.9, 1.0])
def test_similar_pairs_equal_all_pairs(spark, threshold):
    names = misspelled(7, 60) + ["a", "ab", "the a", "national the", "x y z", "zx y", "boards of canadaa boards of canada"]
    df = with_forms(spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "scope long, id long, name string"))
    got = {(x.l_id, x.r_id): x.score for x in similar_pairs(df.where("id % 3 > 0"), df, threshold).collect()}
    scores = {(i, j): fuzzy_similarity(a, b) for i, a in enumerate(names) if i % 3 for j, b in enumerate(names)}
    assert got == {pair: score for pair, score in scores.items() if score >= threshold}


def test_thresholds_beyond_0_to_1(spark):
    df = with_forms(spark.createDataFrame([(1, 1, "a")], "scope long, id long, name string"))
    for threshold in (-0.1, 1.1):
        with pytest.raises(ValueError):
            similar_pairs(df, df, threshold)


def test_best_matches_see_every_name(spark):
    names = misspelled(11, 40)
    df = spark.createDataFrame(list(enumerate(names)), "candidate_id long, candidate string")
    got = {x.target: (x.candidate_id, x.score) for x in r.best_matches(df.select(F.col("candidate").alias("target")), df, 0.5).collect()}
    assert got == {n: (i, 1.0) for i, n in enumerate(names)}
    got = {x.target: x.candidate_id for x in r.best_matches(spark.createDataFrame([("radioheat",)], "target string"), df, 0.5).collect()}
    assert got["radioheat"] == max(range(len(names)), key=lambda i: (fuzzy_similarity("radioheat", names[i]), -i))


def raw(spark, *rows):
    return spark.createDataFrame([("spotify", i, *row, "GB") for i, row in enumerate(rows)], RAW)


def resolved(spark, plays, threshold=0.85):
    artists, aa = r.resolve_artists(r.distinct_raw_artists(plays), threshold)
    albums, ba = r.resolve_albums(r.distinct_raw_albums(plays), aa, threshold)
    tracks, ta = r.resolve_tracks(r.distinct_raw_tracks(plays), aa, ba, threshold)
    return artists, aa, albums, ba, tracks, ta


def test_names_to_entities_to_plays(spark):
    plays = raw(
        spark,
        ("Radiohead", "OK Computer", "Airbag"),
        ("RADIOHEAD", "OK Computer (Deluxe Edition)", "Airbag - 2011 Remaster"),
        ("Radiohedd", "OK Computer", "Airbag (Radio Edit)"),
        ("Radiohead & Björk", None, "Airbag"),
        ("  ", "OK Computer", "Airbag"),
        ("Portishead", None, "Roads"),
        (None, "x", "y"),
    )
    artists, aa, albums, _ba, tracks, ta = resolved(spark, plays)
    names = {x["artist_id"]: x["name"] for x in artists.collect()}
    assert sorted(names.values()) == ["Björk", "Portishead", "Radiohead"]
    aliases = {(x["raw_name"], x["position"]): (names[x["artist_id"]], x["method"]) for x in aa.collect()}
    assert aliases[("RADIOHEAD", 0)] == ("Radiohead", "new_canonical")  # capitals sort first
    assert aliases[("Radiohead", 0)] == ("Radiohead", "exact_match")
    assert aliases[("Radiohedd", 0)] == ("Radiohead", "fuzzy_match")
    assert aliases[("Radiohead & Björk", 1)][0] == "Björk" and ("  ", 0) not in aliases
    assert sorted((x["title"], names.get(x["artist_id"])) for x in albums.collect()) == [("OK Computer", None)]
    titles = sorted((x["title"], names.get(x["artist_id"])) for x in tracks.collect() if x["artist_id"] is not None)
    assert titles == [("Airbag", "Radiohead"), ("Roads", "Portishead")]
    linked = {x["record_id"]: x for x in r.link_plays(plays, aa, ta).collect()}
    assert sorted(linked) == [0, 1, 2, 3, 5]
    assert len({linked[i]["track_id"] for i in (0, 1, 2, 3)}) == 1
    assert linked[3]["album_id"] == linked[0]["album_id"] is not None, "an alias with an album is preferred"
    assert r.link_plays(plays, aa, ta, r.link_plays(plays, aa, ta)).count() == 0


def test_ambiguous_and_stats(spark):
    plays = raw(spark, ("Portishead", "Dummy", "Roads"), ("Portisheadd", "Dummy", "Roadss"), ("Portished", None, "Roads"))
    _a, aa, *_rest = resolved(spark, plays)
    found = {x["raw_name"] for x in r.ambiguous_matches(aa).collect()}
    by_score = {x["raw_name"]: x["confidence"] for x in aa.collect()}
    assert found == {n for n, c in by_score.items() if c < 0.95}
    stats = r.resolution_stats("artists", r.distinct_raw_artists(plays), aa).first()
    assert (stats["processed"], stats["canonical_created"], stats["aliases_created"]) == (3, 1, 3)


def test_overrides(spark):
    plays = raw(spark, ("Simon & Garfunkel", "Bookends", "America"))
    overrides = spark.createDataFrame(
        [("artists", "Simon & Garfunkel", ["Simon & Garfunkel"]), ("albums", "Bookends", ["The Book"])],
        "kind string, raw string, replacement array<string>",
    )
    artists, aa = r.resolve_artists(r.distinct_raw_artists(plays), overrides=overrides)
    assert [x["name"] for x in artists.collect()] == ["Simon & Garfunkel"]
    albums, _ba = r.resolve_albums(r.distinct_raw_albums(plays), aa, overrides=overrides)
    assert [x["title"] for x in albums.collect()] == ["The Book"]


def test_best_match(spark):
    ddl = "target string, candidate_id bigint, candidate string"
    pairs = spark.createDataFrame([("Radio Head", 1, "Radiohead"), ("Radio Head", 2, "Nirvana"), ("Xyz", 1, "Radiohead")], ddl)
    from tracklore.functions.similarity import fuzzy_score

    best = r.best_match(pairs, fuzzy_score("target", "candidate"), 0.75).collect()
    assert [(x["target"], x["candidate_id"]) for x in best] == [("Radio Head", 1)]


def test_backfill(spark):
    plays = spark.createDataFrame([("spotify", 0, None), ("spotify", 1, "US")], "source string, record_id bigint, country string")
    filled = r.backfill_location(plays, raw(spark, ("a", "b", "c"), ("a", "b", "c")).select("source", "record_id", "country"))
    assert sorted(x["country"] for x in filled.select(F.col("country")).collect()) == ["GB", "US"]
