"""Training-data operators on small tables: brute force, SQL, and the odd rows every operator has to take."""

import glob
import hashlib
import os
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check_oracle import compare
from tracklore.llm import (
    chains, components, decontamination, html_cut, mixing, ngram_join, queries, shards, suffix_dedup, suffix_sort, topk,
    toxicity, url_rules,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `_id` string, shard string, score string"
WORDS = [f"w{i}" for i in range(400)]


def text(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


BASE = text(1, 120)
ROWS = [
    (1, BASE, "a"), (2, BASE, "a"), (3, BASE.replace("w1 ", "w2 ", 1), "b"), (4, None, None), (5, "", "b"), (6, "   ", "b"),
    (7, "one two", "a"), (8, "ONE two", None), (9, text(2, 5000), "a"), (10, text(3, 70) + " " + BASE, "c"),
    (10, text(3, 70) + " " + BASE, "c"), (None, BASE, "c"), (11, text(4, 60), "c"), (12, "é" * 80 + " x", "a"),
    (13, "aaaa" * 40, "a"), (14, "aaaa" * 40 + "b", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", s, len(t or ""), "extra", "extra", "extra") for i, t, s in ROWS]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def con(sf):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_sql(spark, con, sf, name):
    df = queries.QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    cursor = con.execute(queries.ORACLES[name])
    assert compare(rows, df.columns, cursor.fetchall(), [c[0] for c in cursor.description]) is None


# 1


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    scored = queries.QUERIES["op1_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    rows = scored.where("held_out").select("toxic", "predicted").collect()
    toxic = [r.predicted for r in rows if r.toxic == 1]
    assert np.mean([r.toxic == r.predicted for r in rows]) > 0.95 and np.mean(toxic) > 0.7


def test_factorization_machine_learns_pairs():
    # Toxic only if both terms meet, which no additive model separates from the two alone and neither.
    sets = [[0], [1], [0, 1], [], [0, 2], [1, 2], [0, 1, 2], [2]] * 20
    labels = np.array([float({0, 1} <= set(s)) for s in sets])
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    terms = np.array([t for s in sets for t in s])
    model = toxicity.FactorizationMachine(3)
    model.fit(rows, terms, labels, epochs=300)
    assert ((model.margins(rows, terms, len(sets))[0] > 0) == (labels == 1)).all()


def test_toxicity_learns_pairs_of_harmless_words(spark):
    # Toxic if exactly one of two words is there: neither word alone tells anything.
    draw = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(3000):
        words = draw.choice(WORDS, 20).tolist()
        here = draw.random(2) < 0.5
        for word, there in zip(("alpha", "beta"), here):
            if there:
                words.insert(int(draw.integers(len(words))), word)
        rows.append((i, " ".join(words)))
        labels.append((i, int(here[0] != here[1])))
    table, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    scored = toxicity.score_toxicity(table, toxicity.fit_toxicity(table, marks)).join(
        marks, F.col("doc.doc_id") == marks["doc_id"]).where(toxicity.held_out(marks["doc_id"])).select("score", "toxic").collect()
    assert np.mean([(r.score >= 0.5) == (r.toxic == 1) for r in scored]) > 0.9


def test_toxicity_odd_rows(spark, docs):
    for label in ([(1, 0)], []):
        labels = spark.createDataFrame(label, "doc_id long, toxic int")
        rows = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()
        assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == 0 for r in rows)


# 2


def test_chains_take_ordered_seeds():
    assert chains.chain_seeds([0, 5, 10, 15, 20], [100, 105, 3, 115, 120])[0] == [0, 1, 3, 4]


def test_alignment_counts_equal_words():
    a, b = np.arange(60), np.concatenate([np.arange(30), [99], np.arange(31, 60)])
    assert chains.align([0, 40], [0, 40], a, b, 0, 0) == (0, 60, 0, 60, 59)


def test_fuzzy_passages(spark, docs):
    rows = chains.shared_passages(docs).collect()
    found = {(r.doc_id, r.other_id): r for r in rows}
    assert set(found) == {(2, 1), (3, 1), (10, 1)}
    assert (found[10, 1].start, found[10, 1].stop, found[10, 1].other_start) == (70, 190, 0) and found[2, 1].share == 1.0
    assert chains.shared_passages(docs.limit(0)).count() == 0


def test_passages_in_long_chains_and_with_edited_ends(spark):
    def own(name, n):
        return [f"{name}{k}" for k in range(n)]

    def edited(words, places):
        return [f"{w}x" if k in places else w for k, w in enumerate(words)]

    shared = {k: own(f"s{k}v", n) for k, n in enumerate((60, 60, 900, 53, 53))}
    rows = [
        (1, own("a", 80) + shared[0] + own("b", 100) + shared[1] + own("c", 80)),
        (2, own("d", 80) + shared[0] + own("e", 100) + shared[1] + own("f", 80)),
        (3, shared[2]), (4, edited(shared[2], range(300, 600, 4))),
        (5, own("g", 80) + shared[3] + own("h", 80)), (6, own("i", 80) + edited(shared[3], {49}) + own("j", 80)),
        (7, own("k", 80) + shared[4] + own("l", 80)), (8, own("m", 80) + edited(shared[4], {3}) + own("n", 80)),
    ]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = sorted((r.other_id, r.doc_id, r.start, r.stop, r.other_start, r.other_stop, r.equal_words)
                 for r in chains.shared_passages(docs).collect())
    assert got == [(1, 2, 80, 140, 80, 140, 60), (1, 2, 240, 300, 240, 300, 60), (3, 4, 0, 900, 0, 900, 825),
                   (5, 6, 80, 133, 80, 133, 52), (7, 8, 80, 133, 80, 133, 52)]


def test_passages_whose_seeds_have_different_first_documents(spark):
    def own(name, n):
        return [f"{name}{k}" for k in range(n)]

    def linked(rows, **options):
        docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
        return {(r.other_id, r.doc_id) for r in chains.shared_passages(docs, **options).collect()}

    shared = own("s", 60)
    rows = [(1, own("a", 40) + shared[:30]), (2, shared[30:] + own("b", 40)), (3, own("c", 9) + shared + own("d", 30)),
            (4, own("e", 50) + shared + own("f", 9)), (5, own("g", 7) + shared + own("h", 5)), (6, own("e", 50) + shared + own("f", 9))]
    assert linked(rows) == linked(rows, crowd=None) == {(3, 4), (3, 5), (4, 5), (4, 6)}
    # With all seeds crowded the whole passages still hang together, and nothing else does.
    crowded = linked(rows, crowd=1)
    assert {(4, 6)} <= crowded <= {(3, 4), (3, 5), (4, 5), (4, 6)} and len(crowded) >= 3


def test_seeds_of_a_pair_count_whether_crowded_or_not(spark):
    words = [f"s{k}" for k in range(70)]
    rows = [(i, [f"d{i}v{k}" for k in range(30)] + words[:20]) for i in range(1, 9)] + [
        (i, [f"d{i}v{k}" for k in range(30)] + words) for i in (20, 21)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = [(r.other_id, r.doc_id, r.start, r.stop, r.equal_words) for r in chains.shared_passages(docs, crowd=4).collect()]
    assert got == [(20, 21, 30, 100, 70)]


def test_crowded_seeds_lose_no_pair(spark):
    """texts that share crowded seeds only are all compared, edited ones among themselves too."""
    draw, rows = np.random.default_rng(5), []
    for i in range(40):
        words = [f"s{i % 2}v{k}" + ("x" if draw.random() < 0.1 else "") for k in range(70)]
        rows.append((i, [f"d{i}v{k}" for k in range(int(draw.integers(0, 50)))] + words + [f"e{i}v{k}" for k in range(int(draw.integers(0, 50)))]))
    rows += [(100 + i, [f"f{i}v{k}" for k in range(60)] + [f"s0v{k}" for k in range(5)] + [f"g{i}v{k}" for k in range(60)]) for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = [sorted(map(tuple, chains.shared_passages(docs, crowd=crowd).collect())) for crowd in (None, 64, 5, 1)]
    assert len(got[0]) > 100 and got[1:] == [got[0]] * 3


def test_longest_runs_equal_brute_force():
    draw = np.random.default_rng(11)
    for _round in range(60):
        i, j = (np.cumsum(draw.choice([1, 1, 1, 1, 2, 5], 90)) for _side in "ab")
        best = max(min(i[l] - i[k], j[l] - j[k]) + 1 for k in range(90) for l in range(k, 90)
                   if 10 * (l - k + 1) >= 8 * (max(i[l] - i[k], j[l] - j[k]) + 1))
        assert chains._longest(i, j)[0] == best
        a, b = draw.integers(0, 6, 40), draw.integers(0, 6, 55)
        x, y = chains._pairs(a, b)
        assert (a[x] == b[y]).all() and len(x) == chains._last_row(a, b)[-1] == sum(r[2] for r in chains.equal_runs(a, b))


# 3


def test_suffix_array_and_prefixes():
    draw = np.random.default_rng(5)
    for round_ in range(60):
        t = np.append(np.tile(draw.integers(1, 4, draw.integers(1, 9)), draw.integers(1, 20)), 0)
        expected = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        for sparse in (1, 32):
            assert suffix_sort.suffix_array(t, sparse).tolist() == expected
        shared = suffix_sort.permuted_common_prefixes(t, np.array(expected), 7)
        for i, j in zip(expected[1:], expected):
            same = next((k for k in range(7) if i + k >= len(t) or j + k >= len(t) or t[i + k] != t[j + k]), 7)
            assert shared[i] == same


def removed(rows, length):
    owner = {}
    for i, raw in rows:
        for k in range(len(raw) - length + 1):
            owner.setdefault(raw[k : k + length], i)
    for i, raw in rows:
        mask = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if owner[raw[k : k + length]] < i:
                mask[k : k + length] = b"\1" * length
        left = bytes(x for x, m in zip(raw, mask) if not m)
        runs = sum(1 for k in range(len(mask)) if mask[k] and (k == 0 or not mask[k - 1]))
        yield i, (len(raw), sum(mask), runs, hashlib.sha256(left).hexdigest())


def test_repeats_beside_runs_of_equal_bytes(spark):
    # The strings of 50 bytes that end in 16 equal ones, against documents with more of these.
    draw, rows = np.random.default_rng(21), []
    for k in range(40):
        prose, fill = "".join(draw.choice(list("abcdefghij klmnop"), 34)), "-.=*"[k % 4]
        for more in draw.permutation([0, 1 + k % 8, 40]).tolist():
            rows.append((len(rows), (f"{len(rows)}<" + prose + fill * (16 + more) + f">{len(rows)}").encode()))
    docs = spark.createDataFrame([(i, raw.decode()) for i, raw in rows], "doc_id long, text string")
    got = sorted((r.doc.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == list(removed(rows, 50))


def test_repeats_equal_brute_force(docs):
    rows = sorted((i, (t or "").encode()) for i, t, _s in ROWS if i is not None)
    got = sorted((r.doc.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
                 for r in suffix_dedup.remove_repeats(docs).collect() if r.doc.doc_id is not None)
    assert got == sorted(removed(rows, 50))
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


# 4


def test_top_k_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (100, [1.0, 2.0, 3.0]), (1, [1.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]),
            (5, [float("inf")]), (6, []), (7, [1.0]), (7, [1.0]), (None, [1.0]), (8, [1e30, 1.0])]
    vectors = topk.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [tuple(r) for r in topk.exact_top_k(vectors.where("vec_id % 100 = 0"), vectors, k=4, query_block=1).collect()]
    one = 1024 * 1024
    assert sorted(got) == [
        (0, 1, 8, 2**63 - 1), (0, 2, 100, 5 * one), (0, 3, 1, one), (0, 4, 7, one),
        (100, 1, 8, 2**63 - 1), (100, 2, 0, 5 * one), (100, 3, 1, one), (100, 4, 7, one)]
    assert topk.exact_top_k(vectors.limit(0), vectors).count() == 0


# 5


PAGE = """<html><head><title>T</title><script>var t="</p>";</script></head><body><header><h1>Site</h1><nav><a href=/>Home</a>
</nav></header><div class="cookie-notice"><p>We use cookies to improve your stay on this very long site, please accept.</p></div>
<main><article><h1>Headline</h1><p>First para &amp; more text that goes on
and on.<p>Hi.</p><div class="ad">Buy the best product ever made by men, now.</div><form><label>Name</label><button>Send</button></form>
<p>Second&nbsp;para of some length goes here.</p></article><section id="comments"><div class="comment"><p>I really liked this article
because it was so very long.</p></div></section></main><footer>&copy; x</footer></body></html>"""


def test_main_text():
    assert html_cut.main_text(PAGE) == "Headline First para & more text that goes on and on. Hi. Second para of some length goes here."
    assert html_cut.main_text(None) == html_cut.main_text("") == html_cut.main_text("<p>") == ""
    assert html_cut.main_text("<div><p>" + "lorem ipsum " * 500 + '<b x="' * 200)


@pytest.mark.parametrize("odd", [
    '<svg viewBox="0 0 1 1"/>', "<math/>", "<title-bar></title-bar>", "<select-menu>", "<object-viewer>", '<object data="x">', "<svg><path>",
    "<SVG class='a'><text>drop</text></SVG >", "<select><option>drop</select>",
])
def test_main_text_goes_on_behind_odd_elements(odd):
    para = "Some long sentence of the article that goes on and on for a while, as sentences do."
    page = f'<body><div class="content"><p>{para}</p>{odd}<p>{para}</p></div></body>'
    assert html_cut.main_text(page) == f"{para} {para}"


@pytest.mark.parametrize("name,kept", [("content has-sidebar", True), ("entry no-comments", True), ("content sidebar", False)])
def test_names_of_what_is_beside_an_element(name, kept):
    para = "Some long sentence of the article that goes on and on for a while, as sentences do."
    assert html_cut.main_text(f'<body><div class="{name}"><p>{para}</p></div></body>') == (para if kept else "")


def test_minimum_cut_equals_brute_force():
    draw = np.random.default_rng(2)
    for _round in range(30):
        n, cost = 6, draw.normal(0, 2, 6)
        ties = [(i, j, float(draw.random())) for i in range(n) for j in range(i)]
        network = html_cut.FlowNetwork()
        nodes = [network.node() for _ in range(n)]
        for node, c in zip(nodes, cost):
            network.tie(0, node, max(c, 0), 0) if c > 0 else network.tie(node, 1, -c, 0)
        for i, j, w in ties:
            network.tie(nodes[i], nodes[j], w, w)

        def total(labels):
            return sum(max(c, 0) if not x else max(-c, 0) for c, x in zip(cost, labels)) + sum(w for i, j, w in ties if labels[i] != labels[j])

        side = network.source_side()
        best = min(total([bool(m >> k & 1) for k in range(n)]) for m in range(2**n))
        assert total([side[x] for x in nodes]) == pytest.approx(best)


@pytest.mark.parametrize(
    ("name", "kept"),
    [("post category-legal", True), ("post tag-privacy", True), ("post type-post category-social", True),
     ("entry story-promoted", True), ("comment-body", False), ("post-comments", False), ("promo", False)],
)
def test_names_of_an_article(name, kept):
    para = "This is a long paragraph, with many words in it, that goes on for a while and says something."
    page = f'<body><article class="{name}"><h2>Head line</h2>' + f"<p>{para}</p>" * 5 + "</article></body>"
    assert html_cut.main_text(page) == ("Head line " + " ".join([para] * 5) if kept else "")


def test_bad_nesting_takes_no_walks():
    start = time.time()
    for page in ("<div>" * 20000 + "</b>" * 20000 + "x", "<b>" * 20000 + "</section>" * 20000 + "x", "<b>" * 20000 + "<p>z" * 5000):
        html_cut.main_text(page)
    assert time.time() - start < 10


def test_shards_do_not_hang_on_the_partitions(spark):
    docs = spark.range(1000).selectExpr("id as doc_id", "repeat('x', cast(id % 50 as int)) as text")
    seen = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("8", "37"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            given = docs.repartition(int(partitions))
            out = shards.shuffle_into_shards(given, [F.col("doc_id")], shards.text_size(F.col("text")), bucket_bytes=200)
            seen.append(sorted((r.doc.doc_id, r.shard, r.slot) for r in out.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] and len(seen[0]) == 1000
    assert sorted(g for _d, shard, slot in seen[0] for g in [slot * 8 + shard]) == list(range(1000))


def test_pages_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (1, "u", PAGE, "x"), (None, "u", "", "y")], "page_id long, url string, html string, text string")
    rows = html_cut.extract_main_text(pages).collect()
    assert sorted(r.n_chars for r in rows) == [0, 0, len(html_cut.main_text(PAGE))]
    assert html_cut.extract_main_text(pages.limit(0)).count() == 0


# 6


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.example.ORG/es/1", "https://example.org/en/123?x=/es/", "http://example.org?/es/", "http://org/",
            "ftp://x.com/fr/a#b", "http://free-bets.net/de/", "http://x.com", "http://notexample.org/es/", "http://org/"]
    table = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = [url_rules.address_rule(*r) for r in url_rules.ADDRESS_RULES] + [url_rules.host_word_rule("bets")]
    rules = url_rules.rule_table(spark, rules)
    got = [tuple(r)[1:5] for r in url_rules.judge_urls(table, rules).orderBy("page_id").collect()]
    assert got == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.org", "/es/1", "example.org/es/", "block"),
        ("example.org", "/en/123", "example.org/en/1", "block"), ("example.org", "", None, "allow"), ("org", "/", "org/", "allow"),
        ("x.com", "/fr/a", "com/fr/", "allow"), ("free-bets.net", "/de/", None, "block"), ("x.com", "", None, "allow"),
        ("notexample.org", "/es/", "org/", "allow"), ("org", "/", "org/", "allow")]
    assert url_rules.judge_urls(table.limit(0), rules).count() == 0


# 7


@pytest.mark.parametrize("bucket_bytes", [300, 1 << 24])
def test_shards(docs, bucket_bytes):
    key = [F.col("doc_id"), F.xxhash64("text")]
    run = lambda: shards.shuffle_into_shards(docs, key, shards.text_size(F.col("text")), 4, bucket_bytes=bucket_bytes).collect()
    rows = run()
    assert sorted(str(r.doc.doc_id) for r in rows) == sorted(str(i) for i, _t, _s in ROWS)
    by_shard = [sorted(r.slot for r in rows if r.shard == s) for s in range(4)]
    assert all(slots == list(range(len(slots))) for slots in by_shard) and max(map(len, by_shard)) - min(map(len, by_shard)) <= 1
    assert sorted(map(str, rows)) == sorted(map(str, run()))
    assert shards.shuffle_into_shards(docs.limit(0), key, F.lit(1)).count() == 0


# 8


def shingle_set(value, words):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (value or "").encode().lower())
    return frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()


@pytest.mark.parametrize("crowd", [1, 64])
def test_components_equal_brute_force(spark, docs, monkeypatch, crowd):
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    monkeypatch.setattr(ngram_join, "FREQUENT", 3)
    draw = np.random.default_rng(9)
    rows = [(i, t) for i, t, _s in ROWS if i is not None]
    for i in range(20, 70):
        words = BASE.split()
        for _edit in range(draw.integers(0, 6)):
            words[draw.integers(len(words))] = f"x{draw.integers(30)}"
        rows.append((i, " ".join(words)))
    sets = [(i, shingle_set(t, 4)) for i, t in rows]
    label = {i: i for i, _s in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets:
            for j, b in sets:
                if a and b and label[i] < label[j] and 100 * len(a & b) >= 85 * len(a | b):
                    label[j], changed = label[i], True
    got = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((i, len(s), label[i]) for i, s in sets)


def test_longer_copies_just_above_the_threshold_are_linked(spark):
    # 20 of 23 shingles; where one of the 3 others is among the first of the longer set, a first one of the shorter set is not.
    base = [[f"v{i}x{k}" for k in range(26)] for i in range(40)]
    rows = [(2 * i + side, " ".join(words[: 23 + 3 * side])) for i, words in enumerate(base) for side in (0, 1)]
    got = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i // 2 * 2 for i, _t in rows}


def test_one_document_of_each_group_stays(docs):
    kept = ngram_join.keep_one_per_group(docs, words=5, percent=80)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14]
    assert kept.columns == docs.columns and ngram_join.keep_one_per_group(docs.limit(0)).count() == 0


def test_connected(spark):
    edges = [(i, i + 1) for i in range(20)] + [(30, 31), (31, 30), (40, 40)]
    got = {r.node: r.label for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 31: 30}


def test_connected_over_many_tasks(spark):
    draw = np.random.default_rng(2)
    edges = [(int(i), int(j)) for i, j in draw.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in draw.permutation(200).tolist()]
    label = {i: i for edge in edges if edge[0] != edge[1] for i in edge}
    for _again in range(len(label)):
        for i, j in edges:
            if i != j:
                label[i] = label[j] = min(label[i], label[j])
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        rows = components.connected(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    finally:
        for key, value in keep.items():
            spark.conf.set(key, value)
    assert sorted((r.node, r.label) for r in rows) == sorted(label.items())


# 9


def test_mix(docs):
    rows = mixing.mix_sources(docs, mixing.word_count(F.col("text"))).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.copies <= 2 for r in rows)
    totals = {}
    for r in rows:
        totals.setdefault(r.doc.source, [r.source_size, r.target, 0, 0])
        totals[r.doc.source][2] += r.copies * r.size
        totals[r.doc.source][3] = max(totals[r.doc.source][3], r.size)
    assert all(abs(taken - target) <= 2 * most and target <= 2 * size for size, target, taken, most in totals.values())
    assert sum(t[1] for t in totals.values()) == pytest.approx(1.5 * sum(t[0] for t in totals.values()))
    drawn = mixing.emit_copies(mixing.mix_sources(docs, mixing.word_count(F.col("text"))))
    assert drawn.count() == sum(r.copies for r in rows) and drawn.columns == docs.columns
    assert mixing.mix_sources(docs.limit(0), F.lit(1)).count() == 0


# 10


def hits(value, items, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, marked, found, windows = words(value), set(), set(), {}
    for name, item in items:
        v = words(item)
        size = min(len(v), window)
        for k in range(len(v) - size + 1 if v else 0):
            windows.setdefault(tuple(v[k : k + size]), set()).add(str(name))
    for size in {len(x) for x in windows}:
        for p in range(len(w) - size + 1):
            if names := windows.get(tuple(w[p : p + size])):
                marked |= set(range(p, p + size))
                found |= names
    return len(w), len(marked), sorted(found)


@pytest.mark.parametrize("block_words", [10, 200_000])
def test_benchmark_hits_equal_brute_force(spark, docs, block_words):
    items = [(1, BASE), (2, "One, TWO"), (3, " ".join(BASE.split()[40:55])), (4, None), (5, "..."), (6, "two"), (7, text(3, 20))]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.judged(decontamination.benchmark_hits(docs, table, block_words=block_words)).collect()
    expected = [(i, *hits(t, items)) for i, t, _s in ROWS]
    key = lambda r: (str(r[0]), r[1:])
    assert sorted([(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got], key=key) == sorted(expected, key=key)
    left = decontamination.drop_contaminated(docs, table, block_words=block_words)
    assert left.count() == sum(1 for _i, n, h, _f in expected if not (h and 20 * h >= n)) and left.columns == docs.columns
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.drop_contaminated(docs, nothing).count() == len(ROWS)
    assert decontamination.without_spans("a b  c d", [{"start": 1, "stop": 3}]) == "a  d"


# pipeline


def test_pipeline_equals_its_parts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = corpus_pipeline.run(spark, sf).collect()
    kept = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    texts = sorted((r.doc.doc_id, r.doc.text, r.doc.source) for r in kept.where("predicted = 0").collect())
    sets = {i: shingle_set(t, 5) for i, t, _s in texts}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets.items():
            for j, b in sets.items():
                if label[i] < label[j] and a and b and 100 * len(a & b) >= 80 * len(a | b):
                    label[j], changed = label[i], True
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    left = []
    for i, t, s in texts:
        n, h, _found = hits(t, items) if label[i] == i else (0, 1, [])
        if label[i] == i and not (h and 20 * h >= n):
            left.append((i, t, s))
    mixed = mixing.mix_sources(docs.where(F.col("doc_id").isin([i for i, _t, _s in left])), mixing.word_count(F.col("text"))).collect()
    copies = {r.doc.doc_id: r.copies for r in mixed if r.copies}
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == copies
    counts = [sorted(r.slot for r in rows if r.shard == s) for s in range(8)]
    assert all(slots == list(range(len(slots))) for slots in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1


def test_shards_query_moves_whole_documents(spark, tmp_path, monkeypatch):
    """the operator gets texts and their sizes; the digest is made of what it returns."""
    rows = [(1, "aé", "en", "s", 2), (2, None, "en", None, 0), (2, None, "en", None, 0), (3, "x" * 5000, "en", "s", 5000), (None, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    real, seen = shards.shuffle_into_shards, []

    def shuffle(docs, key, size, *rest):
        seen.append((docs.columns, sorted(r[0] for r in docs.select(size).collect())))
        return real(docs, key, size, *rest)

    monkeypatch.setattr(shards, "shuffle_into_shards", shuffle)
    got = queries.QUERIES["op7_shards"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    sums = sorted((str(r.doc_id), r.size, r.text_crc32) for r in got.collect())
    assert sums == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert seen == [(["doc_id", "text", "lang", "source", "n_chars"], [1, 1, 1, 4, 5001])]
