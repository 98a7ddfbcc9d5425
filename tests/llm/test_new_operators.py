"""Runs, fingerprints and token alignment against plain versions on small tables with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklore.llm import imatch, periodic_runs, queries, token_spans

DOCS = "doc_id long, text string, lang string, source string, _id string, block string, runs string, term string"
rng = random.Random(5)


def prose(n, words=300):
    return " ".join(f"{rng.choice('abcdefgh')}w{rng.randrange(words)}{rng.choice(['', '', '.', ',', '.' + chr(10)])}" for _ in range(n))


def periodic():
    words = []
    for _ in range(rng.randint(1, 6)):
        words += [rng.choice("abc") for _ in range(rng.randint(1, 5))] * rng.randint(1, 12)
    return " ".join(words)


TEXTS = [
    None, "", "   ", "x", "one two", "a " * 400, "ab " * 5 + "ab", prose(4000), "Ünïcode 日本 😀😀 <|endoftext|> <s> ▁", "日本" * 300,
    "tabs\tand\r\nlines\n\n end ", "  two  spaces. And, more.\n\nThen²x", "\x00 zero", "<0x0A> byte", "don't 'tis x-1 3.5",
    *(periodic() for _ in range(25)), *(prose(rng.randint(1, 90)) for _ in range(15)),
]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "x"), (3, "other"), (None, "no id"), (None, "no id"), (None, None), (99, TEXTS[7]), (100, "one two")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", "odd", "odd", "odd", "odd") for i, t in ROWS], DOCS).repartition(3)


@pytest.fixture
def tables(spark, docs, tmp_path):
    def folder(df):
        df.write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return folder


def keyed(rows):
    return sorted(map(repr, rows))


# 11


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    crc, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or crc % 10 or not n:
        return words
    g = crc // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def plain_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(6, 4 * q):
                found.setdefault((start, i - start + q), q)
            i += 1
    return sorted((s, length, q) for (s, length), q in found.items())


def test_runs_equal_plain_search(spark, tables, docs):
    got = queries.QUERIES["op11_periodic_runs"](spark, tables(docs)).collect()
    expected = []
    for doc_id, text in ROWS:
        words = planted(doc_id, text)
        runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
        dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
        expected.append((doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2],
                         hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    assert keyed(tuple(r) for r in got) == keyed(expected)
    assert sum(r[1] for r in expected) > 30


def test_grammar_extensions_equal_word_by_word():
    random_ = np.random.default_rng(3)
    parts, bar = [np.array([-1])], -2
    for _ in range(30):
        unit = random_.integers(0, 3, random_.integers(1, 9))
        parts += [np.tile(unit, random_.integers(1, 30)), random_.integers(0, 3, 20), np.array([bar])]
        bar -= 1
    words = np.concatenate(parts)
    grammar = periodic_runs.RunLengthGrammar(words)
    left = random_.integers(1, len(words) - 1, 3000)
    right = random_.integers(1, len(words) - 1, 3000)
    left, right = left[left != right], right[left != right]
    ahead, behind = grammar.common(left, right, 1), grammar.common(left, right, -1)
    for x, y, a, b in zip(left, right, ahead, behind):
        n = 0
        while words[x + n] == words[y + n] >= 0:
            n += 1
        assert n == a
        n = 0
        while words[x - n] == words[y - n] >= 0:
            n += 1
        assert n == b


def test_long_periodic_text(spark):
    words = 200_000
    df = spark.createDataFrame([(1, "a b " * words), (2, "c")], "doc_id long, text string")
    rows = {r.doc_id: r for r in periodic_runs.periodic_runs(df).collect()}
    assert [tuple(x) for x in rows[1].runs] == [(0, 2 * words, 2)] and rows[1].collapsed == "a b" and rows[2].runs == []


# 12


def test_edited_texts_and_equal_fingerprints(spark, tables, docs):
    got = queries.QUERIES["op12_imatch_fingerprints"](spark, tables(docs)).collect()
    assert len(got) == len(ROWS)
    texts = defaultdict(set)
    for i, t in ROWS:
        texts[i].add(t or "")
    # Where an id stands for one text, and so does the next one, the edited text is known.
    order = sorted((i for i in texts if i is not None), reverse=True)
    prints = defaultdict(set)
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.doc_id is not None and len(texts[r.doc_id]) == 1:
            [text] = texts[r.doc_id]
            assert r.n_chars == len(text)
            prints[text].add(r.fingerprint)
            at = order.index(r.doc_id)
            if at + 1 < len(order) and len(texts[order[at + 1]]) == 1:
                [after] = texts[order[at + 1]]
                taken = len(text) // 2
                edited = text[: len(text) - taken] + after[:taken]
                assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
                assert edited != text or (r.near_edited == 1 and r.edited_fingerprint == r.fingerprint)
    term_sets = {frozenset(re.findall(r"[^\W_]+", t.lower())) for t in prints}
    assert all(len(p) == 1 for p in prints.values()) and len({min(p) for p in prints.values()}) > 0.8 * len(term_sets)


def test_after_the_last_comes_the_first(spark):
    df = spark.createDataFrame([(1, "abcd"), (2, "efghij"), (3, "kl")], "doc_id long, text string")
    got = {r.doc_id: r.edited_sha256 for r in imatch.fingerprints(df).collect()}
    assert got == {i: hashlib.sha256(t).hexdigest() for i, t in ((3, b"ke"), (2, b"efgabc"), (1, b"abkl"))}
    assert imatch.fingerprints(df.where("doc_id = 1")).collect()[0].near_next == 1


def plain_entries(chosen):
    listed = []
    for t in chosen:
        bits = t & (2**64 - 1)
        for level in range(imatch.LEVELS):
            if (bits >> 5) & (4**level - 1) == 0:
                listed.append((imatch.LEXICONS * level + (bits & 31), bits >> 8))
    return sorted({place for place, _t in listed}), sorted(listed)


def test_entries_name_the_lexicons_that_have_terms(spark):
    hashes = [random.Random(s).randrange(-(2**63), 2**63) for s in range(400)] + [32 * 4**6 * k for k in range(1, 9)]
    df = spark.createDataFrame([(sorted(hashes),), (sorted(hashes)[:-1],), ([],)], "t array<long>")
    made = [r[0] for r in df.select(imatch.entries(F.col("t"))).collect()]
    assert [e >> 16 for e in made[0]] == plain_entries(hashes)[0] and made[2] == []
    changed = {place for place, _t in set(plain_entries(hashes)[1]) - set(plain_entries(sorted(hashes)[:-1])[1])}
    assert {e >> 16 for e in set(made[0]) - set(made[1])} == changed


def test_likeness_follows_common_terms(spark):
    random_ = np.random.default_rng(1)
    rows = []
    for size in (20, 150, 2000):
        for share in (0.0, 0.3, 0.7, 0.95):
            a = random_.integers(-(2**62), 2**62, size)
            b = np.append(a[: int(size * 2 * share / (1 + share))], random_.integers(-(2**62), 2**62, size - int(size * 2 * share / (1 + share))))
            rows.append((size, share, sorted(a.tolist()), sorted(b.tolist())))
    df = spark.createDataFrame(rows, "size int, share double, a array<long>, b array<long>")
    df = df.select("size", "share", imatch.entries(F.col("a")).alias("a"), imatch.entries(F.col("b")).alias("b"))
    got = df.select("share", imatch.likeness(F.lit(1), F.col("a"), F.lit(2), F.col("b")).alias("x")).collect()
    assert all(abs(r.share - r.x) < 0.3 for r in got) and np.corrcoef(*zip(*got))[0, 1] > 0.9


def test_large_lexicons_are_joined(spark, docs, monkeypatch):
    sent = imatch.fingerprints(docs).collect()
    monkeypatch.setattr(imatch, "BROADCAST_TERMS", 0)
    assert keyed(imatch.fingerprints(docs).collect()) == keyed(sent)


# 13


@pytest.fixture(scope="module")
def files():
    return token_spans.read_files()


@pytest.fixture(scope="module")
def aligner(files):
    return token_spans.Aligner(files)


def plain_tokens(aligner, text):
    if not text:
        return [], []
    a = aligner.byte_bpe.encode(" " + text, add_special_tokens=False).ids
    b = aligner.piece_bpe.encode(text)
    raw = (" " + text).encode()
    spelled = [b"".join(table[i] for i in ids) for table, ids in ((aligner.a_bytes, a), (aligner.b_bytes, b))]
    return (a, b) if spelled == [raw, raw] else ([], [])


def plain_links(aligner, a, b):
    def ranges(ids, table):
        stop = 0
        for i in ids:
            yield i, stop, (stop := stop + len(table[i]))

    a, b = list(ranges(a, aligner.a_bytes)), list(ranges(b, aligner.b_bytes))
    links = [(i, j) for i, s, e in a for j, s2, e2 in b if s < e2 and s2 < e]
    groups, done = [], 0
    for cut in sorted({e for _i, _s, e in a} & {e for _i, _s, e in b}):
        groups.append(",".join(str(i) for i, s, _e in a if done <= s < cut) + "|" + ",".join(str(i) for i, s, _e in b if done <= s < cut))
        done = cut
    return links, groups


@pytest.mark.parametrize("block_bytes", [token_spans.BLOCK_BYTES, 300])
def test_alignment_equals_plain_version(spark, docs, aligner, files, block_bytes):
    rows = [(i, t) for i, t in ROWS if len(t or "") < 5000]
    small = docs.where("text is null or length(text) < 5000")
    linked = [(i, *(plain_tokens(aligner, t))) for i, t in rows]
    linked = [(i, a, b, *plain_links(aligner, a, b)) for i, a, b in linked]
    counts = Counter(pair for _i, _a, _b, links, _g in linked for pair in set(links))
    highest = defaultdict(int)
    for (a, _b), n in counts.items():
        highest[a] = max(highest[a], n)
    expected = [
        (i, len(a), len(b), len(groups), len(links), sum(counts[x] == highest[x[0]] for x in links), sum(counts[x] for x in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for i, a, b, links, groups in linked
    ]
    got = token_spans.align_tokens(small, files, block_bytes=block_bytes).collect()
    assert keyed(tuple(r) for r in got) == keyed(expected)
    assert sum(e[1] == 0 for e in expected) < len(expected) / 3


def test_pieces_are_encoded_as_in_their_text(aligner):
    assert aligner.cuttable
    letters = list("ab .,\n\t'é日😀▁² ᠎​﻿1-\x00\x1c　sdt|<>٣\r") + ["<|endoftext|>", "<s>", "  ", " a", "'s", "\n\n", "<0x0A>", "é"]
    random_ = random.Random(9)
    for _ in range(4000):
        text = "".join(random_.choice(letters) for _ in range(random_.randint(1, 14)))
        pieces = aligner.cut(text)
        assert "".join(pieces) == " " + text
        tokens = aligner.align(pieces)
        a, b = ([], []) if None in tokens else ([i for t in tokens for i in t[side].ids.tolist()] for side in (0, 1))
        assert (a, b) == plain_tokens(aligner, text), text


def test_spans_are_refined_by_bytes():
    # Two tokens within one character have its span; the second of them is placed by its bytes.
    starts, stops, lengths = np.array([0, 2, 2, 5]), np.array([2, 5, 5, 6]), np.array([2, 2, 1, 1])
    assert token_spans.refine(starts, stops, lengths).tolist() == [2, 4, 5, 6]


def test_groups_cover_the_text(spark, docs, files, aligner):
    rows = docs.where("text is null or length(text) < 5000")
    for r in token_spans.token_groups(rows, files).join(rows.select("doc_id", "text"), "doc_id").where("doc_id > 3").collect():
        a, b = plain_tokens(aligner, r.text)
        assert [i for g in r.groups for i in g.a] == a and [i for g in r.groups for i in g.b] == b
        assert [g.stop for g in r.groups[:-1]] == [g.start for g in r.groups[1:]]


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_imatch_fingerprints", "op13_token_alignment"])
def test_empty_table(spark, tables, docs, name):
    assert queries.QUERIES[name](spark, tables(docs.where("false"))).collect() == []


def test_documents_of_pairs_are_counted_in_slices(monkeypatch):
    """whole documents at a time, with the counts of all links at once."""
    draw = np.random.default_rng(3)
    sizes, pairs = draw.integers(0, 5, 90), 40
    bounds, pair_of = token_spans._bounds(sizes), draw.integers(0, pairs, sizes.sum())
    docs, pieces = np.sort(draw.integers(0, 30, 500)), draw.integers(0, 90, 500)
    held, owner = token_spans._expand(bounds, pieces)
    expected = np.bincount([pair for _doc, pair in set(zip(docs[owner].tolist(), pair_of[held].tolist()))], minlength=pairs)
    for links in (1, 50, 10**6):
        monkeypatch.setattr(token_spans, "LINKS_AT_ONCE", links)
        assert token_spans._docs_of_pairs(docs, pieces, bounds, pair_of, pairs).tolist() == expected.tolist()
    assert token_spans._docs_of_pairs(docs[:0], pieces[:0], bounds, pair_of, pairs).tolist() == [0] * pairs
