"""Fingerprints of documents by I-Match: hashes of their terms of middling frequency, one for each of many random lexicons.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklore.llm.stages import discard
from tracklore.operators.skew import first_per_key, global_rank
from tracklore.session import cut_lineage

#: Terms in the lexicon: those with ln(documents / documents with the term) in this band.
IDF_BAND = (3.0, 8.0)
#: Random lexicons: on level l there are LEXICONS of them without common terms, each with a term in LEXICONS * 4**l.
LEVELS, LEXICONS = 4, 32
#: Lexicon terms sent to every task. The band has at most e**8 times the mean number of distinct terms of a document, so
#: corpora of ordinary documents stay below; a larger lexicon is joined by a shuffle.
BROADCAST_TERMS = 1 << 20
#: Likeness is read off the densest level of which at most so many lexicons have a term of either text.
FILLED = LEXICONS * 3 // 4
_ENTRY_BITS, _TERM_BITS = 16, 56


def terms(text: Column) -> Column:
    """Hashes of the distinct terms, the lower-cased runs of letters and digits, in the order of the hashes."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def lexicon(texts: DataFrame, text: Column, band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """(term, documents): hashes of the terms whose inverse document frequency lies in the band, counted over all rows.

    Counts are added up before the shuffle, so a term that all documents have is one row a task. Stored once.
    """
    total = texts.count()
    counted = texts.select(F.explode(terms(text)).alias("term")).groupBy("term").agg(F.count("*").alias("documents"))
    return cut_lineage(counted.where(F.log(F.lit(float(max(total, 1))) / F.col("documents")).between(*band)))


def _chained(hashes: Column) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda done, t: F.xxhash64(done, t))


def entries(chosen: Column) -> Column:
    """One number for each random lexicon that has some of the chosen terms: its place, and 16 bits of their hash.

    A term's own hash decides which lexicons it is in: five bits which one of a level, pairs of further bits up to which
    level. The terms are listed by lexicon and sorted, and each list is hashed from its first term to its last.
    """
    mask = (1 << _TERM_BITS) - 1
    lists = []
    for level in range(LEVELS):
        there = F.filter(chosen, lambda t: F.shiftrightunsigned(t, 5).bitwiseAND(4**level - 1) == 0) if level else chosen
        lists.append(F.transform(there, lambda t: F.shiftleft(t.bitwiseAND(LEXICONS - 1) + LEXICONS * level, _TERM_BITS)
                                 .bitwiseOR(F.shiftrightunsigned(t, 64 - _TERM_BITS).bitwiseAND(mask))))
    def closed(done: Column) -> Column:
        entry = (done["at"] * (1 << _ENTRY_BITS) + done["hash"].bitwiseAND((1 << _ENTRY_BITS) - 1)).cast("int")
        return F.when(done["at"] < 0, done["made"]).otherwise(F.concat(done["made"], F.array(entry)))

    def step(done: Column, x: Column) -> Column:
        place = F.shiftrightunsigned(x, _TERM_BITS)
        return F.when(place == done["at"], _state(place, F.xxhash64(done["hash"], x), done["made"])).otherwise(
            _state(place, F.xxhash64(x), closed(done)))

    nothing = _state(F.lit(-1).cast("long"), F.lit(0).cast("long"), F.array().cast("array<int>"))
    return F.aggregate(F.array_sort(F.concat(*lists)), nothing, step, closed)


def _state(at_: Column, hash_: Column, made: Column) -> Column:
    return F.struct(at_.alias("at"), hash_.alias("hash"), made.alias("made"))


def likeness(head: Column, made: Column, other_head: Column, other_made: Column) -> Column:
    """Estimated share of common terms among the terms of either text, 0 to 1, from their fingerprints."""
    place = lambda made: F.transform(made, lambda e: F.shiftright(e, _ENTRY_BITS))
    level = lambda places, l: F.filter(places, lambda p: F.floor(p / LEXICONS) == l)
    either = F.array_union(place(made), place(other_made))
    both = place(F.array_intersect(made, other_made))
    shares = F.lit(0.0)
    for l in reversed(range(LEVELS)):
        filled, same = F.size(level(either, l)), F.size(level(both, l))
        share = F.when(filled > 0, same / filled).otherwise(0.0)
        shares = share if l == LEVELS - 1 else F.when(filled <= FILLED, share).otherwise(shares)
    return F.when(head == other_head, 1.0).otherwise(shares)


def next_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows by (_id, _key), one per id and text, and per row the key of the next one by descending id, nulls last.

    Rows of equal ids are ordered by the hash of their text; after the last row comes the first. The links are stored.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(0)).alias("_id"), F.xxhash64(F.col(id_column).isNotNull(), text).alias("_key"),
        F.col(id_column).cast("long").alias(id_column), text.alias("_text"))
    light = rows.groupBy("_id", "_key", id_column).agg(F.max(F.length("_text")).cast("long").alias("n_chars"), F.count("*").alias("_copies"))
    ranked = cut_lineage(global_rank(light, id_column, "_key", "_place"))
    total = max(ranked.count(), 1)
    after = ranked.select((F.pmod(F.col("_place") - 2, F.lit(total)) + 1).alias("_place"), F.col("_id").alias("_next_id"),
                          F.col("_key").alias("_next_key"))
    links = cut_lineage(ranked.join(after, "_place").drop("_place"))
    discard(ranked)
    return rows, links


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """Per row of `docs`: (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    A fingerprint is the hash of all terms of the text that the lexicon of the table has, and for each of many random
    lexicons with some of them its place and a hash of these (hexadecimal: 16 digits, then 6 for each). A text without
    such terms has the hash of all its terms instead. The edited text is the text whose last half, rounded down, is
    replaced by the first as many characters, or all, of the next row's text by descending id (see `next_texts`).
    near_edited and near_next are the `likeness` of the text's fingerprint to those of the edited and the next text.

    Texts are shuffled once by their key, and the parts of them that the edit takes once more. Terms never leave their
    task, as the lexicon comes to them; if it is too large to be sent, they are joined by their hash. Document
    frequencies are added up before their shuffle.

    Null texts are empty. Null ids come last, and rows of the same id are ordered by their texts; rows that repeat id and
    text are one document, returned as often. A single row is its own next one. Equal texts have equal fingerprints.
    Texts of any length are taken whole. An empty table gives an empty result. Other columns are not read. Starts jobs:
    it stores links, the lexicon and fingerprints.
    """
    rows, links = next_texts(docs, id_column, text_column)
    words = lexicon(rows, F.col("_text"), band)
    chosen = words.select("term")
    chosen = F.broadcast(chosen) if words.count() <= BROADCAST_TERMS else chosen

    texts = first_per_key(rows.select("_id", "_key", "_text"), ["_id", "_key"], [F.col("_id")])
    wanted = links.select(F.col("_next_id").alias("_id"), F.col("_next_key").alias("_key"), F.col("_id").alias("_to_id"),
                          F.col("_key").alias("_to_key"), F.floor(F.col("n_chars") / 2).cast("int").alias("_taken"))
    parts = texts.join(wanted, ["_id", "_key"]).select(
        F.col("_to_id").alias("_id"), F.col("_to_key").alias("_key"), "_taken", F.expr("left(_text, _taken)").alias("_part"))
    edited_text = F.concat(F.expr("left(_text, length(_text) - _taken)"), F.col("_part"))
    both = texts.join(parts, ["_id", "_key"]).select("_id", "_key", "_text", edited_text.alias("_edited"))
    hashed = both.select("_id", "_key", F.sha2("_edited", 256).alias("_sha"), terms(F.col("_text")).alias("_a"), terms(F.col("_edited")).alias("_b"))

    def item(side: int, term: Column, note: Column) -> Column:
        return F.struct(F.lit(side).alias("side"), term.alias("term"), note.alias("note"))

    # Beside the terms of both texts (0, 1) there are items for the hashes of all terms (2, 3), the latter with the digest.
    none = F.lit(None).cast("string")
    listed = hashed.select("_id", "_key", F.explode(F.concat(
        F.transform("_a", lambda t: item(0, t, none)), F.transform("_b", lambda t: item(1, t, none)),
        F.array(item(2, _chained(F.col("_a")), none), item(3, _chained(F.col("_b")), F.col("_sha"))),
    )).alias("_t")).select("_id", "_key", "_t.*")
    met = listed.join(chosen.withColumn("_chosen", F.lit(True)), "term", "left").where("_chosen or side >= 2")

    def of(side: int) -> Column:
        return F.when(F.col("side") == side, F.col("term"))

    grouped = met.groupBy("_id", "_key").agg(
        F.collect_list(of(0)).alias("_a"), F.collect_list(of(1)).alias("_b"), F.max(of(2)).alias("_all_a"), F.max(of(3)).alias("_all_b"),
        F.max("note").alias("edited_sha256"))
    stored = cut_lineage(grouped.select(
        "_id", "_key", "edited_sha256",
        *(F.when(F.size(f"_{x}") > 0, _chained(F.array_sort(f"_{x}"))).otherwise(F.col(f"_all_{x}")).alias(f"_head_{x}") for x in "ab"),
        *(entries(F.col(f"_{x}")).alias(f"_made_{x}") for x in "ab")))

    after = stored.select(F.col("_id").alias("_next_id"), F.col("_key").alias("_next_key"), F.col("_head_a").alias("_head"),
                          F.col("_made_a").alias("_made"))
    after = links.select("_id", "_key", "_next_id", "_next_key").join(after, ["_next_id", "_next_key"]).drop("_next_id", "_next_key")
    result = links.drop("_next_id", "_next_key").join(stored, ["_id", "_key"]).join(after, ["_id", "_key"])
    head, made = F.col("_head_a"), F.col("_made_a")
    return result.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select(
        id_column, "n_chars", "edited_sha256", _text_form(head, made).alias("fingerprint"),
        _text_form(F.col("_head_b"), F.col("_made_b")).alias("edited_fingerprint"),
        likeness(head, made, F.col("_head_b"), F.col("_made_b")).alias("near_edited"),
        likeness(head, made, F.col("_head"), F.col("_made")).alias("near_next"))


def _text_form(head: Column, made: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(head), 16, "0"), F.array_join(F.transform(made, lambda e: F.lpad(F.hex(e), 6, "0")), "")))
