"""Jaccard join of documents on word n-grams by a blocked sparse product of their incidence matrix.

Rows of the matrix are distinct shingle sets, columns are shingles, and only the columns that can matter are multiplied:
under one global order of the shingles, two sets as similar as asked share one of their first few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklore.llm import arrow_text as at
from tracklore.llm.components import connected
from tracklore.llm.stages import discard, store

WORDS, PERCENT = 4, 85
#: Shingles in more documents than this are moved to the end of the global order, the most frequent ones first, as many
#: as the second figure at most: that list and a bitmap of 2**BITMAP_BITS bits are all that is sent to every task.
FREQUENT, MOST_FREQUENT, BITMAP_BITS = 64, 1 << 20, 27
#: Columns with more sets than this are multiplied in memory, in blocks of about so many sets and shingles, so many
#: columns at a time.
CROWD, BLOCK_SETS, BLOCK_SHINGLES, COLUMNS = 64, 1024, 1 << 20, 4096
PAGE = 4096

_FACTORS = at.mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (row, shingle hash) pairs; a row with fewer words has all of them as one shingle."""
    hashes, rows = at.lower_words(data, offsets, at.NOT_SPACE)
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.cumsum(counts) - counts
    found, owner = [], []
    for size in range(1, words + 1):
        if size < words:
            begin = first[counts == size]
        else:
            begin = np.flatnonzero(rows[: max(len(rows) - size + 1, 0)] == rows[size - 1 :]) if len(rows) >= size else np.zeros(0, int)
        value = np.full(len(begin), size, np.uint64)
        for step in range(size):
            value += hashes[begin + step] * _FACTORS[step]
        found.append(at.mix(value))
        owner.append(rows[begin])
    value, row = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return row[new], value[new]


def _least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * n // 100)


def _prefix(n: np.ndarray, percent: int) -> np.ndarray:
    """So many first shingles of a set hold at least one of any set that is similar enough."""
    return n - _least_overlap(n, percent) + 1


def _zone(n: np.ndarray, percent: int) -> np.ndarray:
    return np.minimum(n, _prefix(n, percent) * 5 // 4 + 4)


def _nodes(row: np.ndarray, value: np.ndarray, rows: int) -> list[bytes]:
    """16 bytes per row that stand for its set of shingles."""
    sums = np.zeros((rows, 2), np.uint64)
    if len(row):
        start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        sums[row[start], 0] = np.add.reduceat(at.mix(value ^ np.uint64(0x5851F42D4C957F2D)), start)
        sums[row[start], 1] = np.add.reduceat(at.mix(value + np.uint64(0x14057B7EF767814F)), start)
    raw = sums.tobytes()
    return [raw[16 * i : 16 * i + 16] for i in range(rows)]


def _first(row: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Which of the values, ordered by row, are among the first `limit[row]` of their row."""
    counts = np.bincount(row, minlength=len(limit))
    return np.arange(len(row)) - (np.cumsum(counts) - counts)[row] < limit[row]


def _first_copies(nodes: list[bytes]) -> np.ndarray:
    """Which rows are the first with their node."""
    once = np.zeros(len(nodes), bool)
    once[list(dict(zip(reversed(nodes), range(len(nodes) - 1, -1, -1))).values())] = True
    return once


def _lists(row: np.ndarray, value: np.ndarray, rows: int) -> pa.Array:
    bounds = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(value.view(np.int64)))


def _survey(words: int, percent: int):
    """Per document its id, key, number of shingles, node and zone.

    The zone has the shingles of smallest hash, some more than a prefix needs; a copy within a block has none.
    """

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in at.blocks(batch.column(2)):
                row, value = shingles(data, offsets, words)
                n = np.bincount(row, minlength=hi - lo)
                nodes = _nodes(row, value, hi - lo)
                near = _first(row, _zone(n, percent)) & _first_copies(nodes)[row]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).cast(pa.int64()), batch.column(1).slice(lo, hi - lo), pa.array(n, pa.int64()),
                     pa.array(nodes, pa.binary()), _lists(row[near], value[near], hi - lo)], SURVEY)

    return survey


SURVEY = ["id", "key", "n", "node", "zone"]
SURVEY_DDL = "id long, key long, n long, node binary, zone array<long>"
POSTINGS = ["token", "node", "n", "late", "last"]
POSTINGS_DDL = "token long, node binary, n long, late boolean, last long"


def _bitmap_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    for batch in batches:
        slot = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - BITMAP_BITS)
        np.bitwise_or.at(bits, (slot >> np.uint64(3)).astype(np.int64), np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8))
    pages = bits.reshape(-1, PAGE)
    used = np.flatnonzero(pages.any(axis=1))
    if len(used):
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([pages[i].tobytes() for i in used], pa.binary())], ["page", "bits"])


def _bitmap(tokens: DataFrame) -> np.ndarray:
    """Bit per hash slot that holds a token; of a fixed size, so a false hit only costs time."""
    bits = np.zeros((1 << (BITMAP_BITS - 3)) // PAGE * PAGE, np.uint8).reshape(-1, PAGE)
    for row in tokens.select("token").mapInArrow(_bitmap_pages, "page int, bits binary").toLocalIterator():
        bits[row[0]] |= np.frombuffer(row[1], np.uint8)
    return bits.ravel()


def _has(bits: np.ndarray, value: np.ndarray) -> np.ndarray:
    slot = value >> np.uint64(64 - BITMAP_BITS)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _zones(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the sets of a batch of the survey, and row and hash of the shingles in their zones."""
    zone, n = batch.column(1), batch.column(0).to_numpy()
    lengths = zone.value_lengths().to_numpy(zero_copy_only=False)
    return n, np.repeat(np.arange(len(n)), lengths), zone.flatten().to_numpy(zero_copy_only=False).view(np.uint64)


def _beyond(n: np.ndarray, row: np.ndarray, late: np.ndarray, percent: int) -> np.ndarray:
    """Sets whose prefix reaches beyond their zone, because too much of the zone is frequent."""
    return (_zone(n, percent) < n) & (np.bincount(row[~late], minlength=len(n)) < _prefix(n, percent))


def _beyond_zone(sent, percent: int):
    def beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, row, value = _zones(batch)
            out = _beyond(n, row, at.member(sent.value, value) >= 0, percent)
            yield batch.select(["node"]).filter(pa.array(out))

    return beyond


def _posted(n, nodes, row, value, late, percent: int, bits=None) -> pa.RecordBatch:
    """Postings of the first shingles of each set; `last` is the last of these, with its place in the order."""
    order = np.lexsort((value, late, row))
    row, value, late = row[order], value[order], late[order]
    first = _first(row, _prefix(n, percent))
    row, value, late = row[first], value[first], late[first]
    last, last_late = np.zeros(len(n), np.uint64), np.zeros(len(n), bool)
    if len(row):
        end = np.flatnonzero(np.concatenate([row[1:] != row[:-1], [True]]))
        last[row[end]], last_late[row[end]] = value[end], late[end]
    if bits is not None:
        seen = _has(bits, value)
        row, value = row[seen], value[seen]
    signed = (last ^ np.uint64(1 << 63)).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(value.view(np.int64)), nodes.take(pa.array(row)), pa.array(n[row], pa.int64()), pa.array(last_late[row]),
         pa.array(signed[row])], POSTINGS)


def _postings_of_zones(sent, percent: int):
    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, bits = sent.value
        for batch in batches:
            n, row, value = _zones(batch)
            late = at.member(heavy, value) >= 0
            inside = ~_beyond(n, row, late, percent)[row]
            yield _posted(n, batch.column(2), row[inside], value[inside], late[inside], percent, bits)

    return postings


def _postings_of_texts(sent, words: int, percent: int):
    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in at.blocks(batch.column(0)):
                row, value = shingles(data, offsets, words)
                nodes = pa.array(_nodes(row, value, hi - lo), pa.binary())
                yield _posted(np.bincount(row, minlength=hi - lo), nodes, row, value, at.member(sent.value, value) >= 0, percent)

    return postings


def _set_maker(words: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in at.blocks(batch.column(0)):
                row, value = shingles(data, offsets, words)
                yield pa.RecordBatch.from_arrays([pa.array(_nodes(row, value, hi - lo), pa.binary()), _lists(row, value, hi - lo)], ["node", "items"])

    return sets


def _texts_of(texts: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The text of one document of each wanted node."""
    sources = nodes.join(wanted, "node", "left_semi").select(F.col("id").alias("_id"), F.col("key").alias("_key"))
    return texts.join(sources, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left_semi").select("text")


def _sets(texts: DataFrame, nodes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, items) of the wanted nodes."""
    rows = _texts_of(texts, nodes, wanted).mapInArrow(_set_maker(words), "node binary, items array<long>")
    return store(rows.dropDuplicates(["node"]))


def _similar(a: Column, b: Column, shared: Column, percent: int) -> Column:
    return 100 * shared >= percent * (a + b - shared)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("_x"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("_y"))
    shared = F.size(F.array_intersect("_x", "_y"))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.where(_similar(F.size("_x"), F.size("_y"), shared, percent)).select("a", "b")


def _share(n: Column, percent: int) -> Column:
    return F.ceil(n * percent / 100)


def _of_earlier(name: str) -> Column:
    """A column of that of the sets `a` and `b` whose first shingles end earlier: what the other has of these is posted."""
    earlier = F.struct("a.late", "a.last") <= F.struct("b.late", "b.last")
    return F.when(earlier, F.col(f"a.{name}")).otherwise(F.col(f"b.{name}"))


def _may_fit(percent: int) -> Column:
    """Whether sets `a` and `b` can be similar by their sizes and the most that the one that ends earlier can share."""
    return _similar(F.col("a.n"), F.col("b.n"), F.least(_of_earlier("most"), "a.n", "b.n"), percent)


def _crowds(crowded: DataFrame) -> DataFrame:
    """(node, crowd): sets that crowded columns connect are in one crowd."""
    name = F.encode(F.concat(F.lit("column "), F.col("token").cast("string")), "utf-8")
    members = connected(crowded.select(F.col("node").alias("a"), name.alias("b")))
    return members.join(crowded.select("node").distinct(), "node", "left_semi").withColumnRenamed("label", "crowd")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Product of two incidence matrices, a slice of their common columns at a time."""
    lengths = [np.array([len(x) for x in side]) for side in (left, right)]
    known, column = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    split = int(lengths[0].sum())
    rows = [np.repeat(np.arange(len(n)), n) for n in lengths]
    columns = [column[:split], column[split:]]
    seen = np.isin(np.arange(len(known)), columns[0]) & np.isin(np.arange(len(known)), columns[1])
    place = np.cumsum(seen) - 1
    out = np.zeros((len(left), len(right)), np.float32)
    parts = []
    for row, col in zip(rows, columns):
        row, col = row[seen[col]], place[col[seen[col]]]
        order = np.argsort(col, kind="stable")
        parts.append((row[order], col[order]))
    for start in range(0, int(seen.sum()), COLUMNS):
        pair = []
        for (row, col), n in zip(parts, lengths):
            lo, hi = np.searchsorted(col, [start, start + COLUMNS])
            dense = np.zeros((len(n), COLUMNS), np.float32)
            dense[row[lo:hi], col[lo:hi] - start] = 1
            pair.append(dense)
        out += pair[0] @ pair[1].T
    return out


def _linker(percent: int):
    def link(table: pa.Table) -> pa.Table:
        """Links of one block of the product, as few as connect what the block connects."""
        table = table.combine_chunks()
        sides = [table.filter(pa.compute.equal(table["side"], k)) for k in (0, 1)]
        if table["same"][0].as_py():
            sides[1] = sides[0]
        sets = [[np.asarray(x.values) for x in t["items"]] for t in sides]
        nodes = [t["node"].to_pylist() for t in sides]
        shared = _overlaps(*sets)
        n = [np.array([len(x) for x in side]) for side in sets]
        i, j = np.nonzero(100 * shared >= percent * (n[0][:, None] + n[1][None, :] - shared))
        parent: dict[bytes, bytes] = {}

        def root(x: bytes) -> bytes:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        found = []
        for x, y in zip(i.tolist(), j.tolist()):
            a, b = nodes[0][x], nodes[1][y]
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[ra] = rb
                found.append((a, b))
        return pa.table({"a": pa.array([a for a, _b in found], pa.binary()), "b": pa.array([b for _a, b in found], pa.binary())})

    return link


def _crowd_links(crowded: DataFrame, sets_of, percent: int) -> DataFrame:
    """Links (a, b) that connect whatever similar sets of a crowd connect.

    A crowd is cut into blocks by size class and hash, and each pair of blocks whose sizes allow a link is one product
    in memory, so neither sets nor their pairs meet as rows. Classes are a factor 100 / `percent` apart: only equal and
    neighbouring ones can link.
    """
    members = store(
        _crowds(crowded.select("token", "node")).join(crowded.select("node", "n").distinct(), "node")
        .withColumn("class", F.floor(F.log(F.col("n")) / F.log(F.lit(100 / percent)) + 1e-9))
    )
    enough = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    counts = members.groupBy("crowd", "class").agg(enough.alias("blocks"))
    members = members.join(counts, ["crowd", "class"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    blocks = counts.select("crowd", "class", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"))
    a = blocks.select("crowd", F.struct("class", "block").alias("a"), F.explode(F.array(F.col("class"), F.col("class") + 1)).alias("class"))
    b = blocks.select("crowd", F.struct("class", "block").alias("b"), "class")
    pairs = a.join(b, ["crowd", "class"]).where(F.col("a") <= F.col("b")).select(
        "crowd", "a", "b", (F.col("a") == F.col("b")).alias("same"))
    ends = pairs.select(
        F.xxhash64("crowd", "a", "b").alias("pair"), "crowd", "same",
        F.explode(F.when(F.col("same"), F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("at"))))
                  .otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("at")),
                                     F.struct(F.lit(1).alias("side"), F.col("b").alias("at"))))).alias("end"))
    placed = ends.select("pair", "crowd", "same", "end.side", F.col("end.at.class").alias("class"), F.col("end.at.block").alias("block"))
    rows = members.select("node", "crowd", "class", "block").join(placed, ["crowd", "class", "block"]).join(
        sets_of(members.select("node")), "node")
    return rows.select("pair", "same", "side", "node", "items").groupBy("pair").applyInArrow(_linker(percent), "a binary, b binary")


def _products(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may be similar, by the sum of their products.

    Each column is multiplied with itself; the overlaps add up per pair. The set whose first shingles end earlier has no
    more than its other shingles left to share, which bounds the whole overlap.
    """
    a, b = (members.select("token", F.struct("node", "n", "most", "late", "last").alias(x)) for x in "ab")
    meet = a.join(b, "token").where((F.col("a.node") < F.col("b.node")) & _may_fit(percent))
    overlap = meet.groupBy(F.col("a.node").alias("x"), F.col("b.node").alias("y")).agg(
        F.count("*").alias("shared"), F.first("a").alias("a"), F.first("b").alias("b"))
    most = F.least(F.col("shared") + _share(_of_earlier("n"), percent) - 1, "a.n", "b.n")
    return overlap.where(_similar(F.col("a.n"), F.col("b.n"), most, percent)).select(F.col("x").alias("a"), F.col("y").alias("b"))


def similar_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS,
                   percent: int = PERCENT) -> DataFrame:
    """Per row of `docs`: (id, key, n_shingles, node, label, component_id).

    Words are runs of characters other than white space, A-Z lower-cased; the set of a document has its distinct
    shingles of `words` words, or its whole word sequence if shorter. Two documents are linked when 100 * intersection
    is at least `percent` * union; `label` names the group that links connect and `component_id` is its smallest id.
    Equal sets are one row of the matrix, so copies never meet. Null and empty texts have no shingle and no link: each is
    its own component. Ids that are null count as larger than others. Repeated rows are all kept and share a component.
    `key` is a hash of the text. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text_column).alias("key"), F.col(text_column).alias("text"))
    survey = store(texts.mapInArrow(_survey(words, percent), SURVEY_DDL))
    rows = survey.select("id", "key", "n", "node")
    nodes = rows.where("n > 0").groupBy("node").agg(F.min(F.struct("id", "key")).alias("_least"), F.min("id").alias("least_id"))
    nodes = store(nodes.select("node", "_least.*", "least_id"))
    shared = store(
        survey.select(F.explode("zone").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where("n > 1"))
    frequent = shared.where(F.col("n") > FREQUENT).orderBy(F.desc("n"), "token").limit(MOST_FREQUENT)
    heavy = np.sort(frequent.select("token").toPandas()["token"].to_numpy(np.int64).view(np.uint64))
    zones = survey.where(F.size("zone") > 0).select("n", "zone", "node")
    order = spark.sparkContext.broadcast(heavy)
    beyond = store(zones.mapInArrow(_beyond_zone(order, percent), "node binary").distinct())
    posted = store(_texts_of(texts, nodes, beyond).mapInArrow(_postings_of_texts(order, words, percent), POSTINGS_DDL))
    # A token is left out only if no other set can have it among its first ones.
    bits = _bitmap(shared.select("token").unionAll(posted.select("token")))
    sent = spark.sparkContext.broadcast((heavy, bits))
    every = store(
        zones.mapInArrow(_postings_of_zones(sent, percent), POSTINGS_DDL).unionAll(posted).dropDuplicates(["token", "node"]))
    # Nothing that is still to run reads the broadcasts; what was made with them is stored.
    order.destroy()
    sent.destroy()
    discard(shared, beyond, posted)
    sizes = store(every.groupBy("token").agg(F.count("*").alias("_m")).where("_m > 1"))
    met = every.join(sizes.select("token"), "token", "left_semi")
    # The first shingles that no other set posts bound the overlap with sets whose first shingles end later.
    known = met.groupBy("node").agg(F.count("*").alias("_met"))
    postings = store(met.join(known, "node").withColumn("most", _share(F.col("n"), percent) - 1 + F.col("_met")).drop("_met"))
    discard(every)
    crowds = sizes.where(F.col("_m") > CROWD).select("token")
    # Two sets that meet in a crowded column are compared there, others by the columns that are not crowded.
    crowded = postings.join(crowds, "token", "left_semi").select("token", "node", "n")
    near = store(_crowd_links(crowded, lambda wanted: _sets(texts, nodes, wanted, words), percent))
    pairs = store(_products(postings.join(crowds, "token", "left_anti"), percent))
    discard(postings, sizes)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _sets(texts, nodes, ends, words)
    joined = connected(near.unionAll(_verified(pairs, sets, percent))).select("node", F.col("label").alias("_label"))
    discard(near, pairs, sets)
    labels = store(nodes.select("node").join(joined, "node", "left").select("node", F.coalesce("_label", "node").alias("label")))
    least = nodes.join(labels, "node").groupBy("label").agg(F.min("least_id").alias("least"))
    named = labels.join(least, "label").select(F.col("node").alias("_node"), "label", "least")
    return rows.join(named, F.when(F.col("n") > 0, F.col("node")) == F.col("_node"), "left").select(
        F.col("id").alias(id_column), "key", F.col("n").alias("n_shingles"), "node", "label",
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))


def keep_one_per_group(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """`docs` with one row of each group, the one with the smallest id; rows without words are kept, equal ones once."""
    groups = store(similar_groups(docs, id_column, text_column, **options))
    alone = F.concat_ws("|", F.lit("-"), F.col(id_column).cast("string"), F.col("key").cast("string")).cast("binary")
    group = F.coalesce("label", alone)
    first = F.min(F.struct(F.col(id_column).isNull(), F.col(id_column).alias("_id"), F.col("key").alias("_key"))).alias("s")
    kept = groups.groupBy(group.alias("g")).agg(first).select("s._id", "s._key").distinct()
    same = docs[id_column].cast("long").eqNullSafe(kept["_id"]) & (F.xxhash64(docs[text_column]) == kept["_key"])
    left = docs.join(kept, same, "left_semi")
    repeated = groups.groupBy(id_column, "key").count().where("count > 1").limit(1).count()
    return left.dropDuplicates([id_column, text_column]) if repeated else left
