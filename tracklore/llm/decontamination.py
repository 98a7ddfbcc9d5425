"""Benchmark passages in documents, found by a generalised suffix automaton of the benchmark items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklore.llm import arrow_text as at

WINDOW, COVERAGE = 13, 20
#: Words of the items that share one automaton; bounds what is broadcast and what a task holds.
BLOCK_WORDS = 200_000
HITS_DDL = "_id long, _key long, n_words long, spans array<struct<start: long, stop: long>>, items array<string>"
HITS_ARROW = pa.schema([
    ("_id", pa.int64()), ("_key", pa.int64()), ("n_words", pa.int64()),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("items", pa.list_(pa.string())),
])


class SuffixAutomaton:
    """All substrings of a set of word sequences.

    A window is `window` consecutive words of an item, or the whole item if it has fewer words (but not none). States
    know the items of their windows, so a text needs one step per word to find every window that ends there.
    """

    def __init__(self, items: list[tuple[object, list[int]]], window: int) -> None:
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends = []
        for _name, words in items:
            state, path = 0, []
            for word in words:
                state = self._extend(state, word)
                path.append(state)
            ends.append(path)
        states = len(self.link)
        self.owners: list[set | None] = [None] * states  # items that have the state's words, for states of a window
        self.whole: list[set | None] = [None] * states  # items shorter than a window that are the state's words
        for (name, words), path in zip(items, ends):
            if len(words) < window:
                if path:
                    self._add(self.whole, path[-1], name)
                continue
            for state in path:
                while state > 0 and self.length[state] >= window and name not in (self.owners[state] or ()):
                    self._add(self.owners, state, name)
                    state = self.link[state]
        # The nearest state with a whole short item on the way to the root, itself included; -1 for none.
        self.short = [-1] * states
        for state in sorted(range(1, states), key=self.length.__getitem__):
            self.short[state] = state if self.whole[state] else self.short[self.link[state]]
        self.shortest = min([window, *(len(w) for _n, w in items if w)])

    @staticmethod
    def _add(table: list, state: int, name: object) -> None:
        if table[state] is None:
            table[state] = set()
        table[state].add(name)

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, parent: int, word: int, child: int) -> int:
        """The state of `child`'s words that are one longer than `parent`; a copy of it if it also has longer ones."""
        if self.length[child] == self.length[parent] + 1:
            return child
        copy = self._state(self.length[parent] + 1, self.link[child], dict(self.next[child]))
        self.link[child] = copy
        while parent >= 0 and self.next[parent].get(word) == child:
            self.next[parent][word] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return self._split(last, word, known)
        state, at_ = self._state(self.length[last] + 1, 0, {}), last
        while at_ >= 0 and word not in self.next[at_]:
            self.next[at_][word] = state
            at_ = self.link[at_]
        if at_ >= 0:
            self.link[state] = self._split(at_, word, self.next[at_][word])
        return state

    def scan(self, words: list[int], first: int, spans: list[list[int]], found: set) -> None:
        """Adds the hit spans and the items of a run of known words that starts at word `first` of its text."""
        step, link, length, window, shortest = self.next, self.link, self.length, self.window, self.shortest
        state = matched = 0
        for place, word in enumerate(words, first):
            to = step[state].get(word)
            if to is None:
                while to is None and state > 0:
                    state = link[state]
                    to = step[state].get(word)
                matched = length[state]
                if to is None:
                    continue
            state, matched = to, matched + 1
            if matched < shortest:
                continue
            reach = 0
            if matched >= window:
                reach, at_ = matched, state
                while length[link[at_]] >= window:
                    at_ = link[at_]
                found |= self.owners[at_]
            item = state if self.whole[state] and matched == length[state] else self.short[link[state]]
            while item > 0:
                found |= self.whole[item]
                reach = max(reach, length[item])
                item = self.short[link[item]]
            if reach:
                start = place + 1 - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, place + 1])


def _item_automaton(items: list[tuple[str, str]], window: int) -> tuple[np.ndarray, SuffixAutomaton]:
    """Sorted hashes of the items' words, and the automaton over their indexes."""
    words = [at.lower_words(np.frombuffer((text or "").encode(), np.uint8), np.array([0, len((text or "").encode())]),
                            at.ALPHANUMERIC)[0] for _name, text in items]
    known = np.unique(np.concatenate([np.zeros(0, np.uint64), *words]))
    coded = [(name, np.searchsorted(known, w).tolist()) for (name, _text), w in zip(items, words)]
    return known, SuffixAutomaton(coded, window)


def _scanner(items, window: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, automaton = _item_automaton(items.value, window)
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for lo, hi, data, offsets in at.blocks(batch.column(2)):
                hashes, rows = at.lower_words(data, offsets, at.ALPHANUMERIC)
                counts = np.bincount(rows, minlength=hi - lo)
                first = np.cumsum(counts) - counts
                codes = at.member(known, hashes)
                spans: list[list] = [[] for _ in range(hi - lo)]
                found: list[set] = [set() for _ in range(hi - lo)]
                # Only runs of words that all occur in items, and that can hold a window, are walked.
                usable = codes >= 0
                begins = usable & ~np.concatenate([[False], usable[:-1] & (rows[1:] == rows[:-1])]) if len(rows) else usable
                start = np.flatnonzero(begins)
                run = np.cumsum(begins)[usable] - 1
                lengths = np.bincount(run, minlength=len(start)) if len(start) else np.zeros(0, int)
                for a, n in zip(start[lengths >= automaton.shortest].tolist(), lengths[lengths >= automaton.shortest].tolist()):
                    row = int(rows[a])
                    automaton.scan(codes[a : a + n].tolist(), a - int(first[row]), spans[row], found[row])
                yield pa.RecordBatch.from_arrays([
                    ids.slice(lo, hi - lo).cast(pa.int64()), keys.slice(lo, hi - lo), pa.array(counts, pa.int64()),
                    pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans], HITS_ARROW.field("spans").type),
                    pa.array([sorted(f) for f in found], pa.list_(pa.string())),
                ], schema=HITS_ARROW)

    return scan


def _item_blocks(items: DataFrame, id_column: str, text_column: str, block_words: int) -> Iterator[list[tuple[str, str]]]:
    """Items in lists of about `block_words` words, one list at a time; a longer item is a list of its own."""
    block, size = [], 0
    for row in items.select(F.col(id_column).cast("string"), text_column).toLocalIterator():
        words = len((row[1] or "").split()) + 1
        if block and size + words > block_words:
            yield block
            block, size = [], 0
        block.append((row[0] or "", row[1]))
        size += words
    yield block


def benchmark_hits(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                   item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                   block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of `docs`: (id, key, n_words, spans, items).

    `spans` are the maximal runs of words (start, stop) inside occurrences of windows of the items, `items` the distinct
    ids, as sorted strings, of the items whose windows occur, `key` a hash of the text. Matches never cross documents.
    The items are cut into blocks; for each block the whole text of every document streams through the automaton of the
    block, and the findings of all blocks are united. Null and empty texts have no words; items without words have no
    window; items with a null id count as one item with the id ''. Repeated rows are all kept. Without items nothing is
    found, without documents the result is empty. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("_id"), F.xxhash64(text_column).alias("_key"), F.col(text_column).alias("_text"))
    passes = [
        rows.mapInArrow(_scanner(spark.sparkContext.broadcast(block), window), HITS_DDL)
        for block in _item_blocks(items, item_id, item_text, block_words)
    ]
    if len(passes) == 1:
        return passes[0].withColumnsRenamed({"_id": id_column, "_key": "key"})
    united = passes[0]
    for one in passes[1:]:
        united = united.unionAll(one)
    merged = united.groupBy("_id", "_key").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        (F.count("*") / len(passes)).cast("int").alias("_rows"),
    )
    joined = F.expr("""aggregate(array_sort(_spans), cast(array() as array<struct<start: bigint, stop: bigint>>), (done, x) ->
        if(size(done) > 0 and element_at(done, -1).stop >= x.start,
           concat(slice(done, 1, size(done) - 1), array(named_struct('start', element_at(done, -1).start,
                  'stop', greatest(element_at(done, -1).stop, x.stop)))),
           concat(done, array(x))))""")
    return merged.withColumn("spans", joined).withColumn("_copy", F.explode(F.sequence(F.lit(1), "_rows"))).select(
        F.col("_id").alias(id_column), F.col("_key").alias("key"), "n_words", "spans", "items")


def judged(hits: DataFrame, coverage: int = COVERAGE) -> DataFrame:
    """Adds n_hit (words inside windows) and contaminated (at least one word in `coverage` is hit)."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda done, x: done + x["stop"] - x["start"])
    counted = hits.withColumn("n_hit", n_hit)
    return counted.withColumn("contaminated", (F.col("n_hit") > 0) & (coverage * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """`docs` without the contaminated rows; the others unchanged."""
    bad = judged(benchmark_hits(docs, items, id_column, text_column, **options)).where("contaminated")
    keys = bad.select(F.col(id_column).alias("_bad_id"), F.col("key").alias("_bad_key")).distinct()
    same = docs[id_column].cast("long").eqNullSafe(keys["_bad_id"]) & (F.xxhash64(docs[text_column]) == keys["_bad_key"])
    return docs.join(keys, same, "left_anti")


def without_spans(text: str | None, spans: list) -> str | None:
    """The text with the hit words, and what stands between them, cut out; for use on single texts."""
    if not text or not spans:
        return text
    raw = text.encode()
    starts, ends, _rows = at.split_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), at.ALPHANUMERIC)
    parts, done = [], 0
    for span in spans:
        parts.append(raw[done : int(starts[span["start"]])])
        done = int(ends[span["stop"] - 1])
    return b"".join([*parts, raw[done:]]).decode()
