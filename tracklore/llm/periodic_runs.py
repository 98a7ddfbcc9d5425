"""Passages that repeat with a short period, found by recompression: a run-length grammar answers how far two places agree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklore.llm import arrow_text as at

#: A run has at least this many words, and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Places compared at once.
QUERIES = 1 << 20
WORDS = r"[^\x20\x09-\x0D]+"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = pa.schema([("_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])
_DDL = "_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class RunLengthGrammar:
    """Levels of letters over sequences of words, made by block and pair compression in turn.

    Block compression replaces a stretch of equal letters by one letter per (letter, count). Pair compression divides the
    letters into left and right ones by a hash and replaces each left letter followed by a right one. Equal letters stand
    for equal words, and what a letter is replaced by depends on its neighbours only, so equal stretches of words become
    equal letters but for a few at their ends, on every level. Two places are compared by climbing while both start a
    letter of the next level that is the same, and descending from the first letters that differ: a logarithmic number of
    steps. Words below zero stand between sequences; they must be distinct, are never replaced and end every comparison.
    The first and the last word have to be such.
    """

    def __init__(self, words: np.ndarray) -> None:
        names, lengths, self._next = words.astype(np.int64), np.ones(len(words), np.int64), int(words.max(initial=0)) + 1
        levels, owners, turn = [(names, lengths)], [], 0
        idle = 0
        while idle < 8 and (names[1:] >= 0).sum() > (names < 0).sum():
            made = self._blocks(names) if turn % 2 == 0 else self._pairs(names, turn)
            turn += 1
            if made is None:
                idle += 1
                continue
            idle = 0
            heads, names = made
            owners.append(np.cumsum(heads) - 1)
            lengths = np.add.reduceat(lengths, np.flatnonzero(heads))
            levels.append((names, lengths))
        sizes = np.array([len(n) for n, _l in levels])
        offsets = np.cumsum(sizes) - sizes
        self.name = np.concatenate([n for n, _l in levels])
        self.length = np.concatenate([n for _n, n in levels])
        # The letter of the next level that a letter is part of, -1 at the top; and the first and last part of each letter.
        self.owner = np.full(len(self.name), -1)
        self.parts = {1: np.full(len(self.name), -1), -1: np.full(len(self.name), -1)}
        for level, of in enumerate(owners):
            here = offsets[level] + np.arange(len(of))
            above = offsets[level + 1] + of
            self.owner[here] = above
            self.parts[-1][above] = here
            self.parts[1][above[::-1]] = here[::-1]
        # Equal letters from a letter on, in either direction.
        change = np.flatnonzero(np.append(True, self.name[1:] != self.name[:-1]) | np.isin(np.arange(len(self.name)), offsets))
        ends = np.append(change[1:], len(self.name))
        run = np.repeat(np.arange(len(change)), ends - change)
        place = np.arange(len(self.name))
        self.equal = {1: ends[run] - place, -1: place - change[run] + 1}

    def _fresh(self, keys: np.ndarray) -> np.ndarray:
        found, names = np.unique(keys, return_inverse=True)
        names = names + self._next
        self._next += len(found)
        return names

    def _blocks(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        heads = np.append(True, names[1:] != names[:-1])
        if heads.all():
            return None
        at_ = np.flatnonzero(heads)
        counts = np.diff(np.append(at_, len(names)))
        replaced, many = names[at_], counts > 1
        replaced[many] = self._fresh(replaced[many] * (int(counts.max()) + 1) + counts[many])
        return heads, replaced

    def _pairs(self, names: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray] | None:
        with np.errstate(over="ignore"):
            right = (at.mix(names.astype(np.uint64) + at.U64(turn) * at.U64(0x9E3779B97F4A7C15)) & at.U64(1)) == 1
        joined = ~right[:-1] & right[1:] & (names[:-1] >= 0) & (names[1:] >= 0)
        if not joined.any():
            return None
        at_ = np.flatnonzero(joined)
        replaced = names.copy()
        replaced[at_] = self._fresh(names[at_] * self._next + names[at_ + 1])
        heads = np.append(True, ~joined)
        return heads, replaced[heads]

    def common(self, left: np.ndarray, right: np.ndarray, step: int) -> np.ndarray:
        """Number of equal words from the two places on, both included; to the left with step -1."""
        total = np.zeros(len(left), np.int64)
        query, x, y = np.arange(len(left)), left.astype(np.int64), right.astype(np.int64)
        climbing = np.ones(len(left), bool)
        parts, equal = self.parts[step], self.equal[step]
        while len(query):
            up_x, up_y = self.owner[x], self.owner[y]
            up = climbing & (up_x >= 0)
            up &= (self.name[up_x] == self.name[up_y]) & (parts[up_x] == x) & (parts[up_y] == y)
            same = ~up & (self.name[x] == self.name[y])
            down = ~up & ~same
            moved = np.minimum(equal[x], equal[y]) * same
            total[query] += moved * self.length[x]
            climbing &= ~down
            below_x, below_y = parts[x], parts[y]
            x = np.where(up, up_x, np.where(down, below_x, x + step * moved))
            y = np.where(up, up_y, np.where(down, below_y, y + step * moved))
            going = x >= 0
            query, x, y, climbing = query[going], x[going], y[going], climbing[going]
        return total


def _grids(n: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, periods): for every period up to `most` the multiples of thrice the period, in lists of bounded length.

    A run of four periods agrees with itself, one period on, in at least three periods of consecutive places, one of which
    is on the grid. The grids of all periods have n / 3 * (1 + 1/2 + 1/3 + ...) places.
    """
    periods = np.arange(1, most + 1)
    spacing = (LEAST_PERIODS - 1) * periods
    counts = -(-np.maximum(n - periods, 0) // spacing)
    upto = np.cumsum(counts)
    lo = 0
    while lo < most:
        done = upto[lo - 1] if lo else 0
        hi = max(int(np.searchsorted(upto, done + QUERIES, "right")), lo + 1)
        of = np.repeat(np.arange(lo, hi), counts[lo:hi])
        place = np.arange(len(of)) - (upto[of] - counts[of] - done)
        yield place * spacing[of], periods[of]
        lo = hi


def find_runs(words: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, smallest period) of all runs, by start and period; `longest` sequence between words below zero."""
    grammar, found = None, []
    for place, period in _grids(len(words), longest // LEAST_PERIODS):
        near = place + period
        same = (words[place] == words[near])
        place, period, near = place[same], period[same], near[same]
        # Of the places that agree around a place of the grid there is one beside it.
        same = (words[place - 1] == words[near - 1]) | (words[place + 1] == words[near + 1])
        place, period, near = place[same], period[same], near[same]
        if not len(place):
            continue
        grammar = grammar or RunLengthGrammar(words)
        ahead = grammar.common(place, near, 1)
        behind = grammar.common(place - 1, near - 1, -1)
        length = ahead + behind + period
        good = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
        found.append(np.stack([place - behind, length, period])[:, good])
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = np.concatenate(found, 1)
    # A stretch with a period has the multiples of it as well; its smallest one is on its own grid.
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])) if len(start) else np.zeros(0, bool)
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _sequences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts, ends and rows of the words; the words as numbers with separators; the place of each word among these."""
    starts, ends, rows = at.split_words(data, offsets, at.NOT_SPACE)
    n = len(offsets) - 1
    codes = np.unique(at.hash_slices(data, starts, ends), return_inverse=True)[1]
    words = np.empty(len(codes) + n + 1, np.int64)
    place = np.arange(len(codes)) + rows + 1
    bars = np.cumsum(np.append(0, np.bincount(rows, minlength=n) + 1))
    words[place], words[bars] = codes, -1 - np.arange(n + 1)
    return starts, ends, rows, words, place, bars


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    """The words of each row joined by one space."""
    gap = np.append(rows[1:] == rows[:-1], False).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    lengths = ends - starts
    to = np.cumsum(lengths + gap) - lengths - gap
    place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.full(int((lengths + gap).sum()), 32, np.uint8)
    out[np.repeat(to, lengths) + place] = data[np.repeat(starts, lengths) + place]
    sizes = np.bincount(rows, lengths + gap, n).astype(np.int64)
    bounds = np.append(0, np.cumsum(sizes))
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(bounds), pa.py_buffer(out)).cast(pa.string())


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, data, offsets in at.blocks(batch.column(1)):
            n = hi - lo
            starts, ends, rows, words, place, bars = _sequences(data, offsets)
            counts = np.diff(bars) - 1
            start, length, period = find_runs(words, int(counts.max(initial=0)))
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, start + period, 1)
            np.add.at(cover, start + length, -1)
            kept = np.cumsum(cover)[place] == 0
            row = np.searchsorted(bars, start, "right") - 1
            runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - bars[row] - 1, length, period)], fields=list(_RUN))
            bounds = np.append(0, np.cumsum(np.bincount(row, minlength=n)))
            yield pa.RecordBatch.from_arrays([
                ids.slice(lo, n), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs),
                _joined(data, starts[kept], ends[kept], rows[kept], n),
            ], schema=_SCHEMA)


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str | Column = "text") -> DataFrame:
    """Per row of `docs`: (id, n_words, runs, collapsed).

    `runs` are the maximal stretches of words with a smallest period q, at least max(6, 4 q) words long, as (start,
    length, period) by start and period, words numbered from 0. `collapsed` are the words, joined by one space, without
    those that any run has after its first q words. Whole rows of about two megabytes are handled together, a longer
    text alone, in near-linear time (n log n places to compare, a logarithmic number of steps each); nothing is shuffled.

    Words are runs of bytes other than white space, compared by 64-bit hashes. Null and empty texts have no words, no
    runs and the collapsed text ''. Null ids stay null, repeated rows are all kept and treated alike, an empty table
    gives an empty result. Matches never cross rows. Other columns are not read.
    """
    text = F.col(text_column) if isinstance(text_column, str) else text_column
    rows = docs.select(F.col(id_column).cast("long").alias("_id"), text.alias("_text"))
    return rows.mapInArrow(_find, _DDL).withColumnRenamed("_id", id_column)


def planted_text(id_column: Column, text: Column) -> Column:
    """The text with a periodic end, for one id in ten; with g = crc32 div 10, n words and a = g mod n, word i >= a becomes
    word a + (i - a) mod p, where p = 1 + (n - a) div (3 + g mod 8). A null id gets none."""
    crc = F.crc32(id_column.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    planted = F.transform(F.array(F.struct(words.alias("w"), F.floor(crc / 10).alias("g"))), lambda s: _planted(s["w"], s["g"]))[0]
    return F.when((crc % 10 == 0) & text.rlike(WORDS), planted).otherwise(text)


def _planted(words: Column, g: Column) -> Column:
    n = F.size(words).cast("long")
    a = g % n
    p = F.floor((n - a) / (g % 8 + 3)) + 1
    source = F.transform(F.sequence(a, n - 1), lambda i: F.get(words, (a + (i - a) % p).cast("int")))
    return F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), source), " ")


def with_strongest(found: DataFrame) -> DataFrame:
    """Adds n_runs, and start, length, period and exponent_milli of the run with the most periods (nulls without a run)."""
    better = ("(best, r) -> if(best is null or r.length * best.period > best.length * r.period, r, best)")  # ties: the earlier one
    best = F.expr(f"aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), {better})")
    return found.withColumn("_best", best).select(
        *found.columns, F.size("runs").cast("long").alias("n_runs"), *(F.col(f"_best.{x}").alias(x) for x in ("start", "length", "period")),
        F.expr("(1000 * _best.length) div _best.period").alias("exponent_milli"))
