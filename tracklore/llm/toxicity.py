"""Toxicity scores from a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklore.llm import arrow_text as at
from tracklore.llm.stages import discard, store

#: Hash buckets for terms; lengths in bytes of the word beginnings that are terms beside the whole words.
BUCKET_BITS, PREFIXES = 20, (3, 4, 5, 6)
#: Bounds of the fit: labelled documents, terms kept by the screening, factors per term.
MOST_DOCS, MOST_TERMS, FACTORS = 20_000, 2_048, 4
LEAST_DOCS, LEAST_Z, CUT = 4, 5.0, 0.7
EPOCHS, RATE, DECAY = 60, 0.1, 1e-4
#: Pairs of words: how far apart among the words that enough documents have, bits of the table that finds where a pair
#: stands out, standard errors that it has to, and pairs whose words are kept.
REACH, PAIR_BITS, LEAST_PAIR_Z, MOST_PAIRS = 8, 20, 7.0, 256
#: Documents with the overall rate that smooth the rate of a word; table places in a page; bytes of text whose pairs are
#: held at once.
PRIOR, PAGE, PAIR_BYTES = 10.0, 1 << 12, 1 << 18


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs: whole lower-case words, and their first bytes as beginnings."""
    starts, ends, rows = at.split_words(data, offsets, at.ALPHANUMERIC)
    low = at.LOWER[data]
    found, owner = [at.hash_slices(low, starts, ends)], [rows]
    for size in PREFIXES:
        long_enough = ends - starts > size
        begin = starts[long_enough]
        found.append(at.mix(at.hash_slices(low, begin, begin + size) + np.uint64(size)))
        owner.append(rows[long_enough])
    shift = np.uint64(64 - BUCKET_BITS)
    pairs = np.unique((np.concatenate(owner).astype(np.uint64) << np.uint64(BUCKET_BITS)) | (np.concatenate(found) >> shift))
    return (pairs >> np.uint64(BUCKET_BITS)).astype(np.int64), (pairs & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket: documents of a task that have it, in all and among the toxic."""
    seen = np.zeros((2, 1 << BUCKET_BITS), np.int32)
    for batch in batches:
        toxic = batch.column(0).to_numpy(zero_copy_only=False)
        for lo, _hi, data, offsets in at.blocks(batch.column(1)):
            rows, buckets = _terms(data, offsets)
            seen[0] += np.bincount(buckets, minlength=1 << BUCKET_BITS).astype(np.int32)
            seen[1] += np.bincount(buckets[toxic[lo + rows] == 1], minlength=1 << BUCKET_BITS).astype(np.int32)
    at_ = np.flatnonzero(seen[0])
    for i in range(0, len(at_), 100_000):
        part = at_[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(seen[0][part], pa.int64()),
                                          pa.array(seen[1][part], pa.int64())], ["bucket", "n", "n_toxic"])


def _lookup(kept: np.ndarray) -> np.ndarray:
    table = np.full(1 << BUCKET_BITS, -1, np.int32)
    table[kept] = np.arange(len(kept))
    return table


def _word_pairs(data: np.ndarray, offsets: np.ndarray, rates: np.ndarray,
                wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, lesser bucket, greater bucket) of different words with a rate, near each other in a text.

    With `wanted`, only the pairs whose place in the table it marks.
    """
    starts, ends, rows = at.split_words(data, offsets, at.ALPHANUMERIC)
    words = (at.hash_slices(at.LOWER[data], starts, ends) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    known = ~np.isnan(rates[words])
    rows, words = rows[known].astype(np.int64), words[known]
    found = [np.zeros(0, np.int64)]
    for step in range(1, REACH + 1):
        first = np.flatnonzero(rows[:-step] == rows[step:]) if len(rows) > step else np.zeros(0, np.int64)
        a, b = words[first], words[first + step]
        less, more = np.minimum(a, b), np.maximum(a, b)
        taken = a != b if wanted is None else (a != b) & wanted[_place(less, more)]
        found.append(((rows[first] << (2 * BUCKET_BITS)) | (less << BUCKET_BITS) | more)[taken])
    pairs, mask = np.unique(np.concatenate(found)), (1 << BUCKET_BITS) - 1
    return pairs >> (2 * BUCKET_BITS), (pairs >> BUCKET_BITS) & mask, pairs & mask


def _place(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    key = (a.astype(np.uint64) << np.uint64(BUCKET_BITS)) | b.astype(np.uint64)
    return (at.mix(key) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def _count_pairs(sent):
    """Pages of a table of fixed size: documents with a pair, toxic ones, and how many its two words let expect at most, at least."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rates = sent.value
        seen = np.zeros((1 << PAIR_BITS, 4), np.float32)
        for batch in batches:
            toxic = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _hi, data, offsets in at.blocks(batch.column(1), PAIR_BYTES):
                rows, a, b = _word_pairs(data, offsets, rates)
                order = np.argsort(place := _place(a, b))
                rows, a, b, place = rows[order], a[order], b[order], place[order]
                first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, int)
                of_two = np.stack([rates[a], rates[b]])
                for k, weight in enumerate((np.ones(len(place)), toxic[lo + rows], of_two.max(axis=0), of_two.min(axis=0))):
                    if len(first):
                        seen[place[first], k] += np.add.reduceat(weight, first)
        pages = seen.reshape(-1, PAGE * 4)
        used = np.flatnonzero(pages.any(axis=1))
        for k in used:
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([pages[k].tobytes()], pa.binary())], ["page", "sums"])

    return count


def _excess(n, toxic, high, low):
    """Standard errors by which the toxic documents are beyond what the likelier, or below what the less likely word explains."""
    above = (toxic - high) / np.sqrt(high * np.maximum(1 - high / np.maximum(n, 1), 0) + 0.25)
    below = (low - toxic) / np.sqrt(low * np.maximum(1 - low / np.maximum(n, 1), 0) + 0.25)
    return np.maximum(above, below)


def _places(table: pa.Table) -> pa.Table:
    """Places of a page where pairs stand out."""
    sums = sum(np.frombuffer(x, np.float32).reshape(PAGE, 4).astype(np.float64) for x in table["sums"].to_pylist())
    z = _excess(*sums.T)
    out = np.flatnonzero((sums[:, 0] >= LEAST_DOCS) & (z >= LEAST_PAIR_Z))
    return pa.table({"place": pa.array(out + table["page"][0].as_py() * PAGE, pa.int64()), "z": pa.array(z[out], pa.float64())})


def _pairs_at(sent):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rates, wanted = sent.value
        for batch in batches:
            toxic = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _hi, data, offsets in at.blocks(batch.column(1), PAIR_BYTES):
                rows, a, b = _word_pairs(data, offsets, rates, wanted)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(toxic[lo + rows], pa.int64())], ["a", "b", "toxic"])

    return pairs


def _paired_words(sample: DataFrame, counts: DataFrame, base: float) -> np.ndarray:
    """Buckets of words that tell nothing alone but near each other.

    A pair counts if its documents are toxic more often than those of either word, or less often, by `LEAST_PAIR_Z`
    standard errors: first by a table of hashed pairs, whose size is fixed, then by itself.
    """
    context = sample.sparkSession.sparkContext
    known = counts.where(F.col("n") >= LEAST_DOCS).select(
        F.col("bucket").cast("int"), ((F.col("n_toxic") + PRIOR * base) / (F.col("n") + PRIOR)).cast("float").alias("rate")).toArrow()
    rates = np.full(1 << BUCKET_BITS, np.nan, np.float32)
    rates[known["bucket"].to_numpy()] = known["rate"].to_numpy()
    sent = context.broadcast(rates)
    table = sample.mapInArrow(_count_pairs(sent), "page long, sums binary")
    places = table.groupBy("page").applyInArrow(_places, "place long, z double").orderBy(F.desc("z"), "place").limit(MOST_PAIRS)
    wanted = np.zeros(1 << PAIR_BITS, bool)
    wanted[[r[0] for r in places.select("place").collect()]] = True
    sent.destroy()
    if not wanted.any():
        return np.zeros(0, np.int64)
    sent = context.broadcast((rates, wanted))
    exact = sample.mapInArrow(_pairs_at(sent), "a long, b long, toxic long").groupBy("a", "b").agg(
        F.count("*").alias("n"), F.sum("toxic").alias("toxic")).where(F.col("n") >= LEAST_DOCS).toArrow()
    sent.destroy()
    a, b, n, toxic = (exact[c].to_numpy().astype(np.int64) for c in ("a", "b", "n", "toxic"))
    z = _excess(n, toxic, n * np.maximum(rates[a], rates[b]), n * np.minimum(rates[a], rates[b]))
    best = np.lexsort((b, a, -z))[: min(MOST_PAIRS, int((z >= LEAST_PAIR_Z).sum()))]
    return np.unique(np.concatenate([a[best], b[best]]))


def _known_terms(sent):
    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _lookup(sent.value)
        for batch in batches:
            for lo, hi, data, offsets in at.blocks(batch.column(1)):
                rows, buckets = _terms(data, offsets)
                terms = table[buckets]
                rows, terms = rows[terms >= 0], terms[terms >= 0]
                bounds = np.searchsorted(rows, np.arange(hi - lo + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(terms, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], ["toxic", "terms"])

    return known


class FactorizationMachine:
    """Logistic model of weights per term and of products of factors for each pair of terms in a document."""

    def __init__(self, terms: int, factors: int = FACTORS, seed: int = 3) -> None:
        draw = np.random.default_rng(seed)
        self.bias, self.weights = 0.0, np.zeros(terms)
        self.factors = draw.normal(0, 0.05, (terms, factors))

    def margins(self, rows: np.ndarray, terms: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Margin of each of `n` documents, and the sums of factors it needs; (rows, terms) are distinct pairs."""
        sums = np.stack([np.bincount(rows, f[terms], n) for f in self.factors.T], axis=1) if n else np.zeros((0, self.factors.shape[1]))
        squares = np.bincount(rows, np.square(self.factors).sum(axis=1)[terms], n)
        pairs = 0.5 * (np.square(sums).sum(axis=1) - squares)
        return self.bias + np.bincount(rows, self.weights[terms], n) + pairs, sums

    def fit(self, rows: np.ndarray, terms: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS) -> None:
        """Full-batch Adam on the mean log loss; both classes weigh the same."""
        n, k = len(labels), len(self.weights)
        positive = max(labels.sum(), 1)
        share = np.where(labels == 1, 0.5 / positive, 0.5 / max(n - positive, 1))
        moments = [np.zeros((2, 1)), np.zeros((2, k)), np.zeros((2, *self.factors.shape))]
        for step in range(1, epochs + 1):
            margin, sums = self.margins(rows, terms, n)
            slope = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - labels) * share
            each = slope[rows]
            by_term = np.bincount(terms, each, k)
            crossed = np.stack([np.bincount(terms, each * s[rows], k) for s in sums.T], axis=1)
            grads = [np.array([slope.sum()]), by_term + DECAY * self.weights,
                     crossed - by_term[:, None] * self.factors + DECAY * self.factors]
            moves = []
            for grad, moment in zip(grads, moments):
                moment[0] = 0.9 * moment[0] + 0.1 * grad
                moment[1] = 0.999 * moment[1] + 0.001 * np.square(grad)
                moves.append(RATE * (moment[0] / (1 - 0.9**step)) / (np.sqrt(moment[1] / (1 - 0.999**step)) + 1e-9))
            self.bias -= float(moves[0][0])
            self.weights -= moves[1]
            self.factors -= moves[2]


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 label_column: str = "toxic", most_docs: int = MOST_DOCS) -> tuple[np.ndarray, FactorizationMachine]:
    """Kept buckets and model, learnt from labelled rows whose id is not held out.

    At most `most_docs` labelled documents, those with the smallest hashed ids, are used; conflicting labels of an id
    count as toxic. Terms stay if they are in at least `LEAST_DOCS` of these documents and more frequent among the toxic
    than among the others by `LEAST_Z` standard errors, the `MOST_TERMS` clearest at most; words of the `MOST_PAIRS`
    clearest pairs that are toxic more or less often than either word stay as well, whatever they tell alone. Without
    documents of both classes no term stays and every score is the share of toxic labels.
    """
    spark = docs.sparkSession
    rows = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & ~held_out(F.col(id_column)))
    chosen = (
        rows.groupBy(F.col(id_column).alias("_id")).agg(F.max(F.col(label_column).cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("_id"), "_id").limit(most_docs)
    )
    texts = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    sample = store(texts.join(F.broadcast(chosen), "_id").select("toxic", "_text"))
    totals = chosen.agg(F.count("*"), F.sum("toxic")).first()
    n, positive = totals[0], totals[1] or 0
    if not positive or positive == n:
        discard(sample)
        model = FactorizationMachine(0)
        model.bias = 50.0 if positive else -50.0
        return np.zeros(0, np.int64), model
    counts = sample.mapInArrow(_count_terms, "bucket long, n long, n_toxic long").groupBy("bucket").agg(
        F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
    p, q = F.col("n_toxic") / positive, (F.col("n") - F.col("n_toxic")) / (n - positive)
    rate = F.col("n") / n
    z = (p - q) / F.sqrt(rate * (1 - rate) * (1 / positive + 1 / (n - positive)) + 1e-12)
    clearest = counts.where((F.col("n") >= LEAST_DOCS) & (z >= LEAST_Z)).orderBy(F.desc(z), "bucket").limit(MOST_TERMS)
    alone = np.array([r[0] for r in clearest.select("bucket").collect()], np.int64)
    kept = np.union1d(alone, _paired_words(sample, counts, positive / n))
    sent = spark.sparkContext.broadcast(kept)
    known = sample.mapInArrow(_known_terms(sent), "toxic int, terms array<int>")
    # Only the kept terms of the bounded sample reach the driver.
    fitted = known.toArrow().combine_chunks()
    sent.destroy()
    discard(sample)
    lists = fitted.column("terms").combine_chunks() if fitted.num_rows else pa.array([], pa.list_(pa.int32()))
    lengths = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    model = FactorizationMachine(len(kept))
    model.fit(np.repeat(np.arange(len(lengths)), lengths), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
              fitted.column("toxic").to_numpy().astype(np.float64))
    return kept, model


def _scorer(sent):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, model = sent.value
        table = _lookup(kept)
        for batch in batches:
            for lo, hi, data, offsets in at.blocks(batch.column(batch.num_columns - 1)):
                rows, buckets = _terms(data, offsets)
                terms = table[buckets]
                margin, _sums = model.margins(rows[terms >= 0], terms[terms >= 0], hi - lo)
                scores = pa.array(1 / (1 + np.exp(-np.clip(margin, -50, 50))), pa.float64())
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), scores],
                                                 [*batch.schema.names, "score"])

    return score


def score_toxicity(docs: DataFrame, fitted: tuple[np.ndarray, FactorizationMachine], text_column: str = "text") -> DataFrame:
    """All rows of `docs` as (doc struct, score, predicted): 1 if the score is at least `CUT`.

    The whole text is scored and nothing else; null and empty texts have no terms and get the model's base score.
    Repeated rows score alike. An empty table gives an empty result. Columns of any name are kept inside `doc`.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fitted)
    packed = docs.select(F.struct("*").alias("doc"), F.col(text_column).alias("_text"))
    doc_type = packed.schema["doc"].dataType.simpleString()
    scored = packed.mapInArrow(_scorer(sent), f"doc {doc_type}, _text string, score double")
    return scored.select("doc", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
