"""Exact top-k inner products by branch and bound over dimension blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracklore.session import cut_lineage

K, SCALE = 10, 1024
#: Queries that are sent to all tasks at once, and dimensions added between two prunings.
QUERY_BLOCK, DIMENSIONS = 2048, 8
FOUND_DDL = "_query long, query_id long, vec_id long, score long"
LONG = (-(2**63), 2**63 - 1)


def _matrix(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """Vertical layout: one row per dimension; shorter vectors end in zeros."""
    out = np.zeros((width, len(vectors)))
    for i, v in enumerate(vectors):
        out[: len(v), i] = v
    return out


def _rest(columns: np.ndarray, steps: list[int]) -> np.ndarray:
    """Length of each vector's part from each step on."""
    return np.sqrt(np.array([np.square(columns[s:]).sum(axis=0) for s in steps]))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _exact(query: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Inner products of numbers too large for floats, as whole numbers held to the range of a long."""
    q = [int(x) for x in query]
    products = [sum(a * int(b) for a, b in zip(q, column)) for column in columns.T]
    return np.array([min(max(p, LONG[0]), LONG[1]) for p in products], object)


def _searcher(queries, k: int, scale: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, names, vectors = queries.value
        best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in names]
        for batch in batches:
            lists = batch.column(1)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            own = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
            width = max([len(v) for v in vectors] + [len(v) for v in own])
            columns, asked = _matrix(own, width), _matrix(vectors, width)
            steps = list(range(0, width, DIMENSIONS)) or [0]
            rest, asked_rest = _rest(columns, steps), _rest(asked, steps)
            top = np.abs(columns).max(initial=0) * max(width, 1)
            for j, name in enumerate(names):
                query = asked[:, j]
                alive = np.flatnonzero(ids != name)
                if top * np.abs(query).max(initial=0) >= 2.0**53:
                    scores = _exact(query, columns[:, alive])
                else:
                    least = best[j][0][-1] if len(best[j][0]) == k else -np.inf
                    scores = np.zeros(len(alive))
                    for s, start in enumerate(steps):
                        if least > -np.inf:
                            # What is still missing is at most the product of the lengths of both rests.
                            most = scores + rest[s][alive] * (asked_rest[s, j] * (1 + 1e-9))
                            keep = most >= least - 0.5
                            if not keep.all():
                                alive, scores = alive[keep], scores[keep]
                        if not len(alive):
                            break
                        stop = min(start + DIMENSIONS, width)
                        part = columns[start:stop]
                        scores = scores + query[start:stop] @ (part if len(alive) == len(ids) else part[:, alive])
                if len(alive):
                    old, old_ids = best[j]
                    best[j] = _best(np.concatenate([old, scores]), np.concatenate([old_ids, ids[alive]]), k)
        rows = [(number, name, int(i), int(s)) for number, name, (scores, found) in zip(numbers, names, best)
                for s, i in zip(scores, found)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                             ["_query", "query_id", "vec_id", "score"])

    return search


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, vector) of the rows that take part: id and vector not null, all components finite numbers."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite)


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int = K, scale: int = SCALE,
                query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries` (vec_id, vector) its `k` best rows of `candidates`.

    The score is the inner product of floor(scale * component); higher is better, ties go to the smaller id. Rows with
    the query's own id are no candidates; if fewer than `k` others exist, all are returned. Queries go out in blocks of
    `query_block`; for each block every candidate is read once. Inside a task the candidates of a batch lie column by
    column; products grow by a few dimensions at a time, and candidates whose bound falls below the k-th best so far are
    compacted away. Missing trailing components count as 0; scores beyond a long are held to its range. Repeated
    queries are answered each, repeated candidates are all ranked. Empty inputs give an empty result.
    """
    spark = queries.sparkSession
    rows = queries.select("vec_id", "vector").toLocalIterator()
    found, number = None, 0
    while block := list(islice(rows, query_block)):
        numbers = list(range(number, number + len(block)))
        number += len(block)
        sent = (numbers, [r[0] for r in block], [np.floor(np.array(r[1], np.float64) * scale) for r in block])
        part = candidates.select("vec_id", "vector").mapInArrow(_searcher(spark.sparkContext.broadcast(sent), k, scale), FOUND_DDL)
        found = cut_lineage(part) if found is None else found.unionAll(cut_lineage(part))
    if found is None:
        found = spark.createDataFrame([], FOUND_DDL)
    rank = F.row_number().over(Window.partitionBy("_query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
