"""Exact top-k inner products by MaxScore over sharded postings.

A vector is a document of terms: component d is the term ``d+`` or ``d-`` by its sign, with its magnitude as weight. A query weighs
``d+`` with its own component and ``d-`` with the negated one, so the sum over shared terms is the inner product. Terms are taken
by falling bounds (query weight times the shard's largest weight of the term). As soon as the bounds of those that are left add
up to less than the threshold, they are non-essential: a document in none of the lists before can't enter. So only the
essential lists are traversed, and the other terms are probed in the candidates while these can still reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.session import durable

from .vectors import against_shards, best, id_ranks, matrix, one_per_id, shard_count, whole_vectors

K, SCALE = 10, 1024
NOTHING = np.zeros(0, np.int64)


class Shard:
    """Postings of each term, the largest weight in each list, and the vectors for probes."""

    def __init__(self, ids: pa.Array, vectors: np.ndarray):
        self.ids, self.vectors, self.rank = ids, np.asfortranarray(vectors), id_ranks(ids)
        self.docs: list[tuple[np.ndarray, np.ndarray]] = []
        self.weights: list[tuple[np.ndarray, np.ndarray]] = []
        for d in range(vectors.shape[1]):
            column = self.vectors[:, d]
            plus, minus = np.flatnonzero(column > 0), np.flatnonzero(column < 0)
            self.docs.append((plus, minus))
            self.weights.append((column[plus], -column[minus]))
        self.largest = np.array([[w.max(initial=0) for w in pair] for pair in self.weights], np.int64).reshape(-1, 2)
        known = ids.to_numpy(zero_copy_only=False) if not ids.null_count else np.array([np.nan if i is None else i for i in ids.to_pylist()], object)
        self.known = known

    def search(self, own: int | None, query: np.ndarray, threshold: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the shard's ``k`` best rows for ``query``, without those of the id ``own`` and, with a
        ``threshold``, only of scores that reach it."""
        dims = np.flatnonzero(query[: len(self.docs)])
        sign = (query[dims] < 0).astype(int)  # the list whose weights count for the query
        bound = np.abs(query[dims]) * self.largest[dims, sign]
        order = np.argsort(-bound, kind="stable")
        dims, sign = dims[order], sign[order]
        left = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # sum of the bounds from this term on
        total = np.zeros(len(self.rank), np.int64)
        below = np.flatnonzero(left < threshold) if threshold is not None else NOTHING
        if len(below):
            essential = int(below[0])
            met = np.zeros(len(total), bool)
            for d, s in zip(dims[:essential], sign[:essential]):
                docs = self.docs[d][s]
                met[docs] = True
                total[docs] += abs(query[d]) * self.weights[d][s]
            rows = np.flatnonzero(met)
        else:  # a document in no list could still be among the best
            essential = len(dims)
            rows = np.arange(len(total))
            for d, s in zip(dims, sign):
                total[self.docs[d][s]] += abs(query[d]) * self.weights[d][s]
        partial = total[rows]
        # the opposite terms of the essential components only take away; then the non-essential ones, both signs at once
        for j in [*range(essential), *range(essential, len(dims))]:
            if threshold is not None:
                competitive = partial + left[max(j, essential)] >= threshold
                if not competitive.all():
                    rows, partial = rows[competitive], partial[competitive]
            if not len(rows):
                break
            gain = query[dims[j]] * self.vectors[rows, dims[j]]
            partial = partial + (np.minimum(gain, 0) if j < essential else gain)
        if threshold is not None:
            rows, partial = rows[partial >= threshold], partial[partial >= threshold]
        other = self.known[rows] != own
        rows, partial = rows[other], partial[other]
        at = best(partial, self.rank[rows], k)
        return rows[at], partial[at]


def _searcher(k: int):
    def run(held: list[pa.RecordBatch], asked: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for b in asked:
            if shard is None:
                rows = pa.Table.from_batches(held).combine_chunks() if held else None
                ids = rows.column("id").combine_chunks() if held else pa.array([], pa.int64())
                shard = Shard(ids, matrix(rows.column("vector").combine_chunks()) if held else np.zeros((0, 0), np.int64))
            out: list[tuple[pa.Array, pa.Array, np.ndarray]] = []
            query_ids = b.column("id").to_pylist()
            for own, query, threshold in zip(query_ids, matrix(b.column("vector")), b.column("threshold").to_pylist()):
                rows, scores = shard.search(own, query, threshold, k)
                out.append((np.full(len(rows), own, np.int64), rows, scores))
            found = [np.concatenate([o[i] for o in out]) for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), shard.ids.take(pa.array(found[1])), pa.array(found[2], pa.int64())], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, asks: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``vectors(vec_id, embedding)`` that ``asks`` picks, the ``k`` rows of highest
    inner product of the scaled whole-number vectors, equal scores by smaller id.

    Each query first searches one shard, dealt by its id; the score of the ``k``-th row found is its threshold in all others. The
    shards' lists are merged by a window that keeps ``k`` rows a task before it shuffles. A query's own row is every row
    of its id; of rows that share a query's id the smallest vector asks. A null id asks nothing and comes last among equals.
    Vectors of different lengths meet in the components they share. Empty tables give an empty result; repeated
    rows count as often as they occur."""
    rows = durable(whole_vectors(vectors, scale))
    shards = shard_count(rows)
    home = F.pmod(F.xxhash64("id", F.lit("home")), F.lit(shards)).cast("int")
    queries = durable(one_per_id(rows.where(asks & F.col("id").isNotNull())))
    shape = "query_id bigint, vec_id bigint, score bigint"
    run = _searcher(k)
    first = queries.select("id", "vector", F.lit(None).cast("bigint").alias("threshold"), F.array(home).alias("shards"))
    seen = durable(against_shards(rows, first, shards, run, shape))
    least = seen.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"))
    least = least.select(F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.col("low")).alias("threshold"))
    rest = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != home)
    then = queries.join(least, "id", "left").select("id", "vector", "threshold", rest.alias("shards"))
    found = seen.unionByName(against_shards(rows, then, shards, run, shape))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
