"""Whole-number vectors, and a stated set of queries against all of them shard by shard.

A shard is a partition: its rows come first, the queries after them as a stream. So a task holds one shard of bounded size and
one batch of queries, nothing is broadcast, and both sides may grow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a shard, about, at most and at least (fewer only where the table is small).
SHARD_ROWS, LEAST_ROWS = 32_768, 256
#: Scaled components from this magnitude on count as not finite: sums of their products could leave 64 bits.
LIMIT = 1 << 26


def whole_vectors(rows: DataFrame, scale: int, *others: Column, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id, vector, *others``: each component x becomes ``floor(scale * x)``, x as double. Vectors that are null or hold a null or
    non-finite component are left out; an empty vector is one of zeros."""
    x = F.col(vec_col)
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    fine = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double") * scale) < LIMIT))  # NaN is above all
    return rows.where(fine).select(F.col(id_col).cast("bigint").alias("id"), whole.alias("vector"), *others)


def shard_count(rows: DataFrame) -> int:
    """As many shards as shuffle partitions, if they keep ``LEAST_ROWS``, and more where they would exceed ``SHARD_ROWS``."""
    n, wanted = rows.count(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-n // SHARD_ROWS), min(wanted, -(-n // LEAST_ROWS)))


def shard_of_row(shards: int) -> Column:
    """By position in the stored table, so rows that share an identifier are spread as well."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")


def against_shards(rows: DataFrame, queries: DataFrame, shards: int, run: Callable[[list[pa.RecordBatch], Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], shape: str) -> DataFrame:
    """``run(batches of the shard's rows, stream of query batches)`` for each shard.

    ``rows`` is a stored table with the columns that ``run`` wants, ``queries`` has the same and a list ``shards`` of those it is sent to."""
    left = rows.select(shard_of_row(shards).alias("_shard"), F.lit(0).alias("_kind"), F.struct(*rows.columns).alias("_row"))
    columns = [c for c in queries.columns if c != "shards"]
    right = queries.select(F.explode("shards").alias("_shard"), F.lit(1).alias("_kind"), F.struct(*columns).alias("_query"))
    dealt = left.unionByName(right, allowMissingColumns=True).repartitionById(shards, F.col("_shard")).sortWithinPartitions("_kind")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def asked() -> Iterator[pa.RecordBatch]:
            for b in batches:
                first = int(np.searchsorted(b.column(0).to_numpy(), 1))
                if first:
                    held.append(pa.RecordBatch.from_struct_array(b.column(1).slice(0, first)))
                if first < b.num_rows:
                    yield pa.RecordBatch.from_struct_array(b.column(2).slice(first))

        stream = asked()
        ahead = next(stream, None)
        if ahead is not None:
            yield from run(held, (b for part in ((ahead,), stream) for b in part))

    return dealt.select("_kind", "_row", "_query").mapInArrow(task, shape)


def matrix(vectors: pa.Array, width: int = 0) -> np.ndarray:
    """One row a vector, shorter ones filled up with zeros."""
    lengths = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.zeros(0, np.int64)
    width = max(width, int(lengths.max(initial=0)))
    out = np.zeros((len(vectors), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def one_per_id(queries: DataFrame) -> DataFrame:
    """Of rows that share an identifier the one with the smallest values asks."""
    others = [c for c in queries.columns if c != "id"]
    return queries.groupBy("id").agg(F.min(F.struct(*others)).alias("_first")).select("id", *(F.col(f"_first.{c}").alias(c) for c in others))


def best(scores: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores in order, equal ones by smaller rank. ``rank`` is distinct."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores > edge)
        even = np.flatnonzero(scores == edge)
        if len(even) > k - len(at):
            even = even[np.argpartition(rank[even], k - len(at) - 1)[: k - len(at)]] if k > len(at) else even[:0]
        at = np.concatenate((at, even))
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((rank[at], -scores[at]))]


def id_ranks(ids: pa.Array) -> np.ndarray:
    """Distinct ranks in ascending order of the ids, nulls last."""
    out = np.empty(len(ids), np.int64)
    out[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
    return out
