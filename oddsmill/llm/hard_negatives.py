"""Hard negatives by exact scores that are looked up in Four-Russians tables.

An anchor's components are cut into groups of eight, and the sums of all 256 subsets of a group are laid down in a table. Candidates are
kept as bit planes of their two's complement, packed so that a byte holds one plane of one group. A byte indexes the group's
table, the sums of all groups are one plane's share of the inner product, and shifting and adding from the sign plane
down gives the whole of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.session import durable

from .vectors import against_shards, best, id_ranks, matrix, one_per_id, shard_count, whole_vectors

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: A negative's score lies between these percentages of the positive's.
LOW, HIGH = 30, 90
GROUP = 8
#: Anchors whose tables are used at once, and candidates that are looked up at once: tables and sums stay in the cache.
ANCHORS, ROWS = 64, 4_096


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """``table[group, byte, anchor]``: the sum of the anchor's components whose bit is set in the byte. Bit 7 is the first component."""
    n, width = anchors.shape
    parts = np.zeros((n, -(-width // GROUP) * GROUP), anchors.dtype)
    parts[:, :width] = anchors
    parts = parts.reshape(n, -1, GROUP)
    table = np.zeros((parts.shape[1], 1 << GROUP, n), anchors.dtype)
    for bit in range(GROUP):
        table[:, 1 << bit : 2 << bit] = table[:, : 1 << bit] + parts[:, :, GROUP - 1 - bit].T[:, None, :]
    return table


def bit_planes(vectors: np.ndarray) -> np.ndarray:
    """``planes[plane, group, row]``, the sign plane first, as many planes as the largest component needs."""
    most = int(max(vectors.max(initial=0), -(vectors.min(initial=0) + 1)))
    planes = most.bit_length() + 1
    out = [np.packbits((vectors >> p & 1).astype(np.uint8), axis=1).T for p in reversed(range(planes))]
    return np.ascontiguousarray(np.stack(out))


def scores(table: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Exact inner products, by row and anchor."""
    total = np.zeros((planes.shape[2], table.shape[2]), table.dtype)
    looked_up = np.empty_like(total)
    for p in range(planes.shape[0]):
        total <<= 1
        for g in range(min(planes.shape[1], table.shape[0])):
            np.take(table[g], planes[p, g], axis=0, out=looked_up, mode="clip")
            if p:
                total += looked_up
            else:  # the sign plane weighs negatively
                total -= looked_up
    return total


class Shard:
    def __init__(self, held: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(held).combine_chunks() if held else None
        self.ids = rows.column("id").combine_chunks() if held else pa.array([], pa.int64())
        vectors = matrix(rows.column("vector").combine_chunks()) if held else np.zeros((0, 0), np.int64)
        self.labels = rows.column("label").to_numpy() if held else np.zeros(0, np.int64)
        self.known = np.array([np.nan if i is None else i for i in self.ids.to_pylist()], object) if self.ids.null_count else self.ids.to_numpy()
        self.rank = id_ranks(self.ids)
        self.largest, self.width = int(np.abs(vectors).max(initial=0)), vectors.shape[1]
        self.planes = [bit_planes(vectors[at : at + ROWS]) for at in range(0, len(vectors), ROWS)]

    def scored(self, anchors: np.ndarray) -> np.ndarray:
        """Scores of all rows by anchor, as int64; the sums are held in 32 bits where they fit."""
        bound = self.largest * int(np.abs(anchors).sum(axis=1).max(initial=0)) * 2
        table = subset_sums(anchors.astype(np.int32 if bound < 2**31 else np.int64))
        parts = [np.ascontiguousarray(scores(table, p).T) for p in self.planes]
        return np.concatenate(parts, axis=1).astype(np.int64) if parts else np.zeros((len(anchors), 0), np.int64)


#: From a shard, an anchor and its scores: numbers of lists, and the rows of each.
Pick = Callable[[Shard, dict, np.ndarray], Iterator[tuple[int, np.ndarray]]]


def _miner(pick: Pick):
    """Emits ``anchor_id, place, vec_id, score`` of what ``pick`` chooses from an anchor's scores over one shard."""

    def run(held: list[pa.RecordBatch], asked: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in asked:
            shard = shard or Shard(held)
            for at in range(0, batch.num_rows, ANCHORS):
                b = batch.slice(at, ANCHORS)
                others = b.drop_columns(["vector"]).to_pylist()
                found = [(a["id"], place, rows, total[rows]) for a, total in zip(others, shard.scored(matrix(b.column("vector")))) for place, rows in pick(shard, a, total)]
                counts = [len(f[2]) for f in found]
                rows = np.concatenate([f[2] for f in found]).astype(np.int64) if found else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([f[0] for f in found], counts).astype(np.int64)), pa.array(np.repeat([f[1] for f in found], counts).astype(np.int32)), shard.ids.take(pa.array(rows)), pa.array(np.concatenate([f[3] for f in found]) if found else rows, pa.int64())],
                    ["anchor_id", "place", "vec_id", "score"],
                )

    return run


def _positives(k: int) -> Pick:
    def pick(shard: Shard, anchor: dict, total: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        rows = np.flatnonzero((shard.labels == anchor["label"]) & (shard.known != anchor["id"]))
        yield 0, rows[best(total[rows], shard.rank[rows], k)]

    return pick


def _negatives(k: int, low: int, high: int) -> Pick:
    def pick(shard: Shard, anchor: dict, total: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        rows = np.flatnonzero((shard.labels != anchor["label"]) & (shard.known != anchor["id"]))
        own = 100 * total[rows]
        for positive in anchor["positives"]:
            inside = rows[(own >= low * positive["score"]) & (own <= high * positive["score"])]
            yield positive["rank"], inside[best(total[inside], shard.rank[inside], k)]

    return pick


def _first(found: DataFrame, keys: list[str], k: int, name: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def mine(vectors: DataFrame, asks: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows of ``vectors(vec_id, embedding)`` that ``asks`` (over ``id``) picks, labelled by ``label`` (over the columns of
    ``vectors``). An anchor's positives are its first ``positives`` other rows of the same label, the negatives of each the
    first ``negatives`` rows of other labels whose score lies between ``low`` and ``high`` percent of the positive's.
    Higher scores come first, equal ones by smaller id. Both are mined by a pass over all shards, so scores are looked up
    twice and never stored. Rows without a label or a whole finite vector take no part; every row of an anchor's id is its own,
    and of those the smallest (label, vector) asks; a null id asks nothing and comes last among equals. A positive of score
    zero or less has no negatives but those of score zero for zero. Repeated rows count as often as they occur; empty
    tables give an empty result."""
    rows = durable(whole_vectors(vectors, scale, label.cast("bigint").alias("label")).where(F.col("label").isNotNull()))
    shards = shard_count(rows)
    everywhere = F.sequence(F.lit(0), F.lit(shards - 1)).alias("shards")
    anchors = durable(one_per_id(rows.where(asks & F.col("id").isNotNull()).select("id", "label", "vector")))
    shape = "anchor_id bigint, place int, vec_id bigint, score bigint"
    near = _first(against_shards(rows, anchors.select("*", everywhere), shards, _miner(_positives(positives)), shape), ["anchor_id"], positives, "n")
    near = durable(near.select(F.col("anchor_id").alias("id"), F.col("n").alias("place"), "vec_id", "score"))
    lists = near.groupBy("id").agg(F.collect_list(F.struct(F.col("place").alias("rank"), "score")).alias("positives"))  # a few per anchor
    asked = anchors.join(lists, "id").select("*", everywhere)
    far = _first(against_shards(rows, asked, shards, _miner(_negatives(negatives, low, high)), shape), ["anchor_id", "place"], negatives, "rank")
    both = far.select(F.col("anchor_id").alias("id"), "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(near, ["id", "place"])
    return both.select(F.col("id").alias("anchor_id"), F.col("vec_id").alias("positive_id"), "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")
