"""Near copies by word shingles: min-hash bands propose groups, the exact Jaccard similarity of the shingle sets decides, components group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmill.session import durable

from .chunks import slices
from .components import connected_components
from .tables import located, sized, without_rows
from .workers import frugal

#: Words of a shingle, and the Jaccard similarity from which on two texts are near copies.
WORDS, SIMILARITY = 5, 0.8
#: Min-hashes of a band, and bands. A pair at 0.8 shares no band with a probability of (1 - 0.8^5)^32, about 3 in 10^6.
ROWS, BANDS = 5, 32
#: Texts, and bytes of their shingle sets, that are compared with each other at once; larger groups are dealt out in parts.
GROUP, GROUP_BYTES = 2048, 8 << 20
#: Texts of a larger group, about, that each of its parts holds besides its own: fewer, but not below the second, if they are very long.
PIVOTS, LEAST_PIVOTS = 16, 4
#: Shingles that are hashed at a time.
CHUNK = 4096
#: Odd factors of the min-hashes.
FACTORS = np.random.default_rng(5).integers(0, 2**64, ROWS * BANDS, np.uint64) | np.uint64(1)


def shingles(text: str) -> np.ndarray:
    """Sorted XXH64 of the distinct shingles; a shorter text is one shingle, a text without words has none."""
    import xxhash

    words = text.encode().lower().split()  # bytes: A-Z only, and exactly the six ASCII spaces
    if not words:
        return np.zeros(0, np.uint64)
    grams = zip(*(words[k:] for k in range(WORDS))) if len(words) >= WORDS else [words]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(g)) for g in grams), np.uint64))


def bands(own: np.ndarray) -> list[int]:
    """One number per band; none without shingles."""
    import xxhash

    if not len(own):
        return []
    low = np.full(ROWS * BANDS, 2**64 - 1, np.uint64)
    for at in range(0, len(own), CHUNK):
        low = np.minimum(low, (own[at : at + CHUNK, None] * FACTORS[None, :]).min(axis=0))
    return [xxhash.xxh64_intdigest(low[k * ROWS : (k + 1) * ROWS].tobytes(), k) - 2**63 for k in range(BANDS)]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        for b in slices(batch, 1):
            sets = [shingles(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))], ["key", "node", "size", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in slices(batch, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["node", "own"])


def linked(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A star per connected part of the pairs that are similar enough: as good as all pairs for reachability, and never
    more than there are sets."""
    out, rest = [], list(range(len(sets)))
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        front = [root]
        flat = None
        while front and rest:
            if flat is None:
                sizes = np.array([len(sets[i]) for i in rest])
                flat, starts = np.concatenate([sets[i] for i in rest]), np.cumsum([0, *sizes[:-1]])
            one = sets[front.pop()]
            hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
            both = np.add.reduceat(hit.astype(np.int64), starts)
            close = both / (len(one) + sizes - both) >= SIMILARITY
            if close.any():
                reached = [i for i, c in zip(rest, close) if c]
                out += [(root, i) for i in reached]
                front += reached
                rest, flat = [i for i, c in zip(rest, close) if not c], None
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside each group of a stream ``group, node, own`` that is sorted by group; one group is held at a time."""
    group, members = None, {}

    def met() -> list[tuple[bytes, bytes]]:
        nodes = sorted(members)
        return [(nodes[x], nodes[y]) for x, y in linked([np.frombuffer(members[n], np.uint64) for n in nodes])]

    def batch(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)], ["a", "b"])

    for b in batches:
        rows: list[tuple[bytes, bytes]] = []
        groups = b.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), b.num_rows]
        for low, high in zip(edges[:-1], edges[1:]):
            if low < high and groups[low] != group:
                rows += met()
                group, members = groups[low], {}
            part = b.slice(low, high - low)
            members.update(zip(part.column(1).to_pylist(), part.column(2).to_pylist()))
        yield batch(rows)
    yield batch(met())


def _compared(members: DataFrame, sets: DataFrame, *group: str) -> DataFrame:
    """Links inside each group. A pair shares many bands, so groups of the same nodes are met once, before sets are sent.

    Groups are sorted streams, not rows: Spark may spill them, and a task holds no more than one."""
    same = members.groupBy(*group).agg(F.array_sort(F.collect_set("node")).alias("nodes")).select("nodes").where(F.size("nodes") > 1).distinct()
    one = same.select(F.xxhash64("nodes").alias("group"), F.explode("nodes").alias("node"))  # lists that collide are compared as one group
    dealt = one.join(sets, "node").select("group", "node", "own").repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(frugal(_links), "a binary, b binary")


def _parts(n: str, size: str) -> Column:
    return F.greatest(F.ceil(F.col(n) / GROUP), F.ceil(F.col(size) * 8 / GROUP_BYTES))


def links(keys: DataFrame, sets: DataFrame) -> DataFrame:
    """Stored links ``(a, b)`` that connect what all similar pairs that share a bucket connect; ``keys(bucket, node, size)`` are
    distinct, ``size`` is the number of the node's shingles.

    A bucket of up to ``GROUP`` nodes and ``GROUP_BYTES`` is compared whole. The nodes of a larger one are dealt out in parts, to
    each of which go the same few pivots. Nodes that are not connected with most of their bucket then meet all of it, part
    by part, so nothing is capped, and the work grows with the square only of what is not connected."""
    sizes = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).where("n > 1")
    sizes = durable(sizes.select("bucket", "n", "size", _parts("n", "size").alias("parts")))
    parts = keys.drop("size").join(sizes, "bucket")
    hash_of = F.xxhash64("node")
    few, least = F.floor(F.col("n") / PIVOTS), F.greatest(F.floor(F.col("n") / LEAST_PIVOTS), F.lit(1))
    each = F.least(F.greatest(few, F.floor(F.col("size") * 8 / GROUP_BYTES)), least)
    pivot = (F.col("parts") > 1) & (F.pmod(F.xxhash64("node", F.lit("pivot")), F.greatest(each, F.lit(1))) == 0)
    own = F.pmod(hash_of, F.col("parts"))
    dealt = parts.withColumn("part", F.explode(F.when(pivot, F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).otherwise(F.array(own))))
    found = durable(_compared(dealt.select("bucket", "part", "node"), sets, "bucket", "part"))
    hot = sizes.where("parts > 1").select("bucket")
    if hot.isEmpty():
        return found
    names = durable(connected_components(found))
    members = durable(keys.join(sized(durable(hot)), "bucket").join(names, "node", "left").select("bucket", "node", "size", F.coalesce("component", "node").alias("component")))
    counts = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    most = counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max_by(F.struct("component", "n", "size"), F.struct("n", "component")).alias("most"))
    most = most.withColumn("away", F.col("n") - F.col("most.n")).withColumn("away_size", F.col("size") - F.col("most.size")).where("away > 0")
    most = durable(most.select("bucket", "most.component", _parts("n", "size").alias("parts"), _parts("away", "away_size").alias("strays")).withColumnRenamed("component", "most"))
    if most.isEmpty():
        return found
    members = members.drop("size").join(sized(most), "bucket").withColumn("h", F.pmod(hash_of, F.lit(2**31)))
    zero = F.lit(0).cast("bigint")
    every = members.withColumn("stray", F.explode(F.sequence(zero, F.col("strays") - 1))).select("bucket", "stray", F.pmod("h", "parts").alias("part"), "node")
    strays = members.where("component != most").withColumn("part", F.explode(F.sequence(zero, F.col("parts") - 1))).select("bucket", F.pmod("h", "strays").alias("stray"), "part", "node")
    return found.unionByName(_compared(every.unionByName(strays), sets, "bucket", "stray", "part"))


def copies(rows: DataFrame) -> DataFrame:
    """``key, component`` of each of ``rows(key, text)``: the smallest key reachable over similar pairs, itself included. Keys are distinct.

    Equal sets of shingles are one node, that of texts without words among them."""
    sketch = durable(rows.mapInArrow(frugal(_sketches), f"key {rows.schema['key'].dataType.simpleString()}, node binary, size bigint, bands array<bigint>"))
    nodes = durable(sketch.groupBy("node").agg(F.min("key").alias("low"), F.min("size").alias("size"), F.min("bands").alias("bands")))
    keys = nodes.select(F.explode("bands").alias("bucket"), "node", "size")
    shared = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    keys = durable(keys.join(shared, "bucket"))
    wanted = durable(keys.select("node").distinct().join(nodes.select("node", F.col("low").alias("key")), "node"))
    sets = durable(rows.join(sized(wanted), "key").select("node", "text").mapInArrow(frugal(_sets), "node binary, own binary"))
    parts = durable(connected_components(links(keys, sets)))
    nodes = nodes.join(parts, "node", "left").select("node", "low", F.coalesce("component", "node").alias("part"))
    names = nodes.groupBy("part").agg(F.min("low").alias("component"))
    return sketch.select("key", "node").join(nodes.select("node", "part").join(names, "part").select("node", "component"), "node").select("key", "component")


def kept_documents(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with one row of each component of near copies: the one with the smallest identifier (of
    equal ones, the first in the files; a null identifier only where there is no other)."""
    rows, at = located(docs)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(at).alias("at"))
    found = copies(rows.select(key.alias("key"), F.coalesce("text", F.lit("")).alias("text")))
    return without_rows(rows, durable(found.where(F.col("key") != F.col("component")).select("key.at")), at)
