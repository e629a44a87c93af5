"""SimHash near-duplicates: pigeonhole blocks propose pairs, Hamming distance decides, components group."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmill.session import durable

from .components import connected_components
from .tables import keyed_text, located, without_rows
from .workers import frugal

#: Bits in which linked fingerprints may differ.
DISTANCE = 3
#: Parts into which the free bits are split; any ``DISTANCE`` differing bits leave ``PARTS - DISTANCE`` of them alike.
PARTS = 5
#: Distinct fingerprints that are compared with each other in one task; larger groups are split by more blocks.
GROUP = 2048
#: Shingles whose bits are counted at a time.
CHUNK = 65_536


def fingerprint(text: str) -> int:
    """64 majority bits over the XXH64 (seed 42) of all 3-word shingles, repeats included, as a signed integer."""
    import xxhash

    words = text.encode().lower().split()  # bytes: A-Z only, and exactly the six ASCII spaces
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    n = max(1, len(words) - 2)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : min(at + CHUNK, n) + 2]
        hashes = [h(b" ".join(s), 42) for s in zip(part, part[1:], part[2:])] if len(words) > 2 else [h(b" ".join(words), 42)]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > n).view(">i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t) for t in b.column(1).to_pylist()], pa.int64())], ["key", "fp"])


def fingerprints(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, fp)`` of each row of ``docs(key, text)``."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), "text").mapInArrow(frugal(_fingerprints), f"key {kind}, fp bigint")


def block_masks(mask: int) -> list[int]:
    """The masks that fix two more fifths of the bits that ``mask`` leaves free. Two numbers that agree on ``mask`` and
    differ in at most three bits agree on one of them at least."""
    free = [i for i in range(64) if not mask >> i & 1]
    parts = [sum(1 << int(i) for i in p) for p in np.array_split(free, PARTS)]
    return [mask | sum(c) for c in combinations(parts, PARTS - DISTANCE)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each group of fingerprints, a star per connected part of the links inside it: as good as all links for
    reachability, and never more rows than members."""
    for b in batches:
        left: list[int] = []
        right: list[int] = []
        for members in b.column(0):
            x = np.sort(np.asarray(members.as_py(), np.int64)).view(np.uint64)
            while len(x):
                root, front, rest = x[0], x[:1], x[1:]
                while len(front) and len(rest):
                    close = np.zeros(len(rest), bool)
                    for at in range(0, len(front), 256):  # every member is compared once with those not yet reached
                        close |= (np.bitwise_count(front[at : at + 256, None] ^ rest[None, :]) <= DISTANCE).any(axis=0)
                    front, rest = rest[close], rest[~close]
                    right += front.view(np.int64).tolist()
                    left += [int(root.astype(np.int64))] * len(front)
                x = rest
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between the distinct fingerprints ``distinct(fp)`` that connect exactly what all pairs within
    the distance connect.

    Fingerprints join on (mask, masked bits). Groups of up to ``GROUP`` are compared whole; the members of a larger one
    go on to the next level, where the bits still free are split again, until at most 14 are free and a group has
    at most 2^14 members by its nature. Nothing is capped, and no group is gathered before its size is known."""
    spark = distinct.sparkSession
    level, rows, links = [0], distinct.select("fp", F.lit(0).cast("bigint").alias("mask")), None
    while True:
        finer = {m: block_masks(m) for m in level}
        steps = spark.createDataFrame([(_signed(m), [_signed(x) for x in v]) for m, v in finer.items()], "mask bigint, masks array<bigint>")
        keys = rows.join(F.broadcast(steps), "mask").select("fp", F.explode("masks").alias("mask"))  # at most 10, 100, 1,000 rows of masks
        keys = keys.withColumn("block", F.col("fp").bitwiseAND(F.col("mask"))).distinct() if links is not None else keys.withColumn("block", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = durable(keys.groupBy("mask", "block").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        level = sorted({x for v in finer.values() for x in v})
        last = 64 - min(x.bit_count() for x in level) <= 14
        whole = sizes if last else sizes.where(F.col("n") <= GROUP)
        groups = keys.join(whole.select("mask", "block"), ["mask", "block"]).groupBy("mask", "block").agg(F.collect_list("fp").alias("fps"))
        found = groups.select("fps").mapInArrow(_links, "a bigint, b bigint")
        links = found if links is None else links.unionByName(found)
        hot = sizes.where(F.col("n") > GROUP).select("mask", "block")
        if last or hot.isEmpty():
            return links
        rows = durable(keys.join(hot, ["mask", "block"], "left_semi").select("fp", "mask", "block")).select("fp", "mask")


def simhash_components(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, fp, component`` of each row of ``docs(key, text)``; the component is the smallest key reachable over
    links between fingerprints, itself included.

    Equal fingerprints are one node, so copies are never expanded into pairs. Null or empty texts have fingerprint
    zero and are linked like any other. A null key is ignored as a component's name unless the component has no other
    (then it is null). Repeated rows are returned as often as they occur."""
    fps = durable(fingerprints(docs, key))
    nodes = durable(fps.groupBy("fp").agg(F.min("key").alias("low")))
    parts = durable(connected_components(fingerprint_links(nodes.select("fp"))))
    nodes = nodes.join(parts, nodes.fp == parts.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("part"))
    names = nodes.groupBy("part").agg(F.min("low").alias("component"))
    return fps.join(nodes.select("fp", "part").join(names, "part").select("fp", "component"), "fp")


def documents_components(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits), ``component_id`` of each document."""
    out = simhash_components(keyed_text(docs))
    return out.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def kept_documents(docs: DataFrame, further: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``docs``, all columns, with one row of each near-duplicate component: the one with the smallest identifier (of
    equal ones, the first in the files; a null identifier only where there is no other).

    ``further`` gives ``key, component`` of ``(key, text)`` by another measure. Components then run over the links of both, so
    a text may connect two others by one link of each."""
    rows, at = located(docs)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(at).alias("at"))
    texts = rows.select(key.alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    moved = lambda found: found.where(F.col("key") != F.col("component")).select("key", "component")
    gone = moved(simhash_components(texts, "key"))
    if further is not None:
        edges = gone.unionByName(moved(further(texts))).select(F.col("component").alias("a"), F.col("key").alias("b"))
        gone = moved(connected_components(edges).withColumnRenamed("node", "key"))
    return without_rows(rows, durable(gone.select("key.at")), at)
