"""Token ids as raw payloads in shards, with a minimal perfect hash index from document keys to offsets.

A shard is a row of a Parquet folder, so that any store Spark can reach holds it and any executor can read it:

    part, seq       the shard's place: parts are ranges of ascending keys, shards count up within a part
    before          ids in earlier shards of the part
    n_ids, n_docs   of this shard
    low, high       smallest and largest key (null: only documents without a key), for pruning
    n_null          documents without a key; they come first and can be scanned but not looked up
    width           bytes an id, 2 where the vocabulary allows, else 4
    payload         the ids of all documents, one after the other, little-endian, nothing between
    keys, ends      of each document in order: its key (int64) and the offset behind its last id (uint64)
    slot_doc        by slot of the perfect hash: the first document with that key (uint32); equal keys stand together
    mph_*           the perfect hash and its stored fingerprints

``manifest`` beside it has the ids before each part.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import PieceCache, gathered
from .perfect_hash import PerfectHash
from .tables import sized
from .trie_bpe import byte_letters, default_path

#: Ids after which a shard ends with its document.
SHARD_IDS = 2_000_000
#: Bytes of text that are encoded at a time: new pieces go to the encoder in one list.
ENCODED_BYTES = 4_000_000
#: Words of one or two characters whose ids a worker remembers beside the pieces.
REMEMBERED_SIGNS = 10_000
#: Letters and signs of which the pre-tokenizer makes words by these two rules alone; the apostrophe and the signs of added tokens have others.
LETTERS, SIGNS = "".join(c for c in map(chr, range(0x250)) if c.isalpha()), "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
PLAIN = re.compile(f" ?[{LETTERS}{re.escape(SIGNS)}]++(?:\n[{LETTERS}{re.escape(SIGNS)}]++)*+").fullmatch
WORDS = re.compile(f" ?[{LETTERS}]+| ?[{re.escape(SIGNS)}]+|\n").findall
#: The letters that stand for the bytes of each of them in a byte-level vocabulary.
SPELLED = {ord(c): "".join(byte_letters()[b] for b in c.encode()) for c in LETTERS + SIGNS + " \n"}
BINARY = ["payload", "keys", "ends", "slot_doc", "mph_words", "mph_ranks", "mph_sizes", "mph_prints"]
NUMBERS = {"part": pa.int32(), "seq": pa.int32(), "before": pa.int64(), "n_ids": pa.int64(), "n_docs": pa.int64(), "low": pa.int64(), "high": pa.int64(), "n_null": pa.int64(), "width": pa.int32()}
SHAPE = ", ".join(f"{k} {'int' if t == pa.int32() else 'bigint'}" for k, t in NUMBERS.items()) + "".join(f", {k} binary" for k in BINARY)
ARROW = pa.schema([*NUMBERS.items(), *((k, pa.binary()) for k in BINARY)])


def takes_plain_words(tok) -> bool:
    """Whether ``tok`` cuts texts of ``LETTERS`` and ``SIGNS`` into the words of ``plain_words``, each spelled by its bytes' letters."""
    setup = json.loads(tok.to_str())
    before = setup["pre_tokenizer"] or {}
    byte_level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    return byte_level and setup["normalizer"] is None and not any(set(a["content"]) <= {*map(chr, SPELLED)} for a in setup["added_tokens"])


def plain_words(piece: str) -> list[str] | None:
    """The pre-tokenizer's words of a piece of letters and signs, with a space at its front or none; None: it has other signs."""
    return WORDS(piece) if PLAIN(piece) else None


@lru_cache(maxsize=2)
def _encoder(path: str) -> tuple[PieceCache, int]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    merge, plain = tok.model.tokenize, takes_plain_words(tok)

    def ids(word: str) -> list[int]:
        return [t.id for t in merge(word.translate(SPELLED))]

    sign = lru_cache(maxsize=REMEMBERED_SIGNS)(ids)

    def pack(pieces: list[str]) -> list[bytes]:
        """Plain pieces go word by word to the library's model, all others through its whole chain."""
        cuts = [plain_words(p) if plain else None for p in pieces]
        others = iter(tok.encode_batch_fast([p for p, c in zip(pieces, cuts) if c is None], add_special_tokens=False))
        out = []
        for words in cuts:
            if words is None:
                found = next(others).ids
            else:
                found = []
                for w in words:
                    found += sign(w) if len(w) < 3 else ids(w)
            out.append(array("I", found).tobytes())
        return out

    return PieceCache(pack), tok.get_vocab_size(with_added_tokens=True)


def shard_row(part: int, seq: int, before: int, keys: list, ids: list[bytes], width: int) -> dict:
    known = np.array([k for k in keys if k is not None], np.int64)
    n_null = len(keys) - len(known)
    distinct, first = np.unique(known, return_index=True)
    index = PerfectHash.build(distinct)
    slot_doc = np.zeros(len(distinct), "<u4")
    slot_doc[index.slots(distinct)] = first + n_null
    ends = np.cumsum([len(i) // 4 for i in ids], dtype=np.uint64)
    payload = np.frombuffer(b"".join(ids), "<u4").astype(f"<u{width}").tobytes()
    row = {"part": part, "seq": seq, "before": before, "n_ids": int(ends[-1]), "n_docs": len(keys), "low": int(known[0]) if len(known) else None, "high": int(known[-1]) if len(known) else None, "n_null": n_null, "width": width}
    return row | {"payload": payload, "keys": np.array([k or 0 for k in keys], "<i8").tobytes(), "ends": ends.astype("<u8").tobytes(), "slot_doc": slot_doc.tobytes()} | index.parts()


def write_shards(docs: DataFrame, out: str, path: str | None = None, end_id: int | None = 0, partitions: int | None = None, shard_ids: int = SHARD_IDS) -> None:
    """Encode ``docs(doc_id, text)`` and write them in ascending order of the key, nulls first, each followed by ``end_id``.

    Null texts count as empty. Rows that share a key stand together in the order of their texts. Keys are dealt out by
    ranges; the text's hash and a row number after the key let a key with very many rows be split. A part is
    encoded as a stream: no more than a shard is held at a time. An empty table gives no shards."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, vocabulary = _encoder(path)
        width = 2 if vocabulary <= 1 << 16 else 4
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        part, seq, before, keys, ids, held = TaskContext.get().partitionId(), 0, 0, [], [], 0
        for b in gathered(batches, 1, ENCODED_BYTES):
            for key, packed in zip(b.column(0).to_pylist(), cache.texts([t or "" for t in b.column(1).to_pylist()])):
                keys.append(key)
                ids.append(packed + end)
                held += len(ids[-1]) // 4
                if held >= shard_ids:
                    yield pa.RecordBatch.from_pylist([shard_row(part, seq, before, keys, ids, width)], ARROW)
                    seq, before, keys, ids, held = seq + 1, before + held, [], [], 0
        if keys:
            yield pa.RecordBatch.from_pylist([shard_row(part, seq, before, keys, ids, width)], ARROW)

    spark = docs.sparkSession
    order = ["doc_id", "_text", "_row"]
    rows = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("_text"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    rows.sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, SHAPE).write.option("compression", "zstd").parquet(f"{out}/shards")
    parts = spark.read.schema(SHAPE).parquet(f"{out}/shards").groupBy("part").agg(F.sum("n_ids").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part: as many as tasks
    parts.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base")).write.parquet(f"{out}/manifest")


def _documents(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Payload, starts and ends of each document, and the keys, of one shard."""
    ends = np.frombuffer(row["ends"], "<u8").astype(np.int64)
    keys = np.frombuffer(row["keys"], "<i8")
    return np.frombuffer(row["payload"], f"<u{row['width']}"), np.concatenate(([0], ends[:-1])), ends, keys


def _rows(spark: SparkSession, out: str) -> DataFrame:
    bases = spark.read.schema("part int, base bigint").parquet(f"{out}/manifest")
    return spark.read.schema(SHAPE).parquet(f"{out}/shards").join(sized(bases), "part")


def read_shards(spark: SparkSession, out: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, as the files have them, and with ``with_ids`` the ids.

    Each document with a key is found through the index, and every key must lead to a run of documents that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                payload, starts, ends, keys = _documents(row)
                n_null = row["n_null"]
                known = keys[n_null:]
                slots = PerfectHash.load(row).slots(known)
                first = np.frombuffer(row["slot_doc"], "<u4")[slots].astype(np.int64) if len(known) else np.zeros(0, np.int64)
                if (slots < 0).any() or (keys[first] != known).any():
                    raise ValueError(f"the index of shard {row['part']}/{row['seq']} is damaged")
                run_start = np.flatnonzero(np.concatenate(([True], known[1:] != known[:-1]))) if len(known) else first
                doc = np.concatenate((np.arange(n_null), first + np.arange(len(known)) - np.repeat(run_start, np.diff(np.append(run_start, len(known))))))
                wide = [payload[starts[d] : ends[d]].astype("<u4").tobytes() for d in doc.tolist()]
                columns = [
                    pa.array([None] * n_null + known.tolist(), pa.int64()), pa.array(row["base"] + row["before"] + starts[doc], pa.int64()),
                    pa.array(ends[doc] - starts[doc], pa.int64()), pa.array([zlib.crc32(w) for w in wide], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array(wide, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return _rows(spark, out).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def lookup(spark: SparkSession, out: str, keys: list[int]) -> DataFrame:
    """``doc_id, start, ids`` of the documents with these keys (a bounded list); keys that are not there give no row.

    Only shards whose range holds a key are read, and in them each key costs one probe of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                payload, starts, ends, stored = _documents(row)
                found = []
                wanted = np.array([k for k in keys if row["low"] <= k <= row["high"]], np.int64)
                for key, slot in zip(wanted.tolist(), PerfectHash.load(row).slots(wanted).tolist()):
                    doc = int(np.frombuffer(row["slot_doc"], "<u4")[slot]) if slot >= 0 else len(stored)
                    while doc < len(stored) and stored[doc] == key:
                        found.append((key, int(row["base"] + row["before"] + starts[doc]), payload[starts[doc] : ends[doc]].astype("<u4").tobytes()))
                        doc += 1
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "start", "ids"])

    rows = _rows(spark, out)
    if not keys:
        return rows.limit(0).mapInArrow(run, "doc_id bigint, start bigint, ids binary")
    near = F.exists(F.array(*map(F.lit, keys)), lambda k: (k >= F.col("low")) & (k <= F.col("high")))
    return rows.where((F.col("high") >= min(keys)) & (F.col("low") <= max(keys)) & near).mapInArrow(run, "doc_id bigint, start bigint, ids binary")
