"""Benchmark decontamination: n-gram seeds bring passages and test items together, local alignment scores them."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmill.session import durable

from .chunks import slices
from .tables import located, without_rows
from .workers import frugal

#: Words of a seed, and the share of an item's words that an alignment must match.
WORDS, SIMILARITY = 5, 0.8
#: Words of test items that are looked for in one pass over the documents; more items are taken in blocks.
BLOCK_WORDS = 500_000
MATCH, MISMATCH, GAP = 2, -1, -1

#: A-Z to lower case, ASCII signs other than letters and digits to spaces.
PLAIN = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or 0x30 <= c <= 0x39 or c >= 0x80 else 0x20 for c in range(256))


def plain_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(PLAIN).split()


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int]:
    """Smith-Waterman over word numbers: the score of the best local alignment, the words that match in it (of equally good ones, the most), and
    where it ends in ``a`` and in ``b`` (exclusive).

    The table is filled along its diagonals, three of which are held. A cell holds the score above and the matches
    below its 32nd bit, so both are maximised at once."""
    m, n = len(a), len(b)
    if not m or not n:
        return 0, 0, 0, 0
    one = 1 << 32
    before = last = np.zeros(m + 1, np.int64)
    best, where = 0, (0, 0)
    for d in range(2, m + n + 1):
        i = np.arange(max(1, d - n), min(m, d - 1) + 1)
        step = np.where(a[i - 1] == b[d - i - 1], MATCH * one + 1, MISMATCH * one)
        cell = np.maximum(np.maximum(before[i - 1] + step, np.maximum(last[i - 1], last[i]) + GAP * one), 0)
        now = np.zeros(m + 1, np.int64)
        now[i] = cell
        k = int(cell.argmax())
        if cell[k] > best:
            best, where = int(cell[k]), (int(i[k]), int(d - i[k]))
        before, last = last, now
    return best >> 32, best & (one - 1), *where


class Items:
    """A block of test items: their words as numbers, and their n-grams as hashes of those numbers."""

    def __init__(self, rows: list[tuple[object, str | None]], words: int = WORDS):
        self.ids = [r[0] for r in rows]
        texts = [plain_words(r[1]) for r in rows]
        self.number: dict[bytes, int] = {}
        self.words = [np.array([self.number.setdefault(w, len(self.number)) for w in t], np.int64) for t in texts]
        self.sizes = sorted({min(words, len(w)) for w in self.words if len(w)})
        self.grams: dict[int, list[tuple[int, int]]] = defaultdict(list)  # hash: items and places
        for k, w in enumerate(self.words):
            if len(w):
                for at, h in enumerate(gram_hashes(w, min(words, len(w))).tolist()):
                    self.grams[h].append((k, at))

        self.parts = [np.unique(w, return_counts=True) for w in self.words]

    def may_match(self, k: int, words: np.ndarray, similarity: float) -> bool:
        """Whether ``words`` hold enough of the words of item ``k``, in any order, for an alignment to match that share of them."""
        own, counts = self.parts[k]
        x = np.sort(words)
        have = np.minimum(np.searchsorted(x, own, side="right") - np.searchsorted(x, own), counts)
        return int(have.sum()) / len(self.words[k]) >= similarity

    def numbers(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words (-1: in no item), with a gap of -1 after each text, and where each text starts."""
        sizes = [len(t) + 1 for t in texts]
        starts = np.cumsum([0, *sizes])
        flat = [w for t in texts for w in (*t, b"")]
        return np.fromiter(map(self.number.get, flat, repeat(-1)), np.int64, len(flat)), starts

    def hits(self, numbers: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the n-grams that are among the sorted ``wanted``."""
        at, found = [], []
        for size in self.sizes:
            if len(numbers) < size or not len(wanted):
                continue
            missing = np.concatenate(([0], np.cumsum(numbers < 0)))
            place = np.flatnonzero(missing[size:] == missing[:-size])
            h = gram_hashes(numbers, size, place)
            k = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
            ok = wanted[k] == h
            at.append(place[ok])
            found.append(h[ok])
        return np.concatenate([*at, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*found, np.zeros(0, np.uint64)]).astype(np.uint64)


def gram_hashes(numbers: np.ndarray, size: int, place: np.ndarray | None = None) -> np.ndarray:
    place = np.arange(len(numbers) - size + 1) if place is None else place
    with np.errstate(over="ignore"):
        h = np.full(len(place), size, np.uint64)
        for k in range(size):
            h = (h ^ (numbers[place + k].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def passages(items: Items, at: np.ndarray, found: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(item, start, end) of the stretches of a text of ``size`` words that n-grams of items point to.

    No start and no end of a best alignment scores below zero, so it holds at most two words more for each word of the item. A
    stretch therefore begins three words before the n-gram for each word of the item before it, and ends likewise. Those
    whose beginnings of the item lie near each other share one, which is never longer than four times the item."""
    spots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for p, h in zip(at.tolist(), found.tolist()):
        for k, offset in items.grams[h]:
            spots[k].append((p - offset, p - 3 * offset, p + 3 * (len(items.words[k]) - offset)))
    out = []
    for k, places in spots.items():
        first = None
        for begin, low, high in sorted(places):
            if first is not None and begin - first <= len(items.words[k]):
                start, end = min(start, low), max(end, high)
                continue
            if first is not None:
                out.append((k, max(0, start), min(size, end)))
            first, start, end = begin, low, high
        out.append((k, max(0, start), min(size, end)))
    return out


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, str | None]]]:
    """The test items in blocks of about ``BLOCK_WORDS``; only one block at a time comes to the driver."""
    words = benchmark.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n = max(1, -(-int(words) // BLOCK_WORDS))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        yield [(r.item_id, r.text) for r in benchmark.where(block == k).select("item_id", "text").orderBy("item_id", "text").collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """Stored ``key, item_id, similarity, matched_words, item_words, score, start_word, end_word``: for each row of ``docs(key, text)``
    and each item of ``benchmark(item_id, text)`` the best alignment that matches ``similarity`` of the item's words.

    Words are compared without case and signs. Every n-gram of an item is a seed, however many documents hold it. A text's
    passages around seeds are dealt out and aligned with their items, unless they hold too few of an item's words for any
    alignment to do. Items with fewer words than a seed are sought whole; null or empty items and texts match nothing.
    Rows with the same key and repeated items are reported once."""
    out = None
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # said outright: passages are few bytes, but each is work
    kind = docs.schema[key].dataType.simpleString()
    docs = docs.select(F.col(key).alias("key"), "text")
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    for rows in _blocks(benchmark):
        items = Items(rows)
        holder = docs.sparkSession.sparkContext.broadcast(items)
        found = _candidates(docs, kind, holder, similarity).repartition(tasks, "key", "item", "start")
        aligned = _aligned(found, kind, holder, item_kind, similarity)
        out = aligned if out is None else out.unionByName(aligned)
    best = F.max_by(F.struct("similarity", "matched_words", "item_words", "score", "start_word", "end_word"), F.struct("score", "matched_words", -F.col("start_word"))).alias("best")
    return durable(out.groupBy("key", "item_id").agg(best).select(F.col("key").alias(key), "item_id", "best.*"))


def _candidates(docs: DataFrame, kind: str, holder, similarity: float) -> DataFrame:
    """``key, item, start, words``: passages that hold a seed and may match, as the items' word numbers (-1: another word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = holder.value
        wanted = np.array(sorted(items.grams), np.uint64)
        for batch in batches:
            for b in slices(batch, 1):
                texts = [plain_words(t) for t in b.column(1).to_pylist()]
                numbers, starts = items.numbers(texts)
                at, h = items.hits(numbers, wanted)
                doc = np.searchsorted(starts, at, side="right") - 1
                order = np.argsort(doc, kind="stable")
                at, h, doc = at[order], h[order], doc[order]
                rows = []
                for d in np.unique(doc).tolist():
                    low, high = np.searchsorted(doc, [d, d + 1])
                    for k, begin, end in passages(items, at[low:high] - starts[d], h[low:high], len(texts[d])):
                        words = numbers[starts[d] + begin : starts[d] + end]
                        if items.may_match(k, words, similarity):
                            rows.append((d, k, begin, words.astype("<i8").tobytes()))
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary()),
                ], ["key", "item", "start", "words"])

    return docs.mapInArrow(frugal(run), f"key {kind}, item bigint, start bigint, words binary")


def _aligned(found: DataFrame, kind: str, holder, item_kind: str, similarity: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = holder.value
        for b in batches:
            rows, seen = [], {}
            for n, (k, start, words) in enumerate(zip(*(b.column(c).to_pylist() for c in (1, 2, 3)))):
                if (k, words) not in seen:  # copies of a passage are aligned once
                    seen[k, words] = align(items.words[k], np.frombuffer(words, "<i8"))
                score, matched, in_item, in_text = seen[k, words]
                share = matched / len(items.words[k])
                if share >= similarity:
                    text = np.frombuffer(words, "<i8")[:in_text][::-1]
                    back = align(items.words[k][:in_item][::-1], text)[3]
                    rows.append((n, items.ids[k], share, matched, len(items.words[k]), score, start + in_text - back, start + in_text))
            columns = list(zip(*rows)) or [[]] * 8
            kinds = [None, None, pa.float64(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], ITEM), *(pa.array(c, t) for c, t in zip(columns[2:], kinds[2:])),
            ], ["key", "item_id", "similarity", "matched_words", "item_words", "score", "start_word", "end_word"])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    ITEM = to_arrow_type(_parse_datatype_string(item_kind))
    shape = f"key {kind}, item_id {item_kind}, similarity double, matched_words bigint, item_words bigint, score bigint, start_word bigint, end_word bigint"
    return found.mapInArrow(frugal(run), shape)


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rows that hold a test item."""
    rows, at = located(docs)
    leaks = find_leaks(rows.select(at, "text"), benchmark, at)
    return without_rows(rows, durable(leaks.select(at).distinct()), at)
