"""Language-model scores of whole documents: counts over the whole corpus, a recurrent network trained by model averaging.

The network predicts the most frequent words one by one and every other word by the class of its ending; within such a
class a word has its share of the class's counts, and one more share stands for all words that training never saw. So
probabilities over the known words and the unseen word of each class add up to one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmill.session import durable

from .chunks import slices
from .gru import HEAD, PER_CLASS, TAIL, Network, Shape, initial, pack, unpack
from .tables import held_out

#: Documents whose crc32(doc_id as text) modulo FOLDS is FOLD are held out.
FOLDS, FOLD = 5, 1
#: Words whose counts every task gets at most, the most frequent ones; the others meet their counts in a join.
LEXICON = 300_000
#: Each round trains on its share of all training documents, from the average of the round before.
ROUNDS = 2
#: Symbols that a task holds at a time, and distinct words that it counts before it sends them on.
CHUNK_SYMBOLS, CHUNK_WORDS = 2_000_000, 200_000
SMOOTHING = 0.5
#: Partial sums of parameters that the driver gets at most.
MERGERS = 16


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found.keys()), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "c"])

    found: Counter = Counter()
    for b in batches:
        for part in slices(b, 0):
            for text in part.column(0).to_pylist():
                found.update(_words(text))
            found[b""] += part.num_rows  # the end of each document
            if len(found) > CHUNK_WORDS:
                yield batch(found)
                found = Counter()
    yield batch(found)


class Lexicon:
    """What a task knows of words: symbol and log-probabilities of the frequent ones, classes of endings for the others."""

    def __init__(self, words: list[bytes], counts: np.ndarray, head: int, endings: list[bytes], mass: np.ndarray, total: int, distinct: int):
        self.head, self.total, self.distinct = head, total, distinct
        self.index = {w: i for i, w in enumerate(words)}
        self.endings = {e: i for i, e in enumerate(endings)}
        self.mass = mass  # by tail class, shares included
        self.symbol = np.arange(len(words), dtype=np.int64)
        self.symbol[head:] = [head + self.ending(w) for w in words[head:]]
        self.base = np.log10((counts + SMOOTHING) / (total + SMOOTHING * (distinct + 1)))
        self.inside = np.zeros(len(words))
        self.inside[head:] = np.log10((counts[head:] + SMOOTHING) / mass[self.symbol[head:] - head])

    def ending(self, word: bytes) -> int:
        return self.endings.get(word[-2:], TAIL - 1)


@lru_cache(maxsize=1)
def _lexicon(ticket: str, holder) -> Lexicon:
    return Lexicon(*holder.value)


def learn_counts(docs: DataFrame) -> tuple[DataFrame, tuple, np.ndarray]:
    """The stored table ``counts(word, c)`` of ``docs(text)``, end of document (the empty word) included, the
    lexicon's parts, and the counts of the tail classes.

    Counting covers every token; tasks send sums per word. The driver gets the most frequent words, ``LEXICON`` at most
    and all down to one count, and the sums of the tail classes."""
    counts = durable(docs.select("text").mapInArrow(_count, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c")).where("c > 0"))
    total, distinct = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    step = F.floor(F.log("c") * 64)  # steps of about 1.6 %: some thousand sums reach the driver, and no task sorts the words
    sizes = counts.where(F.octet_length("word") > 0).groupBy(step.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, held = None, 0
    for r in sorted(sizes, key=lambda r: -r.k):
        held += r.n
        if held > LEXICON:
            break
        least = r.k
    top = counts.where((F.octet_length("word") > 0) & (step >= least if least is not None else F.lit(False))).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    end = counts.where(F.octet_length("word") == 0).agg(F.sum("c")).first()[0] or 0
    words, sizes = [b"", *top.column(0).to_pylist()], np.concatenate(([end], top.column(1).to_numpy()))
    head = min(HEAD, len(words))
    known_head = words[1:head]
    tail = counts.where((F.octet_length("word") > 0) & ~F.col("word").isin(known_head)) if known_head else counts.where(F.octet_length("word") > 0)
    ending = F.expr("substring(word, -2, 2)")
    by_ending = tail.groupBy(ending.alias("e")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n"))
    endings = [bytes(r.e) for r in by_ending.orderBy(F.desc("c"), "e").limit(TAIL - 1).collect()]
    place = F.coalesce(F.array_position(F.array(*map(F.lit, endings)), F.col("e")), F.lit(0)) if endings else F.lit(0)
    mass = np.full(TAIL, SMOOTHING)
    share = np.zeros(TAIL)
    for r in by_ending.groupBy(place.alias("k")).agg(F.sum("c").alias("c"), F.sum("n").alias("n")).collect():
        k = r.k - 1 if r.k else TAIL - 1
        mass[k] += r.c + SMOOTHING * r.n
        share[k] += r.c
    return counts, (words, sizes, head, endings, mass, int(total or 0), int(distinct)), share


def encode(docs: DataFrame, holder, ticket: str) -> DataFrame:
    """The stored table of all ``docs(doc_id, text)``: symbols, token counts and what the lexicon settles of the two
    sums; words outside it with their number and class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = _lexicon(ticket, holder)
        look, end_known = lex.index.get, int(lex.total > 0)
        for batch in batches:
            for b in slices(batch, 1):
                texts, words, ends = b.column(1).to_pylist(), [], [0]
                for t in texts:
                    words += _words(t)
                    words.append(b"")
                    ends.append(len(words))
                at = np.fromiter(map(look, words, repeat(-1)), np.int64, len(words))
                sizes = np.diff(ends)
                doc = np.repeat(np.arange(len(texts)), sizes)
                known, rest = at >= 0, np.flatnonzero(at < 0)
                symbol = lex.symbol[at]
                others: list[Counter] = [Counter() for _ in texts]
                for i, d in zip(rest.tolist(), doc[rest].tolist()):
                    others[d][words[i]] += 1
                symbol[rest] = [lex.head + lex.ending(words[i]) for i in rest.tolist()]
                sums = [np.bincount(doc[known], v[at[known]], minlength=len(texts)) for v in (lex.base, lex.inside)]
                n_known = np.bincount(doc[known], minlength=len(texts)) - (1 - end_known)
                packed = symbol.astype("<u2").tobytes()
                yield pa.RecordBatch.from_arrays([
                    b.column(0), pa.array(sizes, pa.int64()), pa.array(n_known, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), pa.array([packed[2 * i : 2 * j] for i, j in zip(ends, ends[1:])], pa.binary()),
                    pa.array([list(o.keys()) for o in others], pa.list_(pa.binary())), pa.array([list(o.values()) for o in others], pa.list_(pa.int32())),
                    pa.array([[lex.ending(w) for w in o] for o in others], pa.list_(pa.int32())),
                ], ["doc_id", "n_tokens", "n_known", "base", "inside", "symbols", "words", "times", "kinds"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, n_tokens bigint, n_known bigint, base double, inside double, symbols binary, words array<binary>, times array<int>, kinds array<int>"
    return durable(docs.select("doc_id", "text").mapInArrow(run, shape).withColumn("uid", F.monotonically_increasing_id()))


def _chunks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[list[np.ndarray], list[pa.RecordBatch]]]:
    """Documents' symbols, about ``CHUNK_SYMBOLS`` at a time, with the rows they came in."""
    docs, rows, held = [], [], 0
    for b in batches:
        here = [np.frombuffer(s, "<u2") for s in b.column(b.schema.get_field_index(column)).to_pylist()]
        docs, held = docs + here, held + sum(map(len, here))
        rows.append(b)
        if held >= CHUNK_SYMBOLS:
            yield docs, rows
            docs, rows, held = [], [], 0
    if docs:
        yield docs, rows


def train(encoded: DataFrame, shape: Shape, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Every task trains on its documents by truncated backpropagation; a round ends with the mean of the tasks'
    parameters, weighted by tokens. The sums are merged by tasks first, so the driver gets ``MERGERS`` rows of fixed size."""
    params = initial(shape, counts)
    like = dict(params)
    spark = encoded.sparkSession

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, total = 0, None
        for b in batches:
            for n, flat in zip(*(c.to_pylist() for c in b.columns)):
                part = np.frombuffer(flat, "<f8")
                weight, total = weight + n, part if total is None else total + part
        if weight:
            yield pa.RecordBatch.from_arrays([pa.array([weight], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "params"])

    for r in range(ROUNDS):
        holder = spark.sparkContext.broadcast(pack(params))

        def run(batches: Iterator[pa.RecordBatch], holder=holder) -> Iterator[pa.RecordBatch]:
            net, seen, n = Network(shape, unpack(holder.value.copy(), like)), {k: np.full_like(v, 1e-2) for k, v in like.items()}, 0
            for docs, _ in _chunks(batches, "symbols"):
                net.train(docs, seen=seen)
                n += sum(map(len, docs))
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([(pack(net.p).astype("<f8") * n).tobytes()], pa.binary())], ["n", "params"])

        part = encoded.where(F.pmod(F.xxhash64("uid"), F.lit(ROUNDS)) == r).select("symbols")
        sums = part.mapInArrow(run, "n bigint, params binary").repartition(MERGERS).mapInArrow(merge, "n bigint, params binary").collect()
        holder.unpersist()
        if sums:
            params = unpack(np.sum([np.frombuffer(s.params, "<f8") for s in sums], axis=0) / sum(s.n for s in sums), like)
    return params


def score_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row of ``docs(doc_id, text)``.

    ``base_score`` is the smoothed unigram, ``score`` the network's log10-probability of the whole text; the state is
    carried through a document from its first token to its end, in windows. Null texts count as empty: their one
    token is the end. A null id belongs to the training rows. Repeated rows are scored each. Without training rows
    the base is 0 a token and the network is the untrained one."""
    spark = docs.sparkSession
    counts, parts, share = learn_counts(docs.where(~held_out(F.col("doc_id"), FOLDS, FOLD)))
    words, sizes, head, endings, mass, total, distinct = parts
    holder = spark.sparkContext.broadcast(parts)
    encoded = encode(docs, holder, ticket=f"{spark.sparkContext.applicationId}-{holder._jbroadcast.id() if holder._jbroadcast else id(holder)}")
    shape = Shape(head, PER_CLASS, TAIL)
    params = train(encoded.where(~held_out(F.col("doc_id"), FOLDS, FOLD)), shape, np.concatenate([sizes[:head], share]))
    model = spark.sparkContext.broadcast(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(shape, model.value)
        for texts, rows in _chunks(batches, "symbols"):
            table = pa.Table.from_batches(rows).drop_columns("symbols").append_column("score", pa.array(net.score(texts)))
            yield from table.to_batches()

    columns = ["doc_id", "uid", "n_tokens", "n_known", "base", "inside"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.select(columns).schema)
    scored = encoded.select(*columns, "symbols").mapInArrow(run, f"{kinds}, score double")

    tokens = total + SMOOTHING * (distinct + 1)
    masses = F.element_at(F.array(*(F.lit(float(m)) for m in mass)), F.col("t.kinds") + 1)
    c = F.coalesce("c", F.lit(0))
    rare = encoded.select("uid", F.explode(F.arrays_zip("words", "times", "kinds")).alias("t")).withColumn("word", F.col("t.words")).join(counts, "word", "left")
    rare = rare.groupBy("uid").agg(
        F.sum(F.when(c > 0, F.col("t.times")).otherwise(0)).alias("more_known"), F.sum(F.col("t.times") * F.log10((c + SMOOTHING) / tokens)).alias("more_base"),
        F.sum(F.col("t.times") * F.log10((c + SMOOTHING) / masses)).alias("more"),
    )
    more = lambda name: F.coalesce(name, F.lit(0))
    return scored.join(rare, "uid", "left").select(
        "doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "n_tokens", (F.col("n_known") + more("more_known")).cast("bigint").alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + more("more_base")).alias("base_score"), (F.col("score") + F.col("inside") + more("more")).alias("score"),
    )
