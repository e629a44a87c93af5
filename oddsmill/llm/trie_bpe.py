"""Byte-level BPE by prefix-sharing trie traversal, and its decoder.

The encoding of a prefix is fixed by its last token: it is the encoding of what lies before that token, and the token.
The last token is the one token that ends the prefix, encodes to itself, and forms a valid pair with the last token of
what lies before it, that is, a pair whose joined bytes encode to exactly these two. So the distinct words of a batch
go into a trie, and a depth-first walk hands each node the last tokens of the path above it: a prefix that many words
share is encoded once, in time linear in its length.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import PieceCache, slices
from .workers import emptied, keeps

#: Longer words stay outside the trie, which would get a node per letter; each walks its own path.
TRIE_LETTERS = 1_000
#: Words inside pieces that a worker remembers, about, and pieces of text of each generation, until a task of another operator empties both.
REMEMBERED = 200_000
#: Pairs of tokens that a worker knows to be valid or not, at most.
REMEMBERED_PAIRS = 300_000
#: Bytes of text that are worked on at a time.
PART_BYTES = 1_000_000
#: Above every merge: two neighbours that do not merge.
NO_MERGE = 1 << 62


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the others
    take the code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class TrieBpe:
    """Encoder and decoder of one tokenizer file. Words and tokens are strings of byte letters."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str  # only cuts pieces into words
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merge = {(vocab[a], vocab[b]): rank << 32 | vocab[a + b] for rank, (a, b) in enumerate(merges)}  # rank, then the token made
        self.letters = {c: vocab[c] for c in byte_letters().values() if c in vocab}
        self.token = {i: t for t, i in vocab.items()}
        self.whole = {t: i for t, i in vocab.items() if self.merged(t) == [i]}
        self.sizes: dict[str, list[int]] = {}  # by the last four letters, the lengths of tokens that end so, long ones first
        for t in self.whole:
            if len(t) > 3:
                self.sizes.setdefault(t[-4:], []).append(len(t))
        self.sizes = {k: sorted(set(v), reverse=True) for k, v in self.sizes.items()}
        self.size_of = {i: len(t) for t, i in vocab.items()}
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        back = {c: b for b, c in byte_letters().items()}
        plain = {i: bytes(back[c] for c in t) for i, t in self.token.items()}
        self.bytes_of = plain | {i: t.encode() for t, i in self.added.items()}

    def merged(self, word: str) -> list[int]:
        """Encoding by the definition: the pair of lowest rank merges first, from the left. For single tokens and pairs."""
        ids, merge = [self.letters[c] for c in word], self.merge.get
        found = [merge(p, NO_MERGE) for p in zip(ids, ids[1:])]  # of each two neighbours
        while found:
            best = min(found)
            if best == NO_MERGE:
                break
            k = found.index(best)
            ids[k : k + 2] = [best & 0xFFFFFFFF]
            del found[k]
            if k:
                found[k - 1] = merge((ids[k - 1], ids[k]), NO_MERGE)
            if k < len(found):
                found[k] = merge((ids[k], ids[k + 1]), NO_MERGE)
        return ids

    def valid(self, left: int, right: int) -> bool:
        pair = left << 32 | right
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) > REMEMBERED_PAIRS:
                self.pairs.clear()
            known = self.pairs[pair] = self.merged(self.token[left] + self.token[right]) == [left, right]
        return known

    def last_token(self, word: str, n: int, last: list[int]) -> int:
        """The last token of the encoding of the first ``n`` letters of ``word``, given those of all shorter prefixes."""
        whole = self.whole.get
        if n > 3:
            for size in self.sizes.get(word[n - 4 : n], ()):
                if size <= n:
                    t = whole(word[n - size : n])
                    if t is not None and (size == n or self.valid(last[n - size], t)):
                        return t
        for size in (3, 2) if n > 2 else (2,) if n > 1 else ():
            t = whole(word[n - size : n])
            if t is not None and (size == n or self.valid(last[n - size], t)):
                return t
        return self.letters[word[n - 1]]

    def spelled(self, size: int, last: list[int]) -> bytes:
        """The ids of the path's first ``size`` letters, read back from the last tokens."""
        ids = []
        while size:
            ids.append(last[size])
            size -= self.size_of[last[size]]
        return array("I", reversed(ids)).tobytes()

    def walk(self, words: list[str]) -> dict[str, bytes]:
        """The packed ids of distinct words: insert all, then go down depth first.

        A node is a dict from the next letter to the node below, or to the one word that goes on there (its tail needs
        no nodes of its own); the word that ends at a node is under the empty string."""
        root: dict = {}
        for w in sorted(words):
            node, depth = root, 0
            if len(w) > TRIE_LETTERS:
                root.setdefault("long", []).append(w)
                continue
            while True:
                if depth == len(w):
                    node[""] = w
                    break
                below = node.get(w[depth])
                if below is None:
                    node[w[depth]] = w
                    break
                depth += 1
                if isinstance(below, str):  # the word there and this one share this letter: they part below
                    other, below = below, {}
                    node[w[depth - 1]] = below
                    below[other[depth : depth + 1]] = other
                node = below
        out: dict[str, bytes] = {}
        alone = root.pop("long", [])
        last = [0] * (max(map(len, words), default=0) + 1)
        todo = [("", root)]
        while todo:
            prefix, node = todo.pop()
            depth = len(prefix)
            if depth:
                last[depth] = self.last_token(prefix, depth, last)
            deeper = []
            for c, below in node.items():
                if isinstance(below, str):
                    for n in range(depth + 1, len(below) + 1):
                        last[n] = self.last_token(below, n, last)
                    out[below] = self.spelled(len(below), last)
                else:
                    deeper.append((prefix + c, below))
            todo += deeper
        for w in alone:
            for n in range(1, len(w) + 1):
                last[n] = self.last_token(w, n, last)
            out[w] = self.spelled(len(w), last)
        return out

    def cut_words(self, text: str) -> list[str]:
        """The pre-tokenizer's words, in byte letters. Plain ones, perhaps with one mark behind, need no pattern."""
        body = text[1:] if text[:1] == " " else text
        if body.isascii():
            space = "\u0120" if body is not text else ""
            if body.isalpha():
                return [space + body]
            if len(body) > 1 and body[-1] in ".,;:!?" and body[:-1].isalpha():
                return [space + body[:-1], body[-1]]
        return [w for w, _ in self.split(text)]

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of each piece: special strings first, then the words that the pre-tokenizer cuts."""
        parts: list[list[str | bytes]] = []
        new: dict[str, None] = {}
        for p in pieces:
            row: list[str | bytes] = []
            for i, text in enumerate(self.added_pattern.split(p) if self.added_pattern and "<" in p else [p]):
                if i % 2:
                    row.append(array("I", [self.added[text]]).tobytes())
                elif text:
                    row += self.cut_words(text)
            parts.append(row)
            new.update((w, None) for w in row if isinstance(w, str) and w not in self.words)
        found = self.walk(list(new))
        get = lambda w: w if isinstance(w, bytes) else found.get(w) or self.words[w]
        out = [get(row[0]) if len(row) == 1 else b"".join(map(get, row)) for row in parts]
        if len(self.words) > REMEMBERED:
            self.words.clear()
        for row in parts:
            if len(row) > 1:  # a piece that is one word is remembered by whoever asked for the piece
                self.words.update((w, found[w]) for w in row if w in found)
        return out

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _worker(path: str) -> tuple[TrieBpe, PieceCache]:
    bpe = TrieBpe(path)
    cache = PieceCache(bpe.pieces, REMEMBERED)

    def forget() -> None:
        cache.forget()
        bpe.words.clear()
        bpe.pairs.clear()

    keeps(forget)
    return bpe, cache


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, key: str = "doc_id", path: str | None = None, decoded: bool = False, remember: bool = True) -> DataFrame:
    """``key, ids`` (little-endian unsigned 32-bit, packed) of each row of ``docs(key, text)``, in one pass without a
    shuffle; with ``decoded`` also the text that the ids decode to.

    Null texts count as empty and have no ids. Special strings inside a text are taken as their special token, as the
    tokenizer file says. Repeated rows are returned as often as they occur. Without ``remember`` a worker keeps no pieces
    from task to task: more time, the same rows, and memory for what else the executor does."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cache = _worker(path)
        for batch in batches:
            for b in slices(batch, 1, PART_BYTES):
                ids = cache.texts([t or "" for t in b.column(1).to_pylist()])
                columns = [b.column(0), pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array([bpe.decode(i) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["key", "ids", "decoded"][: len(columns)])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run if remember else emptied(run), f"key {kind}, ids binary" + ", decoded string" * decoded)


def decode_ids(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``key, text`` of each row of ``rows(key, ids)``."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = _worker(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(i or b"") for i in b.column(1).to_pylist()], pa.string())], ["key", "text"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("key", "ids").mapInArrow(run, f"key {kind}, text string")
