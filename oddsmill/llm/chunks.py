"""Cutting texts where a byte-level BPE never merges, and encoding every distinct piece once per worker.

The pre-tokenizer's pattern lets a space start a piece but never end one: before a space that a visible character
follows there is always a cut. Texts are split there, so a piece repeated in many documents is encoded once and then
looked up. The cache of a worker is bounded: it has two generations, and when the younger is full it becomes the older, which
costs time and changes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a generation of a worker's cache remembers at most, unless the encoder says otherwise.
REMEMBERED = 400_000
MARKS = ".,;:!?"
#: A space that no visible character follows: no cut there.
UNCUT = re.compile(r" (?:\s|\Z)")
#: Bytes of text that are worked on at a time (one whole text at least).
SLICE_BYTES = 1_500_000


def cut(text: str) -> list[str]:
    """Pieces of ``text``: ``" ".join(cut(text)) == text``, every joint is a sure cut, the space belongs to the right piece."""
    parts = text.split(" ")
    if not UNCUT.search(text):
        return parts
    out = parts[:1]
    for p in parts[1:]:
        if p and not p[0].isspace():
            out.append(p)
        else:
            out[-1] += " " + p
    return out


class PieceCache:
    """Encodes texts piece by piece; ``encode`` turns a list of distinct pieces into their ids, packed as bytes.

    Letters with one mark behind them are two words of any such pre-tokenizer, so they are put together from the two."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], remembered: int | None = None):
        self.encode, self.remembered = encode, remembered or REMEMBERED
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks = dict(zip(MARKS, encode(list(MARKS))))

    def forget(self) -> None:
        self.known, self.older = {}, {}

    def texts(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.remembered:
            self.known, self.older = {}, self.known
        known = self.known
        cuts = [cut(t) for t in texts]
        first = [c[0] for c in cuts]  # no space before it, so never looked up with the others
        rest = [c[1:] for c in cuts]
        new = set().union(*rest).difference(known)
        again = self.older.keys() & new
        known.update((p, self.older[p]) for p in again)
        new -= again
        marked = [p for p in new if p[-1] in MARKS and p[:-1].isalpha()]
        new.difference_update(marked)
        new.update(p[:-1] for p in marked if p[:-1] not in known)
        spelled, starts = list(new), list(set(first))
        ids = self.encode([*starts, *(" " + p for p in spelled)])
        head = dict(zip(starts, ids))
        known.update(zip(spelled, ids[len(starts) :]))
        known.update((p, known[p[:-1]] + self.marks[p[-1]]) for p in marked)
        look = known.__getitem__
        return [head[f] + b"".join(map(look, r)) for f, r in zip(first, rest)]


def slices(batch: pa.RecordBatch, column: int, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts hold about ``size`` bytes, one row at least."""
    size, start, held = size or SLICE_BYTES, 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if i > start and held + n > size:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def gathered(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """All rows in order, in batches whose texts hold about ``size`` bytes: small batches are put together, large ones cut."""
    held, full = [], 0
    for batch in batches:
        for part in slices(batch, column, size):
            n = pc.sum(pc.binary_length(part.column(column))).as_py() or 0
            if held and full + n > size:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, full = [], 0
            held.append(part)
            full += n
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
