"""Fill-in-the-middle transformation over a piece table.

A document is a list of descriptors ``(buffer, start, length)`` over immutable buffers: its text, and the sentinels. Cutting
splits a descriptor, an arrangement permutes descriptors and puts sentinels before them, the inverse permutation restores
the order, and digests and texts are streamed from the descriptors. No text is copied before its output is written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import slices

#: Before the prefix, the middle and the suffix. A text that holds one of them stays plain.
SENTINELS = (b"<P>", b"<M>", b"<S>")
#: Order of prefix (0), middle (1) and suffix (2) in the output of each form.
ARRANGEMENTS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
#: Percent of documents that stay plain, and of the others that become ``spm``.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
#: Bytes of a text whose units are counted at a time.
CHUNK = 1 << 20

TEXT, MARKS = 0, 1
LETTER = np.array([chr(c).isalpha() and c < 0x80 for c in range(256)])
#: Bytes that begin a code point.
LEAD = np.array([c & 0xC0 != 0x80 for c in range(256)])


class PieceTable:
    """Descriptors over a text and the sentinels."""

    def __init__(self, text: bytes | memoryview):
        self.buffers = (memoryview(text), memoryview(b"".join(SENTINELS)))
        self.pieces = [(TEXT, 0, len(self.buffers[TEXT]))]

    def cut(self, at: int) -> None:
        """Split the descriptor that holds byte ``at`` of the present sequence, so that a piece begins there. At either end
        an empty piece comes off."""
        for k, (buffer, start, length) in enumerate(self.pieces):
            if at <= length:
                self.pieces[k : k + 1] = [(buffer, start, at), (buffer, start + at, length - at)]
                return
            at -= length
        raise ValueError("behind the end")

    def arrange(self, order: tuple[int, ...]) -> None:
        """Permute the pieces and put its sentinel before each."""
        ends = np.cumsum([0, *map(len, SENTINELS)]).tolist()
        self.pieces = [p for i in order for p in ((MARKS, ends[i], len(SENTINELS[i])), self.pieces[i])]

    def restore(self, order: tuple[int, ...]) -> None:
        """Drop the sentinels' pieces (every other one, the first included) and put the rest in order by the inverse permutation."""
        parts = self.pieces[1::2]
        self.pieces = [parts[order.index(i)] for i in range(len(order))]

    def stream(self) -> Iterator[memoryview]:
        for buffer, start, length in self.pieces:
            yield self.buffers[buffer][start : start + length]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for part in self.stream():
            digest.update(part)
        return digest.hexdigest()


def arranged(output: bytes, form: str) -> PieceTable:
    """The piece table of an output: its sentinels are found one after the other, and cut off. Since no part holds one, and
    none can arise at a joint (``<`` only begins a sentinel, ``>`` only ends one), the first hit is the right one."""
    table = PieceTable(output)
    if form in ARRANGEMENTS:
        ahead = at = 0
        for i in ARRANGEMENTS[form]:
            at = output.index(SENTINELS[i], at)
            if ahead:
                table.cut(at)
            table.cut(at := at + len(SENTINELS[i]))
            ahead += 1
        table.restore(ARRANGEMENTS[form])
    return table


def unit_starts(text: bytes) -> Iterator[np.ndarray]:
    """Offsets at which units begin, chunk by chunk: a run of ASCII letters, or any other code point."""
    before = False
    for at in range(0, len(text), CHUNK):
        raw = np.frombuffer(text, np.uint8, min(CHUNK, len(text) - at), at)
        letter = LETTER[raw]
        inside = letter & np.concatenate(([before], letter[:-1]))
        before = bool(letter[-1])
        yield np.flatnonzero(LEAD[raw] & ~inside) + at


def offset(text: bytes, unit: int) -> int:
    """Byte at which the unit of this number begins; the text's length if it has no more."""
    for starts in unit_starts(text):
        if unit < len(starts):
            return int(starts[unit])
        unit -= len(starts)
    return len(text)


def code_points(part: memoryview) -> int:
    return sum(int(np.count_nonzero(LEAD[np.frombuffer(part[at : at + CHUNK], np.uint8)])) for at in range(0, len(part), CHUNK))


def draws(doc_id: int | None, seed: str) -> list[int]:
    """Four numbers of 32 bits from the digest of seed and identifier (a null one counts as no digits)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def transformed(text: bytes, doc_id: int | None, seed: str) -> tuple[PieceTable, dict]:
    """The arranged table of one document, and its row without the output."""
    h = draws(doc_id, seed)
    n = sum(map(len, unit_starts(text)))
    table = PieceTable(text)
    row = {"n": n, "form": "plain", "prefix_chars": None, "middle_chars": None}
    if text and h[2] % 100 < 100 - PLAIN_PERCENT and not any(s in text for s in SENTINELS):
        form = "spm" if h[3] % 100 < SPM_PERCENT else "psm"
        low, high = (offset(text, u) for u in sorted((h[0] % (n + 1), h[1] % (n + 1))))
        table.cut(low)
        table.pieces, tail = table.pieces[:1], table.pieces[1]
        table.pieces += [(tail[0], tail[1], high - low), (tail[0], tail[1] + high - low, tail[2] - high + low)]
        prefix, middle, _ = table.stream()
        row |= {"form": form, "prefix_chars": code_points(prefix), "middle_chars": code_points(middle)}
        table.arrange(ARRANGEMENTS[form])
    return table, row


PIECE = "struct<buffer:int,start:bigint,length:bigint>"
ARROW_PIECES = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))


def transform_documents(docs: DataFrame, seed: str = "1") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, pieces, output, output_sha256`` of each row of ``docs(doc_id, text)``.

    ``n`` counts the units (runs of ASCII letters, else single code points) between which cuts may lie, ``pieces`` are the
    descriptors that make up ``output`` (buffer 0: the text, 1: the sentinels; in bytes). Null texts count as empty and
    stay plain; a null id is drawn for as one without digits; repeated rows give repeated results. No shuffle; an
    empty table gives an empty one. A long text is worked on in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 1):
                rows, pieces, outputs, digests = [], [], [], []
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    table, row = transformed(text or b"", doc_id, seed)
                    rows.append(row)
                    pieces.append([{"buffer": k, "start": s, "length": n} for k, s, n in table.pieces])
                    outputs.append(b"".join(table.stream()))
                    digests.append(table.sha256())
                take = lambda name, kind: pa.array([r[name] for r in rows], kind)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), take("n", pa.int64()), take("form", pa.string()), take("prefix_chars", pa.int64()), take("middle_chars", pa.int64()), pa.array(pieces, ARROW_PIECES), pa.array(outputs, pa.binary()), pa.array(digests, pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "pieces", "output", "output_sha256"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text"))
    out = rows.mapInArrow(run, f"doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, pieces array<{PIECE}>, output binary, output_sha256 string")
    return out.withColumn("output", F.col("output").cast("string"))


def restore_documents(rows: DataFrame) -> DataFrame:
    """``rows`` without ``output``, and with ``text`` and ``restored_sha256``, rebuilt from ``output`` and ``form`` alone."""
    others = [c for c in rows.columns if c not in ("output", "text", "restored_sha256")]
    packed = rows.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), F.coalesce(F.col("output"), F.lit("")).cast("binary").alias("output"), F.col("form").alias("kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 1):
                tables = [arranged(o, f) for o, f in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([b"".join(t.stream()) for t in tables], pa.binary()), pa.array([t.sha256() for t in tables], pa.string())], ["row", "text", "digest"])

    out = packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, text binary, digest string")
    return out.select("row.*", F.col("text").cast("string").alias("text"), F.col("digest").alias("restored_sha256"))
