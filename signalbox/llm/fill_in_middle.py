"""Fill-in-the-middle transformation over piece tables.

A document becomes descriptors (buffer, start, length) over two buffers that never change: its text, and the
sentinels. Cutting splits a descriptor at a unit border, an arrangement permutes the sections and puts sentinels before
them, and the inverse permutation restores the text. Texts are copied only where they leave: ``output``
is written from the descriptors, hashes take one descriptor after the other.

Units are runs of A-Z and a-z, and any other code point alone. Both cuts, whether a document stays plain and which of the
two arrangements it gets follow from a hash of its id, so every run and every executor agrees.

Edge cases: a null text is empty; an empty text, or one that already has a sentinel, stays plain; a null id hashes as
empty text; repeated rows get the same output; an empty table gives an empty result. Other columns are kept, those
named like the results replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.llm.common import row_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = PREFIX + SUFFIX + MIDDLE
#: Per hundred: documents that are transformed, and those of them with the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: Sections in the order of the output: 0 prefix, 1 middle, 2 suffix.
ARRANGEMENTS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
MARKS = (PREFIX, MIDDLE, SUFFIX)
RESULTS = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, output_sha256 string, restored_sha256 string"
NAMES = [c.split()[0] for c in RESULTS.split(", ")]
HASH_CHARS = 1 << 16
TEXT, ADDED = 0, 1  # the two buffers


@dataclass(frozen=True)
class Descriptor:
    buffer: int
    start: int
    length: int

    def split(self, at: int) -> tuple[Descriptor, Descriptor]:
        return Descriptor(self.buffer, self.start, at), Descriptor(self.buffer, self.start + at, self.length - at)


class PieceTable:
    """Immutable buffers and the descriptors that spell a text out of them."""

    def __init__(self, text: str, pieces: Iterable[Descriptor] | None = None):
        self.buffers = (text, SENTINELS)
        self.pieces = tuple(pieces) if pieces is not None else (Descriptor(TEXT, 0, len(text)),)

    def arranged(self, pieces: Iterable[Descriptor]) -> PieceTable:
        return PieceTable(self.buffers[TEXT], pieces)

    def chunks(self, size: int = HASH_CHARS) -> Iterator[str]:
        for p in self.pieces:
            for at in range(p.start, p.start + p.length, size):
                yield self.buffers[p.buffer][at : min(at + size, p.start + p.length)]

    def text(self) -> str:
        return "".join(self.chunks())

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for part in self.chunks():
            digest.update(part.encode("utf-8", "surrogatepass"))
        return digest.hexdigest()


def _mark(section: int) -> Descriptor:
    return Descriptor(ADDED, SENTINELS.index(MARKS[section]), len(MARKS[section]))


def unit_starts(text: str) -> np.ndarray:
    """Code point offsets at which units start, and the end of the text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    folded = points | np.uint32(32)
    letter = (folded >= 97) & (folded <= 122) & (points < 128)
    starts = np.ones(len(points) + 1, bool)
    starts[1:-1] = ~(letter[1:] & letter[:-1])
    return np.flatnonzero(starts) if len(points) else np.zeros(1, np.int64)


def cut(table: PieceTable, first: int, second: int) -> tuple[Descriptor, Descriptor, Descriptor]:
    """Prefix, middle and suffix of a text that is one descriptor still."""
    head, suffix = table.pieces[0].split(second)
    return *head.split(first), suffix


def arrange(table: PieceTable, sections: tuple[Descriptor, ...], form: str) -> PieceTable:
    return table.arranged(p for k in ARRANGEMENTS[form] for p in (_mark(k), sections[k]))


def restore(output: str, form: str) -> PieceTable:
    """The text of an output, as descriptors over that output.

    No sentinel overlaps another one or its own shifted copy, so those that ``arrange`` wrote are the only ones.
    """
    if form not in ARRANGEMENTS:
        return PieceTable(output)
    order, found, end = ARRANGEMENTS[form], [], len(output)
    for k in reversed(order):
        at = output.rindex(MARKS[k], 0, end)
        found.append(Descriptor(TEXT, at + len(MARKS[k]), end - at - len(MARKS[k])))
        end = at
    found.reverse()
    inverse = sorted(range(len(order)), key=order.__getitem__)
    return PieceTable(output, (found[place] for place in inverse))


def transformed_text(doc_id: int | None, text: str | None) -> tuple:
    """The result columns of one document."""
    table, text = PieceTable(text or ""), text or ""
    key = hashlib.sha256(b"1:" + (b"" if doc_id is None else b"%d" % doc_id)).hexdigest()
    h1, h2, h3, h4 = (int(key[k : k + 8], 16) for k in (0, 8, 16, 24))
    starts = unit_starts(text)
    n, form, sizes = len(starts) - 1, "plain", (None, None)
    if text and h3 % 100 < TRANSFORMED and not any(m in text for m in MARKS):
        form = "spm" if h4 % 100 < SUFFIX_FIRST else "psm"
        first, second = sorted((int(starts[h1 % (n + 1)]), int(starts[h2 % (n + 1)])))
        sections = cut(table, first, second)
        sizes = sections[0].length, sections[1].length
        table = arrange(table, sections, form)
    output = table.text()
    return n, form, *sizes, output, table.sha256(), restore(output, form).sha256()


def transformed(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (``doc_id``, ``text``) with ``output`` and the columns that describe it."""
    docs = docs.drop(*NAMES).withColumn("_key", F.col("doc_id").cast("long"))
    plain = [f.name for f in docs.schema if f.name != "_key"]

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        for batch in row_batches(batches):
            ids, texts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_key", "text"))
            made = list(map(transformed_text, ids, texts))
            columns = [pa.array(list(c), k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)] if made else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in plain), *columns], names=[*plain, *NAMES])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "_key"]
    return docs.mapInArrow(rewrite, ", ".join([*kept, RESULTS]))
