"""Pack tokenised documents into fixed-length sequences by the sum-of-squares rule.

A document is its token ids and an end id; one longer than a sequence is cut into whole sequences and a
rest. Pieces are dealt at random into shards of about ``SHARD_PIECES`` and each shard is packed alone: a piece goes where
the sum, over residual gaps, of the squared number of open sequences with that gap becomes smallest.
Sizes come in descending classes, random inside a class, which leaves next to no waste; a shard
keeps the number of open sequences per gap, nothing that grows beyond its own pieces.

Edge cases: a null or empty text is the end id alone; repeated rows are packed one by one; null ids stay null;
an empty table gives an empty result. Columns other than ``doc_id`` and ``text`` are not carried.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.llm.common import released, row_batches, stored, text_of

if TYPE_CHECKING:
    from tokenizers import Tokenizer

SEQUENCE, END_ID, SHARD_PIECES, CACHED_WORDS = 2048, 0, 20_000, 250_000
#: Numbers of size classes tried in turn, until a shard needs one sequence more than its tokens fill at most.
SIZE_CLASSES = (8, 16, 32, 64, 128, 2048)
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = f"{PIECES}, sequence_id bigint, offset bigint"

# Fixed values of the vocabulary file: how it splits words, and characters on which all libraries agree.
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PLAIN = re.compile(r"[!-~¡-ɏ]*\Z")
# Python's split() takes these for white space, the tokenizer does not.
SEPARATORS = re.compile("[\x1c-\x1f]")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordIds(dict):
    """Ids of at most ``CACHED_WORDS`` words, worked out when they are first asked for. A part of a word is kept as a word."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.id_bytes = [k.to_bytes(4, "little") for k in range(tokenizer.get_vocab_size(with_added_tokens=True))]

    def __missing__(self, word: str) -> bytes:
        ids = self._made(word)
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _made(self, word: str) -> bytes:
        if not PLAIN.match(word):
            return self.whole(word)
        if not word.isalpha():
            # most others are letters and one mark
            parts = (word[:-1], word[-1]) if word[:-1].isalpha() else PARTS.findall(word)
            if len(parts) > 1:
                return b"".join([self[p] for p in parts])
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.id_bytes[t.id] for t in self.model.tokenize(word)])


class WordTokens:
    """Token ids of texts, word by word with a bounded cache: no token crosses white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.words = WordIds(Tokenizer.from_file(path))

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        # a special token, which the library finds before it splits, may be there in the first case
        if "<|" in text or SEPARATORS.search(text):
            return self.words.whole(text)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        lower = text.replace("Σ", "σ").lower()
        if not unicodedata.is_normalized("NFC", lower):  # words would be composed again
            return self.words.whole(text)
        return b"".join(map(self.words.__getitem__, lower.split()))


def word_tokens(path: str | None) -> WordTokens:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return WordTokens(path)


def pieces(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """A row per piece of each document, with the checksum of its ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        tokens = word_tokens(path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in row_batches(batches):
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = tokens.ids(text) + end
                for k, start in enumerate(range(0, len(ids) // 4, sequence)):
                    part = ids[4 * start : 4 * (start + sequence)]
                    out.append((doc_id, k, start, len(part) // 4, zlib.crc32(part)))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])
        # an executor may keep more workers than it has tasks: none holds words or vocabulary beyond its task
        del tokens
        released()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(cut, PIECES)


def place(lengths: np.ndarray, sequence: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, taken in the given order."""
    open_with = np.zeros(sequence + 1, np.int64)  # number of open sequences by residual gap
    at_gap: defaultdict[int, list[int]] = defaultdict(list)
    numbers, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    impossible = np.iinfo(np.int64).max
    for i, size in enumerate(lengths.tolist()):
        here = open_with[size:sequence]
        # one sequence leaves its gap and, unless it is full then, joins another gap
        change = np.where(here > 0, 2 * (open_with[: sequence - size] - here + 1), impossible)
        if size < sequence and here[0]:
            change[0] = 1 - 2 * here[0]
        best = int(change.argmin()) if size < sequence else 0
        if size < sequence and change[best] < impossible and change[best] <= 2 * open_with[sequence - size] + 1:
            gap = size + best
            number = at_gap[gap].pop()
            open_with[gap] -= 1
        else:
            gap, number, made = sequence, made, made + 1
        left = gap - size
        if left:
            open_with[left] += 1
            at_gap[left].append(number)
        numbers[i], offsets[i] = number, sequence - gap
    return numbers, offsets


def place_by_class(lengths: np.ndarray, sequence: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """``place`` in descending size classes, the given order inside a class; the best of a few class widths."""
    best, least = None, -(-int(lengths.sum()) // sequence)
    for classes in SIZE_CLASSES:
        order = np.argsort(-((lengths - 1) * classes // sequence), kind="stable")
        numbers, offsets = place(lengths[order], sequence)
        if best is None or numbers.max() < best[0].max():
            back = np.argsort(order, kind="stable")
            best = numbers[back], offsets[back]
        if best[0].max() <= least:
            break
    return best


def packed(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces of ``docs`` (``doc_id``, ``text``) with ``sequence_id`` and ``offset``."""
    parts = stored(pieces(docs, path, sequence), "pieces")
    shards = max(1, -(-parts.count() // SHARD_PIECES))

    def pack(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["_order", "doc_id", "piece", "ids_crc32"], kind="stable")
        numbers, offsets = place_by_class(shard["length"].to_numpy(), sequence)
        return shard.assign(sequence_id=(shard["_shard"].to_numpy().astype(np.int64) << 32) + numbers, offset=offsets)[[c.split()[0] for c in PACKED.split(", ")]]

    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = parts.withColumn("_order", order).withColumn("_shard", F.pmod(F.xxhash64("_order"), F.lit(shards)))
    return dealt.groupBy("_shard").applyInPandas(pack, PACKED)
