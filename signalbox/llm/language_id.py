"""Language identification by a bit-sliced Bloom filter of character n-grams.

All languages share one filter: each of its rows has a bit per language. An n-gram names ``HASHES`` rows, and
their conjunction is a bitmask of all languages that contain it. A document's mask bits are counted per language, the
counts are corrected for the share that the filter answers by mistake, and the largest one decides.

An n-gram belongs to a language if at least one in ``COMMON`` of the language's documents has it and the share of
documents with it is at least ``RIVAL`` of the largest share among languages, so stray foreign passages and wrong labels do
not blur the filter. A language's n-grams are thus at most ``COMMON`` times the distinct n-grams of a mean document,
however many documents there are; the rows of the filter follow from the largest language, its words from the number of languages.

Edge cases: null text or no letter: ``und``, score 0; no n-gram known: the most frequent language, score 0; nothing to
learn from: ``und``; rows without language teach nothing; ties go to the least name; repeated rows count
each and are answered alike; an empty table gives an empty result. Other columns are kept, those named like results replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbox.llm.common import mixed, row_batches, stored

ORDERS = (2, 3, 4)
COMMON, RIVAL = 500, 0.5
HASHES, ROWS_PER_GRAM = 4, 12
WINDOW = 1 << 18  # letters hashed at a time
UNDETERMINED = "und"


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letters_of(text: str | None) -> np.ndarray:
    """Code points of the lower-cased letters; a zero at both ends and wherever other characters stand."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(_letters()[codes], codes, 0)
    kept = codes[(codes != 0) | (np.roll(codes, 1) != 0)] if len(codes) else codes
    if not kept.any():
        return np.zeros(0, np.uint64)
    first, last = int(kept[0] == 0), len(kept) - int(kept[-1] == 0)
    return np.concatenate([[0], kept[first:last], [0]]).astype(np.uint64)


def grams_of(letters: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of all n-grams that do not reach over a word's end, some at a time."""
    for at in range(0, len(letters), WINDOW):
        part = letters[at : at + WINDOW + max(ORDERS) - 1]
        hashes, inner = part.copy(), np.ones(len(part), bool)
        for size in range(2, max(ORDERS) + 1):
            n = min(len(part) - size + 1, WINDOW)
            if n <= 0:
                break
            # the code point that stops being the last one must be a letter, unless it is the first
            inner = inner[:n] if size == 2 else inner[:n] & (part[size - 2 : size - 2 + n] != 0)
            hashes = hashes[:n] * np.uint64(0x9E3779B97F4A7C15) + part[size - 1 : size - 1 + n] + np.uint64(size)
            if size in ORDERS:
                # pairs of two ends cannot occur, as ends are never neighbours
                yield mixed(hashes[inner])


@dataclass(frozen=True)
class Filter:
    languages: tuple[str, ...]
    rows: np.ndarray  # rows x words of 64 languages
    false_share: np.ndarray  # by language: of unknown n-grams, those taken as known
    fallback: str

    def counts(self, text: str | None) -> tuple[int, np.ndarray]:
        """Number of n-grams, and of those that each language contains."""
        n, found = 0, np.zeros(len(self.languages), np.int64)
        for grams in grams_of(letters_of(text)):
            masks = None
            for row in rows_of(grams, len(self.rows)):
                masks = self.rows[row] if masks is None else masks & self.rows[row]
            n += len(grams)
            for k in range(len(self.languages)):
                found[k] += int(((masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).sum())
        return n, found

    def predict(self, text: str | None) -> tuple[str, float]:
        n, found = self.counts(text)
        if not n or not self.languages:
            return UNDETERMINED, 0.0
        shares = np.clip((found / n - self.false_share) / (1 - self.false_share), 0, 1)
        best = int(shares.argmax())
        return (self.languages[best], float(shares[best])) if shares[best] > 0 else (self.fallback, 0.0)


def rows_of(grams: np.ndarray, n_rows: int) -> Iterator[np.ndarray]:
    """The rows that each n-gram names; ``n_rows`` is a power of two."""
    step = (grams >> np.uint64(32)) | np.uint64(1)
    for k in range(HASHES):
        yield ((grams + np.uint64(k) * step) & np.uint64(n_rows - 1)).astype(np.int64)


def document_counts(docs: DataFrame) -> DataFrame:
    """Documents by language and n-gram, of ``lang`` and ``text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches):
            own: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = [np.unique(g) for g in grams_of(letters_of(text))]
                if parts:
                    own.setdefault(lang, []).append(np.unique(np.concatenate(parts)))
            for lang, arrays in own.items():
                grams, n = np.unique(np.concatenate(arrays), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    counted = docs.select("lang", "text").mapInArrow(count, "lang string, gram bigint, n bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def contained(docs: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """N-grams with the numbers of the languages that contain them; ``sizes``: documents by language."""
    languages = docs.sparkSession.createDataFrame([(k, v, n) for k, (v, n) in enumerate(sorted(sizes.items()))], "k int, lang string, size long")
    # one row a language
    known = document_counts(docs).join(F.broadcast(languages), "lang").filter(F.col("n") * COMMON >= F.col("size"))
    entry = F.struct((F.col("n") / F.col("size")).alias("share"), "k")
    shares = known.groupBy("gram").agg(F.collect_list(entry).alias("shares"))  # at most one entry a language
    top = F.array_max("shares")["share"]
    return shares.select("gram", F.transform(F.filter("shares", lambda s: s["share"] >= RIVAL * top), lambda s: s["k"]).alias("languages"))


def fitted(docs: DataFrame, eligible: Column | None = None) -> Filter:
    """The filter for ``docs.lang``; ``eligible`` says which rows may be learned from."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.lit(True) if eligible is None else eligible))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = tuple(sorted(sizes))
    if not names:
        return Filter((), np.zeros((1, 1), np.uint64), np.zeros(0), UNDETERMINED)
    grams = stored(contained(usable, sizes), "grams")
    largest = grams.select(F.explode("languages").alias("k")).groupBy("k").count().agg(F.max("count").alias("n")).first()["n"] or 1
    n_rows, words = 1 << (ROWS_PER_GRAM * largest - 1).bit_length(), -(-len(names) // 64)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            grams = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            masks = np.zeros((len(grams), words), np.uint64)
            owner = np.repeat(np.arange(len(grams)), lists.value_lengths().to_numpy(zero_copy_only=False))
            k = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            np.bitwise_or.at(masks, (owner, k // 64), np.uint64(1) << (k % 64).astype(np.uint64))
            for row in rows_of(grams, n_rows):
                for w in range(words):
                    yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.full(len(row), w, np.int64)), pa.array(masks[:, w].view(np.int64))], names=["row", "word", "bits"])

    rows = np.zeros((n_rows, words), np.uint64)
    # at most one entry per row and word of the filter, whose size is bounded as the module says
    for r in grams.mapInArrow(slices, "row bigint, word bigint, bits bigint").groupBy("row", "word").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        rows[r["row"], r["word"]] = np.uint64(r["bits"] & (2**64 - 1))
    filled = np.array([((rows[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(names))])
    return Filter(names, rows, filled**HASHES, max(names, key=lambda v: (sizes[v], [-ord(c) for c in v])))


def predicted(docs: DataFrame, model: Filter) -> DataFrame:
    """Rows of ``docs`` (which has ``text``) with ``lang_pred`` and ``score``."""
    docs = docs.drop("lang_pred", "score")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches):
            found = [held.value.predict(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(answer, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "lang_pred string, score double"]))
