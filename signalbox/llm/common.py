"""What several training-data operators share: table access, word rules, document keys."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox.session import checkpointed, configure, scratch_path

__all__ = ["checkpointed", "configure", "scratch_path", "stored", "table", "text_of", "crc_of_id"]

#: Characters that separate words: space and tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
#: The word rule as a regular expression (JVM and SQL side).
WORD = r"[^\x20\x09-\x0D]+"
#: A-Z only, as the word rules lower-case nothing else.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
ARROW_ROWS = 2048
UPPER_LETTERS, LOWER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # texts may be long: fewer rows in a batch that goes to Python
    configure(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once as Parquet in the shared folder and read back: cuts lineage, keeps columns prunable."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Words of a text as UTF-8; ``bytes.split`` splits at exactly the separators of the word rule."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.translate(LOWER) if lower else raw).split()


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, element by element, modulo 2**64."""
    h = np.atleast_1d(h)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles_of(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text.

    Fewer words than ``size``: the whole sequence is the one shingle. No words: none.
    """
    h = hashes_of(words_of(text, lower=True))
    if not len(h):
        return h
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(size, len(h)), np.uint64)
    for k in range(min(size, len(h))):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def row_batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that long texts are not held as Python objects all at once.

    What a task has freed goes back to the system at its end, as its worker is kept for others.
    """
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    released()


def released() -> None:
    """Give memory that freed objects held back to the system: workers are reused by later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass
