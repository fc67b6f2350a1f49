"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the ``SKETCH`` smallest distinct 64-bit hashes of the shingles of a text, written as base64
of little-endian integers in ascending order. Sketches of parts merge into the sketch of the whole, and
tell resemblance, containment and the number of distinct shingles. Up to ``SKETCH`` shingles they are exact.

Edge cases: a null text is empty; fewer words than a shingle make one shingle of the whole; a text without
words has the empty sketch, which resembles itself fully and all else not at all; equal texts have equal
sketches; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalbox.llm.common import row_batches, shingles_of, text_of

SKETCH, SHINGLE = 256, 5
#: Ranges of ids per shuffle partition, so that hashing them to partitions comes out even.
RANGES = 4

EDITED = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double"


def sketch(text: str | None, k: int = SKETCH) -> np.ndarray:
    return shingles_of(text, SHINGLE)[:k]


def encoded(s: np.ndarray) -> str:
    return base64.b64encode(s.astype("<u8").tobytes()).decode()


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = SKETCH) -> np.ndarray:
    return np.union1d(a, b)[:k]


def _common(a: np.ndarray, b: np.ndarray, k: int) -> tuple[int, np.ndarray]:
    union = merge(a, b, k)
    both = np.intersect1d(a, b, assume_unique=True)
    return int(np.searchsorted(both, union[-1], "right")) if len(union) else 0, union


def resemblance(a: np.ndarray, b: np.ndarray, k: int = SKETCH) -> float:
    shared, union = _common(a, b, k)
    return shared / len(union) if len(union) else 1.0


def distinct(s: np.ndarray, k: int = SKETCH) -> float:
    """Estimated number of distinct shingles; exact below ``k``."""
    return float(len(s)) if len(s) < k else (k - 1) * 2.0**64 / max(1.0, float(s[-1]))


def containment(a: np.ndarray, b: np.ndarray, k: int = SKETCH) -> float:
    """Estimated share of the shingles of ``a`` that ``b`` has."""
    shared, union = _common(a, b, k)
    own = int(np.isin(a[: np.searchsorted(a, union[-1], "right")], union).sum()) if len(union) else 0
    return shared / own if own else 1.0


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (which has ``text``) with ``fingerprint`` and ``n_shingles``."""
    docs = docs.drop("fingerprint", "n_shingles")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches):
            found = [sketch(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(map(encoded, found), pa.string()), pa.array(map(distinct, found), pa.float64())],
                names=[*batch.schema.names, "fingerprint", "n_shingles"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "fingerprint string, n_shingles double"])
    return docs.mapInArrow(add, schema)


def merged(parts: DataFrame, key: str, k: int = SKETCH) -> DataFrame:
    """The ``fingerprint`` of each key from those of its parts: distinct hashes, then the ``k`` smallest of a key."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches):
            found = [decoded(f) for f in batch.column(1).to_pylist()]
            owner = batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(s) for s in found])))
            # unsigned order as signed order
            flat = (np.concatenate([*found, np.zeros(0, np.uint64)]) ^ np.uint64(1 << 63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([owner, pa.array(flat)], names=[key, "_hash"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches):
            found = [np.sort(np.array(v, np.int64)).view(np.uint64) ^ np.uint64(1 << 63) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(encoded, found), pa.string())], names=[key, "fingerprint"])

    kind = parts.schema[key].dataType.simpleString()
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_hash"))
    small = parts.select(key, "fingerprint").mapInArrow(hashes, f"`{key}` {kind}, _hash bigint").distinct().withColumn("_rank", rank).filter(F.col("_rank") <= k)
    # at most k hashes for each key
    return small.groupBy(key).agg(F.collect_list("_hash").alias("_hashes")).mapInArrow(joined, f"`{key}` {kind}, fingerprint string")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by range, own rows before the copy that begins the next range, id and text."""
    last, out = None, []
    names = [c.split()[0] for c in EDITED.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 3]
    for batch in row_batches(batches):
        for at, head, doc_id, text in zip(*(batch.column(n).to_pylist() for n in ("_range", "_head", "doc_id", "text")), strict=True):
            own = sketch(text)
            if last and last[0] == at and not last[1]:
                _, _, before, whole, old = last
                n, cut = len(whole), len(whole) // 4
                edited = whole[: n - cut] + text[:cut]
                new = sketch(edited)
                out.append((before, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), encoded(old), encoded(new), resemblance(old, new), resemblance(old, own), distinct(old)))
            last = (at, head, doc_id, text, own)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out = []


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Each document (``doc_id``, ``text``) with the fingerprint of an edited text, and how like both and the
    next document are.

    The edited text ends in the beginning of the next document by id, the first one after the last; null ids come first
    and rows of one id are ordered by their texts. Ids are cut into ranges; the row that begins a range is
    also sent to the range before it, so that neighbours meet without a global window.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    rows = docs.select(key.alias("_key"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    n = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    quantiles = rows.stat.approxQuantile("_key", [k / n for k in range(1, n)], 1 / (4 * n))
    bounds = np.unique(np.array(quantiles, float)).astype(np.int64)

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy(), "right").astype(np.int32))

    placed = rows.withColumn("_range", range_of("_key"))
    # a row for each range, of which there are at most n
    heads = sorted((r["_range"], r["head"]) for r in placed.groupBy("_range").agg(F.min("_key").alias("head")).collect())
    before = {head: heads[k - 1][0] for k, (_, head) in enumerate(heads)}

    @F.pandas_udf("int")
    def range_before(keys: pd.Series) -> pd.Series:
        return keys.map(before).astype("Int32")

    copies = F.explode(F.array_compact(F.array(
        F.struct(F.col("_range"), F.lit(0).alias("_head")),
        F.when(F.col("_before").isNotNull(), F.struct(F.col("_before").alias("_range"), F.lit(1).alias("_head"))))))
    dealt = placed.withColumn("_before", range_before("_key")).withColumn("_to", copies).select("_to._range", "_to._head", "_key", "doc_id", "text")
    ordered = dealt.repartition(n // RANGES, "_range").sortWithinPartitions("_range", "_head", "_key", "text")
    return ordered.select("_range", "_head", "doc_id", "text").mapInArrow(_pairs, EDITED)
