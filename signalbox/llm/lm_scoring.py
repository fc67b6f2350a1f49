"""Language-model scoring by deleted interpolation.

The model mixes maximum-likelihood estimates of bigrams and unigrams with a uniform one. The weights depend on how
often the context was seen (a bucket per power of two) and are learned by expectation-maximisation on held-out counts: for
a slice of the training documents, each document's own counts are deleted from the totals first.

Counts of all n-grams would be a shuffle far larger than the text if every occurrence were a row. Documents are
therefore gathered into chunks of bounded size. A chunk asks for each of its distinct n-grams once: 64-bit hashes
in ascending order, cut into ranges, each range of a chunk one compressed row that also holds the chunk's training counts. A
task adds up one range over all chunks and answers every chunk in the order it asked. The answers meet the
chunk again by its number, and its documents are scored from exact corpus counts. Frequent n-grams cost one entry
a chunk, and nothing is gathered in one place but per-range sums of bounded size.

Edge cases: a null text is empty and has the end token alone; without training documents all counts are zero and
the uniform estimate remains; repeated rows are counted and scored one by one; null ids count as training
documents of the id "" ; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbox.llm.common import hashes_of, mixed, row_batches, stored, text_of, words_of

CHUNK_CHARS, RANGE_CHARS = 8_000_000, 4_000_000
#: Every so-many-th training document lends its counts to the weights.
SLICE = 8
#: Fixed hashes of the end token and of the context before the first token.
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
STEPS_PER_OCTAVE, NEVER, BUCKETS, ROUNDS = 4, -9999, 40, 60

CHUNKS = "chunk bigint, deleted boolean, chars bigint, docs binary"
ASKED = "gram int, range int, chunk bigint, keys binary, counts binary"
ANSWERED = "gram int, range int, chunk bigint, totals binary, distinct bigint, total bigint"
SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def squeezed(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes: high bytes of small numbers cost next to nothing."""
    width = values.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(-1, width).T.tobytes()) if len(values) else b""


def unsqueezed(data: bytes, dtype) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype)
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def chunked(docs: DataFrame, train: Column, deleted: Column) -> DataFrame:
    """Documents in chunks of about ``CHUNK_CHARS``; those that lend counts are in chunks of their own."""
    schema = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("text", pa.string())])

    def packed(chunk: int, lends: bool, rows: list[tuple]) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(batch)
        return pa.RecordBatch.from_pydict({"chunk": [chunk], "deleted": [lends], "chars": [sum(len(r[2]) for r in rows)], "docs": [sink.getvalue().to_pybytes()]})

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, open_rows, sizes = TaskContext.get().partitionId() << 32, {True: [], False: []}, {True: 0, False: 0}
        for batch in row_batches(batches):
            for doc_id, trained, lends, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                open_rows[lends].append((doc_id, trained, text))
                sizes[lends] += len(text)
                if sizes[lends] >= CHUNK_CHARS:
                    yield packed(number, lends, open_rows[lends])
                    number, open_rows[lends], sizes[lends] = number + 1, [], 0
        for lends, rows in open_rows.items():
            if rows:
                yield packed(number, lends, rows)
                number += 1

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), train.alias("train"), deleted.alias("deleted"), text_of().alias("text"))
    return picked.mapInArrow(gather, CHUNKS)


class Chunk:
    """Token hashes of a chunk's documents and its distinct n-grams, the same whenever it is read."""

    def __init__(self, data: bytes):
        table = pa.ipc.open_stream(data).read_all()
        self.doc_ids, self.train = table.column(0).to_pylist(), np.array(table.column(1).to_pylist(), bool)
        tokens = []
        for batch in row_batches(table.to_batches()):
            tokens += [np.append(hashes_of(words_of(t, lower=True)), END) for t in batch.column(2).to_pylist()]
        self.sizes = np.array([len(t) for t in tokens])
        self.ends = self.sizes.cumsum()
        self.tokens = np.concatenate(tokens)
        before = np.append(START, self.tokens[:-1])
        before[self.ends[:-1]] = START
        self.before = before
        pairs = mixed(mixed(before) + self.tokens)
        self.keys, self.places, self.counts = {}, {}, {}
        weight = np.repeat(self.train, self.sizes)
        for gram, values in ((1, self.tokens), (2, pairs)):
            self.keys[gram], self.places[gram] = np.unique(values, return_inverse=True)
            self.counts[gram] = np.bincount(self.places[gram], weight, len(self.keys[gram])).astype(np.uint32)


def asked(chunks: DataFrame, bits: int) -> DataFrame:
    """A row for each chunk, n-gram length and range of keys (their first ``bits`` bits)."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in ASKED.split(", ")]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        for batch in row_batches(batches, 1):
            chunk, number = Chunk(batch.column(1)[0].as_py()), batch.column(0)[0].as_py()
            for gram, keys in chunk.keys.items():
                place = (keys >> np.uint64(64 - bits)).astype(np.int64)
                starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
                out = []
                for start, stop in zip(starts, np.append(starts[1:], len(keys)), strict=True):
                    part = keys[start:stop]
                    out.append((gram, int(place[start]), number, squeezed(np.diff(part, prepend=np.uint64(0))), squeezed(chunk.counts[gram][start:stop])))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return chunks.select("chunk", "docs").mapInArrow(ask, ASKED)


def answered(requests: DataFrame) -> DataFrame:
    """Corpus counts of the keys of every request, in its order, and per range the distinct keys and their sum (chunk -1)."""

    def add_up(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [np.cumsum(unsqueezed(k, np.uint64), dtype=np.uint64) for k in rows["keys"]]
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(place, np.concatenate([unsqueezed(c, np.uint32) for c in rows["counts"]])).astype(np.uint64)
        parts = np.split(totals[place], np.cumsum([len(k) for k in keys])[:-1])
        gram, at = rows["gram"].iloc[0], rows["range"].iloc[0]
        out = pd.DataFrame({"gram": gram, "range": at, "chunk": rows["chunk"], "totals": [squeezed(p) for p in parts], "distinct": 0, "total": 0})
        own = pd.DataFrame({"gram": [gram], "range": [at], "chunk": [-1], "totals": [b""], "distinct": [int((totals > 0).sum())], "total": [int(totals.sum())]})
        return pd.concat([out, own], ignore_index=True)

    return requests.groupBy("gram", "range").applyInPandas(add_up, ANSWERED)


def _with_totals(docs: pd.DataFrame, answers: pd.DataFrame) -> tuple[Chunk, dict[int, np.ndarray]]:
    chunk, totals = Chunk(docs["docs"].iloc[0]), {}
    for gram in chunk.keys:
        own = answers[answers["gram"] == gram].sort_values("range")["totals"]
        totals[gram] = np.concatenate([unsqueezed(t, np.uint64) for t in own]).astype(np.int64)
    return chunk, totals


def _context(chunk: Chunk, unigrams: np.ndarray, trained: int) -> np.ndarray:
    """How often the context of each position was seen: the token before, or the start of a document."""
    seen = np.append(0, unigrams[chunk.places[1]][:-1])
    return np.where(chunk.before == START, trained, seen)


def bucket_of(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(context + 1.0)), BUCKETS - 1).astype(np.int64)


def _steps(p: np.ndarray) -> np.ndarray:
    out = np.full(len(p), NEVER, np.int64)
    out[p > 0] = np.round(STEPS_PER_OCTAVE * np.log2(p[p > 0]))
    return out


def held_out_counts(chunks: DataFrame, answers: DataFrame, n: int, trained: int) -> pd.DataFrame:
    """How many positions of the lending documents have which context bucket and (rounded) estimates, after
    deletion of the document's own counts. The table is a grid of fixed extent."""

    def measure(docs: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        cells = []
        if len(docs):
            chunk, totals = _with_totals(docs, own)
            c1, c2, seen = totals[1][chunk.places[1]], totals[2][chunk.places[2]], _context(chunk, totals[1], trained)
            for start, stop in zip(chunk.ends - chunk.sizes, chunk.ends, strict=True):
                _, at1, n1 = np.unique(chunk.places[1][start:stop], return_inverse=True, return_counts=True)
                _, at2, n2 = np.unique(chunk.places[2][start:stop], return_inverse=True, return_counts=True)
                c1[start:stop] -= n1[at1]
                c2[start:stop] -= n2[at2]
                seen[start] -= 1
                seen[start + 1 : stop] -= n1[at1][:-1]
            size = np.repeat(chunk.sizes, chunk.sizes)
            p2 = np.divide(c2, seen, out=np.zeros(len(c2)), where=seen > 0)
            p1 = np.divide(c1, n - size, out=np.zeros(len(c1)), where=n > size)
            cells, counts = np.unique(np.stack([bucket_of(seen), _steps(p2), _steps(p1)], 1), axis=0, return_counts=True)
            return pd.DataFrame({"bucket": cells[:, 0], "two": cells[:, 1], "one": cells[:, 2], "n": counts})
        return pd.DataFrame({"bucket": [], "two": [], "one": [], "n": []}).astype("int64")

    lending = chunks.filter("deleted").select("chunk", "docs")
    own = answers.join(lending.select("chunk"), "chunk", "left_semi").select("chunk", "gram", "range", "totals")
    cells = lending.groupBy("chunk").cogroup(own.groupBy("chunk")).applyInPandas(measure, "bucket bigint, two bigint, one bigint, n bigint")
    return cells.groupBy("bucket", "two", "one").agg(F.sum("n").alias("n")).toPandas()


def learned_weights(cells: pd.DataFrame, distinct: int) -> np.ndarray:
    """Weights of bigram, unigram and uniform estimate per context bucket, by expectation-maximisation."""
    cells = cells.sort_values(["bucket", "two", "one"])
    estimate = [np.where(cells[c] == NEVER, 0.0, 2.0 ** (cells[c].to_numpy(float) / STEPS_PER_OCTAVE)) for c in ("two", "one")]
    p = np.stack([*estimate, np.full(len(cells), 1 / (distinct + 1))], 1)
    n, bucket = cells["n"].to_numpy(float), cells["bucket"].to_numpy(np.int64)

    def maximised(group: np.ndarray, groups: int, prior: np.ndarray) -> np.ndarray:
        weights = np.tile(prior, (groups, 1))
        for _ in range(ROUNDS):
            part = weights[group] * p
            part *= (n / np.maximum(part.sum(1), 1e-300))[:, None]
            sums = np.stack([np.bincount(group, part[:, k], groups) for k in range(3)], 1) + prior
            weights = sums / sums.sum(1, keepdims=True)
        return weights

    overall = maximised(np.zeros(len(cells), np.int64), 1, np.array([0.4, 0.4, 0.2]))[0]
    weights = maximised(bucket, BUCKETS, np.maximum(overall, 1e-3))
    weights[0, 0] = 0.0  # a context never seen has no bigram estimate
    return weights / weights.sum(1, keepdims=True)


def scored(docs: DataFrame, held_out: Column, lends: Column) -> DataFrame:
    """Each document (``doc_id``, ``text``) with token counts, add-one ``base_score`` and ``score``, log10
    probabilities; learns from rows that are not ``held_out``, weights from those of them that ``lends`` picks."""
    spark = docs.sparkSession
    chunks = stored(chunked(docs, ~held_out, ~held_out & lends), "lm-chunks")
    chars = chunks.agg(F.sum("chars")).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), chars // RANGE_CHARS, 2)
    answers = stored(answered(asked(chunks, (ranges - 1).bit_length())), "lm-answers")
    sums = answers.filter("chunk = -1 AND gram = 1").agg(F.sum("total"), F.sum("distinct")).first()
    n, distinct = sums[0] or 0, sums[1] or 0
    answers = answers.filter("chunk >= 0")
    trained = docs.filter(~held_out).count()
    weights = learned_weights(held_out_counts(chunks, answers, n, trained), distinct)
    if not n:  # nothing was counted: the uniform estimate alone
        weights = np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))

    def score(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        chunk, totals = _with_totals(rows, own)
        c1, c2, seen = totals[1][chunk.places[1]], totals[2][chunk.places[2]], _context(chunk, totals[1], trained)
        w = weights[bucket_of(seen)]
        p = w[:, 0] * np.divide(c2, seen, out=np.zeros(len(c2)), where=seen > 0) + w[:, 1] * (c1 / max(n, 1)) + w[:, 2] / (distinct + 1)
        starts = chunk.ends - chunk.sizes
        base = np.log10((c1 + 1) / (n + 1 * (distinct + 1)))
        return pd.DataFrame({
            "doc_id": pd.array(chunk.doc_ids, "Int64"), "held_out": ~chunk.train, "n_tokens": chunk.sizes, "n_known": np.add.reduceat(c1 > 0, starts, dtype=np.int64),
            "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(np.log10(p), starts),
        })

    met = chunks.select("chunk", "docs").groupBy("chunk").cogroup(answers.select("chunk", "gram", "range", "totals").groupBy("chunk"))
    return met.applyInPandas(score, SCORED).withColumn("train_tokens", F.lit(n).cast("long"))
