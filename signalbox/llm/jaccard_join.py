"""Join of documents whose word-shingle sets have a Jaccard similarity of 0.75 or more, and its groups.

Candidates come from a partition of the universe. Sets of sizes ``2**k`` to ``2**(k+1) - 1`` form band ``k``; the
scheme of a band hashes shingles into segments. Sets of sizes ``s`` and ``t`` that are similar enough differ in at most
``H = (s + t) // 7`` shingles, so of any ``H + 1`` segments one is equal. A set therefore indexes its first
``H + 1`` non-empty segments, and a few more, in the scheme of its own band and, where partners may lie there, of the next.

What a segment costs decides how it is used:

- empty segments would meet everywhere and are passed over; a set with too few others also indexes the one-deletion
  neighbourhoods of its segments (each covers one difference more), and its empty ones only if that is not enough;
- segments that more than ``HOT`` sets share are passed over by every set that has no more of them than any possible
  partner indexed beyond ``H + 1``: such a set still shares another segment with each partner;
- sets with more hot segments than that (passages that many documents share, large groups of near copies) are also
  indexed by single shingles, the finest partition: of ``n`` shingles the ``n - ceil(0.75 n) + 1`` rarest ones, of which two
  similar sets have one in common; how many shingles follow it in both limits what they can share.

All pairs of a cold segment are formed; a pair counts as a candidate if it shares as many segments as the spare ones
demand. Pairs are verified on the whole sets (64-bit hashes of the shingles). Equal sets are one class throughout. Where many
sets share a single shingle, all are compared with one of them first; what that links need not be compared again.
Then all pairs between components are compared that sizes and ranks leave. So no link between different
components is lost, and a large group of near copies costs about one comparison per member.

Edge cases: a null text and one without words have an empty set and are linked with nothing, not even each other; fewer
than five words are one shingle; documents with a null id take part, but never name a component unless all its ids are
null; repeated rows are exact copies; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalbox.llm.common import mixed, row_batches, shingles_of, stored
from signalbox.llm.components import components

#: Sets that share a segment (or a single shingle) before it counts as hot.
HOT = 12
#: Ratio of neighbouring size classes when what is left of large groups is compared.
SIZE_STEP = 1.03
#: The same when the least spare among possible partners is looked up.
PARTNER_STEP = 1.1
#: Words of 64 parity bits that a set is reduced to; each shingle in which two sets differ changes one bit at most.
PARITY = tuple(f"p{k}" for k in range(8))
#: Bits of the filter that keeps texts of documents without a candidate from being shuffled; its size is fixed.
FILTER_BITS = 1 << 24
NO_ID = 2**63 - 1
_SEGMENT = np.uint64(0x9E3779B97F4A7C15)


def segments_of(band: int) -> int:
    """Segments of a scheme: enough non-empty ones for the largest set of the band, with some to spare."""
    return (36 * ((2 << band) - 1)) // 100 + 4


def _seed(band: int) -> np.uint64:
    return np.uint64((band + 1) * 0xD6E8FEB86659FD93 % 2**64)


def spare(needed: int) -> int:
    return 2 + needed // 8


def differences(size: int, partner: int) -> int:
    return (size + partner) // 7


def schemes_of(size: int) -> list[tuple[int, int]]:
    """(band, largest partner) of each scheme that a set of this size takes part in."""
    band, largest = size.bit_length() - 1, 4 * size // 3
    out = [(band, min(largest, (2 << band) - 1))]
    return out + [(band + 1, largest)] if largest >= 2 << band else out


def signatures(h: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Signatures of a set (low six bits: the band of the scheme), and per scheme how many go beyond the
    needed ones (-1: too few non-empty segments)."""
    found, beyond = [], []
    own = mixed(h)
    for band, partner in schemes_of(len(h)):
        needed = differences(len(h), partner) + 1
        segment = (mixed(h + _seed(band)) % np.uint64(segments_of(band))).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        placed, values = segment[order], own[order]
        starts = np.flatnonzero(np.concatenate([[True], placed[1:] != placed[:-1]]))
        sums, names = np.add.reduceat(values, starts), placed[starts]

        def named(sums: np.ndarray, names: np.ndarray, band: int = band) -> np.ndarray:
            s = mixed(sums + mixed((names.astype(np.uint64) + np.uint64(1)) * _SEGMENT + _seed(band)))
            return (s & ~np.uint64(63)) | np.uint64(band)

        if len(names) >= needed:
            take = min(len(names), needed + spare(needed))
            found.append(named(sums[:take], names[:take]))
            beyond.append(take - needed)
            continue
        beyond.append(-1)
        counts = np.diff(np.append(starts, len(h)))
        found.append(named(sums, names))
        at = np.repeat(np.arange(len(starts)), counts)
        several = counts[at] > 1
        found.append(named(sums[at[several]] - values[several], names[at[several]]))
        if len(names) + int((counts > 1).sum()) < needed:
            empty = np.setdiff1d(np.arange(segments_of(band)), names)
            found.append(named(np.zeros(len(empty), np.uint64), empty))
    return np.concatenate(found), beyond


def set_key(h: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set, as signed integers."""
    sums = np.array([mixed(h).sum(dtype=np.uint64), mixed(h ^ _SEGMENT).sum(dtype=np.uint64)]) + np.uint64(len(h))
    a, b = mixed(sums).view(np.int64).tolist()
    return a, b


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``doc_id``, hashes of the text (``x1``, ``x2``), ``n_shingles``, the set's key (``h1``, ``h2``) and its spare
    signatures in either scheme."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches):
            out = []
            for text in batch.column(1).to_pylist():
                h = shingles_of(text)
                if len(h):
                    beyond = signatures(h)[1]
                    out.append((len(h), *set_key(h), beyond[0], beyond[1] if len(beyond) > 1 else None))
                else:
                    out.append((0, None, None, None, None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 5, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *columns], names=["doc_id", "x1", "x2", "n_shingles", "h1", "h2", "spare_own", "spare_next"])

    return docs.select(F.col("doc_id").cast("long"), "text", *text_hashes()).mapInArrow(
        measure, "doc_id bigint, x1 bigint, x2 bigint, n_shingles bigint, h1 bigint, h2 bigint, spare_own int, spare_next int")


def text_hashes() -> list[Column]:
    """Two hashes that stand for a text."""
    return [F.xxhash64("text").alias("x1"), F.xxhash64(F.lit(1), "text").alias("x2")]


def _index(docs: DataFrame) -> DataFrame:
    """``sig`` and ``owner`` (first hash of the set's key); a task indexes equal sets once."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # as many integers as documents of this task
        for batch in row_batches(batches):
            sigs, owners = [], []
            for text in batch.column(0).to_pylist():
                h = shingles_of(text)
                if len(h) and (owner := set_key(h)[0]) not in seen:
                    seen.add(owner)
                    sigs.append(signatures(h)[0])
                    owners.append(np.full(len(sigs[-1]), owner))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(owners))], names=["sig", "owner"])

    return docs.select("text").mapInArrow(emit, "sig bigint, owner bigint")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by signature and owner, the distinct ones whose signature has several owners."""
    last_sig, last_owner, given = np.zeros(0, np.int64), np.zeros(0, np.int64), False
    for batch in batches:
        if not batch.num_rows:
            continue
        sig, owner = np.concatenate([last_sig, batch.column(0).to_numpy()]), np.concatenate([last_owner, batch.column(1).to_numpy()])
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (owner[1:] != owner[:-1])])
        sig, owner = sig[new], owner[new]
        same = sig[1:] == sig[:-1]
        out = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        was_given = given and len(last_sig) > 0
        given = bool(out[-1]) or (was_given and len(sig) == 1)
        if was_given:
            out[0] = False
        last_sig, last_owner = sig[-1:].copy(), owner[-1:].copy()
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(sig[out]), pa.array(owner[out])], names=["sig", "owner"])


def _segments(docs: DataFrame) -> DataFrame:
    """Rows (``sig``, ``owner``) of the segments that several sets have."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _index(docs).repartition(n, "sig").sortWithinPartitions("sig", "owner").mapInArrow(_shared, "sig bigint, owner bigint")
    return stored(rows, "segments")


def _reserves(classes: DataFrame) -> DataFrame:
    """``owner``, ``scheme``, ``n`` and ``spare``; a hash that two sets share counts with the smaller reserve."""
    either = F.explode(F.array(F.struct(F.col("band").alias("scheme"), F.col("spare_own").alias("spare")), F.struct((F.col("band") + 1).alias("scheme"), F.col("spare_next").alias("spare"))))
    rows = classes.select(F.col("h1").alias("owner"), "n", either.alias("_of")).select("owner", "n", "_of.*").filter("spare IS NOT NULL")
    return rows.groupBy("owner", "scheme").agg(F.min("spare").alias("spare"), F.min("n").alias("n"))


def segment_candidates(docs: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (``a``, ``b``) from cold segments, and the owners with too many hot ones."""
    rows = _segments(docs)
    hot = stored(rows.groupBy("sig").count().filter(F.col("count") > HOT).select("sig"), "hot-segments")
    scheme = F.col("sig").bitwiseAND(63).cast("int")
    burden = rows.join(hot, "sig", "left_semi").groupBy("owner", scheme.alias("scheme")).agg(F.count(F.lit(1)).alias("hot"))
    known = stored(_reserves(classes).join(burden, ["owner", "scheme"], "left").fillna(0, ["hot"]), "reserves")
    cold = rows.join(hot, "sig", "left_anti").withColumn("scheme", scheme).join(known, ["owner", "scheme"]).drop("scheme")
    cold = stored(cold, "cold-segments")
    left = cold.select("sig", *(F.col(c).alias(f"{c}_a") for c in ("owner", "n", "spare", "hot")))
    right = cold.select("sig", *(F.col(c).alias(f"{c}_b") for c in ("owner", "n", "spare", "hot")))
    near = (F.col("owner_a") < F.col("owner_b")) & (4 * F.least("n_a", "n_b") >= 3 * F.greatest("n_a", "n_b"))
    demand = 1 + F.least("spare_a", "spare_b") - F.least("hot_a", "hot_b")
    # a group has at most HOT members, so at most HOT / 2 pairs a row
    met = left.join(right, "sig").filter(near).groupBy("owner_a", "owner_b", F.col("sig").bitwiseAND(63).alias("scheme")).agg(F.count(F.lit(1)).alias("shared"), F.min(demand).alias("demand"))
    pairs = met.filter("shared >= demand").select(F.col("owner_a").alias("a"), F.col("owner_b").alias("b")).distinct()
    return stored(pairs, "pairs"), _burdened(known)


def _burdened(known: DataFrame) -> DataFrame:
    """Owners whose hot segments may be all that they share with some partner.

    A pair shares more segments than the smaller spare of the two, one at least. If all of those are hot, both
    sets have more hot ones than that spare, so each is held against the least spare among the sets that its size allows
    as partners in the scheme, taken by classes of size: both sets of such a pair are found.
    """
    size_class = F.floor(F.log("n") / math.log(PARTNER_STEP)).cast("int")
    reach = math.ceil(math.log(4 / 3) / math.log(PARTNER_STEP)) + 1  # classes up or down to the last allowed partner
    classed = known.withColumn("_class", size_class)
    own = classed.groupBy("scheme", "_class").agg(F.min("spare").alias("_spare"))
    least = own.select("scheme", F.explode(F.sequence(F.col("_class") - reach, F.col("_class") + reach)).alias("_class"), "_spare").groupBy(
        "scheme", "_class").agg(F.greatest(F.min("_spare"), F.lit(0)).alias("_least"))
    # a few dozen classes in each of at most 64 schemes
    return classed.join(F.broadcast(least), ["scheme", "_class"]).filter("hot > _least").select("owner").distinct()


def rarest_shingles(texts: DataFrame) -> DataFrame:
    """Rows (``sig``, ``owner``, ``n``): the shingles of each set that it must index, rarest first, where shared."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches):
            sets = [shingles_of(t) for t in batch.column(1).to_pylist()]
            sizes = np.array([len(h) for h in sets])
            if len(sets):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(sets).view(np.int64)), batch.column(0).take(pa.array(np.repeat(np.arange(len(sets)), sizes))), pa.array(np.repeat(sizes, sizes))],
                    names=["sig", "owner", "n"])

    rows = stored(texts.select("owner", "text").mapInArrow(explode, "sig bigint, owner bigint, n bigint"), "single-shingles")
    counts = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("sets"))
    rank = F.row_number().over(Window.partitionBy("owner").orderBy("sets", "sig"))  # a set's own shingles
    needed = F.col("n") - F.ceil(F.lit(0.75) * F.col("n")) + 1
    ranked = rows.join(counts, "sig").withColumn("_rank", rank).filter((F.col("_rank") <= needed) & (F.col("sets") > 1))
    return ranked.select("sig", "owner", "n", (F.col("n") - F.col("_rank") + 1).alias("rest"))


def parities(texts: DataFrame) -> DataFrame:
    """``owner`` and the parity bits of its set."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches):
            bits = np.zeros((batch.num_rows, 64 * len(PARITY)), np.uint8)
            for row, text in enumerate(batch.column(1).to_pylist()):
                place = (mixed(shingles_of(text)) % np.uint64(64 * len(PARITY))).astype(np.int64)
                bits[row] = np.bincount(place, minlength=64 * len(PARITY)) % 2
            words = np.packbits(bits, axis=1).view(">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(words[:, k]) for k in range(len(PARITY)))], names=["owner", *PARITY])

    return texts.select("owner", "text").mapInArrow(reduce, "owner bigint, " + ", ".join(f"{c} bigint" for c in PARITY))


def _close_enough(one: str, two: str) -> Column:
    """Whether two sets may be similar that have this shingle as their first one in common, rarest first: all
    others they share come after it in both, and their parities differ in no more bits than the sets may."""
    apart = sum((F.bit_count(F.col(f"{c}{one}").bitwiseXOR(F.col(f"{c}{two}"))) for c in PARITY), F.lit(0))
    n, m, rest, other = F.col(f"n{one}"), F.col(f"n{two}"), F.col(f"rest{one}"), F.col(f"rest{two}")
    return (4 * F.least(n, m) >= 3 * F.greatest(n, m)) & (7 * F.least(rest, other) >= 3 * (n + m)) & (7 * apart <= n + m)


def _left_over(groups: DataFrame) -> DataFrame:
    """All pairs of different components that may be similar; partners meet by shingle and class of size, so sets
    that a common passage brings together, but not their sizes and the rest of their shingles, do not meet."""
    size_class = lambda n: F.floor(F.log(n) / math.log(SIZE_STEP)).cast("int")
    largest = F.least(F.floor(F.lit(4) * F.col("n_a") / 3), F.floor(F.lit(7) * F.col("rest_a") / 3) - F.col("n_a"))
    side = lambda c: groups.select("sig", *(F.col(x).alias(f"{x}_{c}") for x in ("owner", "n", "rest", "component", *PARITY)))
    smaller = side("a").withColumn("_most", largest).filter(F.col("_most") >= F.col("n_a"))
    smaller = smaller.withColumn("_class", F.explode(F.sequence(size_class(F.col("n_a")), size_class(F.col("_most") + 0.5)))).drop("_most")
    larger = side("b").filter(7 * F.col("rest_b") >= 3 * F.ceil(1.75 * F.col("n_b"))).withColumn("_class", size_class(F.col("n_b")))
    before = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("owner_a") < F.col("owner_b")))
    met = smaller.join(larger, ["sig", "_class"]).filter(before & (F.col("component_a") != F.col("component_b")) & _close_enough("_a", "_b"))
    return met.select(F.least("owner_a", "owner_b").alias("a"), F.greatest("owner_a", "owner_b").alias("b"))


def _filter_of(keys: DataFrame, column: str) -> np.ndarray:
    """Bitmap over hashes of a column, ``FILTER_BITS`` bits whatever the number of rows."""
    place = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))
    mask = F.expr("shiftleft(1L, cast(_place % 32 AS int))")
    words = keys.withColumn("_place", place).groupBy(F.shiftright("_place", 5).alias("word")).agg(F.bit_or(mask).alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    return out


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``owner``, ``h2`` and ``text`` of the classes ``wanted`` (``h1``, ``h2``, ``rep``)."""
    bitmap = docs.sparkSession.sparkContext.broadcast(_filter_of(wanted, "rep"))

    @F.pandas_udf("boolean")
    def maybe(places: pd.Series) -> pd.Series:
        at = places.to_numpy(np.int64)
        return pd.Series((bitmap.value[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) == 1)

    near = docs.select(_id().alias("rep"), "text").filter(maybe(F.pmod(F.xxhash64("rep"), F.lit(FILTER_BITS)))).select("text")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches):
            keys = [set_key(h) if len(h := shingles_of(t)) else (None, None) for t in batch.column(0).to_pylist()]
            columns = [pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(0)], names=["h1", "h2", "text"])

    # rows of one id, or of none, may have different texts: they meet their class by the set, not by the id
    found = near.mapInArrow(keyed, "h1 bigint, h2 bigint, text string").join(wanted.select("h1", "h2"), ["h1", "h2"], "left_semi")
    return found.groupBy(F.col("h1").alias("owner"), "h2").agg(F.min("text").alias("text"))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, left = None, None
    for batch in row_batches(batches):
        out = []
        for a, a2, b, b2, one, two in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            if last != (a, a2):
                last, left = (a, a2), shingles_of(one)
            right = shingles_of(two)
            both = len(np.intersect1d(left, right, assume_unique=True))
            out.append(100 * both >= 75 * (len(left) + len(right) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], names=["a", "b"]).filter(pa.array(out, pa.bool_()))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``: owners) whose sets are similar; a text travels to its partner, each pair once."""
    right = texts.select(F.col("owner").alias("b"), F.col("h2").alias("b2"), F.col("text").alias("two"))
    left = texts.select(F.col("owner").alias("a"), F.col("h2").alias("a2"), F.col("text").alias("one"))
    met = pairs.join(right, "b").join(left, "a").select("a", "a2", "b", "b2", "one", "two")
    return met.mapInArrow(_similar, "a bigint, b bigint").distinct()


def linked(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (``a``, ``b``) between owners that connect all components of similar sets."""
    pairs, burdened = segment_candidates(docs, classes)
    burdened = stored(burdened, "burdened")
    owners = pairs.select(F.col("a").alias("h1")).union(pairs.select("b")).union(burdened).distinct()
    wanted = stored(classes.join(owners, "h1", "left_semi").select("h1", "h2", "rep"), "wanted")
    texts = stored(_texts(docs, wanted), "texts")
    links, done = stored(verified(pairs, texts), "links"), pairs
    hot_texts = texts.join(burdened, "owner", "left_semi")
    active = stored(rarest_shingles(hot_texts).join(parities(hot_texts).dropDuplicates(["owner"]), "owner"), "rarest-shingles")
    alone = active.withColumn("component", F.col("owner"))
    groups = alone.groupBy("sig").agg(F.min("owner").alias("hub"), F.count(F.lit(1)).alias("members"))
    many = alone.join(groups.filter(F.col("members") > HOT), "sig")
    hubs = many.filter("owner = hub").select("sig", F.col("n").alias("n_hub"), F.col("rest").alias("rest_hub"), *(F.col(c).alias(f"{c}_hub") for c in PARITY))
    to_hub = many.filter("owner <> hub").join(hubs, "sig").filter(_close_enough("", "_hub")).select(F.col("hub").alias("a"), F.col("owner").alias("b"))
    few = alone.join(groups.filter((F.col("members") > 1) & (F.col("members") <= HOT)).select("sig"), "sig", "left_semi")
    pairs = stored(_left_over(few).union(to_hub).distinct().join(done, ["a", "b"], "left_anti"), "pairs")
    links, done = stored(links.union(verified(pairs, texts)), "links"), stored(done.union(pairs), "compared")
    # what is linked by now needs no comparison; a hub has met all of its group
    labels = components(links).withColumnRenamed("node", "owner")
    labelled = many.filter("owner <> hub").drop("component").join(labels, "owner", "left").withColumn("component", F.coalesce("component", "owner"))
    still_open = labelled.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("sig")
    left = stored(labelled.join(still_open, "sig", "left_semi"), "open-groups")
    pairs = stored(_left_over(left).distinct().join(done, ["a", "b"], "left_anti"), "pairs")
    return links.union(verified(pairs, texts))


def grouped(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs``: ``doc_id``, ``x1`` and ``x2`` of its text, ``n_shingles``, ``component`` (null
    for an empty set) and ``name``, the least id in the component (null if it has none)."""
    docs = docs.select("doc_id", "text")
    sets = stored(shingle_sets(docs), "shingle-sets")
    full = sets.filter("n_shingles > 0")
    classes = stored(
        full.groupBy("h1", "h2").agg(F.min(_id()).alias("rep"), F.min("spare_own").alias("spare_own"), F.min("spare_next").alias("spare_next"),
                                     F.min("n_shingles").alias("n"), F.floor(F.log2(F.min("n_shingles") + 0.5)).cast("int").alias("band")), "classes")
    labels = components(linked(docs, classes))
    whole = classes.join(labels.withColumnRenamed("node", "h1"), "h1", "left").withColumn("component", F.coalesce("component", "h1"))
    names = whole.groupBy("component").agg(F.min("rep").alias("name"))
    named = whole.join(names, "component").select("h1", "h2", "component", F.when(F.col("name") < NO_ID, F.col("name")).alias("name"))
    rows = ["doc_id", "x1", "x2", "n_shingles"]
    empty = sets.filter("n_shingles = 0").select(*rows, F.lit(None).cast("bigint").alias("component"), F.col("doc_id").alias("name"))
    return full.join(named, ["h1", "h2"]).select(*rows, "component", "name").union(empty)


def joined(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``docs`` (``doc_id``, ``text``)."""
    return grouped(docs).select("doc_id", "n_shingles", F.col("name").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, one of each component: the one with the least id (null last), then by the hashes of its text.

    Rows with equal ids and texts are interchangeable. Empty texts are linked with nothing, so all of them stay.
    """
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "x1", "x2")
    rows = stored(grouped(docs).filter("component IS NOT NULL").select("component", "doc_id", "x1", "x2"), "grouped")
    best = rows.groupBy("component").agg(F.min(place).alias("_best"))
    key = [F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("_id"), "x1", "x2"]
    keys = rows.join(best, "component").groupBy(*key).agg(
        F.count(F.lit(1)).alias("_rows"), F.max(place == F.col("_best")).alias("_kept"))
    # only what must go, and what must go down to one row
    marks = stored(keys.filter(~F.col("_kept") | (F.col("_rows") > 1)), "marks")
    names = ["_id", "x1", "x2"]
    marked = docs.withColumns(dict(zip(names, [_id(), *text_hashes()], strict=True))).join(marks, names, "left").filter("coalesce(_kept, true)")
    once = marked.filter("_rows > 1").dropDuplicates(names)
    return marked.filter("_rows IS NULL").union(once).select(*docs.columns)
