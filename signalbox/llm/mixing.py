"""Mix sources to target weights.

Each row gets a hash-random key. A source's key range is cut into buckets of about ``BUCKET_ROWS``
rows; word counts are summed per bucket and a prefix sum over the few bucket rows tells where each
bucket begins. Rows are then sorted inside their bucket only, and the running count is cut at the
exact budget of the source: ``floor(target / size)`` whole epochs and a last one up to the cut.

Targets: sources in code-point order (null last) weigh ``weights``, repeating; together they get
``share`` times all words; no source gets more than ``most`` times its own, the excess goes to the
others by weight until none is above.

Edge cases: null texts have no words and are never taken; a null source is a source of its own; rows
with equal id and size are interchangeable; an empty table gives an empty result. Columns named
like the results are replaced, all others are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalbox.llm.common import WORD, stored

BUCKET_ROWS = 4096
RESULTS = ("size", "source_size", "target", "taken")


def _key() -> Column:
    """Hash-random, the same in every run; md5 so that SQL engines agree on it."""
    return F.md5(F.concat(F.lit("mix-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _source() -> Column:
    """Sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``_source``, ``source_size``, ``target`` and ``_buckets`` from rows of (``_source``, ``size``)."""
    totals = stored(sizes.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows")), "mix-sources")
    # one row per source from here on
    rank = F.row_number().over(Window.orderBy("_source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    capped = stored(totals.withColumn("_weight", weight).withColumn("_cap", most * F.col("source_size")), "mix-weights")
    budget, level = (capped.agg(share * F.sum("source_size"), F.sum("_weight")).first() or (0, 0))
    level = (budget or 0) / level if level else 0.0
    while True:
        full = F.col("_cap") <= level * F.col("_weight")
        taken, rest = capped.agg(F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("_weight")))).first()
        higher = ((budget or 0) - (taken or 0)) / rest if rest else level
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    target = F.round(F.least(F.col("_cap"), F.col("_weight") * F.lit(float(level))), 6)
    return capped.select("_source", "source_size", target.alias("target"), F.ceil(F.col("_rows") / BUCKET_ROWS).alias("_buckets"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, size: Column | None = None) -> DataFrame:
    """Rows of ``docs`` (``doc_id``, ``source``, ``text`` unless ``size`` is given) with ``size``,
    ``source_size``, ``target`` and ``taken``, the words that the mix takes of the row, repeats counted."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long") if size is None else size
    keyed = docs.withColumn("size", size).drop(*(c for c in RESULTS if c != "size"))
    keyed = keyed.withColumns({"_source": _source(), "_key": _key()})
    slim = stored(keyed.select("_source", "_key", "size"), "mix-sizes")
    sources = stored(source_targets(slim, weights, share, most), "mix-targets")

    def bucketed(df: DataFrame) -> DataFrame:
        # the source table is small or not by its measured size; a hot source is split by adaptive execution
        place = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * F.col("_buckets")
        return df.join(sources, "_source").withColumn("_bucket", F.shiftright(place, 32))

    sums = bucketed(slim).groupBy("_source", "_bucket").agg(F.sum("size").alias("_words"))
    earlier = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_source", "_bucket", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_source", "_bucket").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.floor("target")
    epochs = F.coalesce(F.floor(budget / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0))
    before = F.col("_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    last = F.greatest(F.lit(0), F.least(F.col("size"), budget - epochs * F.col("source_size") - before))
    return (
        bucketed(keyed).join(starts, ["_source", "_bucket"])
        .withColumn("taken", (epochs * F.col("size") + last).cast("long"))
        .drop("_source", "_bucket", "_buckets", "_start", "_key")
    )


def copies(docs: DataFrame, whole: bool = False, **options) -> DataFrame:
    """The mix itself: a row per whole copy taken and one with the first words of the document at a cut.

    ``whole``: no text is cut; the document at a cut is taken if that is nearer the target.
    """
    plan = mixed(docs, **options).filter("taken > 0")
    rest = F.col("taken") % F.col("size")
    if not whole:
        words = F.slice(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)), 1, rest.cast("int"))
        out = plan.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
        partial = (rest > 0) & (F.col("_copy") * F.col("size") > F.col("taken"))
        return out.withColumn("text", F.when(partial, F.concat_ws(" ", words)).otherwise(F.col("text"))).select(*docs.columns)
    times = F.floor(F.col("taken") / F.col("size")) + F.when(2 * rest >= F.col("size"), 1).otherwise(0)
    return plan.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select(*docs.columns)
