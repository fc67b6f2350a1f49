"""Ordered per-key operators that do not funnel a hot key through one task.

A plain window over ``partitionBy(key).orderBy(time)`` sends every row of a key to one task. Here every
key is cut into consecutive chunks of its order (for example hours); each chunk is windowed on its own,
and one summary row per (key, chunk) carries the previous/next row, running totals and last known values
across chunk borders. There is one plan whatever the size of a key, and the input is not counted first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalbox.session import checkpointed


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once per row however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    *,
    lags: Mapping[str, Column | str] | None = None,
    leads: Mapping[str, Column | str] | None = None,
    sums: Mapping[str, Column | str] | None = None,
    fills: Mapping[str, Column | str] | None = None,
    fills_before: Mapping[str, Column | str] | None = None,
    fills_after: Mapping[str, Column | str] | None = None,
    maxes_before: Mapping[str, Column | str] | None = None,
) -> DataFrame:
    """Add ordered columns per key.

    ``lags``/``leads``: value on the previous/next row.  ``sums``: running total up to and
    including the row.  ``fills``: last non-null value up to and including the row;
    ``fills_before``/``fills_after``: last/first non-null value strictly before/after it.
    ``maxes_before``: greatest value strictly before it.

    ``order`` must be non-null and unique per key, and ``chunk`` an integer that never
    decreases along it.  Without keys every row belongs to one sequence; its carry table
    has one row per chunk.
    """
    lags, leads, sums = dict(lags or {}), dict(leads or {}), dict(sums or {})
    fills, before, after = dict(fills or {}), dict(fills_before or {}), dict(fills_after or {})
    maxes = dict(maxes_before or {})
    keys, order = list(keys), list(order)
    out_names = [*df.columns, *lags, *leads, *sums, *fills, *before, *after, *maxes]

    base = df.withColumn("_chunk", chunk.cast("bigint"))
    group = [*keys, "_chunk"]

    # named so that an input already hashed on the key alone is spread over its chunks too
    local_in = base.repartition(*[F.col(c) for c in group])
    ahead = Window.partitionBy(*group).orderBy(*order)
    upto = ahead.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    strictly_before = ahead.rowsBetween(Window.unboundedPreceding, -1)
    # looking ahead walks the rows backwards: a frame ending unbounded would be rescanned for every row
    strictly_after = Window.partitionBy(*group).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    position = F.struct(*order)
    fill_values = {**{("f", n): c for n, c in fills.items()}, **{("b", n): c for n, c in before.items()}}
    pack = lambda cols: F.struct(*[_col(c).alias(n) for n, c in cols.items()])

    columns: dict[str, Column] = {}
    if lags:
        columns["_lag"] = F.lag(pack(lags)).over(ahead)
    if leads:
        columns["_lead"] = F.lead(pack(leads)).over(ahead)
    for name, c in sums.items():
        columns[f"_s_{name}"] = F.sum(_col(c)).over(upto)
    for name, c in fills.items():
        columns[f"_f_{name}"] = F.last(_col(c), ignorenulls=True).over(upto)
    for name, c in before.items():
        columns[f"_b_{name}"] = F.last(_col(c), ignorenulls=True).over(strictly_before)
    for name, c in after.items():
        columns[f"_a_{name}"] = F.last(_col(c), ignorenulls=True).over(strictly_after)
    for name, c in maxes.items():
        columns[f"_m_{name}"] = F.max(_col(c)).over(strictly_before)
    local = local_in.withColumns(columns)

    summary = []
    if lags:
        summary.append(F.max_by(pack(lags), position).alias("_t_lag"))
    if leads:
        summary.append(F.min_by(pack(leads), position).alias("_t_lead"))
    for name, c in sums.items():
        summary.append(F.sum(_col(c)).alias(f"_t_s_{name}"))
    for (kind, name), c in fill_values.items():
        summary.append(F.max_by(_col(c), F.when(_col(c).isNotNull(), position)).alias(f"_t_{kind}_{name}"))
    for name, c in after.items():
        summary.append(F.min_by(_col(c), F.when(_col(c).isNotNull(), position)).alias(f"_t_a_{name}"))
    for name, c in maxes.items():
        summary.append(F.max(_col(c)).alias(f"_t_m_{name}"))
    tails = local_in.groupBy(*group).agg(*summary)

    across = Window.partitionBy(*keys).orderBy("_chunk") if keys else Window.orderBy("_chunk")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*keys) if keys else Window
    later = back.orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carry = [F.col(k) for k in group]
    if lags:
        carry.append(F.lag("_t_lag").over(across).alias("_c_lag"))
    if leads:
        carry.append(F.lead("_t_lead").over(across).alias("_c_lead"))
    for name in sums:
        carry.append(F.sum(f"_t_s_{name}").over(earlier).alias(f"_c_s_{name}"))
    for kind, name in fill_values:
        carry.append(F.last(f"_t_{kind}_{name}", ignorenulls=True).over(earlier).alias(f"_c_{kind}_{name}"))
    for name in after:
        carry.append(F.last(f"_t_a_{name}", ignorenulls=True).over(later).alias(f"_c_a_{name}"))
    for name in maxes:
        carry.append(F.max(f"_t_m_{name}").over(earlier).alias(f"_c_m_{name}"))
    joined = local.join(tails.select(*carry), group, "left")

    result: dict[str, Column] = {}
    for names, part in ((lags, "lag"), (leads, "lead")):
        if names:
            chosen = F.coalesce(F.col(f"_{part}"), F.col(f"_c_{part}"))
            result.update({n: chosen.getField(n) for n in names})
    for name in sums:
        result[name] = F.coalesce(F.col(f"_s_{name}"), F.lit(0)) + F.coalesce(F.col(f"_c_s_{name}"), F.lit(0))
    for names, kind in ((fills, "f"), (before, "b"), (after, "a")):
        for name in names:
            result[name] = F.coalesce(F.col(f"_{kind}_{name}"), F.col(f"_c_{kind}_{name}"))
    for name in maxes:
        result[name] = F.greatest(F.col(f"_m_{name}"), F.col(f"_c_m_{name}"))  # passes over nulls
    return joined.withColumns(result).select(*out_names)


def global_rank(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Add the 1-based place of each row in the order of the whole table; ``order`` must be unique.

    Rows are dealt to ranges with sampled bounds, ranked inside their range, and moved up by the sizes of the ranges
    before it: no task gets more than a range, whatever values are frequent.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn(out, inside).join(F.broadcast(starts), "_range").withColumn(out, F.col(out) + F.col("_before")).drop("_range", "_before")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    *,
    chunk_width: float = 60.0,
) -> DataFrame:
    """Exact linear-interpolation quantiles per key without gathering a key's values.

    Values are counted first, the counts are accumulated along the value axis, and the
    two neighbours of each fractional rank are picked by a plain aggregate.
    """
    keys = list(keys)
    # one row per distinct value; read several times below, so the input is evaluated once
    counts = checkpointed(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_k")))
    running = ordered_scan(
        counts, keys, [value], F.floor(F.col(value) / chunk_width), sums={"_upto": "_k"}
    )
    totals = counts.groupBy(*keys).agg(F.sum("_k").alias("_total"))
    ranked = running.join(totals, keys)
    picks, outs = [], []
    for name, p in probs.items():
        rank = (F.col("_total") - 1) * F.lit(float(p))
        holds = lambda r: (F.col("_upto") - F.col("_k") <= r) & (F.col("_upto") > r)
        picks.append(F.max(F.when(holds(F.floor(rank)), F.col(value))).cast("double").alias(f"_lo_{name}"))
        picks.append(F.max(F.when(holds(F.ceil(rank)), F.col(value))).cast("double").alias(f"_hi_{name}"))
        picks.append(F.max(rank - F.floor(rank)).alias(f"_w_{name}"))
        lo, hi, w = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.col(f"_w_{name}")
        outs.append((lo + (hi - lo) * w).alias(name))
    return ranked.groupBy(*keys).agg(*picks).select(*keys, *outs)


def nearest_instant(
    queries: DataFrame, at: str, points: DataFrame, point: str, *, chunk_s: float = 3600.0
) -> DataFrame:
    """For each distinct query value: the nearest point at or before and at or after it.

    Both sides are reduced to distinct numeric values first, so equal instants are one
    row, then merged into a single chunked sequence.  Returns ``at``, ``prev_point``,
    ``next_point``; join it back on ``at``.
    """
    q = queries.select(F.col(at).alias("_v")).filter("_v is not null").distinct().withColumn("_q", F.lit(True))
    p = points.select(F.col(point).alias("_v")).filter("_v is not null").distinct().withColumn("_p", F.lit(True))
    merged = q.unionByName(p, allowMissingColumns=True).groupBy("_v").agg(
        F.max("_q").alias("_q"), F.max("_p").alias("_p")
    )
    here = F.when(F.col("_p"), F.col("_v"))
    scanned = ordered_scan(
        merged, [], ["_v"], F.floor(F.col("_v") / chunk_s),
        fills={"prev_point": here}, fills_after={"_following": here},
    )
    return scanned.filter("_q").select(
        F.col("_v").alias(at),
        "prev_point",
        F.coalesce(here, F.col("_following")).alias("next_point"),
    )


def greedy_chain(rows: DataFrame, keys: Sequence[str], at: str, next_at: Column, *, chunk_s: int) -> DataFrame:
    """Per key, take the first row, then always the first row not before the taken row's ``next_at``.

    Each choice depends on the one before, so a row points to the row that would be taken after it. A row that no
    earlier one's ``next_at`` reaches is taken in any case; chains start there and end where they meet the next such row. Pointers are
    then doubled: after round ``k`` all rows up to ``2**k`` choices from a start are known, so the rounds grow with the logarithm of
    the longest stretch without a gap, and no task sees more of a key than a chunk. ``at`` is unique per key.
    """
    keys = list(keys)
    chunk = lambda c: F.floor(F.col(c) / chunk_s)
    base = rows.select(*keys, F.col(at).cast("bigint").alias("_at"), next_at.cast("bigint").alias("_next"))
    opened = ordered_scan(base, keys, ["_at"], chunk("_at"), maxes_before={"_reached": "_next"})
    opened = checkpointed(opened.withColumn("_taken", F.coalesce(F.col("_at") >= F.col("_reached"), F.lit(True))).drop("_reached"))
    # the first row at or after each wanted instant: instants sort before rows of the same time
    points = opened.select(*keys, F.col("_at").alias("_v"), F.lit(1).alias("_kind"), "_taken")
    wanted = opened.select(*keys, F.col("_next").alias("_v")).distinct().withColumn("_kind", F.lit(0))
    row = F.when(F.col("_kind") == 1, F.struct(F.col("_v").alias("at"), F.col("_taken").alias("taken")))
    found = ordered_scan(
        points.unionByName(wanted, allowMissingColumns=True), keys, ["_v", "_kind"], chunk("_v"), fills_after={"_to": row},
    ).filter((F.col("_kind") == 0) & ~F.col("_to.taken")).select(*keys, F.col("_v").alias("_next"), F.col("_to.at").alias("_to"))
    state = checkpointed(opened.join(found, [*keys, "_next"], "left").select(*keys, "_at", "_taken", "_to"))
    while not state.filter("_to IS NOT NULL").isEmpty():
        pointed = state.filter("_to IS NOT NULL")
        taken = pointed.filter("_taken").select(*keys, F.col("_to").alias("_at"), F.lit(True).alias("_hit")).distinct()
        jumps = pointed.select(*keys, F.col("_at").alias("_to"), F.col("_to").alias("_jump"))
        state = checkpointed(
            state.join(taken, [*keys, "_at"], "left").join(jumps, [*keys, "_to"], "left")
            .select(*keys, "_at", (F.col("_taken") | F.coalesce("_hit", F.lit(False))).alias("_taken"), F.col("_jump").alias("_to"))
        )
    return rows.join(state.filter("_taken").select(*keys, F.col("_at").alias(at)), [*keys, at], "left_semi")
