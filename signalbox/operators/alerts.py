"""Service alerts: flattening, activity, matching, ordering.

An alert row has ``id``, ``pos`` (feed order), ``active_periods`` (array of
start_at/end_at) and ``informed_entities`` (array of route_id/stop_id/direction_id).
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbox.functions.punctuality import replacement_route_id
from signalbox.operators.feeds import epoch_instant, with_cycle
from signalbox.operators.schedule import routes_by_name

AXES = ("route_id", "stop_id", "direction_id")


def pick_translation(text: Column) -> Column:
    """English first, else the first entry, else null."""
    entries = text["translation"]
    english = F.get(F.filter(entries, lambda t: t["language"] == "en"), 0)["text"]
    has_english = F.exists(entries, lambda t: t["language"] == "en")
    return F.when(has_english, english).otherwise(F.get(entries, 0)["text"])


def alerts_of(captures: DataFrame) -> DataFrame:
    """One row per (cycle, alert id); the last entity of a poll wins."""
    e = with_cycle(captures).select("cycle_at", F.posexplode("feed.entity").alias("pos", "_e"))
    a = F.col("_e.alert")
    periods = F.transform(
        a["active_period"],
        lambda p: F.struct(epoch_instant(p["start"]).alias("start_at"), epoch_instant(p["end"]).alias("end_at")),
    )
    rows = e.filter(a.isNotNull() & F.col("_e.id").isNotNull()).select(
        "cycle_at", F.col("_e.id").alias("id"), "pos",
        a["cause"].alias("cause"), a["effect"].alias("effect"),
        pick_translation(a["header_text"]).alias("header_text"),
        pick_translation(a["description_text"]).alias("description_text"),
        pick_translation(a["url"]).alias("url"),
        F.coalesce(periods, F.array()).alias("active_periods"),
        F.coalesce(a["informed_entity"], F.array()).alias("informed_entities"),
    )
    rest = [c for c in rows.columns if c not in ("cycle_at", "id")]
    return rows.groupBy("cycle_at", "id").agg(F.max_by(F.struct(*rest), "pos").alias("_a")).select(
        "cycle_at", "id", "_a.*"
    )


def is_active(now: Column, periods: str = "active_periods") -> Column:
    """No period at all, or any period around ``now`` with inclusive and possibly open ends."""
    covers = lambda p: (p["start_at"].isNull() | (p["start_at"] <= now)) & (
        p["end_at"].isNull() | (p["end_at"] >= now)
    )
    return (F.size(periods) == 0) | F.exists(periods, covers)


def earliest_start(periods: str = "active_periods") -> Column:
    return F.array_min(F.transform(periods, lambda p: p["start_at"]))


def briefable(alerts: DataFrame, now: Column) -> DataFrame:
    """Active alerts that name at least one route."""
    return alerts.filter(is_active(now) & F.exists("informed_entities", lambda e: e["route_id"].isNotNull()))


def has_briefable(alerts: DataFrame, now: Column) -> DataFrame:
    return briefable(alerts, now).limit(1).agg((F.count(F.lit(1)) > 0).alias("has_briefable"))


def newest_first(alerts: DataFrame) -> DataFrame:
    """Latest earliest-start first, unknown starts last, feed order between equals."""
    return alerts.orderBy(earliest_start().desc_nulls_last(), "pos")


def alerts_matching(
    alerts: DataFrame, now: Column, route_id: str | None = None, stop_id: str | None = None,
    direction_id: int | None = None,
) -> DataFrame:
    """Active alerts compatible with one request; a null on either side matches anything."""
    wanted = {"route_id": route_id, "stop_id": stop_id, "direction_id": direction_id}

    def fits(e):
        ok = F.lit(True)
        for axis, value in wanted.items():
            if value is not None:
                ok = ok & (e[axis].isNull() | (e[axis] == F.lit(value)))
        return ok

    return newest_first(
        alerts.filter(is_active(now) & ((F.size("informed_entities") == 0) | F.exists("informed_entities", fits)))
    )


def shape_of() -> Column:
    """Which axes a row names: a digit per axis."""
    return F.concat(*[F.when(F.col(a).isNotNull(), "1").otherwise("0") for a in AXES])


def match_by_shape(alerts: DataFrame, requests: DataFrame, now: Column, key: str = "request_id") -> tuple[DataFrame, DataFrame]:
    """Alerts of many requests at once, wildcards on both sides: (``key``, id) pairs, and (shape, id) classes.

    ``requests`` has ``key`` and non-null or null route_id/stop_id/direction_id. Rows of both sides are told apart
    by shape, the axes they name. Two shapes that name an axis in common meet by equality on the axes that both name. Where they
    name none in common, as with a network-wide alert, every request of that shape matches: such an alert is one class row per
    request shape, valid for all requests with ``shape_of()`` equal to it, and is left out of the pairs. Only shapes that occur
    are filed, eight on each side at most.
    """
    current = alerts.filter(is_active(now))
    nothing = F.struct(*[F.lit(None).cast(t).alias(a) for a, t in zip(AXES, ("string", "string", "int"))])
    whole = F.when(F.size("informed_entities") == 0, F.array(nothing)).otherwise(
        F.transform("informed_entities", lambda e: F.struct(*[e[a].alias(a) for a in AXES]))
    )
    entities = current.select("id", F.explode(whole).alias("_e")).select("id", "_e.*").distinct().withColumn("_es", shape_of())
    asking = requests.select(key, *AXES, shape_of().alias("_rs"))
    shapes = lambda df, c: sorted(r[0] for r in df.select(c).distinct().collect())  # noqa: E731  at most eight
    named, asked = shapes(entities, "_es"), shapes(asking, "_rs")
    shared = {(e, r): [a for a, x, y in zip(AXES, e, r) if x == y == "1"] for e in named for r in asked}

    def filed(df: DataFrame, own: str, other: str, met: dict[str, list[tuple[str, list[str]]]]) -> DataFrame:
        """A row per shape of the other side that has axes in common, with their values."""
        values = lambda axes: F.concat_ws("|", *[F.coalesce(F.col(a).cast("string") if a in axes else F.lit(""), F.lit("")) for a in AXES])
        entry = lambda o, axes: F.struct(F.lit(o).alias(other), values(axes).alias("_k"))
        none = F.array().cast(f"array<struct<{other}: string, _k: string>>")
        out = none
        for shape, others in met.items():
            out = F.when(F.col(own) == shape, F.array(*[entry(o, axes) for o, axes in others]) if others else none).otherwise(out)
        return df.withColumn("_f", F.explode(out)).select("*", "_f.*").drop("_f")

    left = filed(entities, "_es", "_rs", {e: [(r, shared[e, r]) for r in asked if shared[e, r]] for e in named})
    right = filed(asking, "_rs", "_es", {r: [(e, shared[e, r]) for e in named if shared[e, r]] for r in asked})
    spark = alerts.sparkSession
    open_pairs = spark.createDataFrame([(e, r) for (e, r), axes in shared.items() if not axes], "_es string, shape string")
    classes = entities.select("id", "_es").distinct().join(F.broadcast(open_pairs), "_es").select("shape", "id").distinct()
    pairs = left.select("id", "_es", "_rs", "_k").join(right.select(key, "_es", "_rs", "_k"), ["_es", "_rs", "_k"]).select(key, "_rs", "id").distinct()
    by_rule = classes.withColumnRenamed("shape", "_rs")
    return pairs.join(by_rule, ["_rs", "id"], "left_anti").select(key, "id"), classes


def alike(alerts: DataFrame, now: Column, value: Column) -> DataFrame:
    """Active alerts with the same informed entities as one, with their number ``n`` and the sum ``s`` of ``value``.

    What matches one of them matches all. The rows are alerts to ``match_by_shape``: their ``id`` stands for the entities. Rows of
    one alert id are one alert, with the entities of all of them.
    """
    axes = lambda e: F.struct(*[e[a].alias(a) for a in AXES])
    nothing = F.struct(*[F.lit(None).cast(t).alias(a) for a, t in zip(AXES, ("string", "string", "int"))])
    whole = F.when(F.size("informed_entities") == 0, F.array(nothing)).otherwise(F.transform("informed_entities", axes))
    each = alerts.filter(is_active(now)).select("id", value.alias("_value"), whole.alias("_e")).groupBy("id").agg(
        F.first("_value").alias("_value"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_e")))).alias("informed_entities"))
    periods = F.array().cast("array<struct<start_at: timestamp, end_at: timestamp>>")
    return each.groupBy("informed_entities").agg(F.count(F.lit(1)).alias("n"), F.sum("_value").alias("s")).select(
        F.to_json("informed_entities", {"ignoreNullFields": "false"}).alias("id"), periods.alias("active_periods"), "informed_entities", "n", "s")


def asked() -> Column:
    """What a request asks for, as one value: equal for requests that the same alerts match."""
    return F.to_json(F.struct(*AXES), {"ignoreNullFields": "false"})


def match_alerts(alerts: DataFrame, requests: DataFrame, now: Column, key: str = "request_id") -> DataFrame:
    """(request, alert id) for many requests, written out in full: with many requests, work on ``match_by_shape`` instead."""
    pairs, classes = match_by_shape(alerts, requests, now, key)
    return pairs.unionByName(classes.join(requests.select(key, shape_of().alias("shape")), "shape").select(key, "id"))


def alerts_for_line(alerts: DataFrame, routes: DataFrame, name: str, now: Column) -> DataFrame:
    """Alerts of a named line and of its bus replacement, each alert once, in route order."""
    found = routes_by_name(routes, name)
    ids = found.select("route_id").unionByName(found.select(replacement_route_id("route_id").alias("route_id"))).distinct()
    requests = ids.select(
        F.col("route_id").alias("request_id"), "route_id", F.lit(None).cast("string").alias("stop_id"),
        F.lit(None).cast("int").alias("direction_id"),
    )
    first = match_alerts(alerts, requests, now).groupBy("id").agg(F.min("request_id").alias("matched_route_id"))
    return alerts.join(first, "id")


def name_entities(alerts: DataFrame, routes: DataFrame, inferred: DataFrame) -> DataFrame:
    """Line name per listed entity: by route id, else the alert's voted line for stop-only entities.

    ``inferred`` is (alert_id, long_name) from ``schedule.likely_lines``.
    """
    rows = alerts.select("id", F.posexplode("informed_entities").alias("ordinal", "_e")).select("id", "ordinal", "_e.*")
    named = routes.select("route_id", F.col("long_name").alias("_by_route"))
    voted = inferred.select(F.col("alert_id").alias("id"), F.col("long_name").alias("_by_vote"))
    stop_only = F.col("route_id").isNull() & F.col("stop_id").isNotNull()
    return rows.join(named, "route_id", "left").join(voted, "id", "left").select(
        "id", "ordinal", "route_id", "stop_id", "direction_id",
        F.when(F.col("route_id").isNotNull(), F.col("_by_route")).when(stop_only, F.col("_by_vote")).alias("route_name"),
    )


def display_fields(named_entities: DataFrame, alerts: DataFrame) -> DataFrame:
    """Distinct line names and the earliest start of each alert."""
    lines = named_entities.filter(F.col("route_name").isNotNull()).select("id", "route_name").distinct().groupBy("id").agg(
        F.array_sort(F.collect_set("route_name")).alias("line_names")
    )
    return alerts.select("id", earliest_start().alias("since")).join(lines, "id", "left").withColumn(
        "line_names", F.coalesce("line_names", F.array())
    )


def latest_alerts(alerts: DataFrame, polls: DataFrame, now: Column) -> DataFrame:
    """Alerts of the newest successful poll not after ``now``; each poll replaces all earlier ones.

    ``polls`` lists the successful alert polls (``cycle_at``), so an empty poll clears the set.
    """
    newest = polls.filter(F.col("cycle_at") <= now).agg(F.max("cycle_at").alias("cycle_at"))
    return alerts.join(newest, "cycle_at", "left_semi")
