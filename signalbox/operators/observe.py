"""Delay features of running trips and their paced observation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbox.functions.gtfstime import parse_start_date
from signalbox.operators.alerts import is_active
from signalbox.operators.ordered import greedy_chain, ordered_scan

# fixed values
OBSERVATION_INTERVAL_S = 120
FEATURE_MAX_AGE_S = 60


def routes_with_alert(alerts: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(routes named by an active alert, one-row flag whether some active alert fits every route)."""
    current = alerts.filter(is_active(now))
    listed = current.select(F.explode("informed_entities").alias("_e"))
    named = listed.filter(F.col("_e.route_id").isNotNull()).select(F.col("_e.route_id").alias("route_id")).distinct()
    anywhere = (F.size("informed_entities") == 0) | F.exists("informed_entities", lambda e: e["route_id"].isNull())
    return named, current.agg(F.coalesce(F.bool_or(anywhere), F.lit(False)).alias("_everywhere"), F.lit(1).alias("_one"))


def delay_features(rows: DataFrame, termini: DataFrame, alerts: DataFrame, now: Column) -> DataFrame:
    """Current delay, stops remaining and alert flag of each snapshot; rows without all of them are left out.

    ``rows`` has trip_id, service_date, route_id and ``stop_time_updates``.
    """
    lowest = F.array_min(F.transform("stop_time_updates", lambda s: s["stop_sequence"]))
    nearest = F.get(F.filter("stop_time_updates", lambda s: s["stop_sequence"] == lowest), 0)
    named, everywhere = routes_with_alert(alerts, now)
    joined = (
        rows.join(termini.select("trip_id", "service_date", "terminus_sequence"), ["trip_id", "service_date"])
        .join(named.withColumn("_named", F.lit(True)), "route_id", "left")
        .withColumn("_one", F.lit(1)).join(F.broadcast(everywhere), "_one")
    )
    flag = F.col("route_id").isNotNull() & (F.col("_everywhere") | F.coalesce("_named", F.lit(False)))
    return joined.select(
        *rows.columns,
        F.coalesce(nearest["arr_delay"], nearest["dep_delay"]).alias("current_delay_s"),
        (F.col("terminus_sequence") - nearest["stop_sequence"]).cast("int").alias("stops_remaining"),
        flag.alias("active_alert_flag"),
    ).filter(F.col("current_delay_s").isNotNull() & (F.col("stops_remaining") >= 0))


def observable(rows: DataFrame) -> DataFrame:
    """Rows a delay can be observed on: dated, not cancelled, with stop updates."""
    return rows.withColumn("service_date", parse_start_date("start_date")).filter(
        F.col("service_date").isNotNull() & ~F.equal_null("relationship", F.lit("CANCELED"))
        & (F.size("stop_time_updates") > 0)
    )


def paced(
    rows: DataFrame, keys: Sequence[str] = ("trip_id",), at: str = "at", *, interval_s: int = OBSERVATION_INTERVAL_S,
    chunk_s: int = 3600,
) -> DataFrame:
    """Keep a key's first row, then each first row at least ``interval_s`` after the last kept one."""
    return greedy_chain(rows, keys, at, F.col(at) + interval_s, chunk_s=chunk_s)


def with_last_good(
    features: DataFrame, at: str = "at", *, tie: str | None = None, max_age_s: float = FEATURE_MAX_AGE_S,
) -> DataFrame:
    """Fill a cycle without features from the trip's last good ones when young enough, flagged stale.

    ``features``: trip_id, ``at`` and the struct column ``features`` (null when underivable).
    """
    scanned = ordered_scan(
        features, ["trip_id"], [at] + ([tie] if tie else []), F.floor(F.col(at) / 3600),
        fills_before={"_good": F.when(F.col("features").isNotNull(), F.struct(F.col(at).alias("at"), "features"))},
    )
    young = F.col(at) - F.col("_good.at") <= max_age_s
    stale = F.col("features").isNull() & F.coalesce(young, F.lit(False))
    return scanned.withColumns({
        "stale": stale, "features": F.when(stale, F.col("_good.features")).otherwise(F.col("features"))
    }).drop("_good")
