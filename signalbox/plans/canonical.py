"""Transit-shaped projections of the driver tables (see FIXTURES.md section 3).

Each view here has a twin of the same name in ``oracle_views``; queries are written
against these, so they always read the whole underlying tables.
"""

from __future__ import annotations

from datetime import datetime, timezone
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalbox.functions.gtfstime import gtfs_text
from signalbox.functions.punctuality import punctuality_status
from signalbox.schemas import CAPTURE, struct

# request instants used by the point-in-time queries
SCHEDULE_NOW = datetime(1998, 6, 15, 2, 0, 0, tzinfo=timezone.utc)  # a Monday, local noon
FEED_NOW = datetime(2024, 1, 16, 0, 0, 0, tzinfo=timezone.utc)

_CALENDAR = """
SELECT * FROM VALUES
 ('1-URGENT', true, true, true, true, true, true, true, DATE'1995-01-01', DATE'2001-12-31'),
 ('2-HIGH', true, true, true, true, true, false, false, DATE'1995-01-01', DATE'2001-12-31'),
 ('3-MEDIUM', false, false, false, false, false, true, true, DATE'1995-01-01', DATE'2001-12-31'),
 ('4-NOT SPECIFIED', true, false, true, false, true, false, false, DATE'1995-01-01', DATE'2001-12-31'),
 ('5-LOW', false, true, false, true, false, true, false, DATE'1995-01-01', DATE'2001-12-31')
AS c(service_id, monday, tuesday, wednesday, thursday, friday, saturday, sunday, start_date, end_date)
"""
_CALENDAR_DATES = """
SELECT * FROM VALUES
 ('2-HIGH', DATE'1998-06-15', 2),
 ('3-MEDIUM', DATE'1998-06-15', 1),
 ('1-URGENT', DATE'1998-06-16', 2),
 ('5-LOW', DATE'1998-06-17', 1)
AS c(service_id, date, exception_type)
"""


def ts(value: datetime):
    """Literal instant."""
    return F.timestamp_seconds(F.lit(int(value.timestamp())))


def epoch(column) -> F.Column:
    """Whole epoch seconds of an instant as bigint."""
    return F.floor(F.unix_micros(column) / 1_000_000).cast("bigint")


def _route_of(nation):
    return F.when(nation < 20, F.concat(F.lit("R"), nation.cast("string"), F.lit(":"))).otherwise(
        F.concat(F.lit("R"), (nation - 20).cast("string"), F.lit("-R:"))
    )


def _entity_types() -> dict:
    entity = struct(CAPTURE)["feed"].dataType["entity"].dataType.elementType
    return {f.name: f.dataType for f in entity.fields}


class Tables:
    """Lazy access to the driver tables and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def routes(self) -> DataFrame:
        n = F.col("n_nationkey")
        return self.raw("nation").select(
            _route_of(n).alias("route_id"),
            F.when(n < 20, F.col("n_name")).otherwise("Replacement Bus").alias("short_name"),
            F.concat(F.lit("NATION_"), (n % 20).cast("string")).alias("long_name"),
        )

    @cached_property
    def trips(self) -> DataFrame:
        orders = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
        customers = self.raw("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        key = F.col("o_orderkey")
        return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
            key.alias("trip_no"),
            key.cast("string").alias("trip_id"),
            _route_of(F.col("c_nationkey")).alias("route_id"),
            F.col("o_orderpriority").alias("service_id"),
            (key % 2).cast("int").alias("direction_id"),
            F.to_date("o_orderdate").alias("start_date"),
            F.col("o_orderstatus").alias("order_status"),
            F.when(key % 10 == 0, F.lit("")).otherwise(F.col("c_mktsegment")).alias("headsign"),
            F.when(key % 4 != 0, F.concat(F.lit("SH"), (key % 5).cast("string"))).alias("shape_id"),
            F.concat(F.lit("D"), F.year("o_orderdate").cast("string")).alias("digest"),
        )

    @cached_property
    def sequenced_lines(self) -> DataFrame:
        """lineitem with ``seq`` (1-based position within the order) and ``is_last``."""
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
        lines = self.raw("lineitem").select("l_orderkey", *order)
        # the calls of one trip are few by their meaning: ranked as one window partition
        ahead = Window.partitionBy("l_orderkey").orderBy(*order)
        return lines.select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", F.row_number().over(ahead).cast("bigint").alias("seq"),
            F.lead(F.lit(True)).over(ahead).isNull().alias("is_last"),
        )

    @cached_property
    def stop_times(self) -> DataFrame:
        arrival = F.lit(18000) + (F.col("l_orderkey") * 7919) % 79200 + F.col("seq") * 180
        return self.sequenced_lines.select(
            F.col("l_orderkey").alias("trip_no"),
            F.col("l_orderkey").cast("string").alias("trip_id"),
            F.col("seq").alias("stop_sequence"),
            F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("stop_id"),
            arrival.alias("arr_s"),
            F.when(~F.col("is_last"), arrival + 30).alias("dep_s"),
        ).withColumns({"arrival_time": gtfs_text("arr_s"), "departure_time": gtfs_text("dep_s")}).withColumn(
            "departure_time", F.when(F.col("dep_s").isNotNull(), F.col("departure_time"))
        )

    @cached_property
    def stops(self) -> DataFrame:
        s, n = F.col("s_suppkey"), F.col("s_nationkey")
        supplier = self.raw("supplier")
        lat = lambda c: F.lit(-37.82) + (c % 20) * F.lit(0.001)
        lon = F.lit(144.955) + (n % 25) * F.lit(0.001)
        platforms = supplier.select(
            F.concat(F.lit("S"), s.cast("string")).alias("stop_id"),
            F.concat(F.lit("Stop "), s.cast("string")).alias("name"),
            F.concat(F.lit("P"), n.cast("string")).alias("parent_station"),
            F.lit(0).alias("location_type"),
            lat(s).alias("lat"),
            lon.alias("lon"),
            (s % 4 + 1).cast("string").alias("platform_code"),
            F.lit(None).cast("int").alias("wheelchair"),
        )
        stations = supplier.select("s_nationkey").distinct().select(
            F.concat(F.lit("P"), n.cast("string")).alias("stop_id"),
            F.concat(F.lit("NATION_"), n.cast("string"), F.lit(" Railway Station")).alias("name"),
            F.lit(None).cast("string").alias("parent_station"),
            F.lit(1).alias("location_type"),
            lat(n).alias("lat"),
            lon.alias("lon"),
            F.lit(None).cast("string").alias("platform_code"),
            (n % 3).cast("int").alias("wheelchair"),
        )
        return platforms.unionByName(stations)

    @cached_property
    def calendar(self) -> DataFrame:
        return self.spark.sql(_CALENDAR)

    @cached_property
    def calendar_dates(self) -> DataFrame:
        return self.spark.sql(_CALENDAR_DATES)

    @cached_property
    def pins(self) -> DataFrame:
        """One digest per date with orders; month-end dates stay unpinned."""
        day = F.to_date("o_orderdate")
        return (
            self.raw("orders").select(day.alias("service_date")).distinct()
            .filter(F.dayofmonth("service_date") != 31)
            .withColumn("digest", F.concat(F.lit("D"), F.year("service_date").cast("string")))
        )

    @cached_property
    def completions(self) -> DataFrame:
        k, seq = F.col("l_orderkey"), F.col("seq")
        delay = ((F.col("l_partkey") * 37 + seq * 101) % 1500 - 300).cast("int")
        ran = F.col("order_status") != "P"
        lines = self.sequenced_lines.join(self.trips, F.col("l_orderkey") == F.col("trip_no"))
        second_of_day = (F.col("l_suppkey") * 911 + k * 677) % 86400
        return lines.select(
            F.col("start_date").alias("service_date"),
            "trip_id",
            F.when((k * 7 + seq) % 41 != 0, F.col("route_id")).alias("route_id"),
            seq.alias("seq"),
            F.when(~ran, F.when((k + seq) % 2 == 0, "cancelled").otherwise("undetermined_gap"))
            .otherwise(punctuality_status(delay)).alias("status"),
            F.when(ran, delay).alias("delay_seconds"),
            F.when(
                ran, F.timestamp_seconds(F.unix_date("start_date").cast("bigint") * 86400 + second_of_day)
            ).alias("actual_at"),
        )

    @cached_property
    def observations(self) -> DataFrame:
        seq = F.col("seq")
        lines = self.sequenced_lines.join(self.trips, F.col("l_orderkey") == F.col("trip_no"))
        return lines.select(
            F.col("start_date").alias("service_date"),
            "trip_id",
            "route_id",
            seq.alias("seq"),
            ((F.col("l_partkey") * 37 + (seq - 1) * 101) % 1500 - 300).cast("int").alias("current_delay_s"),
            ((F.col("l_suppkey") * 13 + seq) % 12).cast("int").alias("stops_remaining"),
            (F.col("l_suppkey") % 2 == 1).alias("active_alert_flag"),
        )

    @cached_property
    def _events(self) -> DataFrame:
        return self.raw("events").select(
            "event_id", "user_id", "event_type", "value",
            F.get_json_object("props", "$.k").cast("bigint").alias("k"),
            F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        )

    @cached_property
    def polls(self) -> DataFrame:
        second = F.floor(F.col("ts_us") / 1_000_000)
        return self._events.select(
            F.col("event_id").alias("poll_id"),
            "ts_us",
            F.when(F.col("event_id") % 3 == 0, "vehicle_positions")
            .when(F.col("event_id") % 3 == 1, "trip_updates").otherwise("service_alerts").alias("feed"),
            (F.col("event_type") != "error").alias("ok"),
            F.col("k").alias("remaining"),
            (F.floor(second / 3600) * 3600).cast("bigint").alias("header_ts"),
            (F.col("k") % 7).alias("n_entities"),
            F.when(F.col("event_type") == "error", F.concat(F.lit("http_"), (F.col("k") % 4 + 500).cast("string")))
            .alias("error"),
        )

    def _run_columns(self):
        second = F.floor(F.col("ts_us") / 1_000_000)
        stamp = F.timestamp_seconds(second)
        return [
            F.date_format(stamp, "yyyyMMdd").alias("start_date"),
            F.concat(F.lpad((F.col("user_id") % 24).cast("string"), 2, "0"), F.lit(":00:00")).alias("start_time"),
        ]

    @cached_property
    def positions(self) -> DataFrame:
        user, k = F.col("user_id"), F.col("k")
        return self._events.filter(F.col("event_type").isin("view", "click")).select(
            "event_id", "ts_us",
            user.cast("string").alias("trip_id"),
            F.concat(
                F.lit("R"), ((user + F.when(k % 10 == 0, 1).otherwise(0)) % 20).cast("string"), F.lit(":")
            ).alias("route_id"),
            (F.lit(-37.82) + (k % 20) * F.lit(0.001)).alias("lat"),
            (F.lit(144.955) + (F.floor("value").cast("bigint") % 25) * F.lit(0.001)).alias("lon"),
            "k",
            *self._run_columns(),
        )

    @cached_property
    def trip_updates(self) -> DataFrame:
        user, k = F.col("user_id"), F.col("k")
        sequence = k % 12 + 1
        second = F.floor(F.col("ts_us") / 1_000_000).cast("bigint")
        return self._events.filter(F.col("event_type").isin("purchase", "signup")).select(
            "event_id", "ts_us",
            user.cast("string").alias("trip_id"),
            F.when(k % 31 != 0, F.concat(F.lit("R"), (user % 20).cast("string"), F.lit(":"))).alias("route_id"),
            sequence.alias("stop_sequence"),
            F.concat(F.lit("S"), ((user + sequence) % 10).cast("string")).alias("stop_id"),
            (F.floor(F.col("value") * 10).cast("bigint") - 200).alias("delay"),
            F.when(k % 25 == 0, "CANCELED").when(k % 25 == 1, "ADDED").otherwise("SCHEDULED").alias("relationship"),
            F.when(k % 6 != 0, second + 120).alias("arr_time"),
            F.when(k % 8 != 0, second + 150).alias("dep_time"),
            *self._run_columns(),
        )

    @cached_property
    def alerts(self) -> DataFrame:
        p = F.col("p_partkey")
        day = F.lit(int(datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp())) + (p % 30) * 86400
        return self.raw("part").select(
            p.cast("string").alias("id"),
            p.alias("pos"),
            F.col("p_type").alias("effect"),
            F.col("p_name").alias("header_text"),
            F.when(p % 3 != 0, F.concat(F.lit("R"), (p % 20).cast("string"), F.lit(":"))).alias("route_id"),
            F.when(p % 5 == 0, F.concat(F.lit("S"), (p % 10).cast("string"))).alias("stop_id"),
            F.when(p % 4 != 0, (p % 2).cast("int")).alias("direction_id"),
            F.when(p % 7 != 0, F.timestamp_seconds(day)).alias("start_at"),
            F.timestamp_seconds(day + F.col("p_size") * 86400).alias("end_at"),
            (p % 14 == 0).alias("no_period"),
            (p % 11 == 0).alias("no_entity"),
        )

    @cached_property
    def alert_rows(self) -> DataFrame:
        """Alerts with their period and entity arrays."""
        none = lambda kind: F.array().cast(kind)
        period, entity = F.array(F.struct("start_at", "end_at")), F.array(F.struct("route_id", "stop_id", "direction_id"))
        return self.alerts.select(
            "id", "pos", "effect", "header_text",
            F.when(F.col("no_period"), none("array<struct<start_at: timestamp, end_at: timestamp>>")).otherwise(period)
            .alias("active_periods"),
            F.when(F.col("no_entity"), none("array<struct<route_id: string, stop_id: string, direction_id: int>>"))
            .otherwise(entity).alias("informed_entities"),
        )

    def _capture(self, stamp, header, entities):
        return F.struct(
            F.struct(
                F.lit("2.0").alias("gtfs_realtime_version"), F.lit("FULL_DATASET").alias("incrementality"),
                header.cast("string").alias("timestamp"),
            ).alias("header"),
            entities.alias("entity"),
        ).alias("feed")

    @cached_property
    def update_captures(self) -> DataFrame:
        """One trip-update poll per purchase/signup: two updates (at times the same trip) and an empty entity."""
        kinds = _entity_types()
        none = lambda name: F.lit(None).cast(kinds[name]).alias(name)
        k, user = F.col("k"), F.col("user_id")
        second = F.floor(F.col("ts_us") / 1_000_000).cast("bigint")

        def update(label: str, trip, shift: int):
            stu = F.struct(
                (k % 12 + 1).cast("int").alias("stop_sequence"), F.lit("S1").alias("stop_id"),
                F.lit("SCHEDULED").alias("schedule_relationship"),
                F.when(k % 4 != 0, F.struct((k.cast("int") + shift).alias("delay"), second.cast("string").alias("time")))
                .alias("arrival"),
                F.when(k % 5 != 0, F.struct((k.cast("int") - shift).alias("delay"), second.cast("string").alias("time")))
                .alias("departure"),
            )
            body = F.struct(
                F.struct(
                    trip.cast("string").alias("trip_id"), F.lit("08:00:00").alias("start_time"),
                    F.date_format(F.timestamp_seconds(second), "yyyyMMdd").alias("start_date"),
                    F.when(k % 25 == 0, "CANCELED").otherwise("SCHEDULED").alias("schedule_relationship"),
                    F.concat(F.lit("R"), ((user + shift) % 20).cast("string"), F.lit(":")).alias("route_id"),
                ).alias("trip"),
                F.array(stu).alias("stop_time_update"),
            )
            return F.struct(
                F.lit(label).alias("id"), body.cast(kinds["trip_update"]).alias("trip_update"), none("vehicle"), none("alert")
            )

        empty = F.struct(F.lit("c").alias("id"), none("trip_update"), none("vehicle"), none("alert"))
        other = F.when(k % 3 == 0, user).otherwise(user + 1000)
        return self._events.filter(F.col("event_type").isin("purchase", "signup")).select(
            F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("fetch_timestamp"),
            self._capture(second, second - k, F.array(update("a", user, 0), update("b", other, 1), empty)),
        )

    @cached_property
    def vehicle_captures(self) -> DataFrame:
        """One vehicle-position poll per view/click."""
        kinds = _entity_types()
        none = lambda name: F.lit(None).cast(kinds[name]).alias(name)
        k, user = F.col("k"), F.col("user_id")
        second = F.floor(F.col("ts_us") / 1_000_000).cast("bigint")
        vehicle = F.struct(
            F.struct(
                user.cast("string").alias("trip_id"),
                F.when(k % 10 != 0, F.concat(F.lit("R"), (user % 20).cast("string"), F.lit(":"))).alias("route_id"),
                F.lit("").alias("start_time"), F.lit(None).cast("string").alias("start_date"),
                (user % 2).cast("int").alias("direction_id"), F.lit(None).cast("string").alias("schedule_relationship"),
            ).alias("trip"),
            F.struct(
                (F.lit(-37.82) + (k % 20) * F.lit(0.001)).alias("latitude"), F.lit(144.96).alias("longitude"),
                F.when(k % 2 == 0, k.cast("double")).alias("bearing"), F.lit(None).cast("double").alias("speed"),
            ).alias("position"),
            F.when(k % 3 != 0, (second - 5).cast("string")).alias("timestamp"),
            F.when(k % 4 == 0, "S1").otherwise("").alias("stop_id"),
            F.when(k % 7 != 0, "IN_TRANSIT_TO").alias("current_status"), F.lit(None).cast("string").alias("occupancy_status"),
            F.struct(user.cast("string").alias("id"), F.when(k % 6 != 0, F.lit("car")).alias("label")).alias("vehicle"),
        )
        entity = F.struct(
            F.lit("v").alias("id"), none("trip_update"), vehicle.cast(kinds["vehicle"]).alias("vehicle"), none("alert")
        )
        return self._events.filter(F.col("event_type").isin("view", "click")).select(
            F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("fetch_timestamp"),
            self._capture(second, second, F.array(entity)),
        )

    @cached_property
    def alert_captures(self) -> DataFrame:
        """One alert poll per part: an alert, and at times a later one of the same id or one without an id."""
        kinds = _entity_types()
        none = lambda name: F.lit(None).cast(kinds[name]).alias(name)
        p = F.col("p_partkey")
        say = lambda text, lang: F.struct(text.alias("text"), F.lit(lang).alias("language"))
        name, brand = F.col("p_name"), F.col("p_brand")
        words = F.when(p % 3 == 0, F.array(say(brand, "fr"), say(name, "en"))).when(p % 3 == 1, F.array(say(brand, "fr")))
        start = F.lit(1704067200) + (p % 30) * 86400

        def alert(effect):
            return F.struct(
                F.lit("UNKNOWN").alias("cause"), effect.alias("effect"),
                F.struct(words.alias("translation")).alias("header_text"),
                F.struct(F.array(say(name, "en")).alias("translation")).alias("description_text"),
                F.lit(None).cast("struct<translation: array<struct<text: string, language: string>>>").alias("url"),
                F.when(p % 14 != 0, F.array(F.struct(
                    F.when(p % 7 != 0, start.cast("string")).alias("start"),
                    (start + F.col("p_size") * 86400).cast("string").alias("end")))).alias("active_period"),
                F.when(p % 11 != 0, F.array(F.struct(
                    F.when(p % 3 != 0, F.concat(F.lit("R"), (p % 20).cast("string"), F.lit(":"))).alias("route_id"),
                    F.lit(None).cast("string").alias("stop_id"), F.lit(None).cast("int").alias("direction_id"))))
                .alias("informed_entity"),
            ).cast(kinds["alert"]).alias("alert")

        entry = lambda ident, effect: F.struct(
            ident.alias("id"), none("trip_update"), none("vehicle"), alert(effect)
        )
        later = F.when(p % 6 == 0, p.cast("string"))
        return self.raw("part").select(
            F.date_format(F.timestamp_seconds(F.lit(1704067200) + p), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("fetch_timestamp"),
            self._capture(p, p, F.array(entry(p.cast("string"), F.col("p_type")), entry(later, F.lit("REPLACED")))),
        )

    @cached_property
    def snapshots(self) -> DataFrame:
        """Every trip update as a snapshot with a three-stop update window."""
        k, second = F.col("k"), F.floor(F.col("ts_us") / 1_000_000).cast("bigint")
        base = self._events.filter(F.col("event_type").isin("purchase", "signup"))
        user = F.col("user_id")
        delay = F.floor(F.col("value") * 10).cast("bigint") - 200

        def update(i: int):
            sequence = k % 12 + 1 + i
            return F.struct(
                sequence.alias("stop_sequence"),
                F.concat(F.lit("S"), ((user + sequence) % 10).cast("string")).alias("stop_id"),
                F.when((k + i) % 13 == 0, "SKIPPED").otherwise("SCHEDULED").alias("relationship"),
                F.when((k + i) % 6 != 0, (second + i * 300 - 200).cast("string")).alias("arr_time"),
                F.when((k + i) % 8 != 0, (second + i * 300 - 170).cast("string")).alias("dep_time"),
                F.when((k + i) % 5 != 0, delay.cast("int")).alias("arr_delay"),
                F.when((k + i) % 4 != 0, (delay + 10).cast("int")).alias("dep_delay"),
            )

        return base.select(
            "event_id", "ts_us",
            user.cast("string").alias("trip_id"),
            F.when(k % 31 != 0, F.concat(F.lit("R"), (user % 20).cast("string"), F.lit(":"))).alias("route_id"),
            F.when(k % 25 == 0, "CANCELED").when(k % 25 == 1, "ADDED").otherwise("SCHEDULED").alias("relationship"),
            F.timestamp_seconds(second + (k * 7) % 900 - 300).alias("now_at"),
            F.date_format(F.timestamp_seconds(second), "yyyyMMdd").alias("start_date"),
            F.array(*[update(i) for i in range(3)]).alias("stop_time_updates"),
            (F.lit(-37.82) + (k % 20) * F.lit(0.001)).alias("lat"),
            (F.lit(144.955) + (user % 25) * F.lit(0.001)).alias("lon"),
        )

    @cached_property
    def latest_snapshots(self) -> DataFrame:
        """Newest snapshot per trip."""
        rest = [c for c in self.snapshots.columns if c != "trip_id"]
        newest = F.max_by(F.struct(*rest), F.struct("ts_us", "event_id"))
        return self.snapshots.groupBy("trip_id").agg(newest.alias("_s")).select("trip_id", "_s.*")

    @cached_property
    def shapes(self) -> DataFrame:
        c = F.col("c_custkey")
        return self.raw("customer").select(
            F.concat(F.lit("SH"), (c % 6).cast("string")).alias("shape_id"),
            F.floor(c / 6).cast("bigint").alias("shape_pt_sequence"),
            (F.lit(-37.9) + (c % 97) * F.lit(0.001)).alias("lat"),
            (F.lit(144.9) + (c % 89) * F.lit(0.001)).alias("lon"),
        )

    @cached_property
    def alert_stops(self) -> DataFrame:
        """Stop lists of alerts that name no route."""
        p = F.col("p_partkey")
        ordinals = F.explode(F.sequence(F.lit(0), (p % 3).cast("int")))
        return self.raw("part").select(p.cast("string").alias("alert_id"), p, ordinals.alias("ordinal")).select(
            "alert_id", "ordinal", F.concat(F.lit("S"), ((p + F.col("ordinal") * 7) % 10).cast("string")).alias("stop_id")
        )

    @cached_property
    def stop_home_lines(self) -> DataFrame:
        """(stop_id, route_id): the line of the nation a supplier belongs to."""
        return self.raw("supplier").select(
            F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("stop_id"),
            _route_of(F.col("s_nationkey")).alias("route_id"),
        )
