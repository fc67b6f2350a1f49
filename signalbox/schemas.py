"""Declared schemas of the files and event tables."""

from __future__ import annotations

from pyspark.sql import types as T


def struct(ddl: str) -> T.StructType:
    """Parsed form of one of the schemas below; parsing needs a running session."""
    return T.StructType.fromDDL(ddl)


_TRANSLATED = "struct<translation: array<struct<text: string, language: string>>>"

# 64-bit integers of the feed arrive quoted, so they are declared as strings and cast
CAPTURE = (
    "fetch_timestamp string, fetch_latency_ms double, payload_bytes bigint, response_headers map<string,string>,"
    "feed struct<"
    " header: struct<gtfs_realtime_version: string, incrementality: string, timestamp: string>,"
    " entity: array<struct<id: string,"
    "  trip_update: struct<"
    "   trip: struct<trip_id: string, start_time: string, start_date: string,"
    "    schedule_relationship: string, route_id: string>,"
    "   stop_time_update: array<struct<stop_sequence: int, stop_id: string, schedule_relationship: string,"
    "    arrival: struct<delay: int, time: string>, departure: struct<delay: int, time: string>>>>,"
    "  vehicle: struct<"
    "   trip: struct<trip_id: string, route_id: string, start_time: string, start_date: string,"
    "    direction_id: int, schedule_relationship: string>,"
    "   position: struct<latitude: double, longitude: double, bearing: double, speed: double>,"
    "   timestamp: string, stop_id: string, current_status: string, occupancy_status: string,"
    "   vehicle: struct<id: string, label: string>>,"
    f"  alert: struct<cause: string, effect: string, header_text: {_TRANSLATED},"
    f"   description_text: {_TRANSLATED}, url: {_TRANSLATED},"
    "   active_period: array<struct<start: string, `end`: string>>,"
    "   informed_entity: array<struct<route_id: string, stop_id: string, direction_id: int>>>>>>"
)
CAPTURE_ERROR = ("fetch_timestamp string, error string, status_code int, body_snippet string")
RATE_LIMIT = "array<struct<window: string, type: string, remaining: bigint>>"

CALENDAR_FILE = (
    "service_id string, monday string, tuesday string, wednesday string, thursday string, friday string,"
    "saturday string, sunday string, start_date string, end_date string"
)
CALENDAR_DATES_FILE = ("service_id string, date string, exception_type string")

# event tables, without the archive columns
EVENT_TABLES: dict[str, str] = {
    "discrepancy_events": (
        "recorded_at timestamp, trip_id string, observed_at timestamp, discrepancy_type string,"
        "tu_value string, vp_value string"
    ),
    "ghost_events": (
        "recorded_at timestamp, trip_id string, last_seen_at timestamp, last_seen_lat double, last_seen_lon double,"
        "reappeared_at timestamp, reappear_lat double, reappear_lon double, loop_contained boolean,"
        "ghost_duration_s double, backoff_overlapped boolean, reason string"
    ),
    "poll_gap_events": (
        "recorded_at timestamp, started_at timestamp, ended_at timestamp, reason string,"
        "consecutive_failures int, max_level_reached_s double"
    ),
    "trip_completion_events": (
        "recorded_at timestamp, trip_id string, route_id string, scheduled_terminus_arrival timestamp,"
        "actual_terminus_arrival timestamp, delay_seconds int, status string"
    ),
    "delay_observation_events": (
        "recorded_at timestamp, trip_id string, route_id string, observed_at timestamp, current_delay_s int,"
        "stops_remaining int, active_alert_flag boolean"
    ),
}
ARCHIVE_COLUMNS = (
    "schema_version int, service_date date, is_gap_marker boolean, gap_started_at timestamp,"
    "gap_ended_at timestamp, gap_reason string"
)
SCHEMA_VERSION = 2


def archive_schema(table: str) -> T.StructType:
    return struct(f"{EVENT_TABLES[table]}, {ARCHIVE_COLUMNS}")
