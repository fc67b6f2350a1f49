"""The event archive: gap markers, drift, empty days, and the pass that writes closed days."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox.functions.punctuality import is_permanent_gap
from signalbox.schemas import EVENT_TABLES, SCHEMA_VERSION, archive_schema
from signalbox.session import checkpointed
from signalbox.sources import store

# fixed values: what the writers are known to emit
KNOWN_VALUES: dict[tuple[str, str], tuple[str, ...]] = {
    ("discrepancy_events", "discrepancy_type"): (
        "route_id_mismatch", "start_time_mismatch", "start_date_mismatch", "schedule_relationship_mismatch",
        "vp_without_tu",
    ),
    ("poll_gap_events", "reason"): ("circuit_breaker",),
    ("trip_completion_events", "status"): ("on_time", "late", "cancelled", "undetermined_gap"),
}
GAP_TABLE = "poll_gap_events"
MANIFEST = "service_date date, table string"


def with_base_columns(events: DataFrame) -> DataFrame:
    """Archive columns of an ordinary row; the service date is that of its partition."""
    none = lambda kind: F.lit(None).cast(kind)
    return events.withColumns({
        "schema_version": F.lit(SCHEMA_VERSION), "is_gap_marker": F.lit(False), "gap_started_at": none("timestamp"),
        "gap_ended_at": none("timestamp"), "gap_reason": none("string"),
    })


def gap_markers(gaps: DataFrame) -> DataFrame:
    """Marker rows of a day's poll gaps, to be added to every other table of that day."""
    return gaps.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), "service_date", F.lit(True).alias("is_gap_marker"),
        F.col("started_at").alias("gap_started_at"), F.col("ended_at").alias("gap_ended_at"),
        F.col("reason").alias("gap_reason"),
    )


def archive_table(events: DataFrame, gaps: DataFrame, table: str) -> DataFrame:
    """Rows of one archive table: its events and, except for the gap table, the day's markers."""
    schema = archive_schema(table)
    rows = with_base_columns(events)
    if table != GAP_TABLE:
        rows = rows.unionByName(gap_markers(gaps), allowMissingColumns=True)
    return rows.select(*[
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
    ])


def without_markers(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("is_gap_marker"))


def drift(tables: Mapping[str, DataFrame], known: Mapping[tuple[str, str], tuple[str, ...]] = KNOWN_VALUES) -> DataFrame:
    """Values outside the known vocabulary, per registered column; never blocks anything."""
    found = [
        tables[table].filter(F.col(column).isNotNull() & ~F.col(column).isin(*values)).groupBy(
            F.lit(table).alias("table"), F.lit(column).alias("column"), F.col(column).alias("value")
        ).agg(F.count(F.lit(1)).alias("n"))
        for (table, column), values in known.items() if table in tables
    ]
    return reduce(DataFrame.unionByName, found)


def archive_path(base: str, table: str) -> str:
    return f"{base.rstrip('/')}/data/{table}"


def write_archive(rows: DataFrame, base: str, table: str) -> None:
    placed = rows.withColumns({"year": F.date_format("service_date", "yyyy"), "month": F.date_format("service_date", "MM")})
    store._write(placed, archive_path(base, table), ["year", "month", "service_date"], "overwrite")


def read_archive(spark: SparkSession, base: str, table: str) -> DataFrame:
    """Archive rows of any schema version; columns a file lacks are null."""
    schema = archive_schema(table)
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return store.read_table(spark, archive_path(base, table), ddl).select(*schema.names)


def empty_days(days: DataFrame, rows: DataFrame, table: str) -> DataFrame:
    """Days of the pass for which the table holds nothing, as manifest rows."""
    return days.select("service_date").join(rows.select("service_date"), "service_date", "left_anti").select(
        "service_date", F.lit(table).alias("table")
    )


def record_empty_days(spark: SparkSession, base: str, entries: DataFrame) -> None:
    path = f"{base.rstrip('/')}/_empty_days"
    known = store.read_table(spark, path, MANIFEST)
    entries.distinct().join(known, ["service_date", "table"], "left_anti").write.mode("append").parquet(path)


def archived_days(spark: SparkSession, base: str) -> DataFrame:
    """(service_date, table) pairs done, from the listing of the files written and from the empty-day manifest."""
    listed = [
        store.listed_files(spark, archive_path(base, table)).select("service_date", F.lit(table).alias("table"))
        for table in EVENT_TABLES
    ]
    manifest = store.read_table(spark, f"{base.rstrip('/')}/_empty_days", MANIFEST)
    return reduce(DataFrame.unionByName, listed).unionByName(manifest).distinct()


def fully_archived(done: DataFrame) -> DataFrame:
    """Days that every table has."""
    counts = done.distinct().groupBy("service_date").agg(F.count(F.lit(1)).alias("tables"))
    return counts.filter(F.col("tables") == len(EVENT_TABLES)).select("service_date")


def latest_archived(done: DataFrame) -> DataFrame:
    return done.agg(F.max("service_date").alias("latest_archived_date"))


def backlog(closed: DataFrame, done: DataFrame, today: Column) -> DataFrame:
    """How many closed days still wait and how old the oldest is."""
    waiting = closed.select("service_date").join(fully_archived(done), "service_date", "left_anti")
    return waiting.agg(
        F.count(F.lit(1)).alias("days_pending"), F.max(F.datediff(today, "service_date")).alias("oldest_age_days")
    )


def run_archive_pass(
    spark: SparkSession, base: str, backup_base: str, archive_base: str, report_path: str, now: datetime
) -> dict[str, DataFrame]:
    """Archive every closed day that is not complete yet, all days in one pass per table.

    Days come from both registries. Each day's files are tried first, each on its own: a day that is missing from the primary, or
    damaged there, is read from the backup and reported as recovered; one that neither side can give is reported as failed
    and holds no other day up. Only files of the days of the pass are opened.
    """
    at = F.lit(now)
    requested = store.read_table(spark, store.table_path(base, "_expected_days"), "service_date date")
    registered = {root: checkpointed(store.read_registry(spark, root).select("service_date").distinct()) for root in (base, backup_base)}
    candidates = reduce(DataFrame.unionByName, registered.values(), requested.select("service_date")).distinct()
    open_days = candidates.filter(store.is_closed("service_date", at)).join(
        fully_archived(archived_days(spark, archive_base)), "service_date", "left_anti")
    pending = [r.service_date for r in open_days.collect()]  # one entry a calendar day

    def listed(root: str) -> DataFrame:
        days = registered[root].filter(F.col("service_date").isin(pending))
        damaged = store.unreadable_days(spark, root, pending).withColumn("_bad", F.lit(True))
        return days.join(damaged, "service_date", "left").select("service_date", F.lit(root).alias("path"), F.col("_bad").isNull().alias("is_readable"))

    known = store.choose_partitions(listed(base), listed(backup_base))
    todo = checkpointed(spark.createDataFrame([(d,) for d in pending], "service_date date").join(known, "service_date", "left"))
    days = todo.filter(F.col("path").isNotNull())
    found = days.select("service_date", "path").collect()
    days_of = {root: [r.service_date for r in found if r.path == root] for root in (base, backup_base)}

    def rows_of(table: str) -> DataFrame:
        schema = f"{EVENT_TABLES[table]}, service_date date"
        parts = [
            store.read_table(spark, store.table_path(root, table), schema).filter(F.col("service_date").isin(own))
            for root, own in days_of.items()
        ]
        return parts[0].unionByName(parts[1])

    gaps = checkpointed(rows_of(GAP_TABLE))
    tables = {table: archive_table(rows_of(table), gaps, table) for table in EVENT_TABLES}
    findings = checkpointed(drift(tables))
    for table, rows in tables.items():
        write_archive(rows, archive_base, table)
        # the files now there tell which days have rows; nothing is read back
        written = store.listed_files(spark, archive_path(archive_base, table))
        record_empty_days(spark, archive_base, empty_days(days, written, table))

    failed = todo.filter(F.col("path").isNull())
    recovered = days.filter(F.coalesce("recovered", F.lit(False)))
    entry = lambda df, reason, healed, permanent: df.select(
        "service_date", at.alias("detected_at"), F.lit(reason).alias("reason"), F.lit(healed).alias("recovered"),
        permanent.alias("permanent"),
    )
    permanent = is_permanent_gap(F.col("service_date"), F.to_date(at))
    report = entry(failed, "missing_or_corrupt_partition_and_backup", False, permanent).unionByName(
        entry(recovered, "restored_from_backup", True, F.lit(False))
    )
    store.append_gap_report(report, report_path)
    return {
        "archived": days.select("service_date"), "failed": failed.select("service_date"),
        "recovered": recovered.select("service_date"), "drift": findings,
        "latest": latest_archived(archived_days(spark, archive_base)),
    }
