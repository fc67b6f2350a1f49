"""Day-partitioned event tables, their registry, and the tables derived from them.

Tables live under ``<base>/<table>/service_date=.../``.  A registry row per (day, table)
says that the day exists, so a day without events is told from a day never recorded.
Writes are rebalanced on the partition column: a very large day is split over several
tasks and files, small days are put together.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox.functions.gtfstime import service_date, service_date_boundary
from signalbox.operators.rollups import day_spine, in_days
from signalbox.schemas import EVENT_TABLES
from signalbox.session import checkpointed

# fixed values
CLOSE_BUFFER_MINUTES = 30
RETENTION_DAYS = 60
REPORT_RETENTION_DAYS = 182
REGISTRY = "service_date date, table string, digest string, opened_at timestamp"
GAP_REPORT = "service_date date, detected_at timestamp, reason string, recovered boolean, permanent boolean"


def table_path(base: str, table: str) -> str:
    return f"{base.rstrip('/')}/{table}"


def _present(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Declared columns of a Parquet table: missing columns come back null, a missing table empty."""
    if not _present(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _write(df: DataFrame, path: str, partitions: Sequence[str], mode: str) -> None:
    df.hint("rebalance", *partitions).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(
        *partitions
    ).parquet(path)


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """``service_date`` and ``file`` name of each data file of a day-partitioned table: a listing, no file is opened."""
    if not _present(spark, path):
        return spark.createDataFrame([], "service_date date, file string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path)
    day = F.regexp_extract("path", r"service_date=(\d{4}-\d{2}-\d{2})", 1)
    return files.select(F.to_date(F.nullif(day, F.lit(""))).alias("service_date"), F.element_at(F.split("path", "/"), -1).alias("file")).filter(
        "service_date IS NOT NULL")


def unreadable_days(spark: SparkSession, base: str, days: Sequence[date]) -> DataFrame:
    """Those of ``days`` with a file that cannot be read whole, in any event table; each file is tried on its own.

    A file is good if its footer opens and all its rows can be decoded: damaged files are skipped or cut short by the
    reader, so they have fewer rows than their footer says, or none where a file is listed.
    """
    wanted, bad = F.col("service_date").isin(list(days)), []
    for table, columns in EVENT_TABLES.items():
        path = table_path(base, table)
        if not _present(spark, path):
            continue
        rows = spark.read.schema(f"{columns}, service_date date").option("ignoreCorruptFiles", True).parquet(path).filter(wanted)
        per_file = rows.groupBy("service_date", F.col("_metadata.file_name").alias("file"))  # one write uses a name in several days
        footers = per_file.agg(F.count(F.lit(1)).alias("rows"))
        names = [f.name for f in rows.schema if f.name != "service_date"]
        # the hash is asked for below, so that every column is decoded
        decoded = per_file.agg(F.count(F.lit(1)).alias("decoded"), F.bit_xor(F.xxhash64(*names)).alias("hash"))
        listed = listed_files(spark, path).filter(wanted)
        # readers pass over files without a byte, which a listing by name still has
        folders = {f"{path}/service_date={d}": d for d in days}
        present = [f for f in folders if _present(spark, f)]
        names_of = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(present).inputFiles() if present else []
        sizes = {(r.service_date.isoformat(), r.file) for r in listed.collect()}  # the files of the days asked for
        empty = {x for f in names_of if (x := (f.rsplit("service_date=", 1)[1].split("/")[0], f.rsplit("/", 1)[1])) not in sizes}
        bad.append(spark.createDataFrame([(date.fromisoformat(d),) for d, _ in sorted(empty)], "service_date date"))
        bad.append(listed.join(footers, ["service_date", "file"], "left").join(decoded, ["service_date", "file"], "left").filter(
            "rows IS NULL OR decoded IS NULL OR decoded < rows OR hash IS NULL").select("service_date"))
    none = spark.createDataFrame([], "service_date date")
    return reduce(DataFrame.unionByName, bad, none).distinct()


# --- event tables ---


def append_events(events: DataFrame, base: str, table: str, at: str, recorded_at: Column | None = None) -> None:
    """Append rows to the service day their instant belongs to, stamped with the recording time."""
    stamped = events.withColumns({
        "service_date": service_date(at), "recorded_at": F.current_timestamp() if recorded_at is None else recorded_at
    })
    _write(stamped, table_path(base, table), ["service_date"], "append")


def read_registry(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, table_path(base, "_registry"), REGISTRY)


def register_days(spark: SparkSession, base: str, days: DataFrame) -> None:
    """Note (service_date, table, digest) once; known pairs are left alone."""
    keys = ["service_date", "table"]
    fresh = days.dropDuplicates(keys).join(read_registry(spark, base).select(*keys), keys, "left_anti")
    fresh.select(*keys, "digest", F.current_timestamp().alias("opened_at")).write.mode("append").parquet(
        table_path(base, "_registry")
    )


def read_days(spark: SparkSession, base: str, table: str, days: Sequence[date]) -> tuple[DataFrame, DataFrame]:
    """(events of the requested days, per-day coverage flag).

    The partition column prunes the scan.  A day is covered when the registry knows the
    table for it, even if it holds no rows.
    """
    events = in_days(read_table(spark, table_path(base, table), f"{EVENT_TABLES[table]}, service_date date"), days)
    known = read_registry(spark, base).filter(F.col("table") == table).select("service_date").distinct()
    return events, day_coverage(day_spine(spark, days), known)


def day_coverage(requested: DataFrame, known: DataFrame) -> DataFrame:
    return requested.join(known.select("service_date", F.lit(True).alias("_k")), "service_date", "left").select(
        "service_date", F.coalesce("_k", F.lit(False)).alias("is_covered")
    )


def missing_days(requested: DataFrame, known: DataFrame) -> DataFrame:
    """Requested days nothing is known about: unknown, not zero."""
    return requested.select("service_date").join(known.select("service_date"), "service_date", "left_anti")


# --- rollups, digests, pins, snapshots ---


def upsert_days(df: DataFrame, path: str) -> None:
    """Replace the service days present in ``df`` and leave the others; repeating it changes nothing else."""
    _write(df.withColumn("generated_at", F.current_timestamp()), path, ["service_date"], "overwrite")


def append_digest(digests: DataFrame, line_stats: DataFrame, base: str) -> None:
    digests.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(table_path(base, "weekly_digests"))
    line_stats.write.mode("append").parquet(table_path(base, "weekly_digest_line_stats"))


def new_pins(pins: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted (service_date, digest) pairs whose date is not pinned yet; the first pin of a date stands."""
    return wanted.join(pins.select("service_date"), "service_date", "left_anti")


def pin_first(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Write the new pins and return them."""
    pins = read_table(spark, path, "service_date date, digest string, pinned_at timestamp")
    fresh = checkpointed(new_pins(pins, wanted).withColumn("pinned_at", F.current_timestamp()))
    fresh.write.mode("append").parquet(path)
    return fresh


def store_snapshot(rows: DataFrame, path: str, known: DataFrame) -> None:
    """Append static rows of digests that are not stored yet."""
    fresh = rows.join(known.select("digest").distinct(), "digest", "left_anti")
    _write(fresh, path, ["digest"], "append")


# --- maintenance plans ---


def is_closed(day: Column | str, now: Column, buffer_minutes: int = CLOSE_BUFFER_MINUTES) -> Column:
    """No further write can reach the day: the next day has begun, plus a buffer."""
    column = F.col(day) if isinstance(day, str) else day
    return now >= service_date_boundary(F.date_add(column, 1)) + F.expr(f"INTERVAL {buffer_minutes} MINUTES")


def days_to_copy(primary: DataFrame, backup: DataFrame, now: Column) -> DataFrame:
    """Closed days not in the backup yet; closed partitions never change."""
    return primary.filter(is_closed("service_date", now)).join(
        backup.select("service_date"), "service_date", "left_anti"
    )


def copy_days(spark: SparkSession, base: str, backup_base: str, table: str, days: DataFrame) -> None:
    schema = f"{EVENT_TABLES[table]}, service_date date"
    rows = read_table(spark, table_path(base, table), schema).join(days.select("service_date"), "service_date", "left_semi")
    _write(rows, table_path(backup_base, table), ["service_date"], "overwrite")


def retention_plan(
    days: DataFrame, today: Column, retention_days: int = RETENTION_DAYS, must_be_in: DataFrame | None = None
) -> DataFrame:
    """What to do with each day: keep, delete, or skip because it is not backed up."""
    old = F.datediff(today, "service_date") > retention_days
    if must_be_in is None:
        return days.select("service_date", F.when(old, "delete").otherwise("keep").alias("action"))
    safe = must_be_in.select("service_date", F.lit(True).alias("_b")).distinct()
    return days.join(safe, "service_date", "left").select(
        "service_date",
        F.when(~old, "keep").when(F.col("_b"), "delete").otherwise("skipped_not_backed_up").alias("action"),
    )


def choose_partitions(primary: DataFrame, backup: DataFrame) -> DataFrame:
    """Where to read each known day from: the primary, else the backup, flagged as recovered.

    Both list (service_date, path, is_readable); a day neither side can read has no path.
    """
    usable = lambda df, name: df.select(
        "service_date", F.when(F.col("is_readable"), F.col("path")).alias(name)
    )
    both = usable(primary, "_p").join(usable(backup, "_b"), "service_date", "full")
    return both.select(
        "service_date", F.coalesce("_p", "_b").alias("path"),
        (F.col("_p").isNull() & F.col("_b").isNotNull()).alias("recovered"),
    )


# --- gap report ---


def append_gap_report(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def read_gap_report(spark: SparkSession, path: str) -> DataFrame:
    if not _present(spark, path):
        return spark.createDataFrame([], GAP_REPORT)
    return spark.read.schema(GAP_REPORT).json(path)


def prune_gap_report(spark: SparkSession, path: str, now: datetime, retention_days: int = REPORT_RETENTION_DAYS) -> int:
    """Drop entries detected before the cutoff; returns how many were dropped."""
    cutoff = F.lit(now - timedelta(days=retention_days))
    entries = checkpointed(read_gap_report(spark, path))
    removed = entries.filter(F.col("detected_at") < cutoff).count()
    if removed:
        entries.filter(F.col("detected_at") >= cutoff).write.mode("overwrite").json(path)
    return removed
