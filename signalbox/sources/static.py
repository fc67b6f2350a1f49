"""Static timetable scans: delimited files and zipped archives.

Both ways give string columns by header name; the ``parse_*`` functions turn those into
typed tables. ``pos`` orders the rows by file name, place in the file and row, where a last-row-wins rule needs it.
"""

from __future__ import annotations

import csv
import hashlib
import io
import zipfile
from collections.abc import Iterator, Sequence
from typing import IO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox.operators.schedule import WEEKDAYS
from signalbox.session import checkpointed

# fixed values
METRO_MODE = "2"
INNER_ARCHIVE = "google_transit.zip"
BLOCK_BYTES = 1 << 20
BLOCK_SCHEMA = "digest string, mode string, member string, block bigint, header array<string>, records array<string>"
FILE_POSITION = "struct<file: string, start: bigint, row: bigint>"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header-named string columns of one GTFS file or folder (a byte-order mark is dropped).

    ``pos``: a split is read by one task from its start, so ids that rise in a task order its rows, whatever task it went to.
    """
    return spark.read.option("header", True).option("escape", '"').csv(path).withColumn("pos", F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row")))


def read_optional_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Like ``read_csv`` but an absent file is an empty table."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return read_csv(spark, path)
    return spark.createDataFrame([], ", ".join(f"{c} string" for c in columns) + f", pos {FILE_POSITION}")


def _members(content: bytes, modes: Sequence[str] | None) -> Iterator[tuple[str, str, str, zipfile.ZipFile]]:
    """(digest, mode, member, archive) for each text member, looking into one level of inner archives."""
    with zipfile.ZipFile(io.BytesIO(content)) as outer:
        inner = {n.split("/")[0]: n for n in outer.namelist() if n.endswith("/" + INNER_ARCHIVE)}
        if not inner:
            digest = hashlib.sha256(content).hexdigest()
            for name in outer.namelist():
                if name.endswith(".txt"):
                    yield digest, "", name, outer
            return
        wanted = list(inner) if modes is None else list(modes)
        if absent := sorted(set(wanted) - set(inner)):
            raise ValueError(f"archive holds the modes {sorted(inner)}, asked for {absent}")
        for mode in wanted:
            for digest, _, name, archive in _members(outer.read(inner[mode]), None):
                yield digest, mode, name, archive


def _record_end(held: bytes) -> int:
    """Where the last whole record ends: after a line end that is in no quotes."""
    end = held.rfind(b"\n")
    while end >= 0 and held.count(b'"', 0, end) % 2:
        end = held.rfind(b"\n", 0, end)
    return end + 1


def _records(raw: IO[bytes], size: int = BLOCK_BYTES) -> Iterator[list[str]]:
    """Records of a member, about ``size`` bytes of them at a time; a record may have line ends in quotes."""
    held, more = b"", True
    while more:
        data = raw.read(size)
        held, more = held + data, bool(data)
        end = _record_end(held) if more else len(held)
        lines, held = held[:end].decode("utf-8").split("\n"), held[end:]
        if any(line.count('"') % 2 for line in lines if '"' in line):
            whole: list[str] = []
            for line in lines:
                if whole and whole[-1].count('"') % 2:
                    whole[-1] += "\n" + line
                else:
                    whole.append(line)
            lines = whole
        lines = [line.rstrip("\r") for line in lines if line.strip()]
        if lines:
            yield lines


def _named(header: str) -> list[str]:
    """Column names; those without one, or with one that occurred before, are numbered."""
    names = next(csv.reader([header.removeprefix("\ufeff")]))
    return [n if n and n not in names[:k] else f"_{k}" for k, n in enumerate(names)]


def unpacked(
    archives: DataFrame, modes: Sequence[str] | None = (METRO_MODE,), members: Sequence[str] | None = None, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Rows of the text members of zipped timetables (``content``), keyed by the digest of the archive they came from.

    A zip is inflated by one task, as it cannot be split, but only cut into blocks of whole records there; the
    blocks are then dealt out and parsed on the JVM. ``pos`` is the place of a row in its member. An archive without one
    of the ``modes`` is an error.
    """
    wanted = set(members) if members else None

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                for digest, mode, name, archive in _members(content, modes):
                    if wanted is not None and name not in wanted:
                        continue
                    with archive.open(name) as raw:
                        header = None
                        for block, records in enumerate(_records(raw, block_bytes)):
                            if header is None:
                                header, records = _named(records[0]), records[1:]
                            yield pd.DataFrame([(digest, mode, name, block, header, records)], columns=["digest", "mode", "member", "block", "header", "records"])

    # inflated once: the widest header is asked for before the rows are parsed
    blocks = checkpointed(archives.select("content").mapInPandas(cut, BLOCK_SCHEMA))
    width = blocks.agg(F.max(F.size("header")).alias("n")).first().n or 0
    places = [f"c{k}" for k in range(width)]
    nulls = F.array_repeat(F.lit(None).cast("string"), width)
    schema = F.lit(", ".join(f"{c} string" for c in places) or "c0 string")

    def cells(record: Column) -> Column:
        """Values of a record, blank ones null. One without quotes is cut at its commas, which gives the same as the parser."""
        parsed = F.from_csv(record, schema, {"escape": '"', "multiLine": "true"})
        listed = F.flatten(F.transform(F.array(parsed), lambda v: F.array(*[v[c] for c in places]).cast("array<string>")))
        odd = F.contains(record, F.lit('"')) | F.contains(record, F.lit("\r"))
        return F.when(odd, listed).otherwise(F.transform(F.split(record, ",", -1), lambda v: F.nullif(v, F.lit(""))))

    # worked out where the records are laid out, once each: a filter on a field is not turned into another parse below it
    fields = F.transform("records", lambda r: F.map_from_arrays("header", F.slice(F.concat(cells(r), nulls), F.lit(1), F.size("header"))))
    dealt = blocks.repartition("digest", "mode", "member", "block").select(
        "digest", "mode", "member", "block", F.posexplode(fields).alias("row", "fields"))
    return dealt.select("digest", "mode", "member", (F.shiftleft("block", 32) + F.col("row")).alias("pos"), "fields")


def read_archives(
    spark: SparkSession, path: str, modes: Sequence[str] | None = (METRO_MODE,), members: Sequence[str] | None = None
) -> DataFrame:
    """``unpacked`` archive files."""
    return unpacked(spark.read.format("binaryFile").load(path), modes, members)


def member_rows(lines: DataFrame, member: str, columns: Sequence[str]) -> DataFrame:
    """One member of the ingested archives as string columns."""
    return lines.filter(F.col("member") == member).select(
        "digest", "pos", *[F.col("fields")[c].alias(c) for c in columns]
    )


def new_snapshots(lines: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of archives whose digest is not stored yet."""
    return lines.join(known.select("digest").distinct(), "digest", "left_anti")


def _text(df: DataFrame, name: str, blank: str | None = None) -> Column:
    """Trimmed column, blank or absent giving ``blank``."""
    if name not in df.columns:
        return F.lit(blank).cast("string").alias(name)
    value = F.nullif(F.trim(F.col(name)), F.lit(""))
    return (value if blank is None else F.coalesce(value, F.lit(blank))).alias(name)


def _keys(df: DataFrame) -> list[str]:
    return ["digest"] if "digest" in df.columns else []


def parse_calendar(df: DataFrame) -> DataFrame:
    return df.select(
        *_keys(df), "service_id",
        *[F.coalesce(F.trim(F.col(d)) == "1", F.lit(False)).alias(d) for d in WEEKDAYS],
        F.to_date(F.trim("start_date"), "yyyyMMdd").alias("start_date"),
        F.to_date(F.trim("end_date"), "yyyyMMdd").alias("end_date"),
    )


def parse_calendar_dates(df: DataFrame) -> DataFrame:
    return df.select(
        *_keys(df), "service_id", F.to_date(F.trim("date"), "yyyyMMdd").alias("date"),
        F.trim("exception_type").cast("int").alias("exception_type"),
    )


def parse_trips(df: DataFrame) -> DataFrame:
    return df.select(
        *_keys(df), "trip_id", "route_id", "service_id",
        _text(df, "trip_headsign", "").alias("headsign"), _text(df, "direction_id").cast("int").alias("direction_id"),
        _text(df, "shape_id"),
    )


def parse_stop_times(df: DataFrame) -> DataFrame:
    return df.select(
        *_keys(df), "trip_id", F.trim("stop_sequence").cast("bigint").alias("stop_sequence"), "stop_id",
        _text(df, "arrival_time"), _text(df, "departure_time"), "pos",
    )


def parse_stops(df: DataFrame) -> DataFrame:
    """Stops, a station never having a parent; the last row of an id wins."""
    kind = _text(df, "location_type", "0")
    rows = df.select(
        *_keys(df), "stop_id", "pos", _text(df, "stop_name", "").alias("name"), kind.cast("int").alias("location_type"),
        F.when(kind != "1", _text(df, "parent_station")).alias("parent_station"),
        _text(df, "stop_lat").cast("double").alias("lat"), _text(df, "stop_lon").cast("double").alias("lon"),
        _text(df, "platform_code"), _text(df, "wheelchair_boarding").alias("wheelchair"),
    )
    return last_row(rows, [*_keys(df), "stop_id"])


def parse_routes(df: DataFrame) -> DataFrame:
    rows = df.select(
        *_keys(df), "route_id", "pos", _text(df, "route_short_name", "").alias("short_name"),
        _text(df, "route_long_name", "").alias("long_name"),
    )
    return last_row(rows, [*_keys(df), "route_id"])


def parse_shapes(df: DataFrame) -> DataFrame:
    return df.select(
        *_keys(df), "shape_id", F.trim("shape_pt_sequence").cast("bigint").alias("shape_pt_sequence"),
        F.col("shape_pt_lat").cast("double").alias("lat"), F.col("shape_pt_lon").cast("double").alias("lon"),
    )


def last_row(rows: DataFrame, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """Keep the row latest in file order per key."""
    rest = [c for c in rows.columns if c not in keys and c != pos]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), pos).alias("_r")).select(*keys, "_r.*")
