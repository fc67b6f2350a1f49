"""Streamed queries answer every event of the table, those of its last half hour too."""

import os

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def brief(tmp_path_factory):
    """The driver tables with events squeezed into their first twenty minutes."""
    where = tmp_path_factory.mktemp("brief")
    for name in os.listdir(SF):
        if name != "events.parquet":
            os.symlink(f"{SF}/{name}", where / name)
    events = pq.read_table(f"{SF}/events.parquet")
    ts = events["ts"]
    micros = pc.cast(pc.cast(ts, pa.timestamp("us", ts.type.tz)), pa.int64())
    first = pc.min(micros).as_py()
    squeezed = pa.array([first + (m - first) // 3000 for m in micros.to_pylist()], pa.int64())
    events = events.set_column(events.schema.get_field_index("ts"), "ts", pc.cast(pc.cast(squeezed, pa.timestamp("us", ts.type.tz)), ts.type))
    pq.write_table(events, where / "events.parquet")
    return str(where)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver data not present")
@pytest.mark.parametrize("name", ["str01_header_content_stream", "str08_paced_stream", "str09_dwell_stream", "str10_edge_trigger_stream"])
@pytest.mark.parametrize("span", ["month", "brief"])
def test_stream_answers_every_row(spark, brief, name, span):
    where = SF if span == "month" else brief
    con, sql = connect(where), entry.oracle_sql()[name]
    assert con.execute(f"select count(*) from ({sql})").fetchone()[0]  # the SQL holds the last half hour too
    good, message = compare(spark, entry.queries()[name], sql, where, con)
    assert good, message


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver data not present")
def test_completion_stream_ends_every_trip(spark, brief):
    got = entry.queries()["str06_completion_stream"](spark, brief)
    tracked = connect(brief).execute(f"select distinct trip_id from ({entry.oracle_sql()['str06_completion_stream']})").fetchall()
    assert len(tracked) > 10 and {r.trip_id for r in got.select("trip_id").distinct().collect()} == {r[0] for r in tracked}
