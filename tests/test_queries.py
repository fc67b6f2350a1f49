"""A spread of the registered queries against DuckDB on the smallest data set; all of them: check_oracle.py."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
SPREAD = (
    "agg03_line_day_rollup", "agg04_hour_day_rollup", "win03_next_per_direction", "join10_live_overlay", "agg14_skip_stop_counts",
    "win05_header_changes", "agg18_cadence", "join16_coverage", "str02_ghost_episodes", "str06_trip_completions", "join20_labelled_observations",
    "join11_alert_match", "win08_rolling_headway", "src08_archive_ingest", "str05_resolved_episodes", "str02_ghost_stream", "str06_completion_stream", "snk01_discrepancy_event_stream",
)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver data not present")
@pytest.mark.parametrize("name", SPREAD)
def test_query_matches_oracle(spark, con, name):
    good, message = compare(spark, entry.queries()[name], entry.oracle_sql()[name], SF, con)
    assert good, message


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and entry.FLAGSHIP in entry.queries()
