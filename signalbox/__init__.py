"""Transit analytics on Spark: timetable, realtime-capture, state, rollup and archive operators.

Every operator takes DataFrames and returns DataFrames; thresholds are keyword
arguments.  Instants are ``TimestampType`` in a UTC session (see ``session.configure``).
"""

from signalbox.session import build_session, configure

__all__ = ["build_session", "configure"]
