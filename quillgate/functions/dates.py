"""Times as they are shown and reported."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock(ts: Column) -> Column:
    """Hour and minute of the session's time zone, two digits each, with AM or PM; dashes for
    no time."""
    return F.coalesce(F.date_format(ts, "hh:mm a"), F.lit("--:--"))


def iso_utc(ts: Column) -> Column:
    """The time in UTC to the millisecond, as 2024-01-31T09:05:07.120Z; null stays null."""
    return F.date_format(F.convert_timezone(None, F.lit("UTC"), ts.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 in UTC, rounded down."""
    return F.unix_millis(ts)
