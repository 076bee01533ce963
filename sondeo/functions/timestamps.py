"""Wall-clock arithmetic that does not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wall_micros(ts: str | Column) -> Column:
    """Microseconds since 1970-01-01 as read off the clock face."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return ((days * 24 + F.hour(ts)) * 60 + F.minute(ts)) * 60_000_000 + seconds


def day(ts: str | Column) -> Column:
    return (F.col(ts) if isinstance(ts, str) else ts).cast("date")
