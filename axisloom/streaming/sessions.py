"""Extension: intervals from event streams.

Events of a track on a contig that lie at most `gap` apart form one interval. On a stream this is a
session window over event time, with late events handled by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, time: str, by: list[str], gap: str, late: str | None = None) -> DataFrame:
    """by, start, end (epoch seconds, half-open) and number of events of each session, batch or stream."""
    rows = events.withWatermark(time, late) if late and events.isStreaming else events
    out = rows.groupBy(*by, F.session_window(time, gap)).agg(F.count("*").alias("n"))
    return out.select(*by, F.unix_timestamp("session_window.start").alias("start"), F.unix_timestamp("session_window.end").alias("end"), "n")
