"""An extension beyond the batch operators: windowed counts over the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.registry import query


def tumbling_counts(events: DataFrame, time_col: str = "ts", every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by event type and window; over a stream, rows later than `late` are dropped and windows close."""
    rows = events.withColumn(time_col, F.col(time_col).cast("timestamp"))
    rows = rows.withWatermark(time_col, late) if rows.isStreaming else rows
    w = F.window(time_col, every)
    return rows.groupBy(w, "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


@query("SELECT CAST(epoch(time_bucket(INTERVAL '1 hour', CAST(ts AS TIMESTAMP))) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_events(t) -> DataFrame:
    return tumbling_counts(t.events).select(F.unix_timestamp("start").alias("start"), "event_type", "n")
