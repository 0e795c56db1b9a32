"""Counters of what was found and done, over the time of the events.

Events may come late: what is behind the newest by more than ``late`` is dropped, and a window
is told, once and for good, when the watermark has passed its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LATE = "1 hour"


def _totals(counts: dict[str, Column], reason: Column | None) -> list[Column]:
    own = [F.sum(F.coalesce(v.cast("long"), F.lit(0))).alias(c) for c, v in counts.items()]
    last = [F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_at")]
    # the reason of the last event that has one
    return own + last + ([F.max_by(reason, F.when(reason.isNotNull(), F.struct("ts", reason.alias("r")))).alias("last_reason")] if reason is not None else [])


def window_counters(events: DataFrame, key: str, counts: dict[str, Column], every: str, reason: Column | None = None, late: str | None = LATE) -> DataFrame:
    """(key, begins, ends, counts..., events, last_at, last_reason) of tumbling windows, over a
    table or a stream with ``ts``. Rows without a time are in no window; a null key is a key;
    windows without an event aren't told. ``late`` None: a table, or a stream that has its
    watermark already."""
    rows = events.withWatermark("ts", late) if late else events
    w = rows.groupBy(F.window("ts", every).alias("w"), F.col(f"`{key}`").alias(key)).agg(*_totals(counts, reason))
    return w.select(key, F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), *(c for c in w.columns if c not in ("w", key)))


def session_counters(events: DataFrame, key: str, counts: dict[str, Column], quiet: str, reason: Column | None = None, late: str | None = LATE) -> DataFrame:
    """As :func:`window_counters`, over sessions: a session of a key ends ``quiet`` after its
    last event."""
    rows = (events.withWatermark("ts", late) if late else events).where(F.col("ts").isNotNull())
    w = rows.groupBy(F.session_window("ts", quiet).alias("w"), F.col(f"`{key}`").alias(key)).agg(*_totals(counts, reason))
    return w.select(key, F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), *(c for c in w.columns if c not in ("w", key)))


def counters_sink(counters: DataFrame, path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Starts a stream of counters: each window is appended to ``path`` when it is closed."""
    writer = counters.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
