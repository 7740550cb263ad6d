"""Debouncing: an event is ready once its key has been quiet for a while."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, ts: str, gap: str, tie: str) -> DataFrame:
    """(key, session, n, first, last): runs of a key's events no further apart than ``gap``."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    new = F.lag(ts).over(w).isNull() | (F.col(ts) - F.lag(ts).over(w) > F.expr(gap))
    s = events.withColumn("_new", new.cast("int")).withColumn("session", F.sum("_new").over(w).cast("long"))
    return s.groupBy(key, "session").agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def ready(events: DataFrame, key: str = "path", ts: str = "ts", delay: str = "250 milliseconds"):
    """A stream of (key, ts, change) as one row per quiet period: key, first, last, n, change (the last).

    A session window closes when nothing has come for ``delay``: each event
    puts it off.  Late events beyond the watermark are dropped.
    """
    s = events.withWatermark(ts, delay).groupBy(F.session_window(ts, delay), key)
    out = s.agg(F.count("*").alias("n"), F.max_by("change", ts).alias("change"))
    return out.select(key, F.col("session_window.start").alias("first"), F.col("session_window.end").alias("last"), "n", "change")


def collapse(batch: DataFrame, most: int = 256) -> DataFrame:
    """A batch of more than ``most`` events is one ``Overflow``: all is to be scanned again."""
    n = batch.limit(most + 1).count()
    if n <= most:
        return batch
    return batch.sparkSession.createDataFrame([("", "Overflow")], "path string, change string")
