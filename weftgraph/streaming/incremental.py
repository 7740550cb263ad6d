"""Incremental maintenance: extract what changed, resolve all, publish once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import classify_changes


class UnreadableError(RuntimeError):
    """A file that had been verified can't be read; the rescan is refused as a whole."""


def plan_rescan(now: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, change) after a full scan by content; refuses if a known file can't be read."""
    c = classify_changes(now, manifest)
    lost = [r["path"] for r in c.filter("change = 'Unreadable'").limit(5).collect()]
    if lost:
        raise UnreadableError(", ".join(lost))
    return c


def apply_changes(extractions: DataFrame, changes: DataFrame, extract: Callable[[DataFrame], DataFrame], files: DataFrame) -> DataFrame:
    """Extractions by path after ``changes`` (path, change): stale ones replaced, deleted ones gone, the rest reused."""
    touched = changes.filter("change not in ('HashHit', 'StatHit')").select("path")
    fresh = files.join(changes.filter("change in ('New', 'Stale', 'Created', 'Modified')").select("path"), "path", "left_semi")
    return extractions.join(touched, "path", "left_anti").unionByName(extract(fresh).select(*extractions.columns))


def overlay(base: DataFrame, *more: DataFrame, keys: list[str]) -> DataFrame:
    """Deterministic rows first, then accepted drops, then notes; an earlier layer's key wins."""
    from ..operators.merge import append_absent

    out = base
    for m in more:
        out = append_absent(out, m, keys)
    return out


def windowed_stats(ops, ts: str = "ts", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """An extension: operations and mean latency by event-time window, late rows within the watermark included."""
    return ops.withWatermark(ts, late).groupBy(F.window(ts, width), "op").agg(F.count("*").alias("n"), F.avg("ms").alias("mean_ms")).select("window.start", "window.end", "op", "n", "mean_ms")
