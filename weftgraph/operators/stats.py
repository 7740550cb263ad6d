"""Operation log, ledger and cache statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import BUCKETS, latency_bucket

N_BUCKETS = len(BUCKETS) + 1


def histogram(ops: DataFrame, op: str = "op", ms: str = "ms", ready: Column | None = None) -> DataFrame:
    """(op, bucket, n) over reads that were answered; ``ready`` false leaves a read out."""
    rows = ops if ready is None else ops.filter(ready)
    return rows.groupBy(F.col(op).alias("op"), latency_bucket(F.col(ms)).alias("bucket")).agg(F.count("*").alias("n"))


def lifetime(ops: DataFrame, op: str = "op", ms: str = "ms") -> DataFrame:
    return ops.groupBy(F.col(op).alias("op")).agg(F.count("*").alias("n"), F.sum(ms).alias("total_ms"), F.avg(ms).alias("mean_ms"))


def histogram_percentile(hist: DataFrame, p: float) -> DataFrame:
    """(op, value): the percentile within the bucket that holds it, linear; the last bound beyond all."""
    w = Window.partitionBy("op").orderBy("bucket")
    target = min(max(p, 0.0), 1.0) * F.sum("n").over(Window.partitionBy("op"))
    h = hist.filter("n > 0").withColumn("cum", F.sum("n").over(w)).withColumn("target", target)
    bounds = F.array(F.lit(0.0), *[F.lit(float(b)) for b in BUCKETS])
    low = F.element_at(bounds, F.least(F.col("bucket"), F.lit(len(BUCKETS))) + 1)
    high = F.element_at(bounds, F.least(F.col("bucket") + 1, F.lit(len(BUCKETS))) + 1)
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("target") - (F.col("cum") - F.col("n"))) / F.col("n")))
    value = F.when(F.col("bucket") >= len(BUCKETS), float(BUCKETS[-1])).otherwise(low + (high - low) * part)
    return h.filter("cum >= target").groupBy("op").agg(F.min_by(value, "bucket").alias("value"))


def recent_percentile(ops: DataFrame, p: float, last: int = 256, op: str = "op", ms: str = "ms", seq: str = "seq") -> DataFrame:
    """(op, value): exact percentile of the ``last`` operations of each kind."""
    w = Window.partitionBy(op).orderBy(F.desc(seq))
    few = ops.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= last)
    return few.groupBy(F.col(op).alias("op")).agg(F.percentile(ms, p).alias("value"))


def route_counts(ops: DataFrame, route: str, kinds: list[str]) -> DataFrame:
    return ops.agg(*[F.count_if(F.col(route) == k).alias(k) for k in kinds])


def zero_hit_rate(ops: DataFrame, hits: str) -> DataFrame:
    """Share of searches that found nothing; null without searches."""
    return ops.agg((F.count_if(F.col(hits) == 0) / F.when(F.count(hits) > 0, F.count(hits))).alias("rate"))


def rollup(ledger: DataFrame, since: str | None = None) -> DataFrame:
    """(op, n, total_ms, mean_ms, p50, p90, mixed) over ledger lines from ``since`` on.

    Histograms add up by bucket if all lines have one schema version; else
    ``mixed`` is set and the percentiles are null.
    """
    rows = ledger if since is None else ledger.filter(F.col("shutdown") >= F.lit(since))
    mixed = rows.agg(F.count_distinct("schema_version") > 1).scalar()
    each = rows.select(F.explode("ops").alias("op", "s"))
    sums = each.groupBy("op").agg(F.sum("s.count").alias("n"), F.sum("s.total_ms").alias("total_ms"))
    h = each.select("op", F.posexplode("s.hist_ms").alias("bucket", "n")).groupBy("op", "bucket").agg(F.sum("n").alias("n"))
    out = sums.join(histogram_percentile(h, 0.5).withColumnRenamed("value", "p50"), "op", "left").join(histogram_percentile(h, 0.9).withColumnRenamed("value", "p90"), "op", "left")
    out = out.withColumn("mixed", mixed)
    keep = lambda c: F.when(~F.col("mixed"), F.col(c)).alias(c)
    return out.select("op", "n", "total_ms", (F.col("total_ms") / F.when(F.col("n") > 0, F.col("n"))).alias("mean_ms"), keep("p50"), keep("p90"), "mixed")


def status(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: how much of what there is."""
    n = nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("kind") == "file").alias("files"), F.count_if(F.col("id").startswith("memory:")).alias("memory_nodes"), F.count_if(F.col("kind").isin("document", "media", "concept")).alias("semantic_nodes"), F.count_distinct("kind").alias("kinds"))
    e = edges.agg(F.count("*").alias("edges"), F.count_distinct("relation").alias("relations"))
    return n.withColumn("edges", e.select("edges").scalar()).withColumn("relations", e.select("relations").scalar())


def unextracted(files: DataFrame, extracted: DataFrame) -> DataFrame:
    """(language, n) of files that no extractor took."""
    return files.join(extracted.select("path"), "path", "left_anti").groupBy("language").agg(F.count("*").alias("n"))
