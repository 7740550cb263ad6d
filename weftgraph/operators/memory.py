"""Session notes: remembered as nodes that concern others, recalled by text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import contains_ci

MOST_BYTES = 16_384


class NoteError(ValueError):
    """A note without a title, or with too long a body."""


def remember(spark: SparkSession, notes: list[dict], after: int = 0) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of notes (title, body, tags, touches, at): ids rise strictly from ``at`` or the last."""
    rows, edges, last = [], [], after
    for n in notes:
        if not n.get("title", "").strip():
            raise NoteError("a note needs a title")
        if len(n.get("body", "").encode()) > MOST_BYTES:
            raise NoteError(f"a body has {MOST_BYTES} bytes at most")
        last = max(last + 1, n.get("at", 0))
        id_ = f"memory:checkpoint:{last}"
        rows.append((last, id_, n["title"], "checkpoint", "", {"body": n.get("body", ""), "tags": ",".join(n.get("tags", [])), "created_at": str(last)}))
        edges += [(last, id_, t, "concerns") for t in n.get("touches", [])]
    return (
        spark.createDataFrame(rows, "ord long, id string, label string, kind string, source_file string, properties map<string,string>"),
        spark.createDataFrame(edges, "ord long, source string, target string, relation string"),
    )


def recall(notes: DataFrame, concerns: DataFrame, nodes: DataFrame, query: str = "", limit: int = 10) -> DataFrame:
    """Notes (id, title, tags, body, created_at) that hold ``query`` in title, tags or body, the newest first.

    ``concerns`` lists (id, label) of what each touches; the label of what is no
    node is null.  ``total`` counts before the limit.
    """
    q = F.lit(query)
    hit = notes.filter(contains_ci(F.col("title"), q) | contains_ci(F.col("tags"), q) | contains_ci(F.col("body"), q))
    best = hit.orderBy(F.col("created_at").cast("long").desc(), F.desc("id"))
    best = best.limit(limit) if limit else best
    touched = concerns.select("source", "target").join(best.select(F.col("id").alias("source")), "source", "left_semi").join(nodes.select(F.col("id").alias("target"), "label"), "target", "left")
    lists = touched.groupBy(F.col("source").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("target").alias("id"), "label"))).alias("concerns"))
    return best.join(lists, "id", "left").withColumn("total", hit.agg(F.count("*")).scalar())
