"""Connected components of links, as tables: no link or component reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import unionfind
from ._common import settle

def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b), whole numbers; the root is the least node of its component.

    Every node hooks onto its least neighbour, if that is less; chains of hooks
    are halved until each points at a root; links between roots are the next
    round's.  Each round halves the groups that still have links, at least, and
    no more than ``unionfind.FINISH`` links are left to one task.  Self-links and repeated
    links change nothing; links of a null end are left out.
    """
    edges = settle(links.filter("a is not null and b is not null").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    label = None
    while (left := edges.count()) > unionfind.FINISH:
        if label is None:
            label = edges.select(F.col("hi").alias("node")).union(edges.select("lo")).distinct().withColumn("root", F.col("node"))
            edges = edges.filter("hi <> lo")
        up = settle(edges.groupBy("hi").agg(F.min("lo").alias("up")))
        while True:
            step = up.select(F.col("hi").alias("up"), F.col("up").alias("next"))
            jumped = settle(up.join(step, "up", "left").select("hi", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")))
            up = jumped.select("hi", "up")
            if jumped.filter("moved").isEmpty():
                break
        to = up.select(F.col("hi").alias("root"), "up")
        label = settle(label.join(to, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        a = edges.join(up, "hi").select(F.col("up").alias("a"), F.col("lo").alias("root"))
        b = a.join(to, "root", "left").select("a", F.coalesce("up", "root").alias("b")).filter("a <> b")
        edges = settle(b.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    if label is None:
        return settle(unionfind.finish(edges))
    if not left:
        return label
    last = unionfind.finish(edges).select(F.col("node").alias("root"), F.col("root").alias("up"))
    return settle(label.join(last, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
