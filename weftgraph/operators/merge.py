"""Fragments to graph: unions in which the first occurrence wins, and edge rewriting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import node_key
from .base import first_by

EDGE_KEY = ["source", "relation", "target"]


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row an id, the first; an empty id is made from file, kind and label."""
    if {"source_file", "kind", "label"} <= set(nodes.columns):
        nodes = nodes.withColumn("id", node_key(F.col("id"), F.col("source_file"), F.col("kind"), F.col("label")))
    return first_by(nodes, ["id"], F.col("ord"))


def merge_edges(edges: DataFrame) -> DataFrame:
    """One row for each (source, relation, target), the first; ends may be no nodes."""
    if set(edges.columns) == {*EDGE_KEY, "ord"}:  # equal rows but for their place, which a null comes first in
        return edges.groupBy(*EDGE_KEY).agg(F.when(F.count("ord") == F.count("*"), F.min("ord")).alias("ord")).select(*edges.columns)
    return first_by(edges, EDGE_KEY, F.col("ord"))


def merge_hyperedges(hyperedges: DataFrame) -> DataFrame:
    return first_by(hyperedges, ["id"], F.col("ord"))


def renumber(df: DataFrame) -> DataFrame:
    """Ordinals 0, 1, ... in the old order, by ranges: no task sees all rows."""
    ranged = df.repartitionByRange("ord").sortWithinPartitions("ord").withColumn("_m", F.monotonically_increasing_id())
    from .base import settle

    ranged = settle(ranged)
    part = F.shiftright("_m", 33)
    sizes = ranged.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    begin = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))
    out = ranged.withColumn("_p", part).join(F.broadcast(begin), "_p")
    return out.withColumn("ord", F.col("_b") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_p", "_b")


def append_absent(base: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` and those rows of ``more`` whose key it lacks, the first of each."""
    new = first_by(more, keys, F.col("ord")).join(base.select(*keys), keys, "left_anti")
    return base.unionByName(new.select(*base.columns))


def rewrite_edges(edges: DataFrame, remap: DataFrame, drop_self: bool = False, dropped: DataFrame | None = None) -> DataFrame:
    """Edges with ends mapped by ``remap`` (old, new), made distinct again.

    Entity resolution keeps self-loops; import resolution drops them, and edges
    that touch an id of ``dropped`` (id).
    """
    to = lambda c: remap.select(F.col("old").alias(c), F.col("new").alias(f"_{c}"))
    out = edges
    if dropped is not None:
        for c in ("source", "target"):
            out = out.join(dropped.select(F.col("id").alias(c)), c, "left_anti")
    for c in ("source", "target"):
        out = out.join(to(c), c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    if drop_self:
        out = out.filter("source <> target")
    return merge_edges(out.select(*edges.columns))


def override_union(base: DataFrame, over: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``over`` replace those of ``base`` by key; within ``over`` the last wins."""
    w = Window.partitionBy(*keys).orderBy(F.desc("_side"), F.desc("ord"))
    both = base.withColumn("_side", F.lit(0)).unionByName(over.withColumn("_side", F.lit(1)))
    return both.withColumn("_first", F.row_number().over(w)).filter("_first = 1").drop("_first", "_side")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    ends = edges.select("*", F.explode(F.array("source", "target")).alias("_end"))
    return ends.join(nodes.select(F.col("id").alias("_end")), "_end", "left_anti").select(*edges.columns).distinct() if not any(t.startswith("map") for _, t in edges.dtypes) else first_by(ends.join(nodes.select(F.col("id").alias("_end")), "_end", "left_anti").select(*edges.columns), EDGE_KEY, F.col("ord"))
