"""Neighbourhoods, blast radius, paths and components, for many seeds at a time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import unionfind
from .base import FEW, few, settle, top_by
from .merge import renumber

DIRECTIONS = ("in", "out", "both")


def adjacency(edges: DataFrame, direction: str, relation: str | None = None) -> DataFrame:
    """(id, nid, relation, direction, eord): what stands next to ``id``.

    ``out`` follows edges, ``in`` goes against them.  An unknown direction has
    no neighbours.  ``ord`` is taken from the edges if they have it.
    """
    e = edges if relation is None else edges.filter(F.col("relation") == relation)
    eord = F.col("ord") if "ord" in edges.columns else F.xxhash64("source", "relation", "target")
    out = e.select(F.col("source").alias("id"), F.col("target").alias("nid"), "relation", F.lit("out").alias("direction"), eord.alias("eord"))
    in_ = e.select(F.col("target").alias("id"), F.col("source").alias("nid"), "relation", F.lit("in").alias("direction"), eord.alias("eord"))
    if direction == "both":
        return out.unionByName(in_)
    return out if direction == "out" else in_ if direction == "in" else out.limit(0)


def neighbours(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, direction: str = "both", relation: str | None = None) -> DataFrame:
    """(seed, id, relation, direction, label, kind, centrality) of each edge that touches a seed.

    ``nodes`` may have ``centrality``; a neighbour that is no node stays, with
    centrality 0.  A loop is reported once, as ``out``.
    """
    n = nodes.select(F.col("id").alias("nid"), "label", "kind", *([F.col("centrality")] if "centrality" in nodes.columns else []))
    asked = settle(seeds.select("id").distinct())
    met = adjacency(edges, direction, relation).join(few(asked), "id", "left_semi").withColumnRenamed("id", "seed")
    if direction == "both":
        met = met.filter("not (seed = nid and direction = 'in')")
    met = settle(met)
    there = n.join(few(settle(met.select("nid").distinct())), "nid", "left_semi")
    out = met.join(there, "nid", "left").withColumnRenamed("nid", "id")
    return out.withColumn("centrality", F.coalesce("centrality", F.lit(0.0)) if "centrality" in nodes.columns else F.lit(0.0))


def explain(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, direction: str = "both", relation: str | None = None, limit: int = 100) -> DataFrame:
    """:func:`neighbours`, the most central first and ``limit`` of each seed, with ``neighbor_count`` of all."""
    met = neighbours(nodes, edges, seeds, direction, relation)
    met = met.withColumn("neighbor_count", F.count("*").over(Window.partitionBy("seed")))
    return top_by(met, ["seed"], limit, F.desc("centrality"), F.col("eord"), F.col("id"), F.col("relation"), F.desc("direction"))


def impact(edges: DataFrame, seeds: DataFrame, direction: str = "dependents", relation: str | None = None, depth: int = 3, via: bool = False) -> DataFrame:
    """(seed, id, depth[, via]) of what is within ``depth`` hops of each seed, the seed left out.

    ``dependents`` goes against the edges, ``dependencies`` along them, ``both``
    either way; anything else finds nothing.  Each hop joins the frontier with
    the edges and drops what has been reached, so the work is that of the edges
    met, once.  ``via`` is the relation of the first discovery in breadth-first
    order, which takes a ranking of each hop.
    """
    way = {"dependents": "in", "dependencies": "out", "both": "both"}.get(direction, "none")
    adj = adjacency(edges, way, relation).select("id", "nid", "relation", "eord")
    front = seeds.select(F.col("id").alias("seed"), "id").distinct().withColumn("rank", F.lit(0).cast("long"))
    visited = front.select("seed", "id")
    found: list[DataFrame] = []
    for hop in range(1, depth + 1):
        met = front.join(adj, "id").select("seed", F.col("nid").alias("id"), "rank", "eord", "relation")
        new = met.groupBy("seed", "id").agg(F.min(F.struct("rank", "eord", "relation")).alias("by")) if via else met.select("seed", "id").distinct()
        new = new.join(visited, ["seed", "id"], "left_anti")
        if via:
            order = Window.partitionBy("seed").orderBy("by")
            new = new.select("seed", "id", F.row_number().over(order).cast("long").alias("rank"), F.col("by.relation").alias("via"))
        new = settle(new) if hop < depth else new
        found.append(new.select("seed", "id", F.lit(hop).alias("depth"), *(["via"] if via else [])))
        if hop < depth:
            front = new.select("seed", "id", F.col("rank") if via else F.lit(0).cast("long").alias("rank"))
            visited = visited.unionByName(new.select("seed", "id"))
    return reduce(DataFrame.unionByName, found) if found else front.limit(0).select("seed", "id", F.lit(0).alias("depth"))


def ranked_impact(nodes: DataFrame, reached: DataFrame, limit: int = 200) -> DataFrame:
    """Reached nodes by depth, centrality, label and id, ``limit`` of each seed, with ``total`` and ``truncated``."""
    n = nodes.select("id", "label", "kind", "centrality")
    r = reached.join(n, "id").withColumn("total", F.count("*").over(Window.partitionBy("seed")))
    out = top_by(r, ["seed"], limit, F.col("depth"), F.desc("centrality"), F.col("label"), F.col("id"))
    return out.withColumn("truncated", F.lit(bool(limit)) & (F.col("total") > limit))


def shortest_path(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(step, id) along a shortest undirected path; empty if there is none.

    A node's parent is the one found first, by the parent's rank and the edge's
    ordinal.  Breadth first from both ends, the smaller front in turn, until
    the fronts meet; what was visited is left out of each hop, so the search
    ends when nothing new is met, however long the path.  Only nodes between
    the ends at the least distance can be parents of such, so only they are ranked.
    """
    spark = edges.sparkSession
    start = spark.createDataFrame([(source,)], "id string")
    if source == target:
        return start.select(F.lit(0).alias("step"), "id")
    adj = adjacency(edges, "both").select("id", "nid", "eord")
    fronts = [start, spark.createDataFrame([(target,)], "id string")]
    visited, sizes = list(fronts), [1, 1]
    hops: list[list[DataFrame]] = [[], []]
    while True:
        k = int(sizes[1] < sizes[0])
        front = F.broadcast(fronts[k]) if sizes[k] <= FEW else fronts[k]
        step = settle(adj.join(front, "id", "left_semi"))
        new = settle(step.select(F.col("nid").alias("id")).distinct().join(visited[k], "id", "left_anti"))
        sizes[k] = new.count()
        if not sizes[k]:
            return start.limit(0).select(F.lit(0).alias("step"), "id")
        hops[k].append(step)
        fronts[k], visited[k] = new, visited[k].unionByName(new)
        if len(hops[k]) % 16 == 0:  # a plan of that many unions is cut
            visited[k] = settle(visited[k])
        between = fronts[0].join(fronts[1], "id", "left_semi")
        if not between.isEmpty():
            break
    links, at = [], between
    for step in reversed(hops[0]):  # (parent, id, eord) that lead to where the fronts met
        links.append(settle(step.select(F.col("id").alias("parent"), F.col("nid").alias("id"), "eord").join(at, "id", "left_semi")))
        at = links[-1].select(F.col("parent").alias("id")).distinct()
    links = links[::-1] + [step.select(F.col("nid").alias("parent"), "id", "eord") for step in reversed(hops[1])]
    ranked, found = start.select(F.col("id").alias("parent"), F.lit(0).cast("long").alias("rank")), []
    for link in links:
        by = link.join(ranked, "parent").groupBy("id").agg(F.min(F.struct("rank", "eord", "parent")).alias("ord"))
        new = by.select("id", F.col("ord.parent").alias("parent"), "ord")
        # a rank within the hop: what was found first expands first
        if link.limit(FEW + 1).count() > FEW:
            new = renumber(settle(new)).select("id", "parent", F.col("ord").alias("rank"))
        else:
            new = new.select("id", "parent", F.row_number().over(Window.orderBy("ord")).cast("long").alias("rank"))
        found.append(settle(new))
        ranked = found[-1].select(F.col("id").alias("parent"), "rank")
    path, at = [target], target
    for hop in reversed(found):  # one row a hop
        at = hop.filter(F.col("id") == at).select("parent").first()[0]
        path.append(at)
    return spark.createDataFrame(list(enumerate(reversed(path))), "step int, id string")


def distances(edges: DataFrame, seeds: DataFrame, depth: int = 6) -> DataFrame:
    """(seed, id, depth) along undirected shortest paths up to ``depth``, the seed with 0."""
    far = impact(edges, seeds, "both", None, depth)
    return seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth")).unionByName(far)


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, root): the least ``ord`` of each node's component under ``pairs`` (a, b) of ordinals.

    Each round every group hooks onto its least neighbour, hooks are flattened
    by jumps, and the links left are those between groups; once they are few
    enough, one task joins them.
    """
    edges = settle(pairs.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    label = nodes.select("ord", F.col("ord").alias("root"))
    while (left := edges.count()) > unionfind.FINISH:
        up = settle(edges.groupBy("hi").agg(F.min("lo").alias("up")))
        while True:
            step = up.select(F.col("hi").alias("up"), F.col("up").alias("next"))
            up = settle(up.join(step, "up", "left").select("hi", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")))
            done = up.filter("moved").isEmpty()
            up = up.select("hi", "up")
            if done:
                break
        to = up.select(F.col("hi").alias("root"), "up")
        label = settle(label.join(to, "root", "left").select("ord", F.coalesce("up", "root").alias("root")))
        e = edges.join(up, "hi").select(F.col("up").alias("a"), F.col("lo").alias("root")).join(to, "root", "left").select("a", F.coalesce("up", "root").alias("b")).filter("a <> b")
        edges = settle(e.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    if not left:
        return label
    last = unionfind.finish(edges).select(F.col("node").alias("root"), F.col("root").alias("up"))
    return settle(label.join(last, "root", "left").select("ord", F.coalesce("up", "root").alias("root")))
