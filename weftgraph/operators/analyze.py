"""Centrality, communities and connectivity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import unionfind
from .base import few, settle
from .merge import renumber

MEMORY = "memory:"
#: Prefixes of ids that enrichment makes.
ENRICHMENT = ("doc:", "concept:", "media:", "topic:")


def is_memory(c):
    return c.startswith(MEMORY)


def is_enrichment(c):
    out = F.lit(False)
    for p in ENRICHMENT:
        out = out | c.startswith(p)
    return out


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree) of every node but memory nodes: undirected, each edge counts, a loop twice.

    Edges that touch a memory node or an id that is no node don't count.
    """
    ids = nodes.select("id").filter(~is_memory(F.col("id"))).distinct()
    e = edges.select("source", "target").filter(~is_memory(F.col("source")) & ~is_memory(F.col("target")))
    # ends are counted once, nodes or not; an edge's far end is asked for only where some id is no node
    ends = e.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    met = settle(ids.withColumn("_node", F.lit(True)).join(ends, "id", "full"))
    counted = met.filter("_node").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))
    lost = met.filter("_node is null").select("id")
    if lost.isEmpty():
        return counted
    lost = few(lost)
    beside = lambda c, far: e.join(lost.withColumnRenamed("id", c), c, "left_semi").select(F.col(far).alias("id"))
    less = beside("source", "target").union(beside("target", "source")).groupBy("id").agg(F.count("*").alias("less"))
    return counted.join(less, "id", "left").select("id", (F.col("degree") - F.coalesce("less", F.lit(0))).alias("degree"))


def centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree, degree_centrality): degree by the largest, six decimals."""
    d = degrees(nodes, edges)
    top = d.agg(F.max("degree")).scalar()
    return d.select("id", "degree", F.when(top > 0, F.round(F.col("degree") / top, 6)).otherwise(F.lit(0.0)).alias("degree_centrality"))


def god_nodes(nodes: DataFrame, edges: DataFrame, ranks: int = 10, flags: int = 3) -> DataFrame:
    """The ``ranks`` nodes of highest degree, the earlier first on a tie; the first ``flags`` are gods.

    Memory nodes rank with degree 0 and take a place, but are not returned.
    """
    d = degrees(nodes, edges)
    all_ = nodes.select("id", "ord").join(d, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    # the first few go through a top-k, and only they are numbered
    few = all_.orderBy(F.desc("degree"), "ord").limit(ranks)
    ranked = few.withColumn("god_node_rank", F.row_number().over(Window.orderBy(F.desc("degree"), "ord")).cast("int"))
    return ranked.filter(~is_memory(F.col("id"))).select("id", "degree", "god_node_rank", (F.col("god_node_rank") <= flags).alias("god_node"))


def cross_community(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends have communities (column ``community``, '' for none) that differ."""
    of = lambda c: nodes.filter("community <> ''").select(F.col("id").alias(c), F.col("community").alias(f"{c}_community"))
    out = edges.join(of("source"), "source").join(of("target"), "target")
    return out.filter("source_community <> target_community")


def modularity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: modularity of column ``community`` at resolution 1, every edge an undirected one."""
    of = lambda c: nodes.select(F.col("id").alias(c), F.col("community").alias(f"{c[0]}c"))
    e = edges.select("source", "target").join(of("source"), "source").join(of("target"), "target")
    flat = e.select(F.explode(F.array(F.struct(F.col("sc").alias("c"), (F.col("sc") == F.col("tc")).cast("int").alias("inside")), F.struct(F.col("tc").alias("c"), F.lit(0).alias("inside")))).alias("x"))
    by = flat.groupBy("x.c").agg(F.sum("x.inside").alias("inside"), F.count("*").alias("ends"))
    two_m = by.agg(F.sum("ends")).scalar()
    part = by.select((2 * F.col("inside") / two_m - (F.col("ends") / two_m) ** 2).alias("q"))
    return part.agg(F.coalesce(F.sum("q"), F.lit(0.0)).alias("modularity"))


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 8, levels: int = 3) -> DataFrame:
    """(id, community): Louvain moves as plans, one super-step per half of the nodes.

    In each super-step a node sees the weight of its links into each
    neighbouring community and goes to the one of largest gain in modularity,
    the least by name on a tie.  Even and odd nodes move in turn, so that two
    don't swap for ever.  Then communities become nodes.  Every node gets a
    community, alone if it has no edge; the result depends on the tables alone.
    One task makes the same moves where it can hold all links.
    """
    ids = nodes.select("id").distinct()
    e = edges.select("source", "target").join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    w = settle(e.select(F.col("source").alias("a"), F.col("target").alias("b")).union(e.select("target", "source")).groupBy("a", "b").agg(F.sum(F.lit(1.0)).alias("w")))
    size = w.agg(F.count("*").alias("n"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("two_m")).first()
    two_m = size["two_m"]
    if size["n"] <= unionfind.FINISH:
        return ids.join(_moved_in_one_task(w, rounds, levels), "id", "left").select("id", F.coalesce("community", "id").alias("community"))
    home = settle(ids.select("id", F.col("id").alias("community")))
    for _ in range(levels):
        k = settle(w.groupBy(F.col("a").alias("v")).agg(F.sum("w").alias("k")))
        at = settle(k.select("v", F.col("v").alias("c"), "k"))
        moved = False
        for r in range(rounds):
            total = at.groupBy("c").agg(F.sum("k").alias("tot"))
            links = w.filter("a <> b").join(at.select(F.col("v").alias("b"), F.col("c").alias("to")), "b").groupBy(F.col("a").alias("v"), "to").agg(F.sum("w").alias("win"))
            here = at.select("v", F.col("c").alias("to"), F.lit(0.0).alias("win"))
            options = links.unionByName(here).groupBy("v", "to").agg(F.sum("win").alias("win"))
            options = options.join(at, "v").join(total.withColumnRenamed("c", "to"), "to")
            rest = F.col("tot") - F.when(F.col("to") == F.col("c"), F.col("k")).otherwise(0.0)
            gain = F.round(F.col("win") - F.col("k") * rest / two_m, 9)
            best = options.withColumn("gain", gain).groupBy("v", "c", "k").agg(F.min(F.struct((-F.col("gain")).alias("g"), (F.col("to") != F.col("c")).alias("stay"), "to")).alias("m"))
            turn = F.pmod(F.xxhash64("v"), F.lit(2)) == r % 2
            new = settle(best.select("v", F.when(turn, F.col("m.to")).otherwise(F.col("c")).alias("c"), "k", (turn & (F.col("m.to") != F.col("c"))).alias("went")))
            went = not new.filter("went").isEmpty()
            at = new.drop("went")
            moved |= went
            if not went and r % 2:
                break
        if not moved:
            break
        home = settle(home.join(at.select(F.col("v").alias("community"), "c"), "community", "left").select("id", F.coalesce("c", "community").alias("community")))
        to = at.select("v", "c")
        w = settle(w.join(to.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a").join(to.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")))
    # a community is named after its first member, whatever node gave it its name
    least = home.groupBy("community").agg(F.min("id").alias("first"))
    return home.join(least, "community").select("id", F.col("first").alias("community"))


def _moved_in_one_task(w: DataFrame, rounds: int, levels: int) -> DataFrame:
    """(id, community) of the ends of links (a, b, w): the moves of :func:`communities` on arrays."""

    def run(batches):
        held = [(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_numpy(), b.column(3).to_numpy()) for b in batches if len(b)]
        if not held:
            return
        a, b = (np.array([x for h in held for x in h[k]], object) for k in (0, 1))
        w, turn_a = (np.concatenate([h[k] for h in held]) for k in (2, 3))
        names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b = ends[: len(a)], ends[len(a) :]
        n, two_m = len(names), w.sum()
        turn = np.zeros(n, np.int64)
        turn[a] = turn_a
        home = np.arange(n)
        for _ in range(levels):
            k = np.bincount(a, w, n)
            at, moved, nodes = np.arange(n), False, np.unique(a)
            other = a != b
            for r in range(rounds):
                total = np.bincount(at, k, n)
                pair = np.concatenate([a[other] * n + at[b[other]], nodes * n + at[nodes]])
                keys, which = np.unique(pair, return_inverse=True)
                win = np.bincount(which, np.concatenate([w[other], np.zeros(len(nodes))]))
                v, to = keys // n, keys % n
                rest = total[to] - np.where(to == at[v], k[v], 0.0)
                gain = np.round(win - k[v] * rest / two_m, 9)
                order = np.lexsort((to, to != at[v], -gain, v))
                first = order[np.unique(v[order], return_index=True)[1]]
                new = at.copy()
                mine = turn[v[first]] == r % 2
                new[v[first][mine]] = to[first][mine]
                went = bool((new != at).any())
                at, moved = new, moved or went
                if not went and r % 2:
                    break
            if not moved:
                break
            home = at[home]
            links, which = np.unique(at[a] * n + at[b], return_inverse=True)
            a, b, w = links // n, links % n, np.bincount(which, w)
        first = np.full(n, n)
        np.minimum.at(first, home, np.arange(n))
        yield pa.RecordBatch.from_pydict({"id": names.tolist(), "community": names[first[home]].tolist()}, pa.schema([("id", pa.string()), ("community", pa.string())]))

    rows = w.select("a", "b", "w", F.pmod(F.xxhash64("a"), F.lit(2)).alias("turn"))
    return rows.coalesce(1).mapInArrow(run, "id string, community string")


def layout(nodes: DataFrame) -> DataFrame:
    """(id, x, y): communities on a spiral, their members on circles within; two decimals.

    Stands in for a force-directed layout: positions are stable, near for one
    community, and members are numbered by ranges of community and ordinal.
    """
    placed = renumber(nodes.select(F.struct("community", "ord").alias("ord"), "id", "community"))
    begin = few(settle(placed.groupBy("community").agg(F.min("ord").alias("begin"))))
    at = placed.join(begin, "community").withColumn("k", F.col("ord") - F.col("begin") + 1).withColumn("h", F.pmod(F.xxhash64("community"), F.lit(1 << 20)) / float(1 << 20))
    turn, far = F.col("h") * 2 * 3.141592653589793 * 89, 100 + 900 * F.sqrt(F.col("h"))
    own, r = F.col("k") * 2.399963229728653, 4 * F.sqrt(F.col("k").cast("double"))
    return at.select("id", F.round(far * F.cos(turn) + r * F.cos(own), 2).alias("x"), F.round(far * F.sin(turn) + r * F.sin(own), 2).alias("y"))


def semantic_connectivity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row on how documents hang together with code.

    A document is connected if a non-semantic id is its neighbour, or that of a
    semantic neighbour.  Concepts and topics without a non-semantic neighbour
    are orphans.  Media and ids that are no node count as code.
    """
    doc = lambda c: c.startswith("doc:")
    concept = lambda c: c.startswith("concept:") | c.startswith("topic:")
    semantic = lambda c: doc(c) | concept(c)
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).union(edges.select("target", "source")).distinct()
    near = both.filter(semantic(F.col("a")) & ~semantic(F.col("b"))).select(F.col("a").alias("id")).distinct()
    two = both.filter(doc(F.col("a")) & semantic(F.col("b"))).join(near.withColumnRenamed("id", "b"), "b", "left_semi").select(F.col("a").alias("id"))
    linked = near.filter(doc(F.col("id"))).union(two).distinct().withColumn("linked", F.lit(True))
    direct = near.withColumn("direct", F.lit(True))
    n = nodes.select("id").distinct().filter(semantic(F.col("id"))).join(linked, "id", "left").join(direct, "id", "left")
    counts = n.agg(
        F.count_if(doc(F.col("id"))).alias("documents"), F.count_if(doc(F.col("id")) & F.col("linked").isNotNull()).alias("connected_documents"),
        F.count_if(concept(F.col("id"))).alias("concepts"), F.count_if(concept(F.col("id")) & F.col("direct").isNull()).alias("orphan_concepts"),
    )
    crossing = edges.filter((doc(F.col("source")) & ~semantic(F.col("target"))) | (~semantic(F.col("source")) & doc(F.col("target")))).agg(F.count("*"))
    return counts.withColumn("doc_code_edges", crossing.scalar())
