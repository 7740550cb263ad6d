"""One build: files to a resolved, deduplicated and analysed graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import analyze, dedup, extract, merge, resolve
from ..operators.base import settle
from ..schema import EDGES, NODES, conform


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    tally: DataFrame


def build(files: DataFrame, aliases: DataFrame | None = None, dedupe: bool = True, community: bool = True) -> Graph:
    """``files`` (path, language, text) to a graph.

    Order matters and is fixed: merge, imports, calls, relations, dispatch,
    entity resolution, communities, centrality.  The last but one and its
    predecessor can be left out.
    """
    n, e, calls, relations = extract.flatten(extract.extract(files))
    more = extract.pattern_nodes(files).select("path", "id", "label", "kind", "source_file")
    sql_nodes, sql_edges = extract.sql_entities(files)
    more = settle(more.unionByName(sql_nodes.select("path", "id", "label", "kind", "source_file")).unionByName(extract.mcp_servers(files)))
    late = F.lit(1 << 50) + F.xxhash64("path", "id").bitwiseAND(F.lit((1 << 40) - 1))
    n = conform(n, "nodes").unionByName(conform(more.withColumn("ord", late), "nodes"))
    e = conform(e, "edges").unionByName(conform(sql_edges.withColumn("ord", F.lit(1 << 50) + F.xxhash64("source", "target").bitwiseAND(F.lit((1 << 40) - 1))), "edges"))
    nodes = settle(merge.merge_nodes(n))
    nodes, edges = resolve.resolve_imports(nodes, merge.merge_edges(e), aliases)
    nodes, edges = settle(nodes), settle(edges)
    outcomes = settle(resolve.call_outcomes(nodes, edges, calls))
    step = 1 << 52
    found = [resolve.call_edges(outcomes).withColumn("ord", F.col("ord") + step)]
    found.append(resolve.resolve_relations(nodes, edges, relations).withColumn("ord", F.col("ord") + 2 * step))
    key = F.xxhash64("source", "relation", "target").bitwiseAND(F.lit((1 << 40) - 1))
    found.append(resolve.interface_dispatch(nodes, edges).withColumn("ord", key + 3 * step))
    found.append(resolve.contract_rescue(nodes, outcomes).withColumn("ord", key + 4 * step))
    found.append(resolve.trait_dispatch(nodes, edges).withColumn("ord", key + 5 * step))
    for f in found:
        edges = edges.unionByName(conform(f, "edges"))
    edges = settle(merge.merge_edges(edges))
    if dedupe:
        nodes, edges = dedup.deduplicate(nodes, edges)
        nodes, edges = settle(nodes), settle(edges)
    home = analyze.communities(nodes, edges) if community else nodes.select("id", F.lit("").alias("community"))
    central = analyze.centrality(nodes, edges)
    gods = analyze.god_nodes(nodes, edges).select("id", "god_node", "god_node_rank")
    nodes = nodes.join(home, "id", "left").join(central.select("id", F.col("degree_centrality").alias("centrality")), "id", "left").join(gods, "id", "left")
    nodes = nodes.withColumn("centrality", F.coalesce("centrality", F.lit(0.0))).withColumn("god_node", F.coalesce("god_node", F.lit(False)))
    return Graph(settle(nodes), edges, resolve.call_tally(outcomes))


__all__ = ["EDGES", "NODES", "Graph", "build"]
