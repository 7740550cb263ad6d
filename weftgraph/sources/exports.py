"""Sinks: parquet snapshots, node-link JSON, SVG, Markdown, Cypher, call lists, statistics."""

from __future__ import annotations

import json
import os
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import cypher_escape, html_escape, script_escape
from ..operators.analyze import MEMORY
from ..operators.merge import renumber


def node_lines(nodes: DataFrame) -> DataFrame:
    """(ord, line): each node as JSON, absent fields left out."""
    cols = [c for c in ("id", "label", "source_file", "confidence", "properties", "confidence_score") if c in nodes.columns]
    loc = [F.col("loc").alias("source_location")] if "loc" in nodes.columns else []
    return nodes.select("ord", F.to_json(F.struct(*cols, F.col("kind").alias("type"), *loc)).alias("line"))


def edge_lines(edges: DataFrame) -> DataFrame:
    cols = [c for c in ("source", "target", "relation", "confidence", "properties", "confidence_score") if c in edges.columns]
    return edges.select("ord", F.to_json(F.struct(*cols)).alias("line"))


def svg_rows(nodes: DataFrame) -> DataFrame:
    """(ord, x, y, svg): nodes on a circle around (240, 180) of radius 120, in order."""
    n = nodes.agg(F.count("*")).scalar()
    placed = renumber(nodes.select("ord", F.col("ord").alias("_ord"), "label")).select(F.col("_ord").alias("ord"), "label", F.col("ord").alias("k"))
    at = placed.select("ord", "label", (F.col("k") * (2 * 3.141592653589793) / n).alias("a"))
    at = at.select("ord", "label", (240 + 120 * F.cos("a")).alias("x"), (180 + 120 * F.sin("a")).alias("y"))
    return at.select("ord", "x", "y", F.format_string('<circle cx="%.2f" cy="%.2f" r="6"/><text x="%.2f" y="%.2f">%s</text>', F.col("x"), F.col("y"), F.col("x") + 8, F.col("y"), html_escape(F.col("label"))).alias("svg"))


def markdown_blocks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ord, block): a heading for each node, its kind and file, and links in edge order."""
    links = edges.join(nodes.select(F.col("id").alias("target"), F.col("label").alias("to")), "target").groupBy(F.col("source").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "to"))), lambda x: F.concat(F.lit("[["), x["to"], F.lit("]]"))).alias("links"))
    n = nodes.join(links, "id", "left")
    return n.select("ord", F.concat(F.lit("## "), "label", F.lit("\n- kind: "), "kind", F.lit("\n- source: "), "source_file", F.lit("\n- links: "), F.coalesce(F.array_join("links", ", "), F.lit("none")), F.lit("\n")).alias("block"))


def cypher_statements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, ord, statement): MERGE of nodes, then of edges."""
    q = lambda c: cypher_escape(F.col(c))
    n = nodes.select(F.lit(0).alias("part"), "ord", F.format_string("MERGE (n:Node {id: '%s'}) SET n.label = '%s', n.kind = '%s';", q("id"), q("label"), q("kind")).alias("statement"))
    e = edges.select(F.lit(1).alias("part"), "ord", F.format_string("MATCH (a:Node {id: '%s'}), (b:Node {id: '%s'}) MERGE (a)-[:REL {relation: '%s'}]->(b);", q("source"), q("target"), q("relation")).alias("statement"))
    return n.unionByName(e)


def call_flow(edges: DataFrame) -> DataFrame:
    """(ord, item): CALLS edges as list items."""
    return edges.filter("relation = 'CALLS'").select("ord", F.concat(F.lit("<li>"), html_escape(F.col("source")), F.lit(" &rarr; "), html_escape(F.col("target")), F.lit("</li>")).alias("item"))


def graph_document(nodes: DataFrame, edges: DataFrame, meta: dict) -> str:
    """The whole graph as node-link JSON, for graphs that one machine can hold; parquet is the sink for others."""
    body = lambda rows: ",".join(r["line"] for r in rows.orderBy("ord").toLocalIterator())
    return f'{{"directed":true,"multigraph":false,"graph":{json.dumps(meta, sort_keys=True)},"nodes":[{body(node_lines(nodes))}],"links":[{body(edge_lines(edges))}]}}'


def html_page(document: str) -> str:
    return f'<!doctype html><meta charset="utf-8"><title>graph</title><script type="application/json" id="graph">{document.replace("</", "<" + chr(92) + "/")}</script>'


def stats_row(nodes: DataFrame, edges: DataFrame, tally: DataFrame, phases: dict[str, float], files_total: int, files_extracted: int, files_cache_hit: int) -> dict:
    """Build statistics as they are written to ``stats.json``."""
    out = {"phase_ms": phases, "total_ms": sum(phases.values()), "files_total": files_total, "files_extracted": files_extracted, "files_cache_hit": files_cache_hit}
    out["cache_hit_rate"] = files_cache_hit / files_total if files_total else 0.0
    out["node_count"], out["edge_count"] = nodes.count(), edges.count()
    out["call_resolution"] = tally.first().asDict()
    if files_cache_hit and files_extracted:
        out["cache_saved_ms_estimate"] = files_cache_hit * phases.get("extract_ms", 0.0) / files_extracted
    return out


def write_exports(nodes: DataFrame, edges: DataFrame, folder: str, meta: dict | None = None) -> None:
    """The six exports of a small graph; text is assembled by one writer."""
    os.makedirs(folder, exist_ok=True)

    def put(name: str, text) -> None:
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            f.writelines([text] if isinstance(text, str) else text)

    doc = graph_document(nodes, edges, meta or {})
    put("graph.json", doc)
    put("graph.html", html_page(doc))
    put("graph.svg", ['<svg xmlns="http://www.w3.org/2000/svg" width="480" height="360">', *(r["svg"] for r in svg_rows(nodes).orderBy("ord").toLocalIterator()), "</svg>"])
    put("obsidian.md", (r["block"] + "\n" for r in markdown_blocks(nodes, edges).orderBy("ord").toLocalIterator()))
    put("cypher.txt", (r["statement"] + "\n" for r in cypher_statements(nodes, edges).orderBy("part", "ord").toLocalIterator()))
    put("call-flow.html", ["<ol>", *(r["item"] for r in call_flow(edges).orderBy("ord").toLocalIterator()), "</ol>"])


class Snapshots:
    """Versions of a graph as parquet; a pointer row names the current one.

    A version is written whole before the pointer moves, so readers see the old
    or the new one, and a failed write leaves the last good.  Memory nodes and
    their edges are kept elsewhere and left out.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def current(self) -> int:
        """The newest version whose pointer is complete; 0 if there is none."""
        try:
            return self.spark.read.json(posixpath.join(self.root, "pointers")).agg(F.max("version")).first()[0] or 0
        except Exception:  # no pointer yet
            return 0

    def publish(self, nodes: DataFrame, edges: DataFrame) -> int:
        v = self.current() + 1
        at = posixpath.join(self.root, f"v={v}")
        nodes.filter(~F.col("id").startswith(MEMORY)).write.mode("overwrite").parquet(f"{at}/nodes")
        edges.filter(~F.col("source").startswith(MEMORY) & ~F.col("target").startswith(MEMORY)).write.mode("overwrite").parquet(f"{at}/edges")
        self.spark.createDataFrame([(v,)], "version long").coalesce(1).write.mode("append").json(posixpath.join(self.root, "pointers"))
        return v

    def read(self, version: int | None = None) -> tuple[DataFrame, DataFrame]:
        v = version or self.current()
        if not v:
            raise LookupError("no snapshot has been published")
        at = posixpath.join(self.root, f"v={v}")
        return self.spark.read.parquet(f"{at}/nodes"), self.spark.read.parquet(f"{at}/edges")


def append_ledger(line: DataFrame, path: str) -> None:
    line.coalesce(1).write.mode("append").json(path)


def escaped_html(nodes: DataFrame, column: str) -> DataFrame:
    return nodes.withColumn(column, script_escape(html_escape(F.col(column))))
