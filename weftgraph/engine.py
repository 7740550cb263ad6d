"""The operations on a published graph, as one object."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import context, memory, search, stats, traverse
from .operators.base import settle


class PinError(ValueError):
    """The graph is of another content than the caller asked for."""


class Engine:
    """query, explain, impact, path, context, update, status, remember and recall over (nodes, edges).

    Each call sees one version of the graph and is logged with its time.
    ``root`` pins a call to a content hash.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, root: str | None = None):
        self.spark: SparkSession = nodes.sparkSession
        self.root = root
        self.log: list[tuple[str, float]] = []
        self._set(nodes, edges)
        self.notes: list[dict] = []

    def _set(self, nodes: DataFrame, edges: DataFrame) -> None:
        self.nodes = nodes if "centrality" in nodes.columns else nodes.withColumn("centrality", F.lit(0.0))
        self.edges = edges

    def _run(self, op: str, pin: str | None, make):
        if pin is not None and pin != self.root:
            raise PinError(f"the graph is of {self.root}")
        start = time.monotonic()
        out = settle(make())
        self.log.append((op, (time.monotonic() - start) * 1000))
        return out

    def _ids(self, *names: str) -> DataFrame:
        q = self.spark.createDataFrame([(n,) for n in names], "name string")
        return search.resolve(self.nodes, q).select("id")

    def query(self, text: str, limit: int = 50, kind: str | None = None, file: str | None = None, pin: str | None = None) -> DataFrame:
        """Structural questions, symbols or substrings, by what the text is."""

        def make():
            asked = self.spark.createDataFrame([(text,)], "query string")
            r = search.route(self.nodes, asked).first()
            if r["route"] == "structural":
                rule, _ = search.parse_phrase(text)
                seed = self.spark.createDataFrame([(r["target"],)], "id string")
                return traverse.explain(self.nodes, self.edges, seed, rule.direction, rule.relation, limit)
            if r["route"] == "entity":
                return self.nodes.filter(F.col("id") == r["target"])
            return search.substring_search(self.nodes, text, kind, file, limit)

        return self._run("query", pin, make)

    def explain(self, name: str, direction: str = "both", relation: str | None = None, limit: int = 100, pin: str | None = None) -> DataFrame:
        return self._run("explain", pin, lambda: traverse.explain(self.nodes, self.edges, self._ids(name), direction, relation, limit))

    def impact(self, *names: str, direction: str = "dependents", relation: str | None = None, depth: int = 3, limit: int = 200, pin: str | None = None) -> DataFrame:
        return self._run("impact", pin, lambda: traverse.ranked_impact(self.nodes, traverse.impact(self.edges, self._ids(*names), direction, relation, depth, via=True), limit))

    def path(self, source: str, target: str, pin: str | None = None) -> DataFrame:
        def make():
            ends = [self._ids(n).first() for n in (source, target)]
            if None in ends:
                missing = [n for n, e in zip((source, target), ends, strict=True) if e is None]
                return search.suggest(self.nodes, self.spark.createDataFrame([(m,) for m in missing], "name string"))
            return traverse.shortest_path(self.edges, ends[0]["id"], ends[1]["id"])

        return self._run("path", pin, make)

    def context(self, text: str, budget: int = 4000, depth: int = 2, gather: str = "adaptive", packer: str = "greedy", pin: str | None = None) -> DataFrame:
        def make():
            q = self.spark.createDataFrame([(0, text)], "qid int, query string")
            seeds = context.focal(self.nodes, q)
            return context.pack(self.nodes, context.gather(self.nodes, self.edges, q, seeds, depth, gather == "adaptive"), budget, packer)

        return self._run("context", pin, make)

    def update(self, nodes: DataFrame, edges: DataFrame, root: str | None = None) -> None:
        self._set(nodes, edges)
        self.root = root

    def status(self, pin: str | None = None) -> DataFrame:
        return self._run("status", pin, lambda: stats.status(self.nodes, self.edges))

    def remember(self, title: str, body: str = "", tags: list[str] | None = None, touches: list[str] | None = None, at: int | None = None) -> str:
        """Keep a note; returns its id.  Notes are no part of a published snapshot."""
        note = {"title": title, "body": body, "tags": tags or [], "touches": touches or [], "at": time.time_ns() if at is None else at}
        last = max((n["at"] for n in self.notes), default=0)
        note["at"] = max(note["at"], last + 1)
        memory.remember(self.spark, [note])
        self.notes.append(note)
        return f"memory:checkpoint:{note['at']}"

    def recall(self, text: str = "", limit: int = 10) -> DataFrame:
        n, e = memory.remember(self.spark, self.notes) if self.notes else (None, None)
        if n is None:
            return self.spark.createDataFrame([], "id string, title string")
        p = lambda k: F.element_at("properties", F.lit(k)).alias(k)
        return memory.recall(n.select("id", F.col("label").alias("title"), p("tags"), p("body"), p("created_at")), e, self.nodes, text, limit)

    def op_stats(self) -> DataFrame:
        return stats.lifetime(self.spark.createDataFrame(self.log or [("none", 0.0)], "op string, ms double"))
