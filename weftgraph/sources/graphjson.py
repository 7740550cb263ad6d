"""Node-link JSON, fragment drops, ledgers and manifests as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LOC
from ..operators.semantic import validate_fragments

_NODE = f"struct<id: string, label: string, source_file: string, type: string, kind: string, confidence: string, confidence_score: double, properties: map<string,string>, source_location: {LOC}>"
_LINK = "struct<source: string, target: string, relation: string, confidence: string, confidence_score: double, properties: map<string,string>>"
GRAPH = f"directed boolean, multigraph boolean, graph struct<build_state: int, cache_hit_rate: double, content_root: struct<algorithm: string, sha256: string, leaf_count: long>>, nodes array<{_NODE}>, links array<{_LINK}>"


def _tables(doc: DataFrame, links: str) -> tuple[DataFrame, DataFrame]:
    n = doc.select(F.posexplode("nodes").alias("ord", "n")).select(
        F.col("ord").cast("long").alias("ord"), "n.id", F.coalesce("n.label", "n.id").alias("label"), F.coalesce("n.type", "n.kind", F.lit("")).alias("kind"), F.coalesce("n.source_file", F.lit("")).alias("source_file"),
        F.col("n.source_location").alias("loc"), F.coalesce("n.confidence", F.lit("EXTRACTED")).alias("confidence"), "n.confidence_score", F.coalesce("n.properties", F.expr("cast(map() as map<string,string>)")).alias("properties"),
    ).filter("id is not null")
    e = doc.select(F.posexplode(links).alias("ord", "e")).select(
        F.col("ord").cast("long").alias("ord"), "e.source", "e.target", "e.relation", F.coalesce("e.confidence", F.lit("EXTRACTED")).alias("confidence"), "e.confidence_score", F.coalesce("e.properties", F.expr("cast(map() as map<string,string>)")).alias("properties"),
    ).filter("source is not null and target is not null")
    return n, e


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, meta) of a node-link file; absent fields get their defaults, hyperedges are not kept in it."""
    doc = spark.read.schema(GRAPH).option("multiLine", "true").json(path)
    n, e = _tables(doc, "links")
    return n, e, doc.select("graph.*")


def fragment_drops(spark: SparkSession, folder: str) -> DataFrame:
    """(path, chunk, text) of ``chunk_<digits>.json`` files, to be read in order of chunk, then path."""
    raw = spark.read.option("wholetext", "true").option("pathGlobFilter", "chunk_*.json").option("recursiveFileLookup", "true").text(folder)
    out = raw.select(F.col("_metadata.file_path").alias("path"), F.regexp_extract("_metadata.file_name", r"^chunk_(\d+)\.json$", 1).alias("chunk"), F.col("value").alias("text"))
    return out.filter("chunk <> ''").withColumn("chunk", F.col("chunk").cast("int"))


def read_fragments(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, errors): the accepted files' rows, ordered by chunk and path, the first occurrence to win later."""
    checked = validate_fragments(files)
    good = files.join(checked.filter("size(errors) = 0").select("path"), "path", "left_semi")
    doc = good.select("path", "chunk", F.from_json("text", f"nodes array<{_NODE}>, edges array<{_LINK}>").alias("d")).select("path", "chunk", "d.*")
    n, e = _tables(doc, "edges")
    return n, e, checked.filter("size(errors) > 0")


#: Counts and latencies of one process's life.
LEDGER = "schema_version int, boot string, shutdown string, uptime_seconds double, query_zero_hits long, context_zero_hits long, adaptive_context long, recall_zero_hits long, not_ready long, query_route_entity long, query_route_structural long, query_route_search long, ops map<string, struct<count: long, total_ms: double, hist_ms: array<long>>>"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger lines; torn and blank ones are skipped."""
    return spark.read.schema(LEDGER).option("mode", "DROPMALFORMED").json(path).filter("schema_version is not null")


def read_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The manifest of an index; None if it can't be read or its root is no hash."""
    try:
        m = spark.read.parquet(path)
        return m if m.filter(~F.col("sha256").rlike("^[0-9a-fA-F]{64}$")).isEmpty() else None
    except Exception:  # any damage means that there is no manifest
        return None


def read_semantic_cache(spark: SparkSession, path: str, version: int = 2) -> DataFrame | None:
    """Cached records; None for another version, a record without its keys, or a source twice."""
    c = spark.read.json(path)
    bad = c.filter((F.col("version") != version) | F.col("source").isNull() | F.col("sha256").isNull())
    twice = c.groupBy("source").count().filter("count > 1")
    return c if bad.isEmpty() and twice.isEmpty() else None


def path_aliases(config: str, base: str = "") -> list[tuple[str, str, int]]:
    """(prefix, replacement, ord) of a tsconfig or jsconfig with comments; only patterns that end in ``*``."""
    import json
    import posixpath
    import re

    text = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", config, flags=re.S)
    options = json.loads(re.sub(r",(\s*[}\]])", r"\1", text)).get("compilerOptions", {})
    root = posixpath.join(base, options.get("baseUrl", "."))
    out = []
    for pattern, to in options.get("paths", {}).items():
        if pattern.endswith("*"):
            for r in to:
                if r.endswith("*"):
                    tidy = posixpath.normpath(posixpath.join(root, r[:-1]))
                    out.append((pattern[:-1], ("" if tidy == "." else tidy) + "/" * r[:-1].endswith("/"), len(out)))
    return out
