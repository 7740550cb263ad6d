"""Contracts between services: generated from a spec, anchored in consumers' graphs, fused."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .merge import EDGE_KEY, dangling, override_union
from .resolve import anchor


class SeamError(ValueError):
    """The spec is incomplete or points nowhere; nothing is emitted."""


def _need(doc: dict, fields: tuple[str, ...], where: str) -> None:
    missing = [f for f in fields if f not in doc]
    if missing:
        raise SeamError(f"{where} lacks {', '.join(missing)}")


def generate(spark: SparkSession, spec: dict, graphs: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a spec; ``graphs`` has each consumer's nodes.

    All checks come before any row: fields, endpoints and schemas that are
    referred to, and call sites, which must lie in a node.  Call sites of one
    consumer are anchored in one join.
    """
    _need(spec, ("provider", "api_version", "services", "schemas", "endpoints", "consumes", "mirrors"), "spec")
    who, version = spec["provider"], spec["api_version"]
    endpoint = lambda m, p: f"endpoint:{who}:{m} {p}"
    schema = lambda s: f"schema:{who}:{version}:{s}"
    nodes: dict[str, tuple] = {}
    edges: list[tuple[str, str, str]] = []

    def put(id_, label, kind, file, **props):
        nodes.setdefault(id_, (len(nodes), id_, label, kind, file, {k: v for k, v in props.items() if v is not None}))

    csv = lambda xs, end="": ",".join(f"{x}{end}" for x in xs)
    for s in spec["services"]:
        _need(s, ("name",), "service")
        put(f"service:{s['name']}", s["name"], "service", "", role=s.get("role", ""), owned="true" if s.get("owned") else "false", **{k: s.get(k) or None for k in ("status", "replacement", "graph")})
    for s in spec["schemas"]:
        _need(s, ("name", "canonical"), "schema")
        put(schema(s["name"]), s["name"], "schema", s["canonical"], canonical=s["canonical"])
    for e in spec["endpoints"]:
        _need(e, ("method", "path", "response_schema"), "endpoint")
        id_ = endpoint(e["method"], e["path"])
        put(id_, f"{e['method']} {e['path']}", "endpoint", "", provider=who, method=e["method"], path_template=e["path"], path_params=csv(e.get("path_params", [])), response_schema=e["response_schema"], error_codes=csv(e.get("error_codes", spec.get("error_codes", []))), query_params=csv(e.get("query_params", []), "?") or None)
        edges += [(id_, f"service:{who}", "SERVED_BY"), (id_, schema(e["response_schema"]), "RESPONDS_WITH")]
    sites: list[tuple[str, str, str, int, str]] = []
    for c in spec["consumes"]:
        _need(c, ("service", "method", "path", "call_site"), "consumes")
        id_ = endpoint(c["method"], c["path"])
        if id_ not in nodes:
            raise SeamError(f"unknown endpoint: {c['method']} {c['path']}")
        edges.append((f"service:{c['service']}", id_, "CONSUMES"))
        _need(c["call_site"], ("graph", "file", "line"), "call_site")
        sites.append((id_, c["call_site"]["graph"], c["call_site"]["file"], int(c["call_site"]["line"]), "CONSUMED_AT"))
    for m in spec["mirrors"]:
        _need(m, ("schema", "graph", "file", "line"), "mirrors")
        if schema(m["schema"]) not in nodes:
            raise SeamError(f"unknown schema: {m['schema']}")
        sites.append((schema(m["schema"]), m["graph"], m["file"], int(m["line"]), "MIRRORED_BY"))
    unknown = {g for _, g, *_ in sites} - graphs.keys()
    if unknown:
        raise SeamError(f"unknown graphs: {', '.join(sorted(unknown))}")
    found: dict[int, dict] = {}
    for g in sorted({s[1] for s in sites}):
        mine = spark.createDataFrame([(k, s[2], s[3]) for k, s in enumerate(sites) if s[1] == g], "site int, file string, line int")
        rows = anchor(mine, graphs[g]).join(graphs[g].select("id", "label", "kind", "source_file", "loc"), "id")
        found |= {r["site"]: r.asDict(True) for r in rows.collect()}  # a row a call site of the spec
    for k, (of, g, file, line, relation) in enumerate(sites):
        if k not in found:
            raise SeamError(f"no node at {file}:{line} in {g}")
        r = found[k]
        put(r["id"], r["label"], "code-ref", r["source_file"], service=g, symbol_kind=r["kind"], span=f"{r['loc']['start_line']}-{r['loc']['end_line']}")
        edges.append((of, r["id"], relation))
    n = spark.createDataFrame(list(nodes.values()), "ord long, id string, label string, kind string, source_file string, properties map<string,string>")
    e = spark.createDataFrame([(k, *x) for k, x in enumerate(edges)], "ord long, source string, target string, relation string")
    return n, e


def fuse(seam: tuple[DataFrame, DataFrame], services: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """The seam and the services' own graphs as one; their nodes replace shadows, the later service's win.

    Edges are distinct and carry no more than their key.  A dangling edge fails
    the whole.
    """
    n, e = seam
    cols = ["id", "label", "kind", "source_file", "properties"]
    big = 1 << 40
    n = n.select("ord", *cols)
    more = None
    for k, (sn, se) in enumerate(services, 1):
        part = sn.select((F.col("ord") + k * big).alias("ord"), *cols)
        more = part if more is None else more.unionByName(part)
        e = e.select("ord", *EDGE_KEY).unionByName(se.select((F.col("ord") + k * big).alias("ord"), *EDGE_KEY))
    n = override_union(n, more, ["id"]) if more is not None else n
    e = e.groupBy(*EDGE_KEY).agg(F.min("ord").alias("ord"))
    lost = dangling(n, e).limit(3).collect()
    if lost:
        raise SeamError(f"dangling edges: {[tuple(x) for x in lost]}")
    return n, e
