"""Token-budgeted context: gather around focal nodes, rank, pack."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ascii_lower, lexical_terms, query_term_overlap, slice_token_cost
from .analyze import is_enrichment, is_memory
from .base import few, first_by, settle, top_by
from .search import idf_search, resolve
from .traverse import adjacency

#: Overlap from which a node beyond the first hop is expanded, and bounds of the packers.
THETA, SIBLINGS, CAPACITY = 0.05, 5, 50_000
#: Needles up to which each is looked for in every node.
NEEDLES = 64


def focal(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, id, ord_): the node a query (qid, query) names, else the most central whose label or id holds it, else three by lexical weight."""
    q = queries.select("qid", "query").distinct()
    named = settle(q.join(resolve(nodes, q.select(F.col("query").alias("name"))), F.col("query") == F.col("name")).select("qid", "id", F.lit(1).alias("tier"), F.lit(1).alias("ord_")))
    rest = q.join(named.select("qid"), "qid", "left_anti")
    holding = holders(nodes, rest.select(F.col("query").alias("needle")).distinct())
    holds = rest.join(first_by(holding, ["needle"], F.desc("centrality"), F.col("ord")), F.col("query") == F.col("needle")).select("qid", "id", F.lit(2).alias("tier"), F.lit(1).alias("ord_"))
    lexical = idf_search(nodes, rest, 3).select("qid", "id", F.lit(3).alias("tier"), F.col("rank").alias("ord_"))
    both = named.unionByName(holds).unionByName(lexical)
    best = both.groupBy("qid").agg(F.min("tier").alias("tier"))
    return settle(both.join(best, ["qid", "tier"]).select("qid", "id", "ord_"))


def holders(nodes: DataFrame, needles: DataFrame) -> DataFrame:
    """(needle, id, centrality, ord) of nodes whose label or id holds a needle, A-Z in any case.

    Enrichment and memory are left out, and nothing holds the empty needle.  What
    holds a needle holds its first three characters (all of a shorter one): nodes
    and needles meet by those in an equi-join, and the rest is checked there.
    ``NEEDLES`` or fewer are looked for in each node instead.
    """
    q = settle(needles.filter("needle <> ''").select("needle", ascii_lower(F.col("needle")).alias("low")))
    n = nodes.filter(~is_memory(F.col("id")) & ~is_enrichment(F.col("id"))).select("id", "centrality", "ord", ascii_lower(F.concat("label", F.lit("\0"), "id")).alias("both"))
    rows = q.limit(NEEDLES + 1).collect()
    if len(rows) <= NEEDLES:
        asked = F.array(*[F.struct(F.lit(r.needle).alias("needle"), F.lit(r.low).alias("low")) for r in rows]) if rows else F.expr("cast(array() as array<struct<needle: string, low: string>>)")
        met = n.withColumn("x", F.explode(F.filter(asked, lambda x: F.contains(F.col("both"), x["low"]))))
        return met.select("x.needle", "id", "centrality", "ord")
    q = q.withColumn("gram", F.substring("low", 1, 3))
    grams = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length("both") - k + 1, F.lit(1))), lambda i: F.substring(F.col("both"), i, F.lit(k)))
    met = n.withColumn("gram", F.explode(F.array_distinct(F.flatten(F.array(grams(1), grams(2), grams(3))))))
    return met.join(q, "gram").filter(F.contains("both", "low")).select("needle", "id", "centrality", "ord")


def gather(nodes: DataFrame, edges: DataFrame, queries: DataFrame, seeds: DataFrame, depth: int = 2, adaptive: bool = True) -> DataFrame:
    """(qid, id, depth, via, overlap) around the seeds of each query.

    Undirected, breadth first; enrichment is never walked into.  Adaptive: a
    node beyond the first hop is expanded only if its label shares ``THETA`` of
    the query's terms.  Then the best siblings in a reached node's file join at
    depth 2, if they share a term.
    """
    terms = settle(queries.select("qid", lexical_terms(F.col("query")).alias("terms")))
    n = nodes.filter(~is_memory(F.col("id")) & ~is_enrichment(F.col("id"))).select("id", "source_file", "centrality", lexical_terms(F.col("label")).alias("words"))
    # edges and nodes are read for each hop and kept only where a front touches them
    at = lambda df: n.join(few(settle(df.select("id").distinct())), "id", "left_semi")
    adj = adjacency(edges, "both").select("id", "nid")
    front = settle(seeds.select("qid", "id").distinct())
    reached = front.select("qid", "id", F.lit(0).alias("depth"))
    here = None
    for hop in range(1, depth + 1):
        if adaptive and hop > 1:
            front = settle(front.join(here.select("id", "words"), "id").join(terms, "qid").filter(query_term_overlap(F.col("terms"), F.col("words")) >= THETA).select("qid", "id"))
        step = settle(adj.join(few(settle(front.select("id").distinct())), "id", "left_semi").distinct())
        met = settle(front.join(step, "id").select("qid", F.col("nid").alias("id")).distinct())
        here = settle(at(met))
        front = settle(met.join(here.select("id"), "id", "left_semi").join(reached, ["qid", "id"], "left_anti"))
        reached = reached.unionByName(front.select("qid", "id", F.lit(hop).alias("depth")))
    reached = settle(reached.withColumn("via", F.lit("edge")))
    if adaptive:
        files = settle(reached.join(at(reached).select("id", "source_file"), "id").filter("source_file <> ''").select("qid", "source_file").distinct().join(terms.filter("size(terms) > 0"), "qid"))
        near = n.join(few(files), "source_file").withColumn("overlap", query_term_overlap(F.col("terms"), F.col("words"))).filter("overlap > 0").join(few(settle(reached.select("qid", "id"))), ["qid", "id"], "left_anti")
        best = top_by(near.select("qid", "id", "source_file", "overlap", "centrality"), ["qid", "source_file"], SIBLINGS, F.desc("overlap"), F.desc("centrality"), F.col("id"))
        reached = settle(reached.unionByName(best.select("qid", "id", F.lit(2).alias("depth"), F.lit("same_file").alias("via"))))
    return reached.join(at(reached).select("id", "words"), "id").join(terms, "qid").select("qid", "id", "depth", "via", query_term_overlap(F.col("terms"), F.col("words")).alias("overlap"))


def entry(row: dict, brief: bool = False, snippet: int = 0) -> str:
    """A packed node as compact JSON with sorted keys; ``snippet`` characters stand for its source."""
    out = {"id": row["id"], "label": row["label"], "kind": row["kind"], "depth": int(row["depth"])}
    if row.get("source_file"):
        out["source_file"] = row["source_file"]
    if row.get("start_line"):
        out["line"] = int(row["start_line"])
    if row.get("centrality"):
        out["centrality"] = round(float(row["centrality"]), 6)
    if brief:
        out["snippet_omitted"] = True
    elif snippet:
        out["snippet"] = "x" * snippet
    return json.dumps(out, separators=(",", ":"), sort_keys=True, ensure_ascii=False)


def _tokens(n: int) -> int:
    return (n + 3) // 4


def _snippet(row: dict) -> int:
    return 4 * int(row["cost"]) if row.get("start_line") else 0


def pack_greedy(rows: list[dict], budget: int) -> list[tuple[str, str, int]]:
    """(id, form, tokens) of each candidate: ``full``, else ``brief``, else ``omitted``; the focal comes first.

    ``rows`` are in rank order, the focal with depth 0 first; it is always full.
    """
    return [x for _, x in sorted(greedy(rows, budget))]


def greedy(rows: Iterable[dict], budget: int) -> Iterator[tuple[int, tuple[str, str, int]]]:
    """:func:`pack_greedy` with ranks, of a stream: what is omitted comes at once, the others at the end."""
    kept: list[tuple[int, str, str, int]] = []
    rank = used = 0
    for r in rows:
        if rank and r["via"] == "same_file" and not r["overlap"]:
            continue
        rank += 1
        full = _tokens(len(entry(r, snippet=_snippet(r)).encode()))
        brief = _tokens(len(entry(r, brief=True).encode()))
        if rank == 1 or used + full <= budget:
            kept.append((rank, r["id"], "full", full))
            used += full
        elif used + brief <= budget:
            kept.append((rank, r["id"], "brief", brief))
            used += brief
        else:
            yield rank, (r["id"], "omitted", 0)
    # the array around the entries counts: take from the end what is over
    focus, size = kept[0][3] if kept else 0, sum(4 * x[3] for x in kept[1:])
    while len(kept) > 1 and focus + _tokens(2 + size + len(kept) - 2) > budget:
        at, id_, _, tokens = kept.pop()
        size -= 4 * tokens
        yield at, (id_, "omitted", 0)
    for at, *x in kept:
        yield at, tuple(x)


def knapsack(weights: list[int], values: list[float], capacity: int) -> list[int]:
    """Indices of the best choice within the capacity; of equal ones that which takes later items less."""
    best = [0.0] * (capacity + 1)
    took: list[bytearray] = []
    for w, v in zip(weights, values, strict=True):
        row = bytearray(capacity + 1)
        for c in range(capacity, w - 1, -1):
            if best[c - w] + v > best[c]:
                best[c] = best[c - w] + v
                row[c] = 1
        took.append(row)
    out, c = [], capacity
    for k in range(len(weights) - 1, -1, -1):
        if took[k][c]:
            out.append(k)
            c -= weights[k]
    return out[::-1]


def pack_knapsack(rows: list[dict], budget: int) -> list[tuple[str, str, int]]:
    """(id, form, tokens) of the choice of largest value, shed by value for each token until it fits."""
    if not rows:
        return []
    first, rest = rows[0], rows[1:]
    weights = [max(1, int(r["cost"])) for r in rest]
    values = [(r["overlap"] if r["via"] == "same_file" else 1 / (1 + r["depth"]) + r["overlap"]) * math.sqrt(w) for r, w in zip(rest, weights, strict=True)]
    capacity = min(max(budget - int(first["cost"]), 0), sum(weights), CAPACITY)
    chosen = [(rest[k], values[k], _tokens(len(entry(rest[k], snippet=_snippet(rest[k])).encode()))) for k in knapsack(weights, values, capacity)]
    chosen.sort(key=lambda x: (x[0]["depth"], x[0]["label"]))
    focus = _tokens(len(entry(first, snippet=_snippet(first)).encode()))
    left = sorted(range(len(chosen)), key=lambda k: chosen[k][1] / max(1, chosen[k][2]))
    cost = lambda ks: focus + _tokens(2 + sum(4 * chosen[k][2] for k in ks) + max(len(ks) - 1, 0))
    while left and cost(left) > budget:
        left.pop(0)
    return [(first["id"], "full", focus)] + [(chosen[k][0]["id"], "full", chosen[k][2]) for k in sorted(left)]


def pack(nodes: DataFrame, gathered: DataFrame, budget: int, packer: str = "greedy") -> DataFrame:
    """(qid, rank, id, form, tokens): each query's candidates packed into ``budget`` tokens.

    A packer decides in sequence, for each query over all its candidates, the
    nearest and most central first.  They are read as a stream: what greedy
    holds is bounded by the budget, as an entry has some length.  For the
    knapsack no more than capacity / weight candidates of one weight can be
    chosen, those of most value; the others are left out before.
    """
    if "loc" in nodes.columns:
        start, end, column = F.col("loc.start_line"), F.col("loc.end_line"), F.col("loc.end_column")
    else:
        start, end, column = (F.lit(None).cast("int"),) * 3
    n = nodes.select("id", "label", "kind", "source_file", "centrality", start.alias("start_line"), slice_token_cost(F.col("label"), start, end, column).alias("cost"))
    gathered = settle(gathered)
    n = n.join(few(settle(gathered.select("id").distinct())), "id", "left_semi")
    c = top_by(gathered.join(n, "id"), ["qid"], 0, F.col("depth"), F.desc("centrality"), F.col("label"), F.col("id"), rank="place")
    if packer == "knapsack":
        weight = F.greatest(F.col("cost").cast("int"), F.lit(1))
        value = F.when(F.col("via") == "same_file", F.col("overlap")).otherwise(F.lit(1.0) / (F.col("depth") + 1) + F.col("overlap")) * F.sqrt(weight)
        c = c.withColumn("w", F.when(F.col("place") > 1, weight))  # the focus is no item
        c = top_by(c.withColumn("v", value), ["qid", "w"], 0, F.desc("v"), F.col("place"), rank="of").filter(f"w is null or of * w <= {min(budget, CAPACITY)}").drop("w", "v", "of")
    choose = {"greedy": greedy, "knapsack": lambda rows, most: enumerate(pack_knapsack(list(rows), most), 1)}[packer]
    fields = c.columns

    def run(batches):
        rows = (r for b in batches for r in b.to_pylist())
        for qid, mine in groupby(rows, key=lambda r: r["qid"]):
            found = ((qid, rank, *packed) for rank, packed in choose(mine, budget))
            while part := list(islice(found, 10_000)):
                yield pa.RecordBatch.from_pydict(dict(zip(["qid", "rank", "id", "form", "tokens"], zip(*part, strict=True), strict=True)), pa.schema([("qid", key), ("rank", pa.int32()), ("id", pa.string()), ("form", pa.string()), ("tokens", pa.int64())]))

    kind = dict(c.dtypes)["qid"]
    key = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    c = c.repartition("qid").sortWithinPartitions("qid", "place").select(*fields)
    return c.mapInArrow(run, f"qid {kind}, rank int, id string, form string, tokens long")


def snippets(wanted: DataFrame, sources: DataFrame, lines: int = 40, chars: int = 2000) -> DataFrame:
    """Source lines of (key, path, start_line, end_line): key, snippet, truncated.

    ``sources`` is (path, text[, sha256]); at most ``lines`` lines and ``chars``
    characters with a line end for each.  With ``pinned`` hashes in ``wanted``
    a file whose hash is missing or another gives no snippet.
    """
    s = sources.select("path", F.split("text", "\n").alias("all"), *([F.col("sha256")] if "sha256" in sources.columns else []))
    w = wanted.join(s, "path", "left")
    if "pinned" in wanted.columns and "sha256" in sources.columns:
        w = w.withColumn("all", F.when(F.col("pinned") == F.col("sha256"), F.col("all")))
    n = F.least(F.col("end_line") - F.col("start_line") + 1, F.lit(lines))
    w = w.withColumn("part", F.when(F.col("start_line") <= F.size("all"), F.slice("all", F.col("start_line"), F.greatest(n, F.lit(0)))))
    kept = F.aggregate("part", F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("out"), F.lit(False).alias("full")), lambda a, x: F.when(a["full"] | (a["used"] + F.char_length(x) + 1 > chars), F.struct(a["used"].alias("used"), a["out"].alias("out"), F.lit(True).alias("full"))).otherwise(F.struct((a["used"] + F.char_length(x) + 1).alias("used"), F.concat(a["out"], F.array(x)).alias("out"), F.lit(False).alias("full"))))
    w = w.withColumn("k", kept)
    cut = F.col("k.full") | (F.col("end_line") - F.col("start_line") + 1 > lines)
    return w.select("key", F.array_join("k.out", "\n").alias("snippet"), cut.alias("truncated"))


def first_site(nodes: DataFrame) -> DataFrame:
    return first_by(nodes.filter("source_file <> ''"), ["source_file"], F.col("ord"))
