"""Node resolution, search and suggestions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ascii_lower, bounded_edit_distance, contains_ci, label_symbol, lexical_terms, stem_term
from .analyze import is_enrichment, is_memory
from .base import few, first_by, settle, top_by


@dataclass(frozen=True)
class Rule:
    prefix: str
    suffix: str
    relation: str
    direction: str
    name: str


#: Phrases that ask for a structure, in the order in which they are tried.
PHRASES = [
    Rule("callers of ", "", "CALLS", "in", "callers"),
    Rule("who calls ", "", "CALLS", "in", "callers"),
    Rule("what calls ", "", "CALLS", "in", "callers"),
    Rule("callees of ", "", "CALLS", "out", "callees"),
    Rule("what does ", " call", "CALLS", "out", "callees"),
    Rule("references to ", "", "references", "in", "references"),
    Rule("who references ", "", "references", "in", "references"),
    Rule("uses of ", "", "references", "in", "references"),
    Rule("implementations of ", "", "inherits", "in", "implementations"),
    Rule("who implements ", "", "inherits", "in", "implementations"),
    Rule("subclasses of ", "", "inherits", "in", "implementations"),
    Rule("who extends ", "", "inherits", "in", "implementations"),
    Rule("importers of ", "", "imports", "in", "importers"),
    Rule("who imports ", "", "imports", "in", "importers"),
]


def parse_phrase(text: str) -> tuple[Rule, str] | None:
    """The structure that a query asks for and what it asks it of."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for r in PHRASES:
        if low.startswith(r.prefix) and low.endswith(r.suffix) and len(low) >= len(r.prefix) + len(r.suffix):
            of = text[len(r.prefix) : len(text) - len(r.suffix)].rstrip(" \t?").lstrip(" \t")
            if of:
                return r, of
    return None


def phrases(queries: DataFrame, text: str = "query") -> DataFrame:
    """:func:`parse_phrase` for a table of queries: rule (null for none), relation, direction, operand."""
    low = ascii_lower(F.col(text))
    hit, found = F.lit(None).cast("int"), F.lit(None).cast("string")
    for k, r in reversed(list(enumerate(PHRASES))):
        fits = low.startswith(r.prefix) & low.endswith(r.suffix) & (F.char_length(low) >= len(r.prefix) + len(r.suffix))
        of = F.regexp_replace(F.regexp_replace(F.substring(F.col(text), F.lit(len(r.prefix) + 1), F.char_length(F.col(text)) - len(r.prefix) - len(r.suffix)), "[ \\t?]+$", ""), "^[ \\t]+", "")
        ok = fits & (of != "")
        hit, found = F.when(ok, k).otherwise(hit), F.when(ok, of).otherwise(found)
    pick = lambda f: F.element_at(F.array(*[F.lit(getattr(r, f)) for r in PHRASES]), F.col("_rule") + 1)
    out = queries.withColumn("_rule", hit).withColumn("operand", found)
    return out.select("*", pick("name").alias("rule"), pick("relation").alias("relation"), pick("direction").alias("direction")).drop("_rule")


def resolve(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(name, id): the node that each name means, if any.

    An exact id, else the first with that exact label, else among those whose
    label or symbol (label up to a bracket or blank) is the name without regard
    to case the most central, then by label, then the first.  Nodes and names
    meet by tier and key in one equi-join.
    """
    at = lambda tier, key: F.struct(F.lit(tier).alias("tier"), key.alias("k"))
    label = F.col("label")
    keys = F.array(at(1, F.col("id")), at(2, label), at(3, ascii_lower(label_symbol(label))), at(3, ascii_lower(label)))
    name = F.col("name")
    asked = names.select("name").distinct().select("name", F.explode(F.array(at(1, name), at(2, name), at(3, ascii_lower(name)))).alias("x")).select("name", "x.*")
    n = nodes.select("id", "label", "ord", "centrality", F.explode(F.array_distinct(keys)).alias("x")).select("id", "label", "ord", "centrality", "x.*")
    met = n.join(few(settle(asked)), ["tier", "k"])
    by_symbol = F.col("tier") == 3
    c, l = F.when(by_symbol, -F.col("centrality")).otherwise(F.lit(0.0)), F.when(by_symbol, label).otherwise(F.lit(""))
    return first_by(met, ["name"], F.col("tier"), c, l, F.col("ord")).select("name", "id", "tier")


def substring_search(nodes: DataFrame, needle: str, kind: str | None = None, file: str | None = None, limit: int = 50) -> DataFrame:
    """Nodes whose label or id holds ``needle``: non-enrichment first, then central, label, id.

    The empty needle is in every node.  Memory nodes are never found.  ``total``
    counts before the limit.
    """
    s = F.lit(needle)
    hit = nodes.filter((contains_ci(F.col("label"), s) | contains_ci(F.col("id"), s)) & ~is_memory(F.col("id")))
    if kind is not None:
        hit = hit.filter(ascii_lower(F.col("kind")) == ascii_lower(F.lit(kind)))
    if file is not None:
        hit = hit.filter(contains_ci(F.col("source_file"), F.lit(file)))
    order = (is_enrichment(F.col("id")), F.desc("centrality"), "label", "id")
    best = hit.orderBy(*order)
    best = best.limit(limit) if limit else best
    return best.select("id", "label", "kind", "source_file", "centrality", hit.agg(F.count("*")).scalar().alias("total"))


def exact_symbols(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(name, id) of every node that is the name by id, label or symbol."""
    keys = F.array_distinct(F.array(F.col("id"), F.concat(F.lit("\0"), ascii_lower(F.col("label"))), F.concat(F.lit("\0"), ascii_lower(label_symbol(F.col("label"))))))
    n = nodes.filter(~is_memory(F.col("id"))).select("id", F.explode(keys).alias("k"))
    q = names.select("name").distinct().select("name", F.explode(F.array(F.col("name"), F.concat(F.lit("\0"), ascii_lower(F.col("name"))))).alias("k"))
    return q.join(n, "k").select("name", "id").distinct()


def route(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, route, target): structural if the operand of a phrase resolves, entity if one symbol is meant, else search."""
    q = phrases(queries.select("query").distinct())
    structural = q.filter("rule is not null").join(resolve(nodes, q.filter("rule is not null").select(F.col("operand").alias("name"))), F.col("operand") == F.col("name")).select("query", F.lit("structural").alias("route"), F.col("id").alias("target"), F.lit(1).alias("t"))
    words = q.filter(~F.col("query").rlike(r"\s") & (F.col("query") != "")).select(F.col("query").alias("name"))
    one = exact_symbols(nodes, words).groupBy("name").agg(F.min("id").alias("target"), F.count("*").alias("n")).filter("n = 1")
    entity = one.select(F.col("name").alias("query"), F.lit("entity").alias("route"), "target", F.lit(2).alias("t"))
    rest = q.select("query", F.lit("search").alias("route"), F.lit(None).cast("string").alias("target"), F.lit(3).alias("t"))
    return first_by(structural.unionByName(entity).unionByName(rest), ["query"], F.col("t")).drop("t")


def idf_search(nodes: DataFrame, queries: DataFrame, limit: int = 5) -> DataFrame:
    """Stemmed words of labels against those of each query (qid, query): (qid, id, score, rank).

    A term weighs ln(1 + N/(1 + df)); the score is the weight found over the
    weight asked.  Memory and enrichment nodes take no part.  Queries of the
    same terms are answered once, and nodes of one label score alike, so that
    of each label only its first ``limit`` nodes are compared.
    """
    stems = lambda c: F.array_distinct(F.transform(lexical_terms(c), stem_term))
    n = nodes.filter(~is_memory(F.col("id")) & ~is_enrichment(F.col("id"))).select("id", "label", "centrality", "ord")
    total = n.agg(F.count("*")).scalar()
    asking = settle(queries.select("qid", F.array_join(F.array_sort(stems(F.col("query"))), " ").alias("asked")).filter("qid is not null and asked <> ''"))
    q = asking.select("asked").distinct().select("asked", F.explode(F.split("asked", " ")).alias("term"))
    wanted = settle(q.select("term").distinct())
    # only terms that are asked for are ever grouped
    has = settle(n.select("*", F.explode(stems(F.col("label"))).alias("term")).join(few(wanted), "term", "left_semi"))
    df = wanted.join(has.groupBy("term").agg(F.count("*").alias("df")), "term", "left")
    qw = q.join(df.select("term", F.log(1 + total / (1 + F.coalesce("df", F.lit(0)))).alias("w")), "term")
    whole = qw.groupBy("asked").agg(F.sum("w").alias("all"))
    first = settle(top_by(has, ["label", "term"], limit, F.desc("centrality"), F.col("ord")))
    got = qw.join(first.select("label", "term").distinct(), "term").groupBy("asked", "label").agg(F.sum("w").alias("got"))
    score = got.join(whole, "asked").select("asked", "label", F.round(F.col("got") / F.col("all"), 9).alias("score"))
    met = score.join(first.select("label", "id", "centrality", "ord").distinct(), "label")
    best = top_by(met, ["asked"], limit, F.desc("score"), F.desc("centrality"), F.col("label"), F.col("ord"))
    return asking.join(best, "asked").select("qid", "id", "score", "rank")


def suggest(nodes: DataFrame, names: DataFrame, limit: int = 5) -> DataFrame:
    """(name, id, distance, rank): nodes whose symbol or id tail is a few edits from the name.

    The cap is a third of the name, 2 at least; the lengths bound the distance,
    so names meet nodes by length in an equi-join instead of all with all.
    """
    q = names.select("name").distinct().withColumn("k", ascii_lower(F.col("name"))).withColumn("cap", F.greatest(F.lit(2), F.floor(F.char_length("name") / 3).cast("int")))
    q = q.withColumn("len", F.explode(F.sequence(F.greatest(F.lit(0), F.char_length("name") - F.col("cap")), F.char_length("name") + F.col("cap"))))
    tail = ascii_lower(F.regexp_extract("id", r"([^:/.]*)$", 1))
    n = nodes.filter(~is_memory(F.col("id"))).select("id", "label", "centrality", F.explode(F.array_distinct(F.array(ascii_lower(label_symbol(F.col("label"))), tail))).alias("s"))
    met = q.join(n.withColumn("len", F.char_length("s")), "len")
    near = met.withColumn("d", bounded_edit_distance(F.col("k"), F.col("s"), F.col("cap"))).filter(F.col("d") <= F.col("cap"))
    best = near.groupBy("name", "id", "label", "centrality").agg(F.min("d").alias("distance"))
    return top_by(best, ["name"], limit, F.col("distance"), F.desc("centrality"), F.col("label"), F.col("id")).select("name", "id", "distance", "rank")


def neighbour_summary(met: DataFrame, top: int = 5) -> DataFrame:
    """(seed, relation, direction, n, ids): how many neighbours, and the first few by centrality."""
    w = Window.partitionBy("seed", "relation", "direction").orderBy(F.desc("centrality"), "id")
    few = F.when(F.col("_k") <= top, F.struct("_k", "id"))
    return met.withColumn("_k", F.row_number().over(w)).groupBy("seed", "relation", "direction").agg(F.count("*").alias("n"), F.transform(F.sort_array(F.collect_list(few)), lambda x: x["id"]).alias("ids"))
