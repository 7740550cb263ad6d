"""The registered queries and the SQL that each must agree with.

A query is a function of (spark, sf_dir) under ``@query(name, sql)``; SQL is
DuckDB's, None where it can't say it.  Graph queries run over the projection of
the driver's tables (:mod:`weftgraph.plans.projection`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalar as fn
from .operators import analyze, dedup, merge, resolve, search, stats, traverse
from .plans import projection as proj

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        name = f.__name__
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import catalogue_more, catalogue_rules  # noqa: F401  register more

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import catalogue_more, catalogue_rules  # noqa: F401

    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return proj.nodes(spark, sf_dir), proj.edges(spark, sf_dir)


def ids(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "id string")


def with_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    c = analyze.centrality(nodes, edges).select("id", F.col("degree_centrality").alias("centrality"))
    return nodes.join(c, "id", "left").withColumn("centrality", F.coalesce("centrality", F.lit(0.0)))


G = f"with nodes as ({proj.NODES_SQL}), edges as ({proj.EDGES_SQL}), ends as (select source as id from edges union all select target from edges), deg as (select n.id, count(e.id)::bigint as degree from (select distinct id from nodes) n left join ends e on n.id = e.id group by n.id), cent as (select id, degree, round(degree / (select max(degree) from deg), 6) as centrality from deg)"
GR = G.replace("with nodes", "with recursive nodes", 1)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What depends on nation 0 within three hops, by depth, centrality, label and id."""
    n, e = graph(spark, sf_dir)
    reached = traverse.impact(e, ids(spark, "nation:0"), "dependents", None, 3)
    return traverse.ranked_impact(with_centrality(n, e), reached)


# --- centrality and communities -------------------------------------------


@query(f"{G} select id, degree, centrality as degree_centrality from cent")
def degree_centrality(spark, d):
    return analyze.centrality(*graph(spark, d))


@query(f"{G} select n.id, degree, r::int as god_node_rank, r <= 3 as god_node from (select n.id, degree, row_number() over (order by degree desc, ord) as r from nodes n join deg using (id)) n where r <= 10")
def god_nodes(spark, d):
    return analyze.god_nodes(*graph(spark, d))


#: Stand-in communities: a customer's or supplier's nation, all else by kind.
def _communities(spark, d):
    n, e = graph(spark, d)
    home = e.filter(F.col("relation") == "IN_NATION").select(F.col("source").alias("id"), F.col("target").alias("c"))
    return n.join(home, "id", "left").withColumn("community", F.coalesce("c", "kind")).drop("c"), e


_COMM = G + ", comm as (select n.id, coalesce(e.target, n.kind) as community from nodes n left join edges e on e.source = n.id and e.relation = 'IN_NATION')"


@query(f"{_COMM} select relation, a.community as source_community, b.community as target_community, count(*)::bigint as n from edges e join comm a on a.id = source join comm b on b.id = target where a.community <> b.community group by 1, 2, 3")
def cross_community_edges(spark, d):
    out = analyze.cross_community(*_communities(spark, d))
    return out.groupBy("relation", "source_community", "target_community").agg(F.count("*").alias("n"))


@query(f"{_COMM}, x as (select a.community as c, (a.community = b.community)::int as inside from edges join comm a on a.id = source join comm b on b.id = target union all select b.community, 0 from edges join comm a on a.id = source join comm b on b.id = target), y as (select c, sum(inside) as l, count(*) as k from x group by c) select round(sum(2 * l / (select sum(k) from y) - (k / (select sum(k) from y)) ** 2), 9) as modularity from y")
def modularity(spark, d):
    return analyze.modularity(*_communities(spark, d)).select(F.round("modularity", 9).alias("modularity"))


@query()
def communities(spark, d):
    return analyze.communities(*graph(spark, d))


@query()
def community_layout(spark, d):
    return analyze.layout(_communities(spark, d)[0])


@query("select 'doc' as kind, 3::bigint as documents, 2::bigint as connected_documents, 2::bigint as concepts, 1::bigint as orphan_concepts, 2::bigint as doc_code_edges")
def semantic_connectivity(spark, d):
    n = ids(spark, "doc:a", "doc:b", "doc:c", "concept:x", "topic:y", "media:m", "fn:f")
    e = spark.createDataFrame([("doc:a", "fn:f"), ("doc:b", "concept:x"), ("concept:x", "fn:f"), ("doc:c", "topic:y"), ("doc:a", "media:m")], "source string, target string")
    return analyze.semantic_connectivity(n, e).select(F.lit("doc").alias("kind"), "*")


# --- neighbours and blast radius -------------------------------------------


def _nb(direction):
    c = {"out": "e.source", "in": "e.target"}
    o = {"out": "e.target", "in": "e.source"}
    part = lambda k: f"select {c[k]} as seed, {o[k]} as id, relation, '{k}' as direction from edges e where {c[k]} in ('nation:3', 'part:7', 'customer:11')"
    return f"{G}, met as ({' union all '.join(part(k) for k in (('out', 'in') if direction == 'both' else (direction,)))}) select seed, met.id, relation, direction, n.label, n.kind, coalesce(c.centrality, 0) as centrality from met left join nodes n using (id) left join cent c using (id)"


def _neighbours(direction):
    def run(spark, d):
        n, e = graph(spark, d)
        return traverse.neighbours(with_centrality(n, e), e, ids(spark, "nation:3", "part:7", "customer:11"), direction).select("seed", "id", "relation", "direction", "label", "kind", "centrality")

    return run


for _d in traverse.DIRECTIONS:
    _f = _neighbours(_d)
    _f.__name__ = f"neighbors_{_d}"
    query(_nb(_d))(_f)


@query(f"{_nb('both').replace(G, G).replace('select seed, met.id', 'select * from (select seed, met.id, row_number() over (partition by seed order by coalesce(c.centrality, 0) desc, met.id, relation, direction desc) as rank, count(*) over (partition by seed)::bigint as neighbor_count')}) where rank <= 10")
def explain_topk(spark, d):
    n, e = graph(spark, d)
    e = e.withColumn("ord", F.lit(0).cast("long"))
    out = traverse.explain(with_centrality(n, e), e, ids(spark, "nation:3", "part:7", "customer:11"), limit=10)
    return out.select("seed", "id", F.col("rank").cast("long").alias("rank"), "neighbor_count", "relation", "direction", "label", "kind", "centrality")


def _reach(seed, pairs, depth):
    return f"""{GR}, adj as ({pairs}), reach(id, depth) as (select '{seed}', 0 union select a.nid, r.depth + 1 from reach r join adj a on a.id = r.id where r.depth < {depth})
    select '{seed}' as seed, id, min(depth)::int as depth from reach where id <> '{seed}' group by id"""


_IN = "select target as id, source as nid from edges"
_OUT = "select source as id, target as nid from edges"


@query(_reach("nation:0", _IN, 3))
def impact_dependents(spark, d):
    return traverse.impact(graph(spark, d)[1], ids(spark, "nation:0"), "dependents")


@query(_reach("order:1", _OUT, 3))
def impact_dependencies(spark, d):
    return traverse.impact(graph(spark, d)[1], ids(spark, "order:1"), "dependencies")


@query(_reach("supplier:1", f"{_IN} union {_OUT}", 2))
def impact_both(spark, d):
    return traverse.impact(graph(spark, d)[1], ids(spark, "supplier:1"), "both", depth=2)


@query(_reach("part:5", "select source as id, target as nid from edges where relation = 'SUPPLIED_BY' union all select target, source from edges where false", 3))
def impact_relation(spark, d):
    return traverse.impact(graph(spark, d)[1], ids(spark, "part:5"), "dependencies", "SUPPLIED_BY")


@query(" union all ".join(f"select * from ({_reach(s, _IN, 2)})" for s in ("nation:1", "region:2", "part:9")))
def impact_many_seeds(spark, d):
    return traverse.impact(graph(spark, d)[1], ids(spark, "nation:1", "region:2", "part:9"), "dependents", depth=2)


@query()
def impact_via(spark, d):
    return traverse.impact(graph(spark, d)[1], ids(spark, "nation:0"), "both", depth=2, via=True)


@query(f"{GR}, adj as ({_IN} union {_OUT}), reach(id, depth) as (select 'customer:1', 0 union select a.nid, r.depth + 1 from reach r join adj a on a.id = r.id where r.depth < 6) select (min(depth) + 1)::bigint as n from reach where id = 'customer:2'")
def shortest_path_length(spark, d):
    return traverse.shortest_path(proj.edges(spark, d, True), "customer:1", "customer:2").agg(F.count("*").alias("n"))


@query()
def shortest_path(spark, d):
    return traverse.shortest_path(proj.edges(spark, d, True), "customer:1", "supplier:2")


@query(f"{_reach('region:1', f'{_IN} union {_OUT}', 3)} union all select 'region:1', 'region:1', 0")
def distances(spark, d):
    return traverse.distances(graph(spark, d)[1], ids(spark, "region:1"), 3)


@query(f"{GR.split(', ends as')[0]}, e as (select source as a, target as b from edges union select target, source from edges), r(id, o) using key (id) as (select id, ord from nodes union select e.b, min(r.o) from r join e on e.a = r.id join recurring.r as c on c.id = e.b where r.o < c.o group by e.b) select id, o::bigint as root from r")
def connected_components(spark, d):
    n, e = graph(spark, d)
    o = n.select("id", "ord")
    p = e.join(o.select(F.col("id").alias("source"), F.col("ord").alias("a")), "source").join(o.select(F.col("id").alias("target"), F.col("ord").alias("b")), "target")
    return traverse.components(n, p.select("a", "b")).join(o, "ord").select("id", "root")


# --- resolution and search -------------------------------------------------

_NAMES = ["nation:3", "NATION_3", "nation_3", "Order#7", "ORDER#7", "Customer#000000001", "supplier#000000001", "nothing", "region:1", ""]
_names = lambda spark: spark.createDataFrame([(n,) for n in _NAMES], "name string")
_NAMES_SQL = "names(name) as (values " + ", ".join(f"('{n}')" for n in _NAMES) + ")"
_SYM = "regexp_extract(label, '^[^( \\t\\n]*')"


@query(f"{G}, {_NAMES_SQL}, n as (select n.*, centrality, lower({_SYM}) as sym from nodes n join cent using (id)), m as (select name, id, 1 as tier, 0 as c, '' as l, ord from names join n on name = id union all select name, id, 2, 0, '', ord from names join n on name = label union all select name, id, 3, -centrality, label, ord from names join n on lower(name) = sym or lower(name) = lower(label)) select name, id, tier::int as tier from (select *, row_number() over (partition by name order by tier, c, l, ord) as r from m) where r = 1")
def resolve_node(spark, d):
    return search.resolve(with_centrality(*graph(spark, d)), _names(spark))


_SEARCH = "select id, label, kind, source_file, centrality, count(*) over ()::bigint as total from nodes join cent using (id) where {} order by centrality desc, label, id limit {}"


@query(f"{G} {_SEARCH.format('contains(lower(label), ' + repr('an') + ') or contains(id, ' + repr('an') + ')', 50)}")
def substring_search(spark, d):
    return search.substring_search(with_centrality(*graph(spark, d)), "AN")


@query(f"{G} {_SEARCH.format('(contains(lower(label), ' + repr('00') + ') or contains(id, ' + repr('00') + ')) and kind = ' + repr('supplier') + ' and contains(source_file, ' + repr('supp') + ')', 20)}")
def kind_file_filter(spark, d):
    return search.substring_search(with_centrality(*graph(spark, d)), "00", "SUPPLIER", "Supp", 20)


_ASK = ["callers of NATION_6", "Who calls nation:3?", "what does Order#7 call", "references to nothing", "NATION_7", "customer#000000002", "some words", "uses of  region:1 ", "importers of", "zzz"]


@query("select query, route, target from (values " + ", ".join(f"('{q}', '{r}', {t})" for q, r, t in zip(_ASK, ["structural", "structural", "structural", "search", "entity", "entity", "search", "structural", "search", "search"], ["'nation:6'", "'nation:3'", "'order:7'", "null", "'nation:7'", "'customer:2'", "null", "'region:1'", "null", "null"], strict=True)) + ") t(query, route, target)")
def query_route(spark, d):
    return search.route(with_centrality(*graph(spark, d)), spark.createDataFrame([(q,) for q in _ASK], "query string"))


_TERMS = "list_distinct(list_transform(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda t: length(t) >= 3), lambda t: {}))"
_STEM = "regexp_replace(t, '^(.{4,}?)(?:" + "|".join(fn.SUFFIXES) + ")$', '\\1')"


@query(f"""{G}, q as (select p_partkey as qid, unnest({_TERMS.format("p_name || ' ' || p_type", _STEM)}) as term from part where p_partkey % 50 = 0),
n as (select n.id, label, centrality, ord, {_TERMS.format('label', _STEM)} as terms from nodes n join cent using (id)),
pages_n as (select count(*) as total from n), has as (select id, unnest(terms) as term from n),
w as (select term, ln(1 + (select total from pages_n) / (1 + (select count(*) from has h where h.term = x.term))) as w from (select distinct term from q) x),
s as (select q.qid, h.id, round(sum(w) / (select sum(w2.w) from q q2 join w w2 using (term) where q2.qid = q.qid), 9) as score from q join w using (term) join has h using (term) group by q.qid, h.id)
select qid, id, score, rank::int as rank from (select s.*, row_number() over (partition by qid order by score desc, centrality desc, label, ord) as rank from s join n using (id)) where rank <= 5""")
def idf_search(spark, d):
    n = with_centrality(*graph(spark, d))
    q = table(spark, d, "part").filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("qid"), F.concat_ws(" ", "p_name", "p_type").alias("query"))
    return search.idf_search(n, q)


_TYPOS = ["NATON_3", "AFRCA", "nation", "ASIAA", "MIDLE EST", "Customer#00000001"]


@query(f"""{G}, q as (select unnest({_TYPOS}) as name), n as (select n.id, label, centrality, lower({_SYM}) as sym, lower(regexp_extract(n.id, '([^:/.]*)$', 1)) as tail from nodes n join cent using (id)),
m as (select name, id, label, centrality, least(levenshtein(lower(name), sym), levenshtein(lower(name), tail)) as dist, greatest(2, length(name) // 3) as cap from q, n)
select name, id, dist::int as distance, rank::int as rank from (select *, row_number() over (partition by name order by dist, centrality desc, label, id) as rank from m where dist <= cap) where rank <= 5""")
def suggestions(spark, d):
    n = with_centrality(*graph(spark, d))
    return search.suggest(n, spark.createDataFrame([(t,) for t in _TYPOS], "name string"))


@query(f"{_nb('both').replace('select seed, met.id', 'select seed, relation, direction, count(*)::bigint as n, string_agg(id, chr(32) order by k) filter (k <= 5) as ids from (select *, row_number() over (partition by seed, relation, direction order by centrality desc, id) as k from (select seed, met.id')})) group by seed, relation, direction")
def neighbor_summary(spark, d):
    return search.neighbour_summary(_neighbours("both")(spark, d)).select("seed", "relation", "direction", "n", F.array_join("ids", " ").alias("ids"))


# --- functions -------------------------------------------------------------


@query("select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') as ident, list_aggregate(list_sort(list_distinct(list_transform(range(greatest(length(p_name) - 2, 1)), lambda i: substr(p_name, i + 1, 3)))), 'string_agg', '|') as grams, ((strlen(p_name) + 3) // 4)::bigint as tokens, regexp_extract(p_name, '^[^( \\t\\n]*') as symbol from part")
def text_functions(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", fn.make_id(n).alias("ident"), F.array_join(F.array_sort(fn.shingles(n)), "|").alias("grams"), fn.estimate_tokens(n).alias("tokens"), fn.label_symbol(n).alias("symbol"))


@query("select p_partkey, round(coalesce((select sum(-c / length(p_name) * log2(c / length(p_name))) from (select count(*) as c from (select unnest(string_split(p_name, '')) as ch) group by ch)), 0), 9) as bits from part")
def entropy(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(fn.shannon_entropy(F.col("p_name")), 9).alias("bits"))


@query("select p_partkey, least(levenshtein(p_name, p_type), 7)::int as distance, replace(replace(replace(replace(replace(p_name || '<&>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') as html, replace(replace(p_brand || '\\''', '\\', '\\\\'), '''', '\\''') as cypher, lower(p_type) as ident from part")
def escapes_and_distance(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", fn.bounded_edit_distance(F.col("p_name"), F.col("p_type"), 6).alias("distance"), fn.html_escape(F.concat("p_name", F.lit("<&>"))).alias("html"), fn.cypher_escape(F.concat("p_brand", F.lit("\\'"))).alias("cypher"), fn.normalize_sql_ident(F.col("p_type")).alias("ident"))


@query("select page_id, coalesce(nullif(regexp_replace(left(trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-'), 60), '-+$', ''), ''), 'checkpoint') as slug, list_aggregate(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(url), '[^a-z0-9]+'), lambda t: length(t) >= 3))), 'string_agg', ' ') as terms from pages")
def slugs_and_terms(spark, d):
    u = F.lower("url")
    return table(spark, d, "pages").select("page_id", fn.slugify(F.col("url")).alias("slug"), F.array_join(F.array_sort(fn.lexical_terms(u)), " ").alias("terms"))


@query("select doc_id, sha256(text) as digest, sha256('\\x00'::blob || unhex(lpad(printf('%x', strlen('doc/' || doc_id)), 8, '0')) || encode('doc/' || doc_id) || unhex(sha256(text))) as leaf from documents")
def merkle_leaves(spark, d):
    digest = fn.sha256_hex(F.col("text"))
    return table(spark, d, "documents").select("doc_id", digest.alias("digest"), fn.merkle_leaf(F.concat(F.lit("doc/"), F.col("doc_id")), digest).alias("leaf"))


# --- merging ---------------------------------------------------------------


def _events(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("ord"), F.concat(F.lit("u"), F.col("user_id") % 50).alias("id"), F.col("event_type").alias("kind"))


@query("select ord, id, kind from (select event_id as ord, 'u' || (user_id % 50) as id, event_type as kind, row_number() over (partition by user_id % 50 order by event_id) as r from events) where r = 1")
def merge_first_wins(spark, d):
    return merge.merge_nodes(_events(spark, d))


@query("select id, kind, min(event_id)::bigint as ord from (select event_id, 'u' || (user_id % 50) as id, event_type as kind from events) where event_id >= 40 and (id, kind) not in (select ('u' || (user_id % 50), event_type) from events where event_id < 40) group by 1, 2 union all select 'u' || (user_id % 50), event_type, event_id from events where event_id < 40")
def left_anti_merge(spark, d):
    e = _events(spark, d)
    return merge.append_absent(e.filter("ord < 40"), e.filter("ord >= 40"), ["id", "kind"])


@query("select id, kind, ord from (select *, row_number() over (partition by id order by side desc, ord desc) as r from (select event_id as ord, 'u' || (user_id % 50) as id, event_type as kind, (event_id >= 300)::int as side from events)) where r = 1")
def override_union(spark, d):
    e = _events(spark, d)
    base = merge.merge_nodes(e.filter("ord < 300"))
    return merge.override_union(base, e.filter("ord >= 300"), ["id"])


_MOD = "case when {0} like 'customer:%' then 'customer:' || (substr({0}, 10)::int % 10) else {0} end"


@query(f"{G} select distinct {_MOD.format('source')} as source, {_MOD.format('target')} as target, relation from edges")
def edge_rewrite(spark, d):
    n, e = graph(spark, d)
    remap = n.filter("kind = 'customer'").select(F.col("id").alias("old"), F.concat(F.lit("customer:"), F.substring("id", 10, 20).cast("int") % 10).alias("new"))
    return merge.rewrite_edges(e.withColumn("ord", F.xxhash64("source", "target")), remap).drop("ord")


_THIRD = "split_part({0}, ':', 1) = 'supplier' and split_part({0}, ':', 2)::int % 3 = 0"


@query(f"{G} select source, target, relation from edges where {_THIRD.format('source')} or {_THIRD.format('target')}")
def dangling_edges(spark, d):
    n, e = graph(spark, d)
    return merge.dangling(n.filter("kind <> 'supplier' or substring(id, 10) % 3 <> 0"), e)


# --- resolution ------------------------------------------------------------


@query("with need as (select distinct l_suppkey, l_partkey from lineitem), has as (select distinct l_orderkey % 5 as who, l_partkey from lineitem), size as (select l_suppkey, count(*) as n from need group by 1) select who, l_suppkey as grp from has join need using (l_partkey) join size using (l_suppkey) group by who, l_suppkey, n having count(*) = n")
def relational_division(spark, d):
    li = table(spark, d, "lineitem")
    wants = li.select(F.col("l_suppkey").alias("grp"), F.col("l_partkey").alias("item"))
    return resolve.relational_division(li.select((F.col("l_orderkey") % 5).alias("who"), F.col("l_partkey").alias("item")), wants, "who", "grp", "item")


_URLPATH = "regexp_replace(url, '^[a-z]+://', '')"


@query(f"with f as (select page_id::varchar as id, {_URLPATH} as path from pages), s as (select distinct regexp_extract(path, '[^/]*/[^/]*$') as spec from f) select spec, min(id) as id from s join f on path = spec or ends_with(path, '/' || spec) where spec <> '' group by spec having count(*) = 1")
def suffix_unique_match(spark, d):
    f = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("id"), F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return resolve.unique_suffix(f.select(F.regexp_extract("path", "[^/]*/[^/]*$", 0).alias("spec")).filter("spec <> ''"), f)


@query("with n as (select l_orderkey * 10 + l_linenumber as ord, 'f' || (l_suppkey % 20) as file, l_partkey % 500 as a, l_partkey % 500 + l_quantity::int as b from lineitem), s as (select event_id as site, 'f' || (user_id % 20) as file, (event_id * 7 % 500)::int as line from events) select site, id from (select site, ord::varchar as id, row_number() over (partition by site order by b - a, ord) as r from s join n using (file) where line between a and b) where r = 1")
def range_anchor(spark, d):
    n = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.concat(F.lit("src/f"), F.col("l_suppkey") % 20).alias("source_file"), F.lit("function").alias("kind"),
        F.expr("named_struct('start_line', cast(l_partkey % 500 as int), 'end_line', cast(l_partkey % 500 + cast(l_quantity as int) as int))").alias("loc"),
    ).withColumn("id", F.col("ord").cast("string"))
    s = table(spark, d, "events").select(F.col("event_id").alias("site"), F.concat(F.lit("f"), F.col("user_id") % 20).alias("file"), (F.col("event_id") * 7 % 500).cast("int").alias("line"))
    return resolve.anchor(s, n)


#: Suppliers call parts, which are declared in the "file" of their brand; some are methods, some are imported.
def _calls(spark, d):
    label = F.when(F.col("p_partkey") % 7 == 0, F.concat_ws(" ", "p_name", "p_partkey")).otherwise(F.col("p_name"))
    p = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("ord"), F.concat(F.lit("part:"), F.col("p_partkey")).alias("id"), label.alias("label"), F.lit("function").alias("kind"), F.col("p_brand").alias("source_file"))
    c = table(spark, d, "supplier").select((F.col("s_suppkey") + 10**6).alias("ord"), F.concat(F.lit("supplier:"), F.col("s_suppkey")).alias("id"), F.col("s_name").alias("label"), F.lit("module").alias("kind"), F.concat(F.lit("Brand#"), F.col("s_suppkey") % 6).alias("source_file"))
    n = p.unionByName(c).withColumn("properties", F.expr("if(kind = 'function' and ord % 97 = 5, map('method', 'true'), cast(map() as map<string,string>))"))
    brands = table(spark, d, "part").select("p_brand").distinct()
    n = n.unionByName(brands.select(F.lit(2 * 10**6).cast("long").alias("ord"), F.concat(F.lit("file:"), "p_brand").alias("id"), F.col("p_brand").alias("label"), F.lit("file").alias("kind"), F.col("p_brand").alias("source_file"), F.expr("cast(map() as map<string,string>)").alias("properties")))
    imports = p.filter("ord % 3 = 0").select("ord", F.concat(F.lit("file:Brand#"), F.col("ord") % 6).alias("source"), F.col("id").alias("target"), F.lit("imports").alias("relation"))
    li = table(spark, d, "lineitem").join(p.select(F.col("ord").alias("l_partkey"), "label"), "l_partkey")
    raw = li.select(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("ord"), F.concat(F.lit("supplier:"), F.col("l_suppkey")).alias("caller_id"), F.col("label").alias("callee_label"), F.lit("").alias("source_file"), F.lit(None).cast("int").alias("loc"), (F.col("l_linenumber") == 7).alias("is_member_call"))
    return n, merge.merge_edges(imports), raw


_KEY = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '_', 'g'), '_')"


_OUTCOMES = f"""with decl as (select p_partkey, p_brand as f, {_KEY.format("case when p_partkey % 7 = 0 then p_name || ' ' || p_partkey else p_name end")} as k, p_partkey % 97 = 5 as method from part),
g as (select k, count(*) as n, count(distinct f) as nf, count(*) filter (method) as methods, min(p_partkey) as lone from decl group by k), h as (select k, f, count(*) as n, bool_or(method) as method from decl group by k, f),
c as (select l_linenumber = 7 as member, 'Brand#' || (l_suppkey % 6) as f, k from lineitem join decl on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey),
o as (select case when h.n = 1 and (not member or h.method) then 'resolved_same_file' when h.n > 1 then 'resolved_overload_first' when not member and g.n = 1 then 'resolved_project_unique' when not member and g.nf = 1 then 'resolved_overload_first'
    when not member and g.n > 1 then 'dropped_ambiguous' when member and g.methods = 1 then 'resolved_member_method' else 'dropped_unknown' end as outcome,
    case when h.n = 1 and (not member or h.method) or not member and h.n is null and g.n = 1 and lone % 3 = 0 and c.f = 'Brand#' || (lone % 6) and exists (from part where p_brand = c.f) then 'EXTRACTED' else 'INFERRED' end as confidence
    from c join g using (k) left join h on h.k = c.k and h.f = c.f)"""
_TALLIED = ["resolved_same_file", "resolved_project_unique", "resolved_member_method", "resolved_overload_first", "dropped_unknown", "dropped_ambiguous", "dropped_self"]


@query(f"{_OUTCOMES} select outcome, confidence, count(*)::bigint as n from o group by outcome, confidence")
def call_resolution_tiers(spark, d):
    return resolve.call_outcomes(*_calls(spark, d)).groupBy("outcome", "confidence").agg(F.count("*").alias("n"))


@query(f"{_OUTCOMES} select count(*)::bigint as total, {', '.join(f"count(*) filter (outcome = '{x}')::bigint as {x}" for x in _TALLIED)}, round(count(*) filter (starts_with(outcome, 'resolved')) / count(*), 9) as resolved_rate, true as balances from o")
def call_tally_balances(spark, d):
    return resolve.call_tally(resolve.call_outcomes(*_calls(spark, d))).withColumn("resolved_rate", F.round("resolved_rate", 9))


# --- entity resolution -----------------------------------------------------


def _labels(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.concat(F.lit("part:"), F.col("p_partkey")).alias("id"), F.col("p_name").alias("label"), F.lit("concept").alias("kind"), F.lit("").alias("source_file"))
    return p.withColumn("loc", F.expr("cast(null as struct<start_line: int, start_column: int, end_line: int, end_column: int>)")).withColumn("properties", F.expr("cast(map() as map<string,string>)"))


@query(f"select min(p_partkey)::bigint as first, count(*)::bigint as n from part group by {_KEY.format('p_name')}, p_brand")
def exact_dedup_groups(spark, d):
    p = dedup._prepared(_labels(spark, d).drop("source_file").join(table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("source_file")), "ord"))
    pairs = dedup.exact_pairs(p)
    return traverse.components(p, pairs).groupBy(F.col("root").alias("first")).agg(F.count("*").alias("n"))


@query()
def fuzzy_pairs(spark, d):
    return dedup.fuzzy_pairs(dedup._prepared(_labels(spark, d)))


@query()
def entity_resolution(spark, d):
    n, e = _labels(spark, d), table(spark, d, "lineitem").select(F.concat(F.lit("part:"), F.col("l_partkey")).alias("source"), F.concat(F.lit("supplier:"), F.col("l_suppkey")).alias("target"), F.lit("SUPPLIED_BY").alias("relation"), F.col("l_orderkey").alias("ord"))
    nodes, edges = dedup.deduplicate(n, e)
    return edges.join(nodes.select(F.col("id").alias("source"), "label"), "source").groupBy("label").agg(F.count("*").alias("edges"))


# --- operation statistics --------------------------------------------------


def _ops(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("op"), F.col("value").alias("ms"), F.col("event_id").alias("seq"), F.col("user_id"), F.col("ts"))


_B = "case " + " ".join(f"when value < {b} then {k}" for k, b in enumerate(fn.BUCKETS)) + f" else {len(fn.BUCKETS)} end"


@query(f"select event_type as op, {_B}::int as bucket, count(*)::bigint as n from events group by 1, 2")
def op_histogram(spark, d):
    return stats.histogram(_ops(spark, d))


def _percentile(p):
    """SQL: the percentile of each op's histogram h (op, b, n)."""
    low, high = (f"list_extract([0.0, {', '.join(map(str, fn.BUCKETS))}, 1024], b::int + {k})" for k in (1, 2))
    value = f"case when b >= {len(fn.BUCKETS)} then {float(fn.BUCKETS[-1])} else {low} + ({high} - {low}) * greatest(0, least(1, (t - (cum - n)) / n)) end"
    return f"select op, arg_min({value}, b)::double as value from (select *, sum(n) over (partition by op order by b) as cum, {p} * sum(n) over (partition by op) as t from h) where cum >= t group by op"


@query(f"with h as (select event_type as op, {_B} as b, count(*) as n from events group by 1, 2) select op, round(value, 6) as value from ({_percentile(0.9)})")
def histogram_percentile(spark, d):
    return stats.histogram_percentile(stats.histogram(_ops(spark, d)), 0.9).select("op", F.round("value", 6).alias("value"))


@query("select event_type as op, round(quantile_cont(value, 0.5), 9) as value from (select *, row_number() over (partition by event_type order by event_id desc) as r from events) where r <= 256 group by 1")
def recent_window_p50(spark, d):
    return stats.recent_percentile(_ops(spark, d), 0.5).select("op", F.round("value", 9).alias("value"))


@query("select event_type as op, count(*)::bigint as n, round(sum(value), 4) as total_ms, round(avg(value), 6) as mean_ms from events group by 1")
def op_lifetime(spark, d):
    return stats.lifetime(_ops(spark, d)).select("op", "n", F.round("total_ms", 4).alias("total_ms"), F.round("mean_ms", 6).alias("mean_ms"))


@query("select count(*) filter (event_type = 'click')::bigint as click, count(*) filter (event_type = 'view')::bigint as view, count(*) filter (event_type = 'error')::bigint as error from events")
def route_counts(spark, d):
    return stats.route_counts(_ops(spark, d), "op", ["click", "view", "error"])


@query("select count(*) filter (user_id % 7 = 0) / count(*) as rate from events")
def zero_hit_rate(spark, d):
    return stats.zero_hit_rate(_ops(spark, d).withColumn("hits", F.col("user_id") % 7), "hits")


@query(f"""with e as (select *, strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%SZ') as shutdown from events), h as (select event_type as op, {_B} as b, count(*) as n from e where shutdown >= '2024-01-05' group by 1, 2),
p50 as ({_percentile(0.5)}), p90 as ({_percentile(0.9)})
select e.event_type as op, count(*)::bigint as n, round(sum(value), 4) as total_ms, round(avg(value), 6) as mean_ms, (select round(value, 6) from p50 where op = e.event_type) as p50, (select round(value, 6) from p90 where op = e.event_type) as p90, false as mixed from e where shutdown >= '2024-01-05' group by 1""")
def ledger_rollup(spark, d):
    ops = _ops(spark, d).withColumn("shutdown", F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).withColumn("bucket", fn.latency_bucket(F.col("ms")))
    lines = ops.groupBy("shutdown", "op").agg(F.count("*").alias("count"), F.sum("ms").alias("total_ms"), F.array(*[F.count_if(F.col("bucket") == k) for k in range(stats.N_BUCKETS)]).alias("hist_ms"))
    ledger = lines.groupBy("shutdown").agg(F.map_from_entries(F.collect_list(F.struct("op", F.struct("count", "total_ms", "hist_ms")))).alias("ops")).withColumn("schema_version", F.lit(1))
    out = stats.rollup(ledger, "2024-01-05")
    return out.select("op", "n", "mixed", F.round("total_ms", 4).alias("total_ms"), *[F.round(c, 6).alias(c) for c in ("mean_ms", "p50", "p90")])


@query(f"{G} select (select count(*) from nodes)::bigint as nodes, 0::bigint as files, 0::bigint as memory_nodes, 0::bigint as semantic_nodes, (select count(distinct kind) from nodes)::bigint as kinds, (select count(*) from edges)::bigint as edges, (select count(distinct relation) from edges)::bigint as relations")
def status(spark, d):
    return stats.status(*graph(spark, d))


@query("select user_id, session::bigint as session, count(*)::bigint as n, min(ts) as first, max(ts) as last from (select *, sum(new) over (partition by user_id order by ts, event_id) as session from (select *, (lag(ts) over (partition by user_id order by ts, event_id) is null or ts - lag(ts) over (partition by user_id order by ts, event_id) > interval 1 hour)::int as new from events)) group by 1, 2")
def debounce_sessions(spark, d):
    from .streaming.debounce import sessions

    return sessions(table(spark, d, "events"), "user_id", "ts", "interval 1 hour", "event_id").select("user_id", "session", "n", "first", "last")
