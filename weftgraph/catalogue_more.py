"""More registered queries: sources, documents, packing, contracts, notes and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalogue import G, graph, ids, query, table, with_centrality
from .functions import scalar as fn
from .operators.base import settle
from .operators import context, extract, memory, resolve, seam, semantic
from .plans import projection
from .sources import exports, files

# --- files -----------------------------------------------------------------

#: Made-up paths from the pages' ids: every extension and directory comes up.
_EXT = [e for es in files.EXTENSIONS.values() for e in es] + files.DOCUMENTS + files.MEDIA + [".zip", ""]
_DIR = ["src", "lib/node_modules/x", "app/.claude", ".tool/worktrees/a", "worktrees", "pkg/vendor", "docs"]
_PATH = "list_extract({d}, (page_id % {nd} + 1)::int) || '/f' || page_id || list_extract({e}, (page_id % {ne} + 1)::int)".format(d=_DIR, nd=len(_DIR), e=_EXT, ne=len(_EXT))


def _paths(spark, d):
    p = table(spark, d, "pages")
    pick = lambda xs: F.element_at(fn.lit_array(xs), (F.col("page_id") % len(xs) + 1).cast("int"))
    return p.select("page_id", F.concat(pick(_DIR), F.lit("/f"), "page_id", pick(_EXT)).alias("path"))


_LANG = "case " + " ".join(f"when ext in ({', '.join(repr(e) for e in es)}) then '{k}'" for k, es in files.EXTENSIONS.items()) + " end"


@query(f"with p as (select page_id, {_PATH} as path from pages), x as (select *, regexp_extract(path, '[^/](\\.[^./]*)$', 1) as ext from p) select path, {_LANG} as language, case when {_LANG} is not null then 'code' when ext in ({', '.join(map(repr, files.DOCUMENTS))}) then 'document' when ext in ({', '.join(map(repr, files.MEDIA))}) then 'media' end as kind from x")
def language_detect(spark, d):
    p = F.col("path")
    return _paths(spark, d).select("path", files.language(p).alias("language"), files.kind_of_file(p).alias("kind"))


@query(f"with p as (select page_id, {_PATH} as path from pages) select path from p where not regexp_matches(path, '(^|/)({'|'.join(s.replace('.', chr(92) + '.') for s in files.SKIPPED)})/') and not regexp_matches(path, '(^|/)\\.[^/]*/worktrees/') and not starts_with(path, 'docs/') and not regexp_matches(path, '/f7\\.[ch]$')")
def ignore_filter(spark, d):
    rules = files.read_gitignore("# notes\n!keep\n/docs/\nsrc/f7\nf7.c\nf7.h\n")
    kept = files.without_dependencies(_paths(spark, d).select("path"))
    return kept.filter(~files.ignored(F.col("path"), rules))


@query("select path, case when old is null then 'New' when now is null then 'Deleted' when now = old then 'HashHit' else 'Stale' end as change from (select coalesce(a.path, b.path) as path, a.h as now, b.h as old from (select 'd/' || doc_id as path, sha256(text) as h from documents where doc_id % 10 <> 3) a full join (select 'd/' || doc_id as path, sha256(text || case when doc_id % 10 = 4 then 'x' else '' end) as h from documents where doc_id % 10 <> 5) b on a.path = b.path)")
def file_changes(spark, d):
    docs = table(spark, d, "documents")
    side = lambda text: docs.select("doc_id", F.concat(F.lit("d/"), "doc_id").alias("path"), F.octet_length("text").cast("long").alias("size"), F.lit(0).cast("long").alias("mtime"), F.sha2(text, 256).alias("sha256"))
    now = side(F.col("text")).filter("doc_id % 10 <> 3")
    old = side(F.concat("text", F.when(F.col("doc_id") % 10 == 4, "x").otherwise(""))).filter("doc_id % 10 <> 5")
    return files.classify_changes(now, old)


@query("""with recursive leaf as (select row_number() over (order by 'd/' || doc_id) - 1 as k, sha256('\\x00'::blob || unhex(lpad(printf('%x', strlen('d/' || doc_id)), 8, '0')) || encode('d/' || doc_id) || unhex(sha256(text))) as h, count(*) over () as n from documents),
t as (select k, h, n from leaf union all select k // 2, case when count(*) = 1 then max(h) else sha256('\\x01'::blob || unhex(max(h) filter (k % 2 = 0)) || unhex(max(h) filter (k % 2 = 1))) end, (n + 1) // 2 from t where n > 1 group by k // 2, n)
select 'sha256-merkle-v1' as algorithm, h as sha256, (select count(*) from documents)::bigint as leaf_count from t where n = 1""")
def content_root(spark, d):
    docs = table(spark, d, "documents")
    return files.content_root(docs.select(F.concat(F.lit("d/"), "doc_id").alias("path"), F.sha2("text", 256).alias("sha256")))


_LINES = "with l as (select doc_id, list_slice(string_split(text, chr(10)), 2, 4) as l from documents), k as (select *, len(list_filter(range(1, len(l) + 1), lambda i: list_sum(list_transform(l[1:i], lambda x: length(x) + 1)) <= 2000)) as k from l)"


@query(f"{_LINES} select doc_id::varchar as key, case when len(l) > 0 then array_to_string(l[1:k], chr(10)) end as snippet, case when len(l) > 0 then k < len(l) end as truncated from k")
def snippet_slice(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    wanted = docs.select(F.col("path").alias("key"), "path", F.lit(2).alias("start_line"), F.lit(4).alias("end_line"))
    return context.snippets(wanted, docs).select("key", "snippet", "truncated")


# --- extraction ------------------------------------------------------------


@query()
def extract_synthetic_python(spark, d):
    tree = files.synthetic_tree(spark, 50).select("path", F.lit("python").alias("language"), F.col("content").alias("text"))
    n, _, _, _ = extract.flatten(extract.extract(tree))
    return n.groupBy("kind").agg(F.count("*").alias("n"))


@query("""with p as (select 'db/' || p_partkey || '.sql' as path, p_partkey || '.sql' as file, lower(replace(p_name, ' ', '_')) as t, p_name as q, p_partkey as k from part)
select path, file as label, 'sql_file' as kind, 0 as start_line from p union all select path, t, 'sql_table', 1 from p union all select path, q, 'sql_enum', 2 from p union all select path, 'new_' || k, 'sql_table', 4 from p""")
def extract_sql(spark, d):
    return extract.sql_entities(_scripts(spark, d))[0].select("path", "label", "kind", F.coalesce("start_line", F.lit(0)).alias("start_line"))


def _scripts(spark, d):
    name = F.upper(F.replace("p_name", F.lit(" "), F.lit("_")))
    text = F.concat(F.lit("CREATE TABLE IF NOT EXISTS public . "), name, F.lit(' (id int);\ncreate type app."'), "p_name", F.lit("\" as enum ('a');\n\nALTER TABLE "), name, F.lit(" rename to public.New_"), "p_partkey", F.lit(";\nalter table New_"), "p_partkey", F.lit(" ADD CONSTRAINT k FOREIGN KEY (id) REFERENCES \"public\" .\""), "p_brand", F.lit('" (id);'))
    return table(spark, d, "part").select(F.concat(F.lit("db/"), "p_partkey", F.lit(".sql")).alias("path"), F.lit("sql").alias("language"), text.alias("text"))


_ID = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '_', 'g'), '_')"


@query(f"select 'db/' || p_partkey || '.sql' as path, 'sql_table_new_' || p_partkey as source, {_ID.format("'sql_table_' || p_brand")} as target, 'references' as relation from part")
def extract_sql_references(spark, d):
    return extract.sql_entities(_scripts(spark, d))[1].select("path", "source", "target", "relation")


@query("select 'p' || p_partkey || '.csproj' as path, p_name as label, 'package_reference' as kind, 2::int as start_line from part")
def extract_msbuild(spark, d):
    p = table(spark, d, "part")
    f = p.select(F.concat(F.lit("p"), "p_partkey", F.lit(".csproj")).alias("path"), F.lit("msbuild").alias("language"), F.concat(F.lit("<X>\n<PackageReference Include=\""), "p_name", F.lit("\" />")).alias("text"))
    return extract.pattern_nodes(f).select("path", "label", "kind", "start_line")


# --- documents and code ----------------------------------------------------


@query("with sym as (select 'NATION_' || n_nationkey as name, 'nation:' || n_nationkey as id from nation), docs as (select o_orderkey as doc_id, 'see NATION_' || (o_custkey % 30) || ', nation_x and NATION_' || (o_orderkey % 30) as text from orders), tok as (select distinct doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) as name from docs) select doc_id as doc, name, id, rank::int as rank from (select doc_id, name, row_number() over (partition by doc_id order by length(name) desc, name) as rank from tok where name in (select name from sym)) join sym using (name)")
def doc_links(spark, d):
    n = projection.nodes(spark, d).filter("kind = 'nation'")
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("see NATION_"), F.col("o_custkey") % 30, F.lit(", nation_x and NATION_"), F.col("o_orderkey") % 30).alias("text"))
    return semantic.doc_links(docs, semantic.symbol_index(n))


@query("with recursive f as (select source as grp, doc_id, row_number() over (partition by source order by lpad(doc_id::varchar, 9, '0')) as r, n_chars as size from documents), go(grp, r, chunk, n, bytes) as (select grp, r, 0, 1, size from f where r = 1 union all select f.grp, f.r, case when go.n >= 8 or go.bytes + f.size > 1048576 then chunk + 1 else chunk end, case when go.n >= 8 or go.bytes + f.size > 1048576 then 1 else go.n + 1 end, case when go.n >= 8 or go.bytes + f.size > 1048576 then f.size else go.bytes + f.size end from go join f on f.grp = go.grp and f.r = go.r + 1) select grp, lpad(doc_id::varchar, 9, '0') as path, chunk::int as chunk from go join f using (grp, r)")
def chunk_plan(spark, d):
    docs = table(spark, d, "documents").select("source", F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"), F.col("n_chars").alias("size"))
    return semantic.plan_chunks(docs, "source")


@query("select event_id, case when event_id % 3 = 0 then 0 when event_id % 3 = 1 then 1 else 2 end::int as n_errors from events")
def fragment_validation(spark, d):
    e = table(spark, d, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"nodes": [{"id": "a", "label": "b", "props": '), "props", F.lit('}], "edges": []}'))).when(F.col("event_id") % 3 == 1, "{torn").otherwise('{"nodes": [{"id": "a"}]}')
    f = e.select(F.col("event_id").cast("string").alias("path"), text.alias("text"))
    return semantic.validate_fragments(f).select(F.col("path").cast("long").alias("event_id"), F.size("errors").alias("n_errors"))


@query("with r as (select doc_id, source as fragment, sha256(text) as now, case when doc_id % 97 = 0 then 'old' else sha256(text) end as was from documents) select 'd/' || doc_id as source, fragment, min(now = was) over (partition by fragment) as valid from r")
def cache_reconcile(spark, d):
    docs = table(spark, d, "documents")
    path, h = F.concat(F.lit("d/"), "doc_id"), F.sha2("text", 256)
    records = docs.select(path.alias("source"), F.when(F.col("doc_id") % 97 == 0, "old").otherwise(h).alias("sha256"), F.col("source").alias("fragment"), F.lit("n").alias("node_id"))
    return semantic.cache_states(records, docs.select(path.alias("path"), h.alias("sha256")), ids(spark, "n"))


# --- context ---------------------------------------------------------------


def _packed(spark, d, packer):
    n, e = graph(spark, d)
    n = settle(with_centrality(n, e))
    q = spark.createDataFrame([(1, "nation:3"), (2, "small ring"), (3, "customer:7")], "qid int, query string")
    near = context.gather(n, e, q, context.focal(n, q))
    return context.pack(n, near, 600, packer)


_FOCUS = ["nation:3", "small ring", "customer:7", "ATION_", "RING", "zz", "order:1", "#000", "supplier 000000003"]


@query(f"""{G}, q(query) as (values {', '.join(f"('{x}')" for x in _FOCUS)}), n as (select n.*, centrality, lower(regexp_extract(label, '^[^( \\t\\n]*')) as sym from nodes n join cent using (id)),
m as (select query, id, 1 as tier, 0 as c, '' as l, ord from q join n on query = id union all select query, id, 2, 0, '', ord from q join n on query = label union all select query, id, 3, -centrality, label, ord from q join n on lower(query) = sym or lower(query) = lower(label)
    union all select query, id, 4, -centrality, '', ord from q join n on contains(lower(label), lower(query)) or contains(id, lower(query)))
select query, id from (select *, row_number() over (partition by query order by tier, c, l, ord) as r from m) where r = 1""")
def focal(spark, d):
    n, e = graph(spark, d)
    q = spark.createDataFrame([(x, x) for x in _FOCUS], "qid string, query string")
    found = context.focal(settle(with_centrality(n, e)), q)
    # what only words lead to has three seeds and is tested with idf_search
    return found.join(found.groupBy("qid").count().filter("count = 1"), "qid").select(F.col("qid").alias("query"), "id")


@query()
def context_greedy(spark, d):
    return _packed(spark, d, "greedy")


@query()
def context_knapsack(spark, d):
    return _packed(spark, d, "knapsack")


# --- contracts -------------------------------------------------------------

SPEC = {
    "provider": "tariffs", "api_version": "2031", "error_codes": [409, 422],
    "services": [{"name": "tariffs", "role": "provider", "owned": True}, {"name": "depot", "role": "consumer", "owned": False}],
    "schemas": [{"name": "Quote", "canonical": "tariffs/model/quote.kt"}],
    "endpoints": [{"method": "GET", "path": "/quotes/{parcel}", "response_schema": "Quote", "path_params": ["parcel"]}],
    "consumes": [{"service": "depot", "method": "GET", "path": "/quotes/{parcel}", "call_site": {"graph": "depot", "file": "lib/prices.kt", "line": 17}}],
    "mirrors": [{"schema": "Quote", "graph": "depot", "file": "lib/shapes.kt", "line": 5}],
}
_CODE = "ord long, id string, label string, kind string, source_file string, loc struct<start_line: int, start_column: int, end_line: int, end_column: int>"


def depot(spark):
    rows = [
        (0, "depot::prices", "prices", "file", "depot/lib/prices.kt", (1, 0, 60, 0)), (1, "depot::Prices", "Prices", "class", "depot/lib/prices.kt", (3, 0, 60, 0)),
        (2, "depot::quoteFor", "quoteFor", "function", "depot/lib/prices.kt", (14, 0, 21, 0)), (3, "depot::Quote", "Quote", "class", "depot/lib/shapes.kt", (4, 0, 9, 0)),
    ]
    return spark.createDataFrame(rows, _CODE)


def _duties(spark, d):
    """A contract made of the tables: each region is a service that asks for the duties of its nations."""
    regions = table(spark, d, "region").orderBy("r_regionkey").collect()  # a handful at any scale
    nations = table(spark, d, "nation").orderBy("n_nationkey").collect()
    name = {r.r_regionkey: r.r_name.lower().replace(" ", "_") for r in regions}
    of = lambda n: name[n.n_regionkey]
    spec = {
        "provider": "customs", "api_version": "7", "services": [{"name": "customs", "role": "provider"}, *({"name": r, "role": "consumer", "owned": True} for r in name.values())],
        "schemas": [{"name": f"duty_{r}", "canonical": f"customs/{r}.kt"} for r in name.values()],
        "endpoints": [{"method": "GET", "path": f"/duty/{n.n_nationkey}", "response_schema": f"duty_{of(n)}"} for n in nations],
        "consumes": [{"service": of(n), "method": "GET", "path": f"/duty/{n.n_nationkey}", "call_site": {"graph": of(n), "file": "src/duties.kt", "line": 10 * n.n_nationkey + 4}} for n in nations],
        "mirrors": [{"schema": f"duty_{r}", "graph": r, "file": "src/shape.kt", "line": 2} for r in name.values()],
    }
    graphs = {}
    for r in name.values():
        rows = [(n.n_nationkey + 2, f"{r}::ask{n.n_nationkey}", f"ask{n.n_nationkey}", "function", f"{r}/src/duties.kt", (10 * n.n_nationkey + 1, 0, 10 * n.n_nationkey + 8, 0)) for n in nations if of(n) == r]
        graphs[r] = spark.createDataFrame([(0, f"{r}::Duties", "Duties", "class", f"{r}/src/duties.kt", (1, 0, 9_999, 0)), (1, f"{r}::Shape", "Shape", "class", f"{r}/src/shape.kt", (1, 0, 9, 0)), *rows], _CODE)
    return spec, graphs


@query("""with n as (select n_nationkey as k, replace(lower(r_name), ' ', '_') as r from nation join region on n_regionkey = r_regionkey), r as (select replace(lower(r_name), ' ', '_') as r from region)
select 'endpoint:customs:GET /duty/' || k as source, 'service:customs' as target, 'SERVED_BY' as relation from n union all select 'endpoint:customs:GET /duty/' || k, 'schema:customs:7:duty_' || r, 'RESPONDS_WITH' from n
union all select 'service:' || r, 'endpoint:customs:GET /duty/' || k, 'CONSUMES' from n union all select 'endpoint:customs:GET /duty/' || k, r || '::ask' || k, 'CONSUMED_AT' from n union all select 'schema:customs:7:duty_' || r, r || '::Shape', 'MIRRORED_BY' from r""")
def seam_edges(spark, d):
    spec, graphs = _duties(spark, d)
    n, e = seam.generate(spark, spec, graphs)
    _, e = seam.fuse((n, e), [(g.withColumn("properties", F.expr("cast(map() as map<string,string>)")), e.limit(0)) for g in graphs.values()])
    return e.select("source", "target", "relation")


# --- notes -----------------------------------------------------------------


@query("select id, created_at, count(*) over ()::bigint as total from (select conv_id || ':' || turn as id, (conv_id * 100 + turn)::varchar as created_at, conv_id * 100 + turn as n from conversations where contains(lower(text), 'the')) qualify row_number() over (order by n desc, id desc) <= 10")
def notes_recall(spark, d):
    c = table(spark, d, "conversations")
    id_ = F.concat_ws(":", "conv_id", "turn")
    notes = c.select(id_.alias("id"), F.lit("").alias("title"), F.lit("").alias("tags"), F.col("text").alias("body"), (F.col("conv_id") * 100 + F.col("turn")).cast("string").alias("created_at"))
    touches = c.select(id_.alias("source"), F.col("role").alias("target"))
    hit = memory.recall(notes, touches, ids(spark, "user").withColumn("label", F.lit("User")), "THE")
    all_ = c.filter(F.contains(F.lower("text"), F.lit("the"))).agg(F.count("*")).scalar()
    return hit.select("id", "created_at", all_.alias("total"))


# --- sinks -----------------------------------------------------------------


@query(f"{G}, s as (select row_number() over (order by ord) - 1 as k, count(*) over () as n, ord from nodes) select ord, round(240 + 120 * cos(2 * pi() * k / n), 6) as x, round(180 + 120 * sin(2 * pi() * k / n), 6) as y from s")
def svg_positions(spark, d):
    n = projection.nodes(spark, d)
    return exports.svg_rows(n).select("ord", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"{G} select 'MERGE (n:Node {{id: ''' || id || '''}}) SET n.label = ''' || label || ''', n.kind = ''' || kind || ''';' as statement from nodes union all select 'MATCH (a:Node {{id: ''' || source || '''}}), (b:Node {{id: ''' || target || '''}}) MERGE (a)-[:REL {{relation: ''' || relation || '''}}]->(b);' from edges")
def cypher_statements(spark, d):
    n, e = graph(spark, d)
    return exports.cypher_statements(n, e.withColumn("ord", F.lit(0).cast("long"))).select("statement")


@query(f"{G} select '## ' || label || chr(10) || '- kind: ' || kind || chr(10) || '- source: ' || source_file || chr(10) || '- links: ' || coalesce((select string_agg('[[' || t.label || ']]', ', ' order by t.ord) from edges e join nodes t on t.id = e.target where e.source = n.id), 'none') || chr(10) as block from nodes n")
def markdown_blocks(spark, d):
    n, e = graph(spark, d)
    e = e.join(n.select(F.col("id").alias("target"), "ord"), "target")
    return exports.markdown_blocks(n, e).select("block")


@query("select c_custkey as id, lower(c_mktsegment) as key, count(*) over (partition by c_mktsegment)::bigint as n from customer")
def symbol_keys(spark, d):
    c = table(spark, d, "customer").withColumn("label", F.col("c_mktsegment"))
    keyed = resolve._keyed(c, "label", "key")
    counts = keyed.groupBy("key").agg(F.count("*").alias("n"))
    return keyed.join(counts, "key").select(F.col("c_custkey").alias("id"), "key", "n")
