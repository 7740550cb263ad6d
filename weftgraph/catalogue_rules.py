"""More registered queries: keys, guards, costs, forms of text, resolution in its steps, layers and changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalogue import G, graph, query, table
from .functions import scalar as fn
from .operators import analyze, resolve, semantic
from .operators.base import settle
from .sources import files
from .streaming import debounce, incremental

_NO_PROPERTIES = "cast(map() as map<string,string>)"
_ID = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '_', 'g'), '_')"


def _cat(*parts):
    """Texts and columns, put together."""
    return F.concat(*[F.lit(p[1:]) if p.startswith("'") else F.col(p) for p in parts])


# --- keys, guards and measures ---------------------------------------------


@query(f"select p_partkey, case when p_partkey % 2 = 0 then 'part ' || p_partkey else {_ID.format("p_type || '.sql:' || p_brand || ':' || p_name")} end as key from part")
def node_keys(spark, d):
    given = F.when(F.col("p_partkey") % 2 == 0, _cat("'part ", "p_partkey")).otherwise("")
    return table(spark, d, "part").select("p_partkey", fn.node_key(given, _cat("p_type", "'.sql"), F.col("p_brand"), F.col("p_name")).alias("key"))


@query("select doc_id, doc_id % 4 <> 1 and doc_id % 5 <> 2 as valid from documents where text is not null")
def content_root_valid(spark, d):
    h = F.sha2("text", 256)
    sha = F.when(F.col("doc_id") % 5 == 2, F.concat(F.substring(h, 1, 63), F.lit("g"))).when(F.col("doc_id") % 5 == 3, F.upper(h)).otherwise(h)
    algorithm = F.when(F.col("doc_id") % 4 == 1, "sha256").otherwise("sha256-merkle-v1")
    return table(spark, d, "documents").filter("text is not null").select("doc_id", fn.is_valid_content_root(algorithm, sha).alias("valid"))


@query("select p_partkey, length(p_name) >= 3 and coalesce((select sum(-c / length(p_name) * log2(c / length(p_name))) from (select count(*) as c from (select unnest(string_split(p_name, '')) as ch) group by ch)), 0) >= 3.0000001 as enough from part")
def entropy_gate(spark, d):
    return table(spark, d, "part").select("p_partkey", fn.has_meaningful_entropy(F.col("p_name"), 3.0000001).alias("enough"))


@query("with t as (select p_partkey, list_distinct(list_filter(string_split(lower(p_name || ' of ' || p_size), ' '), lambda x: length(x) >= 3)) as q, list_distinct(list_filter(string_split(lower(reverse(p_name) || ' ' || p_name || ' ' || p_type), ' '), lambda x: length(x) >= 3)) as l from part) select p_partkey, round(coalesce(len(list_intersect(q, l)) / nullif(len(q), 0), 0), 9) as overlap from t")
def term_overlap(spark, d):
    asked = fn.lexical_terms(F.concat_ws(" ", "p_name", F.lit("of"), "p_size"))
    label = fn.lexical_terms(F.concat_ws(" ", F.reverse("p_name"), "p_name", "p_type"))
    return table(spark, d, "part").select("p_partkey", F.round(fn.query_term_overlap(asked, label), 9).alias("overlap"))


#: A name, and one that differs in a letter, is longer, is the same or is another.
_NEAR_SQL = "case p_partkey % 4 when 0 then 'x' || p_name[2:] when 1 then p_name || 's' when 2 then p_name else reverse(p_name) end"


@query(f"""with p as (select p_partkey, p_name as a, {_NEAR_SQL} as b, 0.9 + p_size / 500.0 as jw from part),
s as (select *, length(a) = length(b) and len(list_filter(range(1, length(a) + 1), lambda i: a[i] <> b[i])) = 1 as one from p)
select p_partkey, one, a <> b and (starts_with(a, b) or starts_with(b, a) or greatest(length(a), length(b)) < 12 and not (jw >= 0.97 and one)) as blocked from s""")
def merge_blockers(spark, d):
    k, a = F.col("p_partkey") % 4, F.col("p_name")
    b = F.when(k == 0, F.concat(F.lit("x"), F.substring(a, 2, 1000))).when(k == 1, F.concat(a, F.lit("s"))).when(k == 2, a).otherwise(F.reverse(a))
    jw = F.lit(0.9) + F.col("p_size") / 500.0
    return table(spark, d, "part").select("p_partkey", fn.single_char_substitution(a, b).alias("one"), fn.fuzzy_merge_blocked(a, b, jw).alias("blocked"))


@query("""with l as (select l_orderkey, l_linenumber, l_partkey::varchar as label, case when l_suppkey % 5 > 0 then l_linenumber end as a, l_linenumber + l_quantity::int as b, l_suppkey % 90 as c from lineitem)
select l_orderkey, l_linenumber, label, case when a is null then greatest(1, (length(label) + 3) // 4) else greatest(1, (least(2000, greatest(length(label), (least(greatest(b - a + 1, 1), 40) - 1) * 40 + case when b - a + 1 <= 40 then c else 40 end)) + 3) // 4) end::bigint as cost from l""")
def slice_costs(spark, d):
    begin = F.when(F.col("l_suppkey") % 5 > 0, F.col("l_linenumber"))
    end = F.col("l_linenumber") + F.col("l_quantity").cast("int")
    label = F.col("l_partkey").cast("string")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", label.alias("label"), fn.slice_token_cost(label, begin, end, F.col("l_suppkey") % 90).alias("cost"))


@query("""with s as (select user_id, count(*) filter (event_type = 'view') as hits, count(*) filter (event_type = 'click') as extracted, sum(value) filter (event_type = 'click') as ms, count(*) filter (event_type = 'error') as errors from events group by 1)
select user_id, round(hits / nullif(hits + extracted, 0), 9) as hit_rate, case when hits > 0 and extracted > 0 then round(hits * ms / extracted, 4) end as saved_ms, round(errors / nullif(extracted, 0), 9) as error_rate from s""")
def guarded_ratios(spark, d):
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    s = table(spark, d, "events").groupBy("user_id").agg(n("view").alias("hits"), n("click").alias("extracted"), F.sum(F.when(F.col("event_type") == "click", F.col("value"))).alias("ms"), n("error").alias("errors"))
    hits, extracted = F.col("hits"), F.col("extracted")
    return s.select("user_id", F.round(fn.ratio(hits, hits + extracted), 9).alias("hit_rate"), F.round(fn.modeled_cache_saved_ms(hits, extracted, F.col("ms")), 4).alias("saved_ms"), F.round(fn.ratio(F.col("errors"), extracted), 9).alias("error_rate"))


@query("""select event_id, case when ms < 1000 then round(ms)::bigint || ' ms' when ms < 60000 then printf('%.1f s', ms / 1000) else round(ms / 1000 / 60)::bigint || case when round(ms / 1000 / 60) = 1 then ' minute' else ' minutes' end end as took,
strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as stamp, date_trunc('second', ts) as parsed, case when event_id % 2 = 0 then date_trunc('second', ts) end as maybe from (select *, value * (event_id % 30) * 40 as ms from events)""")
def durations_and_stamps(spark, d):
    stamp = fn.iso8601(F.col("ts"))
    maybe = fn.parse_iso8601(F.when(F.col("event_id") % 2 == 0, stamp).otherwise(F.concat(stamp, F.lit("!"))))
    return table(spark, d, "events").select("event_id", fn.human_duration(F.col("value") * (F.col("event_id") % 30) * 40).alias("took"), stamp.alias("stamp"), fn.parse_iso8601(stamp).alias("parsed"), maybe.alias("maybe"))


@query("""with p as (select page_id, case page_id % 3 when 0 then 'f' || page_id || '.test.ts' when 1 then '.env' || page_id else 'Makefile' end as name, case when page_id % 4 = 0 then '' else 'a/b' || (page_id % 4) end as parent from pages)
select page_id, name, parent, case when page_id % 3 = 0 then 'f' || page_id || '.test' else name end as stem, case when parent = '' then name else parent || '/' || name || ',' || parent[3:] || '/' || name || ',' || name end as ends,
'z/' || case when parent = '' then '' else parent || '/' end || name as tidy from p""")
def path_parts(spark, d):
    k = F.col("page_id")
    name = F.when(k % 3 == 0, _cat("'f", "page_id", "'.test.ts")).when(k % 3 == 1, _cat("'.env", "page_id")).otherwise("Makefile")
    path = F.when(k % 4 == 0, name).otherwise(F.concat(F.lit("a/b"), k % 4, F.lit("/"), name))
    rough = F.concat(F.lit("y/../z//./"), path)
    return table(spark, d, "pages").select("page_id", fn.file_name(path).alias("name"), fn.parent_of(path).alias("parent"), fn.stem_of(path).alias("stem"), F.array_join(fn.path_suffixes(path), ",").alias("ends"), fn.normal_path(rough).alias("tidy"))


@query("select o_custkey, string_agg(o_orderkey || 'n', ',' order by o_orderkey) as keys from orders group by o_custkey")
def csv_lists(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(fn.join_csv(F.sort_array(F.collect_list("o_orderkey")), "n").alias("keys"))


_PREFIXES = ["memory:", "doc:", "concept:", "media:", "topic:", "fn:", "docs:"]


@query(f"select id, id like 'memory:%' as memory, regexp_matches(id, '^(doc|concept|media|topic):') as enrichment from (select list_extract({_PREFIXES}, (page_id % {len(_PREFIXES)} + 1)::int) || page_id as id from pages)")
def id_guards(spark, d):
    ids = table(spark, d, "pages").select(F.concat(F.element_at(fn.lit_array(_PREFIXES), (F.col("page_id") % len(_PREFIXES) + 1).cast("int")), "page_id").alias("id"))
    return ids.select("id", analyze.is_memory(F.col("id")).alias("memory"), analyze.is_enrichment(F.col("id")).alias("enrichment"))


# --- resolution in its steps -----------------------------------------------

#: Files by page: one in ten is the index of a directory.  Every page imports another's file in one of five ways.
_FILE_SQL = "case when {k} % 10 = 0 then 'src/p' || {k} || '/index' else 'src/d' || ({k} % 7) || '/f' || {k} end"


@query(f"""with p as (select a.page_id as k, b.page_id as q from pages a join pages b on b.page_id = a.page_id * 7 % 50)
select 'file:' || k as source, case when k % 3 = 0 and q % 2 = 0 then {_ID.format(_FILE_SQL.format(k='q') + " || '.ts:Thing'")} else 'file:' || q end as target, 'imports' as relation from p
where k % 5 < 4 and not (k % 5 = 3 and q % 10 = 0) and (k <> q or k % 3 = 0 and q % 2 = 0)""")
def import_resolution(spark, d):
    k = F.col("k")
    bare = F.when(k % 10 == 0, _cat("'src/p", "k", "'/index")).otherwise(F.concat(F.lit("src/d"), k % 7, _cat("'/f", "k")))
    f = table(spark, d, "pages").select(F.col("page_id").alias("k")).withColumn("bare", bare).withColumn("path", _cat("bare", "'.ts"))
    none = F.expr(_NO_PROPERTIES).alias("properties")
    file_nodes = f.select(k.alias("ord"), _cat("'file:", "k").alias("id"), F.lit("file").alias("kind"), F.col("path").alias("source_file"), none)
    things = f.filter("k % 2 = 0").select(k.alias("ord"), fn.make_id(_cat("path", "':Thing")).alias("id"), F.lit("class").alias("kind"), F.col("path").alias("source_file"), none)
    to = f.select(k.alias("q"), F.col("bare").alias("tb"), F.col("path").alias("tp"))
    asks = f.select("k", (k * 7 % 50).alias("q")).join(to, "q")
    way = k % 5
    directory = F.when(F.col("q") % 10 == 0, _cat("'src/p", "q")).otherwise(F.col("tb"))
    spec = F.when(way == 0, F.col("tp")).when(way == 1, directory).when(way == 2, F.concat(F.lit("@/"), F.substring("tb", 5, 1000))).when(way == 3, _cat("'f", "q")).otherwise("nowhere/at/all")
    item = F.when(k % 3 == 0, "Thing").otherwise("")
    stubs = asks.select(k.alias("ord"), _cat("'stub:", "k").alias("id"), F.lit("import").alias("kind"), F.lit("").alias("source_file"), F.create_map(F.lit("import_path"), spec, F.lit("item"), item).alias("properties"))
    edges = asks.select(k.alias("ord"), _cat("'file:", "k").alias("source"), _cat("'stub:", "k").alias("target"), F.lit("imports").alias("relation"))
    aliases = spark.createDataFrame([("@/", "src/", 0), ("@/f", "elsewhere/", 1)], "prefix string, replacement string, ord int")
    nodes, edges = settle(file_nodes.unionByName(things).unionByName(stubs)), settle(edges)  # as the build does
    return resolve.resolve_imports(nodes, edges, aliases)[1].select("source", "target", "relation")


@query("""with recursive step as (select p_partkey as a, p_size % 3 as name, p_partkey // 2 as b from part), go(stub, name, place, seen, hop) as (select o_orderkey, o_orderkey % 3, o_custkey, [-1::bigint], 0 from orders
union all select stub, go.name, b, list_append(seen, place), hop + 1 from go join step on a = place and step.name = go.name where hop < 8 and not list_contains(seen, place) and b <> place)
select stub, 'f' || place as file from (select *, row_number() over (partition by stub order by hop desc) as r from go) where r = 1""")
def reexport_chains(spark, d):
    """Each part re-exports one of three names from the part of half its number."""
    exported = table(spark, d, "part").select(_cat("'f", "p_partkey").alias("file"), (F.col("p_size") % 3).cast("string").alias("name"), F.concat(F.lit("f"), F.floor(F.col("p_partkey") / 2)).alias("to"))
    bound = table(spark, d, "orders").select(F.col("o_orderkey").alias("stub"), (F.col("o_orderkey") % 3).cast("string").alias("name"), _cat("'f", "o_custkey").alias("file"))
    return resolve.chase_reexports(bound, exported)


@query("""with t as (select distinct 'contract:' || n_nationkey as contract, 'method:' || c_custkey as impl, 'type:' || c_custkey % 97 as type, 'trait:' || n_regionkey as trait from customer join nation on n_nationkey = c_nationkey where c_custkey % 4 > 0 and c_custkey % 5 = n_regionkey)
select contract as source, impl as target, 'dispatches_to' as relation, 'INFERRED' as confidence from t union select type, trait, 'implements', 'INFERRED' from t""")
def trait_dispatch(spark, d):
    return resolve.trait_dispatch(*_traits(spark, d))


@query("""with has as (select distinct c_custkey % 97 as t, c_nationkey as n from customer), fit as (select t, n_regionkey as r from has join nation on n_nationkey = n group by 1, 2 having count(*) = (select count(*) from nation m where m.n_regionkey = nation.n_regionkey))
select 'type:' || t as source, 'trait:' || r as target, 'implements' as relation, 'INFERRED' as confidence from fit
union all select 'contract:' || c_nationkey, 'method:' || c_custkey, 'dispatches_to', 'INFERRED' from customer join nation on n_nationkey = c_nationkey join fit on t = c_custkey % 97 and r = n_regionkey""")
def interface_dispatch(spark, d):
    return resolve.interface_dispatch(*_traits(spark, d))


def _traits(spark, d):
    """Regions promise a method for each nation; customers are methods of 97 types, named after their nation."""
    nation, customer = table(spark, d, "nation"), table(spark, d, "customer")
    promise = F.create_map(F.lit("interface_method"), F.lit("true"))
    contracts = nation.select(_cat("'contract:", "n_nationkey").alias("id"), F.col("n_name").alias("label"), _cat("'trait:", "n_regionkey").alias("owner"), promise.alias("properties"))
    kind = F.concat(F.lit("type:"), F.col("c_custkey") % 97)
    own = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(_cat("'method:", "c_custkey").alias("id"), F.upper("n_name").alias("label"), kind.alias("owner"), F.expr(_NO_PROPERTIES).alias("properties"), "c_custkey")
    edge = lambda df, a, b, relation: df.select(F.lit(0).cast("long").alias("ord"), F.col(a).alias("source"), F.col(b).alias("target"), F.lit(relation).alias("relation"))
    said = own.filter("c_custkey % 4 > 0").withColumn("trait", F.concat(F.lit("trait:"), F.col("c_custkey") % 5))
    edges = edge(contracts, "owner", "id", "method").unionByName(edge(own.filter("c_custkey % 2 = 0"), "owner", "id", "method")).unionByName(edge(own, "id", "owner", "method_of")).unionByName(edge(said, "id", "trait", "impl_trait"))
    return contracts.unionByName(own.drop("c_custkey")).drop("owner"), edges


@query("""with c as (select p_partkey as k, p_name || ' ' || p_partkey % 40 as label, p_size % 2 = 0 as promise from part), one as (select label, min('part:' || k) as target from c where promise group by 1 having count(*) = 1)
select distinct 'part:' || k * 3 % 50 as source, target, 'CALLS' as relation, 'INFERRED' as confidence from c join one using (label) where k % 3 > 0 and target <> 'part:' || k * 3 % 50""")
def contract_rescue(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").withColumn("label", F.concat("p_name", F.lit(" "), k % 40))
    marked = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("interface_method"), F.lit("true"))).otherwise(F.expr(_NO_PROPERTIES))
    nodes = p.select(_cat("'part:", "p_partkey").alias("id"), "label", marked.alias("properties"))
    calls = p.select(F.concat(F.lit("part:"), k * 3 % 50).alias("caller_id"), F.col("label").alias("callee_label"), F.when(k % 3 > 0, "dropped_unknown").otherwise("resolved_same_file").alias("outcome"))
    return resolve.contract_rescue(nodes, calls)


@query("""with c as (select c_custkey as k, c_custkey % 501 as file, c_mktsegment as label from customer), one as (select file, label, min(k) as t from c group by 1, 2 having count(*) = 1),
raw as (select o_orderkey as ord, o_custkey as k, o_custkey % 501 as file, o_orderkey % 2 = 0 as same, m.label as wants from orders join c m on m.k = (o_custkey * 3 + 1) % 100),
option as (select ord, raw.k, one.t, 2 as tier, 0 as e from raw join one on one.file = (raw.file + 1) % 501 and label = wants union all select ord, raw.k, one.t, 2, 1 from raw join one on one.file = (raw.file + 2) % 501 and label = wants
union all select ord, raw.k, one.t, 3, 0 from raw join one on one.file = raw.file and label = wants and same union all select ord, raw.k, c.k, 1, 0 from raw join c on c.k = raw.file % 50 and label = wants),
best as (select ord, k, arg_min(t, tier * 10 + e) as t from option group by 1, 2)
select min(ord) as ord, 'c:' || k as source, 'c:' || t as target, 'references' as relation, 'field' as context from best where k <> t group by k, t""")
def relation_resolution(spark, d):
    """Customers in 501 files; each file imports the next two, and a customer by name."""
    c = table(spark, d, "customer")
    named = c.select(_cat("'c:", "c_custkey").alias("id"), F.col("c_mktsegment").alias("label"), F.lit("class").alias("kind"), F.concat(F.lit("f"), F.col("c_custkey") % 501).alias("source_file"))
    f = spark.range(501).select(F.col("id").alias("k"), F.concat(F.lit("f"), "id").alias("id"))
    of_file = f.select("id", F.col("id").alias("label"), F.lit("file").alias("kind"), F.col("id").alias("source_file"))
    to = lambda ord_, target, relation: f.select(F.lit(ord_).cast("long").alias("ord"), F.col("id").alias("source"), target.alias("target"), F.lit(relation).alias("relation"))
    edges = to(0, F.concat(F.lit("f"), (F.col("k") + 1) % 501), "imports").unionByName(to(1, F.concat(F.lit("f"), (F.col("k") + 2) % 501), "re_exports")).unionByName(to(2, F.concat(F.lit("c:"), F.col("k") % 50), "imports")).unionByName(to(-1, F.concat(F.lit("c:"), F.col("k") % 70), "imports_from"))
    wants = c.select(F.col("c_custkey").alias("w"), F.col("c_mktsegment").alias("target_label"))
    o = table(spark, d, "orders").withColumn("w", (F.col("o_custkey") * 3 + 1) % 100).join(wants, "w")
    raw = o.select(F.col("o_orderkey").alias("ord"), _cat("'c:", "o_custkey").alias("source_id"), "target_label", F.lit("references").alias("relation"), F.lit("field").alias("context"), F.concat(F.lit("f"), F.col("o_custkey") % 501).alias("source_file"), (F.col("o_orderkey") % 2 == 0).alias("allow_same_file"))
    out = resolve.resolve_relations(named.unionByName(of_file), edges, raw)
    return out.select("ord", "source", "target", "relation", F.element_at("properties", F.lit("context")).alias("context"))


@query(f"{G}, need as (select source, source as id from edges union select source, target from edges) select source, id, source_file, case when source_file <> 'part' then sha256(source_file) end as sha256 from need left join nodes using (id)")
def external_dependencies(spark, d):
    n, e = graph(spark, d)
    tables = ["region", "nation", "customer", "supplier", "orders"]
    hashes = spark.createDataFrame([(t,) for t in tables], "path string").withColumn("sha256", F.sha2("path", 256))
    return semantic.external_dependencies(n, e, hashes)


# --- layers and changes ----------------------------------------------------


@query("""with base as (select s_suppkey as ord, 'k' || s_nationkey as id, 'code' as layer from supplier), drops as (select min(c_custkey) as ord, 'k' || c_custkey % 60 as id, 'drop' as layer from customer group by 2),
notes as (select min(event_id) as ord, 'k' || user_id % 90 as id, 'note' as layer from events group by 2) select * from base union all select * from drops where id not in (select id from base) union all select * from notes where id not in (select id from base union all select id from drops)""")
def overlay_layers(spark, d):
    layer = lambda t, ord_, id_, name: table(spark, d, t).select(F.col(ord_).alias("ord"), F.concat(F.lit("k"), id_).alias("id"), F.lit(name).alias("layer"))
    base = layer("supplier", "s_suppkey", F.col("s_nationkey"), "code")
    return incremental.overlay(base, layer("customer", "c_custkey", F.col("c_custkey") % 60, "drop"), layer("events", "event_id", F.col("user_id") % 90, "note"), keys=["id"])


@query("""with old as (select doc_id, sha256(text) as h from documents where doc_id % 7 <> 3), now as (select doc_id, sha256(case when doc_id % 11 = 4 then text || '+' else text end) as h from documents where doc_id % 9 <> 5 and text is not null)
select 'd/' || now.doc_id as path, case when old.h = now.h then 'kept ' else 'made ' end || now.h as facts from now left join old using (doc_id)""")
def incremental_extraction(spark, d):
    docs = table(spark, d, "documents").filter("text is not null").withColumn("path", _cat("'d/", "doc_id"))
    tree = lambda t: t.select("doc_id", "path", "text", F.octet_length("text").cast("long").alias("size"), F.lit(0).cast("long").alias("mtime"), F.sha2("text", 256).alias("sha256"))
    old = tree(docs.filter("doc_id % 7 <> 3"))
    now = tree(docs.filter("doc_id % 9 <> 5").withColumn("text", F.when(F.col("doc_id") % 11 == 4, F.concat("text", F.lit("+"))).otherwise(F.col("text"))))
    facts = lambda word: lambda t: t.select("path", F.concat(F.lit(f"{word} "), "sha256").alias("facts"))
    return incremental.apply_changes(facts("kept")(old), files.classify_changes(now, old), facts("made"), now)


@query("select case when n > 256 then '' else path end as path, case when n > 256 then 'Overflow' else 'Modified' end as change from (select n_name as path, count(*) over () as n from nation) union all select '', 'Overflow' from (select count(*) as n from events) where n > 256 union all select props, event_type from events where (select count(*) from events) <= 256")
def overflow_collapse(spark, d):
    few = table(spark, d, "nation").select(F.col("n_name").alias("path"), F.lit("Modified").alias("change"))
    many = table(spark, d, "events").select(F.col("props").alias("path"), F.col("event_type").alias("change"))
    return debounce.collapse(few).unionByName(debounce.collapse(many))
