import random

import pytest
from pyspark.sql import functions as F

from weftgraph.catalogue_more import SPEC, depot
from weftgraph.operators import analyze, context, dedup, merge, resolve, seam, search, semantic, stats, traverse
from weftgraph.schema import LOC

NODE = f"ord long, id string, label string, kind string, source_file string, centrality double, loc {LOC}, properties map<string,string>"


def nodes(spark, *rows):
    full = [(k, r[0], r[1], r[2], r[3] if len(r) > 3 else "", r[4] if len(r) > 4 else 0.0, r[5] if len(r) > 5 else None, r[6] if len(r) > 6 else {}) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, NODE)


def edges(spark, *rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "ord long, source string, target string, relation string")


@pytest.fixture(scope="module")
def small(spark):
    n = nodes(spark, ("a", "Alpha", "class", "alpha.cpp", 1.0), ("b", "Beta", "function"), ("c", "AlphaLeaf", "function", "", 0.1), ("d", "gamma_run(int x, bool dry)", "function"))
    return n, edges(spark, ("a", "b", "CALLS"), ("c", "a", "CALLS"))


def test_impact_and_path(spark, small):
    n, e = small
    seed = spark.createDataFrame([("b",)], "id string")
    got = {(r.id, r.depth, r.via) for r in traverse.impact(e, seed, "dependents", via=True).collect()}
    assert got == {("a", 1, "CALLS"), ("c", 2, "CALLS")}
    assert traverse.impact(e, seed, "sideways").count() == 0
    assert [r.id for r in traverse.shortest_path(e, "c", "b").orderBy("step").collect()] == ["c", "a", "b"]
    assert [r.id for r in traverse.shortest_path(e, "c", "c").collect()] == ["c"]
    assert traverse.shortest_path(e, "c", "zzz").count() == 0


def test_random_distances_agree_with_a_model(spark):
    rnd = random.Random(3)
    pairs = [(f"n{rnd.randrange(30)}", f"n{rnd.randrange(30)}", rnd.choice("xy")) for _ in range(45)]
    e = edges(spark, *pairs)
    near = {}
    for s, t, _ in pairs:
        near.setdefault(s, set()).add(t)
        near.setdefault(t, set()).add(s)
    depth, front = {"n0": 0}, ["n0"]
    for k in range(1, 4):
        front = [y for x in front for y in near.get(x, ()) if y not in depth and not depth.update({y: k})]
    got = {r.id: r.depth for r in traverse.distances(e, spark.createDataFrame([("n0",)], "id string"), 3).collect()}
    assert got == depth


def test_centrality_leaves_notes_out(spark):
    n = nodes(spark, ("a", "a", "f"), ("b", "b", "f"), ("c", "c", "f"), ("memory:checkpoint:1", "m", "checkpoint"))
    e = edges(spark, ("a", "b", "LINKS"), ("a", "c", "CROSSES"), ("memory:checkpoint:1", "a", "concerns"), ("a", "gone", "LINKS"))
    assert {r.id: (r.degree, r.degree_centrality) for r in analyze.centrality(n, e).collect()} == {"a": (2, 1.0), "b": (1, 0.5), "c": (1, 0.5)}
    assert [r.id for r in analyze.god_nodes(n, e, 2).orderBy("god_node_rank").collect()] == ["a", "b"]


def test_communities_find_two_cliques(spark):
    ids = [f"{g}{k}" for g in "xy" for k in range(5)]
    n = nodes(spark, *[(i, i, "f") for i in ids], ("alone", "alone", "f"))
    e = edges(spark, *[(f"{g}{i}", f"{g}{j}", "L") for g in "xy" for i in range(5) for j in range(i)], ("x0", "y0", "L"))
    home = {r.id: r.community for r in analyze.communities(n, e).collect()}
    assert len(home) == 11 and len({home[f"x{k}"] for k in range(5)}) == 1 and len(set(home.values())) == 3
    q = analyze.modularity(n.join(analyze.communities(n, e), "id"), e).first()[0]
    assert q > 0.4
    assert analyze.layout(n.join(analyze.communities(n, e), "id")).count() == 11


def test_resolve_search_and_routes(spark, small):
    n, _ = small
    names = spark.createDataFrame([("a",), ("Beta",), ("GAMMA_RUN",), ("nope",)], "name string")
    assert {r["name"]: (r.id, r.tier) for r in search.resolve(n, names).collect()} == {"a": ("a", 1), "Beta": ("b", 2), "GAMMA_RUN": ("d", 3)}
    assert [r.id for r in search.substring_search(n, "alpha").collect()] == ["a", "c"]
    assert search.parse_phrase("What does  Foo call") == (search.PHRASES[4], "Foo")
    assert search.parse_phrase("callers of ") is None
    got = {r.query: (r.route, r.target) for r in search.route(n, spark.createDataFrame([("callers of Beta?",), ("alpha",), ("two words",)], "query string")).collect()}
    assert got == {"callers of Beta?": ("structural", "b"), "alpha": ("entity", "a"), "two words": ("search", None)}


def test_calls_resolve_by_tiers_and_balance(spark):
    n = nodes(spark, ("f1", "a.py", "file", "a.py"), ("m", "main", "function", "a.py"), ("h", "helper", "function", "a.py"), ("o1", "over", "function", "b.py"), ("o2", "over", "function", "b.py"), ("z1", "amb", "function", "b.py"), ("z2", "amb", "function", "c.py"), ("u", "only", "function", "c.py"), ("k", "meth", "function", "c.py"))
    e = edges(spark, ("C", "k", "method"))
    calls = spark.createDataFrame([(0, "m", "helper", False), (1, "m", "over", False), (2, "m", "amb", False), (3, "m", "only", False), (4, "m", "meth", True), (5, "m", "zzz", False), (6, "m", "main", False), (7, "m", "print", False), (8, "x", "helper", False)], "ord long, caller_id string, callee_label string, is_member_call boolean").withColumn("source_file", F.lit("")).withColumn("loc", F.lit(0))
    out = resolve.call_outcomes(n, e, calls)
    assert {r.callee_label: r.outcome for r in out.collect()} == {"helper": "resolved_same_file", "over": "resolved_overload_first", "amb": "dropped_ambiguous", "only": "resolved_project_unique", "meth": "resolved_member_method", "zzz": "dropped_unknown", "main": "dropped_self"}
    t = resolve.call_tally(out).first()
    assert t.balances and t.total == 7
    assert {(r.source, r.target, r.confidence) for r in resolve.call_edges(out).collect()} == {("m", "h", "EXTRACTED"), ("m", "o1", "INFERRED"), ("m", "o2", "INFERRED"), ("m", "u", "INFERRED"), ("m", "k", "INFERRED")}


def test_imports_bind_or_go(spark):
    stub = lambda i, spec, item=None: (i, i, "import", "", 0.0, None, {"import_path": spec} | ({"item": item} if item else {}))
    n = nodes(spark, ("fa", "a.ts", "file", "src/a.ts"), ("fi", "index.ts", "file", "src/lib/index.ts"), ("src_a_ts_foo", "foo", "function", "src/a.ts"), stub("s1", "src/a", "foo"), stub("s2", "src/lib"), stub("s3", "react"), stub("s4", "@/a"))
    e = edges(spark, ("x", "s1", "imports"), ("x", "s2", "imports_from"), ("x", "s3", "imports_from"), ("x", "s4", "imports_from"))
    alias = spark.createDataFrame([("@/", "src/", 0)], "prefix string, replacement string, ord int")
    left, out = resolve.resolve_imports(n, e, alias)
    assert {(r.source, r.target) for r in out.collect()} == {("x", "src_a_ts_foo"), ("x", "fi"), ("x", "fa")}
    assert left.count() == 3


def test_interfaces_dispatch_to_full_implementers(spark):
    p = {"interface_method": "true"}
    n = nodes(spark, ("I", "matcher", "type"), ("im", "Match", "method", "", 0.0, None, p), ("A", "A", "type"), ("am", "Match", "method"), ("B", "B", "type"), ("bm", "Other", "method"))
    e = edges(spark, ("I", "im", "method"), ("am", "A", "method_of"), ("bm", "B", "method_of"))
    assert {(r.source, r.target, r.relation) for r in resolve.interface_dispatch(n, e).collect()} == {("A", "I", "implements"), ("im", "am", "dispatches_to")}
    # a method that names its trait is bound to it though its type lacks the other promise
    n = n.unionByName(nodes(spark, ("jm", "Other", "method", "", 0.0, None, p), ("J", "J", "type")))
    e = e.unionByName(edges(spark, ("I", "jm", "method"), ("am", "I", "impl_trait"), ("bm", "J", "impl_trait")))
    assert resolve.interface_dispatch(n, e).isEmpty()
    assert {(r.source, r.target, r.relation) for r in resolve.trait_dispatch(n, e).collect()} == {("im", "am", "dispatches_to"), ("A", "I", "implements")}


def test_imports_follow_reexports(spark):
    """An item that a file only re-exports leads to where it is declared; a circle ends where it is met again."""
    stub = lambda i, label, spec, **more: (i, label, "import", "", 0.0, None, {"import_path": spec} | more)
    n = nodes(
        spark, ("hub", "hub.rs", "file", "task/hub.rs"), ("mid", "mid.rs", "file", "task/mid.rs"), ("task_end_rs_kiln", "Kiln", "type", "task/end.rs"), ("end", "end.rs", "file", "task/end.rs"),
        stub("a", "Kiln", "task/hub", item="Kiln"), stub("b", "Loop", "task/hub", item="Loop"), stub("c", "Other", "task/hub", item="Other"),
        stub("r1", "Kiln", "task/mid", item="Kiln", reexport="true"), stub("r2", "Kiln", "task/end", item="Kiln", reexport="true"),
        stub("r3", "Loop", "task/mid", item="Loop", reexport="true"), stub("r4", "Loop", "task/hub", item="Loop", reexport="true"),
    )
    e = edges(spark, ("x", "a", "imports"), ("y", "b", "imports"), ("z", "c", "imports"), ("hub", "r1", "re_exports"), ("mid", "r2", "re_exports"), ("hub", "r3", "re_exports"), ("mid", "r4", "re_exports"))
    out = {(r.source, r.target) for r in resolve.resolve_imports(n, e)[1].filter("relation = 'imports'").collect()}
    assert out == {("x", "task_end_rs_kiln"), ("y", "hub"), ("z", "hub")}


def test_dedup_guards_and_merges(spark):
    at = lambda a, b=0: (a, b, a + 1, 0)
    n = nodes(
        spark, ("1", "FreightLedgerWriter", "concept"), ("2", "Freight Ledger Writer", "concept"), ("3", "FreightLedgerWriters", "concept"), ("4", "HarborCrate", "concept"), ("5", "HarborCrateTotal", "concept"),
        ("6", "render", "function", "a.ts", 0.0, at(1)), ("7", "render", "function", "b.ts", 0.0, at(1)), ("8", "render", "function", "a.ts", 0.0, at(1)), ("9", "TollGateCounter", "concept"), ("10", "TollGateCounten", "concept"), ("f", "a.ts", "file", "a.ts"), ("g", "a.ts", "file", "a.ts"),
    )
    kept, e = dedup.deduplicate(n, edges(spark, ("8", "7", "CALLS"), ("6", "7", "CALLS"), ("10", "9", "x")))
    ids = {r.id for r in kept.collect()}
    assert {"4", "5", "6", "7", "9", "f", "g", "1"} <= ids and not {"8", "10"} & ids
    assert {(r.source, r.target) for r in e.collect()} == {("6", "7"), ("9", "9")}


def test_merging(spark):
    e = edges(spark, ("a", "b", "x"), ("a", "b", "x"), ("b", "a", "x"))
    assert sorted(r.ord for r in merge.merge_edges(e).collect()) == [0, 2]
    remap = spark.createDataFrame([("b", "a")], "old string, new string")
    assert merge.rewrite_edges(e, remap).count() == 1 and merge.rewrite_edges(e, remap, True).count() == 0
    n = spark.createDataFrame([(k * 10, f"n{k}") for k in range(50)], "ord long, id string").repartition(4)
    assert sorted((r.ord, r.id) for r in merge.renumber(n).collect()) == [(k, f"n{k}") for k in range(50)]


def test_seam_is_whole_or_fails(spark):
    n, e = seam.generate(spark, SPEC, {"depot": depot(spark)})
    assert {(r.relation, r.target) for r in e.collect()} >= {("CONSUMED_AT", "depot::quoteFor"), ("MIRRORED_BY", "depot::Quote")}
    assert n.filter("kind = 'code-ref'").count() == 2
    for change in ({"consumes": [SPEC["consumes"][0] | {"path": "/x"}]}, {"mirrors": [SPEC["mirrors"][0] | {"line": 999}]}, {"mirrors": [SPEC["mirrors"][0] | {"schema": "x"}]}):
        with pytest.raises(seam.SeamError):
            seam.generate(spark, SPEC | change, {"depot": depot(spark)})


def test_packers_keep_the_budget():
    rows = [{"id": f"n{k}", "label": f"label{k}", "kind": "function", "depth": min(k, 2), "via": "edge", "overlap": 0.1 * (k % 4), "cost": 5 + k, "start_line": 1, "source_file": "a.py", "centrality": 0.5} for k in range(30)]
    for budget in (10, 100, 300, 5000):
        for pack in (context.pack_greedy, context.pack_knapsack):
            out = pack(rows, budget)
            assert out[0][:2] == ("n0", "full")
            assert sum(t for _, _, t in out[1:]) <= budget


def test_knapsack_is_optimal():
    rnd = random.Random(7)
    for _ in range(40):
        w, v, c = [rnd.randrange(1, 9) for _ in range(8)], [rnd.random() for _ in range(8)], rnd.randrange(1, 25)
        pick = context.knapsack(w, v, c)
        best = max(sum(v[k] for k in range(8) if m >> k & 1) for m in range(256) if sum(w[k] for k in range(8) if m >> k & 1) <= c)
        assert sum(w[k] for k in pick) <= c and sum(v[k] for k in pick) == pytest.approx(best)


def test_fragments_cache_and_chunks(spark):
    f = spark.createDataFrame([("ok", '{"nodes": [{"id": "a", "label": "A"}], "edges": [], "hyperedges": [{"id": "h", "relation": "r", "nodes": []}]}'), ("torn", "{"), ("list", "[]"), ("lacks", '{"nodes": [{"id": "a"}], "edges": [{"source": "a"}]}'), ("hyper", '{"nodes": [], "edges": [], "hyperedges": 3}')], "path string, text string")
    assert {r.path: len(r.errors) for r in semantic.validate_fragments(f).collect()} == {"ok": 0, "torn": 1, "list": 1, "lacks": 3, "hyper": 1}
    files = spark.createDataFrame([(f"d/{k:02d}", 10 if k != 9 else 2 << 20) for k in range(12)], "path string, size long")
    assert [r.chunk for r in semantic.plan_chunks(files).orderBy("path").collect()] == [0] * 8 + [1, 2, 3, 3]


def test_histogram_percentile(spark):
    h = spark.createDataFrame([("q", 0, 1), ("q", 3, 2), ("q", 11, 1)], "op string, bucket int, n long")
    assert stats.histogram_percentile(h, 0.5).first().value == pytest.approx(6.0)
    assert stats.histogram_percentile(h, 1.0).first().value == 1024.0


def test_communities_in_one_task_and_by_all(spark, monkeypatch):
    from weftgraph.operators import unionfind

    n = spark.createDataFrame([(f"n{k}",) for k in range(24)], "id string")
    links = [(f"n{g * 5 + i}", f"n{g * 5 + j}") for g in range(4) for i in range(5) for j in range(i)] + [("n0", "n5"), ("n6", "n11"), ("n3", "n3"), ("n1", "lost")]
    e = spark.createDataFrame(links, "source string, target string")
    one = {r.id: r.community for r in analyze.communities(n, e, 3, 2).collect()}
    assert len(one) == 24 and one["n22"] == "n22" and one["n0"] == one["n4"] != one["n9"]
    monkeypatch.setattr(unionfind, "FINISH", 0)
    assert {r.id: r.community for r in analyze.communities(n, e, 3, 2).collect()} == one


def test_focus_is_the_most_central_that_holds_the_query(spark):
    n = spark.createDataFrame([(0, "a", "Alpha", 0.1), (1, "b", "AlphaLeaf", 0.5), (2, "doc:pha", "alpha doc", 0.9), (3, "c", "Beta", 0.5)], "ord long, id string, label string, centrality double")
    q = spark.createDataFrame([(1, "pha"), (2, "PHAL"), (3, ""), (4, "b"), (5, "ta")], "qid int, query string")
    assert {r.qid: r.id for r in context.focal(n, q).collect()} == {1: "b", 2: "b", 4: "b", 5: "c"}


def test_links_of_a_document_are_limited_after_names_meet_nodes(spark):
    n = spark.createDataFrame([(k * 3 + j, f"n{k}_{j}", f"name_{k}", "function") for k in range(10) for j in range(3)], "ord long, id string, label string, kind string")
    docs = spark.createDataFrame([(1, " ".join(f"name_{k}" for k in range(10)))], "doc_id long, text string")
    got = sorted((r.rank, r.id) for r in semantic.doc_links(docs, semantic.symbol_index(n)).collect())
    assert [i for _, i in got] == [f"n{k}_{j}" for k in range(3) for j in range(3)] + ["n3_0"]


def test_paths_longer_than_any_number_of_hops(spark):
    e = spark.createDataFrame([(f"v{k}", f"v{k + 1}", "r", k) for k in range(70)], "source string, target string, relation string, ord long")
    assert traverse.shortest_path(e, "v0", "v70").count() == 71
