"""What the graph operators keep and compare grows with what is asked for, not with the square of the tables or all edges."""

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import analyze, context, dedup, resolve, search, traverse
from weftgraph.sources import exports


def noted(monkeypatch, module, name):
    """Row counts of what goes into ``module.name``."""
    seen, keep = [], getattr(module, name)

    def run(df, *args, **kwargs):
        seen.append(df.count())
        return keep(df, *args, **kwargs)

    monkeypatch.setattr(module, name, run)
    return seen


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def far(spark):
    """A path of five nodes, and 300 edges elsewhere."""
    pairs = [(f"p{k}", f"p{k + 1}") for k in range(4)] + [("hub", f"x{k}") for k in range(300)]
    e = spark.createDataFrame([(a, b, "r") for a, b in pairs], "source string, target string, relation string")
    ids = sorted({x for p in pairs for x in p})
    return spark.createDataFrame([(k, i, f"label {i}", "f", f"file{k}", 0.1) for k, i in enumerate(ids)], "ord long, id string, label string, kind string, source_file string, centrality double"), e


def test_paths_keep_only_edges_that_a_front_touches(spark, far, monkeypatch):
    seen = noted(monkeypatch, traverse, "settle")
    assert [r.id for r in traverse.shortest_path(far[1], "p0", "p4").orderBy("step").collect()] == [f"p{k}" for k in range(5)]
    assert max(seen) < 10


def test_first_found_parents_lead_from_either_end(spark):
    """Two paths of one length: the lesser ordinal of the first edge decides, wherever the fronts meet."""
    rows = [("s", "a", 9), ("s", "b", 1), ("a", "c", 2), ("b", "d", 8), ("c", "t", 0), ("d", "t", 7), ("t", "u", 3)]
    e = spark.createDataFrame([(a, b, "r", k) for a, b, k in rows], "source string, target string, relation string, ord long")
    assert [r.id for r in traverse.shortest_path(e, "s", "u").orderBy("step").collect()] == ["s", "b", "d", "t", "u"]


def test_gathering_keeps_only_edges_that_a_front_touches(spark, far, monkeypatch):
    q = spark.createDataFrame([(1, "p0 words")], "qid int, query string")
    seen = noted(monkeypatch, context, "settle")
    got = context.gather(*far, q, spark.createDataFrame([(1, "p0")], "qid int, id string"), 2, False)
    assert {(r.id, r.depth) for r in got.collect()} == {("p0", 0), ("p1", 1), ("p2", 2)}
    assert max(seen) < 10


def test_few_needles_are_looked_for_without_a_join(spark, far):
    got = context.holders(far[0], spark.createDataFrame([("HUB",), ("x29",), ("",)], "needle string"))
    assert sorted((r.needle, r.id) for r in got.collect()) == sorted([("HUB", "hub"), ("x29", "x29")] + [("x29", f"x29{k}") for k in range(10)])
    assert "Join" not in plan(got)


def test_many_needles_meet_by_grams(spark, far, monkeypatch):
    monkeypatch.setattr(context, "NEEDLES", 1)
    got = context.holders(far[0], spark.createDataFrame([("HUB",), ("x299",)], "needle string"))
    assert sorted((r.needle, r.id) for r in got.collect()) == [("HUB", "hub"), ("x299", "x299")]


def test_names_meet_nodes_in_one_join(spark, far):
    got = search.resolve(far[0], spark.createDataFrame([("hub",), ("LABEL P1",), ("none",)], "name string"))
    assert {(r["name"], r.id, r.tier) for r in got.collect()} == {("hub", "hub", 1)} | {("LABEL P1", "p1", 3)}
    assert plan(got).count("Join ") == 1


def test_equal_queries_and_labels_are_compared_once(spark, monkeypatch):
    n = spark.createDataFrame([(k, f"n{k}", ("small ring", "large ring")[k % 2], float(k % 7)) for k in range(80)], "ord long, id string, label string, centrality double")
    q = spark.createDataFrame([(k, "ring small") for k in range(30)], "qid int, query string")
    seen = noted(monkeypatch, search, "top_by")
    got = search.idf_search(n, q, 3).collect()
    want = sorted(range(0, 80, 2), key=lambda k: (-(k % 7), k))[:3]
    assert sorted((r.qid, r["rank"], r.id) for r in got) == sorted((j, r + 1, f"n{k}") for j in range(30) for r, k in enumerate(want))
    assert seen[-1] <= 6


def test_degrees_ask_for_far_ends_only_where_nodes_are_missing(spark, far):
    n, e = far
    assert "Join" not in plan(analyze.degrees(n, e))
    e = e.unionByName(spark.createDataFrame([("p0", "gone", "r"), ("gone", "hub", "r"), ("gone", "lost", "r")], e.schema))
    got = {r.id: r.degree for r in analyze.degrees(n, e).collect()}
    assert got["hub"] == 300 and got["p0"] == 1 and got["p1"] == 2 and len(got) == n.count()


def test_equal_ranges_are_compared_once(spark, monkeypatch):
    n = spark.createDataFrame([(k, f"n{k}", "function", "src/a.py", (10, 20 + k % 2)) for k in range(400)], "ord long, id string, kind string, source_file string, loc struct<start_line: int, end_line: int>")
    s = spark.createDataFrame([(k, "a.py", 10 + k) for k in range(12)], "site long, file string, line int")
    seen = noted(monkeypatch, resolve, "first_by")
    assert {r.site: r.id for r in resolve.anchor(s, n).collect()} == {k: "n0" if k <= 10 else "n1" for k in range(12)}
    assert max(seen) <= 24


def test_outcomes_of_calls_need_no_lists(spark):
    n = spark.createDataFrame([(k, f"n{k}", "over", "function", f"f{k % 2}") for k in range(6)], "ord long, id string, label string, kind string, source_file string").withColumn("properties", F.expr("cast(map() as map<string,string>)"))
    e = spark.createDataFrame([], "ord long, source string, target string, relation string")
    calls = spark.createDataFrame([(k, f"n{k}", "over", False) for k in range(6)], "ord long, caller_id string, callee_label string, is_member_call boolean").withColumn("source_file", F.lit("")).withColumn("loc", F.lit(0))
    out = resolve.call_outcomes(n, e, calls)
    assert "collect_list" not in plan(out.groupBy("outcome").count())
    assert {r.caller_id: (r.outcome, r.targets) for r in out.collect()} == {f"n{k}": ("dropped_self", None) if k < 2 else ("resolved_overload_first", [f"n{k % 2 + j}" for j in (0, 2, 4)]) for k in range(6)}


def test_equal_labels_hang_together_by_the_first(spark):
    rows = [(k, f"n{k}", ("FreightLedgerWriter", "FreightLedgerWritex")[k % 2], "concept") for k in range(60)]
    n = spark.createDataFrame(rows, "ord long, id string, label string, kind string").withColumn("source_file", F.lit("")).withColumn("loc", F.expr("cast(null as struct<start_line: int, start_column: int>)")).withColumn("properties", F.expr("cast(map() as map<string,string>)"))
    pairs = dedup.fuzzy_pairs(dedup._prepared(n))
    assert sorted((r.a, r.b) for r in pairs.collect()) == sorted([(0, 1)] + [(k % 2, k) for k in range(2, 60)])
    scoped = dedup.fuzzy_pairs(dedup._prepared(n), spark.createDataFrame([(7,)], "ord long"))
    assert {r.root for r in traverse.components(n, scoped).collect()} == {0}
    few = dedup.fuzzy_pairs(dedup._prepared(n), spark.createDataFrame([(99,)], "ord long"))
    assert few.isEmpty()


def test_places_are_numbered_by_ranges(spark):
    n = spark.createDataFrame([(k * 3, f"n{k}", f"l{k}", "ab"[k % 2]) for k in range(40)], "ord long, id string, label string, community string").repartition(4)
    svg, spots = exports.svg_rows(n), analyze.layout(n)
    assert "row_number" not in plan(svg) + plan(spots)
    far = {r.ord: (r.x, r.y) for r in svg.collect()}
    assert far[0] == (360.0, 180.0) and far[30] == pytest.approx((240.0, 300.0))
    assert spots.count() == 40
