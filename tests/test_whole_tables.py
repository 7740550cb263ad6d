"""Queries over whole tables, held against their SQL with the cuts taken out of it here."""

import glob
import os

import duckdb
import pytest

from tools.compare import canon
from weftgraph import catalogue

DATA, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"

#: What of the registered SQL keeps it to a part of the tables.
CUTS = {
    "range_anchor": [(" where l_orderkey <= 400", ""), (" where event_id < 300", "")],
    "doc_links": [(" where o_orderkey < 2000", "")],
    "override_union": [(" where event_id < 500", "")],
    "relational_division": [(" where l_suppkey % 5 = 0 and l_partkey % 400 < 3", "")],
    "idf_search": [("p_partkey < 20", "p_partkey % 50 = 0"), (" where kind = 'part' or kind = 'nation'", "")],
    "suggestions": [(" where kind <> 'order' and kind <> 'part'", "")],
    "svg_positions": [(" where kind in ('region', 'nation')", "")],
    "cypher_statements": [(" where kind in ('region', 'nation')", ""), (" where relation = 'PART_OF'", "")],
    "markdown_blocks": [(" where kind in ('region', 'nation')", "")],
}


@pytest.mark.parametrize("name", CUTS)
def test_whole(spark, name):
    data = DATA if name in ("range_anchor", "doc_links") else SMALL
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    sql = catalogue.oracle_sql()[name]
    for cut, instead in CUTS[name]:
        if cut in sql:
            sql = sql.replace(cut, instead)
    got, want = catalogue.queries()[name](spark, data).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns) and canon(got) == canon(want)


def test_communities_of_every_node(spark, monkeypatch):
    from weftgraph.operators import analyze

    monkeypatch.setattr(analyze, "communities", lambda n, e: (n, e))
    got, (n, e) = catalogue.queries()["communities"](spark, SMALL), catalogue.graph(spark, SMALL)
    assert (got[0].count(), got[1].count()) == (n.count(), e.count())


def test_context_walks_every_relation(spark, monkeypatch):
    from weftgraph import catalogue_more
    from weftgraph.operators import context

    monkeypatch.setattr(context, "focal", lambda n, q: None)
    monkeypatch.setattr(context, "gather", lambda n, e, q, s: e)
    monkeypatch.setattr(context, "pack", lambda n, near, budget, packer: near)
    assert catalogue_more._packed(spark, SMALL, "greedy").count() == catalogue.graph(spark, SMALL)[1].count()


def test_snippets_of_every_document(spark, tmp_path):
    texts = ["one", "a\nb", "a\n" + "b" * 1500 + "\n" + "c" * 497 + "\nd\ne", "a\n" + "b" * 1500 + "\n" + "c" * 600 + "\nd", "a\nb\nc\nd\ne", "a\n" + "b" * 2500]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for k, text in enumerate(texts):
        kept, full = [], False
        for line in text.split("\n")[1:4]:
            full = full or sum(len(x) + 1 for x in kept) + len(line) + 1 > 2000
            kept += [] if full else [line]
        want[str(k)] = ("\n".join(kept), full) if "\n" in text else (None, None)
    got = {r.key: (r.snippet, r.truncated) for r in catalogue.queries()["snippet_slice"](spark, str(tmp_path)).collect()}
    assert got == want
