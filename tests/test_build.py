import json
import os
import time

from pyspark.sql import functions as F

from weftgraph.engine import Engine, PinError
from weftgraph.operators import extract
from weftgraph.plans.build import build
from weftgraph.sources import exports, files, graphjson
from weftgraph.streaming import debounce, incremental, watcher

import pytest

SOURCES = [
    ("main.py", "python", "from util import helper\n\nclass Base:\n    pass\n\nclass A(Base):\n    def run(self):\n        return self.other()\n\n    def other(self):\n        return helper()\n\ndef main():\n    if True:\n        A().run()\n    return main2()\n\ndef main2():\n    return 1\n"),
    ("util.py", "python", "def helper():\n    return 1\n"),
    ("bad.py", "python", "def (:"),
    ("web/a.ts", "typescript", "import { b } from './b'\nexport class Foo {\n  bar() {}\n}\nexport const go = () => { b(); }\n"),
    ("web/b.ts", "typescript", "export function b() { return 1 }\n"),
    ("lib.rs", "rust", "use crate::x::y;\nstruct S;\nfn f() { g(); }\nfn g() {}\n"),
    ("db/1.sql", "sql", 'CREATE TABLE "public"."Users" (id int);\nCREATE TABLE orders (id int);\nCREATE TYPE mood AS ENUM (\'a\');\nALTER TABLE orders ADD CONSTRAINT fk FOREIGN KEY (uid) REFERENCES "Users"(id);\nALTER TABLE orders RENAME TO purchases;'),
    (".mcp.json", "mcp_config", '{"mcpServers": {"fs": {"command": "npx"}}}'),
    ("x.csproj", "msbuild", '<Project>\n<Target Name="Go">\n<PackageReference Include="Json" />\n</Project>'),
    ("v.blade.php", "php_blade", "<b>"),
]


@pytest.fixture(scope="module")
def source_files(spark):
    return spark.createDataFrame(SOURCES, "path string, language string, text string")


@pytest.fixture(scope="module")
def graph(source_files):
    return build(source_files.coalesce(1), dedupe=False, community=False)


def test_build_links_what_is_written(graph):
    label = {r.id: r.label for r in graph.nodes.collect()}
    e = {(label.get(r.source), r.relation, label.get(r.target)) for r in graph.edges.collect()}
    assert ("main", "CALLS", "main2") in e and ("other", "CALLS", "helper") in e and ("A", "inherits", "Base") in e
    assert ("A", "method", "run") in e and ("main.py", "contains", "main") in e and ("main.py", "imports", "helper") in e
    assert ("a.ts", "imports_from", "b.ts") in e and ("go", "CALLS", "b") in e and ("f", "CALLS", "g") in e
    assert ("orders", "references", "Users") in e and {"purchases", "mood", "fs", "npx", "Json", "Go"} <= set(label.values())
    t = graph.tally.first()
    assert t.balances and t.total > 0
    assert graph.nodes.filter("community is null or centrality is null").isEmpty()


def test_build_does_not_depend_on_partitions(graph, source_files):
    again = build(source_files.repartition(2), dedupe=False, community=False)
    key = lambda g: (sorted(r.id for r in g.nodes.collect()), sorted((r.source, r.relation, r.target) for r in g.edges.collect()))
    assert key(graph) == key(again)


def test_damage_is_a_warning(source_files):
    x = extract.extract(source_files.filter("path = 'bad.py'")).first()
    assert x.warnings and len(x.nodes) == 1
    assert {r.language: r.n for r in extract.unextracted(source_files).collect()} == {"php_blade": 1}


def test_engine(graph):
    g = Engine(graph.nodes, graph.edges, "r1")
    assert {r.label for r in g.impact("helper").collect()} >= {"other"}
    assert "other" in {r.label for r in g.query("callers of helper").collect()}
    assert g.path("main", "main2").count() == 2
    assert g.context("main", 400).filter("form = 'full'").count() >= 1
    assert g.explain("A").filter("relation = 'method'").count() == 2
    with pytest.raises(PinError):
        g.status(pin="other")
    id_ = g.remember("A note", "about helper", touches=["main"], at=5)
    assert id_ == "memory:checkpoint:5" and g.remember("next", at=5) == "memory:checkpoint:6"
    assert [r.title for r in g.recall("HELPER").collect()] == ["A note"]
    assert g.op_stats().count() >= 5


def test_exports_and_snapshots(graph, spark, tmp_path):
    exports.write_exports(graph.nodes, graph.edges, str(tmp_path / "out"), {"build_state": 4})
    n, e, meta = graphjson.read_graph(spark, str(tmp_path / "out/graph.json"))
    assert n.count() == graph.nodes.count() and e.count() == graph.edges.count() and meta.first().build_state == 4
    assert len(os.listdir(tmp_path / "out")) >= 6
    s = exports.Snapshots(spark, str(tmp_path / "snap"))
    with pytest.raises(LookupError):
        s.read()
    assert s.publish(graph.nodes.select("id"), graph.edges.select("source", "target")) == 1
    assert s.publish(graph.nodes.select("id").limit(1), graph.edges.select("source", "target")) == 2
    assert s.read()[0].count() == 1 and s.read(1)[0].count() == graph.nodes.count()


def test_scan_ignore_and_hash(spark, tmp_path):
    for p in ("src/a.py", "node_modules/x.js", "env2/pyvenv.cfg", "env2/lib.py", "docs/skip.py", "b.sql"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x")
    got = {r.path: r.language for r in files.scan(spark, str(tmp_path), "docs/\n").filter("language is not null").collect()}
    assert got == {"src/a.py": "python", "b.sql": "sql"}
    import hashlib

    rows = [("a", hashlib.sha256(b"1").hexdigest()), ("b", hashlib.sha256(b"2").hexdigest()), ("c", hashlib.sha256(b"3").hexdigest())]
    leaf = [hashlib.sha256(b"\0" + len(p).to_bytes(4, "big") + p.encode() + bytes.fromhex(h)).digest() for p, h in rows]
    want = hashlib.sha256(b"\1" + hashlib.sha256(b"\1" + leaf[0] + leaf[1]).digest() + leaf[2]).hexdigest()
    assert files.content_root(spark.createDataFrame(rows, "path string, sha256 string")).first().sha256 == want
    assert files.content_root(spark.createDataFrame([], "path string, sha256 string")).first().sha256 == hashlib.sha256(b"\2").hexdigest()


def test_rescan_refuses_unreadable(spark):
    cols = "path string, size long, mtime long, sha256 string"
    old = spark.createDataFrame([("a", 1, 1, "x"), ("b", 1, 1, "y"), ("c", 1, 1, "z")], cols)
    now = spark.createDataFrame([("a", 1, 1, "x"), ("b", 1, 2, "y2"), ("d", 1, 1, "w")], cols)
    assert {r.path: r.change for r in incremental.plan_rescan(now, old).collect()} == {"a": "HashHit", "b": "Stale", "c": "Deleted", "d": "New"}
    with pytest.raises(incremental.UnreadableError):
        incremental.plan_rescan(now.withColumn("sha256", F.when(F.col("path") != "a", F.col("sha256"))), old)


def test_incremental_extraction_equals_batch(source_files, spark):
    first = extract.extract(source_files)
    edited = source_files.filter("path <> 'lib.rs'").withColumn("text", F.when(F.col("path") == "util.py", "def helper2():\n    pass\n").otherwise(F.col("text")))
    changes = spark.createDataFrame([("util.py", "Modified"), ("lib.rs", "Deleted")], "path string, change string")
    got = incremental.apply_changes(first, changes, extract.extract, edited)
    key = lambda df: sorted((r.path, str(r.nodes), str(r.edges)) for r in df.collect())
    assert key(got) == key(extract.extract(edited))


def test_fragments_ledger_aliases(spark, tmp_path):
    (tmp_path / "chunk_2.json").write_text(json.dumps({"nodes": [{"id": "a", "label": "A"}], "edges": [{"source": "a", "target": "b", "relation": "r"}]}))
    (tmp_path / "chunk_10.json").write_text("{")
    (tmp_path / "other.json").write_text("{}")
    drops = graphjson.fragment_drops(spark, str(tmp_path))
    assert sorted(r.chunk for r in drops.collect()) == [2, 10]
    n, e, errors = graphjson.read_fragments(drops)
    assert (n.count(), e.count(), errors.count()) == (1, 1, 1)
    (tmp_path / "ledger.jsonl").write_text('{"schema_version": 1, "boot": "a", "shutdown": "b", "ops": {"query": {"count": 2, "total_ms": 3.0, "hist_ms": [2]}}}\n\n{"torn')
    assert graphjson.read_ledger(spark, str(tmp_path / "ledger.jsonl")).count() == 1
    assert graphjson.path_aliases('{ // c\n "compilerOptions": {"baseUrl": "./src", "paths": {"@/*": ["lib/*"], "x": ["y"],}}}') == [("@/", "src/lib/", 0)]


def test_changes_stream(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.py").write_text("1")
    assert watcher.compare({"a": (1,), "b": (1,)}, {"b": (2,), "c": (1,)}) == [("a", "Deleted", None), ("b", "Modified", None), ("c", "Created", None)]
    spark.dataSource.register(watcher.ChangesSource)
    q = spark.readStream.format("weft_changes").load(str(root)).writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="200 milliseconds").start()
    try:
        time.sleep(4)
        (root / "b.md").write_text("x")
        end = time.time() + 30
        while time.time() < end and spark.table("changes").count() == 0:
            time.sleep(0.5)
        assert ("b.md", "Created", "document") in [tuple(r) for r in spark.table("changes").collect()]
    finally:
        q.stop()
    big = spark.range(300).select(F.col("id").cast("string").alias("path"), F.lit("Modified").alias("change"))
    assert debounce.collapse(big).first().change == "Overflow" and debounce.collapse(big.limit(5)).count() == 5
