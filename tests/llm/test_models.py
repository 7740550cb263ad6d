import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import language, licenses, neighbours, quality, queries

DATA = "/root/testdata/sf0.01"


def test_language_on_texts_held_out(spark):
    truth = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    rows = queries.op7_language(spark, DATA).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    aside = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == truth[r.doc_id] for r in aside) >= 0.98 * len(aside)


def brute_kn(words, order=4):
    """Interpolated Kneser-Ney by its definition, over distinct words as counts."""
    counts = [Counter() for _ in range(order + 1)]
    for w, n in Counter(words).items():
        s = f"\x02{w}\x03"
        for k in range(1, order + 1):
            for i in range(1, len(s)):
                if i - k + 1 >= 0:
                    counts[k][s[i - k + 1 : i + 1]] += n
    raw = [Counter(c) for c in counts]
    for k in range(1, order):
        longer = Counter(g[1:] for g in raw[k + 1])
        counts[k] = Counter({g: longer.get(g) or n for g, n in raw[k].items()})
    d = [0.0] * (order + 1)
    for k in range(1, order + 1):
        n1, n2 = (sum(v == x for v in counts[k].values()) for x in (1, 2))
        d[k] = min(max(n1 / (n1 + 2 * n2), 0.1), 0.9) if n1 else 0.5

    def p(g):
        if not g:
            return 1 / language.ALPHABET
        k = len(g)
        same = {x: v for x, v in counts[k].items() if x[:-1] == g[:-1]}
        total = sum(same.values())
        lower = p(g[1:])
        return lower if not total else max(counts[k][g] - d[k], 0) / total + min(d[k] * len(same) / total, 1.0) * lower if counts[k][g] else min(d[k] * len(same) / total, 1.0) * lower

    def word(w):
        s = f"\x02{w}\x03"
        return sum(np.log(p(s[max(0, i - order + 1) : i + 1])) for i in range(1, len(s)))

    return word


def test_kneser_ney_by_definition():
    texts = {"x": ["abba cab abba bacca", "cab cab ab"], "y": ["dad ada bada", "abba d"]}
    m = language.train(texts)
    for k, lang in enumerate(m.languages):
        word = brute_kn([w for t in texts[lang] for w in language.words_of(t)])
        probe = ["abba", "cab", "a", "dada", "zq", "bacab"]
        assert np.allclose(m.score(probe)[0][:, k], [word(w) for w in probe], atol=1e-6)


def test_quality_on_texts_held_out(spark):
    truth = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{DATA}/labels.parquet").to_pylist()}
    rows = [r for r in queries.op3_quality(spark, DATA).collect() if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in rows) >= 0.95 * len(rows)


def test_rules_as_columns_agree_with_numpy(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(400, len(quality.STATS)))
    y = ((x[:, 1] > 0.2) & (x[:, 4] < 0.5)).astype(float)
    m = quality.train(x, y)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{s} double" for s in quality.STATS))
    got = np.array([r[0] for r in df.select(m.column()).collect()])
    want = np.full(len(x), m.intercept)
    for c, w in m.rules:
        want += w * quality._holds(c, x)
    assert np.allclose(got, 1 / (1 + np.exp(-want))) and ((got >= 0.5) == y).mean() > 0.97
    assert 0 < len(m.rules) < 80


def test_neighbours_recall_and_exact_scores(spark):
    t = pq.read_table(f"{DATA}/embeddings.parquet").to_pandas()
    x = np.array(t.embedding.tolist(), float)
    got = queries.op5_neighbours(spark, DATA).toPandas()
    hits = 0
    for q in np.flatnonzero(t.vec_id % 20 == 0):
        mine = got[got.query_id == t.vec_id[q]].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21))
        score = x @ x[q]
        assert np.allclose(mine.score, score[mine.vec_id], atol=1e-12)
        best = [k for k in np.lexsort((t.vec_id, -score)) if k != q][:20]
        hits += len(set(best) & set(mine.vec_id))
    assert hits >= 0.9 * len(got)


def test_neighbours_in_trees_of_outgrown_leaves(spark):
    """A first tree of few leaves, of which one holds a third of all: those too large get trees of their own."""
    rnd = np.random.default_rng(5)
    x = np.vstack([rnd.normal(size=(1, 8)) * 2 + rnd.normal(size=(n, 8)) * 0.5 for n in (900, 300, 300, 300, 300, 20, 20)] + [np.full((60, 8), 0.25)])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.search(df, "vec_id % 20 = 0", 20, leaves=6, split=100).toPandas()
    hits = 0
    for q in range(0, len(x), 20):
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and mine.vec_id.is_unique and q not in set(mine.vec_id)
        score = x @ x[q]
        assert np.allclose(mine.score, score[mine.vec_id], atol=1e-12)
        score[q] = -np.inf
        hits += int((score[mine.vec_id] >= np.sort(score)[-20] - 1e-9).sum())
    assert hits >= 0.9 * len(got)


def test_neighbours_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "VECTORS", 5)
    monkeypatch.setattr(neighbours, "VISITS", 3)
    inf, nan = float("inf"), float("nan")
    same = [(k, [1.0, 2.0]) for k in range(100, 140)]
    odd = [(0, None), (1, []), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [3.0, 1.0]), (20, [3.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0.5) for i, v in odd + same], "vec_id long, embedding array<float>, score double")
    rows = neighbours.search(df, "vec_id % 20 = 0", 5).collect()
    of = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        of.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert of == {20: [(k, 5.0) for k in range(100, 105)], 100: [(20, 5.0)] + [(k, 5.0) for k in range(101, 105)], 120: [(20, 5.0)] + [(k, 5.0) for k in range(100, 104)]}
    assert neighbours.search(df.limit(0), "vec_id % 20 = 0").count() == 0
    two = spark.createDataFrame([(0, [1.0]), (7, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in neighbours.search(two, "vec_id = 0").collect()] == [(0, 1, 7, 2.0)]


def test_licenses(spark):
    apache = licenses.TEMPLATES["Apache-2.0"][1]
    texts = [None, "", "x", "Released under the MIT License.\nmore text", "words\n\n" + apache.replace(" ", "\n", 3) + "\n\nend", apache.upper(), "under the License", "Released under the MIT License.\n" * 3]
    df = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, license string")
    got = {(r.doc_id, r.license): r.dice for r in licenses.scan(df).collect()}
    assert set(got) == {(3, "MIT"), (4, "Apache-2.0"), (5, "Apache-2.0"), (7, "MIT")}
    assert got[3, "MIT"] == 1.0 and got[5, "Apache-2.0"] == 1.0
    assert licenses.scan(df.limit(0)).count() == 0


def test_held_out_matches_zlib(spark):
    from weftgraph.llm._common import held_out

    for r in spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect():
        assert r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2)


def test_neighbours_of_small_leaves_are_as_many_as_asked(spark):
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(60, 8)) * 20
    x = np.concatenate([c + rnd.normal(size=(3 if j % 2 else 60, 8)) * 0.01 for j, c in enumerate(centres)])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.search(df, "vec_id % 7 = 0", 20, recall=0.5).groupBy("query_id").count().collect()
    assert len(got) == -(-len(x) // 7) and {r["count"] for r in got} == {20}


def test_neighbours_routes_hold_a_query_once(spark, monkeypatch):
    """Uncorrelated vectors need many visits: a query's vector is kept once, not for each of them, and in the precision given."""
    rnd = np.random.default_rng(8)
    x = rnd.normal(size=(3000, 24)).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    settled, keep = [], neighbours.settle

    def settle(frame):
        settled.append(keep(frame))
        return settled[-1]

    monkeypatch.setattr(neighbours, "settle", settle)
    monkeypatch.setattr(neighbours, "LEAF", 30)
    got = neighbours.search(df, "vec_id % 20 = 0", 20).toPandas()
    routes = [f for f in settled if "q" in f.columns]
    assert [f.count() for f in routes] == [150]
    assert {r[0] for r in routes[0].select(F.octet_length("q")).collect()} == {4 * 24}
    y, hits = x.astype(float), 0
    for q in range(0, len(x), 20):
        mine = got[got.query_id == q].sort_values("rank")
        score = (y * y[q]).sum(axis=1)
        assert mine.score.tolist() == score[mine.vec_id].tolist() and len(mine) == 20
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20]) & set(mine.vec_id))
    assert hits >= 0.9 * len(got)


def test_neighbours_of_many_visits_come_once(spark, monkeypatch):
    """Where most leaves are visited, tiles are compared whole, twice for some queries: no neighbour takes two ranks."""
    rnd = np.random.default_rng(11)
    x = rnd.normal(size=(4000, 32)).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(neighbours, "LEAF", 60)
    got = neighbours.search(df, "vec_id % 20 = 0", 20).toPandas()
    assert len(got) == 200 * 20 and not got.duplicated(["query_id", "vec_id"]).any()
    score = x[::20].astype(float) @ x.T.astype(float)
    score[np.arange(200), np.arange(0, 4000, 20)] = -np.inf
    best = {(20 * q, v) for q, row in enumerate(np.argsort(-score)[:, :20].tolist()) for v in row}
    assert len(best & set(zip(got.query_id, got.vec_id))) >= 0.94 * len(best)


def test_best_of_equal_vectors_in_pieces(monkeypatch):
    monkeypatch.setattr(neighbours, "PIECE_VALUES", 40)
    x = np.vstack([np.ones((50, 4)), np.full((3, 4), 2.0)])
    ids, asks = np.arange(53)[::-1], np.arange(7)
    seen = np.array([[True, j % 2 == 0] for j in range(7)])
    found = [np.concatenate(c) for c in zip(*neighbours._best(asks, np.ones((7, 4)), ids, x, 5, None, seen, np.array([0, 50, 53])), strict=True)]
    for j in range(7):
        mine = [(float(s), int(ids[a])) for a, s in zip(found[1][found[0] == j], found[2][found[0] == j], strict=True)]
        assert mine == sorted(((4.0 * (1 + (i < 3)), i) for i in range(53) if i != j), key=lambda t: (-t[0], t[1]))[:5]
