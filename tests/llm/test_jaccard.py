import random
import re

import numpy as np
import pyarrow as pa
import pytest

from weftgraph.llm import jaccard, shingles
from weftgraph.llm.components import components
from weftgraph.operators import unionfind

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_set(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(i)] = find(j)
    groups = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            groups[find(k)] = min(groups.get(find(k), i), i)
    return sorted(((i, len(s), groups.get(find(k))) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def variants(rnd, base, n, edits):
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randrange(edits + 1)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
        yield " ".join(w)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    texts = [None, "", " \t\n", "one", "ONE", "a b c d", "A b  c d", "a b c d e", "a b c d f"]
    for _ in range(6):
        base = [rnd.choice(words) for _ in range(rnd.choice([6, 30, 80, 150, 300]))]
        texts += variants(rnd, base, 25, 5)
    passage = " ".join(rnd.choice(words) for _ in range(60))
    texts += [" ".join(rnd.choice(words) for _ in range(rnd.randrange(5, 60))) + " " + passage for _ in range(40)]
    texts += [texts[20]] * 30
    rnd.shuffle(texts)
    return [(k, t) for k, t in enumerate(texts)] + [(3, texts[3])]


def test_agrees_with_all_pairs(spark, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 7)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string").repartition(5)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()), key=str)
    assert got == brute(rows)


def test_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (7, "A b c d e f"), (5, "x"), (None, "y"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 2, 7), (7, 2, 7), (5, 1, 5), (None, 1, None), (None, 0, None)], key=str)
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_ids_bridge_others(spark):
    words = [f"w{k}" for k in range(100)]
    rows = [(5, " ".join([*"abcdefgh", *words[8:]])), (None, " ".join(words)), (9, " ".join([*words[:-8], *"abcdefgh"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()), key=str)
    assert got == brute(rows) == [(5, 96, 5), (9, 96, 5), (None, 96, 5)]
    assert [r.doc_id for r in jaccard.keep_first(docs).collect()] == [5]


def test_ids_of_any_type_and_ids_with_several_texts(spark):
    one, other = "the cat sat on the mat all day", "a dog ran off with the best hat of them"
    docs = spark.createDataFrame([("b", one, 1), ("a", other, 2), ("a", one, 3), ("c", other, 4), ("a", one, 5)], "doc_id string, text string, _row int")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()) == [("a", 4, "a"), ("a", 4, "a"), ("a", 6, "a"), ("b", 4, "a"), ("c", 6, "a")]
    assert sorted(tuple(r) for r in jaccard.keep_first(docs).collect()) == [("a", other, 2), ("a", one, 3)]


@pytest.mark.parametrize("hot", [2, 50])
def test_hot_lists_in_parts_and_blocks(spark, monkeypatch, hot):
    """A third of all rows are near copies, in lists of many parts; another text of theirs differs more."""
    monkeypatch.setattr(jaccard, "CHUNK", 4)
    monkeypatch.setattr(jaccard, "HOT", hot)
    rnd = random.Random(8)
    base = [f"b{k}" for k in range(120)]
    texts = list(variants(rnd, base, 60, 4)) + list(variants(rnd, base[:100], 30, 6)) + list(variants(rnd, base[40:], 30, 6))
    texts += [" ".join(f"o{rnd.randrange(10**6)}" for _ in range(40)) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(texts)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()), key=str)
    assert got == brute(rows)


def test_suffix_filter_never_overstates():
    rnd = np.random.default_rng(3)
    for _ in range(300):
        x, y = (np.unique(rnd.integers(0, 60, rnd.integers(0, 40))).astype(np.uint64) for _ in range(2))
        differ = len(np.setxor1d(x, y))
        assert jaccard._apart(x, y, 10**6) <= differ
        assert jaccard._apart(x, y, differ) <= differ


def test_shingles_of_long_and_odd_texts(monkeypatch):
    monkeypatch.setattr(shingles, "PIECE", 64)
    rnd = random.Random(2)
    texts = [None, "", "x" * 500] + [" ".join(rnd.choice(["a", "Bb", "cé", "d" * 90]) for _ in range(rnd.randrange(40))) for _ in range(60)]
    names = {}
    for t, s in zip(texts, shingles.sets_of(pa.array(texts, pa.string())), strict=True):
        want = brute_set(t)
        assert len(s) == len(want) and (s[1:] > s[:-1]).all()
        assert names.setdefault(frozenset(want), s.tobytes()) == s.tobytes()


def test_parity_bounds_the_difference():
    rnd = np.random.default_rng(1)
    for n in (3, 100, 700, 5000):
        x = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: n - n // 5], rnd.integers(0, 2**63, n // 10).astype(np.uint64)]))
        differ = len(np.setxor1d(x, y))
        a, b = (np.frombuffer(shingles.parity(s), np.uint8)[None] for s in (x, y))
        if a.shape[1] > b.shape[1]:
            a = shingles.fold(a)
        assert np.bitwise_count(a ^ b).sum() <= differ


@pytest.mark.parametrize("finish", [1 << 20, 40, 0])
def test_components(spark, monkeypatch, finish):
    monkeypatch.setattr(unionfind, "FINISH", finish)
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)] + [(500, 500), (1, 2), (2, 1)]
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    assert {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == root
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
