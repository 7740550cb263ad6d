import random
import zlib

import pytest

from weftgraph.llm import mixing, sharding, urls


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > cap * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(1)
    rows = []
    for k in range(900):
        source = rnd.choice(["a", "a", "a", "B", "c", "é", None, "z"])
        rows.append((k if k % 50 else None, " ".join("w" for _ in range(rnd.choice([0, 1, 5, 40, 200]))) if k % 31 else None, source, 1))
    rows += [(7, "w w w", "a", 1)] * 40 + [(2000, "", "empty", 1), (2001, None, "empty", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int")


def test_mix_meets_its_targets(docs):
    rows = mixing.copies(docs).collect()
    assert len(rows) == docs.count()
    sizes, taken, largest, target = {}, {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.size * r.copies
    want = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    again = mixing.copies(docs.repartition(7)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_mix_takes_as_planned(docs):
    n = sum(r.copies for r in mixing.copies(docs).collect())
    assert mixing.mix(docs).count() == n and mixing.mix(docs).columns == docs.columns


def test_mix_keeps_columns_of_any_name_and_shares_copies(spark):
    rows = [(k, "w " * (k % 9 + 1), "ab"[k % 2], f"k{k}", True, k) for k in range(60)]
    rows += [(99, "x y z", "a", v, False, 0) for v in ("p", "p", "q", "r")] + [(None, None, None, None, None, None)]
    schema = "doc_id long, text string, source string, _k string, _id boolean, _n long"
    df = spark.createDataFrame(rows, schema)
    got = [tuple(r) for r in mixing.mix(df).collect()]
    plan = [(r.doc_id, r.copies) for r in mixing.copies(df).collect()]
    assert set(got) <= set(rows)
    for i in {r[0] for r in rows}:
        assert sum(r[0] == i for r in got) == sum(n for j, n in plan if j == i)
    times = [sum(r[3] == v and r[0] == 99 for r in got) / n for v, n in (("p", 2), ("q", 1), ("r", 1))]
    assert max(times) - min(times) <= 1
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in mixing.mix(df.repartition(5)).collect())


def test_mix_numbers_rows_that_repeat(spark, monkeypatch):
    monkeypatch.setattr(mixing, "REPEATS", 7)
    df = spark.createDataFrame([(1, "w w w", "a")] * 500 + [(2, "w", "b")] * 30, "doc_id long, text string, source string")
    rows = mixing.copies(df).collect()
    assert len(rows) == 530
    for s in "ab":
        assert abs(sum(r.taken for r in rows if r.source == s) - next(r.target for r in rows if r.source == s)) <= 1.5
    assert mixing.mix(df).count() == sum(r.copies for r in rows)


def jump(key, n):
    key %= 1 << 64
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_jump_hash_by_definition(spark):
    rnd = random.Random(2)
    keys = [0, 1, -1, 2**63 - 1, -(2**63)] + [rnd.randrange(-(2**63), 2**63) for _ in range(200)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 8, 9, 100):
        assert {r.k: r.s for r in df.select("k", sharding.jump_hash(df.k, n).alias("s")).collect()} == {k: jump(k, n) for k in keys}


def test_shards(spark):
    rows = [(k, f"t{k % 7}é") for k in range(300)] + [(None, None), (None, None), (5, "t5é")]
    got = sharding.shard(spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, shard int"), 8).collect()
    assert len(got) == len(rows)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    text = dict(rows)
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r.shard == jump(r.doc_id or 0, 8) and r.grown_shard in (r.shard, 8)
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shards_of_ids_of_any_type_and_rows_that_repeat(spark):
    rows = [(f"id{k}", f"t{k}") for k in range(200)] + [("again", "x")] * 25_000 + [(None, "x")] * 3
    got = sharding.shard(spark.createDataFrame(rows, "doc_id string, text string"), 8).collect()
    assert len(got) == len(rows) and len({r.shard for r in got}) == 8
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert len({r.shard for r in got if r.doc_id == "again"}) == 1 and all(r.grown_shard in (r.shard, 8) for r in got)


def test_popular_urls_and_hosts_of_many_labels(spark):
    rows = [(k, "http://a.example.com/en/x") for k in range(3000)] + [(k, None) for k in range(3000, 4000)] + [(k, f"http://{'l.' * 2000}net/fr/{k}") for k in range(4000, 4004)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), urls.rule_table(spark, urls.RULES)).groupBy("rule", "verdict").count().collect()
    assert sorted(map(tuple, got), key=str) == [("example.com/en/", "block", 3000), ("net/fr/", "block", 4), (None, "allow", 1000)]
    none = urls.judge(spark.createDataFrame(rows[:2], "page_id long, url string"), urls.rule_table(spark, urls.RULES).limit(0)).collect()
    assert [tuple(r)[3:] for r in none] == [(None, "allow")] * 2


def test_urls(spark):
    cases = {
        None: ("", "", None, "allow"), "no scheme.com/en/": ("", "", None, "allow"), "http://": ("", "", None, "allow"),
        "http://X.com": ("x.com", "", None, "allow"), "http://x.com/": ("x.com", "/", "com/", "allow"),
        "https://example.com/en/1?q=/": ("example.com", "/en/1", "example.com/en/", "block"),
        "https://a.WWW.example.com/en/#x": ("a.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"), "http://x.net/es/": ("x.net", "/es/", "net/es/", "block"),
        "http://x.net/EN": ("x.net", "/EN", None, "allow"), "a://b://net/fr/": ("b:", "//net/fr/", None, "allow"), "http://é.net/fr/\n": ("é.net", "/fr/\n", "net/fr/", "block"),
    }
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate([*cases, *cases])], "page_id long, url string, host string")
    got = {r.page_id: tuple(r)[1:] for r in urls.judge(df, urls.rule_table(spark, urls.RULES)).collect()}
    assert got == dict(enumerate([*cases.values(), *cases.values()]))
    assert urls.judge(df.limit(0), urls.rule_table(spark, urls.RULES)).count() == 0


def test_many_rules_join_by_salt(spark, monkeypatch):
    monkeypatch.setattr(urls, "BROADCAST_ROWS", 2)
    df = spark.createDataFrame([(k, f"http://h{k % 5}.example.com/en/{k}") for k in range(50)], "page_id long, url string")
    assert {r.rule for r in urls.judge(df, urls.rule_table(spark, urls.RULES)).collect()} == {"example.com/en/"}
