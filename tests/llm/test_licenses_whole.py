import random
import re

from weftgraph.llm import licenses


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.doc_id, r.license): (r.dice, r.matches) for r in licenses.scan(df).collect()}


def test_long_candidates_that_repeat_themselves(spark):
    got = found(spark, ["Released under the MIT License. " * 40])
    assert set(got) == {(0, "MIT")} and got[0, "MIT"][0] >= 8 / 9


def test_notices_that_share_their_line(spark):
    whole = licenses.TEMPLATES["ISC"][0]
    words = "".join(f"w{k} " for k in range(150))
    got = found(
        spark,
        [
            "Copyright 2020 Foo. Licensed under the MIT License.",
            words + "as is licensed under the MIT license, " + words,
            words + whole + " " + words + whole.replace("granted", "given") + words,
            words + "under the licence of the software for any purpose",
            "Licensed under CC BY-NC 4.0. See Foo; it is licensed under the MIT License and no other.",
        ],
    )
    assert got == {(0, "MIT"): (1.0, 1), (1, "MIT"): (1.0, 1), (2, "ISC"): (1.0, 2), (4, "MIT"): (1.0, 1), (4, "CC-BY-NC-4.0"): (1.0, 1)}


def test_runs_agree_with_all_windows(spark):
    rnd = random.Random(3)

    def grams(t):
        w = re.findall("[0-9a-z]+", t.lower())
        return [" ".join(p) for p in zip(w, w[1:])]

    known = [(name, set(grams(t))) for name, ts in licenses.TEMPLATES.items() for t in ts]
    texts = []
    for _ in range(25):
        w = [rnd.choice(["foo", "bar", "the", "license"]) for _ in range(30)]
        for _ in range(2):
            t = rnd.choice([t for ts in licenses.TEMPLATES.values() for t in ts if len(t) < 130]).split()
            for _ in range(rnd.randrange(3)):
                t[rnd.randrange(len(t))] = rnd.choice(["foo", "the", "work"])
            k = rnd.randrange(len(w))
            w[k:k] = t
        texts.append(" ".join(w))
    want = {}
    for i, text in enumerate(texts):
        g = grams(text)
        for name, t in known:
            best = max(2 * len(t & s) / (len(s) + len(t)) for a in range(len(g)) for b in range(a + 1, min(len(g), a + 3 * len(t) // 2) + 1) if (s := set(g[a:b])))
            if best >= 0.8:
                want[i, name] = max(best, want.get((i, name), 0))
    got = {k: v[0] for k, v in found(spark, texts).items()}
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
    # a licence is left out only where a better run of another overlaps it
    assert {i for i, _ in got} == {i for i, _ in want} and all(max(v for (j, _), v in got.items() if j == i) == max(v for (j, _), v in want.items() if j == i) for i, _ in got)


def test_no_templates_odd_rows_and_clashing_names(spark):
    schema = "doc_id long, text string, license string, n int"
    rows = [(1, "Licensed under the MIT License.", "x", 1), (1, "Licensed under the MIT License.", "y", 2), (None, "Licensed under the MIT License.", None, None), (2, None, "z", 3), (3, "", "z", 3), (4, "w " * 50_000 + "Licensed under the MIT License.", "z", 3)]
    df = spark.createDataFrame(rows, schema)
    got = {(r.doc_id, r.license, r.dice, r.matches) for r in licenses.scan(df).collect()}
    assert {(i, name) for i, name, _, _ in got} == {(1, "MIT"), (None, "MIT"), (4, "MIT")}
    assert licenses.scan(df, {}).count() == licenses.scan(df, {"x": ["one"]}).count() == licenses.scan(df.limit(0)).count() == 0
    # equal templates: the first one's licence
    assert {r.license for r in licenses.scan(df, {"B": ["Licensed under the MIT License."], "A": ["licensed under the mit license"]}).collect()} == {"B"}


def test_agrees_with_the_sql(spark):
    import duckdb

    rnd = random.Random(6)
    names = [t for ts in licenses.TEMPLATES.values() for t in ts if len(t) < 300]
    texts = []
    for _ in range(40):
        parts = []
        for _ in range(rnd.randrange(1, 6)):
            t = rnd.choice(names).split()
            for _ in range(rnd.randrange(4)):
                t[rnd.randrange(len(t))] = rnd.choice(["foo", "the", "license.", "bar"])
            parts.append(" ".join(t) + rnd.choice(["", ".", "!"]))
        texts.append("".join(p + rnd.choice([" ", "\n", "\n \n", ". "]) for p in parts))
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    want = {(i, name): (round(dice, 9), n) for i, name, dice, n in con.sql(licenses.oracle()).fetchall()}
    assert {k: (round(v[0], 9), v[1]) for k, v in found(spark, texts).items()} == want
