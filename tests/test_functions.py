import random

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import scalar as fn


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


@pytest.mark.parametrize(("text", "want"), [("① Service", "1_service"), ("東京.Service", "東京_service"), ("", ""), ("HTTP Server!!", "http_server"), ("__a--b__", "a_b"), ("Straße", "strasse"), ("ﬁle", "file"), ("é", "é")])
def test_make_id(spark, text, want):
    assert one(spark, fn.make_id(F.lit(text))) == (want,)
    assert fn.make_id_text(text) == want


def test_ascii_ids_agree_with_the_general_rule(spark):
    rnd = random.Random(1)
    texts = ["".join(chr(rnd.randrange(32, 127)) for _ in range(rnd.randrange(12))) for _ in range(300)]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", fn.make_ascii_id(F.col("t")).alias("i")).collect():
        assert r.i == fn.make_id_text(r.t)


def test_jaro_winkler():
    assert fn.jaro_winkler_bytes("", "") == 1.0 and fn.jaro_winkler_bytes("a", "") == 0.0
    assert fn.jaro_winkler_bytes("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert fn.jaro_winkler_bytes("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)


def test_minhash_slots_differ_and_bands_match(spark):
    a, b = one(spark, fn.minhash(fn.shingles(F.lit("payment service"))), fn.minhash(fn.shingles(F.lit("payment service"))))
    assert a == b and len(set(a)) == 16
    assert len(set(one(spark, fn.lsh_bands(fn.minhash(fn.shingles(F.lit("ab")))))[0])) == 4


def test_text_rules(spark):
    assert one(spark, fn.lexical_terms(F.lit("parseHTTPRequest_v2 of parse")), fn.stem_term(F.lit("running")), fn.stem_term(F.lit("uses"))) == (["parse", "http", "request"], "runn", "uses")
    assert one(spark, fn.label_symbol(F.lit("run(int x)")), fn.slugify(F.lit("  A  b!! ")), fn.slugify(F.lit("!"))) == ("run", "a-b", "checkpoint")
    assert one(spark, fn.bounded_edit_distance(F.lit("kitten"), F.lit("sitting"), 2), fn.bounded_edit_distance(F.lit("kitten"), F.lit("sitting"), 5)) == (3, 3)
    assert one(spark, fn.normalize_sql_ident(F.lit('"Users"')), fn.normalize_sql_ident(F.lit("Users"))) == ("Users", "users")
    assert one(spark, fn.estimate_tokens(F.lit("é")), fn.shannon_entropy(F.lit("aabb")), fn.shannon_entropy(F.lit("éé"))) == (1, 1.0, 1.0)
    assert one(spark, fn.normal_path(F.lit("a/./b/../c")), fn.stem_of(F.lit("x/.env")), fn.stem_of(F.lit("x/a.b.c"))) == ("a/c", ".env", "a.b")
    assert one(spark, fn.path_suffixes(F.lit("a/b/c")))[0] == ["a/b/c", "b/c", "c"]
    assert one(spark, fn.fuzzy_merge_blocked(F.lit("abc"), F.lit("abcdef"), F.lit(0.99)), fn.fuzzy_merge_blocked(F.lit("abc"), F.lit("abc"), F.lit(1.0))) == (True, False)


def test_latency_buckets(spark):
    got = [one(spark, fn.latency_bucket(F.lit(float(x))))[0] for x in (0, 0.9, 1, 2, 1023, 1024, 9999)]
    assert got == [0, 0, 1, 2, 10, 11, 11]
