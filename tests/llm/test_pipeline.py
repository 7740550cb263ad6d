import duckdb
import pytest

import corpus_pipeline
from weftgraph.llm import jaccard, language, mixing, quality

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], DATA).write.parquet(f"{top}/{k}")
        out.append(spark.read.parquet(f"{top}/{k}"))
    return out


def test_columns_and_decisions(steps):
    docs, known, good, single, mixed, coded = steps
    assert all(d.columns == docs.columns for d in (known, good, single, mixed))
    ids = lambda d: sorted(r[0] for r in d.select("doc_id").collect())
    # documents without a letter go, and nothing that is in a language
    gone = set(ids(docs)) - set(ids(known))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(sum(c.isalpha() for c in texts[i]) < 0.5 * len(texts[i]) for i in gone)
    assert set(ids(good)) <= set(ids(known)) and len(ids(good)) > 0.8 * len(ids(known))
    rows = jaccard.near_duplicates(good).collect()
    assert ids(single) == sorted({r.component_id for r in rows})
    plan = {r.doc_id: r.copies for r in mixing.copies(single).collect()}
    assert ids(mixed) == sorted(i for i, n in plan.items() for _ in range(n))
    assert ids(coded) == ids(mixed) and coded.filter("size(ids) <> n_tokens").isEmpty()


def test_good_documents_stay(steps, spark):
    labels = f"'{DATA}/labels.parquet'"
    good = {r[0] for r in duckdb.sql(f"select doc_id from {labels} where quality = 1").fetchall()}
    bad = {r[0] for r in duckdb.sql(f"select doc_id from {labels} where quality = 0").fetchall()}
    before = {r[0] for r in steps[1].select("doc_id").collect()}
    after = {r[0] for r in steps[2].select("doc_id").collect()}
    assert len(good & before - after) <= 0.02 * len(good & before)
    assert len(bad & after) <= 0.2 * len(bad & before)


def test_run_is_the_stages_one_after_the_other(steps, spark):
    assert sorted(corpus_pipeline.run(spark, DATA).select("doc_id", "ids_sha256").collect()) == sorted(steps[-1].select("doc_id", "ids_sha256").collect())


SCHEMA = "doc_id long, text string, lang string, source string, quality int, score double"
ODD = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 1, 0.0),
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 1, 0.0),
    (2, None, None, None, None, None),
    (None, "", "en", None, 0, None),
    (3, "%%% ### 123", "fr", "b", 0, 1.0),
    (None, "the quick brown fox jumps over the lazy dog again and again", None, "a", 1, 2.0),
    (4, "le chat noir dort sur le canapé rouge " * 1000, "fr", "b", 1, 3.0),
]


def test_stages_on_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    model = language.fit(docs, docs.doc_id.isNotNull())
    got = {(r.doc_id, r.lang_pred) for r in language.predict(docs, model).collect()}
    assert {(2, "und"), (None, "und"), (3, "und"), (4, "fr"), (1, "en")} <= got
    assert {r.doc_id for r in language.keep_known(docs, model).collect()} >= {1, 4}
    ens = quality.fit(docs, docs.select("doc_id", "quality"), docs.doc_id.isNotNull())
    rows = quality.score(docs, ens).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    kept = [tuple(r)[:2] for r in jaccard.keep_first(docs).collect()]
    assert sorted(k[0] for k in kept if k[0] is not None) == [1, 2, 3, 4] and (None, "") in kept and len(kept) == 5
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    empty = docs.limit(0)
    assert language.predict(empty, language.fit(empty, empty.doc_id.isNotNull())).count() == 0
    assert quality.score(empty, quality.fit(empty, docs.select("doc_id", "quality").limit(0), empty.doc_id.isNotNull())).count() == 0
    assert mixing.mix(empty).count() == 0 and mixing.copies(empty).count() == 0
    assert jaccard.keep_first(empty).count() == 0
