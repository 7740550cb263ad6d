import hashlib
import random
import zlib

import pytest

from weftgraph.llm import bpe, media, queries

TEXTS = [None, "", " ", "The the THE ththe!", "x" * 3000, "'s don't WE'LL 12 ²½ é́ ﬁ Σας İstanbul", "a<|endoftext|>b <|startoftext|>", "tab\tnew\nline nbsp\u0085", "漢字 한글 😀", "The the THE ththe!"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "clash") for k, t in enumerate(TEXTS)] + [(None, "null id", "x")], "doc_id long, text string, n_tokens string")


def test_encode_agrees_with_the_library(docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.vocabulary_path())
    model = bpe.build(docs, queries.vocabulary_path(), n=5)
    rows = {r.doc_id: r for r in bpe.encode(docs, model, with_ids=True, with_text=True).collect()}
    assert len(rows) == len(TEXTS) + 1
    for k, t in [*enumerate(TEXTS), (None, "null id")]:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        assert rows[k].ids == ids and rows[k].n_tokens == len(ids) and rows[k].decoded == decoded
        assert rows[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[k].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_encode_fuzz():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.vocabulary_path())
    vocab = bpe.Vocabulary(queries.vocabulary_path())
    words = [b"the", b"tion", b"thetion", b"a"]
    enc = bpe.Encoder(vocab, bpe.Lexicon.compile(words, vocab.merge(words)))
    rnd = random.Random(3)
    alphabet = [chr(c) for c in range(0x180)] + ["the", "tion", " ", " ", "'re", "<|endoftext|>", "Σ", "ß", "́", " "]
    for _ in range(400):
        t = "".join(rnd.choice(alphabet) for _ in range(rnd.choice([2, 20])))
        assert [i for part in enc.encode(t) for w in part for i in w[3]] == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_texts_longer_than_a_piece(docs, spark, monkeypatch):
    """A batch of texts, one of them in many pieces, is what the library makes of each."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.vocabulary_path())
    vocab = bpe.Vocabulary(queries.vocabulary_path())
    rnd = random.Random(4)
    texts = ["", " ".join(rnd.choice(["the", "thé", "x" * 60, "Ωmega", "9", "<|endoftext|>"]) for _ in range(300)), "of the", " \n", "tail"]
    monkeypatch.setattr(bpe, "PIECE", 50)
    enc = bpe.Encoder(vocab, bpe.Lexicon.compile([b"the"], vocab.merge([b"the"])))
    got = [[[], [], []] for _ in texts]
    for k, ids, numbers, tokens in enc.batch(texts):
        for x, part in zip(got[k], (ids.tolist(), [bytes(numbers).decode()], [bytes(tokens).decode()]), strict=True):
            x += part
    for t, (ids, numbers, tokens) in zip(texts, got, strict=True):
        want = lib.encode(t, add_special_tokens=False).ids
        assert ids == want and "".join(numbers) == "".join(f"{i} " for i in want)
        assert "".join(tokens)[:-1] == lib.decode(want, skip_special_tokens=False)


def test_frequent_words_counts_every_text(spark, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "PIECE", 8)
    docs = spark.createDataFrame([("a a b c d e f <|endoftext|>",), ("a b b <|endoftext|> g",), (None,), ("d d",)], "text string").repartition(2)
    assert bpe.frequent_words(docs, bpe.Vocabulary(queries.vocabulary_path())) == ["a", "b", "d"]


def test_lexicon_is_minimal_and_total():
    words = [b"tap", b"taps", b"top", b"tops", b"s"]
    block = bpe.Lexicon.compile(words, [(k, k + 10) for k in range(5)])
    lex = bpe.Lexicon(block)
    assert [lex.row(k) for k in lex.find(words)] == [(k, k + 10) for k in range(5)]
    assert lex.find([b"", b"ta", b"tapss", b"x", b"t" * 100]).tolist() == [-1] * 5
    assert len(lex.final) == 5  # "ap(s)" and "op(s)" share their states
    assert bpe.Lexicon(bpe.Lexicon.compile([], [])).find([b"a"]).tolist() == [-1]


def test_bpe_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(docs, bpe.build(docs, queries.vocabulary_path())).count() == 0


def test_media_round_trip(docs):
    rows = {r.doc_id: r for r in media.round_trip(docs).collect()}
    for k, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = rows[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert rows[3][1:] == rows[9][1:]


def test_media_lengths_and_damage():
    for n in (*range(64, 1000, 64), 4096, 4160, 32768, 32832, 300_032):
        payload = random.Random(n).randbytes(n)
        m = media.mux(payload)
        s = media.demux(m)
        assert s.payload == payload and len(m) % 188 == 0
        assert [u[0] for u in s.units] == [k * media.TICKS for k in range(len(s.units))]
        assert [u[3] for u in s.units] == [k % media.KEY == 0 for k in range(len(s.units))]
    for bad in (m[:-188], m[:-1], m[:400] + m[588:], b"x" + m[1:], m[:20] + b"\xaa" + m[21:]):
        with pytest.raises(media.MediaError):
            media.demux(bad)


def test_media_columns(docs, spark):
    stored = media.store(docs.select("doc_id", "text"))
    assert {r.doc_id: media.demux(r.media).payload.rstrip(b"\0").decode() for r in stored.collect()}[5] == TEXTS[5]
    u = media.units(stored, "doc_id")
    assert u.count() == len(TEXTS) + 1 and u.filter("random_access and pts = 0").count() == len(TEXTS) + 1
    assert media.units(spark.createDataFrame([(1, None)], "k int, media binary"), "k").count() == 0
    assert media.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0
