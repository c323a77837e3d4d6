import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from textloom.llm import bpe, packing

SCHEMA = "doc_id long, text string, lang string, ids string"
ODD = [
    "Hello, WORLD's  café́ ΣΑΣ İx <|endoftext|>it's <|EndOfText|> a\x1cb　c",
    "", None, "  ", "x" * 5000, "ab'll12345 $$$%%% ñandú" * 50, "日本語のテキスト🙂🙂 ȩ́", "same", "same",
    "".join(np.random.default_rng(1).choice(list("abcdeéthinrsou"), 4000)),
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_encode_decode(spark, library):
    df = spark.createDataFrame([(i, t, "en", "x") for i, t in enumerate(ODD)], SCHEMA)
    got = {r.doc_id: r for r in bpe.encode_decode(df).collect()}
    for i, t in enumerate(ODD):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids
        assert got[i].decoded.decode() == library.decode(ids, skip_special_tokens=False)


def test_stream_is_stable_and_bounded(library):
    e = bpe.encoder()
    for seed in range(20):
        rng = np.random.default_rng(seed)
        text = "".join(rng.choice(list("aeinorstth"), 3000))
        whole = library.encode(text, add_special_tokens=False).ids
        assert list(e.stream([text[i : i + 37].encode() for i in range(0, 3000, 37)])) == whole


def test_texts_in_parts(spark, library, monkeypatch):
    """Texts cut into small parts, in groups of a few letters, give the same tokens, names and plain text."""
    monkeypatch.setattr(bpe, "PART", 5)
    e = bpe.encoder()
    texts = [t for t in ODD if t is None or len(t) < 4500] + ["a \u0301b <|endoftext|> ΣΑΣ\u2003Σ  x\x1cy z", "日本 語🙂 🙂 ok"]
    assert ["".join(e.parts_of(t or "")) for t in texts] == [t or "" for t in texts] and len(list(e.parts_of(texts[-2]))) > 2
    for most in (1, 20, 10**6):
        made = [bpe._Whole(e) for _ in texts]
        for i, ids in e.transduce(texts, most):
            made[i].take(ids)
        for t, m in zip(texts, made, strict=True):
            want = library.encode(t or "", add_special_tokens=False).ids
            ids, said, plain = m.row()
            told = bpe._Digest(e)
            for _, part in e.transduce([t], most):
                told.take(part)
            assert told.row() == (*bpe._digest(ids, said), len(plain))
            assert np.frombuffer(ids, "<u4").tolist() == want
            assert said.decode() == library.decode(want, skip_special_tokens=False)
            one = bpe.TextMachine(e)
            assert plain == "".join(map(one.feed, want)) + one.end()


def test_query_equals_the_library(spark, library):
    """The query's own rows over a whole table."""
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in bpe.query(spark, sf).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_text_machine():
    e = bpe.encoder()
    m = bpe.TextMachine(e)
    ids = np.frombuffer(e.encode(["café 🙂 ok"])[0], "<u4").tolist()
    assert ("".join(map(m.feed, ids)) + m.end()).split() == ["café", "🙂", "ok"]


def test_pack_against_brute_force(spark, library):
    df = spark.createDataFrame([(i, t, "en", "x") for i, t in enumerate(ODD)], SCHEMA).repartition(3)
    rows = packing.pack(df, length=64).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(ODD):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert [x for p in pieces for x in np.frombuffer(p.ids, "<u4")] == ids
        assert {p.doc_tokens for p in pieces} == {len(ids)}
    for k, pieces in by_seq.items():
        at = 0
        for p in sorted(pieces, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at == 64 or k == max(by_seq)
    digest = {(r.doc_id, r.start): r.ids_crc32 for r in packing.digest(packing.pack(df, length=64)).collect()}
    assert all(digest[r.doc_id, r.start] == zlib.crc32(r.ids) for r in rows)


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert bpe.encode_decode(df).count() == 0 and packing.pack(df).count() == 0


def test_digest_columns(spark):
    e = bpe.encoder()
    ids = e.encode(["a b"])[0]
    assert bpe._digest(ids, e.decode(ids)) == (2, hashlib.sha256(ids).hexdigest(), hashlib.sha256(b"a</w> b</w>").hexdigest())
