"""BPE against the library, over the driver's texts and random Unicode."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sonoquery.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Model.read(PATH))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def compare(encoder, library, texts):
    for text, got in zip(texts, encoder.texts(pa.array(texts, pa.string())).to_pylist(), strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got["ids"], "<u4").tolist() == ids, text
        assert got["decoded"] == library.decode(ids, skip_special_tokens=False), text


def test_random_unicode(encoder, library):
    rng = random.Random(1)
    pools = ["abcdefghij'strvemd ", "ÀÉîñßΣσςİıǅﬁ①½Ⅷ٣कि्", "̸́  \x1c\x1d\x85​　<>|", "日本語한국어😀👩‍👩‍👧\u0000\x01!@#$%^&*()_+", "0123456789  \n\t\r\x0b\x0c"]
    texts = []
    for _ in range(2000):
        text = "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 40)))
        if rng.random() < 0.2:
            text += rng.choice(["<|endoftext|>", "<|startoftext|>x", "a<|endoftext|><|endoftext|>b", "<|endoftext", "<|"]) + text
        texts.append(text)
    compare(encoder, library, texts)


def test_runs_and_long_words(encoder, library):
    compare(encoder, library, ["", " ", "a" * 5000, "ab" * 3001, "aaab" * 700 + "!" * 900, "the " * 4000, "THE ThE", "x" * 3 + "\n" * 50])


def test_documents_of_the_driver(encoder, library, spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    compare(encoder, library, [r.text for r in docs.select("text").collect()])


def test_frames(spark, library):
    model = bpe.Model.read(PATH)
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "Hello  wörld", "c"), (1, "Hello  wörld", "d")], "doc_id long, text string, bpe string")
    rows = bpe.round_trip(docs, model).collect()
    assert rows[2]["bpe_"] == rows[3]["bpe_"] and rows[2]["bpe_"]["decoded"] == library.decode(library.encode("Hello  wörld", add_special_tokens=False).ids)
    assert [len(r["bpe_"]["ids"]) for r in rows[:2]] == [0, 0]
    again = bpe.decode(bpe.round_trip(docs, model).selectExpr("bpe_.ids", "bpe_.decoded"), model).collect()
    assert all(r["decoded"] == r["decoded_"] for r in again)
    assert bpe.round_trip(docs.where("false"), model).count() == 0


def test_query(spark, library):
    from sonoquery.llm.queries import op9_bpe

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = op9_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_every_code_point(encoder, library):
    """Classes and case of all code points are those of the library, whatever ``regex`` and Python know."""
    codes = [c for c in (*range(0x32000), *range(0xE0000, 0xE0200)) if not 0xD800 <= c < 0xE000]
    texts = ["".join("a{0}b {0}1 A{0} {0}{0} !{0} ".format(chr(c)) for c in codes[i : i + 40]) for i in range(0, len(codes), 40)]
    library.no_truncation()
    for text, got, want in zip(texts, encoder.texts(pa.array(texts)).field("ids").to_pylist(), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == want.ids, text
