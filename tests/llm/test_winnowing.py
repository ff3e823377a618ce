"""Winnowing against a brute-force version."""

import hashlib
import re

import pytest

from sonoquery.llm import winnowing
from sonoquery.llm.queries import op7_winnowing


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]{1,%d}" % winnowing.PIECE, text or "")
    return [tuple(words[i : i + winnowing.K]) for i in range(max(1, len(words) - winnowing.K + 1))] if words else []


def check_positions(text, parts):
    """The positions must be those that the windows choose by the hashes of all grams."""
    g = grams(text)
    kept = {p.position: p.hash for p in parts}
    value = {}
    for p, h in kept.items():
        assert value.setdefault(g[p], h) == h  # equal grams have equal hashes
    for i in range(max(1, len(g) - winnowing.W + 1) if g else 0):
        window = range(i, min(len(g), i + winnowing.W))
        chosen = [p for p in window if p in kept]
        assert chosen, "each window keeps a hash"
        least = min(kept[p] for p in chosen)
        # no gram that stands right of the smallest kept one equals it unless it is kept too
        best = max(p for p in chosen if kept[p] == least)
        assert all(g[p] != g[best] for p in window if p > best)
    return kept


def test_positions_and_ties(spark):
    texts = [None, "", "  ", "one", "a b c", "a b c d", "a " * 50, "the cat sat on the mat " * 7, " ".join(str(i * i % 97) for i in range(400)), "x" * 200 + " y"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, _words int")
    rows = winnowing.with_fingerprint(df, df.text, "fp").withColumn("parts", winnowing.parts(winnowing.F.col("fp"))).collect()
    by_gram = {}
    for r in rows:
        kept = check_positions(r.text, r.parts)
        assert (not kept) == (not grams(r.text))
        for p, h in kept.items():
            assert by_gram.setdefault(grams(r.text)[p], h) == h
    assert len(set(by_gram.values())) == len(by_gram)


@pytest.mark.parametrize("rows", [3, 2000])
def test_query(spark, monkeypatch, rows):
    monkeypatch.setattr(winnowing.with_bucket, "__defaults__", (rows,))
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    got = {r.doc_id: r for r in op7_winnowing(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    prints = {}
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        row = got[i]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, row.fingerprint) == row.fingerprint
        assert prints.setdefault(edited, row.edited_fingerprint) == row.edited_fingerprint
        assert 0 <= row.near_next <= 1 and 0 <= row.near_edited <= 1
        if len(text) > 1000 and text != after:
            assert row.near_edited > 0.4 > row.near_next or len(set(grams(text))) < 100
        if text == after:
            assert row.near_next == 1


def test_nulls_ties_and_empty(spark):
    rows = [(1, None), (1, "same same"), (1, "same same"), (None, "no key at all here"), (5, ""), (9, "x")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, fingerprint_ string")
    got = winnowing.with_next(df).collect()
    assert sorted((r.doc_id or 0, r.following.text) for r in got) == [(0, ""), (1, ""), (1, "same same"), (1, "same same"), (5, "x"), (9, "no key at all here")]
    assert winnowing.with_next(df.where("false")).count() == 0
