"""Columns of the input may have any name, the operators' own included."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sonoquery.llm import bpe, license_scan, line_dedup, minhash, mixing, pii, quality_classifier, quality_rules, winnowing
from sonoquery.llm.queries import vocabulary

NAMES = """_a _b _c _n _x _key _row _copy _copies _text _base _found _found_ _repeated _firsts _first _salt _hash _times _order _bucket
_before _start _part _passes _rest _position position _lead _after _own _print _words _grams _matches _q _s _weight c0 c1 c2 row n hash
times value node component id a b block copies size target taken turn license lines pii bpe quality score fingerprint following""".split()
DOCS = [(i, f"Line one of {i % 3}\nline two of it\n\nthe third one {i % 2} mail a{i}@b.com all rights reserved", "s" + str(i % 2)) for i in range(12)]


def dedup_near(docs):
    gone = minhash.near_duplicates(docs)
    assert gone.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return gone


OPERATORS = {
    "near": dedup_near,
    "lines": lambda docs: line_dedup.dedup(docs, passages=True),
    "mixing": mixing.training_order,
    "place": mixing.place,
    "winnowing": winnowing.with_next,
    "license": license_scan.scan,
    "pii": lambda docs: pii.pseudonyms(docs, "k"),
    "bpe": lambda docs: bpe.round_trip(docs, bpe.Model.read(vocabulary())),
    "quality": lambda docs: quality_rules.verdicts(docs, quality_rules.fit(docs, quality_rules.trusted(labels(docs)))),
    "classifier": lambda docs: quality_classifier.score(docs, quality_classifier.fit(docs, labels(docs))),
}
PASS = {"lines", "mixing", "winnowing", "license", "pii", "bpe", "quality", "classifier"}


def labels(docs):
    return docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(spark, name):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string")
    wide = docs.select("*", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in NAMES))
    rows = OPERATORS[name](wide)
    got = rows.collect()
    assert len(got) >= 1
    if name in PASS:
        assert rows.columns[: len(wide.columns)] == wide.columns
        for r in got:
            assert all(r[c] == f"{c}{r.doc_id}" for c in NAMES)


def test_stages(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string")
    wide = docs.select("*", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in NAMES))
    for stage in (corpus_pipeline.lines, corpus_pipeline.near_duplicates, corpus_pipeline.mix):
        rows = stage(spark, wide, "")
        assert sorted(rows.columns) == sorted(wide.columns)
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows.collect() for c in NAMES)
