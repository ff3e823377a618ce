"""Quality rules against a brute-force version; the classifier by held-out rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sonoquery.llm import quality_classifier, quality_rules
from sonoquery.llm.queries import op2_quality_rules, op4_quality_classifier
from sonoquery.llm.words import grams, hash_strings, mix

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def cells(text, buckets=quality_rules.BUCKETS):
    """Cells of a text's n-grams, one n-gram at a time."""
    pieces = [p for w in WORD.findall(text or "") for p in (re.findall(r"\w+|[^\w\s]+", w.lower()) or [w.lower()])]
    h = [hash_strings(pa.array([p])) for p in pieces]
    values = [mix(x)[0] for x in h] + [grams(np.concatenate([a, b]), 2)[0] for a, b in zip(h, h[1:], strict=False)]
    return [int(v) >> (64 - int(math.log2(buckets))) for v in values]


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{DIR}/labels.parquet").where("quality = 1").collect()}
    raw, target, own = Counter(), Counter(), {i: cells(t) for i, t in texts.items()}
    for i, c in own.items():
        raw.update(c)
        if i in good:
            target.update(c)
    share = sum(target.values()) / sum(raw.values())

    def ratio(cell):
        expected = raw[cell] * share
        return math.log((target[cell] + quality_rules.PRIOR * expected + quality_rules.EVIDENCE) / ((1 + quality_rules.PRIOR) * expected + quality_rules.EVIDENCE))

    rows = op2_quality_rules(spark, DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        *numbers, failed = base(texts[r.doc_id])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed] == [*numbers, failed]
        score = sum(map(ratio, own[r.doc_id])) / max(1, len(own[r.doc_id]))
        assert abs(r.llr - score) < 1e-9 and r.kept == (not failed and r.llr >= quality_rules.THRESHOLD)


def test_odd_rows(spark):
    texts = [None, "", " \n\t", "a b c d e a b c d e", "x\nx\nx \n\nx", "é" * 50, "w " * 30000, "a b c d e f a b c d e g", "!!! ??? " * 6]
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(None, "one two", None), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality string")
    weights = quality_rules.fit(df, spark.createDataFrame([(6,), (6,), (None,), (77,)], "doc_id long"))
    got = quality_rules.verdicts(df, weights).collect()
    assert len(got) == len(rows)
    for r in got:
        q = r["quality_"]
        *numbers, failed = base(r.text)
        assert [q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed] == [*numbers, failed]
    nothing = quality_rules.fit(df.where("false"), df.select("doc_id").where("false"))
    assert not nothing.any() and quality_rules.verdicts(df.where("false"), nothing).count() == 0


def test_classifier_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op4_quality_classifier(spark, folder).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    held = [(rows[i].score, y) for i, y in labels.items() if i in rows and rows[i].held_out]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in good for b in bad]) > 0.99
    assert np.mean([(s >= 0.3) == y for s, y in held]) > 0.95


def test_classifier_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "some text", 0.5), (4, "a b", 0.5), (4, "a b", 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, None), (None, 1), (4, 1)], "doc_id long, quality int")
    got = quality_classifier.score(docs, quality_classifier.fit(docs, labels)).collect()
    assert all(0 <= r["score_"] <= 1 for r in got) and len({r["score_"] for r in got if r.doc_id == 4}) == 1
    one_kind = quality_classifier.fit(docs, labels.where("quality = 1"))
    assert {r["score_"] for r in quality_classifier.score(docs, one_kind).collect()} == {0.5}
    assert quality_classifier.score(docs.where("false"), one_kind).count() == 0
    assert quality_classifier.fit(docs.where("false"), labels.where("false")).score(np.zeros((1, quality_classifier.DIMENSIONS)))[0] == 0.5
    scored = spark.createDataFrame([(i, i / 100) for i in range(101)], "doc_id long, score double")
    assert quality_classifier.at_quantile(scored, 0.25).where("kept").count() in range(74, 78)


def test_held_out_of_null(spark):
    assert spark.createDataFrame([(None,)], "i long").select(quality_classifier.held_out(F.col("i"))).first()[0] is False


def test_repeated_ids_bring_one_row_to_the_driver(spark, monkeypatch):
    """Of an id that most documents have, one text is learned from, whatever the order of rows."""
    from sonoquery.llm import quality_classifier as classifier

    docs = spark.range(3000).select(F.when(F.col("id") < 2900, 1).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("some words here "), F.col("id").cast("string"), F.lit(" and more of them")).alias("text"))
    labels = docs.select("doc_id").distinct().select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    seen = []
    real = classifier.learn
    monkeypatch.setattr(classifier, "learn", lambda x, y, **k: seen.append((x.copy(), np.array(y))) or real(x, y, **k))
    for parts in (1, 7):
        classifier.fit(docs.repartition(parts), labels)
    assert len(seen[0][1]) == 101 and (seen[0][0] == seen[1][0]).all() and (seen[0][1] == seen[1][1]).all()
