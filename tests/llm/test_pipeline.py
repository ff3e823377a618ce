"""Stages of the pipeline against brute-force versions, each on its own input."""

import hashlib
import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from sonoquery.llm import mixing, quality_rules
from sonoquery.llm.frames import shared_dir
from sonoquery.llm.queries import vocabulary

from .test_line_dedup import brute_passages
from .test_minhash import brute as brute_near

DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Input of each stage and the last output, through Parquet as the driver does it."""
    folder = tmp_path_factory.mktemp("stages")
    frames = [spark.read.parquet(f"{DIR}/documents.parquet")]
    for name, stage in pipeline.STAGES:
        stage(spark, frames[-1], DIR).write.parquet(str(folder / name))
        frames.append(spark.read.parquet(str(folder / name)))
    return frames


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(steps):
    for df in steps[:-1]:
        assert df.columns == COLUMNS


def test_quality(spark, steps):
    before, after = texts(steps[0]), texts(steps[1])
    weights = quality_rules.fit(steps[0], quality_rules.trusted(spark.read.parquet(f"{DIR}/labels.parquet")))
    kept = {r.doc_id for r in quality_rules.verdicts(steps[0], weights).where("quality.kept").collect()}
    assert set(after) == kept and all(before[i] == t for i, t in after.items())
    good = {r.doc_id for r in spark.read.parquet(f"{DIR}/labels.parquet").where("quality = 1").collect()}
    bad = {r.doc_id for r in spark.read.parquet(f"{DIR}/labels.parquet").where("quality = 0").collect()}
    long = {i for i in good if len((before.get(i) or "").split()) >= 20}
    assert len(long & kept) >= 0.98 * len(long) and not bad & kept


def test_lines(steps):
    before, after = texts(steps[1]), texts(steps[2])
    wanted = {}
    for (i, _), (new, removed) in zip(sorted(before.items()), brute_passages(sorted(before.items())), strict=True):
        if not removed or new.strip():
            wanted[i] = new
    assert after == wanted
    assert all(r.n_chars == len(r.text) for r in steps[2].collect())


def test_lines_planted(spark):
    """Passages of 2 to 6 lines, over 50 words each, in texts that differ around them: the second copies go, all else stays."""
    rng = np.random.default_rng(5)
    line = lambda: " ".join(f"w{x}" for x in rng.integers(10**6, size=30))
    rows, wanted = [], {}
    for i in range(40):
        passage = [line() for _ in range(2 + i % 5)]
        for copy in range(2):
            head, tail = ([line() for _ in range(rng.integers(1, 9))] for _ in range(2))
            text = "\n".join([*head, *passage, *tail])
            rows.append((2 * i + copy, text, "en", "s", len(text)))
            wanted[2 * i + copy] = "\n".join([*head, *passage * (1 - copy), *tail])
    got = pipeline.lines(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), DIR)
    assert texts(got) == wanted and all(r.n_chars == len(r.text) for r in got.collect())


def test_near_duplicates(steps):
    before, after = texts(steps[2]), texts(steps[3])
    root, _ = brute_near(before, 5, 80)
    assert after == {i: t for i, t in before.items() if root[i] == i}


def test_mixing(steps):
    size = {r.doc_id: len(re.findall(mixing.WORD, r.text)) for r in steps[3].collect()}
    source = {r.doc_id: r.source for r in steps[3].collect()}
    taken = Counter(r.doc_id for r in steps[4].collect())
    whole, words = Counter(), Counter()
    for i, n in size.items():
        whole[source[i]] += n
        words[source[i]] += n * taken[i]
    targets, names = {s: 0.0 for s in whole}, sorted(whole)
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    rest, free = 1.5 * sum(whole.values()), set(names)
    while True:
        level = rest / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * level > 2 * whole[s]}
        if not above:
            break
        for s in above:
            targets[s] = 2.0 * whole[s]
            rest -= targets[s]
        free -= above
    targets |= {s: weight[s] * level for s in free}
    for s in names:
        assert abs(words[s] - targets[s]) <= max(size[i] for i in size if source[i] == s)
    assert max(taken.values()) <= 2


def test_bpe(steps):
    library = Tokenizer.from_file(vocabulary())
    before = sorted((r.doc_id, r.text) for r in steps[4].collect())
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, bytes(r.ids)) for r in steps[5].collect())
    wanted = []
    for i, text in before:
        packed = np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        wanted.append((i, len(packed) // 4, hashlib.sha256(packed).hexdigest(), packed))
    assert got == sorted(wanted)


def test_run_and_odd_rows(spark, steps, tmp_path):
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    assert pipeline.run(spark, DIR).count() == steps[5].count()
    new = [x for x in set(os.listdir(folder)) - before if x.startswith("sonoquery-")]
    assert len(new) <= len(pipeline.STAGES), new  # results of stages, and nothing written on their way
    base = steps[0].limit(30)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "some words that stand here more than ten of them in a row", None, None, None), (None, "", "en", "s", 0), (7, None, "en", None, 3)], base.schema)
    for rows in (base.unionByName(odd).unionByName(odd), base.where("false")):
        docs = rows.withColumn("quality", F.lit(1)).withColumn("lines", F.lit("c"))
        for k, (name, stage) in enumerate(pipeline.STAGES):
            path = str(tmp_path / f"{rows.count()}-{name}")
            stage(spark, docs, DIR).write.parquet(path)
            docs = spark.read.parquet(path)
            if k < 4:
                assert docs.columns == [*COLUMNS, "quality", "lines"]
