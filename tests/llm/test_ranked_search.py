"""Ranked search against scores of every document."""

import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sonoquery.llm import ranked_search as rs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=50):
    own = [(i, t) for i, x in docs if (t := terms(x))]
    total, length = len(own), sum(len(t) for _, t in own)
    df = {}
    for _, t in own:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for i, t in own:
            m = 100 - 50 + (50 * len(t) * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[x] + 1))) * ((1000000000 * t.count(x)) // (1000 * t.count(x) + 20 * m)) for x in set(terms(text)) if x in df)
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, more="", k=50):
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    if more:
        d, q = (x.select("*", *(F.lit(c).alias(c) for c in more.split())) for x in (d, q))
    return sorted((tuple(r) for r in rs.search(rs.build(d.repartition(3)), q, k=k).collect()), key=str)


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["é", "ÀB", "Zoë", "日本"]
    weights = [1 / (i + 1) for i in range(len(words))]
    topics = [rng.sample(words, 40) for _ in range(5)]
    text = lambda: rng.choice([" ", ", ", "\n"]).join(rng.choices(words, weights, k=rng.choice([1, 3, 20, 60])) + rng.choices(rng.choice(topics), k=rng.choice([0, 10, 30])))
    docs = [(i, text()) for i in range(n)]
    docs += [(i + n, docs[7][1]) for i in range(120)] + [(n + 200, None), (n + 201, ""), (n + 202, " .;- "), (None, docs[3][1]), (5, docs[5][1]), (n + 203, "w1 " * 30_000 + "W2.w3")]
    rng.shuffle(docs)
    items = [(i, text()) for i in range(20)] + [(20, docs[0][1]), (21, None), (22, ""), (23, "unknown words"), (3, "w1 w1 w1"), (24, "W1 é Zoë 日本")]
    return docs, items


def test_ranks(spark, monkeypatch):
    docs, items = corpus(1)
    want = brute(docs, items)
    assert run(spark, docs, items) == want
    monkeypatch.setattr(rs, "SHARD", 16)  # many shards, items in several blocks
    monkeypatch.setattr(rs, "ITEMS", 7)
    monkeypatch.setattr(rs, "GROUP", 50)
    assert run(spark, docs, items, "item doc part number terms tfs ids id n place rank score bound") == want
    assert run(spark, docs, items, k=3) == brute(docs, items, 3)


def test_empty_tables(spark):
    docs, items = corpus(2, 20)
    assert run(spark, [], items) == [] and run(spark, docs, []) == [] and run(spark, [(1, None)], items) == []
    assert run(spark, [(1, "a b"), (2, "a")], [(1, "a")]) == brute([(1, "a b"), (2, "a")], [(1, "a")])


def test_bounds_hold():
    """No document of a shard scores above the shard's bound, and most bounds are near."""
    docs, items = corpus(3)
    ids, ns, ts, fs = [], [], [], []
    for _, _, n, of, hashes, tf in rs.postings(pa.array([x for _, x in docs], pa.string())):
        for d in np.flatnonzero(n):
            ids.append(docs[d][0])
            ns.append(int(n[d]))
            ts.append(hashes[of == d])
            fs.append(tf[of == d])
    asked = rs._Asked([x for _, x in items], 50)
    df = {}
    for t in ts:
        for at in np.flatnonzero(np.isin(asked.terms, t)):
            df[int(at)] = df.get(int(at), 0) + 1
    asked.weigh(df, len(ids), sum(ns))
    for at in range(0, len(ids), 32):
        own = slice(at, at + 32)
        row = dict(zip(("n_docs", "n_terms", *rs._PARTS, "ids"), rs._shard(ids[own], ns[own], ts[own], fs[own])))
        bounds = asked.bounds(*rs._unpacked(row, "terms", "most", "ratio"))
        for item, scores in asked.scores(np.arange(asked.n), *rs._unpacked(row, "terms", "dfs", "lengths", "docs", "tfs")):
            assert scores.max() <= bounds[item]


def test_order_brings_topics_together():
    """Documents of two vocabularies end on different sides of the first split."""
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 80, 30) + 1000 * (i % 2)).astype(np.uint64) for i in range(200)]
    of = np.repeat(np.arange(200), [len(s) for s in sets])
    order = rs.Order(of, np.concatenate(sets), 200)
    leaf, _ = order.places(of, np.concatenate(sets), 200)
    sides = leaf // 2 ** (rs.DEPTH - 1)
    assert len({(i % 2, s) for i, s in enumerate(sides)}) == 2
