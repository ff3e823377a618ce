"""Near duplicates against all pairs."""

import random
import re

import pytest

from sonoquery.llm import minhash
from sonoquery.llm.components import components
from sonoquery.llm.queries import op1_near_dedup


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(docs, n, percent):
    """docs: {id: text}.  Component of each id, from all pairs."""
    sets = {i: shingles(t, n) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(docs)
    by_size = sorted((i for i in ids if sets[i]), key=lambda i: len(sets[i]))
    for x, a in enumerate(by_size):
        for b in by_size[x + 1 :]:
            if len(sets[a]) * 100 < percent * len(sets[b]):
                break
            if root(a) != root(b):
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    low, high = sorted((root(a), root(b)))
                    parent[high] = low
    return {i: root(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def check(rows, docs, n, percent):
    root, size = brute(docs, n, percent)
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.doc_id, r.n_shingles, r.component_id, r.kept) == (r.doc_id, size[r.doc_id], root[r.doc_id], root[r.doc_id] == r.doc_id)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    check(op1_near_dedup(spark, f"/root/testdata/{sf}").collect(), docs, 3, 85)


def test_chains_and_borders(spark):
    """Groups in which copies drift away from the first one, and pairs around the border."""
    rng = random.Random(3)
    docs, words = {}, [f"w{i}" for i in range(3000)]
    for _ in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([8, 40, 150, 400]))]
        for _ in range(25):
            docs[len(docs)] = " ".join(text)
            for _ in range(rng.randint(0, max(1, len(text) // 25))):
                text[rng.randrange(len(text))] = rng.choice(words)
            if rng.random() < 0.3:
                text = list(docs[rng.randrange(len(docs))].split())
    docs |= {len(docs) + i: t for i, t in enumerate([None, "", " \n", "one", "ONE", "one two", "one  two", "One two three", "a b c d", "a b c d"])}
    order = list(docs.items())
    rng.shuffle(order)
    df = spark.createDataFrame([(i, t, 0, "c") for i, t in order], "doc_id long, text string, id int, kept string")
    for n, percent in ((3, 85), (5, 80)):
        check(minhash.near_duplicates(df, n=n, percent=percent).collect(), docs, n, percent)


def test_null_keys_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (3, "A b C d"), (9, None)], "doc_id long, text string")
    rows = sorted((tuple(r) for r in minhash.near_duplicates(df, n=3, percent=85).collect()), key=str)
    assert rows == sorted([(None, 2, None, True), (5, 2, 3, False), (5, 2, 3, False), (3, 2, 3, True), (9, 0, 9, True)], key=str)
    assert minhash.near_duplicates(df.where("false")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 150), (150, 120), (300, 300), (500, 400)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in (100, 120, 150, 200)} | {400: 400, 500: 400}


@pytest.mark.parametrize(("short", "n", "percent"), [(1, 3, 85), (8, 5, 80)])
def test_long_lists(spark, monkeypatch, short, n, percent):
    """Large groups whose copies differ each in its own way, and copies of copies."""
    monkeypatch.setattr(minhash, "SHORT", short)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    docs = {}
    for _ in range(3):
        base = [rng.choice(words) for _ in range(120)]
        group = [base]
        for _ in range(110):
            text = list(rng.choice(group) if rng.random() < 0.5 else base)
            for _ in range(rng.randint(0, 9)):
                at = rng.randrange(len(text))
                kind = rng.random()
                if kind < 0.6:
                    text[at] = rng.choice(words)
                elif kind < 0.8:
                    del text[at]
                else:
                    text.insert(at, rng.choice(words))
            group.append(text)
            docs[len(docs) + 10] = " ".join(text)
    order = list(docs.items())
    rng.shuffle(order)
    df = spark.createDataFrame(order, "doc_id long, text string")
    root, _ = brute(docs, n, percent)
    assert 5 < len(set(root.values())) < len(docs)
    check(minhash.near_duplicates(df, n=n, percent=percent).collect(), docs, n, percent)


def test_candidates_of_a_large_family(spark):
    """Copies that are mostly not similar to each other but share a text and a passage or two: hardly any pairs, and no link lost."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    base, passages = [rng.choice(words) for _ in range(150)], [[rng.choice(words) for _ in range(40)] for _ in range(2)]
    docs = {}
    for i in range(600):
        text = list(base)
        for _ in range(rng.choice([2, 12, 25])):
            text[rng.randrange(len(text))] = rng.choice(words)
        docs[i] = " ".join(passages[0] + text + passages[1] * (i % 3 == 0))
    sets = minhash.sets(minhash.pa.array(docs.values()), 5)
    full = spark.createDataFrame([(i, s.tobytes()) for i, s in zip(docs, sets, strict=True)], "node long, set binary")
    families = spark.createDataFrame([(1, i, i) for i in docs], "family long, node long, component long")
    pairs = minhash.by_difference(families, full, 80, 64)
    assert pairs.count() < 5 * len(docs)  # of 180,000
    root, _ = brute(docs, 5, 80)
    have = [{x for x in s.tolist()} for s in sets]
    real = [(r.a, r.b) for r in pairs.collect() if 100 * len(have[r.a] & have[r.b]) >= 80 * len(have[r.a] | have[r.b])]
    joined = {r.node: r.component for r in components(spark.createDataFrame(real, "a long, b long")).collect()}
    assert {i: joined.get(i, i) for i in docs} == root
    assert 20 < len(set(root.values())) < len(docs)


def test_members_listed_of_a_large_family(spark, monkeypatch):
    """Differences that nobody shares are listed up to the bound only, and none of what most of the family has."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    docs = {}
    for i in range(400):
        text = list(base)
        for at in rng.sample(range(150), 12):
            text[at] = f"own{i} {at}" if i % 40 else f"own {at}"
        docs[i] = " ".join(text)
    sets = minhash.sets(minhash.pa.array(docs.values()), 3)
    full = spark.createDataFrame([(i, s.tobytes()) for i, s in zip(docs, sets, strict=True)], "node long, set binary")
    families = spark.createDataFrame([(1, i, i) for i in docs], "family long, node long, component long")
    listed, members, cut = [], [], minhash.cut

    def counted(df, *more):
        done = cut(df, *more)
        if done.columns == ["family", "node", "component", "g", "e"]:
            listed.append(done.count())
        elif "bound" in done.columns and not members:
            members.append(done.selectExpr("sum(size(d))").first()[0])
        return done

    monkeypatch.setattr(minhash, "cut", counted)
    pairs = {(r.a, r.b) for r in minhash.by_difference(families, full, 85, 64).collect()}
    have = [set(s.tolist()) for s in sets]
    root, _ = brute(docs, 3, 85)
    real = [(a, b) for a, b in pairs if 100 * len(have[a] & have[b]) >= 85 * len(have[a] | have[b])]
    joined = {r.node: r.component for r in components(spark.createDataFrame(real, "a long, b long")).collect()} if real else {}
    assert {i: joined.get(i, i) for i in docs} == root
    assert max(listed) < 0.6 * members[0]
