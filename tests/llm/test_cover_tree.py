"""Links of embeddings against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoquery.llm import cover_tree as ct
from sonoquery.llm.queries import op13_embedding_dedup


def brute(rows, threshold=0.95):
    """(n_links, component) of each row."""
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if good else None for (_, v), good in zip(rows, ok)]
    label, links = list(range(len(rows))), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    names = {}
    for (i, _), k in zip(rows, label):
        if i is not None:
            names[k] = min(i, names.get(k, i))
    return sorted(((i, n, names.get(k), i is not None and i == names.get(k)) for (i, _), n, k in zip(rows, links, label)), key=str)


def run(spark, rows, kind="array<float>", more="", **more_args):
    df = spark.createDataFrame(rows, f"vec_id long, embedding {kind}")
    if more:
        df = df.select("*", *(F.lit(x).alias(x) for x in more.split()))
    return sorted((tuple(r) for r in ct.near_duplicates(df.repartition(3), **more_args).collect()), key=str)


def family(rng, n, dim, spread):
    base = rng.normal(size=dim)
    return base + rng.normal(size=(n, dim)) * spread * np.linalg.norm(base) / math.sqrt(dim)


def table(seed, dim=16):
    rng = np.random.default_rng(seed)
    vectors = [*rng.normal(size=(150, dim)), *family(rng, 60, dim, 0.05), *family(rng, 60, dim, 0.22), *family(rng, 40, dim, 0.3), *family(rng, 30, dim, 0.001)]
    vectors += [vectors[3]] * 20 + [2.0 * vectors[4]] * 2
    return [(int(i), [float(np.float32(x)) for x in v]) for i, v in zip(rng.permutation(len(vectors)), vectors)]


def test_links_and_components(spark):
    rows = table(1)
    assert run(spark, rows) == brute(rows)


def test_many_small_blocks(spark, monkeypatch):
    """Units of several cells, cells dealt to several blocks, and units taken whole give the same."""
    monkeypatch.setattr(ct, "BLOCK", 24)
    monkeypatch.setattr(ct, "SAMPLE", 40)
    for seed in (2, 3):
        rows = table(seed)
        assert run(spark, rows) == brute(rows)
    rng = np.random.default_rng(9)
    tight = [(i, v.tolist()) for i, v in enumerate([*family(rng, 120, 8, 0.01), *family(rng, 90, 8, 0.02), *rng.normal(size=(30, 8))])]
    assert run(spark, tight, "array<double>") == brute(tight)


def test_odd_rows(spark):
    nan, inf = math.nan, math.inf
    rows = [(0, None), (1, []), (2, [0.0, 0.0]), (3, [1.0, nan]), (4, [inf, 1.0]), (5, [1.0, None]), (6, [1.0, 0.0]), (7, [3.0, 0.0]), (8, [1.0]), (9, [2.0]), (None, [1.0, 0.1]), (6, [0.0, 1.0]), (None, None)]
    assert run(spark, rows, "array<double>", more="key dim vec n cell unit salt id v links other component least") == brute(rows)
    assert run(spark, []) == []
    huge = [(0, [1e300, 1e300]), (1, [1e-300, 1e-300]), (2, [1e300, -1e300])]
    assert run(spark, huge, "array<double>") == [(0, 1, 0, True), (1, 1, 0, False), (2, 0, 2, True)]


def test_edge_of_threshold(spark):
    """Pairs just at and just below the threshold are told apart."""
    rows = []
    for i, c in enumerate([0.95 + 1e-9, 0.95 - 1e-9, 0.9500001, 0.9499999]):
        rows += [(2 * i, [0.0] * (2 * i) + [1.0, 0.0] + [0.0] * (6 - 2 * i)), (2 * i + 1, [0.0] * (2 * i) + [c, math.sqrt(1 - c * c)] + [0.0] * (6 - 2 * i))]
    assert [r[1] for r in sorted(run(spark, rows, "array<double>"))] == [1, 1, 0, 0, 1, 1, 0, 0]


def test_tree_is_nested_and_covers():
    rng = np.random.default_rng(4)
    points = ct._units(np.concatenate([rng.normal(size=(300, 6)), family(rng, 100, 6, 0.1)]))
    tree = ct.Tree(points)
    points = points[tree.order]
    for k, (starts, centers, radii) in enumerate(zip(tree.starts, tree.centers, tree.radii)):
        for node, (a, b) in enumerate(zip(starts, starts[1:])):
            assert a <= centers[node] < b and (ct._angle(points[a:b] @ points[centers[node]]) <= radii[node] + 1e-7).all()
            assert k == 0 or radii[node] <= ct.RADII[k - 1] + 1e-7
        if k:
            assert set(tree.centers[k - 1]) <= set(centers)


def test_query_on_the_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in op13_embedding_dedup(spark, folder).collect()), key=str) == brute(rows)


def test_threshold_must_be_between_0_and_1(spark):
    with pytest.raises(ValueError, match="threshold"):
        run(spark, [(1, [1.0])], threshold=1.5)
