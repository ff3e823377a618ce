"""Convolution by blocks against the definition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoquery.operators import blocks


def frame(spark, pairs, partitions=3):
    rows = [(i, None if x is None else list(map(float, x)), None if h is None else list(map(float, h))) for i, (x, h) in enumerate(pairs)]
    return spark.createDataFrame(rows, "id bigint, x array<double>, h array<double>").repartition(partitions)


def waves(df):
    return {r.id: np.array(r.wave) for r in df.collect()}


@pytest.mark.parametrize("partitions", [1, 7])
def test_long_clips_by_values(spark, partitions):
    rng = np.random.default_rng(0)
    pairs = [(rng.standard_normal(16_000), rng.standard_normal(8_000)) for _ in range(3)]
    got = waves(blocks.convolve(frame(spark, pairs, partitions), "id", "x", "h", size=1024))
    for i, (x, h) in enumerate(pairs):
        n = 1 << 15
        np.testing.assert_allclose(got[i], np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(h, n), n)[: len(x) + len(h) - 1], atol=1e-9)
        for k in (0, 1, 1023, 1024, 7_999, 8_000, 15_999, 23_998):  # by the definition
            assert abs(got[i][k] - sum(x[j] * h[k - j] for j in range(max(0, k - 7_999), min(k, 15_999) + 1))) < 1e-9


def test_all_lengths_around_a_block(spark):
    rng = np.random.default_rng(1)
    lengths = [1, 2, 7, 8, 9, 15, 16, 17, 30]
    pairs = [(rng.standard_normal(n), rng.standard_normal(m)) for n in lengths for m in lengths]
    got = waves(blocks.convolve(frame(spark, pairs), "id", "x", "h", size=8))
    for i, (x, h) in enumerate(pairs):
        assert len(got[i]) == len(x) + len(h) - 1
        np.testing.assert_allclose(got[i], np.convolve(x, h), atol=1e-12)


def test_nothing_to_convolve(spark):
    got = waves(blocks.convolve(frame(spark, [([], [1]), (None, [1]), ([1], None), ([2, 3], [4])]), "id", "x", "h", size=1))
    assert {k: v.tolist() for k, v in got.items()} == {0: [], 1: [], 2: [], 3: [8, 12]}
    assert blocks.convolve(frame(spark, []), "id", "x", "h").count() == 0


def test_null_keys_and_keys_of_text(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0], [3.0]), (None, [1.0], [1.0])], "`the id` string, x array<double>, h array<double>").withColumnRenamed("the id", "name")
    got = {r.name_: r.wave for r in blocks.convolve(rows, "name", "x", "h").withColumnRenamed("name", "name_").collect()}
    assert got == {"a": [3.0, 6.0], None: []}


def test_blocks_and_back(spark):
    df = frame(spark, [(range(10), [1]), ([], [1]), (range(4), [1])])
    parts = blocks.cut(df, "id", "x", 4)
    assert {(r.id, r.block): len(r.samples) for r in parts.collect()} == {(0, 0): 4, (0, 1): 4, (0, 2): 2, (2, 0): 4}
    assert {r.id: r.wave for r in blocks.joined(parts, "id").collect()} == {0: list(range(10)), 2: list(range(4))}


def test_pairs_are_not_shuffled(spark):
    rows = spark.range(1000).select((F.col("id") / 10).cast("bigint").alias("id"), (F.col("id") % 10).cast("int").alias("block"), F.array(F.lit(1.0)).alias("samples"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = blocks.convolved(rows, rows.where("block < 2"), "id", 1)
        plan = done._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 3 and "Cartesian" not in plan  # the blocks of each side, and the parts of the result
    below = plan[plan.index("FlatMapGroupsInArrow") :]
    assert below.index("SortMergeJoin") < below.index("Exchange")
    assert done.count() == 100 * 11
