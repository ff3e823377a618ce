"""Array expressions against the numpy kernels, and hand-computable vectors."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoquery.functions import dsp, signal

SR = 1000


def frame(spark, arrays, **more):
    rows = [(i, list(map(float, a)), *(v[i] for v in more.values())) for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, ", ".join(["i int", "a array<double>", *(f"{k} double" for k in more)])).repartition(3)


def values(df, column):
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_descriptors_agree(spark):
    rng = np.random.default_rng(0)
    arrays = [rng.standard_normal(300) * np.exp(-np.arange(300) / rng.uniform(5, 80)) for _ in range(20)]
    distances = [float(d) for d in rng.uniform(0, 10, 20)]
    df = frame(spark, arrays, d=distances).withColumn("at", signal.direct_index(F.col("a"), F.col("d"), SR)).withColumn("sums", signal.decay_curve(F.col("a"), F.col("at")))
    at = values(df, "at")
    assert at == [dsp.direct_sample(a, d, SR) for a, d in zip(arrays, distances, strict=True)]
    for column, wanted in (
        (signal.drr_db(F.col("a"), F.col("at"), SR), [dsp.drr_db(a, d, SR) for a, d in zip(arrays, distances, strict=True)]),
        (signal.c50_db(F.col("a"), F.col("at"), SR), [dsp.c50_db(a, k, SR) for a, k in zip(arrays, at, strict=True)]),
        (signal.t30_s(F.col("sums"), SR), [dsp.t30_s(a, k, SR) for a, k in zip(arrays, at, strict=True)]),
    ):
        np.testing.assert_allclose(values(df, column), wanted, rtol=1e-9, atol=1e-9)


def test_decay_by_window(spark):
    rng = np.random.default_rng(3)
    arrays = [rng.standard_normal(200) * np.exp(-np.arange(200) / rng.uniform(5, 60)) for _ in range(12)] + [np.zeros(5), np.array([])]
    df = frame(spark, arrays).withColumn("at", F.lit(2))
    got = [r.t30 for r in signal.t30_table(df, "i", "a", "at", SR).orderBy("i").collect()]
    np.testing.assert_allclose(got, [dsp.t30_s(a, 2, SR) for a in arrays], rtol=1e-9)


def test_direct_sound_edges(spark):
    df = frame(spark, [[0, 1, -1, 1, 0]], d=[0.343 * 2])
    assert values(df, signal.direct_index(F.col("a"), F.col("d"), SR)) == [1]  # the first of equal ones
    with pytest.raises(Exception, match="search window"):
        values(frame(spark, [[1.0]], d=[343.0]), signal.direct_index(F.col("a"), F.col("d"), SR))
    with pytest.raises(ValueError, match="search window"):
        dsp.direct_sample(np.ones(1), 343.0, SR)


def test_half_even_rounding(spark):
    assert [r[0] for r in spark.createDataFrame([(0.5,), (1.5,), (2.5,), (3.4,)], "x double").select(signal.even(F.col("x"))).collect()] == [0, 2, 2, 3]


def test_masks_powers_and_gains(spark):
    wave = np.concatenate([np.zeros(25), np.ones(25), np.full(10, 2.0)])
    df = frame(spark, [wave]).withColumn("p", signal.frame_powers(F.col("a"), SR)).withColumn("f", signal.active_frames(F.col("p"), 0.3)).withColumn("m", signal.mask(F.col("a"), F.col("f"), SR))
    assert values(df, "p") == [[0.0, 1.0, 4.0]] and values(df, "f") == [[False, False, True]]
    assert values(df, signal.power(F.col("a"), F.col("m"))) == [4.0]
    assert dsp.activity(wave, SR, threshold=0.3).sum() == 10
    with pytest.raises(Exception, match="no sample"):
        values(df, signal.power(F.col("a"), F.transform("a", lambda x: x > 99)))
    assert values(df, signal.snr_db(F.lit(0.0), F.lit(1.0))) == [-math.inf] and dsp.ratio_db(0.0, 1.0) == -math.inf
    assert values(df, signal.noise_gain(F.lit(20.0), F.lit(0.0))) == [10.0]


def test_loop_trim_convolve(spark):
    df = frame(spark, [[1, 2, 3]])
    assert values(df, signal.loop(F.col("a"), F.lit(7), F.lit(2.0), SR)) == [[3, 1, 2, 3, 1, 2, 3]]
    assert values(df, signal.loop(F.col("a"), F.lit(0), F.lit(2.0), SR)) == [[]]
    assert dsp.looped(np.array([1.0, 2, 3]), 7, 2.0, SR).tolist() == [3, 1, 2, 3, 1, 2, 3]
    with pytest.raises(Exception, match="empty clip"):
        values(frame(spark, [[]]), signal.loop(F.col("a"), F.lit(2), F.lit(0.0), SR))
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal(40), rng.standard_normal(9)
    np.testing.assert_allclose(dsp.convolution(a, b), np.convolve(a, b), atol=1e-12)
    got = values(frame(spark, [a]), signal.convolved(F.col("a"), F.array(*[F.lit(float(x)) for x in b])))[0]
    np.testing.assert_allclose(got, np.convolve(a, b), atol=1e-12)
    assert values(frame(spark, [[0, 0, 5, 1]]), signal.trim(F.col("a"), F.lit(2), SR)) == [[0, 5, 1]]


def test_undefined_descriptors(spark):
    df = frame(spark, [[0.0] * 10, [1.0] * 10]).withColumn("s", signal.decay_curve(F.col("a"), F.lit(0)))
    assert all(math.isnan(x) for x in values(df, signal.t30_s(F.col("s"), SR)) + values(df, signal.c50_db(F.col("a"), F.lit(0), SR)))


def test_pink_noise_and_resampling():
    x = dsp.pink(4096, np.random.default_rng(0))
    assert abs(x.mean()) < 1e-12 and abs(x.std() - 1) < 1e-9 and len(dsp.pink(5, np.random.default_rng(0))) == 5
    power = np.abs(np.fft.rfft(dsp.pink(1 << 16, np.random.default_rng(2)))) ** 2
    assert 8 < power[100:200].mean() / power[1000:2000].mean() < 12
    t = np.arange(4000) / 4000
    for rate in (8000, 2000, 6000):
        wave = dsp.resampled(np.sin(2 * np.pi * 50 * t), 4000, rate)
        wanted = np.sin(2 * np.pi * 50 * np.arange(len(wave)) / rate)
        assert len(wave) == rate and np.abs(wave - wanted)[200:-200].max() < 0.01
    assert dsp.resampled(t, 4000, 4000) is t


def test_wav():
    rng = np.random.default_rng(0)
    wave = rng.uniform(-0.03, 0.03, 1001)
    for subtype, gap in (("PCM_16", 1 / 30000), ("FLOAT", 1e-7)):
        data = dsp.wav_bytes(wave, SR, subtype)
        back, rate = dsp.wav_read(data)
        assert rate == SR and np.abs(back - wave).max() < gap and dsp.wav_seconds(data) == 1.001
    with pytest.raises(ValueError):
        dsp.wav_read(b"nothing")


def test_reverberation_of_long_responses(spark):
    """Two-level sums against the definition and the window, for decays that cross in the first, a middle, the last or no block."""
    rng = np.random.default_rng(8)
    arrays = [rng.standard_normal(n) * np.exp(-np.arange(n) / slope) for n in (1, 127, 128, 129, 1000, 16_000) for slope in (5.0, 60.0, 900.0, 1e9)]
    arrays += [np.zeros(300), np.r_[np.zeros(500), 1.0], np.r_[1.0, np.zeros(500)], np.r_[np.ones(128), np.zeros(128), np.full(10, 1e-3)]]
    df = spark.createDataFrame([(i, a.tolist(), i % 3) for i, a in enumerate(arrays)], "i int, a array<double>, at int").where("size(a) > at")
    kept = [(i, a) for i, a in enumerate(arrays) if len(a) > i % 3]
    got = [r[0] for r in df.orderBy("i").select(signal.t30_blocks(F.col("a"), F.col("at"), SR)).collect()]
    np.testing.assert_allclose(got, [dsp.t30_s(a, i % 3, SR) for i, a in kept], rtol=1e-9)
    np.testing.assert_allclose(got, [r.t30 for r in signal.t30_table(df, "i", "a", "at", SR).orderBy("i").collect()], rtol=1e-9)
    assert math.isnan(spark.range(1).select(signal.t30_blocks(F.expr("cast(array() as array<double>)"), F.lit(0), SR)).first()[0])


def test_a_thousand_long_responses_in_seconds(spark):
    wave = F.transform(F.sequence(F.lit(0), F.lit(15_999)), lambda i: F.sin(i * 0.7 + F.col("id")) * F.exp(-i / 1500.0))
    df = spark.range(1000, numPartitions=4).select("id", wave.alias("a"))
    began = time.time()
    # a curve that isn't a column is made once for a row, not once for each sample
    assert df.where("id < 4").select(signal.t30_s(signal.decay_curve(F.slice("a", 1, 1000), F.lit(0)), SR).alias("t")).where("t > 0 or isnan(t)").count() == 4
    assert df.select(signal.t30_blocks(F.col("a"), F.lit(0), SR).alias("t")).where("t > 0").count() == 1000
    assert time.time() - began < 60
