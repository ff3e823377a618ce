"""Bins, bands, paired conditions and reports."""

import json

import pytest
from pyspark.sql import functions as F

from sonoquery.operators import scoring
from sonoquery.schema import Params
from sonoquery.sources import sinks
from sonoquery.streaming import running_band_scores


def test_bins():
    assert scoring.build_bins(-8, 6, 2) == [(-8 + 2 * i, -6 + 2 * i) for i in range(7)]
    assert scoring.build_bins(-8, 5, 2)[-1] == (4, 5)
    bins = scoring.build_bins(-8, 6, 1.5)
    assert bins[0][0] == -8 and bins[-1][1] == 6 and all(a[1] == b[0] for a, b in zip(bins, bins[1:], strict=False))
    for width in (0, -1):
        with pytest.raises(ValueError, match="bin-width"):
            scoring.build_bins(-8, 6, width)
    with pytest.raises(ValueError, match="max-snr"):
        scoring.build_bins(6, 6, 2)


def rows(spark, values):
    return spark.createDataFrame(values, "snr double, errors long, words long")


def test_micro_average_and_empty_references(spark):
    df = rows(spark, [(5.0, 1, 10), (5.5, 9, 10), (20.0, 0, 5), (None, 2, 4), (7.0, 1, 2), (float("nan"), 1, 2), (5.0, 3, 0)])
    got = {r.band: r for r in scoring.band_wer(df).collect()}
    assert set(got) == {"all", "low", "high", "clean", "other"}
    assert got["low"].wer == 0.5 and got["all"].reference_words == 33 and got["all"].examples == 6
    assert got["clean"].mean_snr is None and got["other"].mean_snr == 7.0
    assert {r.band for r in scoring.by_band(df).collect()} == {"low", "high"}


def test_empty_bins_have_no_rate(spark):
    bins = scoring.bins_table(spark, [(0.0, 1.0), (1.0, 2.0)])
    got = scoring.by_bin(rows(spark, [(1.0, 1, 4)]), bins).orderBy("bin_index").collect()
    assert [(r.examples, r.wer) for r in got] == [(0, None), (1, 0.25)]


def test_score_texts(spark):
    df = spark.createDataFrame([("The cat uh sat", "the cat sat"), ("mm", "x"), ("twenty one", None)], "reference string, hypothesis string")
    got = sorted((r.words, r.errors) for r in scoring.score_texts(df, {}).collect())
    assert got == [(1, 1), (3, 0)]
    with pytest.raises(Exception, match="empty after normalization"):
        scoring.score_texts(df, {}, on_empty="error").collect()


def test_report_and_sinks(spark, tmp_path):
    summary = scoring.by_band(rows(spark, [(5.0, 1, 10), (20.0, 0, 5)]))
    assert len(scoring.report(summary)) == 3
    written = json.loads(sinks.summary_json(summary, "band", seed=0))
    assert written["seed"] == 0 and written["conditions"]["low"]["realized_snr_db"]["mean"] == 5.0
    sinks.jsonl(spark.createDataFrame([("é", None)], "a string, b double"), str(tmp_path / "p"))
    assert '{"a":"é","b":null}' in "".join(p.read_text() for p in (tmp_path / "p").glob("part-*"))
    sinks.transcripts(spark.createDataFrame([("low", 1.0, "a", "b")], "band string, final_snr_db double, reference string, hypothesis string"), str(tmp_path / "t"), 7)
    assert (tmp_path / "t" / "step=00007").is_dir()


def test_scene_cache(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([(1, [0.1, 0.2])], "scene_id long, audio array<double>")

    for _ in range(2):
        assert sinks.cached_scenes(Params(), str(tmp_path), make).first().audio == [0.1, 0.2]
    sinks.cached_scenes(Params(sample_rate=8000), str(tmp_path), make)
    assert len(made) == 2


def test_stream_gives_the_batch_scores(spark, tmp_path):
    df = rows(spark, [(5.0, 1, 10), (20.0, 0, 5), (None, 2, 4), (9.0, 3, 7)])
    df.write.parquet(str(tmp_path / "in"))
    query = running_band_scores(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("bands").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    wanted = {tuple(r) for r in scoring.band_wer(df).where("band <> 'all'").collect()}
    assert {tuple(r) for r in spark.table("bands").collect()} == wanted


def test_parameters(tmp_path):
    (tmp_path / "run.toml").write_text("[scene]\nsample_rate = 8000\nnumber_of_noises = 3\n[trainer]\nsteps = 5\n")
    assert Params.read(tmp_path / "run.toml").sample_rate == 8000 and Params.read(tmp_path / "run.toml").number_of_noises == 3
    assert Params().key != Params(base_seed=1).key
    for bad in ({"number_of_noises": 0}, {"clean_probability": 2.0}, {"max_attempts": -1}):
        with pytest.raises(ValueError):
            Params(**bad)


def test_conditions(spark):
    items = spark.range(3).select(F.col("id").alias("speech_index"))
    assert scoring.conditions(items, scoring.EVAL_ORDER).count() == 12
