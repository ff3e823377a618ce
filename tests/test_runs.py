"""Whole runs on small tables."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from sonoquery import schema
from sonoquery.operators import scoring
from sonoquery.plans import runs, scene_queries

DIR = "/root/testdata/sf0.001"
PARAMS = replace(schema.Params(), sample_rate=1000, samples_per_band=6, samples_per_bin=4, max_attempts=40, sweep=(-4.0, 6.0, 5.0))


@pytest.fixture(scope="module")
def tables(spark):
    return scene_queries.sources(spark, DIR)


def test_evaluation(spark, tables, tmp_path):
    made = runs.evaluation_scenes(*tables, PARAMS).cache()
    rows = made.collect()
    assert len(rows) == 24 and {r.condition for r in rows} == set(scoring.EVAL_ORDER)
    for r in rows:
        snr = r.metadata.final_snr_db if r.metadata else None
        assert {"clean": snr is None, "high": snr is not None and snr > 14, "mid": snr is not None and 8 <= snr <= 12, "low": snr is not None and snr < 6}[r.condition]
    heard = made.select("speech_index", "condition", F.when(F.col("condition") == "low", F.lit("nothing")).otherwise(F.col("text")).alias("hypothesis"))
    done = runs.scored(made, heard, {})
    summary = {r.condition: r.wer for r in runs.summary(done).collect()}
    assert summary["clean"] == summary["high"] == 0 and summary["low"] >= 1
    written = json.loads(runs.write_results(done, str(tmp_path), seed=0))
    assert written["conditions"]["low"]["examples"] == 6 and "realized_snr_db" not in written["conditions"]["clean"]
    assert spark.read.json(str(tmp_path / "predictions")).count() == 24
    with pytest.raises(ValueError, match="transcript differs"):
        runs.scored(made.withColumn("text", F.concat("text", "condition")), heard, {})


def test_sweep(tables):
    rows = runs.sweep_scenes(*tables, PARAMS).collect()
    assert len(rows) == 8
    for r in rows:
        low, high = scoring.build_bins(*PARAMS.sweep)[int(r.condition)]
        assert low <= r.metadata.final_snr_db < high


def test_training(tables):
    rows = runs.training_scenes(*tables, PARAMS).select("scene_id", "is_clean").collect()
    assert len({r.scene_id for r in rows}) == len(rows) == 500
    other = runs.training_scenes(*tables, PARAMS, epoch=1).select("scene_id", "is_clean").collect()
    assert {tuple(r) for r in rows} != {tuple(r) for r in other}


def test_splits(spark, tables):
    train, validation = runs.responses_of_fold(tables[2], 1)
    assert {r.room for r in train.select("room").distinct().collect()} == set(schema.ROOM_SETS["A"]) and validation.count() + train.count() == 500
    assert runs.responses_of_fold(tables[2], 1, train)[1].count() == 500
    speech = spark.createDataFrame([(0, "a", 1.9), (1, "b", 2.0)], "row_id long, said string, seconds double")
    assert [r.text for r in runs.speech_split(speech, PARAMS, "said").collect()] == ["b"]
    assert runs.validation_rows(tables[0], replace(PARAMS, validation_examples=9)).count() == 9


def test_audit(spark):
    rows = [(room, f"type{'abcde'[i]}{n}", 30.0 + i, 0.5, 0.505) for n, (s, rs) in enumerate(schema.ROOM_SETS.items(), 1) for i, room in enumerate(rs) for _ in range(2)]
    df = spark.createDataFrame(rows, "room string, description string, volume double, stored double, raw double")
    sets = schema.room_sets(spark)
    means, lines = runs.audit_folds(df, sets)
    assert means.count() == 2 and len(lines) == 5
    for bad, match in ((df.withColumn("raw", F.lit(0.6)), "differ"), (df.withColumn("volume", F.rand(1)), "more than one"), (df.where("room <> 'Room1'"), "Room1"), (df.withColumn("description", F.lit("typea1")), "room sets")):
        with pytest.raises(ValueError, match=match):
            runs.audit_folds(bad, sets)
