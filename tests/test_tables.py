"""Table functions in SQL."""

import numpy as np
import pytest

from sonoquery.functions import dsp, tables

SR = 1000


def test_descriptors_by_lateral(spark):
    rng = np.random.default_rng(2)
    waves = [rng.standard_normal(n) * np.exp(-np.arange(n) / 40) for n in (200, 300, 301)]
    rows = [(i, bytearray(dsp.wav_bytes(w, SR, "FLOAT")), 0.343 * i) for i, w in enumerate(waves)] + [(3, None, 1.0), (4, bytearray(dsp.wav_bytes(waves[0], SR)), None)]
    df = spark.createDataFrame(rows, "id int, data binary, distance double")
    got = tables.registered(spark).sql("SELECT id, d.* FROM {df}, LATERAL descriptors(data, distance, ' t30_s,c50_db, samples,direct,drr_db,sr') d ORDER BY id", df=df)
    assert got.columns == ["id", "t30_s", "c50_db", "samples", "direct", "drr_db", "sr"]
    found = got.collect()
    assert [r.id for r in found] == [0, 1, 2]
    for i, (r, w) in enumerate(zip(found, waves, strict=True)):
        w = w.astype(np.float32).astype(float)
        at = dsp.direct_sample(w, 0.343 * i, SR)
        assert (r.samples, r.direct, r.sr) == (len(w), at, SR)
        np.testing.assert_allclose([r.t30_s, r.c50_db, r.drr_db], [dsp.t30_s(w, at, SR), dsp.c50_db(w, at, SR), dsp.drr_db(w, 0.343 * i, SR)], rtol=1e-12)


def test_columns_are_known_before_the_query_runs(spark):
    df = spark.createDataFrame([], "data binary, distance double")
    assert tables.registered(spark).sql("SELECT d.* FROM {df}, LATERAL descriptors(data, distance, 'direct') d", df=df).dtypes == [("direct", "int")]
    for names in ("'loudness'", "''", "'sr, sr'", "string(distance)"):
        with pytest.raises(Exception, match="named by a constant"):
            spark.sql(f"SELECT d.* FROM {{df}}, LATERAL descriptors(data, distance, {names}) d", df=df).schema
