"""Sampling, rendering, rejection, audits and ingestion."""

import json
import tracemalloc
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sonoquery import schema
from sonoquery.functions import dsp
from sonoquery.operators import labels, rooms, sampling, scenes, scoring
from sonoquery.plans import scene_queries
from sonoquery.plans.catalogue import QUERIES, SQL
from sonoquery.sources import audio

DIR = "/root/testdata/sf0.001"


def test_recipes_dont_depend_on_partitions(spark):
    index = sampling.RoomIndex([(f"Room{i}", f"R{j}", list(range(100 * i + 10 * j, 100 * i + 10 * j + 6))) for i in range(3) for j in range(2)])
    ids = spark.range(200).select(F.col("id").alias("speech_index"))
    a, b = ({r.speech_index: tuple(r) for r in sampling.recipes(ids.repartition(n), index, 50, schema.Params(), 42).collect()} for n in (1, 8))
    assert a == b and len(a) == 200
    rows = sampling.recipes(ids, index, 50, schema.Params(), 42).collect()
    clean = sum(r.is_clean for r in rows)
    assert 25 < clean < 80
    for r in rows:
        if not r.is_clean:
            group = set(range(r.speech_rir_index // 10 * 10, r.speech_rir_index // 10 * 10 + 6))
            assert {r.speech_rir_index, *r.noise_rir_indices} <= group and len({r.speech_rir_index, *r.noise_rir_indices}) == 3
            assert len(set(r.noise_indices)) == 2 and -2 <= r.target_snr_db <= 24 and 35 <= r.pink_db <= 55 and all(0 <= x <= 3000 for x in r.offsets_ms)
    assert not any(r.is_clean for r in sampling.recipes(ids, index, 50, schema.Params(), 42, mode="eval").collect())
    with pytest.raises(Exception, match="too few"):
        sampling.draw(index, 1, 0, schema.Params(), np.random.default_rng(0))


def test_first_draws_follow_the_order():
    """Room, receiver, responses, noises, target, offsets, pink level, seed."""
    index = sampling.RoomIndex([("B", "R1", [4, 5, 6]), ("A", "R2", [7, 8, 9]), ("A", "R10", [1, 2, 3])])
    got = sampling.draw(index, 9, 5, schema.Params(), np.random.default_rng(3))
    rng = np.random.default_rng(3)
    room = ["A", "B"][rng.integers(2)]
    receivers = {"A": [("R10", [1, 2, 3]), ("R2", [7, 8, 9])], "B": [("R1", [4, 5, 6])]}[room]
    receiver, ids = receivers[rng.integers(len(receivers))]
    responses, noises = rng.choice(ids, 3, replace=False), rng.choice(9, 2, replace=False)
    assert (got["room"], got["receiver"], got["speech_rir_index"], got["noise_rir_indices"], got["noise_indices"]) == (room, receiver, responses[0], responses[1:].tolist(), noises.tolist())
    assert got["target_snr_db"] == rng.uniform(-2, 24) and got["offsets_ms"] == rng.uniform(0, 3000, 2).tolist() and got["pink_db"] == rng.uniform(35, 55)


def test_scenes_meet_their_targets():
    rng = np.random.default_rng(0)
    for _ in range(20):
        decay = np.exp(-np.arange(200) / 20.0)
        source = lambda n: dsp.Source(rng.standard_normal(n), rng.standard_normal(200) * decay, float(rng.uniform(0, 10)), float(rng.uniform(0, 300)))
        room = dsp.room(source(500), [source(120), source(700)], 1000, 45.0, np.random.default_rng(7))
        target = float(rng.uniform(-2, 24))
        mix = dsp.mixed(room, target)
        noise = room.gain(target) * room.noise
        before = dsp.ratio_db(dsp.mean_power(room.speech, room.mask), dsp.mean_power(noise, room.mask))
        assert abs(before - target) < 1e-6 and np.abs(mix.audio).max() <= 0.99 + 1e-12
        np.testing.assert_allclose(mix.audio, mix.scale * (room.speech + noise + room.pink), atol=1e-12)
        ps, pn, pp, c = room.statistics()
        g = 10 ** ((10 * np.log10(ps / (pn + 1e-12)) - target) / 20)
        assert abs(10 * np.log10(ps / (g * g * pn + 2 * g * c + pp + 1e-12)) - mix.final_snr_db) < 1e-6
    with pytest.raises(ValueError, match="noise source"):
        dsp.room(source(9), [], 1000, 45.0, rng)


def test_accepted_targets_land_inside(spark):
    found = scenes.accepted_in_bands(scene_queries.gathered(spark, DIR), 1000, 0, 20)
    rows = found.collect()
    assert len(rows) == 1500 and {r.condition for r in rows} == {"high", "mid", "low"}
    hit = [r for r in rows if r.target_snr_db is not None]
    assert len(hit) > 1400
    # what the algebra accepts is what a rendering gives
    some = {(r.speech_index, r.target_snr_db): r for r in hit if r.condition == "mid" and r.speech_index < 20}
    base = scene_queries.gathered(spark, DIR).where("speech_index < 20")
    targets = spark.createDataFrame([(k[0], k[1]) for k in some], "speech_index long, t double")
    for s in scenes.render(base.join(targets, "speech_index").withColumn("target_snr_db", F.col("t")).drop("t"), 1000).collect():
        own = some[s.scene_id, s.metadata.target_snr_db]
        assert abs(s.metadata.final_snr_db - own.realized_snr_db) < 1e-6 and 8 <= s.metadata.final_snr_db <= 12
    with pytest.raises(Exception, match="no attempt"):
        scenes.require(scenes.accepted(base, [("never", 0.0, 1.0)], lambda snr, name: F.lit(False), 1000, 0, 2)).collect()


def test_render_query(spark):
    rows = QUERIES["render_scene"](spark, DIR).collect()
    assert len(rows) == 500 and all(r.valid for r in rows) and 60 < sum(r.is_clean for r in rows) < 190
    assert all((r.final_snr_db is None) == r.is_clean for r in rows)


def test_roundtrip_is_close_at_all_levels(spark, tmp_path):
    """Above about half of full scale, the error of a right 16-bit round trip is over 1 / 32000; that of another sample value isn't allowed for."""
    levels = [0.56118864, -0.56118864, 0.99996, 1.0, -1.0, 0.0, 1e-6, *np.random.default_rng(0).uniform(-1, 1, 2000)]
    rows = [(i, [float(np.float32(x))] * 3) for i, x in enumerate(levels)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert all(r.close for r in scene_queries.audio_roundtrip(spark, str(tmp_path)).collect())
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(audio, "encoded", lambda wave, sr, f=audio.encoded: f(F.transform(wave, lambda x: x + F.signum(0.5 - x) * 2.6 / 32768), sr))
        assert not any(r.close for r in scene_queries.audio_roundtrip(spark, str(tmp_path)).collect() if abs(levels[r.id]) < 0.5)


def own_function(call):
    """The function that ``call`` gives to Arrow."""
    got = []

    def grab(work, *_):
        got.append(work)
        raise LookupError

    with pytest.MonkeyPatch.context() as patch, pytest.raises(LookupError):
        patch.setattr(F, "arrow_udf", grab)
        call()
    return got[0]


def peak_mb(work, *arrays):
    tracemalloc.start()
    try:
        return work(*arrays), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_targets_are_never_python_objects():
    ranges = [(a, a + 2.0) for a in range(-8, 6, 2)]
    got, peak = peak_mb(own_function(lambda: sampling.targets(None, ranges, 5, 20)), pa.array(range(300), pa.int64()))
    assert peak < 3  # dicts take 9 MB
    rng = np.random.default_rng(np.random.SeedSequence([5, 7, 3]))
    assert [x for x in got[7].as_py() if x["condition_index"] == 3] == [{"condition_index": 3, "attempt": a, "target": rng.uniform(-4, -2)} for a in range(20)]


def test_batches_of_scenes_are_never_python_objects():
    wave = pa.list_(pa.float64())
    noises = pa.list_(pa.struct([("pos", pa.int32()), ("clip", wave), ("response", wave), ("distance", pa.float64()), ("offset_ms", pa.float64())]))
    a = lambda i: np.sin(np.arange(64) + i)
    rows = [(a(i), a(i) * 0.9, 1.0, [{"pos": k, "clip": a(i + k), "response": a(k), "distance": 1.0, "offset_ms": 3.0} for k in range(2)], 45.0, i, 3.0) for i in range(400)]
    kinds = (wave, wave, pa.float64(), noises, pa.float64(), pa.int64(), pa.float64())
    batch = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
    work = own_function(lambda: scenes.render(None, 1000))
    got, peak = peak_mb(work, *batch)
    assert len(got) == 400 and peak < 3  # 7.6 MB as lists
    assert work(*(x[5:6] for x in batch))[0].as_py() == got[5].as_py() and len(work(*(x[:0] for x in batch))) == 0


def archive(path, room, names):
    with zipfile.ZipFile(path, "w") as bundle:
        for k, name in enumerate(names):
            wave = np.zeros(4000)
            wave[30 + k] = 0.5
            wave[31 + k :] = 0.1 * np.exp(-np.arange(4000 - 31 - k) / 200.0) * np.random.default_rng(k).standard_normal(4000 - 31 - k)
            bundle.writestr(f"x/{room}/{name}", dsp.wav_bytes(wave, 16000))


def test_ingest(spark, tmp_path):
    (tmp_path / "ir").mkdir()
    archive(tmp_path / "ir" / "office.zip", "office_idx_3", ["S001_R0010_x_hybrid_IR.wav", "S001_R002_hybrid_IR.wav", "S002_R0010_hybrid_IR.wav", "notes.txt", "S009_R009_hybrid_IR.wav"])
    place = tmp_path / "meta" / "office" / "office_idx_3"
    place.mkdir(parents=True)
    for name in ("S1_R010.json", "S1_R2.json", "S2_R10.json"):
        (place / name).write_text(json.dumps({"src_loc": [0, 0, 0], "rec_loc": [0.6, 0, 0.2], "IR_norm": 3}))
    members, meta = audio.members(spark, str(tmp_path / "ir")), audio.sidecars(spark, str(tmp_path / "meta"))
    assert members.count() == 4 and meta.count() == 3
    table = audio.ingest(members, meta)
    audio.write_shards(table, str(tmp_path / "out"), 2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.columns == ["audio", "Room", "Room Description", "Receiver Label", "Direct Path Length [m]", "Avg C50", "Avg T30"]
    rows = sorted(back.collect(), key=lambda r: r.audio.path)
    assert [r.audio.path for r in rows] == ["office_idx_3/S1_R10.wav", "office_idx_3/S1_R2.wav", "office_idx_3/S2_R10.wav"]
    assert rows[0]["Room Description"] == "office" and rows[0]["Receiver Label"] == "R10" and abs(rows[0]["Direct Path Length [m]"] - 0.4**0.5) < 1e-6
    assert audio.ingest(members, meta, receivers_per_room=1).select("Receiver Label").distinct().count() == 1
    (place / "S1_R0010_b.json").write_text("{}")
    with pytest.raises(Exception, match="two metadata files"):
        audio.sidecars(spark, str(tmp_path / "meta")).collect()
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception):
        audio.members(spark, str(tmp_path / "none"))


def test_records_by_bytes_or_path(spark, tmp_path):
    data = dsp.wav_bytes(np.linspace(-0.5, 0.5, 800), 8000, "FLOAT")
    (tmp_path / "a.wav").write_bytes(data)
    rows = spark.createDataFrame([(0, (bytearray(data), None)), (1, (None, str(tmp_path / "a.wav"))), (2, (bytearray(data), "elsewhere"))], "i int, audio struct<bytes:binary,path:string>")
    got = audio.with_bytes(rows).select("i", audio.decoded(F.col("audio.bytes")).alias("d"), audio.seconds(F.col("audio.bytes")).alias("s")).collect()
    assert all(r.s == 0.1 and r.d.sr == 8000 and len(r.d.audio) == 800 for r in got)
    with pytest.raises(Exception, match="neither bytes"):
        audio.with_bytes(spark.createDataFrame([(0, (None, None))], "i int, audio struct<bytes:binary,path:string>")).collect()


def test_row_ids(spark):
    df = audio.numbered(spark.range(500).select((F.col("id") * 7 % 501).alias("k")), "k")
    assert [r.row_id for r in df.orderBy("k").collect()] == list(range(500))


def test_audits(spark):
    bands = "array(1D, 2D, 3D, 4D, 5D, 6D, 7D, double('NaN'))"
    df = spark.sql(f"SELECT {bands} AS b, '[1, 2, 3, nan, 4, 5, 6, 7]' AS t")
    assert df.select(rooms.octave_mean(F.col("b"))).first()[0] == 4.0
    assert df.select(rooms.octave_mean(rooms.parsed_list(F.col("t")))).first()[0] == 4.0
    with pytest.raises(Exception, match="eight octave bands"):
        df.select(rooms.octave_mean(F.array(F.lit(1.0)))).collect()
    sets = schema.room_sets(spark)
    good = sets.select("room", F.concat(F.lit("type"), (F.row_number().over(Window.partitionBy("room_set").orderBy("room"))).cast("string"), F.lit("x")).alias("room_type"))
    rooms.check_types(good, sets)
    with pytest.raises(ValueError, match="room sets"):
        rooms.check_types(good.withColumn("room_type", F.lit("x")), sets)
    ids = spark.range(5).select(F.col("id").alias("row_id"))
    assert rooms.prefix(ids, 3).count() == 3
    with pytest.raises(ValueError, match="asked for"):
        rooms.prefix(ids, 6)
    assert rooms.first_complete_group(spark.createDataFrame([(0, "a", "x"), (1, "b", "x"), (2, "b", "x"), (3, "a", "x")], "row_id long, room string, receiver string"), 2, 10).select("row_id").collect()[0][0] == 1
    with pytest.raises(ValueError):
        schema.fold_rooms(3)


def test_label_masks(spark):
    df = spark.sql("SELECT array(1, 9, 2, 9, 5, 33, 6) AS ids, array(33, 34) AS p")
    masked = labels.without(labels.after_marker(F.col("ids"), F.col("ids"), 9), F.col("p"))
    assert df.select(masked).first()[0] == [-100, -100, -100, -100, 5, -100, 6]
    assert df.select(labels.batch_checks(F.col("ids"), F.col("ids"), masked)).first()[0]
    with pytest.raises(Exception, match="no marker"):
        df.select(labels.after_marker(F.col("ids"), F.col("ids"), 77)).collect()
    vocabulary = spark.createDataFrame([(0, " ,", False), (1, "a,", False), (2, " ", False), (3, "<s>", True), (4, "€", False), (5, "?!", False)], "token_id int, text string, special boolean")
    assert sorted(r[0] for r in labels.punctuation_ids(vocabulary).collect()) == [0, 4, 5]


def test_all_queries_have_stable_columns(spark):
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 50
    for name, query in QUERIES.items():
        df = query(spark, DIR)
        assert df.columns and len(set(df.columns)) == len(df.columns), name


def test_sampling_without_replacement(spark):
    got = [r.speech_index for r in sampling.chosen(spark, 50, 50, 1).collect()]
    assert sorted(got) == list(range(50))
    with pytest.raises(ValueError):
        sampling.chosen(spark, 5, 6, 0)


def test_in_bins_is_half_open(spark):
    rows = spark.createDataFrame([(2.0,), (1.999,)], "snr double")
    assert sorted(r.bin_index for r in scoring.in_bins(rows, scoring.bins_table(spark, [(0.0, 2.0), (2.0, 4.0)])).collect()) == [0, 1]
