"""Members of archives, WAV headers and files of rows."""

import io
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoquery.functions import dsp
from sonoquery.sources import audio, files


def test_one_archive_in_several_tasks(spark, tmp_path):
    rng = np.random.default_rng(0)
    wanted = {}
    with zipfile.ZipFile(tmp_path / "hall.zip", "w", zipfile.ZIP_DEFLATED) as bundle:
        for i in range(40):
            name = f"hall_idx_1/S{i:03d}_R{i % 4:04d}_hybrid_IR.wav"
            wanted[name] = rng.bytes(5000)
            with bundle.open(name, "w", force_zip64=True) as member:
                member.write(wanted[name])
        bundle.writestr("hall_idx_1/notes.txt", "x")
        bundle.mkdir("empty")
    rows = files.registered(spark).read.format("zipmembers").option("ending", ".wav").option("split", "20000").load(str(tmp_path))
    got = rows.withColumn("p", F.spark_partition_id()).collect()
    assert {r.name: bytes(r.bytes) for r in got} == wanted and len(got) == 40 and all(r.size == 5000 for r in got)
    assert len({r.p for r in got}) >= 5
    members = audio.members(spark, str(tmp_path), split=20000).collect()
    assert sorted((r.room_type, r.room, r.src, r.rec) for r in members) == sorted(("hall", "hall_idx_1", i, i % 4) for i in range(40))


def test_archive_beyond_2_gb(spark, tmp_path):
    """Members behind a hole of 3 GB are found, and only their parts are read."""
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as bundle:
        for i in range(3):
            bundle.writestr(f"r/S{i}_R1_hybrid_IR.wav", bytes([i]) * 100)
    with open(tmp_path / "big.zip", "wb") as file:
        file.seek(3 << 30)
        file.write(inner.getvalue())
    assert os.path.getsize(tmp_path / "big.zip") > 2**31
    got = audio.members(spark, str(tmp_path), split=1 << 30).collect()
    assert sorted((r.src, bytes(r.bytes)) for r in got) == [(i, bytes([i]) * 100) for i in range(3)]


def wav(n, sr=1000, before=b""):
    data = dsp.wav_bytes(np.zeros(n), sr)
    at = data.index(b"data")
    return data[:at] + before + data[at:]


def test_headers_by_ranges(spark, tmp_path):
    long_chunk = b"LIST" + (300_000).to_bytes(4, "little") + bytes(300_000)
    odd_chunk = b"note" + (7).to_bytes(4, "little") + bytes(8)
    for name, data in {"a/x": wav(500_000), "a/y": wav(10, 8000, long_chunk), "b/z": wav(0), "b/w": wav(2500, 1000, odd_chunk * 5)}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / f"{name}.wav").write_bytes(data)
    rows = audio.durations(spark, str(tmp_path))
    got = {r.path[-5:-4]: r for r in rows.collect()}
    assert {k: (r.frames, r.seconds, r.sr) for k, r in got.items()} == {"x": (500_000, 500.0, 1000), "y": (10, 0.00125, 8000), "z": (0, 0.0, 1000), "w": (2500, 2.5, 1000)}
    assert all(r.bytes_read <= 3 * files.HEAD_BYTES for r in got.values())
    kept = rows.where(F.col("seconds") >= 2.5)
    assert sorted(r.path[-5:-4] for r in kept.collect()) == ["w", "x"]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", "")
    assert [r.path[-5:-4] for r in rows.where((F.col("size") > 500_000) & (F.col("sr") == 1000)).collect()] == ["x"]
    assert [r.path[-5:-4] for r in rows.where(F.col("path").endswith("y.wav")).collect()] == ["y"]  # not pushed
    (tmp_path / "bad.wav").write_bytes(b"RIFFxxxxWAVE")
    with pytest.raises(Exception, match="without samples"):
        audio.durations(spark, str(tmp_path)).collect()


def test_seconds_of_records(spark):
    long_chunk = b"LIST" + (9000).to_bytes(4, "little") + bytes(9000)
    rows = spark.createDataFrame([(0, bytearray(wav(2000))), (1, bytearray(wav(30, 1000, long_chunk))), (2, None)], "i int, b binary")
    assert {r.i: r.s for r in rows.select("i", audio.seconds(F.col("b")).alias("s")).collect()} == {0: 2.0, 1: 0.03, 2: None}


def rows_of(spark, names, fail=None):
    def made(batches):
        for batch in batches:
            if fail in batch.column(0).to_pylist():
                raise ValueError("a task fails")
            yield batch

    rows = spark.createDataFrame([(n, bytearray(n.encode())) for n in names], "path string, bytes binary").repartition(4)
    return rows.mapInArrow(made, "path string, bytes binary")


def test_files_of_rows(spark, tmp_path):
    folder = str(tmp_path / "out")
    files.write_files(rows_of(spark, [f"r{i % 3}/f{i}.wav" for i in range(20)]), folder)
    found = {os.path.relpath(p, folder).split("/", 1)[1]: open(p).read() for p, _ in files.listed(folder, ".wav")}
    assert found == {f"r{i % 3}/f{i}.wav": f"r{i % 3}/f{i}.wav" for i in range(20)}
    assert os.path.exists(f"{folder}/_SUCCESS")
    with pytest.raises(Exception, match="a task fails"):
        files.write_files(rows_of(spark, ["new1.wav", "new2.wav", "new3.wav"], fail="new2.wav"), folder)
    assert len(files.listed(folder, ".wav")) == 20 and not [x for x in os.listdir(folder) if x.startswith("_pending")]
    with pytest.raises(Exception, match="no path inside"):
        files.write_files(rows_of(spark, ["../out.wav"]), folder)
    files.write_files(rows_of(spark, ["only.wav"]), folder, mode="overwrite")
    assert [os.path.basename(p) for p, _ in files.listed(folder, ".wav")] == ["only.wav"]


def test_no_archives(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        audio.members(spark, str(tmp_path))
    with pytest.raises(ValueError, match="checkpoint"):
        other = type("S", (), {"conf": type("C", (), {"get": staticmethod(lambda *_: None)}), "sparkContext": type("K", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "yarn"})})
        files.shared_folder(other)
