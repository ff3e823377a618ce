"""Audio records, archives of impulse responses, and their ingestion."""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dsp, text
from ..operators import rooms
from . import files

#: Files that one call may name; their names go through the driver.
MAX_PATHS = 100_000

_DECODED = pa.struct([("audio", pa.list_(pa.float64())), ("sr", pa.int32())])


def parquet(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """Parquet files by path or pattern; columns are pruned in the scan."""
    rows = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return rows.select(*columns) if columns else rows


def with_bytes(rows: DataFrame, audio: str = "audio") -> DataFrame:
    """Rows whose records (bytes, path), or paths, have their bytes; a record with neither is an error.

    Files that are named by path are read by Spark, so the path may be in any store.
    """
    spark = rows.sparkSession
    if rows.schema[audio].dataType.simpleString() == "string":
        rows = rows.withColumn(audio, F.struct(F.lit(None).cast("binary").alias("bytes"), F.col(audio).alias("path")))
    missing = F.col(f"{audio}.bytes").isNull()
    paths = [r[0] for r in rows.where(missing & (F.coalesce(F.col(f"{audio}.path"), F.lit("")) != "")).select(f"{audio}.path").distinct().limit(MAX_PATHS + 1).collect()]
    if len(paths) > MAX_PATHS:
        raise ValueError(f"more than {MAX_PATHS} files by path; read them by folder")
    if paths:
        files = spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^file:/+", "/").alias("_path"), "content")
        rows = rows.join(files, F.regexp_replace(f"{audio}.path", "^file:/+", "/") == F.col("_path"), "left").withColumn("_bytes", F.coalesce(f"{audio}.bytes", "content")).drop("_path", "content")
    else:
        rows = rows.withColumn("_bytes", F.col(f"{audio}.bytes"))
    checked = F.when(F.col("_bytes").isNull(), F.raise_error(F.lit("an audio record has neither bytes nor a path"))).otherwise(F.col("_bytes"))
    return rows.withColumn(audio, F.struct(checked.alias("bytes"), F.col(f"{audio}.path").alias("path"))).drop("_bytes")


def decoded(data: Column, sr: int | None = None) -> Column:
    """Struct (audio, sr) of WAV bytes, at the rate ``sr`` if one is given."""

    def work(files: pa.Array) -> pa.Array:
        out = []
        for x in files.to_pylist():
            wave, rate = dsp.wav_read(x)
            out.append({"audio": (dsp.resampled(wave, rate, sr) if sr else wave).tolist(), "sr": sr or rate})
        return pa.array(out, _DECODED)

    return F.arrow_udf(work, "struct<audio:array<double>,sr:int>")(data)


#: Bytes of a WAV record that are sent to Python for its duration.
HEAD = 4096


def seconds(data: Column) -> Column:
    """Duration from the header of WAV bytes.

    Only ``HEAD`` bytes and the length of a record leave the JVM; records whose samples begin beyond (long chunks of other kinds before) are sent whole.
    """

    def from_head(heads: pa.Array, sizes: pa.Array) -> pa.Array:
        out = []
        for head, size in zip(heads.to_pylist(), sizes.to_pylist(), strict=True):
            try:
                out.append(None if head is None else files.wav_head(io.BytesIO(head), size)["seconds"])
            except ValueError:
                out.append(None)
        return pa.array(out, pa.float64())

    def whole(records: pa.Array) -> pa.Array:
        return pa.array([None if x is None else dsp.wav_seconds(x) for x in records.to_pylist()], pa.float64())

    first = F.arrow_udf(from_head, "double")(F.substring(data, 1, HEAD), F.octet_length(data))
    return F.coalesce(first, F.arrow_udf(whole, "double")(F.when(first.isNull(), data)))


def encoded(audio: Column, sr: int, subtype: str = "PCM_16") -> Column:
    """WAV bytes of a waveform, at its own level."""
    return F.arrow_udf(lambda waves: pa.array([dsp.wav_bytes(np.asarray(x, float), sr, subtype) for x in waves.to_pylist()], pa.binary()), "binary")(audio)


def resampled(audio: Column, rate: Column, wanted: int) -> Column:
    def work(waves: pa.Array, rates: pa.Array) -> pa.Array:
        return pa.array([dsp.resampled(np.asarray(w, float), r, wanted).tolist() for w, r in zip(waves.to_pylist(), rates.to_pylist(), strict=True)], pa.list_(pa.float64()))

    return F.arrow_udf(work, "array<double>")(audio, rate)


def members(spark: SparkSession, folder: str, split: int = files.SPLIT_BYTES) -> DataFrame:
    """Impulse responses in ``folder/*.zip``: ``room_type``, ``room``, ``name``, ``src``, ``rec``, ``bytes``.

    An archive of any size is read by several tasks (see :class:`sonoquery.sources.files.ArchiveMembers`).
    Names must end in ``_hybrid_IR.wav`` and begin with S<number>_R<number>, which are read as numbers.
    """
    if not files.listed(folder, ".zip"):
        raise FileNotFoundError(f"no .zip archives in {folder}")
    rows = files.registered(spark).read.format("zipmembers").option("ending", "_hybrid_IR.wav").option("split", str(split)).load(folder)
    parts = F.split("name", "/")
    stem = F.element_at(parts, -1)
    rows = rows.where(stem.rlike(r"^S([0-9]+)_R([0-9]+)"))
    number = lambda i: F.regexp_extract(stem, r"^S([0-9]+)_R([0-9]+)", i).cast("bigint")
    return rows.select(F.regexp_extract("archive", r"([^/]+)\.zip$", 1).alias("room_type"), F.element_at(parts, -2).alias("room"), "name", number(1).alias("src"), number(2).alias("rec"), "bytes")


def durations(spark: SparkSession, folder: str) -> DataFrame:
    """(path, seconds, ...) of the WAV files below ``folder``, from ranged reads of their headers; filters are pushed to the scan."""
    return files.registered(spark).read.format("wavheads").load(folder)


def sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata in ``folder/<type>/<room>/S<src>_R<rec>*.json``; two files for one place are an error."""
    rows = spark.read.schema("src_loc array<double>, rec_loc array<double>").option("multiLine", "true").json(f"{folder.rstrip('/')}/*/*/*.json").select("src_loc", "rec_loc", F.col("_metadata.file_path").alias("_path"))
    part = lambda i: F.regexp_extract("_path", r"([^/]+)/([^/]+)/S([0-9]+)_R([0-9]+)[^/]*\.json$", i)
    rows = rows.where(part(3) != "").select(part(1).alias("room_type"), part(2).alias("room"), part(3).cast("bigint").alias("src"), part(4).cast("bigint").alias("rec"), "src_loc", "rec_loc")
    keys = ["room_type", "room", "src", "rec"]
    one = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.first("src_loc").alias("src_loc"), F.first("rec_loc").alias("rec_loc"))
    return one.withColumn("src", F.when(F.col("_n") > 1, F.raise_error(F.lit("two metadata files for one source and receiver")).cast("bigint")).otherwise(F.col("src"))).drop("_n")


def _described(files: pa.Array, distances: pa.Array, sr: int, subtype: str) -> pa.Array:
    out = []
    for data, distance in zip(files.to_pylist(), distances.to_pylist(), strict=True):
        wave, rate = dsp.wav_read(data)
        wave = dsp.resampled(wave, rate, sr)
        at = dsp.direct_sample(wave, distance, sr)
        out.append({"bytes": dsp.wav_bytes(wave, sr, subtype), "c50": dsp.c50_db(wave, at, sr), "t30": dsp.t30_s(wave, at, sr)})
    return pa.array(out, pa.struct([("bytes", pa.binary()), ("c50", pa.float32()), ("t30", pa.float32())]))


def ingest(responses: DataFrame, metadata: DataFrame, sr: int = 16_000, receivers_per_room: int = 0, seed: int = 0, subtype: str = "PCM_16") -> DataFrame:
    """The table of impulse responses (``schema.RIR``) from members and side-cars.

    Places without metadata are left out.  Descriptors are taken before the
    encoding, and levels stay as they are.
    """
    rows = rooms.keep_receivers(responses, receivers_per_room, seed, "room", "rec")
    rows = rows.join(metadata, ["room_type", "room", "src", "rec"])
    gap = F.sqrt(F.aggregate(F.zip_with("src_loc", "rec_loc", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    rows = rows.withColumn("_d", gap)
    rows = rows.withColumn("_x", F.arrow_udf(lambda a, b: _described(a, b, sr, subtype), "struct<bytes:binary,c50:float,t30:float>")("bytes", "_d"))
    path = F.concat(F.col("room"), F.lit("/S"), F.col("src").cast("string"), F.lit("_R"), F.col("rec").cast("string"), F.lit(".wav"))
    out = rows.select(
        F.struct(F.col("_x.bytes").alias("bytes"), path.alias("path")).alias("audio"), F.col("room").alias("Room"), text.room_description(F.col("room")).alias("Room Description"),
        F.concat(F.lit("R"), F.col("rec").cast("string")).alias("Receiver Label"), F.col("_d").cast("float").alias("Direct Path Length [m]"), F.col("_x.c50").alias("Avg C50"), F.col("_x.t30").alias("Avg T30"), "room_type", "name",
    )
    return out


def write_shards(rows: DataFrame, path: str, shards: int = 1) -> None:
    """Parquet in ``shards`` files, in the order of archive, room and name."""
    order = [F.col(c) for c in ("room_type", "Room", "name")]
    ordered = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    ordered.drop("room_type", "name").write.mode("overwrite").parquet(path)


def store_rooms(rows: DataFrame, path: str, room: str, spread: str, tasks: int = 8) -> DataFrame:
    """``rows`` in a folder for each ``room``, and the table read back.

    A room's rows are dealt to ``tasks`` tasks by the column ``spread``, so a room that holds most rows is no single task's; a room has
    as many files at most.  Rows of a null room have a folder of their own.
    """
    dealt = rows.repartition(F.col(room), F.pmod(F.xxhash64(spread), F.lit(tasks)))
    dealt.write.mode("overwrite").partitionBy(room).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def store_blocks(rows: DataFrame, name: str, blocks: int, row: str = "row_id") -> DataFrame:
    """``rows`` stored as a table of ``blocks`` buckets by ``row``, each sorted by it.

    Joins by ``row`` read the buckets as they lie: what is looked up is shuffled to them, the waveforms are not.
    """
    rows.write.mode("overwrite").bucketBy(blocks, row).sortBy(row).saveAsTable(name)
    return rows.sparkSession.table(name)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``row_id``, their number in a stable order.

    Range partitions are numbered within and shifted by the sizes of those before
    them, so no task holds the whole table.
    """
    n = max(1, math.ceil(rows.count() / 100_000))
    parts = rows.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()).persist()
    sizes = sorted((r["_p"], r["count"]) for r in parts.groupBy("_p").count().collect())
    shift, base = {}, 0
    for p, size in sizes:
        shift[p], base = base, base + size
    offset = F.try_element_at(F.create_map(*[F.lit(x) for kv in shift.items() for x in kv]), F.col("_p")) if shift else F.lit(0)
    inside = Window.partitionBy("_p").orderBy(*order)
    return parts.withColumn("row_id", (F.row_number().over(inside) - 1 + offset).cast("bigint")).drop("_p")
