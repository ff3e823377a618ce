"""Queries on archives and audio files; both are built from embeddings by Spark, in the shared folder."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import dsp, signal, tables
from ..operators import rooms
from ..sources import audio, files
from .room_queries import RESPONSES, SETS, responses
from .scoring_queries import rounded, table
from .signal_queries import DIRECT, SR, square

#: Responses of one archive.
ARCHIVE = 64


def _zipped(group: pa.Table) -> pa.Table:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as bundle:
        for name, wave in zip(group.column("name").to_pylist(), group.column("embedding"), strict=True):
            entry = zipfile.ZipInfo(name)  # a fixed date, so that a task that runs again writes the same
            bundle.writestr(entry, dsp.wav_bytes(wave.values.to_numpy(zero_copy_only=False), SR, "FLOAT"))
    return pa.table({"path": [group.column("room_type")[0].as_py() + ".zip"], "bytes": [buffer.getvalue()]}, pa.schema([("path", pa.string()), ("bytes", pa.binary())]))


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, part = F.col("vec_id"), F.floor(F.col("vec_id") / ARCHIVE).cast("string")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.concat(F.lit("type"), part).alias("room_type"), F.concat(F.lit("Room"), F.col("label").cast("string"), F.lit("_idx_"), part).alias("room"))
    return rows.withColumn("name", F.format_string("%s/S%d_R%03d_hybrid_IR.wav", "room", v, v % 4))


def _archives(spark: SparkSession, sf_dir: str) -> str:
    folder = files.shared_folder(spark)
    rows = _responses(spark, sf_dir).groupBy("room_type").applyInArrow(_zipped, "path string, bytes binary")
    files.write_files(rows, folder)
    return folder


def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What archives of all responses hold: places, sizes and sounds, read in ranges of 16 KB."""
    rows = audio.members(spark, _archives(spark, sf_dir), split=16 << 10).withColumn("wave", audio.decoded(F.col("bytes")))
    weighted = F.aggregate(F.transform("wave.audio", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return rows.select("room_type", "room", "src", "rec", F.octet_length("bytes").cast("bigint").alias("bytes"), F.col("wave.sr").alias("sr"), F.round(weighted, 6).alias("moment"))


def archive_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of impulse responses from archives and the places of sources and receivers; every seventh place is unknown."""
    gap = (F.col("vec_id") % 20) * F.lit(0.343)
    known = _responses(spark, sf_dir).where("vec_id % 7 <> 3").select("room_type", "room", F.col("vec_id").alias("src"), (F.col("vec_id") % 4).alias("rec"), F.array(F.lit(1.0), gap, F.lit(0.0)).alias("src_loc"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("rec_loc"))
    rows = audio.ingest(audio.members(spark, _archives(spark, sf_dir)), known, SR, subtype="FLOAT")
    shown = rows.select(F.col("audio.path").alias("path"), F.col("Room").alias("room"), F.col("Room Description").alias("description"), F.col("Receiver Label").alias("receiver"), F.octet_length("audio.bytes").cast("bigint").alias("bytes"), *(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(n) for c, n in (("Direct Path Length [m]", "distance"), ("Avg C50", "c50_db"), ("Avg T30", "t30_s"))))
    return rounded(shown, 3)


def header_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of clips of several lengths that are long enough, by their headers alone."""
    folder = files.shared_folder(spark)
    clip = F.slice("embedding", 1, (F.col("vec_id") % 64 + 1).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select(F.format_string("label%d/clip%d.wav", "label", "vec_id").alias("path"), audio.encoded(clip.cast("array<double>"), SR).alias("bytes"))
    files.write_files(rows, folder)
    found = audio.durations(spark, folder).where(F.col("seconds") >= 0.04)
    return found.select(F.regexp_extract("path", r"clip([0-9]+)\.wav$", 1).cast("bigint").alias("id"), F.regexp_extract("path", r"label([0-9]+)/", 1).cast("int").alias("label"), "sr", "bits", "frames", F.round("seconds", 6).alias("seconds"), (F.col("bytes_read") <= 2 * files.HEAD_BYTES).alias("by_header"))


def archive_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors of all responses in archives, by a table function in SQL."""
    rows = audio.members(spark, _archives(spark, sf_dir)).withColumn("gap", (F.col("src") % 20) * F.lit(0.343))
    found = tables.registered(spark).sql(
        """SELECT r.src AS id, r.room, d.sr, d.samples, d.direct, d.drr_db, d.c50_db
FROM {rows} r, LATERAL descriptors(r.bytes, r.gap, 'sr, samples, direct, drr_db, c50_db') d""",
        rows=rows,
    )
    return rounded(found, 5)


def fold_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy by receiver of a fold's validation rooms, from responses stored by room; the folders of other rooms aren't read."""
    stored = audio.store_rooms(responses(spark, sf_dir), files.shared_folder(spark), "room", "row_id")
    own = schema.room_sets(spark).where(F.col("room_set") == schema.FOLDS[1][1])
    rows = rooms.in_stored_rooms(stored, own)
    power = signal.energy(F.col("embedding").cast("array<double>"))
    return rounded(rows.groupBy("room", "receiver").agg(F.count("*").alias("n"), F.sum(power).alias("energy")), 5)


ALL = (archive_members, archive_ingest, header_durations, archive_descriptors, fold_stored)
QUERIES = {f.__name__: f for f in ALL}

PLACES = f"places AS (SELECT vec_id, embedding, 'type' || (vec_id // {ARCHIVE}) AS room_type, 'Room' || label || '_idx_' || (vec_id // {ARCHIVE}) AS room FROM embeddings)"
SQL = {
    "archive_members": f"""WITH {PLACES} SELECT room_type, room, vec_id AS src, vec_id % 4 AS rec, (44 + 4 * len(embedding))::BIGINT AS bytes, {SR}::INTEGER AS sr,
round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE * i)), 6) AS moment FROM places""",
    "archive_ingest": f"""WITH {PLACES}, {DIRECT}, e AS (SELECT id, {square('a[direct + 1:direct + 50]')} AS early, {square('a[direct + 51:]')} AS late FROM heard),
faded AS (SELECT id, i - 1 - direct AS pos, a[i] AS x FROM heard, range(1, 65) r(i) WHERE i > direct),
sums AS (SELECT id, pos, sum(x * x) OVER (PARTITION BY id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) AS s FROM faded),
curve AS (SELECT id, pos, 10 * log10(greatest(s / max(s) OVER (PARTITION BY id), 1e-20)) AS db FROM sums),
ends AS (SELECT id, min(pos) FILTER (WHERE db <= -5) AS a, min(pos) FILTER (WHERE db <= -35) AS b FROM curve GROUP BY id)
SELECT room || '/S' || vec_id || '_R' || (vec_id % 4) || '.wav' AS path, room, regexp_replace(room, '_idx_[0-9]+$', '') AS description, 'R' || (vec_id % 4) AS receiver, (44 + 4 * len(embedding))::BIGINT AS bytes,
       round(((vec_id % 20) * 0.343::DOUBLE)::FLOAT::DOUBLE, 3) AS distance, CASE WHEN early > 0 AND late > 0 THEN round((10 * log10(early / late))::FLOAT::DOUBLE, 3) END AS c50_db, round((2.0 * (b - a) / {SR})::FLOAT::DOUBLE, 3) AS t30_s
FROM places JOIN e ON e.id = vec_id JOIN ends ON ends.id = vec_id WHERE vec_id % 7 <> 3""",
    "header_durations": f"""SELECT vec_id AS id, label, {SR}::INTEGER AS sr, 16::INTEGER AS bits, vec_id % 64 + 1 AS frames, round((vec_id % 64 + 1) / {SR}.0::DOUBLE, 6) AS seconds, true AS by_header
FROM embeddings WHERE (vec_id % 64 + 1) / {SR}.0::DOUBLE >= 0.04""",
    "archive_descriptors": f"""WITH {PLACES}, {DIRECT}, e AS (SELECT id, direct, len(a) AS samples, {square('a')} AS whole, {square('a[greatest(0, direct - 1) + 1:least(len(a), direct + 2)]')} AS near,
       {square('a[direct + 1:direct + 50]')} AS early, {square('a[direct + 51:]')} AS late FROM heard)
SELECT id, room, {SR}::INTEGER AS sr, samples, direct, round(10 * log10((near + 1e-12) / (greatest(whole - near, 0) + 1e-12)), 5) AS drr_db,
       CASE WHEN early <= 0 OR late <= 0 THEN 'NaN'::DOUBLE ELSE round(10 * log10(early / late), 5) END AS c50_db FROM e JOIN places ON vec_id = id""",
    "fold_stored": f"""WITH {RESPONSES}, {SETS} SELECT room, receiver, count(*) AS n, round(sum({square('embedding::DOUBLE[]')}), 5) AS energy
FROM responses JOIN sets USING (room) WHERE room_set = '{schema.FOLDS[1][1]}' GROUP BY 1, 2""",
}
