"""Queries on recipes, rendered scenes and audio files; embeddings stand in for waveforms at 1000 samples a second."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signal
from ..operators import sampling, scenes, scoring
from ..schema import Params
from ..sources import audio
from . import room_queries
from .scoring_queries import rounded, table
from .signal_queries import SR

PARAMS = replace(Params(), sample_rate=SR)


def sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Speech, noise and responses: the clips, the clips backwards, and the clips as they fade."""
    rows = room_queries.responses(spark, sf_dir).withColumn("receiver", F.concat(F.lit("R"), F.col("receiver").cast("string")))
    wave = F.col("embedding").cast("array<double>")
    speech = rows.select("row_id", wave.alias("audio"), F.concat(F.lit("clip "), F.col("row_id").cast("string")).alias("text"))
    noise = rows.select("row_id", F.reverse(wave).alias("audio"))
    faded = F.transform(wave, lambda x, i: x * F.exp(-i / 10.0))
    responses = rows.select("row_id", "room", "receiver", faded.alias("audio"), ((F.col("row_id") % 20) * 0.343).alias("distance"))
    return speech, noise, responses


def recipes(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    speech, noise, responses = sources(spark, sf_dir)
    index = sampling.RankIndex.of(responses)
    return sampling.recipes(speech.select(F.col("row_id").alias("speech_index")), index, noise.count(), PARAMS, PARAMS.base_seed, mode=mode)


def recipe_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes(spark, sf_dir, "train")


def gathered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.gather(recipes(spark, sf_dir, "eval").drop("is_clean"), *sources(spark, sf_dir))


def render_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every clip of the training mixture: clean as it is, the others rendered."""
    speech, noise, responses = sources(spark, sf_dir)
    drawn = recipes(spark, sf_dir, "train")
    mixed = scenes.render(scenes.gather(drawn.where(~F.col("is_clean")).drop("is_clean"), speech, noise, responses), SR)
    every = mixed.unionByName(scenes.clean(drawn.where("is_clean"), speech))
    m = F.col("metadata")
    return rounded(every.select("scene_id", "text", "is_clean", F.size("audio").cast("bigint").alias("samples"), signal.peak(F.col("audio")).alias("peak"), signal.sound_item(F.col("audio")).alias("valid"), m["target_snr_db"].alias("target_snr_db"), m["final_snr_db"].alias("final_snr_db"), m["clipping_scale"].alias("clipping_scale"), m["clipped"].alias("clipped")))


def rejection_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scenes.accepted_in_bands(gathered(spark, sf_dir), SR, 0, PARAMS.max_attempts))


def rejection_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scenes.accepted_in_bins(gathered(spark, sf_dir), scoring.build_bins(*PARAMS.sweep), SR, 0, PARAMS.max_attempts))


def audio_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waveforms through WAV files and back, and to another rate."""
    speech, _, _ = sources(spark, sf_dir)
    rows = speech.withColumn("wav", audio.encoded(F.col("audio"), SR)).withColumn("back", audio.decoded(F.col("wav")))
    # 16-bit samples are written as a rounded 32767th (of 32-bit floats) and read as a 32768th, so the error grows with the level
    close = lambda a, b: F.abs(a - b) <= (F.abs(a) + 0.5) / 32768 + F.abs(a) / (1 << 24)
    near = (F.size("audio") == F.size("back.audio")) & F.forall(F.zip_with("audio", "back.audio", close), lambda x: x)
    double = audio.resampled(F.col("audio"), F.lit(SR), 2 * SR)
    return rows.select(F.col("row_id").alias("id"), F.octet_length("wav").cast("bigint").alias("bytes"), F.col("back.sr").alias("sr"), F.round(audio.seconds(F.col("wav")), 6).alias("seconds"), near.alias("close"), F.size(double).cast("bigint").alias("resampled"))


def chosen_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("speech_index"), "text")
    return sampling.chosen(spark, rows.count(), 20, 0).join(rows, "speech_index")


def shuffled_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in the order of the permutation."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("speech_index"), F.char_length("text").cast("bigint").alias("n_chars"))
    n = rows.count()
    return sampling.chosen(spark, n, n, 7).withColumn("place", F.col("place").cast("bigint")).join(rows, "speech_index")


def _chosen_sql(table: str, own: str, n: str, seed: int) -> str:
    """The permutation over a table whose ids are 0, 1, 2 ...; places outside are permuted again by recursion."""
    a, b = "(SELECT a FROM size)", "(SELECT b FROM size)"
    once = lambda source: sampling.permuted_sql(source, "(SELECT n FROM size)", (a, b), seed)
    return f"""WITH RECURSIVE total AS (SELECT count(*)::BIGINT AS n FROM {table}),
side AS (SELECT n, max(k) + 1 AS a FROM total, range(0, 4096) r(k) WHERE k = 0 OR k * k <= n - 1 GROUP BY n),
size AS (SELECT n, a, (n + a - 1) // a AS b FROM side),
places AS (SELECT k, k AS x FROM range(0, {n}) r(k)),
walk AS (SELECT k, x FROM ({once('places')}) UNION ALL SELECT k, x FROM ({once('(SELECT k, x FROM walk WHERE x >= (SELECT n FROM size))')}))
SELECT {own} FROM walk JOIN {table} ON x = {'item_id' if table == 'benchmark' else 'doc_id'}"""


def rank_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every response's address: the numbers of its room and receiver, its rank, and the sizes that draws need."""
    index = sampling.RankIndex.of(room_queries.responses(spark, sf_dir))
    rows = index.rows.join(index.groups, ["room", "receiver"]).join(index.rooms, "room")
    return rows.select("row_id", "room", "receiver", "room_no", "receivers", "receiver_no", "size", "rank")


RANKS_SQL = f"""WITH {room_queries.RESPONSES}, sizes AS (SELECT room, receiver, count(*) AS size FROM responses GROUP BY ALL),
groups AS (SELECT *, row_number() OVER (PARTITION BY room ORDER BY receiver) - 1 AS receiver_no FROM sizes),
rooms AS (SELECT *, row_number() OVER (ORDER BY room) - 1 AS room_no FROM (SELECT room, count(*) AS receivers FROM groups GROUP BY room))
SELECT row_id, room, receiver, room_no, receivers, receiver_no, size, row_number() OVER (PARTITION BY room, receiver ORDER BY row_id) - 1 AS rank
FROM responses JOIN groups USING (room, receiver) JOIN rooms USING (room)"""

ALL = (recipe_sample, rank_addresses, render_scene, rejection_bands, rejection_sweep, audio_roundtrip, chosen_utterances, shuffled_utterances)
QUERIES = {f.__name__: f for f in ALL}
SQL = {
    "rank_addresses": RANKS_SQL,
    "chosen_utterances": _chosen_sql("benchmark", "k::INTEGER AS place, x AS speech_index, text", "20", 0),
    "shuffled_utterances": _chosen_sql("documents", "k AS place, x AS speech_index, len(text) AS n_chars", "(SELECT n FROM total)", 7),
    "audio_roundtrip": "SELECT vec_id AS id, 44 + 2 * len(embedding)::BIGINT AS bytes, 1000::INTEGER AS sr, round(len(embedding) / 1000, 6) AS seconds, true AS close, 2 * len(embedding)::BIGINT AS resampled FROM embeddings",
}
