"""Whole runs: evaluation, sweep, training scenes, ingestion and the audit of folds.

Transcription is outside: a run gives scenes, and takes hypotheses as a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..operators import rooms, sampling, scenes, scoring
from ..schema import Params
from ..sources import audio, sinks


def responses_of_fold(corpus: DataFrame, fold: int, training: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(training, validation) responses: a corpus of its own for training if there is one, else the fold's rooms."""
    if training is not None:
        return training, corpus
    train, validation = schema.fold_rooms(fold)
    return rooms.in_rooms(corpus, list(train)), rooms.in_rooms(corpus, list(validation))


def speech_split(rows: DataFrame, params: Params, text_column: str = "text", seconds: str = "seconds") -> DataFrame:
    """Utterances that are long enough, with their transcript as ``text``."""
    if text_column != "text":
        rows = rows.withColumnRenamed(text_column, "text")
    return rows.where(F.col(seconds) >= params.min_seconds)


def validation_rows(rows: DataFrame, params: Params) -> DataFrame:
    return rooms.subset(rows, params.validation_examples, params.validation_seed)


def training_scenes(speech: DataFrame, noise: DataFrame, responses: DataFrame, params: Params, epoch: int = 0) -> DataFrame:
    """A scene for each utterance, clean or rendered, of one epoch."""
    index = sampling.RankIndex.of(responses)
    drawn = sampling.recipes(speech.select(F.col("row_id").alias("speech_index")), index, noise.count(), params, params.base_seed, epoch).persist()
    mixed = scenes.gather(drawn.where(~F.col("is_clean")).drop("is_clean"), speech, noise, responses)
    return scenes.render(mixed, params.sample_rate).unionByName(scenes.clean(drawn.where("is_clean"), speech))


def _base(speech: DataFrame, noise: DataFrame, responses: DataFrame, params: Params, n: int, seed: int) -> DataFrame:
    spark = speech.sparkSession
    utterances = sampling.chosen(spark, speech.count(), n, seed).select("speech_index")
    drawn = sampling.recipes(utterances, sampling.RankIndex.of(responses), noise.count(), params, seed, mode="eval").drop("is_clean")
    return scenes.gather(drawn, speech, noise, responses).persist()


def _rendered(base: DataFrame, found: DataFrame, params: Params) -> DataFrame:
    """Scenes of accepted targets, with their condition."""
    own = scenes.require(found).select(F.col("speech_index").alias("_i"), "condition", "rejected", F.col("target_snr_db").alias("_target"))
    rows = base.join(own, F.col("speech_index") == F.col("_i")).withColumn("target_snr_db", F.col("_target"))
    # the condition travels in the id, as a scene's row has the scene's columns only
    numbers = own.select("condition").distinct().select("condition", F.dense_rank().over(Window.orderBy("condition")).cast("bigint").alias("_c"))
    count = numbers.count()
    rows = rows.join(F.broadcast(numbers), "condition").withColumn("speech_index", F.col("speech_index") * count + F.col("_c") - 1)
    out = scenes.render(rows, params.sample_rate).withColumn("_c", F.col("scene_id") % count + 1).join(F.broadcast(numbers), "_c")
    return out.withColumn("speech_index", F.floor(F.col("scene_id") / count).cast("bigint")).drop("_c", "scene_id")


def evaluation_scenes(speech: DataFrame, noise: DataFrame, responses: DataFrame, params: Params, seed: int = 0) -> DataFrame:
    """Every chosen utterance clean and in the bands, rendered from one recipe: ``speech_index``, ``condition``, audio, text, metadata."""
    base = _base(speech, noise, responses, params, params.samples_per_band, seed)
    banded = _rendered(base, scenes.accepted_in_bands(base, params.sample_rate, seed, params.max_attempts), params)
    clean = scenes.clean(base.select("speech_index"), speech).withColumn("condition", F.lit("clean")).withColumnRenamed("scene_id", "speech_index")
    return banded.unionByName(clean)


def sweep_scenes(speech: DataFrame, noise: DataFrame, responses: DataFrame, params: Params, seed: int = 0) -> DataFrame:
    """Every chosen utterance in each bin; the condition is the bin's number."""
    base = _base(speech, noise, responses, params, params.samples_per_bin, seed)
    bins = scoring.build_bins(*params.sweep)
    return _rendered(base, scenes.accepted_in_bins(base, bins, params.sample_rate, seed, params.max_attempts), params)


def scored(made: DataFrame, hypotheses: DataFrame, spelling: dict[str, str] | None) -> DataFrame:
    """Scenes with their hypotheses (speech_index, condition, hypothesis), normalized and scored.

    A reference that is empty after normalization is an error, and so is a scene
    whose transcript isn't its utterance's in another condition.
    """
    rows = made.select("speech_index", "condition", F.col("text").alias("reference"), F.col("metadata.final_snr_db").alias("snr"), F.col("metadata.target_snr_db").alias("target_snr_db"))
    changed = rows.groupBy("speech_index").agg(F.countDistinct("reference").alias("n")).where("n > 1").limit(1).count()
    if changed:
        raise ValueError("a transcript differs between the conditions of an utterance")
    return scoring.score_texts(rows.join(hypotheses, ["speech_index", "condition"]), spelling, on_empty="error")


def summary(rows: DataFrame) -> DataFrame:
    """Scores of each condition."""
    return rows.groupBy("condition").agg(*scoring.scores())


def write_results(rows: DataFrame, folder: str, **run) -> str:
    """Predictions as JSON lines in ``folder``; returns the summary's JSON."""
    sinks.jsonl(scoring.prediction_rows(rows), f"{folder.rstrip('/')}/predictions")
    return sinks.summary_json(summary(rows), "condition", **run)


def ingest(spark: SparkSession, archives: str, metadata: str, output: str, sample_rate: int = 16_000, receivers_per_room: int = 0, seed: int = 0, shards: int = 1, subtype: str = "PCM_16") -> DataFrame:
    """Archives of responses with their side-cars as a Parquet table."""
    if sample_rate <= 0 or shards <= 0 or receivers_per_room < 0:
        raise ValueError("sample_rate and shards must be positive")
    table = audio.ingest(audio.members(spark, archives), audio.sidecars(spark, metadata), sample_rate, receivers_per_room, seed, subtype)
    audio.write_shards(table, output, shards)
    return spark.read.parquet(output)


def audit_folds(rows: DataFrame, sets: DataFrame, allowed: float = 0.01) -> tuple[DataFrame, list[str]]:
    """Checks of (room, description, volume, stored, raw), then the means of each set and a report.

    A difference of stored and raw times above ``allowed``, a room with two
    descriptions or volumes, other rooms than the sets have, and a set without one
    room of each type are errors.
    """
    gap = rooms.tolerance(rows, "stored", "raw").first()
    if (gap.max_error or 0) > allowed:
        raise ValueError(f"stored times differ from the bands' mean by {gap.max_error:.4f} s")
    if rooms.dependency_breaks(rows, "room", "description", "volume").limit(1).count():
        raise ValueError("a room has more than one description or volume")
    per_room = rooms.summary(rows)
    wrong = [f"{r.room} ({r.side})" for r in rooms.set_difference(sets, per_room).limit(100).collect()]
    if wrong:
        raise ValueError("rooms differ from the sets: " + ", ".join(sorted(wrong)))
    rooms.check_types(per_room, sets)
    means = rooms.macro_means(per_room, sets)
    lines = [f"stored against bands: mean {gap.mean_error:.6f} s, largest {gap.max_error:.6f} s"]
    lines += [f"set {r.room_set}: volume {r.mean_volume:.3f} m3, T30 {r.stored_mean:.3f} s stored, {r.raw_mean:.3f} s from bands" for r in means.orderBy("room_set").collect()]
    lines += [f"fold {k}: train={a}, validation={b}" for k, (a, b) in schema.FOLDS.items()]
    return means, lines
