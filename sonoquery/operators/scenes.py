"""Rendering scenes: gather the waveforms of recipes, mix them, and find targets without rendering again.

Waveforms join late: recipes are narrow, and a scene's arrays meet in one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dsp
from ..schema import METADATA
from . import sampling, scoring

#: Uses of one waveform by recipes beyond which it is dealt to several tasks, and waveforms that may be told to be such.
HOT_USES, MAX_HOT = 10_000, 10_000


def meet(rows: DataFrame, key: str, waves: DataFrame, *spread: str) -> DataFrame:
    """``rows`` with the columns of ``waves`` by ``key`` (inner join), where few waveforms may be used by most rows.

    Rows are narrow, waveforms are not.  Uses are counted first; a waveform that has more than ``HOT_USES`` of them (or more than a
    ``MAX_HOT``-th of all, so that there are at most ``MAX_HOT`` such) is copied as often as its uses ask
    for, and its rows are dealt to the copies by a hash of the columns ``spread``.  The others join by key alone, so a table stored by
    :func:`sonoquery.sources.audio.store_blocks` isn't shuffled for them.
    """
    spark = rows.sparkSession
    uses = rows.groupBy(key).agg(F.count("*").alias("_uses"))
    total = uses.agg(F.coalesce(F.sum("_uses"), F.lit(0)).alias("n"), F.coalesce(F.max("_uses"), F.lit(0)).alias("most")).first()
    limit = max(HOT_USES, -(-total["n"] // MAX_HOT))
    if total["most"] <= limit:
        return rows.join(waves, key)
    often = [(r[key], -(-r["_uses"] // limit)) for r in uses.where(F.col("_uses") > limit).collect()]
    copies = F.broadcast(spark.createDataFrame(often, f"{key} {rows.schema[key].dataType.simpleString()}, _copies bigint"))  # at most MAX_HOT rows
    marked = rows.join(copies, key, "left")
    cold = marked.where("_copies is null").drop("_copies").join(waves, key)
    dealt = marked.where("_copies is not null").withColumn("_copy", F.pmod(F.xxhash64(*spread), F.col("_copies"))).drop("_copies")
    hot = waves.join(copies, key).withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1))).drop("_copies")
    return cold.unionByName(dealt.join(hot, [key, "_copy"]).drop("_copy"))


def gather(recipes: DataFrame, speech: DataFrame, noise: DataFrame, responses: DataFrame) -> DataFrame:
    """Recipes with ``clip``, ``text``, ``response``, ``distance`` of the speech and an ordered array ``noises``.

    ``speech`` has (row_id, audio, text), ``noise`` (row_id, audio), ``responses`` (row_id, audio, distance).
    """
    sizes = F.when((F.size("noise_indices") == F.size("noise_rir_indices")) & (F.size("noise_indices") == F.size("offsets_ms")), F.col("noise_indices")).otherwise(F.raise_error(F.lit("noises, responses and offsets differ in number")))
    parts = recipes.select("speech_index", F.posexplode(F.arrays_zip(sizes.alias("noise"), F.col("noise_rir_indices").alias("rir"), F.col("offsets_ms").alias("offset"))).alias("pos", "p"))
    parts = parts.select("speech_index", "pos", F.expr("p.noise").alias("_noise"), F.expr("p.rir").alias("_rir"), F.expr("p.offset").alias("_offset"))
    # each side's waveform meets the narrow parts; only then do they travel to their scene
    clips = meet(parts.select("speech_index", "pos", "_noise", "_offset"), "_noise", noise.select(F.col("row_id").alias("_noise"), F.col("audio").alias("clip")), "speech_index", "pos")
    heard = meet(parts.select("speech_index", "pos", "_rir"), "_rir", responses.select(F.col("row_id").alias("_rir"), F.col("audio").alias("response"), "distance"), "speech_index", "pos")
    clips = clips.groupBy("speech_index").agg(F.sort_array(F.collect_list(F.struct("pos", "clip", F.col("_offset").alias("offset_ms")))).alias("_clips"))
    heard = heard.groupBy("speech_index").agg(F.sort_array(F.collect_list(F.struct("pos", "response", "distance"))).alias("_heard"))
    noises = F.zip_with("_clips", "_heard", lambda c, h: F.struct(c["pos"].alias("pos"), c["clip"].alias("clip"), h["response"].alias("response"), h["distance"].alias("distance"), c["offset_ms"].alias("offset_ms")))
    own = meet(recipes, "speech_rir_index", responses.select(F.col("row_id").alias("speech_rir_index"), F.col("audio").alias("response"), "distance"), "speech_index")
    out = own.join(clips, "speech_index").join(heard, "speech_index").where(F.size("_clips") == F.size("_heard")).withColumn("noises", noises).drop("_clips", "_heard")
    return out.join(speech.select(F.col("row_id").alias("speech_index"), F.col("audio").alias("clip"), "text"), "speech_index")


def _room(clip, response, distance, noises, pink_db, seed, sr: int) -> dsp.Room:
    sources = [dsp.Source(np.asarray(x["clip"], float), np.asarray(x["response"], float), x["distance"], x["offset_ms"]) for x in noises]
    return dsp.room(dsp.Source(np.asarray(clip, float), np.asarray(response, float), distance), sources, sr, pink_db, np.random.default_rng(seed))


_COLUMNS = ("clip", "response", "distance", "noises", "pink_db", "rng_seed")


def _value(x: pa.Scalar):
    """``x`` in Python, with waveforms as arrays."""
    if not pa.types.is_nested(x.type) or not x.is_valid:
        return x.as_py()
    if pa.types.is_struct(x.type):
        return {k: _value(x[k]) for k in x}
    return [_value(v) for v in x.values] if pa.types.is_nested(x.type.value_type) else x.values.to_numpy(zero_copy_only=False)


def _rows(*arrays: pa.Array):
    """One row after another, so that a batch is never there as Python objects."""
    return (tuple(_value(a[i]) for a in arrays) for i in range(len(arrays[0])))


def render(gathered: DataFrame, sr: int) -> DataFrame:
    """Scenes (scene_id, audio, text, is_clean, metadata) at each row's ``target_snr_db``."""

    def work(*arrays: pa.Array) -> pa.Array:
        waves, metas, few = [np.zeros(0)], [], []
        for *parts, target in _rows(*arrays):
            scene = _room(*parts, sr)
            mix = dsp.mixed(scene, target)
            meta = {"sr": sr, "target_snr_db": target, "pink_db": parts[4], "rng_seed": parts[5], "final_snr_db": mix.final_snr_db, "speech_drr_db": scene.speech_drr, "noises": [{"drr_db": d, "offset_ms": x["offset_ms"]} for d, x in zip(scene.noise_drrs, parts[3], strict=True)], "clipping_scale": mix.scale, "clipped": mix.clipped}
            waves.append(mix.audio)
            few.append(meta)
            if len(few) == 256:
                metas.append(pa.array(few, kind[1].type))
                few = []
        metas.append(pa.array(few, kind[1].type))
        ends = pa.array(np.cumsum([len(w) for w in waves]), pa.int32())
        audio = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(waves)))
        return pa.StructArray.from_arrays([audio, pa.concat_arrays(metas)], fields=list(kind))

    noise = pa.struct([("drr_db", pa.float64()), ("offset_ms", pa.float64())])
    meta = pa.struct([("sr", pa.int32()), ("target_snr_db", pa.float64()), ("pink_db", pa.float64()), ("rng_seed", pa.int64()), ("final_snr_db", pa.float64()), ("speech_drr_db", pa.float64()), ("noises", pa.list_(noise)), ("clipping_scale", pa.float64()), ("clipped", pa.bool_())])
    kind = pa.struct([("audio", pa.list_(pa.float64())), ("metadata", meta)])
    scene = F.arrow_udf(work, f"struct<audio:array<double>,metadata:{METADATA}>")(*_COLUMNS, "target_snr_db")
    return gathered.withColumn("_s", scene).select(F.col("speech_index").alias("scene_id"), F.col("_s.audio").alias("audio"), "text", F.lit(False).alias("is_clean"), F.col("_s.metadata").alias("metadata"))


def clean(indices: DataFrame, speech: DataFrame) -> DataFrame:
    """Scenes that are the speech alone."""
    rows = indices.select("speech_index").join(speech, F.col("speech_index") == F.col("row_id"))
    return rows.select(F.col("speech_index").alias("scene_id"), "audio", "text", F.lit(True).alias("is_clean"), F.lit(None).cast(METADATA).alias("metadata"))


def statistics(gathered: DataFrame, sr: int) -> DataFrame:
    """(speech_index, ps, pn, pp, c): all that the realized ratio depends on besides the target."""

    def work(*arrays: pa.Array) -> pa.Array:
        out = np.array([_room(*parts, sr).statistics() for parts in _rows(*arrays)], float).reshape(-1, 4)
        return pa.StructArray.from_arrays([pa.array(column) for column in out.T.copy()], ["ps", "pn", "pp", "c"])

    return gathered.withColumn("_s", F.arrow_udf(work, "struct<ps:double,pn:double,pp:double,c:double>")(*_COLUMNS)).select("speech_index", "_s.*")


def realized(ps: Column, pn: Column, pp: Column, c: Column, target: Column) -> Column:
    """Ratio that a scene reaches: the noise's gain meets the target before the pink noise is added."""
    gain = F.pow(F.lit(10.0), (F.log10(ps / (pn + dsp.EPS)) * 10 - target) / 20)
    return F.log10(ps / (gain * gain * pn + gain * c * 2 + pp + dsp.EPS)) * 10


def accepted(gathered: DataFrame, ranges: list[tuple[str, float, float]], inside, sr: int, seed: int, attempts: int) -> DataFrame:
    """For each scene and condition, the first target whose realized ratio is inside; null if no attempt is.

    ``ranges`` are (condition, low, high) of the targets; ``inside(snr, condition)``
    is the test.  Each scene is mixed once, whatever the number of attempts.
    """
    spark = gathered.sparkSession
    names = spark.createDataFrame([(i, n) for i, (n, _, _) in enumerate(ranges, 1)], "condition_index int, condition string")
    tries = sampling.targets(gathered.select("speech_index"), [(a, b) for _, a, b in ranges], seed, attempts).join(F.broadcast(names), "condition_index")
    rows = tries.join(statistics(gathered, sr), "speech_index").withColumn("snr", realized(*(F.col(x) for x in ("ps", "pn", "pp", "c", "target"))))
    ok = inside(F.col("snr"), F.col("condition"))
    first = F.min(F.when(ok, F.struct("attempt", "target", "snr")))
    return rows.groupBy("speech_index", "condition_index", "condition").agg(first.alias("_f")).select("speech_index", "condition_index", "condition", F.col("_f.attempt").alias("rejected"), F.col("_f.target").alias("target_snr_db"), F.col("_f.snr").alias("realized_snr_db"))


def accepted_in_bands(gathered: DataFrame, sr: int, seed: int, attempts: int) -> DataFrame:
    ranges = [(n, *scoring.TARGETS[n]) for n in ("high", "mid", "low")]
    return accepted(gathered, ranges, lambda snr, name: F.coalesce(scoring.band_eval(snr) == name, F.lit(False)), sr, seed, attempts)


def accepted_in_bins(gathered: DataFrame, bins: list[tuple[float, float]], sr: int, seed: int, attempts: int) -> DataFrame:
    ranges = [(str(i), a, b) for i, (a, b) in enumerate(bins)]

    def inside(snr: Column, name: Column) -> Column:
        hit = F.lit(False)
        for label, low, high in ranges:
            hit = F.when(name == label, (snr >= low) & (snr < high)).otherwise(hit)
        return F.coalesce(hit, F.lit(False))

    return accepted(gathered, ranges, inside, sr, seed, attempts)


def require(found: DataFrame) -> DataFrame:
    """``found`` of :func:`accepted`; a scene that no attempt brought into its condition is an error."""
    message = F.concat(F.lit("no attempt reached condition "), F.col("condition"), F.lit(" for scene "), F.col("speech_index").cast("string"))
    return found.withColumn("rejected", F.when(F.col("rejected").isNull(), F.raise_error(message)).otherwise(F.col("rejected")))
