"""Queries on waveforms and impulse responses; embeddings stand in for both, at 1000 samples a second."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signal
from ..operators import blocks
from .scoring_queries import rounded, table

SR = 1000


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, a, distance): a response whose distance puts the direct sound within it."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("a"), ((F.col("vec_id") % 20) * 0.343).alias("distance"))


def with_direct(df: DataFrame) -> DataFrame:
    return df.withColumn("direct", signal.direct_index(F.col("a"), F.col("distance"), SR))


def shown(df: DataFrame, column: str = "a", digits: int = 6) -> DataFrame:
    """A waveform's size, and its sum weighted by position, which tells order and values."""
    weighted = F.aggregate(F.transform(column, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return df.withColumn("n", F.size(column).cast("bigint")).withColumn("moment", F.round(weighted, digits)).drop(column)


WAVES = "waves AS (SELECT vec_id AS id, embedding::DOUBLE[] AS a, (vec_id % 20) * 0.343::DOUBLE AS distance FROM embeddings)"
DIRECT = f"""{WAVES}, near AS (SELECT *, greatest(0, round_even(distance / 343.0::DOUBLE * 1000, 0)::INTEGER - 1) AS low, least(len(a), round_even(distance / 343.0::DOUBLE * 1000, 0)::INTEGER + 2) AS high FROM waves),
heard AS (SELECT id, a, distance, (list_position(list_transform(a[low + 1:high], lambda x: abs(x)), list_max(list_transform(a[low + 1:high], lambda x: abs(x)))) - 1 + low)::INTEGER AS direct FROM near)"""
MOMENT = "round(list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i] * i)), 6)"


def square(list_sql: str) -> str:
    return f"coalesce(list_sum(list_transform({list_sql}, lambda x: x * x)), 0.0)"


def rir_direct_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_direct(waves(spark, sf_dir)).select("id", F.col("direct").cast("bigint").alias("direct"))


def rir_drr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(with_direct(waves(spark, sf_dir)).select("id", signal.drr_db(F.col("a"), F.col("direct"), SR).alias("drr_db")))


def rir_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(with_direct(waves(spark, sf_dir)).select("id", signal.trim(F.col("a"), F.col("direct"), SR).alias("a")))


def rir_c50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(with_direct(waves(spark, sf_dir)).select("id", signal.c50_db(F.col("a"), F.col("direct"), SR).alias("c50_db")))


def rir_t30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses that fall off; the first half of the rooms falls too slowly for a value."""
    slope = F.when(F.col("id") % 5 == 0, 60.0).otherwise(3.0)
    df = waves(spark, sf_dir).withColumn("a", F.transform("a", lambda x, i: x * F.exp(-i / slope)))
    df = df.select("id", signal.t30_blocks(F.col("a"), F.lit(0), SR).alias("t30"))
    return df.select("id", F.round(F.nanvl("t30", F.lit(None).cast("double")), 6).alias("t30"))


def signal_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(waves(spark, sf_dir).select("id", signal.rms(F.col("a")).alias("rms")))


def signal_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = waves(spark, sf_dir).withColumn("level", signal.rms(F.col("a")))
    return shown(df.select("id", signal.normalized(F.col("a"), F.col("level")).alias("a")), digits=5)


def signal_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = waves(spark, sf_dir)
    return shown(df.select("id", signal.loop(F.col("a"), (F.col("id") % 200).cast("int"), (F.col("id") % 97).cast("double"), SR).alias("a")))


def active_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 25 ms of clips that fade, the last frame being shorter."""
    df = waves(spark, sf_dir).withColumn("a", F.transform("a", lambda x, i: x * F.exp(-i / 8.0)))
    df = df.withColumn("p", signal.frame_powers(F.col("a"), SR)).withColumn("active", signal.active_frames(F.col("p")))
    samples = F.size(F.filter(signal.mask(F.col("a"), F.col("active"), SR), lambda m: m)).cast("bigint")
    return df.select("id", F.size("p").cast("bigint").alias("frames"), F.size(F.filter("active", lambda x: x)).cast("bigint").alias("active_frames"), samples.alias("active_samples"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clip as speech and the next one as noise."""
    df = waves(spark, sf_dir)
    return df.select("id", F.col("a").alias("speech")).join(df.select((F.col("id") - 1).alias("id"), F.col("a").alias("noise")), "id")


PAIRS = f"{WAVES}, pairs AS (SELECT s.id, s.a AS speech, n.a AS noise FROM waves s JOIN waves n ON n.id = s.id + 1)"


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pairs(spark, sf_dir).withColumn("powers", signal.frame_powers(F.col("speech"), SR)).withColumn("active", signal.active_frames(F.col("powers"), 0.9))
    df = df.withColumn("m", signal.mask(F.col("speech"), F.col("active"), SR))
    return df.select("id", "speech", "noise", signal.power(F.col("speech"), F.col("m")).alias("ps"), signal.power(F.col("noise"), F.col("m")).alias("pn"))


LEVELS = f"""{PAIRS}, framed AS (SELECT *, list_transform(range(0, (len(speech) + 24) // 25), lambda f: list_sum(list_transform(speech[f * 25 + 1:f * 25 + 25], lambda x: x * x)) / len(speech[f * 25 + 1:f * 25 + 25])) AS powers FROM pairs),
flagged AS (SELECT id, speech, noise, list_filter(range(1, len(speech) + 1), lambda i: powers[(i - 1) // 25 + 1] >= 0.9 * (list_max(powers) + 1e-12)) AS m FROM framed),
levels AS (SELECT id, speech, noise, list_sum(list_transform(m, lambda i: speech[i] * speech[i])) / len(m) AS ps, list_sum(list_transform(m, lambda i: noise[i] * noise[i])) / len(m) AS pn FROM flagged)"""


def snr_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(levels(spark, sf_dir).select("id", signal.snr_db(F.col("ps"), F.col("pn")).alias("snr_db")))


def gain_for_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = levels(spark, sf_dir).withColumn("snr", signal.snr_db(F.col("ps"), F.col("pn")))
    return rounded(df.select("id", signal.noise_gain(F.col("snr"), (F.col("id") % 26 - 2).cast("double")).alias("gain")), 5)


def peak_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixtures of speech and louder noise, and their parts, under one scale."""
    df = pairs(spark, sf_dir).withColumn("mix", F.zip_with("speech", "noise", lambda s, n: s * 2 + n * 3))
    df = df.withColumn("peak", signal.peak(F.col("mix"))).withColumn("scale", signal.guard_scale(F.col("peak")))
    after = signal.peak(signal.scaled(F.col("mix"), F.col("scale")))
    return rounded(df.select("id", "peak", "scale", (F.col("peak") > 0.99).alias("clipped"), after.alias("peak_after")))


def source_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = waves(spark, sf_dir)
    return rounded(df.select("id", signal.euclidean(F.slice("a", 1, 32), F.slice("a", 33, 32)).alias("distance")))


def convolve_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pairs(spark, sf_dir).select("id", F.col("speech").alias("x"), F.col("noise").alias("h"))
    return shown(df.select("id", signal.convolved(F.col("x"), F.col("h")).alias("a")))


#: Vectors that make a clip and a response of ``convolve_blocks``, and samples of each.
CLIP, TAIL, VECTOR = 8, 2, 64


def convolve_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of eight vectors with responses of two (the first of the next clip), block by block; no clip is ever put together."""
    v = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select(F.floor(v / CLIP).alias("id"), (v % CLIP).cast("int").alias("block"), F.col("embedding").cast("array<double>").alias("samples"))
    responses = rows.where(F.col("block") < TAIL).withColumn("id", F.col("id") - 1)
    done = blocks.convolved(rows, responses, "id", VECTOR)
    return shown(done.withColumnRenamed("block", "part"), "samples", 5)


def scene_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waveforms of which some are empty, hold NaN, or hold infinity."""
    kind = F.col("id") % 4
    bad = F.when(kind == 1, F.expr("cast(array() as array<double>)")).when(kind == 2, F.transform("a", lambda x, i: F.when(i == 5, F.expr("double('NaN')")).otherwise(x))).when(kind == 3, F.transform("a", lambda x, i: F.when(i == 63, F.expr("double('Infinity')")).otherwise(x))).otherwise(F.col("a"))
    return waves(spark, sf_dir).withColumn("a", bad).select("id", signal.sound_item(F.col("a")).alias("valid"))


ALL = (rir_direct_index, rir_drr, rir_trim, rir_c50, rir_t30, signal_rms, signal_normalize, signal_loop, active_frames, snr_db, gain_for_snr, peak_guard, source_distance, convolve_direct, convolve_blocks, scene_contract)
QUERIES = {f.__name__: f for f in ALL}
SQL = {
    "rir_direct_index": f"WITH {DIRECT} SELECT id, direct::BIGINT AS direct FROM heard",
    "rir_drr": f"""WITH {DIRECT}, e AS (SELECT id, {square('a')} AS whole, {square('a[greatest(0, direct - 1) + 1:least(len(a), direct + 2)]')} AS near FROM heard)
SELECT id, round(10 * log10((near + 1e-12) / (greatest(whole - near, 0) + 1e-12)), 6) AS drr_db FROM e""",
    "rir_trim": f"WITH {DIRECT}, t AS (SELECT id, a[greatest(0, direct - 1) + 1:] AS b FROM heard) SELECT id, len(b) AS n, {MOMENT.format('b')} AS moment FROM t",
    "rir_c50": f"""WITH {DIRECT}, e AS (SELECT id, {square('a[direct + 1:direct + 50]')} AS early, {square('a[direct + 51:]')} AS late FROM heard)
SELECT id, CASE WHEN early <= 0 OR late <= 0 THEN 'NaN'::DOUBLE ELSE round(10 * log10(early / late), 6) END AS c50_db FROM e""",
    "rir_t30": f"""WITH {WAVES}, faded AS (SELECT id, i - 1 AS pos, a[i] * exp(-(i - 1) / CASE WHEN id % 5 = 0 THEN 60.0::DOUBLE ELSE 3.0 END) AS x FROM waves, range(1, 65) r(i)),
sums AS (SELECT id, pos, sum(x * x) OVER (PARTITION BY id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) AS s FROM faded),
curve AS (SELECT id, pos, 10 * log10(greatest(s / max(s) OVER (PARTITION BY id), 1e-20)) AS db FROM sums),
ends AS (SELECT id, min(pos) FILTER (WHERE db <= -5) AS a, min(pos) FILTER (WHERE db <= -35) AS b FROM curve GROUP BY id)
SELECT id, round(2.0 * (b - a) / 1000, 6) AS t30 FROM ends""",
    "signal_rms": f"WITH {WAVES} SELECT id, round(sqrt({square('a')} / len(a)), 6) AS rms FROM waves",
    "signal_normalize": f"WITH {WAVES}, l AS (SELECT id, a, sqrt({square('a')} / len(a)) AS level FROM waves) SELECT id, len(a) AS n, round(list_sum(list_transform(range(1, len(a) + 1), lambda i: a[i] / (level + 1e-12) * i)), 5) AS moment FROM l",
    "signal_loop": f"WITH {WAVES}, l AS (SELECT id, list_transform(range(0, id % 200), lambda i: a[(i + (id % 97)) % len(a) + 1]) AS b FROM waves) SELECT id, len(b) AS n, coalesce({MOMENT.format('b')}, 0.0) AS moment FROM l",
    "active_frames": f"""WITH {WAVES}, faded AS (SELECT id, list_transform(range(1, len(a) + 1), lambda i: a[i] * exp(-(i - 1) / 8.0::DOUBLE)) AS a FROM waves),
framed AS (SELECT id, a, list_transform(range(0, (len(a) + 24) // 25), lambda f: list_sum(list_transform(a[f * 25 + 1:f * 25 + 25], lambda x: x * x)) / len(a[f * 25 + 1:f * 25 + 25])) AS p FROM faded),
flags AS (SELECT id, a, p, list_filter(range(0, len(p)), lambda f: p[f + 1] >= 0.01 * (list_max(p) + 1e-12)) AS f FROM framed)
SELECT id, len(p) AS frames, len(f) AS active_frames, list_sum(list_transform(f, lambda k: len(a[k * 25 + 1:k * 25 + 25])))::BIGINT AS active_samples FROM flags""",
    "snr_db": f"WITH {LEVELS} SELECT id, round(CASE WHEN ps = 0 THEN '-Infinity'::DOUBLE ELSE 10 * log10(ps / (pn + 1e-12)) END, 6) AS snr_db FROM levels",
    "gain_for_snr": f"WITH {LEVELS} SELECT id, round(pow(10, (10 * log10(ps / (pn + 1e-12)) - (id % 26 - 2)) / 20), 5) AS gain FROM levels",
    "peak_guard": f"""WITH {PAIRS}, mixed AS (SELECT id, list_max(list_transform(range(1, len(speech) + 1), lambda i: abs(speech[i] * 2 + noise[i] * 3))) AS peak FROM pairs)
SELECT id, round(peak, 6) AS peak, round(CASE WHEN peak > 0.99 THEN 0.99 / peak ELSE 1.0 END, 6) AS scale, peak > 0.99 AS clipped, round(CASE WHEN peak > 0.99 THEN 0.99 ELSE peak END, 6) AS peak_after FROM mixed""",
    "source_distance": f"WITH {WAVES} SELECT id, round(sqrt(list_sum(list_transform(range(1, 33), lambda i: (a[i] - a[i + 32]) * (a[i] - a[i + 32])))), 6) AS distance FROM waves",
    "convolve_direct": f"""WITH {PAIRS}, c AS (SELECT id, list_transform(range(0, 127), lambda k: list_sum(list_transform(range(0, 64), lambda i: CASE WHEN k - i >= 0 AND k - i < 64 THEN speech[i + 1] * noise[k - i + 1] ELSE 0.0 END))) AS b FROM pairs)
SELECT id, len(b) AS n, {MOMENT.format('b')} AS moment FROM c""",
    "convolve_blocks": f"""WITH v AS (SELECT vec_id // {CLIP} AS id, vec_id % {CLIP} AS block, p, embedding[p + 1]::DOUBLE AS a FROM embeddings, range(0, {VECTOR}) r(p)),
y AS (SELECT x.id, x.block * {VECTOR} + x.p + h.block * {VECTOR} + h.p AS k, sum(x.a * h.a) AS y FROM v x JOIN v h ON h.id = x.id + 1 AND h.block < {TAIL} GROUP BY 1, 2)
SELECT id, (k // {VECTOR})::INTEGER AS part, count(*) AS n, round(sum(y * (k % {VECTOR} + 1)), 5) AS moment FROM y GROUP BY 1, 2""",
    "scene_contract": f"WITH {WAVES} SELECT id, id % 4 = 0 AS valid FROM waves",
}
