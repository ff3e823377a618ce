"""Waveforms as rows of blocks, and their convolution by overlap-add.

A table of blocks has the clip's key, ``block`` (from 0) and ``samples``; all blocks of a clip but its last
have the same length.  Clips of any length fit, as no row and no task's group holds one whole.

Defined results: a clip with no samples (null or empty) has no blocks, and one that is convolved with
nothing is missing from :func:`convolved`; :func:`convolve` gives it an empty array.  Clips of a null key have no
result.  One key twice is two clips on top of each other: their sums are convolved.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples of a block.
BLOCK = 4096


def cut(df: DataFrame, key: str, wave: str, size: int = BLOCK) -> DataFrame:
    """(key, block, samples) of the arrays ``wave``."""
    numbers = F.sequence(F.lit(0), F.floor((F.size(wave) - 1) / size).cast("int"))
    rows = df.where(F.size(wave) > 0).select(F.col(key), F.col(wave).alias("_wave"), F.explode(numbers).alias("block"))
    return rows.select(key, "block", F.slice("_wave", F.col("block") * size + 1, F.lit(size)).cast("array<double>").alias("samples"))


def joined(blocks: DataFrame, key: str, out: str = "wave") -> DataFrame:
    """(key, array): the clips in one piece; for those that fit in a row."""
    rows = blocks.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("block", "samples"))).alias("_all"))
    return rows.select(key, F.flatten("_all.samples").alias(out))


def _matrix(column: pa.ChunkedArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks as rows of zeros behind their samples, and their lengths."""
    blocks = [x.values.to_numpy(zero_copy_only=False) for x in column]
    out = np.zeros((len(blocks), size))
    for row, x in zip(out, blocks, strict=True):
        row[: len(x)] = x
    return out, np.array([len(x) for x in blocks])


def convolved(x: DataFrame, h: DataFrame, key: str, size: int = BLOCK) -> DataFrame:
    """Blocks of the full convolution of each clip's blocks ``x`` with the blocks ``h`` of the same key; both have blocks of ``size``.

    Block i of one and block j of the other reach blocks i + j and i + j + 1 of the result.  Products with one sum i + j are
    added as spectra and transformed back once; the two parts of that meet the neighbours' by (key, block).  Blocks are shuffled by
    key, where pairs stay, and parts (twice the result's samples) by (key, block).  A group holds as many pairs as the shorter clip has blocks.
    """
    kind = dict(x.dtypes)[key]
    pairs = x.select(key, F.col("block").alias("_i"), F.col("samples").alias("_x")).join(h.select(key, F.col("block").alias("_j"), F.col("samples").alias("_h")), key)

    def product(group: pa.Table) -> pa.Table:
        group = group.sort_by([("_i", "ascending"), ("_j", "ascending")])  # one order of sums, whatever the order of rows
        a, n = _matrix(group.column("_x"), 2 * size)
        b, m = _matrix(group.column("_h"), 2 * size)
        reach = int((n + m).max()) - 1
        y = np.fft.irfft((np.fft.rfft(a) * np.fft.rfft(b)).sum(axis=0), 2 * size)[:reach]
        parts = [y[:size]] + [y[size:]] * (reach > size)
        at = group.column("_sum")[0].as_py()
        own = pa.chunked_array([group.column("_key").combine_chunks()[:1]] * len(parts), group.schema.field("_key").type)
        return pa.table({"_key": own, "block": pa.array([at, at + 1][: len(parts)], pa.int32()), "_part": pa.array(parts, pa.list_(pa.float64()))})

    pairs = pairs.select(F.col(key).alias("_key"), (F.col("_i") + F.col("_j")).cast("int").alias("_sum"), "_i", "_j", "_x", "_h")
    parts = pairs.groupBy("_key", "_sum").applyInArrow(product, f"_key {kind}, block int, _part array<double>")
    added = F.aggregate(F.slice("_parts", 2, F.size("_parts")), F.get("_parts", F.lit(0)), lambda s, p: F.zip_with(s, p, lambda u, v: F.coalesce(u, F.lit(0.0)) + F.coalesce(v, F.lit(0.0))))
    # two parts at most meet in a block, so their order doesn't matter
    return parts.groupBy("_key", "block").agg(F.collect_list("_part").alias("_parts")).select(F.col("_key").alias(key), "block", added.alias("samples"))


def convolve(df: DataFrame, key: str, x: str, h: str, out: str = "wave", size: int = BLOCK) -> DataFrame:
    """(key, array): the full convolution of two array columns, dealt by blocks; for clips whose result fits in a row."""
    done = joined(convolved(cut(df, key, x, size), cut(df, key, h, size), key, size), key, out)
    return df.select(key).distinct().join(done, key, "left").select(key, F.coalesce(F.col(out), F.expr("cast(array() as array<double>)")).alias(out))
