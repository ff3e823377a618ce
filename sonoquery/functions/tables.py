"""Table functions for SQL, used by ``LATERAL``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DataType, DoubleType, IntegerType, LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import dsp

#: Descriptors of a response: type, and value from (wave, rate, distance, direct sound's sample).
KNOWN: dict[str, tuple[DataType, Callable[[np.ndarray, int, float, int], float]]] = {
    "sr": (IntegerType(), lambda wave, sr, distance, at: sr),
    "samples": (LongType(), lambda wave, sr, distance, at: len(wave)),
    "direct": (IntegerType(), lambda wave, sr, distance, at: int(at)),
    "drr_db": (DoubleType(), lambda wave, sr, distance, at: float(dsp.drr_db(wave, distance, sr))),
    "c50_db": (DoubleType(), lambda wave, sr, distance, at: float(dsp.c50_db(wave, at, sr))),
    "t30_s": (DoubleType(), lambda wave, sr, distance, at: float(dsp.t30_s(wave, at, sr))),
}


class Descriptors:
    """``descriptors(bytes, distance, 'c50_db, t30_s')``: a row of the named descriptors for a WAV record.

    The names are a constant, and the columns of the result are those, in that order; a name that isn't known is an error when the query
    is analyzed.  A null record or distance gives no row.
    """

    @staticmethod
    def analyze(data: AnalyzeArgument, distance: AnalyzeArgument, wanted: AnalyzeArgument) -> AnalyzeResult:
        names = [x.strip() for x in (wanted.value or "").split(",") if x.strip()]
        if not names or len(set(names)) < len(names) or not set(names) <= set(KNOWN):
            raise ValueError(f"descriptors are named by a constant, once each, out of {', '.join(KNOWN)}")
        schema = StructType()
        for name in names:
            schema = schema.add(name, KNOWN[name][0])
        return AnalyzeResult(schema)

    def eval(self, data: bytes | None, distance: float | None, wanted: str) -> Iterator[tuple]:
        if data is not None and distance is not None:
            wave, sr = dsp.wav_read(bytes(data))
            at = dsp.direct_sample(wave, distance, sr)
            yield tuple(KNOWN[x.strip()][1](wave, sr, distance, at) for x in wanted.split(",") if x.strip())


def registered(spark: SparkSession) -> SparkSession:
    """``spark``, knowing the functions of this module in SQL."""
    spark.udtf.register("descriptors", udtf(Descriptors))
    return spark
