"""Band scores over a stream of predictions.

Scores are associative sums, so a stream keeps one row of state for each band;
there is no event time and nothing to wait for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scoring


def running_band_scores(predictions: DataFrame) -> DataFrame:
    """Sums by training band of a streaming (snr, errors, words); write in complete or update mode."""
    rows = predictions.where("words > 0").withColumn("band", scoring.band_train(F.col("snr")))
    return rows.groupBy("band").agg(*scoring.scores())
