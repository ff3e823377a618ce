"""Queries on word error rates by band, bin and condition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, snr, errors, words) from the events."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), (F.col("value") / 10 - 8).alias("snr"), k.alias("errors"), (k + 10).alias("words"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; the same in the SQL."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


SCORED = "scored AS (SELECT event_id AS row_id, value / 10 - 8 AS snr, CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS BIGINT) AS errors, CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS BIGINT) + 10 AS words FROM events)"
BAND = "CASE WHEN isnan(snr) THEN NULL WHEN snr > 14 THEN 'high' WHEN snr >= 8 AND snr <= 12 THEN 'mid' WHEN snr < 6 THEN 'low' END"
TRAIN = "CASE WHEN snr IS NULL THEN 'clean' WHEN isnan(snr) THEN 'other' WHEN snr <= 6 THEN 'low' WHEN snr >= 8 AND snr <= 12 THEN 'mid' WHEN snr >= 14 THEN 'high' ELSE 'other' END"
SCORES = "count(*) AS examples, sum(errors)::BIGINT AS word_errors, sum(words)::BIGINT AS reference_words, round(sum(errors)::DOUBLE / nullif(sum(words), 0), 6) AS wer, round(avg(snr), 6) AS mean_snr, round(min(snr), 6) AS min_snr, round(max(snr), 6) AS max_snr"

EDGES = "(0, 5.999), (1, 6.0), (2, 8.0), (3, 12.0), (4, 13.0), (5, 14.0), (6, 14.001), (7, NULL), (8, {nan})"


def snr_band_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.by_band(scored(spark, sf_dir)))


def snr_band_wer_train_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.band_wer(scored(spark, sf_dir)))


def band_boundary_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(f"SELECT CAST(id AS BIGINT) AS id, CAST(snr AS DOUBLE) AS snr FROM VALUES {EDGES.format(nan="DOUBLE('NaN')")} AS t(id, snr)")
    return rows.select("id", scoring.band_eval(F.col("snr")).alias("eval_band"), scoring.band_train(F.col("snr")).alias("train_band"))


BINS = scoring.build_bins(-8.0, 6.0, 2.0)
#: Bins that reach beyond the data, and a last one that is cut.
WIDE = scoring.build_bins(-12.0, 50.5, 4.0)


def _values(bins) -> str:
    return ", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for i, (a, b) in enumerate(bins))


def _bin_sql(bins) -> str:
    return f"""WITH {SCORED}, bins(bin_index, bin_lower, bin_upper) AS (VALUES {_values(bins)})
SELECT b.bin_index, bin_lower, bin_upper, count(s.row_id) AS examples, coalesce(sum(errors), 0)::BIGINT AS word_errors, coalesce(sum(words), 0)::BIGINT AS reference_words,
       round(sum(errors)::DOUBLE / nullif(sum(words), 0), 6) AS wer, round(avg(snr), 6) AS mean_snr
FROM bins b LEFT JOIN scored s ON s.snr >= b.bin_lower AND s.snr < b.bin_upper GROUP BY ALL"""


def snr_bin_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.by_bin(scored(spark, sf_dir), scoring.bins_table(spark, BINS)))


def snr_bin_empty_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.by_bin(scored(spark, sf_dir), scoring.bins_table(spark, WIDE)))


def wer_delta_vs_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = scoring.by_band(scored(spark, sf_dir))
    return rounded(scoring.delta(summary, F.col("band") == "high").select("band", "wer", "delta_pp"))


def paired_condition_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("speech_index"))
    return scoring.conditions(items, scoring.EVAL_ORDER)


def rejection_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts that missed their band: the event's bucket stands for the wanted one."""
    rows = scored(spark, sf_dir).withColumn("wanted", F.element_at(F.array(F.lit("high"), F.lit("mid"), F.lit("low")), (F.col("row_id") % 3 + 1).cast("int")))
    missed = ~F.coalesce(scoring.band_eval(F.col("snr")) == F.col("wanted"), F.lit(False))
    return rows.groupBy("wanted").agg(F.sum(missed.cast("bigint")).alias("rejected"), F.count("*").alias("attempts"))


def prediction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("speech_index"), F.col("turn").cast("double").alias("snr"), F.col("text").alias("reference"), F.col("text").alias("hypothesis"), F.lower("text").alias("normalized_reference"), F.lower("text").alias("normalized_hypothesis"), F.lit(0).cast("bigint").alias("errors"), F.size(F.split("text", " ")).cast("bigint").alias("words"))
    return scoring.prediction_rows(rows)


QUERIES = {f.__name__: f for f in (snr_band_wer, snr_band_wer_train_policy, band_boundary_cases, snr_bin_sweep, snr_bin_empty_bins, wer_delta_vs_baseline, paired_condition_grid, rejection_counters, prediction_rows)}
SQL = {
    "snr_band_wer": f"WITH {SCORED} SELECT {BAND} AS band, {SCORES} FROM scored GROUP BY 1 HAVING band IS NOT NULL",
    "snr_band_wer_train_policy": f"WITH {SCORED}, named AS (SELECT *, {TRAIN} AS own FROM scored WHERE words > 0) SELECT coalesce(own, 'all') AS band, {SCORES} FROM named GROUP BY GROUPING SETS ((own), ())",
    "band_boundary_cases": f"WITH t(id, snr) AS (SELECT i::BIGINT, s::DOUBLE FROM (VALUES {EDGES.format(nan="'NaN'::DOUBLE")}) v(i, s)) SELECT id, {BAND} AS eval_band, {TRAIN} AS train_band FROM t",
    "snr_bin_sweep": _bin_sql(BINS),
    "snr_bin_empty_bins": _bin_sql(WIDE),
    "wer_delta_vs_baseline": f"""WITH {SCORED}, rates AS (SELECT {BAND} AS band, sum(errors)::DOUBLE / sum(words) AS wer FROM scored GROUP BY 1 HAVING band IS NOT NULL)
SELECT band, round(wer, 6) AS wer, round(100 * (wer - (SELECT wer FROM rates WHERE band = 'high')), 6) AS delta_pp FROM rates""",
    "paired_condition_grid": "SELECT item_id AS speech_index, i::INTEGER AS condition_index, c AS condition FROM benchmark, (VALUES (0, 'clean'), (1, 'high'), (2, 'mid'), (3, 'low')) v(i, c)",
    "rejection_counters": f"WITH {SCORED}, asked AS (SELECT *, ['high', 'mid', 'low'][row_id % 3 + 1] AS wanted FROM scored) SELECT wanted, count(*) FILTER (WHERE {BAND} IS DISTINCT FROM wanted) AS rejected, count(*) AS attempts FROM asked GROUP BY 1",
    "prediction_rows": "SELECT conv_id AS speech_index, conv_id::VARCHAR AS speech_id, NULL::VARCHAR AS condition, NULL::DOUBLE AS target_snr_db, turn::DOUBLE AS final_snr_db, NULL::VARCHAR AS room, NULL::VARCHAR AS receiver, text AS reference, text AS hypothesis, lower(text) AS normalized_reference, lower(text) AS normalized_hypothesis, 0::BIGINT AS word_errors, len(string_split(text, ' '))::BIGINT AS reference_words FROM conversations WHERE role = 'user'",
}
