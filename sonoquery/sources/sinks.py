"""Sinks: predictions, summaries, transcript dumps and the cache of rendered scenes."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import Params


def jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object a row; nulls are written, text isn't escaped."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def transcripts(rows: DataFrame, path: str, step: int) -> None:
    """Transcripts (band, final_snr_db, reference, hypothesis) of a step in a folder of its own."""
    out = rows.select("band", "final_snr_db", "reference", "hypothesis").withColumn("step", F.format_string("%05d", F.lit(step)))
    out.write.mode("append").partitionBy("step").option("ignoreNullFields", "false").json(path)


def summary_json(summary: DataFrame, key: str, **run) -> str:
    """A run's summary as JSON: its settings and an object for each condition (a handful of rows)."""
    conditions = {}
    for r in summary.collect():
        values = r.asDict()
        own = {k: values[k] for k in ("examples", "word_errors", "reference_words", "wer")}
        if values.get("mean_snr") is not None:
            own["realized_snr_db"] = {"mean": values["mean_snr"], "min": values.get("min_snr"), "max": values.get("max_snr")}
        conditions[str(values[key])] = own
    return json.dumps(run | {"conditions": conditions}, indent=2, ensure_ascii=False) + "\n"


def cached_scenes(params: Params, folder: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Scenes of a run: read if they are there, else made and written.

    The folder's name has a hash of all parameters.  Spark marks a write as
    complete with _SUCCESS, so half a cache is never read; audio stays in double
    precision, so a hit gives what a miss gave.
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    path = f"{folder.rstrip('/')}/scenes-{params.key}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def scene_key(recipes: DataFrame, *settings) -> Column:
    """Hash of everything in a recipe, and of the settings that rendering depends on besides."""
    return F.sha2(F.concat_ws("|", F.lit(json.dumps(settings, sort_keys=True)), F.to_json(F.struct(*sorted(recipes.columns)), {"ignoreNullFields": "false"})), 256)


class SceneCache:
    """Rendered scenes by the hash of their recipe, in parts that are added whole.

    A part is written beside the others and renamed into place, so a write that is killed leaves nothing that is read.
    A change of one recipe misses one scene.  ``folder`` may be in any store whose renames are atomic.
    """

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def parts(self) -> list[str]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        found = self._fs.listStatus(self._path(self.folder))
        return sorted(x.getPath().toString() for x in found if x.isDirectory() and x.getPath().getName().startswith("part-"))

    def _read(self, parts: list[str]) -> DataFrame:
        return self.spark.read.parquet(*parts)

    def scenes(self, recipes: DataFrame, render: Callable[[DataFrame], DataFrame], *settings) -> DataFrame:
        """A scene for each row of ``recipes``: from the cache, or else from ``render(misses)``, which is added.

        ``render`` gives scenes whose ``scene_id`` is the recipe's ``speech_index``; both must be unique among the recipes.
        """
        keyed = recipes.withColumn("scene_key", scene_key(recipes, *settings))
        parts = self.parts()
        misses = keyed.join(self._read(parts).select("scene_key"), "scene_key", "left_anti") if parts else keyed
        if misses.limit(1).count():
            made = render(misses.drop("scene_key"))
            keys = misses.select("scene_key", F.col("speech_index").alias("scene_id"))
            pending, name = f"{self.folder}/_pending-{uuid.uuid4().hex}", f"{self.folder}/part-{uuid.uuid4().hex}"
            try:
                made.join(keys, "scene_id").write.parquet(pending)
                if not self._fs.rename(self._path(pending), self._path(name)):
                    raise OSError(f"{pending} could not be renamed")
            except BaseException:
                self._fs.delete(self._path(pending), True)
                raise
            parts = self.parts()
        if not parts:
            return render(recipes)
        # two runs may have added a scene at the same time: the part of least name counts
        part = F.regexp_extract(F.col("_metadata.file_path"), "/(part-[0-9a-f]+)/", 1)
        rows = self._read(parts).withColumn("_part", part)
        own = rows.select("scene_key", "_part").groupBy("scene_key").agg(F.min("_part").alias("_part"))
        return rows.join(own.join(keyed.select("scene_key"), "scene_key", "left_semi"), ["scene_key", "_part"], "left_semi").drop("scene_key", "_part")
