"""The cache of scenes by recipe."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sonoquery.operators import scenes
from sonoquery.plans import scene_queries
from sonoquery.sources.sinks import SceneCache

DIR = "/root/testdata/sf0.001"


def test_only_changed_recipes_are_rendered(spark, tmp_path):
    sources = scene_queries.sources(spark, DIR)
    recipes = scene_queries.recipes(spark, DIR, "eval").drop("is_clean").where("speech_index < 12")
    asked = []

    def render(misses):
        asked.append(misses.count())
        return scenes.render(scenes.gather(misses, *sources), scene_queries.SR)

    shown = lambda rows: sorted((r.scene_id, r.text, r.audio, str(r.metadata)) for r in rows.collect())
    cache = SceneCache(spark, str(tmp_path / "scenes"))
    first = shown(cache.scenes(recipes, render, scene_queries.SR))
    assert asked == [12] and len(first) == 12
    assert shown(cache.scenes(recipes, render, scene_queries.SR)) == first and asked == [12]
    changed = recipes.withColumn("target_snr_db", F.when(F.col("speech_index") == 5, 3.25).otherwise(F.col("target_snr_db")))
    second = shown(cache.scenes(changed, render, scene_queries.SR))
    assert asked == [12, 1] and [a for a, b in zip(first, second) if a != b] == [first[5]]
    assert shown(cache.scenes(recipes.where("speech_index < 4"), render, scene_queries.SR)) == first[:4] and asked == [12, 1]
    cache.scenes(recipes.where("speech_index = 1"), render, 2000)
    assert asked == [12, 1, 1]  # other settings are other scenes

    def fails(misses):
        return render(misses).withColumn("text", F.raise_error(F.lit("killed")))

    with pytest.raises(Exception, match="killed"):
        cache.scenes(recipes.withColumn("pink_db", F.lit(50.0)), fails, scene_queries.SR)
    left = [p for p in Path(tmp_path / "scenes").iterdir() if p.name.startswith("_pending")]
    assert not left and shown(cache.scenes(recipes, render, scene_queries.SR)) == first
    (tmp_path / "scenes" / "_pending-0").mkdir()  # a driver that died
    assert shown(cache.scenes(recipes, render, scene_queries.SR)) == first


def test_two_runs_at_once(spark, tmp_path):
    sources = scene_queries.sources(spark, DIR)
    recipes = scene_queries.recipes(spark, DIR, "eval").drop("is_clean").where("speech_index < 3")
    render = lambda misses: scenes.render(scenes.gather(misses, *sources), scene_queries.SR)
    a, b = SceneCache(spark, str(tmp_path / "a")), SceneCache(spark, str(tmp_path / "b"))
    a.scenes(recipes, render).count()
    b.scenes(recipes, render).count()
    for part in (tmp_path / "b").glob("part-*"):
        part.rename(tmp_path / "a" / part.name)
    assert len(a.parts()) == 2 and a.scenes(recipes, render).count() == 3
    assert SceneCache(spark, str(tmp_path / "c")).scenes(recipes.where("false"), render).count() == 0
