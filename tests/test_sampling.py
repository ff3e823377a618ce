"""Addresses by rank, the keyed permutation, and gathering with few waveforms that most rows use."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoquery import schema
from sonoquery.operators import sampling, scenes
from sonoquery.plans import room_queries, scene_queries
from sonoquery.sources import audio

DIR = "/root/testdata/sf0.01"


def plain_recipes(groups, n_noises, params, indices, key, clean):
    """The draws in one go, with the whole index in memory."""
    tree = {}
    for room, receiver, ids in sorted(groups):
        tree.setdefault(room, []).append((receiver, sorted(ids)))
    out = {}
    for i in indices:
        rng = np.random.default_rng(np.random.SeedSequence(key(i)))
        if clean and rng.random() < params.clean_probability:
            out[i] = None
            continue
        room = list(tree)[rng.integers(len(tree))]
        receiver, ids = tree[room][rng.integers(len(tree[room]))]
        rirs, noises = rng.choice(ids, 3, replace=False).tolist(), rng.choice(n_noises, 2, replace=False).tolist()
        target, offsets = rng.uniform(-2, 24), rng.uniform(0, 3000, 2).tolist()
        out[i] = (room, receiver, rirs[0], noises, rirs[1:], offsets, target, rng.uniform(35, 55), int(rng.integers(0, 2**63 - 1)))
    return out


def found(rows):
    names = ("room", "receiver", "speech_rir_index", "noise_indices", "noise_rir_indices", "offsets_ms", "target_snr_db", "pink_db", "rng_seed")
    return {r.speech_index: None if r.is_clean else tuple(r[c] for c in names) for r in rows.collect()}


def test_recipes_of_a_table_equal_plain_numpy(spark):
    _, _, responses = scene_queries.sources(spark, DIR)
    groups = [(r.room, r.receiver, r.ids) for r in responses.groupBy("room", "receiver").agg(F.collect_list("row_id").alias("ids")).collect()]
    indices = [r.speech_index for r in scene_queries.recipe_sample(spark, DIR).select("speech_index").collect()]
    assert len(indices) == 500
    assert found(scene_queries.recipe_sample(spark, DIR)) == plain_recipes(groups, 500, scene_queries.PARAMS, indices, lambda i: [42, 0, i], True)
    assert found(scene_queries.recipes(spark, DIR, "eval")) == plain_recipes(groups, 500, scene_queries.PARAMS, indices, lambda i: [42, i, 0], False)


def test_ranks_of_a_group_in_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(sampling, "BUCKET", 16)
    ids = [i * 3 for i in range(200)]
    rows = [("A", "R1", i) for i in ids] + [("A", "R2", 5), ("B", "R1", 7), (None, "R1", 1), ("B", None, 2)]
    index = sampling.RankIndex.of(spark.createDataFrame(rows, "room string, receiver string, row_id bigint").repartition(5))
    assert index.n_rooms == 2
    assert [tuple(r) for r in index.rows.where("room = 'A' and receiver = 'R1'").orderBy("rank").select("rank", "row_id").collect()] == list(enumerate(ids))
    assert {(r.room, r.receiver, r.receiver_no, r.size) for r in index.groups.collect()} == {("A", "R1", 0, 200), ("A", "R2", 1, 1), ("B", "R1", 0, 1)}
    assert {(r.room_no, r.room, r.receivers) for r in index.rooms.collect()} == {(0, "A", 2), (1, "B", 1)}


def test_repeated_and_impossible_draws(spark):
    index = sampling.RoomIndex([("A", "R1", [4, 5, 6])])
    twice = spark.createDataFrame([(1,), (1,), (2,)], "speech_index bigint")
    rows = sampling.recipes(twice, index, 9, schema.Params(), 1, mode="eval").collect()
    assert sorted(r.speech_index for r in rows) == [1, 1, 2] and len({str(r) for r in rows}) == 2
    for small, noises in ((sampling.RoomIndex([("A", "R1", [4, 5])]), 9), (index, 1), (sampling.RoomIndex([]), 9)):
        with pytest.raises(Exception, match="too few|no responses"):
            sampling.recipes(twice, small, noises, schema.Params(), 1, mode="eval").collect()


def test_no_responses_on_the_driver(spark):
    """The plan of recipes holds no ids: responses are joined."""
    _, _, responses = scene_queries.sources(spark, DIR)
    index = sampling.RankIndex.of(responses)
    plan = sampling.recipes(spark.range(10).select(F.col("id").alias("speech_index")), index, 9, schema.Params(), 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" not in plan and plan.count("Join") >= 3


@pytest.mark.parametrize("count", [1, 2, 3, 7, 40, 97, 1000, 4097])
def test_permutation(spark, count):
    got = [r.speech_index for r in sampling.chosen(spark, count, count, 5).orderBy("place").collect()]
    assert sorted(got) == list(range(count))
    assert [r.speech_index for r in sampling.chosen(spark, count, min(count, 3), 5).orderBy("place").collect()] == got[:3]
    if count > 90:
        assert got != list(range(count)) and got != [r.speech_index for r in sampling.chosen(spark, count, count, 6).orderBy("place").collect()]


def test_permutation_spreads(spark):
    """The first thousandth of a large range is spread over all of it, without repeats."""
    n = 10_000_000
    got = np.array([r.speech_index for r in sampling.chosen(spark, n, 10_000, 3).collect()])
    assert len(set(got.tolist())) == 10_000 and got.min() >= 0 and got.max() < n
    counts = np.histogram(got, 20, (0, n))[0]
    assert counts.min() > 400 and counts.max() < 600
    assert sampling.sides(n)[0] * sampling.sides(n)[1] - n < sampling.sides(n)[0]


def tables(spark, noises):
    rng = np.random.default_rng(2)
    wave = lambda: [float(x) for x in rng.normal(size=6)]
    speech = spark.createDataFrame([(i, wave(), f"t{i}") for i in range(60)], "row_id bigint, audio array<double>, text string")
    noise = spark.createDataFrame([(i, wave()) for i in range(noises)], "row_id bigint, audio array<double>")
    responses = spark.createDataFrame([(i, wave(), i * 0.1) for i in range(9)], "row_id bigint, audio array<double>, distance double")
    index = sampling.RoomIndex([("A", "R1", list(range(9)))])
    recipes = sampling.recipes(speech.select(F.col("row_id").alias("speech_index")), index, noises, schema.Params(), 3, mode="eval").drop("is_clean")
    return recipes, speech, noise, responses


def test_hot_waveforms_are_dealt_to_copies(spark, monkeypatch):
    recipes, *sources = tables(spark, 4)
    plain = sorted(map(str, scenes.gather(recipes, *sources).select("speech_index", "clip", "response", "distance", "noises", "text").collect()))
    monkeypatch.setattr(scenes, "HOT_USES", 5)
    made = scenes.gather(recipes, *sources)
    assert sorted(map(str, made.select("speech_index", "clip", "response", "distance", "noises", "text").collect())) == plain and len(plain) == 60
    assert "_copy" in made._jdf.queryExecution().executedPlan().toString()


def test_stored_blocks_are_not_shuffled(spark):
    """Only the rows that look waveforms up are exchanged."""
    recipes, speech, noise, responses = tables(spark, 40)
    stored = audio.store_blocks(noise, "noise_blocks", 4)
    parts = recipes.select("speech_index", F.explode("noise_indices").alias("row_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = scenes.meet(parts, "row_id", stored, "speech_index")
        assert joined.count() == 120
        plan = joined._jdf.queryExecution().executedPlan().toString()
        scan = next(i for i, line in enumerate(plan.split("\n")) if "noise_blocks" in line)
        depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
        lines, above = plan.split("\n"), []
        d = depth(lines[scan])
        for line in reversed(lines[:scan]):
            if depth(line) < d:
                d = depth(line)
                above.append(line)
        join = next(i for i, line in enumerate(above) if "Join" in line)
        assert "Bucketed: true" in plan and not any("Exchange" in line for line in above[:join])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE noise_blocks")


def test_groups_of_the_queries_are_unchanged(spark):
    index = sampling.RankIndex.of(room_queries.responses(spark, DIR))
    got = {(r.room, r.receiver): r.rows for r in index.rows.groupBy("room", "receiver").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "row_id"))), lambda x: x["row_id"]).alias("rows")).collect()}
    assert got == {(r.room, r.receiver): r.rows for r in room_queries.group_index(spark, DIR).collect()}
