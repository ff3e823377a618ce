"""Tables with a folder for each room, and the pruning of folders by a fold."""

import glob

import pytest
from pyspark.sql import functions as F

from sonoquery import schema
from sonoquery.operators import rooms
from sonoquery.sources import audio


@pytest.fixture
def stored(spark, tmp_path):
    names = F.element_at(F.array(*(F.lit(f"Room{i}") for i in range(1, 11))), (F.col("id") % 10 + 1).cast("int"))
    rows = spark.range(1000).select("id", F.when(F.col("id") < 400, "Room3").when(F.col("id") < 990, names).alias("room"))
    return audio.store_rooms(rows, str(tmp_path / "rooms"), "room", "id", 3), rows, str(tmp_path / "rooms")


def test_rows_and_files(stored):
    table, rows, folder = stored
    assert sorted(table.collect(), key=str) == sorted(rows.collect(), key=str) and table.columns == rows.columns
    assert len(glob.glob(f"{folder}/room=*")) == 11


def test_a_hot_room_is_dealt_to_tasks(spark, stored, tmp_path):
    _, rows, _ = stored
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else the few rows of this test are one task's
    try:
        audio.store_rooms(rows, str(tmp_path / "dealt"), "room", "id", 16)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(glob.glob(f"{tmp_path}/dealt/room=Room3/*.parquet")) == 4  # all partitions of the shuffle


def test_only_the_fold_is_read(spark, stored):
    table, rows, folder = stored
    own = schema.room_sets(spark).where("room_set = 'B'")
    found = rooms.in_stored_rooms(table, own)
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    for name in schema.ROOM_SETS["A"]:  # a scan that opened these would fail
        for file in glob.glob(f"{folder}/room={name}/*.parquet"):
            open(file, "wb").write(b"nothing")
    wanted = rows.where(F.col("room").isin(*schema.ROOM_SETS["B"]))
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in wanted.collect())
    with pytest.raises(Exception, match="(?i)parquet"):
        table.select(F.sum("id")).collect()


def test_many_names_are_not_broadcast(spark, stored, monkeypatch):
    table, rows, _ = stored
    monkeypatch.setattr(rooms, "MAX_NAMES", 2)
    found = rooms.in_stored_rooms(table, schema.room_sets(spark).where("room_set = 'A'"))
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == rows.where(F.col("room").isin(*schema.ROOM_SETS["A"])).count()


def test_nothing_named_and_null_names(spark, stored):
    table, _, _ = stored
    assert rooms.in_stored_rooms(table, spark.createDataFrame([], "room string")).count() == 0
    assert rooms.in_stored_rooms(table, spark.createDataFrame([(None,)], "room string")).count() == 0


def test_numbers_as_names_stay_text(spark, tmp_path):
    rows = spark.createDataFrame([(1, "007"), (2, "7")], "id bigint, room string")
    assert {r.room for r in audio.store_rooms(rows, str(tmp_path / "n"), "room", "id").collect()} == {"007", "7"}
