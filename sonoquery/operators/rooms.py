"""Rooms, receivers and folds: membership, audits and group selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def in_rooms(rows: DataFrame, rooms, room: str = "room") -> DataFrame:
    """Rows of some rooms; a list is pushed to the scan, a table is a semi-join (broadcast only where Spark knows it to be small)."""
    if isinstance(rooms, DataFrame):
        return rows.join(rooms.select(F.col("room").alias(room)), room, "left_semi")
    return rows.where(F.col(room).isin(*rooms))


#: Names of rooms that are broadcast, at most.
MAX_NAMES = 10_000


def in_stored_rooms(rows: DataFrame, sets: DataFrame, room: str = "room") -> DataFrame:
    """Rows of the rooms in ``sets``, from a table with a folder for each room (:func:`sonoquery.sources.audio.store_rooms`).

    Up to ``MAX_NAMES`` names are broadcast, and the folders to read are chosen by them when the query runs (dynamic pruning, where ``sets``
    is a filtered table); with more, it is a shuffled semi-join.  Null names match nothing.
    """
    names = sets.select(F.col("room").alias(room)).distinct()
    few = names.limit(MAX_NAMES + 1).count() <= MAX_NAMES
    return rows.join(names.hint("broadcast" if few else "shuffle_hash"), room, "left_semi")


def set_difference(expected: DataFrame, observed: DataFrame, column: str = "room") -> DataFrame:
    """(column, side): what is missing in, or extra to, the expected values; empty if the sets are equal."""
    a, b = expected.select(column).distinct(), observed.select(column).distinct()
    return a.join(b, column, "left_anti").withColumn("side", F.lit("missing")).union(b.join(a, column, "left_anti").withColumn("side", F.lit("extra")))


def dependency_breaks(rows: DataFrame, key: str, *values: str) -> DataFrame:
    """Keys with other than one value in a column that the key should determine."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(*(F.countDistinct(v).alias(v) for v in values))
    return counts.where(" or ".join(f"`{v}` <> 1" for v in values))


def mean(column: str) -> Column:
    """Mean that leaves out NaN as well as null."""
    return F.avg(F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double")))


def summary(rows: DataFrame) -> DataFrame:
    """Size and means of each (room, description), with the description's type."""
    out = rows.groupBy("room", "description").agg(F.count("*").alias("rir_rows"), mean("volume").alias("mean_volume"), mean("stored").alias("stored_mean"), mean("raw").alias("raw_mean"))
    return out.withColumn("room_type", text.room_type(F.col("description")))


def macro_means(rooms: DataFrame, sets: DataFrame) -> DataFrame:
    """Means over rooms, each of the same weight, by set."""
    joined = rooms.join(F.broadcast(sets), "room")
    return joined.groupBy("room_set").agg(F.count("*").alias("rooms"), F.avg("mean_volume").alias("mean_volume"), F.avg("stored_mean").alias("stored_mean"), F.avg("raw_mean").alias("raw_mean"))


def type_counts(rooms: DataFrame, sets: DataFrame) -> DataFrame:
    return rooms.join(F.broadcast(sets), "room").groupBy("room_set", "room_type").agg(F.count("*").alias("n"))


def check_types(rooms: DataFrame, sets: DataFrame, types: int = 5) -> None:
    """Each set must have so many types, each of them once."""
    bad = type_counts(rooms, sets).groupBy("room_set").agg(F.count("*").alias("kinds"), F.max("n").alias("most")).where((F.col("kinds") != types) | (F.col("most") != 1)).collect()
    if bad:
        raise ValueError(f"room sets without one room of each type: {[r.room_set for r in bad]}")


def octave_mean(bands: Column) -> Column:
    """Mean of eight octave bands without NaN (NaN if all are); a text holds them as a list."""
    numbers = F.filter(bands, lambda x: ~F.isnan(x))
    average = F.when(F.size(numbers) == 0, F.expr("double('NaN')")).otherwise(F.aggregate(numbers, F.lit(0.0), lambda s, x: s + x) / F.size(numbers))
    return F.when(F.size(bands) == 8, average).otherwise(F.raise_error(F.lit("eight octave bands are expected")))


def parsed_list(text_column: Column) -> Column:
    """A literal list of numbers as an array; ``nan`` becomes NaN."""
    quoted = F.regexp_replace(F.lower(text_column), r"\bnan\b", '"NaN"')
    return F.transform(F.from_json(quoted, "array<string>"), lambda x: x.cast("double"))


def tolerance(rows: DataFrame, stored: str, raw: str) -> DataFrame:
    """Mean and largest absolute difference, without NaN."""
    gap = F.nanvl(F.abs(F.col(stored) - F.col(raw)), F.lit(None).cast("double"))
    return rows.agg(F.avg(gap).alias("mean_error"), F.max(gap).alias("max_error"))


def groups(rows: DataFrame, room: str = "room", receiver: str = "receiver", row: str = "row_id") -> DataFrame:
    """Ascending row ids of each (room, receiver); rows with a null key are left out."""
    keyed = rows.where(F.col(room).isNotNull() & F.col(receiver).isNotNull())
    return keyed.groupBy(room, receiver).agg(F.sort_array(F.collect_list(row)).alias("rows"))


def first_complete_group(rows: DataFrame, k: int, limit: int, room: str = "room", receiver: str = "receiver", row: str = "row_id") -> DataFrame:
    """The first ``k`` rows of the group that reaches ``k`` first among the rows below ``limit``; empty if none does."""
    order = Window.partitionBy(room, receiver).orderBy(row)
    numbered = rows.where((F.col(row) < limit) & F.col(room).isNotNull() & F.col(receiver).isNotNull()).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    winner = numbered.where(F.col("_n") == k).agg(F.min_by(F.struct(room, receiver), row).alias("_g")).select(F.col(f"_g.{room}").alias(room), F.col(f"_g.{receiver}").alias(receiver))
    return numbered.join(F.broadcast(winner), [room, receiver]).drop("_n")


def arithmetic_order(column: Column, seed: int) -> Column:
    """A pseudo-random order that every engine computes alike."""
    return (column * 48271 + seed) % 2147483647


def keep_receivers(rows: DataFrame, k: int, seed: int, room: str = "room", receiver: str = "receiver") -> DataFrame:
    """All rows of ``k`` receivers of each room, chosen pseudo-randomly; 0 keeps all."""
    if k <= 0:
        return rows
    order = Window.partitionBy(room).orderBy(arithmetic_order(F.col(receiver), seed), receiver)
    chosen = rows.select(room, receiver).distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")
    return rows.join(chosen, [room, receiver], "left_semi")


def subset(rows: DataFrame, n: int, seed: int, row: str = "row_id") -> DataFrame:
    """``n`` rows in a pseudo-random order (a top-n, not a full sort)."""
    return rows.orderBy(arithmetic_order(F.col(row), seed), row).limit(n)


def prefix(rows: DataFrame, n: int, row: str = "row_id") -> DataFrame:
    """The first ``n`` rows; fewer are an error."""
    taken = rows.orderBy(row).limit(n)
    found = taken.count()
    if found != n:
        raise ValueError(f"{n} rows were asked for, {found} are there")
    return taken
