"""Scene recipes: seeded draws that don't depend on how rows are partitioned.

Every row draws from a generator of its own, seeded by (seed, epoch, index) or
(seed, index, condition), in a fixed order: clean or not (training only), room,
receiver, responses, noises, target, offsets, pink level, seed.

No index of responses travels.  A response is addressed by its rank among the rows of its
(room, receiver); ranks are numbered in the table (:class:`RankIndex`).  A draw goes in three steps, each of
which makes the generator anew and repeats the draws before: the room's number needs the number of rooms only, the
receiver's number that of the room's receivers, the ranks the size of the group.  Between the steps the
sizes come by equi-joins, and in the end ranks meet row ids by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import RECIPE, Params

#: Rows of a group that are numbered in one task, at most (where row ids are dense).
BUCKET = 1 << 20


@dataclass(frozen=True)
class RankIndex:
    """Addresses of responses.

    ``rooms`` has (room_no, room, receivers), ``groups`` (room, receiver_no, receiver, size) and ``rows`` (room, receiver,
    rank, row_id); numbers and ranks count from 0 in ascending order of names and ids.
    """

    rooms: DataFrame
    groups: DataFrame
    rows: DataFrame
    n_rooms: int

    @classmethod
    def of(cls, responses: DataFrame) -> RankIndex:
        """Of responses (room, receiver, row_id); rows with a null room or receiver are left out.

        A group's rows are numbered in buckets of ids, whose sizes are summed up before, so a group may hold most rows.
        One task numbers the rooms, a row for each.
        """
        rows = responses.where(F.col("room").isNotNull() & F.col("receiver").isNotNull()).select("room", "receiver", "row_id", F.floor(F.col("row_id") / BUCKET).alias("_bucket"))
        group = ["room", "receiver"]
        buckets = rows.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
        before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        shifted = buckets.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
        inside = Window.partitionBy(*group, "_bucket").orderBy("row_id")
        ranked = rows.withColumn("_at", F.row_number().over(inside) - 1).join(shifted, [*group, "_bucket"])
        groups = buckets.groupBy(*group).agg(F.sum("_n").alias("size"))
        groups = groups.withColumn("receiver_no", (F.row_number().over(Window.partitionBy("room").orderBy("receiver")) - 1).cast("bigint"))
        rooms = groups.groupBy("room").agg(F.count("*").alias("receivers"))
        rooms = rooms.withColumn("room_no", (F.row_number().over(Window.orderBy("room")) - 1).cast("bigint"))
        return cls(rooms, groups, ranked.select(*group, (F.col("_before") + F.col("_at")).cast("bigint").alias("rank"), "row_id"), groups.select("room").distinct().count())


class RoomIndex:
    """A few groups that a caller names: rooms and receivers in ascending order, with the ascending row ids of each group."""

    def __init__(self, groups: list[tuple[str, str, list[int]]]) -> None:
        self.tree: dict[str, list[tuple[str, np.ndarray]]] = {}
        for room, receiver, ids in sorted(groups, key=lambda g: (g[0], g[1])):
            self.tree.setdefault(room, []).append((receiver, np.asarray(ids, np.int64)))
        self.rooms = list(self.tree)

    def ranked(self, spark: SparkSession) -> RankIndex:
        rows = [(room, receiver, int(i)) for room, receivers in self.tree.items() for receiver, ids in receivers for i in ids]
        return RankIndex.of(spark.createDataFrame(rows, "room string, receiver string, row_id bigint"))


def _rest(size: int, n_noises: int, params: Params, rng: np.random.Generator, group: str) -> dict:
    """What is drawn once the group is known; a group or a noise table that is too small is an error."""
    count = params.number_of_noises
    if size < count + 1 or n_noises < count:
        raise ValueError(f"too few responses in {group} or too few noises for {count} noises")
    ranks = rng.choice(size, size=count + 1, replace=False).tolist()
    noises = rng.choice(n_noises, size=count, replace=False).tolist()
    target = float(rng.uniform(*params.snr_range))
    offsets = rng.uniform(*params.offset_range_ms, size=count).tolist()
    return {"ranks": ranks, "noise_indices": noises, "target_snr_db": target, "offsets_ms": offsets, "pink_db": float(rng.uniform(*params.pink_range_db)), "rng_seed": int(rng.integers(0, np.iinfo(np.int64).max))}


def draw(index: RoomIndex, n_noises: int, speech: int, params: Params, rng: np.random.Generator) -> dict:
    """One recipe from a few groups."""
    room = index.rooms[rng.integers(len(index.rooms))]
    receivers = index.tree[room]
    receiver, ids = receivers[rng.integers(len(receivers))]
    drawn = _rest(len(ids), n_noises, params, rng, f"{room}/{receiver}")
    responses = [int(ids[k]) for k in drawn.pop("ranks")]
    return {"speech_index": speech, "room": room, "receiver": receiver, "speech_rir_index": responses[0], "noise_rir_indices": responses[1:], "number_of_noises": params.number_of_noises} | drawn


_DRAWN = pa.struct([("ranks", pa.list_(pa.int64())), ("noise_indices", pa.list_(pa.int64())), ("target_snr_db", pa.float64()), ("offsets_ms", pa.list_(pa.float64())), ("pink_db", pa.float64()), ("rng_seed", pa.int64())])
_DRAWN_DDL = "struct<ranks:array<bigint>,noise_indices:array<bigint>,target_snr_db:double,offsets_ms:array<double>,pink_db:double,rng_seed:bigint>"


def recipes(indices: DataFrame, index: RankIndex | RoomIndex, n_noises: int, params: Params, seed: int, epoch: int = 0, mode: str = "train") -> DataFrame:
    """A recipe for each row's ``speech_index``; in training, clean rows have nulls and ``is_clean``."""
    if mode not in ("train", "eval"):
        raise ValueError("mode is train or eval")
    if isinstance(index, RoomIndex):
        index = index.ranked(indices.sparkSession)
    n_rooms = index.n_rooms
    if not n_rooms:
        raise ValueError("there are no responses")

    def begun(i: int) -> tuple[np.random.Generator, bool]:
        rng = np.random.default_rng(np.random.SeedSequence([seed, epoch, i] if mode == "train" else [seed, i, 0]))
        return rng, mode == "train" and rng.random() < params.clean_probability

    def room_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The room's number, null for a clean scene."""
        for batch in batches:
            out = []
            for i in batch.column(0).to_pylist():
                rng, clean = begun(i)
                out.append(None if clean else int(rng.integers(n_rooms)))
            yield pa.record_batch([batch.column(0), pa.array(out, pa.int64())], ["speech_index", "room_no"])

    def receiver_of(speech: pa.Array, receivers: pa.Array) -> pa.Array:
        out = []
        for i, n in zip(speech.to_pylist(), receivers.to_pylist(), strict=True):
            rng, _ = begun(i)
            rng.integers(n_rooms)
            out.append(int(rng.integers(n)))
        return pa.array(out, pa.int64())

    def rest_of(speech: pa.Array, receivers: pa.Array, sizes: pa.Array, rooms: pa.Array, names: pa.Array) -> pa.Array:
        out = []
        for i, n, size, room, name in zip(*(x.to_pylist() for x in (speech, receivers, sizes, rooms, names)), strict=True):
            rng, _ = begun(i)
            rng.integers(n_rooms)
            rng.integers(n)
            out.append(_rest(size, n_noises, params, rng, f"{room}/{name}"))
        return pa.array(out, _DRAWN)

    asked = indices.select(F.col("speech_index").cast("bigint")).mapInArrow(room_of, "speech_index bigint, room_no bigint")
    drawn = asked.where(F.col("room_no").isNotNull()).join(index.rooms, "room_no")
    drawn = drawn.withColumn("receiver_no", F.arrow_udf(receiver_of, "bigint")("speech_index", "receivers")).join(index.groups, ["room", "receiver_no"])
    drawn = drawn.withColumn("d", F.arrow_udf(rest_of, _DRAWN_DDL)("speech_index", "receivers", "size", "room", "receiver"))
    own = [F.col(f"d.{c}").alias(c) for c in ("noise_indices", "offsets_ms", "target_snr_db", "pink_db", "rng_seed")]
    ranks = drawn.select("speech_index", "room", "receiver", *own, F.posexplode("d.ranks").alias("pos", "rank"))
    met = ranks.join(index.rows, ["room", "receiver", "rank"])
    # a recipe is its speech index's, so rows that repeat one are made once and counted
    first = F.first(F.struct("room", "receiver", "noise_indices", "offsets_ms", "target_snr_db", "pink_db", "rng_seed"))
    whole = met.groupBy("speech_index").agg(first.alias("f"), F.array_sort(F.collect_set(F.struct("pos", "row_id"))).alias("r"), F.count_if(F.col("pos") == 0).alias("copies"))
    whole = whole.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    at = F.transform("r", lambda x: x["row_id"])
    count = F.lit(params.number_of_noises).cast("int")
    simulated = whole.select(
        "speech_index", "f.room", "f.receiver", F.get(at, F.lit(0)).alias("speech_rir_index"), "f.noise_indices", F.slice(at, 2, count).alias("noise_rir_indices"),
        "f.offsets_ms", count.alias("number_of_noises"), "f.target_snr_db", "f.pink_db", "f.rng_seed", F.lit(False).alias("is_clean"),
    )
    if mode == "eval":
        return simulated
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in simulated.schema if f.name not in ("speech_index", "is_clean")]
    return simulated.unionByName(asked.where(F.col("room_no").isNull()).select("speech_index", *nothing, F.lit(True).alias("is_clean")))


def targets(base: DataFrame, ranges: list[tuple[float, float]], seed: int, attempts: int) -> DataFrame:
    """(speech_index, condition_index, attempt, target): the targets that are tried for each condition, from 1 on."""

    def work(indices: pa.Array) -> pa.Array:
        drawn = np.empty((len(indices), len(ranges), attempts))
        for k, i in enumerate(indices.to_pylist()):
            for c, (low, high) in enumerate(ranges):
                drawn[k, c] = np.random.default_rng(np.random.SeedSequence([seed, i, c + 1])).uniform(low, high, attempts)
        each = len(ranges) * attempts
        condition = np.tile(np.repeat(np.arange(1, len(ranges) + 1, dtype=np.int32), attempts), len(indices))
        attempt = np.tile(np.arange(attempts, dtype=np.int32), len(indices) * len(ranges))
        rows = pa.StructArray.from_arrays([pa.array(condition), pa.array(attempt), pa.array(drawn.reshape(-1))], ["condition_index", "attempt", "target"])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(indices) + 1) * each, pa.int32()), rows)

    draws = F.arrow_udf(work, "array<struct<condition_index:int,attempt:int,target:double>>")
    return base.select("speech_index", F.explode(draws("speech_index")).alias("_t")).select("speech_index", "_t.*")


#: Fixed values of the permutation: rounds, the round function's factor and modulus, the factor of the keys, and steps of a walk.
ROUNDS, FACTOR, MODULUS, KEY_FACTOR, WALK = 6, 48271, 2147483647, 69621, 64


def round_keys(seed: int) -> list[int]:
    key, keys = seed % MODULUS, []
    for i in range(2 * ROUNDS):
        key = (key * KEY_FACTOR + i + 1) % MODULUS
        keys.append(key)
    return keys


def sides(count: int) -> tuple[int, int]:
    """Sides of the smallest near-square rectangle of ``count`` places or more."""
    a = max(1, math.isqrt(max(0, count - 1)) + 1)
    return a, max(1, -(-count // a))


def permuted(k: Column, count: int, seed: int) -> Column:
    """Where the permutation of ``0 .. count - 1`` with key ``seed`` takes ``k``: computed from ``k`` alone.

    ``k`` is a place (l, r) in a rectangle just as large as needed.  Each round adds to one coordinate, modulo
    its side, a function of the other, which can be undone, so the rounds permute the rectangle.  Places beyond ``count`` are
    permuted again until they fall inside; there are fewer of them than the rectangle's side, so a walk of ``WALK``
    steps ends always for up to 4,096 rows and but for a chance below (1 / 64) ** 64 beyond, which is an error.
    """
    a, b = sides(count)
    if b >= MODULUS:
        raise ValueError("too many rows")

    def bound(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def mixed(x: Column, key: Column) -> Column:
        return bound((x * FACTOR + key) % MODULUS, lambda t: t * t % MODULUS)

    keys = round_keys(seed)
    pairs = F.array(*(F.struct(F.lit(keys[2 * i]).cast("bigint").alias("p"), F.lit(keys[2 * i + 1]).cast("bigint").alias("q")) for i in range(ROUNDS)))

    def step(state: Column, key: Column) -> Column:
        left = (state["l"] + mixed(state["r"], key["p"])) % a
        return bound(left, lambda l: F.struct(l.alias("l"), ((state["r"] + mixed(l, key["q"])) % b).alias("r")))

    def once(x: Column) -> Column:
        start = F.struct(F.floor(x / b).cast("bigint").alias("l"), (x % b).cast("bigint").alias("r")) if count < 1 << 50 else F.struct(((x - x % b) / b).cast("bigint").alias("l"), (x % b).cast("bigint").alias("r"))
        return F.aggregate(pairs, start, step, lambda s: s["l"] * b + s["r"])

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(k.cast("bigint")), lambda x, _: F.when(x >= count, once(x)).otherwise(x))
    return bound(walk, lambda x: F.when(x >= count, F.raise_error(F.lit("the walk did not end")).cast("bigint")).otherwise(x))


def permuted_sql(source: str, count: str, sides_sql: tuple[str, str], seed: int) -> str:
    """SQL of the rounds of :func:`permuted` over rows (k, x) of ``source``, once: (k, x)."""
    a, b = sides_sql
    keys = round_keys(seed)
    now = f"SELECT k, x // {b} AS l, x % {b} AS r, {count} AS n, {a} AS a, {b} AS b FROM {source}"
    for p, q in zip(keys[0::2], keys[1::2]):
        now = f"SELECT k, (l + t * t % {MODULUS}) % a AS l, r, n, a, b FROM (SELECT *, (r * {FACTOR} + {p}) % {MODULUS} AS t FROM ({now}))"
        now = f"SELECT k, l, (r + t * t % {MODULUS}) % b AS r, n, a, b FROM (SELECT *, (l * {FACTOR} + {q}) % {MODULUS} AS t FROM ({now}))"
    return f"SELECT k, l * b + r AS x FROM ({now})"


def chosen(spark: SparkSession, count: int, n: int, seed: int) -> DataFrame:
    """``n`` of ``count`` indices without replacement, as ``speech_index`` with their ``place``, 0 being the first.

    The k-th is :func:`permuted` of k, so no table of indices is made anywhere and a longer sample begins with a shorter one.
    """
    if n > count:
        raise ValueError(f"{n} of {count} rows were asked for")
    return spark.range(n).select(F.col("id").cast("int" if n < 1 << 31 else "bigint").alias("place"), permuted(F.col("id"), count, seed).alias("speech_index"))
