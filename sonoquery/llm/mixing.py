"""Mixing sources to target weights by a time-varying curriculum.

Method.  Every source has a target of words and a weight schedule over training
time 0 to 1 (piecewise linear knots).  The integral of the schedule, scaled to
the target, is the source's cumulative token demand.  A source's documents, in a
fixed pseudo-random order and repeated as often as the target asks, form a token
stream; the inverse of the demand at a document's offset in the stream is its
training position.  Documents are then range-sorted by position.  Only DataFrame
expressions are used.

Targets: sources in code point order (null last) take the weights in turn and
share ``share`` times all words; a target stops at ``cap`` times its source's
size and the excess goes to the others by weight until none is above.  Sorting
the sources by size / weight gives that fixed point in one pass over a table
with a row for each source.

Scale: word counts are taken in one pass and written as narrow rows.  A source's
running total is made of totals of hash buckets (about ``BUCKET_ROWS`` rows
each over all sources) and running totals within them, so no task holds a source.

Defined results: a null text has size 0, as an empty one; documents of size 0
take nothing and have no position.  A null source is a source of its own.
Repeated rows are separate documents (equal ones share the source's takings in
any order).  A source without words has target 0.  An empty table gives an empty
result.  Texts of any length are only counted, in the JVM.  Columns of the input may
have any name; the position's gets underscores until it is free.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import cut, free_name, named, plain, restored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
BUCKET_ROWS = 2000
#: Knots (time, weight) of the schedules that the weights' sources follow: falling, level, rising.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)))

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sizes`` (source, source_size) with ``turn``, ``weight`` and ``target``; these few rows meet in one task."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    rows = sizes.select("source", "source_size", turn.alias("turn"))
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), F.col("turn") + 1))
    rows = rows.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    everyone = Window.partitionBy()
    full_first = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    rows = rows.withColumn("_asked", F.lit(float(share)) * F.sum("source_size").over(everyone))
    rows = rows.withColumn("_capped", F.coalesce(F.sum("most").over(full_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("_open", F.sum("weight").over(full_first.rowsBetween(0, Window.unboundedFollowing)))
    level = (F.col("_asked") - F.col("_capped")) / F.col("_open")
    rows = rows.withColumn("_level", F.when(level <= F.col("most") / F.col("weight"), level))
    # the level of the first source, in this order, that stays below its cap
    first = F.min_by("_level", F.when(F.col("_level").isNotNull(), F.col("most") / F.col("weight"))).over(everyone)
    rows = rows.withColumn("target", F.when(F.col("source_size") == 0, 0.0).otherwise(F.coalesce(F.least("most", first * F.col("weight")), F.col("most"))))
    return rows.select("source", "source_size", "turn", "weight", "target")


def inverse(schedule: Sequence[tuple[float, float]], fraction: Column) -> Column:
    """Time at which the integral of a piecewise linear schedule reaches ``fraction`` of its whole."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:], strict=False)]
    whole, done, time = sum(areas), 0.0, F.lit(float(schedule[-1][0]))
    pieces = []
    for (t0, w0), (t1, w1), area in zip(schedule, schedule[1:], areas, strict=False):
        rest = fraction * whole - done
        slope = (w1 - w0) / (t1 - t0)
        pieces.append((done + area, F.lit(t0) + F.coalesce(F.try_divide(2 * rest, F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + rest * (2 * slope), F.lit(0.0)))), F.lit(0.0))))
        done += area
    for end, expression in reversed(pieces):
        time = F.when(fraction * whole < end, expression).otherwise(time)
    return F.greatest(F.lit(float(schedule[0][0])), F.least(time, F.lit(float(schedule[-1][0]))))


def place(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, schedules=SCHEDULES, whole: bool = False, row: str | None = None) -> DataFrame:
    """A row for each document: ``key``, ``source``, ``size``, ``source_size``, ``target``, ``taken`` and ``copies``.

    ``copies`` is an array of (copy, words, position), in ascending order.  The
    last pass over a source ends within a document; that one is taken in part,
    or, with ``whole``, taken if at least half of it falls in.  With ``row``, a
    column of that name has the whole row of ``docs`` as a struct (c0, c1 ...).
    """
    wide = docs.select(named(docs, key).alias("_key"), named(docs, source).alias("source"), words(named(docs, text)).alias("size"), F.struct(*(named(docs, c).alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("_row"))
    wide = wide.withColumn("_order", F.md5(F.coalesce(F.col("_key").cast("string"), F.lit(""))))
    sized = cut(wide.drop("_row"))
    bits = max(0, min(28, math.ceil(math.log2(max(1, sized.count()) / BUCKET_ROWS))))
    bucket = F.conv(F.substring("_order", 1, 7), 16, 10).cast("long").bitwiseAND((1 << 28) - 1)
    sized, wide = (t.withColumn("_bucket", F.shiftright(bucket, 28 - bits)) for t in (sized, wide))
    buckets = sized.groupBy("source", "_bucket").agg(F.sum("size").alias("_in_bucket"))
    sources = targets(buckets.groupBy("source").agg(F.sum("_in_bucket").alias("source_size")), weights, share, cap)
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_before", F.coalesce(F.sum("_in_bucket").over(before), F.lit(0)))
    known = buckets.alias("b").join(sources.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).select("b.source", "_bucket", "_before", "source_size", "turn", "target")
    rows = (wide if row else sized).alias("d").join(known.alias("k"), F.col("d.source").eqNullSafe(F.col("k.source")) & (F.col("d._bucket") == F.col("k._bucket")))
    rows = rows.select("_key", "d.source", "size", "_order", "d._bucket", "_before", "source_size", "turn", "target", *(["_row"] if row else []))
    # rows of one id and size go by their text
    ties = [F.xxhash64(F.col("_row")[plain(docs, text)[1][0]])] if row else []
    inside = Window.partitionBy("source", "_bucket").orderBy("_order", "_key", "size", *ties).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_start", F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("_passes", passes).withColumn("_rest", F.floor(F.col("target") - passes * F.col("source_size")).cast("long"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_start")))
    if whole:
        part = F.when(part * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    rows = rows.withColumn("_part", part.cast("long"))

    def copy(i: Column) -> Column:
        # demand is the inverse's argument: the offset in the stream over the target
        fraction = F.try_divide((i * F.col("source_size") + F.col("_start")).cast("double"), F.col("target"))
        position = F.lit(None).cast("double")
        for k, schedule in enumerate(schedules):
            position = F.when(F.col("turn") % len(schedules) == k, inverse(schedule, fraction)).otherwise(position)
        return F.struct(i.cast("int").alias("copy"), F.when(i < F.col("_passes"), F.col("size")).otherwise(F.col("_part")).alias("words"), position.alias("position"))

    n = F.when(F.col("size") > 0, F.col("_passes") + (F.col("_part") > 0).cast("long")).otherwise(F.lit(0))
    copies = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0))), copy), lambda c: c["copy"] < n)
    taken = F.col("size") * F.col("_passes") + F.col("_part")
    return rows.select(F.col("_key").alias(key), "source", "size", "source_size", "target", taken.alias("taken"), copies.alias("copies"), *([F.col("_row").alias(row)] if row else []))


def training_order(docs: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """Rows of ``docs``, once for each copy that the mix takes whole, range-sorted by position.

    The rows go along with their places and are joined to nothing by id, so that rows
    with the same id, or none, meet their own copies only.
    """
    names = docs.columns
    rows = place(docs, key=key, whole=True, row="_row", **how).select("_row", F.explode("copies").alias("_copy"))
    order = F.col("_copy")["position"], F.col("_row")[plain(docs, key)[1][0]]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, F.col("_copy")["copy"])
    return restored(rows.select("_row.*", order[0].alias("_position")), names, F.col("_position").alias(free_name(names, "position")))
