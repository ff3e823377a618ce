"""Document fingerprints by winnowing, in DataFrame expressions only.

Method.  A text is cut into tokens (words, longer ones into pieces of
``PIECE`` code points), every run of ``K`` tokens is hashed, and of each window of
``W`` consecutive hashes the smallest is kept, the rightmost one if it stands
more than once.  A kept value holds its hash and its position, so any passage of
``K + W - 1`` tokens that two texts share is found in both fingerprints, with the
places where it stands.

A fingerprint is an ``array<bigint>``: the hash (``63 - POSITION_BITS`` bits) in
the upper bits and ``2 ** POSITION_BITS - 1 - position`` in the lower ones.  The
smallest value of a window is thereby the smallest hash and, among equal ones,
the last.  :func:`parts` takes values apart.

Defined results: null and empty texts, and texts of white space, have an empty
fingerprint; a text of fewer than ``K`` tokens has one value for all of them.
Two empty fingerprints are alike (1.0), an empty and another one are not (0.0).
Rows of equal keys and texts follow each other in any order.  An empty table gives
an empty result.  Texts are taken whole, and their positions must be below
``2 ** POSITION_BITS`` tokens.  Columns of the input may have any name; names of
results get underscores until they are free.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import free_name, named, plain, restored

K = 4
W = 4
PIECE = 24
POSITION_BITS = 26
BUCKET_ROWS = 2000
#: Quantiles that are taken of the keys; their bounds are a literal of the plan.
GROUPS = 10_000

_MASK = (1 << POSITION_BITS) - 1
_HASHES = (1 << (63 - POSITION_BITS)) - 1


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]{1,%d}" % PIECE), 0)


def with_fingerprint(df: DataFrame, text: Column, out: str, k: int = K, w: int = W) -> DataFrame:
    """``df`` with the fingerprint of ``text`` in ``out``.

    Each step is a column of its own, so that Catalyst evaluates it once.
    """
    words, grams = free_name([*df.columns, out], "_words"), free_name([*df.columns, out], "_grams")

    def places(array: str, window: int) -> Column:
        n = F.size(array)
        return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)))).otherwise(F.expr("cast(array() as array<int>)"))

    step = df.withColumn(words, F.transform(tokens(text), lambda t: F.xxhash64(t)))
    # get() is null beyond the end, and both xxhash64 and least pass over nulls
    gram = lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k)))
    value = lambda i: F.shiftleft(gram(i).bitwiseAND(_HASHES), POSITION_BITS).bitwiseOR(F.lit(_MASK) - i)
    step = step.withColumn(grams, F.transform(places(words, k), value)).drop(words)
    smallest = lambda i: F.least(*(F.get(grams, i + j) for j in range(w)))
    return step.withColumn(out, F.array_distinct(F.transform(places(grams, w), smallest))).drop(grams)


def hashes(fingerprint: Column) -> Column:
    return F.transform(fingerprint, lambda x: F.shiftright(x, POSITION_BITS))


def parts(fingerprint: Column) -> Column:
    """``array<struct<hash, position>>``, positions in tokens from 0."""
    return F.transform(fingerprint, lambda x: F.struct(F.shiftright(x, POSITION_BITS).alias("hash"), (F.lit(_MASK) - x.bitwiseAND(_MASK)).alias("position")))


def digest(fingerprint: Column) -> Column:
    """128 bits of a fingerprint, as text."""
    return F.concat(F.lower(F.hex(F.xxhash64(fingerprint))), F.lit("-"), F.lower(F.hex(F.xxhash64(fingerprint, F.lit(1)))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of hashes."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def with_bucket(df: DataFrame, key: str, out: str, rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with the number of the range of keys that a row is in, in ascending order.

    Bounds are quantiles of the keys, so ranges are about even whatever the keys
    are; null keys are in range 0.  They come as a literal of two levels, which
    keeps the comparisons for a row to the square root of their number.  Beyond ``GROUPS``
    bounds, the ranges between them are parted evenly, so that ranges don't grow with the input.
    Rows of one key are in one range.
    """
    n = df.count()
    wanted = math.ceil(n / rows)
    groups = min(GROUPS, wanted)
    bounds: list[int] = []
    if groups > 1:
        shares = [i / groups for i in range(1, groups)]
        found = df.select(F.percentile_approx(named(df, key), shares, 10 * groups)).first()[0]
        bounds = sorted(set(found or []))
    if not bounds:
        return df.withColumn(out, F.lit(0).cast("long"))
    step = math.ceil(math.sqrt(len(bounds)))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    above = lambda array: F.size(F.filter(array, lambda b: b <= named(df, key)))
    block = above(F.lit([g[0] for g in blocks]))
    inner = F.get(F.lit([bounds[:0] + g for g in blocks]), block - 1)
    df = df.withColumn(out, F.when(block > 0, (block - 1) * step + above(inner)).otherwise(F.lit(0)).cast("long"))
    parts = math.ceil(wanted / GROUPS)
    if parts < 2:
        return df
    # beyond GROUPS quantiles, each of their ranges is parted evenly by key
    whole = F.lit(bounds)
    low, high = F.get(whole, F.col(out).cast("int") - 1), F.get(whole, F.col(out).cast("int"))
    place = F.floor((named(df, key) - low) * parts / (high - low)).cast("long")
    return df.withColumn(out, F.col(out) * parts + F.coalesce(F.greatest(F.lit(0), F.least(place, F.lit(parts - 1))), F.lit(0)))


def with_next(docs: DataFrame, text: str = "text", key: str = "doc_id", out: str = "fingerprint", following: str = "following") -> DataFrame:
    """``docs`` with the fingerprint of ``text`` and a struct (text, fingerprint) of the next row in ascending order of the key, the first after the last.

    The texts are shuffled once, to ranges of keys; fingerprints are made after
    that.  The first row of each range is handed to the range before it.  Rows
    of one key follow each other in the order of their texts.
    """
    names = docs.columns
    rows, (text, key) = plain(docs, text, key)
    rows = rows.withColumn("_text", F.col(text).cast("string"))
    rows = with_bucket(rows, key, "_bucket")
    first = F.min(F.struct(F.col(key).isNotNull().alias("a"), F.col(key).alias("b"), F.coalesce("_text", F.lit("")).alias("text")))
    firsts = rows.groupBy("_bucket").agg(first.alias("_first"))
    everyone = Window.orderBy("_bucket")
    after = F.coalesce(F.lead("_first").over(everyone), F.first("_first").over(everyone.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    firsts = firsts.select("_bucket", after["text"].alias("_text"))
    firsts = with_fingerprint(firsts, F.col("_text"), "_print").select(F.col("_bucket"), F.struct("_text", "_print").alias("_after"))

    rows = with_fingerprint(rows.repartition("_bucket"), F.col("_text"), "_own")
    order = Window.partitionBy("_bucket").orderBy(F.col(key).asc_nulls_first(), F.coalesce("_text", F.lit("")))
    own = F.struct(F.coalesce("_text", F.lit("")).alias("_text"), F.col("_own").alias("_print"))
    rows = rows.withColumn("_lead", F.lead(own).over(order)).join(firsts, "_bucket", "left")
    follower = F.coalesce("_lead", "_after")
    out = free_name(names, out)
    return restored(rows, names, F.col("_own").alias(out), F.struct(follower["_text"].alias("text"), follower["_print"].alias("fingerprint")).alias(free_name([*names, out], following)))


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last quarter of code points replaced by as many of the first ones of ``following``."""
    n = F.char_length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - quarter), F.substring(following, F.lit(1), quarter))
