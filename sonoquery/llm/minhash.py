"""Near-duplicate documents by bottom-k sketches of one hash function.

Method.  A document's set are the hashes of its distinct word shingles (one 64-bit
hash function); its sketch are the ``K`` smallest of them.

1. Documents with equal sets form a class; one of each goes on.
2. Inverted lists of the retained values.  Similar sets share at least
   ``share * K`` sketch values but for a chance below ``MISS`` a pair; of a sketch's
   values in order of their frequency, it therefore suffices to list the
   rarest ``(1 - share) * K + 1``.  Values of one class only, mostly all of them,
   are in no list.
3. Lists are dealt to blocks of about ``BLOCK`` members, which are compared to the
   block's least member, and the heads of blocks likewise.  A pair whose
   union sketch (the ``K`` smallest of both) estimates too low a similarity is
   dropped; the rest is verified by exact Jaccard on the full sets.  Links
   make components.
4. Only pairs of a list that lie in different components are left.  Those of
   lists of at most ``SHORT`` members are made once each, filtered by the estimate
   within the join.  In longer lists, the members' differences from what most of
   them have are indexed (:func:`by_difference`), which finds all links among them
   without pairing members that differ in ways of their own, whatever passages they
   share.  The pairs are verified in the same way, and join the components found so far.

Lists, links and components stay distributed; rows of a long list are joined by
block or salt, frequent classes are left to Spark's skew handling, and counts are combined before the
shuffle.

Defined results: without words (or text) the set is empty, and the document is
linked with nothing.  With fewer words than a shingle has, the whole sequence is
the only shingle.  Rows with a null key are linked with nothing and have a null
component.  Rows that share a key count as one document with all their sets.  An
empty table gives an empty result.  Texts of any length are taken whole, in a Python
worker one at a time beyond a slice's size.  Only ``text`` and ``key`` are read, so
further columns may have any name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .frames import cut, drop_cut, named, small_batches, spread
from .words import by_slices, coded, grams, hash_strings, mix, starts, trim, words_of

K = 48
MISS = 1e-8
#: Lists of more members are taken apart by their differences from a center.  That costs about
#: a set's size for a member, where pairs cost half the list's length.
SHORT = 256
#: About as many nodes of a family tell its center; the result doesn't depend on it.
CENTER = 128
#: How often bounds are made anew from the nodes that they have left, after the pass over first members.
PASSES = 2
#: Nodes of a list that one head is compared to.
BLOCK = 256
#: Tasks that the rows of one family are dealt to, at least.
SALTS = 16

SET = pa.struct([("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("sketch", pa.list_(pa.int64()))])
SET_DDL = "struct<n:bigint,s1:bigint,s2:bigint,sketch:array<bigint>>"


def sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of each text."""
    doc, words = words_of(pc.ascii_lower(texts))
    codes, distinct = coded(words)
    h = hash_strings(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    g = grams(h, n)
    inside = doc[: len(g)] == doc[n - 1 : n - 1 + len(g)] if len(g) else np.zeros(0, bool)
    of, g = doc[: len(g)][inside], g[inside]
    order = np.lexsort((g, of))
    of, g = of[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (of[1:] != of[:-1])
    of, g = of[new], g[new]
    out = np.split(g, np.searchsorted(of, np.arange(1, len(texts))))
    bounds = starts(doc, len(texts))
    for i in np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < n)).tolist():
        own = h[bounds[i] : bounds[i + 1]]
        out[i] = mix(grams(own, len(own)) + np.uint64(len(own)))
    return out


def _sketches(texts: pa.Array, n: int, k: int) -> pa.Array:
    rows = []
    for s in sets(texts, n):
        name = xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else 0
        rows.append((len(s), *np.array([name >> 64, name & (1 << 64) - 1], np.uint64).view(np.int64).tolist(), s[:k].view(np.int64)))
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SET, strict=True)], fields=list(SET))


def _packed(texts: pa.Array, n: int) -> pa.Array:
    return pa.array([s.tobytes() for s in sets(texts, n)], pa.binary())


def least_share(k: int, percent: int, miss: float = MISS) -> float:
    """Share of ``k`` values that sets of that similarity have in common but for a chance of ``miss``."""
    p, tail = percent / 100, 0.0
    for x in range(k + 1):
        tail += math.comb(k, x) * p**x * (1 - p) ** (k - x)
        if tail > miss:
            return x / k
    return 1.0


def similar(a: pa.Array, b: pa.Array, percent: int) -> pa.Array:
    """Whether packed sets are similar: 100 * intersection >= percent * union."""
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
        both = np.concatenate([x, y])
        both.sort()
        common = int((both[1:] == both[:-1]).sum())
        out.append(100 * common >= percent * (len(both) - common))
    trim()
    return pa.array(out, pa.bool_())


def likely(a: Column, b: Column, na: Column, nb: Column, k: int, percent: int, share: float) -> Column:
    """Whether sizes and the union sketch allow the similarity."""
    sizes = (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (F.least(na, nb) > 0)
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return sizes & (shared >= F.lit(share) * F.size(union))


DIFFERENCE = pa.struct([("d", pa.list_(pa.int64())), ("added", pa.int32())])


def _difference(centers: pa.Array, sets: pa.Array) -> pa.Array:
    """What is in one of a center (a list, null for an empty one) and a packed set: first what the set adds, ``added`` members, then what it lacks in the center's order."""
    out, added = [], []
    for x, y in zip(centers, sets, strict=True):
        own = np.frombuffer(y.as_buffer(), np.int64)
        center = x.values.to_numpy() if x.is_valid else own[:0]
        more = own[~np.isin(own, center, assume_unique=True)]
        out.append(np.concatenate([more, center[~np.isin(center, own, assume_unique=True)]]))
        added.append(len(more))
    trim()
    return pa.StructArray.from_arrays([pa.array(out, DIFFERENCE[0].type), pa.array(added, pa.int32())], fields=list(DIFFERENCE))


def _unpacked(sets: pa.Array) -> pa.Array:
    return pa.array([np.frombuffer(x.as_buffer(), np.int64) for x in sets], pa.list_(pa.int64()))


def _spread(df: DataFrame) -> DataFrame:
    """``df`` once for each salt, for joins to rows of one key that are dealt by :func:`_salt`."""
    return spread(df, SALTS)


def _salt() -> Column:
    return F.pmod(F.hash("node"), F.lit(SALTS))


def _listed(parts: DataFrame) -> DataFrame:
    """What nodes of different components of a family share: (family, e), how often it occurs and the holder with the least g."""
    first = F.min(F.struct("g", "node", "component")).alias("o")
    lists = parts.groupBy("family", "e").agg(F.count("*").alias("times"), F.min("component").alias("low"), F.max("component").alias("high"), first)
    return lists.where("low <> high").drop("low", "high")


def _level(v: Column) -> Column:
    """Class of a number, ascending with it: steps of 4, and finer than 5% above 128."""
    return F.when(v < 128, F.floor(v / 4)).otherwise(32 + F.floor(F.log2(v / 128) * 16)).cast("int")


def _one_each(pairs: DataFrame) -> DataFrame:
    """Of (a, component_a, b, component_b) one pair for each two components, written."""
    low, high = F.least("component_a", "component_b").alias("low"), F.greatest("component_a", "component_b").alias("high")
    return cut(pairs.groupBy(low, high).agg(F.min(F.struct("a", "b")).alias("x")).select("low", "high", "x.a", "x.b"))


def by_difference(families: DataFrame, full: DataFrame, percent: int, short: int) -> DataFrame:
    """Pairs (a, b) that connect all similar nodes of a family, given those that are connected already.

    ``families`` has ``family`` (an integer), ``node`` and ``component``; ``full`` the
    packed sets by node.  A family's center C has the members that more than half of
    its sets have, as far as ``CENTER`` of them can tell.  With D(x) for what x and C don't have in common, x and y differ in
    |D(x)| + |D(y)| - 2 c places, where c counts what D(x) and D(y) share.  Similar sets
    differ in at most r (|x| + |y|), r = (100 - percent) / (100 + percent), so with
    g(x) = |D(x)| - r |x| they are similar if and only if

        2 c >= g(x) + g(y).

    1. Let o be the family's node with the least g.  Nodes with g(x) <= -g(o) are similar
       to o, whatever c is.
    2. Another pair needs c >= (g(x) + m(x)) / 2 and c >= 1, where m(x) is the least g in other
       components than x's among nodes whose D is large enough for x.  A D's members are in one
       order for all of the family: those that C lacks first, as few have them, then those of C
       that fewest lack.  Two D's that share c members share one of the first |D| - c + 1 of each, so
       first, only as many of what C lacks are listed, and nodes that share none of them with other components
       go, unless members of C are among their first.  Then ``PASSES`` times, of what the pass before has left, all that
       C lacks is listed; what other components don't share goes from the D's, and nodes whose D is
       too small then.  Nodes are also compared to the least ones of their lists.  Pairs of what is left meet in
       inverted lists of the first |D| - bound + 1 members of each D, the rarest of what C lacks being first.
    3. In lists of at most ``short`` nodes, pairs are made and c is counted within the
       join.  A longer list, whose nodes have a further passage in common, is
       a family of its own in the next round, with a center of its own; lists of the same
       nodes become one.  A member of a D is missing from about half of the
       family's, or more, so families halve with each round.

    A component that a pair connects to one with a lesser name counts as that one from there on.
    Independent changes are in one D only, and what most of the family has is in the
    center, so a large group of copies with changes of their own gives no pairs,
    whatever passages they all have in common.  Between two components one pair is given.
    """
    p, q = 100 + percent, 100 - percent  # r = q / p; g below is p times that of the text
    difference, unpacked = F.arrow_udf(_difference, "struct<d:array<bigint>,added:int>"), F.arrow_udf(_unpacked, "array<bigint>")
    found = families.select(F.col("component").alias("low"), F.col("component").alias("high"), F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    last = found
    while families.take(1):
        # any center is right; that of some hundred nodes is about that of all, so lists still halve
        members = families.groupBy("family").agg(F.count("*").alias("members"))
        some = families.withColumn("salt", _salt()).join(_spread(members), ["family", "salt"])
        some = some.where(F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / CENTER)) == 0).select("family", "node")
        asked = some.groupBy("family").agg(F.count("*").alias("asked"))
        times = some.join(full, "node").select("family", F.explode(unpacked("set")).alias("e")).groupBy("family", "e").agg(F.count("*").alias("n"))
        centers = cut(times.join(asked, "family").where("2 * n > asked").groupBy("family").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "e"))).alias("_x")).select("family", F.transform("_x", lambda x: x["e"]).alias("center")))
        rows = families.join(full, "node")
        rows = rows.withColumn("salt", _salt()).join(_spread(centers), ["family", "salt"], "left")
        rows = rows.select("family", "node", "salt", "component", (F.octet_length("set") / 8).cast("long").alias("n"), difference("center", "set").alias("x"))
        apart = cut(rows.select("family", "node", "salt", "component", "n", "x.d", "x.added").withColumn("g", F.size("d") * p - F.col("n") * q).drop("n"))

        # 1. nodes that the family's least one is surely similar to
        best = apart.groupBy("family").agg(F.min(F.struct("g", "node", "component")).alias("o"))
        rows = apart.join(_spread(best), ["family", "salt"])
        sides = F.col("node").alias("a"), F.col("component").alias("component_a"), F.col("o.node").alias("b"), F.col("o.component").alias("component_b")
        close = F.col("g") + F.col("o.g") <= 0
        direct = rows.where(close & (F.col("component") != F.col("o.component"))).select(*sides)
        near = rows.withColumn("component", F.when(close, F.col("o.component")).otherwise(F.col("component"))).drop("o")

        # 2. nodes that can have a partner, and what they share
        spent = []
        for i in range(1 + PASSES):
            half = F.col("g") / (2 * p)
            near = near.withColumn("level", _level(F.size("d") - half))
            least = near.groupBy("family", "level", "component").agg(F.min("g").alias("g"))
            # the two least of each level; Spark keeps two for each task before the shuffle
            place = F.row_number().over(Window.partitionBy("family", "level").orderBy("g", "component"))
            two = least.withColumn("place", place).where("place <= 2").select("family", F.struct("level", F.struct("g", "component").alias("o")).alias("x"))
            limits = two.groupBy("family").agg(F.collect_list("x").alias("limits"))
            fit = F.filter("limits", lambda x: (x["level"] >= _level(half)) & (x["o"]["component"] != F.col("component")))  # noqa: B023
            bound = F.ceil((F.col("g") + F.array_min(F.transform(fit, lambda x: x["o"]["g"]))) / (2 * p)).cast("int")
            bound = F.when(F.size(fit) > 0, F.greatest(bound, F.lit(1)))
            near = near.drop("level").join(_spread(limits), ["family", "salt"]).withColumn("bound", bound).drop("limits").where("size(d) >= bound")
            able = near = cut(near)
            first = F.size("d") - F.col("bound") + 1
            ids = near.select("family", "node", "component", "g")
            if i == 0:
                head = F.slice("d", F.lit(1), F.least(first, F.col("added")))
                parts = heads = cut(near.select(*ids.columns, F.explode(head).alias("e")))
            elif i == 1:  # what isn't listed yet
                rest = F.slice("d", F.col("head") + 1, F.col("added") - F.col("head"))
                parts = cut(heads.join(ids.select("family", "node"), ["family", "node"], "left_semi").union(near.select(*ids.columns, F.explode(rest).alias("e"))))
            else:
                parts = cut(before.select("family", "node", "e").join(ids, ["family", "node"]).select(*ids.columns, "e"))
            met = before = cut(parts.join(_listed(parts), ["family", "e"]))
            if i == 0:  # nodes that share one of their first members
                some = met.select("family", "node").distinct().withColumn("_met", F.lit(True))
                near = near.join(some, ["family", "node"], "left").where((first > F.col("added")) | F.col("_met"))
                near = cut(near.withColumn("head", F.least(first, F.col("added"))).drop("bound", "_met"))
            else:
                own = met.groupBy("family", "node").agg(F.sort_array(F.collect_list(F.struct("times", "e"))).alias("own"))
                near = near.join(own, ["family", "node"], "left").withColumn("own", F.coalesce(F.transform("own", lambda x: x["e"]), F.array().cast("array<bigint>")))
                lacks = F.slice("d", F.col("added") + 1, F.size("d") - F.col("added"))
                near = near.select("family", "node", "salt", "component", "g", F.concat("own", lacks).alias("d"), F.size("own").alias("added"), "bound").where("size(d) >= bound")
                if i == 1:  # nodes that a list's least one is similar to
                    stars = met.where("component <> o.component").select("family", "node", "component", "g", "o").distinct().withColumn("salt", _salt())
                    of = able.select("family", F.col("node").alias("_of"), F.col("d").alias("_d")).join(stars.select("family", F.col("o.node").alias("_of")).distinct(), ["family", "_of"])
                    alike = stars.withColumn("_of", F.col("o.node")).join(able.select("family", "node", "d"), ["family", "node"]).join(_spread(of), ["family", "_of", "salt"])
                    alike = alike.where(F.size(F.array_intersect("d", "_d")) * (2 * p) >= F.col("g") + F.col("o.g"))
                    direct = _one_each(direct.union(alike.select(*sides)))
                    joined = direct.union(last).groupBy(F.col("high").alias("component")).agg(F.min("low").alias("_new"))
                    near = near.join(_spread(joined), ["component", "salt"], "left").withColumn("component", F.coalesce("_new", "component")).drop("_new")
                near = cut(near)
                drop_cut(parts)
            spent += [able, near, met]
        spent.remove(near)
        near = near.withColumnRenamed("d", "own")
        listed = F.explode(F.slice("own", F.lit(1), F.size("own") - F.col("bound") + 1))
        lists = cut(near.select("family", listed.alias("e"), "node", "salt", "component"))
        same = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"same{i}") for i in range(2)]
        kinds = lists.groupBy("family", "e").agg(F.count("*").alias("members"), F.min("component").alias("low"), F.max("component").alias("high"), *same)
        kinds = kinds.where("low <> high").groupBy("family", "members", "same0", "same1").agg(F.min("e").alias("e"))
        kinds = cut(kinds.select("family", "e", "members"))

        # 3. pairs of short lists, and long lists as families
        few = lists.join(_spread(kinds.where(F.col("members") <= short).select("family", "e")), ["family", "e", "salt"]).select("family", "e", "node")
        several = few.groupBy("family", "node").agg(F.collect_set("e").alias("values"))
        few = few.join(several, ["family", "node"]).join(near.select("family", "node", "component", "g", "own"), ["family", "node"])
        left, right = (few.select("family", "e", *(F.col(c).alias(c + side) for c in ("node", "component", "g", "own", "values"))) for side in ("_a", "_b"))
        # a pair is made in the first of its lists only, if what it shares is enough
        once = F.col("e") == F.array_min(F.array_intersect("values_a", "values_b"))
        enough = F.size(F.array_intersect("own_a", "own_b")) * (2 * p) >= F.col("g_a") + F.col("g_b")
        pairs = left.join(right, ["family", "e"]).where("node_a < node_b and component_a <> component_b").where(once & enough)
        last = _one_each(pairs.select(F.col("node_a").alias("a"), "component_a", F.col("node_b").alias("b"), "component_b"))
        found = found.union(direct).union(last)
        longer = lists.join(_spread(kinds.where(F.col("members") > short).select("family", "e")), ["family", "e", "salt"])
        families = cut(longer.select(F.xxhash64("family", "e").alias("family"), "node", "component"))
        for done in (centers, apart, near, heads, *spent, lists, kinds):
            drop_cut(done)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def block_heads(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect each list of (``value``, ``node``, ``times``): a block of about ``BLOCK`` nodes has a head, and blocks of heads likewise.

    No node thus meets more than about ``BLOCK`` others of a list, however long it is.
    """
    most = lists.agg(F.max("times")).first()[0] or 0
    members, stars = lists.select("value", "node", "block"), None
    while True:
        heads = members.groupBy("value", "block").agg(F.min("node").alias("a"))
        pairs = members.join(heads, ["value", "block"]).where("node <> a").select("a", F.col("node").alias("b"))
        stars = pairs if stars is None else stars.union(pairs)
        most = math.ceil(most / BLOCK)
        if most <= 1:
            return stars.distinct()
        members = heads.select("value", F.col("a").alias("node"), F.floor(F.col("block") / BLOCK).alias("block"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """(key, ``n_shingles``, ``component_id``, ``kept``) of every row of ``docs``.

    ``component_id`` is the least key that links of similarity ``percent`` / 100 lead
    to; ``kept`` marks the row that has it.
    """
    share = least_share(k, percent)
    whole = named(docs, text).cast("string")
    sketch = F.arrow_udf(lambda texts: by_slices(texts, lambda part: _sketches(part, n, k), SET), SET_DDL)
    pack = F.arrow_udf(lambda texts: by_slices(texts, lambda part: _packed(part, n), pa.binary()), "binary")
    verify = F.arrow_udf(lambda a, b: similar(a, b, percent), "boolean")

    # 1. sketches of all documents, classes of equal sets
    rows = cut(small_batches(docs).select(named(docs, key).alias("id"), sketch(whole).alias("x")).select("id", "x.n", "x.s1", "x.s2", "x.sketch"))
    classes = cut(rows.where("n > 0 and id is not null").groupBy("s1", "s2").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))

    # 2. inverted lists of the rarest values
    values = classes.select("node", "n", F.size("sketch").alias("size"), F.explode("sketch").alias("value"))
    shared = values.groupBy("value").agg(F.count("*").alias("times")).where("times > 1")
    own = values.join(shared, "value").groupBy("node", "n", "size").agg(F.sort_array(F.collect_list(F.struct("times", "value"))).alias("own"))
    needed = F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("size")).cast("int"))
    # the values of one class only come first in the order, and are in no list
    listed = F.slice("own", F.lit(1), F.greatest(F.size("own") - needed + 1, F.lit(0)))
    block = F.pmod(F.xxhash64("node"), F.ceil(F.col("times") / BLOCK)).alias("block")
    lists = cut(own.where(F.size("own") >= needed).select("node", F.explode(listed).alias("x")).select("node", "x.value", "x.times").select("*", block))

    # full sets of the classes that are in a list
    asked = lists.select("node").distinct()
    full = docs.select(named(docs, key).alias("id"), whole.alias("_text")).join(asked.withColumnRenamed("node", "id").hint("shuffle_hash"), "id")
    full = cut(full.select(F.col("id").alias("node"), pack("_text").alias("set")))
    known = classes.join(asked, "node", "left_semi").select("node", "n", "sketch")

    def with_sketches(pairs: DataFrame) -> DataFrame:
        left, right = (known.select(*(F.col(c).alias(c + side) for c in known.columns)) for side in ("_a", "_b"))
        return pairs.join(left, F.col("a") == F.col("node_a")).join(right, F.col("b") == F.col("node_b"))

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that exact Jaccard confirms."""
        first = pairs.select("a", "b").join(full.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
        both = first.join(full.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
        return both.where(verify("set_a", "set_b")).select("a", "b")

    condition = likely(F.col("sketch_a"), F.col("sketch_b"), F.col("n_a"), F.col("n_b"), k, percent, share)

    # 3. the members of a list against the head of their block
    stars = cut(block_heads(lists))
    links = cut(linked(with_sketches(stars).where(condition)).distinct())
    found = cut(components(links))

    # 4. pairs of a list in different components: short lists directly, long ones by differences from a center
    placed = cut(lists.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")))
    short = placed.where(F.col("times") <= SHORT)
    mixed = short.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    short = short.join(mixed.select("value"), "value", "left_semi")
    several = short.groupBy("node").agg(F.collect_set("value").alias("values"))
    few = cut(short.join(several, "node").select("value", "node", "component", "values"))
    short = few.join(known, "node")
    left, right = (short.select("value", *(F.col(c).alias(c + side) for c in ("node", "component", "n", "sketch", "values"))) for side in ("_a", "_b"))
    # a pair is made in the first of its lists only
    once = F.col("value") == F.array_min(F.array_intersect("values_a", "values_b"))
    pairs = left.join(right, "value").where("node_a < node_b and component_a <> component_b").where(once & condition)
    pairs = pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))

    # a family has the lists with the same largest component, which those of a group of copies mostly share
    long = placed.where(F.col("times") > SHORT)
    roots = long.groupBy("value", "times", "component").agg(F.count("*").alias("size")).groupBy("value", "times").agg(F.max(F.struct("size", "component")).alias("_m"), F.count("*").alias("parts"))
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("times") / BLOCK) - 1))
    roots = roots.where("parts > 1").select("value", F.xxhash64("_m.component").alias("family"), blocks.alias("block"))
    families = cut(long.join(roots, ["value", "block"]).select("family", "node", "component").distinct())
    pairs = pairs.union(by_difference(families, full, percent, SHORT)).distinct()
    pairs = cut(pairs.join(stars, ["a", "b"], "left_anti"))
    more = linked(pairs)
    # the components so far are the nodes that the new links connect
    ends = ((side, found.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))) for side in ("a", "b"))
    for side, of in ends:
        more = more.join(of, side, "left").withColumn(side, F.coalesce(f"of_{side}", side)).drop(f"of_{side}")
    merged = cut(components(more))
    top = _spread(merged.select(F.col("node").alias("component"), F.col("component").alias("top")))
    renamed = found.withColumn("salt", _salt()).join(top, ["component", "salt"], "left").select("node", F.coalesce("top", "component").alias("component"))
    every = cut(renamed.union(merged.join(found, "node", "left_anti")))
    for done in (lists, full, stars, links, found, placed, families, few, pairs, merged):
        drop_cut(done)

    # components of all rows
    named_classes = classes.select("s1", "s2", "node").join(every, "node", "left").select("s1", "s2", F.coalesce("component", "node").alias("component"))
    done = rows.drop("sketch").join(named_classes, ["s1", "s2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return done.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id").isNull() | (F.col("id") == component)).alias("kept"))
