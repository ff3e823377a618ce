"""Ranked lexical search over a clustered index whose order comes from recursive graph bisection.

Order.  On a bounded sample of documents the graph of documents and terms is bisected again and again so that the logarithms
of gaps between the documents of a term get small; pairs of documents that gain by it change sides. Every split
keeps for its terms what a posting costs more on the left than on the right, and by the sum over its terms *every* document
goes down the splits: its leaf and the last sum are its place in the new order.

Index.  Documents of a leaf that follow one another make a shard of at most ``SHARD`` documents: one row with an inverted index
(sorted term hashes, postings), the document ids in the new order, and for each term the document count, the largest frequency
and the least ratio of length to frequency.  These give an upper bound of every document's score in the shard.

Search.  For each item the shards of highest bound are searched first; their results give a score that the best documents
reach at least.  Then all shards whose bound reaches it are visited, each task raising its own limit as it finds better
documents, and all others are skipped: what is skipped cannot hold a result, so the ranking is exact.
Places in the new order are mapped back to document ids before ties are decided.

How it is dealt: texts are read once (and for the sample), documents are shuffled once to their shards; large leaves are dealt to several
groups by a hash.  Items are taken in blocks of ``ITEMS``, of which terms, weights and limits are sent to the tasks; each task
gives the best documents of its shards only.

Scores are integers: ``sum of w * ((1000000000 * tf) div (1000 * tf + 20 * m))`` over an item's distinct terms, with ``w = floor(1000 *
ln((2 * N + 2) / (2 * df + 1)))`` and ``m = 50 + (50 * n * N) div L``.

Defined results: documents without a term (null or empty texts) aren't counted and are no results, items without a term have none.
Terms are told apart by 64-bit hashes: that a term of the items meets another one of the corpus by chance is as likely as (terms
asked * terms of the corpus) / 2^64. Repeated rows and ids are documents of their own, null ids come last among ties; so do repeated
items, which have the same results each.  Texts are taken whole; further columns are dropped, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .frames import cut, named, small_batches
from .license_scan import folded
from .words import SLICE_BYTES, coded, hash_strings, slices, trim, words_of

#: Documents and terms that the order is fitted on, at most, and the depth of the splits.
SAMPLE, SAMPLE_TERMS, DEPTH = 2048, 1 << 14, 6
#: Documents and postings of a shard, at most (a document isn't divided).
SHARD, SHARD_POSTINGS = 256, 1 << 18
#: Documents of a leaf that are dealt out as one group, about.
GROUP = 2048
#: Items that are searched at a time, and the shards of each that are searched first.
ITEMS, FIRST = 1000, 2


def postings(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, texts, n, text of each posting, term hash, tf) of slices of texts; postings are in the order of texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    at = 0
    for part in slices(texts, SLICE_BYTES):
        doc, flat = words_of(folded(part.fill_null("")))
        codes, distinct = coded(flat)
        many = max(1, len(distinct))
        pair, tf = np.unique(doc * many + codes, return_counts=True)
        of = pair // many
        yield at, len(part), np.bincount(doc, minlength=len(part)), of, hash_strings(distinct)[pair % many], tf
        at += len(part)


# --- the order --------------------------------------------------------------------------


def _gain(d_from: np.ndarray, n_from: int, d_to: np.ndarray, n_to: int) -> np.ndarray:
    """What a term's gaps get shorter if one document that has it changes sides."""
    cost = lambda d, n: d * (math.log2(n) - np.log2(d + 1.0))
    return cost(d_from, n_from) + cost(d_to, n_to) - cost(np.maximum(d_from - 1, 0), n_from) - cost(d_to + 1, n_to)


def _halves(docs: np.ndarray, of: np.ndarray, term: np.ndarray, n_docs: int, n_terms: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """``docs`` in two halves of least cost."""
    half = len(docs) // 2
    side = np.full(n_docs, -1)
    side[docs[:half]], side[docs[half:]] = 0, 1
    here = side[of] >= 0
    of, term = of[here], term[here]
    for _ in range(rounds):
        left = side[of] == 0
        d_l, d_r = np.bincount(term[left], minlength=n_terms), np.bincount(term[~left], minlength=n_terms)
        to_r, to_l = _gain(d_l, half, d_r, len(docs) - half), _gain(d_r, len(docs) - half, d_l, half)
        gain = np.bincount(of, np.where(left, to_r[term], to_l[term]), n_docs)
        a, b = docs[side[docs] == 0], docs[side[docs] == 1]
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        n = min(len(a), len(b))
        moved = int(np.argmin(np.append(gain[a[:n]] + gain[b[:n]] > 0, False)))
        if not moved:
            break
        side[a[:moved]], side[b[:moved]] = 1, 0
    return docs[side[docs] == 0], docs[side[docs] == 1]


class Order:
    """The splits: for each, what a posting of a term costs more on its left."""

    def __init__(self, of: np.ndarray, hashes: np.ndarray, n_docs: int):
        known, term = np.unique(hashes, return_inverse=True)
        df = np.bincount(term, minlength=len(known))
        chosen = np.sort(np.argsort(-df, kind="stable")[:SAMPLE_TERMS])
        chosen = chosen[df[chosen] > 1]
        number = np.full(len(known), -1)
        number[chosen] = np.arange(len(chosen))
        self.terms = known[chosen]
        keep = number[term] >= 0
        of, term = of[keep], number[term[keep]]
        self.cost = np.zeros((max(1, 2**DEPTH - 1), max(1, len(chosen))), np.float32)
        nodes = [np.arange(n_docs)]
        for node in range(2**DEPTH - 1):
            docs = nodes[node]
            a, b = _halves(docs, of, term, n_docs, len(chosen)) if len(docs) > 1 else (docs, docs[:0])
            nodes += [a, b]
            if len(a) and len(b):
                inside = np.zeros(n_docs, np.int8)
                inside[a], inside[b] = 1, 2
                d = [np.bincount(term[inside[of] == s], minlength=len(chosen)) for s in (1, 2)]
                self.cost[node] = (math.log2(len(a)) - np.log2(d[0] + 1.0)) - (math.log2(len(b)) - np.log2(d[1] + 1.0))

    def places(self, of: np.ndarray, hashes: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, last sum) of documents."""
        node, last = np.zeros(n_docs, np.int64), np.zeros(n_docs)
        if len(self.terms):
            at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
            keep = self.terms[at] == hashes
            of, at = of[keep], at[keep]
            for _ in range(DEPTH):
                last = np.bincount(of, self.cost[node[of], at], n_docs)
                node = 2 * node + 1 + (last > 0)
        else:
            node += 2**DEPTH - 1
        return node - (2**DEPTH - 1), last


# --- the index --------------------------------------------------------------------------


def _shard(ids: list, ns: list[int], terms: list[np.ndarray], tfs: list[np.ndarray]) -> tuple:
    n, hashes, tf = np.array(ns, np.int64), np.concatenate(terms), np.concatenate(tfs).astype(np.int64)
    doc = np.repeat(np.arange(len(ids)), [len(t) for t in terms])
    by = np.argsort(hashes, kind="stable")
    hashes, tf, doc = hashes[by], tf[by], doc[by]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    ratio = np.nextafter((n[doc] / tf).astype(np.float32), np.float32(0))
    raw = (hashes[first].astype("<u8"), np.diff(np.append(first, len(hashes))).astype("<u4"), np.maximum.reduceat(tf, first).astype("<u4"), np.minimum.reduceat(ratio, first).astype("<f4"), n.astype("<u4"), doc.astype("<u2"), tf.astype("<u4"))
    return (len(ids), int(n.sum()), *(x.tobytes() for x in raw), ids)


_PARTS = ("terms", "dfs", "most", "ratio", "lengths", "docs", "tfs")


def build(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of ``docs``: a row for each shard, written to the shared folder."""
    docs = small_batches(docs).select(named(docs, id).alias("id"), named(docs, text).cast("string").alias("text"))
    total = docs.count()

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, count, _, of, hashes, _ in postings(batch.column("text")):
                cuts = np.searchsorted(of, np.arange(count + 1))
                yield pa.record_batch([pa.array([hashes[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], ["terms"])

    sample = docs.select("text").sample(min(1.0, SAMPLE / max(1, total)), seed=11).limit(SAMPLE).mapInArrow(terms_of, "terms binary").collect()
    sets = [np.frombuffer(r["terms"], np.uint64) for r in sample]
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = Order(of, np.concatenate([*sets, np.zeros(0, np.uint64)]), len(sets))
    leaf, _ = order.places(of, np.concatenate([*sets, np.zeros(0, np.uint64)]), len(sets))
    share = np.bincount(leaf, minlength=2**DEPTH) / max(1, len(sets))
    groups = np.maximum(1, np.ceil(share * total / GROUP)).astype(np.int64)
    id_type = docs.schema["id"].dataType
    id_kind = to_arrow_type(id_type)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for at, count, n, of, hashes, tf in postings(batch.column("text")):
                leaf, last = order.places(of, hashes, count)
                cuts = np.searchsorted(of, np.arange(count + 1))
                salt = (np.array([hashes[a:b].sum() if b > a else 0 for a, b in zip(cuts, cuts[1:])], np.uint64) + np.arange(count, dtype=np.uint64)) % groups[leaf].astype(np.uint64)
                full = np.flatnonzero(n)
                tf = tf.astype("<u4")
                yield pa.record_batch(
                    [ids.slice(at, count).take(pa.array(full)), pa.array(n[full]), pa.array((leaf * (1 << 32) + salt.astype(np.int64))[full]), pa.array(last[full]), pa.array([hashes[cuts[i] : cuts[i + 1]].tobytes() for i in full], pa.binary()), pa.array([tf[cuts[i] : cuts[i + 1]].tobytes() for i in full], pa.binary())],
                    ["id", "n", "part", "place", "terms", "tfs"],
                )
            trim()

    rows = docs.mapInArrow(placed, T.StructType([T.StructField("id", id_type), *(T.StructField(c, k) for c, k in (("n", T.LongType()), ("part", T.LongType()), ("place", T.DoubleType()), ("terms", T.BinaryType()), ("tfs", T.BinaryType())))]))
    rows = rows.repartition("part").sortWithinPartitions("part", "place")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, many, held, number = None, 0, ([], [], [], []), 0

        def closed() -> pa.RecordBatch:
            row = _shard(*held)
            kinds = [pa.int64()] * 4 + [pa.binary()] * len(_PARTS) + [pa.list_(id_kind)]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((part, number, *row), kinds)], names=["part", "number", "n_docs", "n_terms", *_PARTS, "ids"])

        for batch in batches:
            for i, own, n, terms, tfs in zip(*(batch.column(c).to_pylist() for c in ("id", "part", "n", "terms", "tfs"))):
                if held[0] and (own != part or len(held[0]) >= SHARD or many + len(terms) // 8 > SHARD_POSTINGS):
                    yield closed()
                    number, many, held = number + 1 if own == part else 0, 0, ([], [], [], [])
                elif own != part:
                    number = 0
                part = own
                many += len(terms) // 8
                for list_, value in zip(held, (i, n, np.frombuffer(terms, "<u8"), np.frombuffer(tfs, "<u4"))):
                    list_.append(value)
        if held[0]:
            yield closed()

    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in ("part", "number", "n_docs", "n_terms")), *(T.StructField(c, T.BinaryType()) for c in _PARTS), T.StructField("ids", T.ArrayType(id_type))])
    return cut(rows.mapInArrow(shards, schema), row_group=16 << 20)


# --- the search -------------------------------------------------------------------------


class _Asked:
    """A block of items: their distinct terms, and each one's places among all terms asked."""

    def __init__(self, texts: list[str | None], k: int):
        doc, hashes = [], []
        for at, _, _, of, h, _ in postings(pa.array(texts, pa.string())):
            doc.append(of + at)
            hashes.append(h)
        self.k, self.n = k, len(texts)
        of = np.concatenate([*doc, np.zeros(0, np.int64)])
        self.terms, self.term = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]), return_inverse=True)
        self.starts = np.searchsorted(of, np.arange(self.n + 1))
        self.df = np.zeros(len(self.terms), np.int64)
        self.weight = np.zeros(len(self.terms), np.int64)
        self.documents = self.words = 0

    def weigh(self, df: dict[int, int], documents: int, words: int) -> None:
        self.documents, self.words = documents, words
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(self.terms))], np.int64)

    def met(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(asked term, its place in the shard) of those that the shard holds."""
        at = np.minimum(np.searchsorted(terms, self.terms), len(terms) - 1)
        own = np.flatnonzero(terms[at] == self.terms)
        return own, at[own]

    def bounds(self, terms: np.ndarray, most: np.ndarray, ratio: np.ndarray) -> np.ndarray:
        """What no score of the shard exceeds, for each item."""
        own, at = self.met(terms)
        best = np.zeros(len(self.terms) + 1)
        over = 49.0 / most[at] + 50.0 * self.documents / self.words * ratio[at].astype(np.float64)
        best[own] = self.weight[own] * (1e9 / (1000.0 + 20.0 * over))
        total = np.add.reduceat(np.append(best[self.term], 0.0), self.starts)[: self.n]
        return np.where(np.diff(self.starts) > 0, total * (1 + 1e-9) + 1e-3, 0.0)

    def scores(self, items: np.ndarray, terms: np.ndarray, dfs: np.ndarray, lengths: np.ndarray, docs: np.ndarray, tfs: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item, score of every document of the shard)."""
        own, at = self.met(terms)
        row = np.full(len(self.terms), -1)
        row[own] = np.arange(len(own))
        ends = np.cumsum(dfs.astype(np.int64))
        count = dfs[at].astype(np.int64)
        of = np.repeat(np.arange(len(own)), count)
        place = np.repeat(ends[at] - count, count) + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        doc, tf = docs[place], tfs[place].astype(np.int64)
        norm = np.array([50 + 50 * int(n) * self.documents // self.words for n in lengths], np.int64)
        value = np.zeros((len(own), len(lengths)), np.int64)
        value[of, doc] = self.weight[own][of] * (1_000_000_000 * tf // (1000 * tf + 20 * norm[doc]))
        for item in items:
            rows = row[self.term[self.starts[item] : self.starts[item + 1]]]
            yield item, value[rows[rows >= 0]].sum(0)


def _unpacked(row: dict, *parts: str) -> list[np.ndarray]:
    kinds = dict(zip(_PARTS, ("<u8", "<u4", "<u4", "<f4", "<u4", "<u2", "<u4")))
    return [np.frombuffer(row[p], kinds[p]) for p in parts]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(len(batch)):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


class _Best:
    """The k best (score, id) of each item."""

    def __init__(self, k: int, limits: np.ndarray):
        self.k, self.limits, self.found = k, limits.copy(), {}

    def add(self, item: int, scores: np.ndarray, ids: list) -> None:
        at = np.flatnonzero(scores >= max(1, self.limits[item]))
        if len(at) > self.k:
            least = np.partition(scores[at], len(at) - self.k)[len(at) - self.k]
            at = at[scores[at] >= least]
        if len(at):
            have = self.found.setdefault(item, [])
            have += [(int(scores[i]), ids[i]) for i in at]
            have.sort(key=lambda x: (-x[0], x[1] is None, x[1]))
            del have[self.k :]
            if len(have) == self.k:
                self.limits[item] = max(self.limits[item], have[-1][0])


def _search(index: DataFrame, asked: _Asked, totals: tuple[int, int]) -> DataFrame:
    """(item, doc, score) of the best documents of each item, more than k where several tasks found some."""
    spark = index.sparkSession

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(asked.terms), np.int64)
        for row in _rows(batches):
            terms, dfs = _unpacked(row, "terms", "dfs")
            own, at = asked.met(terms)
            df[own] += dfs[at]
        held = np.flatnonzero(df)
        yield pa.record_batch([pa.array(held), pa.array(df[held])], ["term", "df"])

    df = {r["term"]: r["df"] for r in index.select("terms", "dfs").mapInArrow(counted, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    asked.weigh(df, *totals)

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        for row in _rows(batches):
            for item, bound in enumerate(asked.bounds(*_unpacked(row, "terms", "most", "ratio")).tolist()):
                have = best.setdefault(item, [])
                if bound > 0 and (len(have) < FIRST or bound > have[-1][0]):
                    have.append((bound, row["part"], row["number"]))
                    have.sort(reverse=True)
                    del have[FIRST:]
        flat = [(item, *x) for item, have in best.items() for x in have]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*flat) if flat else ((),) * 4, (pa.int64(), pa.float64(), pa.int64(), pa.int64()))], names=["item", "bound", "part", "number"])

    tops = index.select("part", "number", "terms", "most", "ratio").mapInArrow(highest, "item bigint, bound double, part bigint, number bigint")
    ranked = tops.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "part", "number"))).where(F.col("r") <= FIRST)
    first: dict[tuple[int, int], set[int]] = {}
    for r in ranked.collect():
        first.setdefault((r["part"], r["number"]), set()).add(r["item"])

    def visit(limits: np.ndarray, only_first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(asked.k, limits)
            for row in _rows(batches):
                before = first.get((row["part"], row["number"]), set())
                if only_first:
                    items = np.array(sorted(before), np.int64)
                else:
                    bounds = asked.bounds(*_unpacked(row, "terms", "most", "ratio"))
                    items = np.array([i for i in np.flatnonzero((bounds > 0) & (bounds >= best.limits)).tolist() if i not in before], np.int64)
                if len(items):
                    for item, scores in asked.scores(items, *_unpacked(row, "terms", "dfs", "lengths", "docs", "tfs")):
                        best.add(int(item), scores, row["ids"])
            flat = [(item, *x) for item, have in best.found.items() for x in have]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], k) for i, k in ((0, pa.int64()), (2, id_kind), (1, pa.int64()))], names=["item", "doc", "score"])
            trim()

        return run

    id_type = index.schema["ids"].dataType.elementType
    id_kind = to_arrow_type(id_type)
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("doc", id_type), T.StructField("score", T.LongType())])
    nothing = np.zeros(asked.n, np.int64)
    if not first:
        return spark.createDataFrame([], schema)
    keys = spark.createDataFrame(sorted(first), "part bigint, number bigint")  # at most FIRST for each item of the block
    seeds = index.where(F.col("part").isin(sorted({p for p, _ in first}))).join(F.broadcast(keys), ["part", "number"], "left_semi")
    early = cut(seeds.mapInArrow(visit(nothing, True), schema))
    ranked = early.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc")))).where(F.col("r") == asked.k)
    limits = nothing.copy()
    for r in ranked.select("item", "score").collect():
        limits[r["item"]] = r["score"]
    return early.unionByName(index.mapInArrow(visit(limits, False), schema))


def search(index: DataFrame, items: DataFrame, id: str = "item_id", text: str = "text", k: int = 50) -> DataFrame:
    """(``id``, rank, doc_id, score) of the ``k`` best documents of :func:`build`'s ``index`` for each row of ``items``."""
    spark = index.sparkSession
    totals = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("l")).first()
    rows = items.select(named(items, id).alias("id"), named(items, text).cast("string").alias("text"))
    id_type, out, block = rows.schema["id"].dataType, None, []

    def taken(block: list) -> DataFrame:
        found = _search(index, _Asked([r["text"] for r in block], k), (totals["n"], totals["l"]))
        ids = spark.createDataFrame([(i, r["id"]) for i, r in enumerate(block)], T.StructType([T.StructField("item", T.LongType()), T.StructField("name", id_type)]))
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc")))).where(F.col("rank") <= k)
        return ranked.join(F.broadcast(ids), "item").select(F.col("name").alias(id), F.col("rank").cast("int"), F.col("doc").alias("doc_id"), "score")

    for row in rows.toLocalIterator():
        block.append(row)
        if len(block) == ITEMS:
            found, block = taken(block), []
            out = found if out is None else out.unionByName(found)
    if block or out is None:
        found = taken(block)
        out = found if out is None else out.unionByName(found)
    return out
