"""Quality rules: rule metrics and a hashed n-gram log-likelihood ratio.

Method.  Word and punctuation unigrams and bigrams are hashed into
``buckets`` cells.  One pass counts the cells over *all* documents (raw
multinomial) and over *all* documents that the labels mark as trusted (target
multinomial).  A document's score is the mean over its n-grams of
``log(p_target / p_raw)``; it is kept when the score is at least ``threshold``
and the base rules pass.  The target is smoothed towards the raw multinomial
(``prior`` times its mass), so a cell without evidence pulls by a bounded
amount and an empty target (no labels) gives a score of 0 everywhere.

Defined results: a null text counts as empty; without words the score is 0 and
the base rules reject (fewer than ``MIN_WORDS`` words).  Repeated rows get equal
verdicts, as a verdict depends on the text alone; repeated or null ids in the
labels add nothing (labels are reduced to distinct trusted ids, null ids
dropped).  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import free_name, named, small_batches
from .words import by_slices, coded, grams, hash_strings, mix, slices, trim, words_of

BUCKETS = 1 << 15
PRIOR = 0.1
#: Occurrences that every cell is credited with in both multinomials.
EVIDENCE = 2.0
THRESHOLD = -0.25
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5

METRICS = pa.struct([(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("llr", pa.float64())])
METRICS_DDL = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,llr:double>"

_PIECES = re.compile(r"\w+|[^\w\s]+")


def _cells(doc: np.ndarray, codes: np.ndarray, distinct: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and cell of every unigram and bigram of the lower-cased word and punctuation runs."""
    pieces = [_PIECES.findall(w) or [w] for w in pc.utf8_lower(distinct).to_pylist()]
    count = np.fromiter(map(len, pieces), np.int64, len(pieces))
    h = hash_strings(pa.array([p for ps in pieces for p in ps], pa.string()))
    first = np.cumsum(count) - count
    n = count[codes]
    of = np.repeat(doc, n)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    stream = h[np.repeat(first[codes], n) + inside]
    two = grams(stream, 2)[of[:-1] == of[1:]] if len(of) > 1 else np.zeros(0, np.uint64)
    docs2 = of[:-1][of[:-1] == of[1:]] if len(of) > 1 else np.zeros(0, np.int64)
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    return np.concatenate([of, docs2]), (np.concatenate([mix(stream), two]) >> shift).astype(np.int64)


def _repeat_words(doc: np.ndarray, codes: np.ndarray, n_texts: int, n: int = REPEAT_WINDOW) -> np.ndarray:
    """Words of each text that lie in an n-word window found at least twice in it."""
    if len(doc) < n:
        return np.zeros(n_texts, np.int64)
    at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
    g = grams(mix(codes.astype(np.uint64)), n)[at]
    with np.errstate(over="ignore"):
        g = mix(g + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(g, kind="stable")
    same = g[order][1:] == g[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(doc) + 1, np.int64)
    np.add.at(covered, at[again], 1)
    np.add.at(covered, at[again] + n, -1)
    return np.bincount(doc[np.cumsum(covered[:-1]) > 0], minlength=n_texts)


def _dup_lines(texts: pa.Array) -> np.ndarray:
    """Lines with a word that equal an earlier line of the text."""
    lists = pc.split_pattern(texts, "\n")
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    codes, distinct = coded(pc.list_flatten(lists))
    worded = pc.match_substring_regex(distinct, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)[codes]
    doc, codes = doc[worded], codes[worded]
    own = np.unique(doc * (len(distinct) + 1) + codes) // (len(distinct) + 1)
    return np.bincount(doc, minlength=len(texts)) - np.bincount(own, minlength=len(texts))


def _metrics(texts: pa.Array, weights: np.ndarray) -> pa.Array:
    n = len(texts)
    doc, words = words_of(texts)
    codes, distinct = coded(words)
    of, cells = _cells(doc, codes, distinct, len(weights))
    total = np.bincount(of, minlength=n)
    llr = np.bincount(of, weights=weights[cells], minlength=n) / np.maximum(total, 1)
    length = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    out = [
        np.bincount(doc, minlength=n),
        np.bincount(doc, weights=length[codes] if len(codes) else None, minlength=n).astype(np.int64),
        pc.count_substring_regex(texts, r"[#*$%&|<>]").to_numpy(zero_copy_only=False).astype(np.int64),
        _dup_lines(texts),
        _repeat_words(doc, codes, n),
    ]
    return pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in out] + [pa.array(llr)], fields=list(METRICS))


def _counting(buckets: int):
    """Each task adds up its documents' cells and gives one row for each cell that it met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            trusted, done = batch.column(1).to_numpy(zero_copy_only=False).astype(bool), 0
            for texts in slices(batch.column(0)):
                doc, words = words_of(pc.fill_null(texts, ""))
                of, cells = _cells(doc, *coded(words), buckets)
                raw += np.bincount(cells, minlength=buckets)
                target += np.bincount(cells[trusted[done : done + len(texts)][of]], minlength=buckets)
                done += len(texts)
            trim()
        met = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(raw[met]), pa.array(target[met])], names=["cell", "raw", "target"])

    return count


def fit(docs: DataFrame, trusted_ids: DataFrame, text: str = "text", key: str = "doc_id", buckets: int = BUCKETS, prior: float = PRIOR) -> np.ndarray:
    """Log-likelihood ratio of every cell, from all documents.

    ``trusted_ids`` has one column ``key``.  The labels are the build side of a
    shuffled hash join: neither side is broadcast or sorted.  What comes to the
    driver is ``buckets`` rows at most, whatever the input.
    """
    ids = trusted_ids.select(named(trusted_ids, key).alias("_id")).where("_id is not null").distinct().withColumn("_trusted", F.lit(True))
    rows = small_batches(docs).select(named(docs, text).cast("string").alias("_text"), named(docs, key).alias("_id"))
    rows = rows.join(ids.hint("shuffle_hash"), "_id", "left").select("_text", F.coalesce("_trusted", F.lit(False)).alias("_trusted"))
    counts = rows.mapInArrow(_counting(buckets), "cell bigint, raw bigint, target bigint").groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for cell, r, t in counts.collect():
        raw[cell], target[cell] = r, t
    expected = raw * (target.sum() / max(1.0, raw.sum()))
    return np.log((target + prior * expected + EVIDENCE) / ((1 + prior) * expected + EVIDENCE))


def metrics(docs: DataFrame, weights: np.ndarray, text: str = "text", out: str = "quality") -> DataFrame:
    """``docs`` with a struct of the metrics, in a column named ``out`` (underscores are appended if that is taken)."""

    def work(texts: pa.Array) -> pa.Array:
        return by_slices(texts, lambda part: _metrics(part, weights), METRICS)

    return small_batches(docs).withColumn(free_name(docs, out), F.arrow_udf(work, METRICS_DDL)(named(docs, text).cast("string")))


def verdicts(docs: DataFrame, weights: np.ndarray, text: str = "text", threshold: float = THRESHOLD, out: str = "quality") -> DataFrame:
    """:func:`metrics` and, in the struct, ``base_failed`` and ``kept``."""
    at = free_name(docs, out)
    scored = metrics(docs, weights, text, at)
    q = lambda c: F.col(at)[c]
    failed = (q("n_words") < MIN_WORDS) | (q("n_repeat_words") * 100 > q("n_words") * MAX_REPEAT_PERCENT)
    return scored.withColumn(at, F.col(at).withField("base_failed", failed).withField("kept", ~failed & (q("llr") >= threshold)))


def trusted(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select("doc_id")
