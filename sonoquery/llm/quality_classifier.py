"""Quality classifier: Bradley-Terry pairwise ranking.

Method.  A document's score is ``w . x`` over features of its whole text.  ``w``
is learned from preference pairs (a row labelled 1 is preferred to a row
labelled 0) by the logistic loss on feature differences, so that
``sigmoid(w . (x_a - x_b))`` is the chance that ``a`` is the better one.  Scores
are put on 0 to 1 by a logistic curve fitted on the same rows, and documents can
be thresholded at a quantile of the scores of all documents.

Only the fit uses a sample: at most ``MAX_LABELLED`` labelled ids, the ones
with the smallest hash, and one text for each (of an id that is repeated, the one of smallest hash); the ids are
broadcast and the feature vectors (``4 * DIMENSIONS`` bytes each) come to the driver, about 14 MB.

Defined results: a null text counts as empty, and empty texts get the score of
their (zero) features.  Labels with a null id or quality are left out; an id
with contradicting labels counts as 0.  Without rows of both labels every score
is 0.5.  Equal texts have equal scores; an empty table gives an empty result.
Texts of any length are read whole, beyond a slice's size one at a time.  Columns of the input may have any name; that of
the score gets underscores until it is free.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import free_name, named, small_batches
from .quality_rules import _cells, _dup_lines, _repeat_words
from .words import by_slices, coded, words_of

CELLS = 256
DENSE = 16
DIMENSIONS = CELLS + DENSE
MAX_LABELLED = 12_000
PAIRS = 60_000
RIDGE = 1e-3
CLIP = 4.0


def features(texts: pa.Array) -> np.ndarray:
    """A row of ``DIMENSIONS`` numbers for each text: shares of kinds of words and hashed n-grams."""
    n = len(texts)
    doc, words = words_of(texts)
    codes, distinct = coded(words)
    n_words = np.bincount(doc, minlength=n)
    per = 1.0 / (n_words + 3.0)  # short texts are drawn towards zero

    def total(of_distinct) -> np.ndarray:
        values = np.asarray(of_distinct.to_numpy(zero_copy_only=False), np.float64)
        return np.bincount(doc, weights=values[codes] if len(codes) else None, minlength=n).astype(np.float64)

    def chars(pattern: str):
        return pc.count_substring_regex(distinct, pattern)

    has = pc.match_substring_regex
    size = len(distinct) + 1
    keys, times = np.unique(doc * size + codes, return_counts=True)
    most = np.zeros(n)
    np.maximum.at(most, keys // size, times)
    twice = np.flatnonzero((doc[1:] == doc[:-1]) & (codes[1:] == codes[:-1])) if len(doc) > 1 else np.zeros(0, np.int64)
    lines = pc.add(pc.count_substring(texts, "\n"), 1).to_numpy(zero_copy_only=False)
    dense = [
        np.log1p(n_words),
        total(pc.utf8_length(distinct)) * per,
        total(chars(r"[#*$%&|<>]")) * per,
        total(has(distinct, r"[#*$%&<>]")) * per,
        total(has(distinct, r"^[#*$%&|<>!?=+~^_-]+$")) * per,
        total(has(distinct, r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]+$")) * per,
        total(has(distinct, r"[!?]{2}")) * per,
        total(has(distinct, r"[.,;:]$")) * per,
        total(chars(r"\p{Nd}")) * per,
        np.bincount(keys // size, minlength=n) * per,
        np.maximum(most - 1, 0) * per,
        np.bincount(doc[twice], minlength=n) * per,
        _repeat_words(doc, codes, n) * per,
        _dup_lines(texts) / (lines + 3.0),
        np.log1p(n_words / lines),
        total(has(distinct, r"^\p{Lu}\p{Ll}")) * per,
    ]
    of, cells = _cells(doc, codes, distinct, CELLS)
    hashed = np.bincount(of * CELLS + cells, minlength=n * CELLS).reshape(n, CELLS)
    hashed = hashed / (hashed.sum(1, keepdims=True) + 50.0)
    return np.column_stack([*dense, hashed]).astype(np.float32)


@dataclass(frozen=True)
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -CLIP, CLIP)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * (self.scaled(x) @ self.weights) + self.offset, -40, 40)))


def learn(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, steps: int = 400, seed: int = 0) -> Ranker:
    """Weights from preference pairs, then the curve that puts scores on 0 to 1."""
    x = np.asarray(x, np.float64).reshape(len(y), DIMENSIONS)
    d = DIMENSIONS
    better, worse = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(better) or not len(worse):
        return Ranker(np.zeros(d), np.ones(d), np.zeros(d), 1.0, 0.0)
    ranker = Ranker(x.mean(0), x.std(0) + 1e-3, np.zeros(d), 1.0, 0.0)
    z = ranker.scaled(x)
    rng = np.random.default_rng(seed)
    a, b = rng.choice(better, pairs), rng.choice(worse, pairs)
    w, m, v = np.zeros(d), np.zeros(d), np.zeros(d)
    for t in range(1, steps + 1):
        part = rng.integers(0, pairs, 2048)
        diff = z[a[part]] - z[b[part]]
        g = -(diff * (1.0 / (1.0 + np.exp(np.clip(diff @ w, -40, 40))))[:, None]).mean(0) + RIDGE * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    s = z @ w
    slope, offset = 1.0, -float(np.median(s))
    for _ in range(50):  # Newton's steps, damped by a small ridge
        p = 1.0 / (1.0 + np.exp(-np.clip(slope * s + offset, -40, 40)))
        r, q = p - y, p * (1 - p) + 1e-6
        h = np.array([[(q * s * s).sum() + 1.0, (q * s).sum()], [(q * s).sum(), q.sum() + 1.0]])
        step = np.linalg.solve(h, [(r * s).sum() + (slope - 1.0), r.sum()])
        slope, offset = slope - float(np.clip(step[0], -1, 1)), offset - float(np.clip(step[1], -2, 2))
    return Ranker(ranker.mean, ranker.scale, w, slope, offset)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", limit: int = MAX_LABELLED) -> Ranker:
    """Learn from a bounded sample of the labelled rows (see the module)."""
    rows = labels.select(named(labels, key).alias("_id"), named(labels, label).cast("int").alias("_y")).where("_id is not null and _y is not null")
    rows = rows.groupBy("_id").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(limit)

    def work(texts: pa.Array) -> pa.Array:
        return by_slices(texts, lambda part: pa.array([r.tobytes() for r in features(part)], pa.binary()), pa.binary())

    chosen = small_batches(docs).select(named(docs, key).alias("_id"), named(docs, text).cast("string").alias("_text")).join(F.broadcast(rows), "_id")
    # one text for each id, so that ids which most rows repeat don't bring more to the driver
    chosen = chosen.groupBy("_id").agg(F.first("_y").alias("_y"), F.min_by("_text", F.struct(F.xxhash64("_text"), "_text")).alias("_text"))
    got = chosen.select("_id", "_y", F.arrow_udf(work, "binary")("_text").alias("_x")).toArrow().sort_by([("_id", "ascending")])
    x = np.frombuffer(b"".join(got["_x"].to_pylist()), np.float32).reshape(-1, DIMENSIONS)
    return learn(x, got["_y"].to_numpy())


def score(docs: DataFrame, ranker: Ranker, text: str = "text", out: str = "score") -> DataFrame:
    def work(texts: pa.Array) -> pa.Array:
        return by_slices(texts, lambda part: pa.array(ranker.score(features(part))), pa.float64())

    return small_batches(docs).withColumn(free_name(docs, out), F.arrow_udf(work, "double")(named(docs, text).cast("string")))


def at_quantile(scored: DataFrame, share: float, column: str = "score", out: str = "kept") -> DataFrame:
    """``scored`` with a flag of the rows above the quantile ``share`` of all scores."""
    cut = scored.approxQuantile(column, [share], 0.001)
    return scored.withColumn(free_name(scored, out), named(scored, column) >= F.lit(cut[0] if cut else 0.0))


def held_out(key: Column) -> Column:
    """Rows that are never learned from: the CRC-32 of the id as text is divisible by 5 (false for a null id)."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))
