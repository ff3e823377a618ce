"""License scans: diagonal voting of word k-grams.

Method.  The hashes of all rolling ``K``-word grams of every text are exploded
and joined by Spark to the positions of equal grams in the templates.  A hit
votes for a diagonal (its position in the text minus that in the template).
Votes are added up for each text, template and diagonal; diagonals at most
``NEAR`` apart are merged, which bridges inserted and missing words; what has
votes enough is verified on the words.  Merged diagonals may chain a good match with what stands around it (a
repeated tail, say), so the stretch of at most length / ``COVER`` words that holds most of the template's grams is taken,
then what is left before and behind it likewise.  The longest common subsequence of the stretch and the
template must cover ``COVER`` of the template, and as large a part of the words
between the stretch's first hit and its last, so words that are strewn over a text are no match.

The templates are constants of the operator, so their table (about a thousand
rows) is broadcast.  Rows are told apart by their key and a hash of the text.
Only hits are grouped, and the texts meet their spans by a shuffled hash join
whose build side is the spans.

Defined results: a null text counts as empty: no words, no places, no labels,
score 0.  Rows that repeat (key and text) get the same result each.  An empty
table gives an empty result.  Null keys are keys like others.  Texts are taken whole,
one at a time in a Python worker beyond a slice's size, and verified in time that grows
with the span.  Columns of the input may have any name; the struct's name gets
underscores until it is free.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import free_name, plain, restored, small_batches
from .license_texts import PHRASES, TEMPLATES
from .words import by_slices, coded, grams, hash_strings, starts, words_of

K = 3
NEAR = 3
VOTES = 0.4
COVER = 0.8

SCAN = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("grams", pa.list_(pa.int64()))])
SCAN_DDL = "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,grams:array<bigint>>"
SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("similarity", pa.float64())]))
SPANS_DDL = "array<struct<label:string,start:bigint,end:bigint,similarity:double>>"

#: Each byte of a text as it counts here: letters in lower case, what separates words as a space.
_BYTES = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)], np.uint8)


def folded(texts: pa.Array) -> pa.Array:
    """Texts with A-Z in lower case and a space for each character that isn't of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``."""
    texts = pa.concat_arrays([texts.cast(pa.large_string())])  # with offsets from 0
    _, offsets, data = texts.buffers()
    if data is None:
        return texts
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, pa.py_buffer(_BYTES[np.frombuffer(data, np.uint8)])], offset=texts.offset)


def words(text: str) -> list[str]:
    return folded(pa.array([text]))[0].as_py().split()


def _scan(texts: pa.Array, phrases: Sequence[tuple[str, str]], k: int) -> pa.Array:
    n = len(texts)
    doc, flat = words_of(folded(texts))
    codes, distinct = coded(flat)
    bounds = starts(doc, n)
    labels: list[set[str]] = [set() for _ in range(n)]
    found: list[np.ndarray] = []
    for phrase, label in phrases:
        parts = [pc.index(distinct, pa.scalar(w, distinct.type)).as_py() for w in phrase.split(" ")]
        m = len(doc) - len(parts) + 1
        if min(parts) < 0 or m <= 0:
            continue
        at = np.flatnonzero(reduce(np.logical_and, [codes[i : i + m] == c for i, c in enumerate(parts)]) & (doc[:m] == doc[len(parts) - 1 :]))
        found.append(at)
        for d in np.unique(doc[at]).tolist():
            labels[d].add(label)
    places = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    of = doc[places]
    n_base = np.bincount(of, minlength=n)
    has = n_base > 0
    first, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
    first[of[::-1]] = (places - bounds[of])[::-1]
    last[of] = places - bounds[of]
    # grams of neighbouring texts are cut off: each text has (words - k + 1) of its own; none with k = 0
    all_grams = grams(hash_strings(distinct)[codes] if k and len(codes) else np.zeros(0, np.uint64), max(k, 1)).view(np.int64)
    inside = doc[: len(all_grams)] == doc[k - 1 : k - 1 + len(all_grams)] if len(all_grams) else np.zeros(0, bool)
    ends = np.concatenate([[0], np.cumsum(np.bincount(doc[: len(all_grams)][inside], minlength=n))]).astype(np.int32)
    out = [
        pa.array(np.diff(bounds).astype(np.int64)),
        pa.array(n_base.astype(np.int64)),
        pa.array(first, mask=~has),
        pa.array(last, mask=~has),
        pa.array([",".join(sorted(x)) for x in labels], pa.string()),
        pa.ListArray.from_arrays(pa.array(ends), pa.array(all_grams[inside])),
    ]
    return pa.StructArray.from_arrays(out, fields=list(SCAN))


def template_grams(templates: Sequence[tuple[str, str]], k: int = K) -> list[tuple[int, int, int]]:
    """(hash, template, position) of all grams of the templates."""
    rows = []
    for t, (_, text) in enumerate(templates):
        h = hash_strings(pa.array(words(text), pa.string()))
        rows += [(int(g), t, i) for i, g in enumerate(grams(h, k).view(np.int64))]
    return rows


def common(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of the longest common subsequence, a word of ``a`` at a time in the bits of an integer for ``b``."""
    places: dict[str, int] = {}
    for i, word in enumerate(b):
        places[word] = places.get(word, 0) | 1 << i
    full = (1 << len(b)) - 1
    free = full
    for word in a:
        if at := places.get(word, 0) & free:
            free = (free + at | free - at) & full
    return len(b) - free.bit_count()


def _best(hits: list[tuple[int, int]], k: int, limit: float) -> tuple[int, int, int]:
    """(different grams, first, last) of the stretch of at most ``limit`` words that holds most grams of the template; of several the shortest, then the first."""
    held: dict[int, int] = {}
    best, left = (0, 0, 0, -1), 0
    for right, (pos, at) in enumerate(hits):
        held[at] = held.get(at, 0) + 1
        while pos + k - hits[left][0] > limit or held[hits[left][1]] > 1:
            gone = hits[left][1]
            held[gone] -= 1
            if not held[gone]:
                del held[gone]
            left += 1
        best = max(best, (len(held), hits[left][0] - pos, -left, right))
    return best[0], -best[2], best[3]


def _windows(own: Sequence[str], start: int, end: int, wanted: Sequence[str], k: int, votes: float, cover: float) -> list[tuple[int, int]]:
    """Stretches of ``own[start:end]``, as places of the first and behind the last word, that hold ``votes`` of a template's grams or more."""
    grams_at: dict[tuple[str, ...], list[int]] = {}
    for i in range(max(1, len(wanted) - k + 1)):
        grams_at.setdefault(tuple(wanted[i : i + k]), []).append(i)
    hits = [(pos, at) for pos in range(start, end - k + 1) for at in grams_at.get(tuple(own[pos : pos + k]), ())]
    found, open_ = [], [hits]
    while open_:  # what stands before and behind a stretch may hold others
        part = open_.pop()
        if len(part) < votes:
            continue
        many, first, last = _best(part, k, len(wanted) / cover)
        if many >= votes:
            # words at the ends that are in no gram belong to it too, as far as the template has them
            found.append((max(start, part[first][0] - part[first][1], part[last][0] + k - int(len(wanted) / cover)), part[first][0], part[last][0] + k, min(end, part[last][0] - part[last][1] + len(wanted))))
            open_ += [part[last + 1 :], part[:first]]
    return sorted((lo, since, until, hi) for lo, since, until, hi in found)


def _verified(text: str | None, spans: list[dict], templates: Sequence[tuple[str, str]], cover: float, k: int = K, votes: float = VOTES) -> list[dict]:
    """Of every chain of diagonals, the stretches in which the template is verified: their words, and as large a part of them, must be the template's."""
    own, out = words(text or ""), []
    ranges: list[list[int]] = []
    for s in sorted(spans, key=lambda s: (s["template"], s["start"])):
        low, high = max(0, s["start"]), min(len(own), s["end"])
        if ranges and ranges[-1][0] == s["template"] and low < ranges[-1][2]:  # chains of one template may overlap
            ranges[-1][2] = max(ranges[-1][2], high)
        else:
            ranges.append([s["template"], low, high])
    for template, low, high in ranges:
        label, wanted = templates[template][0], words(templates[template][1])
        for start, since, until, end in _windows(own, low, high, wanted, k, votes * max(1, len(wanted) - k + 1), cover):
            shared = common(own[start:end], wanted)
            similarity = shared / len(wanted)
            if similarity >= cover and shared >= cover * (until - since):
                out.append({"label": label, "start": start, "end": end, "similarity": similarity})
    return out


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, k: int = K, out: str = "license") -> DataFrame:
    """``docs`` with a struct ``out``: ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``spans`` and ``score``.

    ``spans`` holds the verified (label, start, end, similarity) in words;
    ``score`` is 1 where a phrase stands, else the best similarity of a span, else 0.
    """
    spark, names = small_batches(docs).sparkSession, docs.columns
    docs, (text, key) = plain(docs, text, key)
    templates = list(templates)

    def work(k: int):
        return F.arrow_udf(lambda texts: by_slices(texts, lambda part: _scan(part, phrases, k), SCAN), SCAN_DDL)(as_text)

    as_text = F.col(text).cast("string")
    ids = [F.xxhash64(F.col(key), as_text).alias("_a"), F.hash(as_text, F.col(key)).alias("_b")]

    size = {t: max(1, len(words(x)) - k + 1) for t, (_, x) in enumerate(templates)}
    known = spark.createDataFrame(template_grams(templates, k), "gram bigint, template int, at int")
    long = spark.createDataFrame([(t, size[t], len(words(x))) for t, (_, x) in enumerate(templates)], "template int, size int, length int")
    hits = docs.select(*ids, F.posexplode(work(k)["grams"]).alias("pos", "gram")).join(F.broadcast(known), "gram")
    votes = hits.groupBy("_a", "_b", "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"))
    order = Window.partitionBy("_a", "_b", "template").orderBy("diagonal")
    votes = votes.withColumn("_new", (F.col("diagonal") - F.lag("diagonal", 1, -(1 << 30)).over(order) > NEAR).cast("int"))
    votes = votes.withColumn("_group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = votes.groupBy("_a", "_b", "template", "_group").agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("votes"))
    merged = merged.join(F.broadcast(long), "template").where(F.col("votes") >= F.lit(VOTES) * F.col("size"))
    span = F.struct("template", F.col("low").cast("long").alias("start"), (F.col("high") + F.col("length")).cast("long").alias("end"))
    spans = merged.groupBy("_a", "_b").agg(F.sort_array(F.collect_list(span)).alias("_spans"))

    def check(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([_verified(t, s, templates, COVER, k) for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], SPANS)

    asked = docs.select(*ids, as_text.alias("_text")).join(spans.hint("shuffle_hash"), ["_a", "_b"])
    verified = asked.select("_a", "_b", F.arrow_udf(check, SPANS_DDL)("_text", "_spans").alias("_found")).groupBy("_a", "_b").agg(F.first("_found").alias("_found"))

    result = docs.select("*", *ids, work(0).alias("_base")).join(verified, ["_a", "_b"], "left")
    found = F.coalesce("_found", F.expr(f"cast(array() as {SPANS_DDL})"))
    b = lambda c: F.col("_base")[c]
    labels = F.array_sort(F.array_distinct(F.concat(F.filter(F.split(b("base_labels"), ","), lambda x: x != ""), F.transform(found, lambda s: s["label"]))))
    score = F.when(b("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform(found, lambda s: s["similarity"])), F.lit(0.0)))
    fields = [b(c).alias(c) for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")]
    return restored(result, names, F.struct(*fields, F.array_join(labels, ",").alias("labels"), found.alias("spans"), F.least(score, F.lit(1.0)).alias("score")).alias(free_name(names, out)))
