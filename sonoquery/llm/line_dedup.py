"""Line dedup by content-defined chunks of lines, and by passages.

Method.  Lines (cut at ``\\n``) are hashed, and a line whose hash is divisible by
``DIVISOR`` ends a segment; segments are cut into chunks of ``MIN_LINES`` lines
(a shorter rest joins the chunk before it).  A boundary thus depends on the lines
since the last marked one, and cuts line up again behind the next marked line.
Chunks whose hash stands once in the corpus stay.  Those of the others are
grouped by their bytes, which settles hash collisions; of equal ones, the first
by (id, position) stays and the rest are removed with their line ends.

Limits of chunks: of a passage that is shared by texts which differ around it,
only chunks that lie wholly inside in both texts go, so a short one often
stays (figures in the README).  ``passages`` has no such limit: every window of
``MIN_LINES`` lines with a word (and the blank lines between) that stands before
goes as well, so of a shared run of that many lines nothing stays but its first
copy.  Windows overlap; of every line at least the first occurrence stays.  A
passage of one line with a word is not found by either.

Only chunks of at least ``MIN_LINES`` lines with a word can be removed.  Chunk and window
hashes are written once as narrow rows; the count of a frequent hash is combined
before the shuffle, and so is the choice of the first of equal chunks, so a
chunk that a third of all documents share lands in no single task.  The texts
are shuffled by row to meet their repeated chunks.

Defined results: a null text stays null and has 0 lines; an empty one stays
empty.  A document that loses all its chunks has an empty text.  Rows with the same id and
text count as one document and get the same result; null ids come before others.
An empty table gives an empty result.  Texts are taken whole, one at a time in a
Python worker beyond a slice's size.  Columns of the input may have any name; the
struct's name gets underscores until it is free.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut, free_name, plain, restored, small_batches, spread
from .words import by_slices, coded, grams, hash_strings, mix, slices, trim

DIVISOR = 3
MIN_LINES = 2
#: Tasks that the rows of one hash are dealt to, at least.
SALTS = 8


def _parsed(texts: pa.Array) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
    """Lines of each text; of all lines, the hashes and whether they have a word; the first line of each text, and the end."""
    lists = pc.split_pattern(texts, "\n")
    count = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    codes, distinct = coded(pc.list_flatten(lists))
    worded = pc.match_substring_regex(distinct, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)[codes]
    return lists.to_pylist(), hash_strings(distinct)[codes], worded, np.concatenate([[0], np.cumsum(count)])


def _edges(marks: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a text, from the marks of its lines."""
    n, segments, cuts = len(marks), [0], []
    for c in (np.flatnonzero(marks) + 1).tolist():
        if c - segments[-1] >= MIN_LINES:
            segments.append(c)
    if n - segments[-1] >= MIN_LINES or len(segments) == 1:
        segments.append(n)
    else:
        segments[-1] = n
    for start, end in zip(segments, segments[1:], strict=False):
        cuts += [*range(start + MIN_LINES, end - MIN_LINES + 1, MIN_LINES), end]
    return np.array(cuts)


def _chunks(h: np.ndarray, worded: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    marks = mix(h) % np.uint64(DIVISOR) == 0
    ends, hashes, free = [], [], []
    for start, end in zip(starts.tolist(), starts[1:].tolist(), strict=False):
        edge = _edges(marks[start:end])
        first = np.concatenate([[0], edge[:-1]])
        with np.errstate(over="ignore"):
            place = np.arange(end - start) - np.repeat(first, edge - first)
            part = mix(h[start:end] + mix(place.astype(np.uint64) + np.uint64(1)))
            hashes.append(mix(np.add.reduceat(part, first)).view(np.int64))
        ends.append(edge)
        free.append(np.add.reduceat(worded[start:end].astype(np.int64), first) >= MIN_LINES)
    return ends, hashes, free


def _windows(h: np.ndarray, worded: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each text: (first line, end) of every run of ``MIN_LINES`` lines with a word, blank ones between, and the hashes."""
    at = np.flatnonzero(worded)
    of = np.searchsorted(starts, at, side="right") - 1
    back = MIN_LINES - 1
    own = np.flatnonzero(of[back:] == of[: len(of) - back])
    spans = np.stack([at[own], at[own + back] + 1], axis=1) - starts[of[own]][:, None]
    hashes = mix(grams(h[at], MIN_LINES)[own]).view(np.int64)
    places = np.searchsorted(of[own], np.arange(1, len(starts) - 1))
    return np.split(spans, places), np.split(hashes, places)


def chunks(texts: pa.Array) -> tuple[list[list[str]], list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Of each text: its lines, the ends of its chunks, their hashes, and whether they may be removed."""
    lines, *parsed = _parsed(texts)
    return (lines, *_chunks(*parsed))


def _spans(texts: pa.Array, passages: bool) -> tuple[list[list[str]], list[np.ndarray], list[int]]:
    """Of each text: its lines, (first line, end) of its chunks and then of its windows, and the number of chunks."""
    lines, *parsed = _parsed(texts)
    ends, _, _ = _chunks(*parsed)
    spans = [np.stack([np.concatenate([[0], e[:-1]]), e], axis=1) for e in ends]
    if passages:
        spans = [np.concatenate(x) for x in zip(spans, _windows(*parsed)[0], strict=True)]
    return lines, spans, list(map(len, ends))


def _hashes(texts: pa.Array, passages: bool) -> pa.Array:
    _, *parsed = _parsed(texts)
    _, hashes, free = _chunks(*parsed)
    if passages:
        windows = _windows(*parsed)[1]
        hashes = [np.concatenate(x) for x in zip(hashes, windows, strict=True)]
        free = [np.concatenate([f, np.ones(len(w), bool)]) for f, w in zip(free, windows, strict=True)]
    return pa.array([pa.array(h, mask=~f) for h, f in zip(hashes, free, strict=True)], pa.list_(pa.int64()))


def _bytes(texts: pa.Array, numbers: pa.Array, passages: bool) -> pa.Array:
    """The text of each of the chunks and windows ``numbers``."""
    out, at = [], 0
    wanted = numbers.to_pylist()
    for part in slices(texts):
        for own, spans, n_chunks in zip(*_spans(pc.fill_null(part, ""), passages), strict=True):
            out.append([{"n": n, "window": n >= n_chunks, "chunk": "\n".join(own[slice(*spans[n])])} for n in wanted[at] or []])
            at += 1
    trim()
    return pa.array(out, pa.list_(pa.struct([("n", pa.int32()), ("window", pa.bool_()), ("chunk", pa.string())])))


def _without(texts: pa.Array, repeated: pa.Array, firsts: pa.Array, passages: bool) -> pa.Array:
    out, at = [], 0
    repeated, firsts = repeated.to_pylist(), firsts.to_pylist()
    for part in slices(texts):
        for text, own, spans, n_chunks in zip(part.to_pylist(), *_spans(pc.fill_null(part, ""), passages), strict=True):
            gone = sorted(set(repeated[at] or ()) - set(firsts[at] or ()))
            at += 1
            n = 0 if text is None else len(own)
            row = {"text": text, "n_lines": n, "n_removed": 0, "unrepeated": text, "n_repeated": 0}
            drop = np.zeros(len(own), bool)
            for numbers, rest, dropped in (([k for k in gone if k < n_chunks], "text", "n_removed"), ([k for k in gone if k >= n_chunks], "unrepeated", "n_repeated")):
                for k in numbers:
                    drop[slice(*spans[k])] = True
                if drop.any():
                    row |= {rest: "\n".join([x for x, d in zip(own, drop.tolist(), strict=True) if not d]), dropped: int(drop.sum())}
            out.append(row)
    trim()
    fields = [("text", pa.string()), ("n_lines", pa.int64()), ("n_removed", pa.int64())]
    return pa.array(out, pa.struct(fields + [("unrepeated", pa.string()), ("n_repeated", pa.int64())] * passages))


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", out: str = "lines", passages: bool = False) -> DataFrame:
    """``docs`` with a struct ``out``: ``text`` without repeated chunks, ``n_lines`` before and ``n_removed``.

    With ``passages``, the struct also has ``unrepeated``, the text without repeated chunks
    and windows, and ``n_repeated``, the lines that this lacks.
    """
    names = docs.columns
    rows, (text, key) = plain(small_batches(docs), text, key)
    whole = F.col(text).cast("string")
    hashes = F.arrow_udf(lambda texts: by_slices(texts, lambda part: _hashes(part, passages), pa.list_(pa.int64())), "array<bigint>")
    rows = rows.withColumns({"_a": F.xxhash64(F.col(key), whole), "_b": F.hash(whole, F.col(key))})

    marks = cut(rows.select("_a", "_b", F.posexplode(hashes(whole)).alias("_n", "_hash")).where("_hash is not null"))
    # the rows of a frequent hash are dealt to several tasks
    again = marks.groupBy("_hash").agg(F.count("*").alias("_times")).where("_times > 1").select("_hash")
    marks = marks.withColumn("_salt", F.pmod(F.col("_b") + F.col("_n"), F.lit(SALTS)))
    repeated = marks.join(spread(again, SALTS, "_salt"), ["_hash", "_salt"], "left_semi").groupBy("_a", "_b").agg(F.sort_array(F.collect_set("_n")).alias("_repeated"))
    met = rows.join(repeated.hint("shuffle_hash"), ["_a", "_b"], "left")

    read = F.arrow_udf(lambda texts, numbers: _bytes(texts, numbers, passages), "array<struct<n:int,window:boolean,chunk:string>>")
    found = met.where("_repeated is not null").select("_a", "_b", F.col(key).alias("_key"), F.explode(read(whole, "_repeated")).alias("_x"))
    first = found.groupBy(F.col("_x.window").alias("_window"), F.col("_x.chunk").alias("_chunk")).agg(F.min(F.struct("_key", "_a", "_b", "_x.n")).alias("_first"))
    firsts = first.groupBy(F.col("_first._a").alias("_a"), F.col("_first._b").alias("_b")).agg(F.collect_set("_first.n").alias("_firsts"))
    done = met.join(firsts.hint("shuffle_hash"), ["_a", "_b"], "left")
    more = ",unrepeated:string,n_repeated:bigint" if passages else ""
    write = F.arrow_udf(lambda texts, again, first: _without(texts, again, first, passages), f"struct<text:string,n_lines:bigint,n_removed:bigint{more}>")
    return restored(done, names, write(whole, "_repeated", "_firsts").alias(free_name(names, out)))
