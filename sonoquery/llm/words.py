"""Vectorised text primitives that the Arrow-based operators share.

Everything here works on whole Arrow arrays: a text batch is cut into
slices of bounded bytes, words are dictionary-encoded, and per-word work is
done once for each distinct word of a slice.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are held as words at a time in a Python worker.
SLICE_BYTES = 2 << 20

_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive slices of at most ``limit`` bytes, or of a single text."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(size)
    at = 0
    while at < len(texts):
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield texts.slice(at, end - at)
        at = end


def by_slices(texts: pa.Array, work: Callable[[pa.Array], pa.Array], empty: pa.DataType, limit: int = SLICE_BYTES) -> pa.Array:
    """``work`` on each slice (nulls read as empty texts), put together."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    done = [work(pc.fill_null(part, "")) for part in slices(texts, limit)]
    out = pa.concat_arrays(done) if done else pa.array([], empty)
    trim()
    return out


def trim() -> None:
    """Give free memory back: a worker lives on between stages, and its executor counts it."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if give_back:
        give_back(0)


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text: number of the text, word."""
    lists = pc.ascii_split_whitespace(texts)
    count = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(lists)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), count)
    full = pc.greater(pc.binary_length(flat), 0)
    return doc[full.to_numpy(zero_copy_only=False)], flat.filter(full)


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Code of every word and the distinct words in the order of the codes."""
    if not len(words):
        return np.zeros(0, np.int64), words
    d = words.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def hash_strings(strings: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes, the same in every process."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(s.encode("utf-8", "surrogatepass"), seed) for s in strings.to_pylist()), np.uint64, len(strings))


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finalizer of 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _S33)) * _M1
        h = (h ^ (h >> _S33)) * _M2
        return h ^ (h >> _S33)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive hashes of all runs of ``n`` values (len - n + 1 of them)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = mix(h[: len(h) - n + 1] + _STEP)
        for i in range(1, n):
            out = mix(out + h[i : len(h) - n + 1 + i] * _M2 + _STEP)
    return out


def starts(doc: np.ndarray, n_texts: int) -> np.ndarray:
    """Offsets of each text's words in ``doc`` (n_texts + 1 of them)."""
    return np.searchsorted(doc, np.arange(n_texts + 1))
