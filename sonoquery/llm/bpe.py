"""BPE encoding and decoding by a pair occurrence index.

Method.  The distinct words of a slice of a partition are cut into pieces and
written as one sequence of base symbols.  An index maps every mergeable pair to
all its positions in that sequence.  Ranks that occur are taken in ascending
order; all positions of the rank's pair are merged from left to right, and the
lists of the pairs that vanish or arise at the neighbours are brought up to
date.  Words are then put together to texts by their codes, so a word that
occurs a million times in a slice is merged once.

The model file (``tokenizers`` JSON: NFC, white space, lower case; pieces by a
pattern; byte-level symbols; an end-of-word suffix; no decoder) is read on the
driver and travels as a broadcast of bounded size, a few MB.  It must hold each
merged symbol once, which makes every merge rank higher than those of its parts.

Defined results: a null text counts as empty; an empty text gives no ids and an
empty decoded text.  Special tokens in a text get their own ids, as in the
library.  Repeated rows get equal results; an empty table gives an empty one.
Texts are encoded whole, whatever their length.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from .frames import free_name, named, small_batches
from .words import coded, slices, starts, trim, words_of

RESULT = pa.struct([("ids", pa.binary()), ("decoded", pa.string())])
#: Lists of at least so many positions are merged by array operations.
MANY = 24


# Letters and numbers of Unicode versions that the tokenizers library doesn't know yet, and takes for symbols.
UNKNOWN = """
558 58B-58C 88F C5C CDC 1C89 208F 209D-209F A7CB-A7CC A7CE-A7CF A7D2 A7D4 A7DA A7DC-A7DD A7E2 A7F1 AB6C-AB6D
107BB-107BF 10940-10959 10D50-10D65 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F
12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191
191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2
1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD
"""
#: Lower case of letters that an older Python doesn't know.
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


def classes(pattern: str) -> str:
    """``pattern`` with the library's classes, whatever Unicode version the installed ``regex`` has."""
    unknown = "".join("-".join(f"\\U{int(c, 16):08X}" for c in r.split("-")) for r in UNKNOWN.split())
    for kind in "LN":
        pattern = pattern.replace(rf"[\p{{{kind}}}]", rf"\p{{{kind}}}").replace(rf"\p{{{kind}}}", rf"[\p{{{kind}}}--[{unknown}]]")
    return "(?V1)" + pattern.replace(r"\s", r"\p{White_Space}")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


@dataclass(frozen=True)
class Model:
    """What the executors need of a tokenizer file."""

    inner: np.ndarray  # id of each byte inside a piece
    final: np.ndarray  # id of each byte at the end of a piece
    pairs: np.ndarray  # left * size + right, ascending
    ranks: np.ndarray  # of pairs
    merged: np.ndarray  # by rank
    size: int
    tokens: tuple[str, ...]
    pattern: str
    special: tuple[tuple[str, int], ...]
    name: str  # digest of the file

    @classmethod
    def read(cls, path: str) -> Model:
        with open(path, "rb") as file:
            data = file.read()
        spec = json.loads(data)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *special.values()]) + 1
        tokens = [""] * size
        for token, i in (vocab | special).items():
            tokens[i] = token
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        pairs = np.array([vocab[a] * size + vocab[b] for a, b in merges], np.int64)
        merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        if len(set(merged.tolist())) != len(merged):
            raise ValueError("a symbol is the result of two merges")
        order = np.argsort(pairs)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        symbols = byte_symbols()
        return cls(np.array([vocab[c] for c in symbols]), np.array([vocab[c + suffix] for c in symbols]), pairs[order], order, merged, size, tuple(tokens), pattern, tuple(special.items()), xxhash.xxh3_128_hexdigest(data))


class Encoder:
    """Encodes lists of distinct words; one for each Python worker."""

    def __init__(self, model: Model) -> None:
        self.model = model
        # the classes differ beyond ASCII only, and take longer
        self.ascii, self.other = (regex.compile(p).findall for p in (model.pattern.replace(r"\s", r"\p{White_Space}"), classes(model.pattern)))
        self.special = dict(model.special)
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")").split if self.special else None
        self.rank = dict(zip(model.pairs.tolist(), model.ranks.tolist(), strict=True))
        self.merged = model.merged.tolist()
        self.lefts, self.rights = ([0] * len(model.merged) for _ in range(2))
        for key, r in self.rank.items():
            self.lefts[r], self.rights[r] = divmod(key, model.size)
        self.tokens = np.array([t.encode() for t in model.tokens], object)

    def pieces(self, text: str) -> list[str]:
        return (self.ascii if text.isascii() else self.other)(text)

    def normal(self, word: str) -> str:
        if word.isascii():
            return word.lower()
        return "".join(c.lower() for c in unicodedata.normalize("NFC", word).translate(LOWER))

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and the number of ids of each word."""
        pieces: list[bytes] = []
        n_pieces = np.zeros(len(words), np.int64)
        fixed: dict[int, int] = {}
        for i, word in enumerate(words):
            before = len(pieces)
            if self.cut and "<|" in word or self.cut and any(t in word for t in self.special if "<|" not in t):
                for part in self.cut(word):
                    if part in self.special:
                        fixed[len(pieces)] = self.special[part]
                        pieces.append(b"\0")
                    elif part:
                        pieces += [p.encode("utf-8", "replace") for p in self.pieces(self.normal(part))]
            else:
                pieces += [p.encode("utf-8", "replace") for p in self.pieces(self.normal(word))]
            n_pieces[i] = len(pieces) - before
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids, n_ids = self._merge(np.frombuffer(b"".join(pieces), np.uint8), size)
        if fixed:
            at = np.cumsum(n_ids) - n_ids
            for k, i in fixed.items():
                ids[at[k]] = i
        ends = np.cumsum(np.concatenate([[0], n_ids]))
        last = np.cumsum(n_pieces)
        return ids, ends[last] - ends[last - n_pieces]

    def _merge(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged ids of the pieces, and how many each has."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(size), np.int64)
        m = self.model
        symbols = m.inner[data]
        end = np.cumsum(size) - 1
        symbols[end] = m.final[data[end]]
        whole = np.ones(n, bool)  # has a right neighbour in the piece
        whole[end] = False
        after = np.where(whole, np.arange(1, n + 1, dtype=np.int32), np.int32(-1))
        inside = np.ones(n, bool)
        inside[end - size + 1] = False
        before = np.where(inside, np.arange(-1, n - 1, dtype=np.int32), np.int32(-1))
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(places: np.ndarray, keys: np.ndarray) -> None:
            """Put positions on the lists of the ranks of their pairs."""
            found = np.minimum(np.searchsorted(m.pairs, keys), len(m.pairs) - 1)
            hit = m.pairs[found] == keys
            ranks, places = m.ranks[found[hit]], places[hit]
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ranks)], strict=True):
                if at < to:
                    r = int(ranks[at])
                    if r not in index:
                        index[r] = []
                        heapq.heappush(heap, r)
                    index[r].append(places[at:to])

        left = np.flatnonzero(whole)
        note(left, symbols[left] * m.size + symbols[left + 1])
        while heap:
            r = heapq.heappop(heap)
            places = np.unique(np.concatenate(index.pop(r)))
            new, a, b = self.merged[r], self.lefts[r], self.rights[r]
            if a == b or len(places) < MANY:
                done = []
                for p in places.tolist():
                    q = after[p]
                    if symbols[p] != a or q < 0 or symbols[q] != b:
                        continue  # the pair was merged away by a neighbour
                    symbols[p], symbols[q] = new, -1
                    after[p] = s = after[q]
                    if s >= 0:
                        before[s] = p
                    done.append(p)
                places = np.array(done, np.int64)
            else:  # two occurrences of a pair of different symbols can't overlap
                places = places[symbols[places] == a]
                q = after[places]
                hit = (q >= 0) & (symbols[q] == b)
                places, q = places[hit], q[hit]
                symbols[places], symbols[q] = new, -1
                after[places] = s = after[q]
                before[s[s >= 0]] = places[s >= 0]
            s, o = after[places], before[places]
            right, behind = s >= 0, o[o >= 0]
            at = np.concatenate([places[right], behind])
            if len(at):
                note(at, np.concatenate([new * m.size + symbols[s[right]], symbols[behind] * m.size + symbols[after[behind]]]))
        kept = symbols >= 0
        return symbols[kept], np.add.reduceat(kept.astype(np.int64), end - size + 1)

    def decode(self, ids: np.ndarray) -> bytes:
        return b" ".join(self.tokens[ids].tolist())

    def texts(self, texts: pa.Array) -> pa.Array:
        doc, words = words_of(texts)
        codes, distinct = coded(words)
        flat, count = self.encode(distinct.to_pylist())
        first = np.cumsum(count) - count
        n = count[codes]
        stream = flat.astype("<u4")[np.repeat(first[codes] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        ends = np.concatenate([[0], np.cumsum(n)])[starts(doc, len(texts))]
        parts = [stream[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        decoded = pa.array([self.decode(p) for p in parts], pa.binary()).cast(pa.string())
        return pa.StructArray.from_arrays([pa.array([p.tobytes() for p in parts], pa.binary()), decoded], fields=list(RESULT))


_encoders: dict[str, Encoder] = {}


def _encoder(model: Model) -> Encoder:
    """The worker's encoder for a model (one at a time is kept)."""
    if model.name not in _encoders:
        _encoders.clear()
        _encoders[model.name] = Encoder(model)
    return _encoders[model.name]


def round_trip(docs: DataFrame, model: Model, text: str = "text", out: str = "bpe", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with a struct ``out``: ``ids`` (packed little-endian unsigned 32-bit integers) and ``decoded``, the text of these ids.

    Results leave a Python worker slice by slice, so what it holds at a time is a
    batch of texts and a slice's ids, not the ids of a batch.
    """
    kept = docs.columns if keep is None else keep
    at, source = free_name(kept, out), free_name(kept, "_text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        for batch in batches:
            done = 0
            for part in slices(batch.column(len(kept))):
                rows = batch.slice(done, len(part))
                done += len(part)
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], encoder.texts(pc.fill_null(part, ""))], names=[*kept, at])
            trim()

    rows = small_batches(docs).select(*[named(docs, c) for c in kept], named(docs, text).cast("string").alias(source))
    schema = StructType([*(docs.schema[c] for c in kept), StructField(at, StructType([StructField("ids", BinaryType()), StructField("decoded", StringType())]))])
    return rows.mapInArrow(work, schema)


def decode(docs: DataFrame, model: Model, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of the packed ``ids``; null ids give an empty text."""

    def work(packed: pa.Array) -> pa.Array:
        encoder = _encoder(model)
        return pa.array([encoder.decode(np.frombuffer(x or b"", "<u4")) for x in packed.to_pylist()], pa.binary()).cast(pa.string())

    return small_batches(docs).withColumn(free_name(docs, out), F.arrow_udf(work, "string")(named(docs, ids)))


def unpacked(ids):
    """Column with the packed ids as ``array<int>``."""

    def work(packed: pa.Array) -> pa.Array:
        return pa.array([None if x is None else np.frombuffer(x, "<u4").astype(np.int32) for x in packed.to_pylist()], pa.list_(pa.int32()))

    return F.arrow_udf(work, "array<int>")(ids)
