"""Repair of conversation structure at least cost, with the least audit.

A repaired conversation's role initials read ``(s?(ua)+)?``.  Edits of a row are Keep (0),
Rerole to user or assistant (2) and Delete (3, the only one for blank rows and duplicates);
Insert (2) puts an empty user or assistant turn anywhere; a truncated row that stays costs 1 more.

The search runs in cost layers: for every turn, from the last to the first, one integer holds
for each cost, in ascending order, the bits of the grammar's states from which the rest can be finished at that cost.
An edit shifts bits by its cost and maps them by its letter.  Of the layers only a band above
the least is kept, which is enough (see ``LAYERS``), so work and memory are linear in turns; transitions are few and are remembered.
The first layer that holds the start at the first turn is the cost.  The trace then goes forward with the set of states that share the
letters so far, and takes the least letter that stays on a cheapest way.

How it is dealt: rows are shuffled by conversation twice and read as sorted streams, first narrow ones (role
initial, faults, a digest of role and text), then texts together with the audits.  Neither pass holds texts of more than a
batch; the first holds a digest and a few bytes for each row of the conversation at hand.  A conversation is read by one task, as a digest of
its repaired text is made in order.

Defined results: null roles and texts are one space, null turns come first, a null ``conv_id`` is a conversation too.
Rows of one turn are in the order of role and of a digest of role and text (repeated rows stand together).  A row's initial is its
role's first character; a role without one, or with another than s, u and a, can't be kept.  Further columns are dropped,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .frames import named, small_batches

#: White space, ends of sentences, and the edits' costs.
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

# States: 0 nothing yet, 1 after s, 2 after u, 3 after a.
_ACCEPT = 0b1001
#: Layers of the band.  From any state another is reached, or its way imitated, by at most two inserts and a delete more: costs of the four states differ by 7 at most.
LAYERS = 8
_ONES = sum(1 << 4 * k for k in range(LAYERS))
_BAND = (1 << 4 * LAYERS) - 1


def _before(bits: int, letter: str) -> int:
    """States, in every layer, from which ``letter`` leads into ``bits``."""
    if letter == "u":
        to = bits >> 2 & _ONES
        return to | to << 1 | to << 3
    if letter == "a":
        return (bits >> 3 & _ONES) << 2
    return bits >> 1 & _ONES if letter == "s" else 0


#: States after ``u``, ``a`` and ``s`` from each set of states.
_AFTER = {
    "u": [4 if s & 0b1011 else 0 for s in range(16)],
    "a": [8 if s & 0b0100 else 0 for s in range(16)],
    "s": [2 if s & 0b0001 else 0 for s in range(16)],
}
_EITHER = [u | a for u, a in zip(_AFTER["u"], _AFTER["a"])]
_NOWHERE = [0] * 16


def _with_inserts(bits: int) -> int:
    for _ in range(LAYERS // INSERT):
        bits |= (_before(bits, "u") | _before(bits, "a")) << 4 * INSERT & _BAND
    return bits


def _lowered(bits: int) -> tuple[int, int]:
    """Bits from the least layer on, and that layer."""
    least = ((bits & -bits).bit_length() - 1) // 4
    return bits >> 4 * least, least


_LAST = _with_inserts(_ACCEPT)
#: (bits, row) -> bits one turn before and how many layers up they stand; filled as rows need it.
_STEPS: dict[tuple[int, int], tuple[int, int]] = {}
_LETTERS = "sua?"


def row_code(initial: str, must_go: bool, truncated: bool) -> int:
    """What of a row decides its edits, as a number below 12."""
    letter = _LETTERS.find(initial) if initial else 3
    return (letter if letter >= 0 else 3) * 3 + (2 if must_go else 1 if truncated else 0)


def _step(bits: int, row: int) -> tuple[int, int]:
    wide = bits << 4 * DELETE
    if row % 3 < 2:
        more = TRUNCATED * (row % 3)
        wide |= _before(bits, _LETTERS[row // 3]) << 4 * more | (_before(bits, "u") | _before(bits, "a")) << 4 * (REROLE + more)
    bits, least = _lowered(wide)
    return _with_inserts(bits & _BAND), least


def cheapest(rows: bytes) -> tuple[int, str]:
    """Cost and least audit of a conversation of :func:`row_code` numbers."""
    bits, base = _LAST, 0
    layers, bases = [bits], [0]
    for row in reversed(rows):
        known = _STEPS.get((bits, row))
        if known is None:
            known = _STEPS[bits, row] = _step(bits, row)
        bits, up = known
        base += up
        layers.append(bits)
        bases.append(base)
    layers.reverse()
    bases.reverse()
    left = bases[0] + next(k for k in range(LAYERS) if layers[0] >> 4 * k & 1)
    cost, states, i, n, audit = left, 1, 0, len(rows), []

    def at(i: int, left: int) -> int:
        k = left - bases[i]
        return layers[i] >> 4 * k & 15 if k >= 0 else 0

    while i < n or left:
        if i < n and left >= DELETE and (now := states & at(i + 1, left - DELETE)):
            states, left, i = now, left - DELETE, i + 1
            audit.append("D")
        elif left >= INSERT and (now := _EITHER[states] & at(i, left - INSERT)):
            states, left = now, left - INSERT
            audit.append("I")
        else:
            more = rows[i] % 3
            keep = _AFTER.get(_LETTERS[rows[i] // 3], _NOWHERE)[states]
            if left >= more and (now := keep & at(i + 1, left - more)):
                states, left = now, left - more
                audit.append("K")
            else:
                states, left = _EITHER[states] & at(i + 1, left - REROLE - more), left - REROLE - more
                audit.append("R")
            i += 1
    return cost, "".join(audit)


# --- tables -----------------------------------------------------------------------------


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv, turn, role, text, there) of ``df`` after damage by rule; rows that it drops stay with ``there`` false."""
    text_of = lambda c: F.coalesce(named(df, c).cast("string"), F.lit(" "))
    asked = F.crc32(F.concat(text_of(conv), F.lit(":"), text_of(turn)).cast("binary")) % 20
    rows = df.select(named(df, conv).alias("conv"), named(df, turn).alias("turn"), F.coalesce(named(df, role), F.lit(" ")).alias("role"), F.coalesce(named(df, text), F.lit(" ")).alias("text"), asked.alias("rule"))
    cut_text = F.when(F.col("rule") == 1, "").when(F.col("rule") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", cut_text).withColumn("role", F.when(F.col("rule") == 4, "user").otherwise(F.col("role")))
    twice = F.explode(F.when(F.col("rule") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv", "turn", "role", "text", (F.col("rule") != 0).alias("there"), twice.alias("copy")).drop("copy")


def undamaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows as :func:`audits` and :func:`repaired` take them, as they are."""
    return df.select(named(df, conv).alias("conv"), named(df, turn).alias("turn"), F.coalesce(named(df, role), F.lit(" ")).alias("role"), F.coalesce(named(df, text), F.lit(" ")).alias("text"), F.lit(True).alias("there"))


def _same_text() -> Column:
    return F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))


#: Order of the rows of a conversation (Spark sorts nulls first).
_ORDER = ("turn", "role", "same")


def _audit_fields(conv: T.DataType) -> T.StructType:
    names = ("n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return T.StructType([T.StructField("conv", conv), *(T.StructField(c, T.LongType()) for c in names), T.StructField("audit", T.StringType())])


class _Conversation:
    """What is gathered of the rows of one conversation, in order."""

    def __init__(self) -> None:
        self.rows, self.seen = bytearray(), set()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.before = None

    def add(self, turn, initial: str, same: bytes, blank: bool, truncated: bool) -> None:
        again = same in self.seen
        self.seen.add(same)
        duplicate, truncated = again and not blank, truncated and not blank and not again
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        if self.rows and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first, self.last = turn if self.first is None else self.first, turn
        self.before = initial
        self.rows.append(row_code(initial, blank or duplicate, truncated))

    def result(self) -> tuple:
        cost, audit = cheapest(bytes(self.rows))
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return len(self.rows), gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def audits(rows: DataFrame) -> DataFrame:
    """(conv, n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation of :func:`damaged` or :func:`undamaged` rows."""
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    narrow = small_batches(rows).select("conv", "turn", F.substring("role", 1, 1).alias("initial"), "role", _same_text().alias("same"), (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(*ENDS)).alias("cut_off"), "there")
    narrow = narrow.repartition("conv").sortWithinPartitions("conv", *_ORDER).drop("role")
    schema = _audit_fields(rows.schema["conv"].dataType)
    kinds = pa.schema([("conv", to_arrow_type(schema["conv"].dataType)), *((f.name, pa.int64()) for f in schema[1:8]), ("audit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gathered, out = None, None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv", "turn", "initial", "same", "blank", "cut_off", "there")]
            for conv, turn, initial, same, blank, cut_off, there in zip(*columns):
                if gathered is None or conv != now:
                    if gathered is not None:
                        out.append((now, *gathered.result()))
                    now, gathered = conv, _Conversation()
                if there:
                    gathered.add(turn, initial, same, blank, cut_off)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), kinds)], schema=kinds)
                out = []
        if gathered is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((now, *gathered.result()), kinds)], schema=kinds)

    return narrow.mapInArrow(run, schema)


class _Repair:
    """Applies an audit to rows that come in order; gives the repaired turns."""

    def __init__(self, audit: str):
        self.audit, self.at, self.next = audit, 0, "user"

    def _role(self) -> str:
        role, self.next = self.next, "assistant" if self.next == "user" else "user"
        return role

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._role(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R" or edit == "K" and role[:1] == "s":
            yield (self._role() if edit == "R" else role), text
        elif edit == "K":
            self._role()
            yield role, text


def _with_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of every conversation in order behind one that holds its audit, conversations dealt to tasks."""
    texts = rows.where("there").select("conv", F.lit(1).alias("kind"), "turn", "role", _same_text().alias("same"), "text", F.lit(None).cast("string").alias("audit"))
    empty = (F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("turn", "role"))
    heads = found.select("conv", F.lit(0).alias("kind"), *empty, F.lit(None).cast("binary").alias("same"), F.lit(None).cast("string").alias("text"), "audit")
    return texts.unionByName(heads).repartition("conv").sortWithinPartitions("conv", "kind", *_ORDER).select("conv", "role", "text", "audit")


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, None, None) at each conversation's start, (conv, role, text) for its repaired turns, and None behind every batch."""
    now, repair = None, None
    for batch in batches:
        for conv, role, text, audit in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text", "audit"))):
            if audit is not None:
                if repair is not None:
                    for turn in repair.inserted():
                        yield now, *turn
                now, repair = conv, _Repair(audit)
                yield conv, None, None
            else:
                for turn in repair.row(role, text):
                    yield conv, *turn
        yield None
    if repair is not None:
        for turn in repair.inserted():
            yield now, *turn


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, position, role, text) of the repaired conversations, by their :func:`audits`."""
    kind = rows.schema["conv"].dataType
    schema = T.StructType([T.StructField("conv", kind), T.StructField("position", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, position = [], 0
        for turn in _turns(batches):
            if turn is not None and turn[1] is None:
                position = 0
            elif turn is not None:
                out.append((turn[0], position, *turn[1:]))
                position += 1
            elif out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f) for v, f in zip(zip(*out), kinds)], ["conv", "position", "role", "text"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, f) for v, f in zip(zip(*out), kinds)], ["conv", "position", "role", "text"])

    return _with_audits(rows, found).mapInArrow(run, schema)


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, sha256) of the repaired conversations' ``role:text`` turns, joined by newlines; texts are hashed as they pass."""
    schema = T.StructType([T.StructField("conv", rows.schema["conv"].dataType), T.StructField("sha256", T.StringType())])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, digest, first = [], None, None, True
        for turn in _turns(batches):
            if turn is None:
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f) for v, f in zip(zip(*out), kinds)], ["conv", "sha256"])
                    out = []
            elif turn[1] is None:
                if digest is not None:
                    out.append((now, digest.hexdigest()))
                now, digest, first = turn[0], hashlib.sha256(), True
            else:
                digest.update(f"{'' if first else chr(10)}{turn[1]}:{turn[2]}".encode("utf-8", "surrogatepass"))
                first = False
        if digest is not None:
            out.append((now, digest.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, f) for v, f in zip(zip(*out), kinds)], ["conv", "sha256"])

    return _with_audits(rows, found).mapInArrow(run, schema)
