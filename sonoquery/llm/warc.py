"""WARC records and a Merkle fixity audit of replicas.

Method.  A replica's records are hashed (SHA-256).  Ordered ranges of ``FANOUT``
records of a file, told by the manifest's record numbers and offsets, are hashed
from their records' hashes, ranges of ``FANOUT`` ranges likewise, up to one node
for each file; the replica's root is a digest over its files in ranges of their
numbers.  Two replicas are compared at the root, and where it differs at the
nodes below, level by level; only children of nodes that differ are looked at.
What remains are the records that are changed, missing or extra, with their
places.

A record's place (file, number, offset) is part of the trees, so records that
swap places are found.  Every group that is hashed has at most ``FANOUT``
members.  Trees are tables (level, file, node, digest); the records themselves
aren't shuffled, only their hashes.

Defined results: a null url or body counts as empty; records with a null page id are in
files -1 to -4096, by digest; repeated rows are records of their own, one after the
other.  Bodies of any length are hashed whole.  Only the named columns are read, so
others may have any name.  Equal replicas give no row, an empty table neither; of an empty and another replica, all records
are missing or extra.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import cut
from .words import SLICE_BYTES

FANOUT = 16
FILE_IDS = 512
DATE = "2024-01-01T00:00:00Z"


def record(page: Column, url: Column, body: Column) -> Column:
    """A WARC/1.0 resource record as text (UTF-8)."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page.cast("string"), F.lit("none")),
        F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def _file(page: str, text: Column) -> Column:
    """Number of the file: ``FILE_IDS`` ids each; without an id, one of 4096 negative ones by the record's digest."""
    none = -1 - F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 3), 16, 10).cast("long")
    return F.coalesce(F.floor(F.col(page) / FILE_IDS).cast("long"), none)


def layout(pages: DataFrame, page: str = "page_id", url: str = "url", body: str = "html", other: Column | None = None) -> DataFrame:
    """Manifest of the records in files of ``FILE_IDS`` ids: ``file``, ``number``, ``offset``, ``length``, ``page``, ``digest``.

    With a body ``other``, also ``other``: the digest of the row's record with that body.
    """
    text = record(F.col(page), F.col(url), F.col(body))
    more = [] if other is None else [F.sha2(record(F.col(page), F.col(url), other).cast("binary"), 256).alias("other")]
    rows = pages.select(_file(page, text).alias("file"), F.col(page).alias("page"), F.octet_length(text).cast("long").alias("length"), F.sha2(text.cast("binary"), 256).alias("digest"), *more)
    order = Window.partitionBy("file").orderBy("page", "digest")
    return rows.select(
        "file",
        (F.row_number().over(order) - 1).cast("long").alias("number"),
        F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("offset"),
        "length",
        "page",
        "digest",
        *(["other"] if more else []),
    )


def tree(records: DataFrame, levels: int, fanout: int = FANOUT) -> DataFrame:
    """(level, file, node, digest): level 1 has ranges of records, ``levels`` the files' nodes."""
    leaf = F.concat_ws(":", F.col("number").cast("string"), F.col("offset").cast("string"), F.col("length").cast("string"), "digest")
    level = records.select("file", F.col("number").alias("child"), leaf.alias("digest"))
    out = None
    for i in range(1, levels + 1):
        members = F.transform(F.array_sort(F.collect_list(F.struct("child", "digest"))), lambda x: x["digest"])
        level = level.groupBy("file", F.floor(F.col("child") / fanout).cast("long").alias("node")).agg(F.sha2(F.array_join(members, "|").cast("binary"), 256).alias("digest"))
        own = level.select(F.lit(i).alias("level"), "file", "node", "digest")
        out = own if out is None else out.union(own)
        level = level.select("file", F.col("node").alias("child"), "digest")
    return out


def depth(records: DataFrame, fanout: int = FANOUT) -> int:
    """Levels that the file with the most records needs."""
    most = records.agg(F.max("number")).first()[0] or 0
    levels = 1
    while most >= fanout**levels:
        levels += 1
    return levels


def root(nodes: DataFrame, levels: int, fanout: int = FANOUT) -> DataFrame:
    """One row with the digest of a replica: of its files, in ranges of their numbers."""
    level = nodes.where(F.col("level") == levels).select(F.col("file").alias("child"), "digest")
    most = level.agg(F.max(F.abs("child"))).first()[0] or 0
    for _ in range(max(1, -(-most.bit_length() // 4))):  # until one range, and one of negative numbers, is left
        members = F.transform(F.array_sort(F.collect_list(F.struct("child", "digest"))), lambda x: F.concat_ws(":", x["child"].cast("string"), x["digest"]))
        level = level.groupBy(F.shiftright("child", 4).alias("child")).agg(F.sha2(F.array_join(members, "|").cast("binary"), 256).alias("digest"))
    return level.groupBy().agg(F.array_join(F.array_sort(F.collect_list("digest")), "|").alias("root"))


def audit(a: DataFrame, b: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Records in which replica ``b`` differs from ``a``: ``file``, ``number``, ``offset``, ``length``, ``page``, ``status``, digests.

    ``a`` and ``b`` are manifests as :func:`layout` gives them, with digests of what was read.
    """
    levels = max(depth(a, fanout), depth(b, fanout))
    first, second = cut(tree(a, levels, fanout)), cut(tree(b, levels, fanout))
    if root(first, levels, fanout).first() == root(second, levels, fanout).first():
        open_nodes = first.limit(0).select("file", "node")
    else:
        open_nodes = None
    for level in range(levels, 0, -1):
        mine, theirs = (t.where(F.col("level") == level).select("file", "node", F.col("digest").alias(name)) for t, name in ((first, "_a"), (second, "_b")))
        if open_nodes is not None:
            below = open_nodes.select("file", F.col("node").alias("_up"))
            mine, theirs = (t.withColumn("_up", F.floor(F.col("node") / fanout).cast("long")).join(below, ["file", "_up"], "left_semi").drop("_up") for t in (mine, theirs))
        open_nodes = mine.join(theirs, ["file", "node"], "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("file", "node")
    ranges = open_nodes.withColumnRenamed("node", "_up")

    def inside(records: DataFrame, side: str) -> DataFrame:
        near = records.withColumn("_up", F.floor(F.col("number") / fanout).cast("long")).join(ranges, ["file", "_up"], "left_semi")
        return near.select("file", "number", *(F.col(c).alias(c + side) for c in ("offset", "length", "page", "digest")))

    both = inside(a, "_a").join(inside(b, "_b"), ["file", "number"], "full")
    status = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("changed")
    differs = ~(F.col("digest_a").eqNullSafe(F.col("digest_b")) & F.col("length_a").eqNullSafe(F.col("length_b")) & F.col("offset_a").eqNullSafe(F.col("offset_b")))
    return both.where(differs).select("file", "number", *(F.coalesce(c + "_a", c + "_b").alias(c) for c in ("offset", "length", "page")), status.alias("status"), "digest_a", "digest_b")


def write(pages: DataFrame, path: str, page: str = "page_id", url: str = "url", body: str = "html") -> None:
    """Write the records as WARC files, a folder ``file=N`` for each, in the order of the manifest."""
    text = record(F.col(page), F.col(url), F.col(body))
    rows = pages.select(_file(page, text).alias("file"), F.col(page).alias("_page"), text.alias("value"))
    rows = rows.repartition("file").sortWithinPartitions("file", "_page", F.sha2(F.col("value").cast("binary"), 256))
    # a record ends in a line feed, which the writer puts behind each row
    rows.select("file", F.expr("substring(value, 1, length(value) - 1)").alias("value")).write.option("lineSep", "\n").partitionBy("file").text(path)


READ = [("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("page", pa.string()), ("url", pa.string()), ("body", pa.binary()), ("digest", pa.string()), ("damaged", pa.bool_())]
READ_DDL = "path string, offset bigint, length bigint, type string, page string, url string, body binary, digest string, damaged boolean"
_SIZE = re.compile(rb"(?im)^Content-Length:[ \t]*([0-9]{1,15})[ \t]*\r?$")
_PAGE = re.compile(r"^<urn:page:(.*)>$")
_NEXT = re.compile(rb"WARC/[0-9]\.[0-9]\r\n")
_AGAIN, _BLANK = re.compile(rb"\nWARC/[0-9]\.[0-9]\r\n"), re.compile(rb"\r\n\r\n")
#: Bytes of a record's head, at most.
HEAD_BYTES = 1 << 16


class _Places:
    """The next place of a pattern from a place on; what was found stays known until it is passed, so a file is searched once."""

    def __init__(self, data: bytes, pattern: re.Pattern):
        self.data, self.pattern, self.at = data, pattern, -1

    def after(self, at: int) -> int:
        if self.at < at:
            found = self.pattern.search(self.data, at)
            self.at = found.start() if found else len(self.data)
        return self.at


def _head(data: bytes, at: int, end: int) -> tuple[dict[bytes, bytes], int, int] | None:
    """Fields of the record at a place, where its body begins and where the record ends; None if none is whole there.  ``end`` is the next blank line."""
    size = _SIZE.search(data, at, end)
    if size is None:
        return None
    stop = end + 4 + int(size[1]) + 4
    if stop > len(data) or data[stop - 4 : stop] != b"\r\n\r\n":
        return None
    first, *lines = data[at:end].split(b"\r\n")
    if not _NEXT.fullmatch(first + b"\r\n") or not all(b":" in x or x[:1] in b" \t" for x in lines):
        return None
    fields = (x.split(b":", 1) for x in lines if b":" in x)
    return {k.strip().lower(): v.strip() for k, v in fields}, end + 4, stop


def parsed(data: bytes, base: int = 0) -> Iterator[dict]:
    """Records of an uncompressed WARC file, in order.

    What isn't a whole record (bytes that don't begin one, a head without a length or of more than ``HEAD_BYTES``, a body
    that doesn't end where it should) is a range with ``damaged`` set, up to the next place that
    begins a record; all records behind it are found.  ``digest`` is of all bytes of
    the record or range.  The time grows with the length, whatever the bytes.
    """
    at, blank, again = 0, _Places(data, _BLANK), _Places(data, _AGAIN)
    while at < len(data):
        head = None
        if data.startswith(b"WARC/", at):
            end = blank.after(at)
            # a line within a head has a colon, so the next first line of a record stands behind it
            if end < len(data) and end - at <= HEAD_BYTES and again.after(at) > end - 2:
                head = _head(data, at, end)
        if head is None:
            found = _NEXT.search(data, at + 1)
            stop = found.start() if found else len(data)
            row = {"type": None, "page": None, "url": None, "body": None}
        else:
            fields, body, stop = head
            text = lambda name: fields.get(name, b"").decode("utf-8", "replace")  # noqa: B023, E731
            row = {"type": text(b"warc-type"), "page": _PAGE.sub(r"\1", text(b"warc-record-id")), "url": text(b"warc-target-uri"), "body": data[body : stop - 4]}
        yield {"offset": base + at, "length": stop - at, **row, "digest": hashlib.sha256(memoryview(data)[at:stop]).hexdigest(), "damaged": head is None}
        at = stop


def unzipped(data: bytes) -> Iterator[tuple[bytes, bool]]:
    """Members of a gzip file.

    Of a member that breaks comes what unpacks before (which its check sum doesn't vouch for), and then the bytes from there to the
    next member as they are, with True.
    """
    at, view = 0, memoryview(data)
    while at < len(data):
        unpack, parts, stop = zlib.decompressobj(31), [], at
        try:
            while not unpack.eof and stop < len(data):
                before = unpack.copy()
                parts.append(unpack.decompress(view[stop : stop + (1 << 16)]))
                stop = min(len(data), stop + (1 << 16))
        except zlib.error:
            try:  # the stretch that breaks once more, byte by byte
                for stop in range(stop, min(len(data), stop + (1 << 16))):
                    parts.append(before.decompress(view[stop : stop + 1]))
            except zlib.error:
                pass
        if unpack.eof:
            yield b"".join(parts), False
            at = stop - len(unpack.unused_data)
        else:
            if any(parts):
                yield b"".join(parts), False
            found = data.find(b"\x1f\x8b\x08", max(at + 1, stop))
            end = found if found >= 0 else len(data)
            yield data[stop if any(parts) else at : end], True  # empty where a member only lacks its end
            at = end


def _records(data: bytes, name: str = "") -> Iterator[dict]:
    """Records of a file, which is a gzip file if it begins like one or is named so."""
    if not data.startswith(b"\x1f\x8b") and not name.endswith(".gz"):
        yield from parsed(data)
        return
    base = 0
    for text, damaged in unzipped(data):
        if damaged:
            yield {"offset": base, "length": len(text), "type": None, "page": None, "url": None, "body": None, "digest": hashlib.sha256(text).hexdigest(), "damaged": True}
        else:
            yield from parsed(text, base)
        base += len(text)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), *READ])
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows, size = [], 0
            for record in _records(content.as_py(), path):
                rows.append({"path": path, **record})
                size += record["length"]
                if size > SLICE_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files below ``path`` (``.warc``, ``.warc.gz`` and what :func:`write` makes).

    Columns: ``path``, ``offset``, ``length``, ``type``, ``page``, ``url``, ``body``, the record's ``digest`` and ``damaged``
    (:func:`parsed`).  Places in a ``.gz`` file are those of the unpacked members, of a damaged
    one what unpacks and then its bytes as they are.  A file is read by one task, at most 2 GB; records leave it slice by slice.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,warc,gz}").load(path)
    return files.select("path", "content").mapInArrow(_read, READ_DDL)
