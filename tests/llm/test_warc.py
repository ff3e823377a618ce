"""WARC round trip and fixity audits."""

import gzip
import random
import time

import duckdb
from pyspark.sql import functions as F

from sonoquery.llm import warc
from sonoquery.llm.queries import OP3_SQL, op3_warc_fixity


def pages(spark, n=700):
    rows = [(i, f"http://x/{i}", f"<p>page {i}\r\n\r\né</p>") for i in range(n)]
    return spark.createDataFrame([*rows, (None, None, None), (3, "http://x/3", "again")], "page_id long, url string, html string")


def test_round_trip(spark, tmp_path):
    source = pages(spark)
    warc.write(source, str(tmp_path / "w"))
    read = warc.read(spark, str(tmp_path / "w")).collect()
    wanted = {(r.file, r.offset): r for r in warc.layout(source).collect()}
    assert len(read) == len(wanted) == 702
    for r in read:
        file = int(r.path.split("file=")[1].split("/")[0])
        w = wanted[file, r.offset]
        assert (w.length, w.digest, str(w.page) if w.page is not None else "none") == (r.length, r.digest, r.page)
    assert any(r.body.decode() == "<p>page 5\r\n\r\né</p>" for r in read)


def test_audit_finds_each_kind(spark):
    a = warc.layout(pages(spark)).cache()
    assert warc.audit(a, a).count() == 0
    b = a.where("page is null or page <> 300").withColumn("digest", F.when(F.col("page") == 17, F.lit("0")).otherwise(F.col("digest")))
    extra = spark.createDataFrame([(0, 900, 10**9, 5, None, "x")], "file long, number long, offset long, length long, page long, digest string")
    rows = {(r.page, r.status) for r in warc.audit(a, b.unionByName(extra)).collect()}
    assert rows == {(17, "changed"), (300, "missing"), (None, "extra")}
    assert warc.audit(a, a.where("false")).where("status = 'missing'").count() == 702
    assert warc.audit(a.where("false"), a.where("false")).count() == 0


def test_trees_have_small_groups(spark):
    a = warc.layout(pages(spark))
    levels = warc.depth(a)
    nodes = warc.tree(a, levels)
    assert levels == 3 and nodes.where("level = 3").count() == 3
    assert warc.root(nodes, levels).count() == 1


def test_query_on_null_and_repeated_ids(spark, tmp_path):
    """Undamaged records without an id aren't reported, and each damaged one of a repeated id once."""
    more = [(None, "u", "without id"), (None, "u", "another"), (102, "u", "changed by rule, repeated"), (102, "u", "changed by rule, again"), (11, "u", "lost by rule, repeated"), (4, "u", "sound"), (4, "u", "sound")]
    source = pages(spark, 200).unionByName(spark.createDataFrame(more, "page_id long, url string, html string"))
    source.write.parquet(str(tmp_path / "pages.parquet"))
    wanted = []
    for r in source.collect():
        if r.page_id is not None and (r.page_id % 103 == 11 or r.page_id % 97 == 5 or r.page_id % 101 == 7):
            wanted.append((r.page_id, "missing" if r.page_id % 103 == 11 else "changed"))
    got = [(r.page, r.status) for r in op3_warc_fixity(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(wanted) and got.count((102, "changed")) == 3
    for table in (source, source.where("false")):
        table.write.mode("overwrite").parquet(str(tmp_path / "pages.parquet"))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        rows = op3_warc_fixity(spark, str(tmp_path))
        sql = con.execute(OP3_SQL)
        names = [d[0] for d in sql.description]
        assert sorted(map(str, sql.fetchall())) == sorted(str(tuple(r[c] for c in names)) for r in rows.collect())


def raw(i, body, size=None):
    size = len(body) if size is None else size
    return f"WARC/1.1\r\nWARC-Type: {'response' if i % 2 else 'warcinfo'}\r\nWARC-Record-ID: <urn:uuid:{i}>\r\ncontent-length: {size}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_damaged_files():
    """Whatever happens to one record, all others are found at their places, and every byte is in a record or a damaged range."""
    records = [raw(i, b"body %d\r\nWARC/ is not a head\r\n" % i * 3) for i in range(5)]
    whole = b"".join(records)
    assert [(r["page"], r["damaged"]) for r in warc.parsed(whole)] == [(f"<urn:uuid:{i}>", False) for i in range(5)]
    damage = [b"?" + records[2], records[2][:40], records[2][1:], raw(2, b"x", "many"), raw(2, b"x", 10**9), raw(2, b"xyz" * 20, 7), records[2] + b"\r\n\0junk\n", b"\0" * 99]
    for bad in damage:
        data = b"".join([*records[:2], bad, *records[3:]])
        rows = list(warc.parsed(data))
        assert sum(r["length"] for r in rows) == len(data) and any(r["damaged"] for r in rows)
        assert {f"<urn:uuid:{i}>" for i in (0, 1, 3, 4)} <= {r["page"] for r in rows if not r["damaged"]}
        assert [r["offset"] for r in rows] == [sum(r["length"] for r in rows[:i]) for i in range(len(rows))]
    assert list(warc.parsed(b"")) == [] and [r["damaged"] for r in warc.parsed(whole[:-3])][-1]
    assert [r["damaged"] for r in warc.parsed(b"no record")] == [True]


def test_read_plain_and_gzip(spark, tmp_path):
    records = [raw(i, b"body %d" % i * 20000) for i in range(60)]
    members = [gzip.compress(r) for r in records]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(members))
    broken = members[7][:30] + b"\xff" * 10 + members[7][40:]
    (tmp_path / "c.warc.gz").write_bytes(b"".join([*members[:7], broken, *members[8:]]))
    rows = warc.read(spark, str(tmp_path)).collect()
    of = {n: [r for r in rows if r.path.endswith(n)] for n in ("a.warc", "b.warc.gz", "c.warc.gz")}
    assert [(r.offset, r.digest, r.type) for r in of["a.warc"]] == [(r.offset, r.digest, r.type) for r in of["b.warc.gz"]] and len(of["a.warc"]) == 60
    assert {r.page for r in of["c.warc.gz"] if not r.damaged} == {f"<urn:uuid:{i}>" for i in range(60) if i != 7}
    assert any(r.damaged for r in of["c.warc.gz"])


def _some_records(n, size=3000):
    rng = random.Random(n)
    return [f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {size}\r\n\r\n".encode() + rng.randbytes(size) + b"\r\n\r\n" for i in range(n)]


def test_damaged_first_byte_of_a_gzip_file(spark, tmp_path):
    members = [gzip.compress(r) for r in _some_records(5)]
    data = bytearray(b"".join(members))
    data[0] ^= 0xFF
    (tmp_path / "a.warc.gz").write_bytes(data)
    got = warc.read(spark, str(tmp_path)).collect()
    assert sorted(r.page for r in got if not r.damaged) == ["1", "2", "3", "4"] and sum(r.damaged for r in got) == 1


def test_one_damaged_member_for_a_whole_file():
    """What unpacks before the damage is kept."""
    records = _some_records(40)
    data = bytearray(gzip.compress(b"".join(records)))
    data[len(data) * 3 // 4] ^= 0x10
    got = [r for r in warc._records(bytes(data), "x.warc.gz")]
    whole = [r["page"] for r in got if not r["damaged"]]
    assert whole[:25] == [str(i) for i in range(25)] and any(r["damaged"] for r in got)
    cut_off = [r for r in warc._records(bytes(data[: len(data) // 2]), "x.warc.gz")]
    assert [r["page"] for r in cut_off if not r["damaged"]][:18] == [str(i) for i in range(18)] and cut_off[-1]["damaged"]
    behind = [r for r in warc._records(bytes(data) + gzip.compress(records[0]), "x")]
    assert behind[-1]["page"] == "0" and not behind[-1]["damaged"]


def test_heads_take_linear_time():
    for data in (b"WARC/1.0\r\n" * 400_000, b"WARC/1.0\r\nA: b\r\n" * 250_000 + b"\r\n", (b"WARC/1.0\r\n" * 5000 + b"\r\n") * 80, b"WARC/1.0\r\n\r\n" * 300_000):
        began = time.time()
        assert sum(r["length"] for r in warc.parsed(data)) == len(data)
        assert time.time() - began < 12
    # a field that ends like a record's first line is still a field
    odd = b"WARC/1.0\r\nSoftware: WARC/1.0\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"
    assert [r["damaged"] for r in warc.parsed(odd * 3)] == [False] * 3
