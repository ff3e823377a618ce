"""The mix against its definition."""

import random

import duckdb
import pytest

from sonoquery.llm import mixing
from sonoquery.llm.queries import OP3_SQL, OP5_SQL, op3_warc_fixity, op5_mixing

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("query", "sql", "table"), [(op5_mixing, OP5_SQL, "documents"), (op3_warc_fixity, OP3_SQL, "pages")])
def test_sql(spark, query, sql, table):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DIR}/{table}.parquet'")
    df = query(spark, DIR)
    columns = sorted(df.columns)
    result = con.sql(sql)
    assert sorted(result.columns) == columns
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    assert got == sorted((tuple(r[result.columns.index(c)] for c in columns) for r in result.fetchall()), key=str)


def targets(sizes):
    """By resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, free, rest = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        level = rest / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * level > 2 * sizes[s] + 1e-9}
        if not above:
            return out | {s: weight[s] * level for s in free}
        for s in above:
            out[s] = 2.0 * sizes[s]
            rest -= out[s]
        free -= above
    return out


@pytest.mark.parametrize("bucket", [2, 2000])
def test_mix(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    rng = random.Random(0)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)) if rng.random() < 0.95 else None, rng.choice(["a", "b", "B", "é", None, "z", "a"]), "c") for i in range(400)]
    rows += [(400, "", "empty", "c"), (None, "one two three", "a", "c"), (None, "one two three", "a", "c"), (7, "again", "b", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")
    got = mixing.place(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    wanted, taken = targets(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        assert abs(r.target - wanted[r.source]) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        assert r.taken == sum(c.words for c in r.copies) and [c.copy for c in r.copies] == list(range(len(r.copies)))
        assert all(0 <= c.position <= 1 and c.words > 0 for c in r.copies)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - wanted[s]) < 1 for s in sizes)
    again = mixing.place(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.place(df.where("false")).count() == 0


def test_inverse(spark):
    """The inverse of the integral, against the integral."""
    for schedule in (*mixing.SCHEDULES, ((0.0, 0.0), (0.3, 2.0), (0.7, 0.0), (1.0, 1.0))):
        fractions = [i / 50 for i in range(51)]
        df = spark.createDataFrame([(f,) for f in fractions], "f double")
        times = [r[0] for r in df.orderBy("f").select(mixing.inverse(schedule, df.f)).collect()]
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:], strict=False)]
        for f, t in zip(fractions, times, strict=True):
            done = 0.0
            for (t0, w0), (t1, w1), area in zip(schedule, schedule[1:], areas, strict=False):
                x = min(max(t - t0, 0), t1 - t0)
                done += w0 * x + (w1 - w0) / (t1 - t0) * x * x / 2
            assert abs(done / sum(areas) - f) < 1e-6


def test_training_order(spark):
    df = spark.createDataFrame([(i, "w " * (i % 9 + 1), "s" + str(i % 3), i) for i in range(120)] + [(None, "x y", "s1", 0)], "doc_id long, text string, source string, position int")
    placed = {r.doc_id: r.copies for r in mixing.place(df, whole=True).collect()}
    rows = mixing.training_order(df).collect()
    at = [r["position_"] for r in rows]
    assert at == sorted(at) and len(rows) == sum(len(c) for c in placed.values())
    for r in rows:
        assert any(c.position == r["position_"] and c.words == len(r.text.split()) for c in placed[r.doc_id])


def test_training_order_of_repeated_ids(spark):
    """Rows that share an id, or have none, each stand as often as the mix takes them."""
    rows = [(None if i % 3 else 5, "w " * (i % 4 + 1), "s" + str(i % 2), i) for i in range(90)] + [(5, "w x", "s0", 90), (None, None, "s1", 91)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    taken = sum(len(r.copies) for r in mixing.place(df, whole=True).collect())
    got = mixing.training_order(df).collect()
    assert len(got) == taken and all(tuple(r)[:4] in rows for r in got)
    times = [sum(r.n == n for r in got) for n in range(92)]
    assert max(times) == 2 and times[91] == 0 and len({(r.n, r.position) for r in got}) == len(got)
