"""Line dedup against a brute-force version."""

import numpy as np
import pyarrow as pa

from sonoquery.llm import line_dedup
from sonoquery.llm.queries import op6_line_dedup


def brute(docs):
    """docs: (key, text) in order.  Goes through all chunks one by one."""
    seen, out = set(), []
    for _, text in docs:
        if text is None:
            out.append((None, 0, 0))
            continue
        (lines,), (ends,), _, _ = line_dedup.chunks(pa.array([text]))
        start, kept = 0, []
        for end in ends.tolist():
            part = lines[start:end]
            start = end
            if sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in part) >= line_dedup.MIN_LINES:
                if "\n".join(part) in seen:
                    continue
                seen.add("\n".join(part))
            kept += part
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_chunks_cover_and_resist_shifts():
    rng = np.random.default_rng(0)
    lines = [f"line {i} {rng.integers(1000)}" for i in range(400)]
    parts = []
    for text in ("\n".join(lines), "\n".join(["new", *lines[:200], "inserted", *lines[200:]])):
        (own,), (ends,), _, _ = line_dedup.chunks(pa.array([text]))
        cuts = [0, *ends.tolist()]
        parts.append(["\n".join(own[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)])
        assert "\n".join(parts[-1]) == text
        assert all(b - a >= line_dedup.MIN_LINES for a, b in zip(cuts, cuts[1:], strict=False))
    assert len(set(parts[0]) - set(parts[1])) <= 6


def test_query(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in op6_line_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert [got[i] for i, _ in docs] == brute(docs)
    assert sum(x[2] for x in got.values()) > 0


def test_cases(spark):
    page = "\n".join(f"some words on line {i}" for i in range(30))
    rows = [(1, page), (2, page), (3, "x\n" + page + "\ny"), (4, None), (5, ""), (6, "\n\n\n\n"), (7, "\n\n\n\n"), (8, "one line"), (9, "one line"), (10, page + "\n" + page), (11, "a b\r\nc d"), (12, "a b\r\nc d"), (13, "a b\nc d")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, lines string, _a int")
    got = {r.doc_id: tuple(r["lines_"]) for r in line_dedup.dedup(df).collect()}
    assert [got[i] for i, _ in rows] == brute(rows)
    assert got[2] == ("", 30, 30) and got[6] == got[7] == ("\n\n\n\n", 5, 0) and got[9][0] == "one line"
    twice = spark.createDataFrame([(None, page), (None, page), (1, page)], "doc_id long, text string")
    assert sorted(r["lines"].n_removed for r in line_dedup.dedup(twice).collect()) == [0, 0, 30]
    assert line_dedup.dedup(df.where("false")).count() == 0


def repeated(docs):
    """docs: lists of lines, in order.  Of each, the lines in a pair that stood before, pair by pair; lines have words."""
    seen, out = set(), []
    for lines in docs:
        gone = set()
        for i, pair in enumerate(zip(lines, lines[1:], strict=False)):
            gone |= {i, i + 1} if pair in seen else set()
            seen.add(pair)
        out.append(gone)
    return out


def test_planted_passages(spark):
    """Passages of 2 to 6 lines, over 50 words each, at other places of other texts."""
    rng = np.random.default_rng(1)
    line = lambda: " ".join(f"w{x}" for x in rng.integers(10**6, size=30))
    docs, planted = [], []
    for i in range(60):
        passage = [line() for _ in range(2 + i % 5)]
        for copy in range(2):
            before = [line() for _ in range(rng.integers(1, 12))]
            planted += [(len(docs), len(before), len(passage))] * copy
            docs.append([*before, *passage, *(line() for _ in range(rng.integers(1, 12)))])
    df = spark.createDataFrame([(i, "\n".join(x)) for i, x in enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: r["lines"] for r in line_dedup.dedup(df, passages=True).collect()}
    for i, (lines, gone) in enumerate(zip(docs, repeated(docs), strict=True)):
        assert got[i].unrepeated.split("\n") == [x for k, x in enumerate(lines) if k not in gone] and got[i].n_repeated == len(gone)
    assert all(got[d].n_repeated == n for d, _, n in planted) and sum(x.n_repeated for x in got.values()) == sum(n for _, _, n in planted)
    assert 3 * sum(got[d].n_removed > 0 for d, _, n in planted if n >= 4) >= 2 * sum(n >= 4 for _, _, n in planted)  # by chunks


def brute_passages(docs):
    """docs: (key, text) in order.  Lines left of each, and how many go, by chunks as in :func:`brute` and by runs of two lines with a word, compared as strings."""
    chunks_seen, runs_seen, out = set(), set(), []
    for _, text in docs:
        (lines,), (ends,), _, _ = line_dedup.chunks(pa.array([text]))
        worded = [i for i, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        chunks = [(a, b, chunks_seen) for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False) if sum(a <= i < b for i in worded) >= line_dedup.MIN_LINES]
        gone = set()
        for a, b, seen in [*chunks, *((a, b + 1, runs_seen) for a, b in zip(worded, worded[1:], strict=False))]:
            part = "\n".join(lines[a:b])
            gone |= set(range(a, b)) if part in seen else set()
            seen.add(part)
        out.append(("\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)))
    return out


def test_passages_of_a_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null")
    docs = sorted((r.doc_id, r.text) for r in df.collect())
    got = {r.doc_id: (r["lines"].unrepeated, r["lines"].n_repeated) for r in line_dedup.dedup(df, passages=True).collect()}
    assert [got[i] for i, _ in docs] == brute_passages(docs)
    assert sum(x[1] for x in got.values()) > 0


def test_passages_odd_rows(spark):
    texts = ["a b\n\nc d\nx", "y\na b\n\nc d", "a b\n\n\nc d", "c d\nx\nonly", "one line\n", "\none line", None, "", "r\nr\nr", "\n\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r["lines"].unrepeated, r["lines"].n_repeated) for r in line_dedup.dedup(df, passages=True).collect()}
    wanted = {**{i: (t, 0) for i, t in enumerate(texts)}, 1: ("y", 3), 3: ("only", 2), 8: ("r", 2)}
    assert got == wanted
