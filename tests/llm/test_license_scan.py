"""License scans against a brute-force version."""

import re

from sonoquery.llm import license_scan as scan
from sonoquery.llm.license_texts import PHRASES, TEMPLATES
from sonoquery.llm.queries import op10_license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def base(text):
    words, places, labels = WORD.findall(lower(text)), [], set()
    for phrase, label in PHRASES:
        parts = phrase.split(" ")
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def spans(text):
    """Labels of templates, by trying every diagonal of every template."""
    own, found = WORD.findall(lower(text)), {}
    for label, template in TEMPLATES:
        wanted = WORD.findall(lower(template))
        size = max(1, len(wanted) - scan.K + 1)
        votes = {}
        for i in range(len(own) - scan.K + 1):
            for j in range(len(wanted) - scan.K + 1):
                if own[i : i + scan.K] == wanted[j : j + scan.K]:
                    votes.setdefault(i - j, set()).add(j)
        group, last = [], None
        groups = []
        for d in sorted(votes):
            if last is None or d - last > scan.NEAR:
                group = []
                groups.append(group)
            group.append(d)
            last = d
        for group in groups:
            if len(set().union(*(votes[d] for d in group))) < scan.VOTES * size:
                continue
            part = own[max(0, group[0]) : group[-1] + len(wanted)]
            table = [[0] * (len(wanted) + 1) for _ in range(len(part) + 1)]
            for i, a in enumerate(part, 1):
                for j, b in enumerate(wanted, 1):
                    table[i][j] = table[i - 1][j - 1] + 1 if a == b else max(table[i - 1][j], table[i][j - 1])
            if (s := table[-1][-1] / len(wanted)) >= scan.COVER:
                found[label] = max(found.get(label, 0), s)
    return found


def check(text, row):
    n_words, n_base, first, last, labels = base(text)
    assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == (n_words, n_base, first, last, labels)
    more = spans(text)
    assert row.labels == ",".join(sorted({x for x in labels.split(",") if x} | set(more)))
    assert abs(row.score - (1.0 if n_base else max(more.values(), default=0.0))) < 1e-12


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = op10_license_scan(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for row in rows:
        check(texts[row.doc_id], row)


def test_cases(spark):
    apache = TEMPLATES[7][1]
    cases = [None, "", "  ,;", "cc by", "CC-BY nc", "all rights reserved all rights reserved", "general public", "license " * 4, apache, apache.replace("compliance", "full compliance").replace("You may obtain", "you can get"), "x " * 9000 + apache + " y" * 500, "released under a the MIT license", "café cc ÉCC by Cc by"]
    rows = [(i, t, "clash") for i, t in enumerate(cases)] + [(3, "cc by", "again"), (None, "cc by", None), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = scan.scan(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        check(r.text, r["license_"])
        assert r.license in ("clash", "again", None)
    assert any("apache-2.0" in r["license_"].labels and r.doc_id == 9 for r in got)
    assert scan.scan(docs.where("false")).count() == 0


def test_strewn_and_very_long_texts(spark):
    """Words of a template with as many between them are no match; the template within a very long text is."""
    template = [("t", " ".join(f"w{i}" for i in range(90)))]
    own = scan.words(template[0][1])
    strewn = " ".join(" ".join([*own[i : i + 3], f"z{i}"]) for i in range(85))
    spread = " ".join(x for w in own for x in (w, "and", "so"))
    long = "other words here " * 60_000 + template[0][1] + " tail of it" * 50_000
    df = spark.createDataFrame([(1, strewn), (2, spread), (3, long), (4, template[0][1])], "doc_id long, text string")
    got = {r.doc_id: (r.license.labels, r.license.score) for r in scan.scan(df, templates=template).collect()}
    assert got == {1: ("", 0.0), 2: ("", 0.0), 3: ("t", 1.0), 4: ("t", 1.0)}


def test_common_subsequence():
    import random

    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 80))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        assert scan.common(a, b) == row[-1]


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[j]))
    return out


def test_repeated_parts_of_a_template(spark):
    """An exact template keeps its label, whatever of itself stands before or behind it."""
    rows = []
    for t, (label, text) in enumerate(TEMPLATES):
        own = scan.words(text)
        half = len(own) // 2
        tail, head = own[-3:] * (half // 3 + 1), own[:3] * (half // 3 + 1)
        for i, made in enumerate((own, own + tail[:half], head[:half] + own, own * 3, own + own[: len(own) // 2], own[:3] * 200 + own + own[-3:] * 200, ["word"] * 200 + own + tail)):
            rows.append((100 * t + i, " ".join(made)))
    got = {r.doc_id: r.license for r in scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for t, (label, _) in enumerate(TEMPLATES):
        for i in range(7):
            assert label in got[100 * t + i].labels.split(","), (label, i)
            assert any(s.label == label and s.similarity == 1.0 for s in got[100 * t + i].spans)
        assert sum(s.label == label for s in got[100 * t + 3].spans) >= 2
