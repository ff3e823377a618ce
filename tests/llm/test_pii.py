"""Pseudonyms: validity, permutation, linkage and the way back."""

import hashlib
import math
import random
import re
import string
import time
from datetime import date, timedelta

from pyspark.sql import functions as F

from sonoquery.llm import pii
from sonoquery.llm.queries import PSEUDONYM_KEY, op8_pii


def luhn(number):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(number)))) % 10 == 0


def run(spark, texts, key="k"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.pii for r in pii.pseudonyms(df, key).orderBy("doc_id").collect()]


def test_small_domains_are_permuted(spark):
    n = 35 * 11
    df = spark.range(n).select("id", pii.feistel(F.col("id"), F.lit(35), F.lit(11), F.lit("k"), F.lit("t")).alias("y"))
    df = df.withColumn("x", pii.feistel(F.col("y"), F.lit(35), F.lit(11), F.lit("k"), F.lit("t"), back=True))
    rows = df.collect()
    assert sorted(r.y for r in rows) == list(range(n)) and all(r.x == r.id for r in rows)
    assert sum(r.y == r.id for r in rows) < 12


def test_formats(spark):
    cases = ["4845168114407329", "4845 1681 1440 7329", "+1 (743) 555-3824", "743-555-3824", "227.5.221.1", "of.99@mail9.example.com", "b99e99e99fd999c9cf9999b99d9a9999b999d9ce", "123-45-6789", "1990-02-28", "28.02.1990", "02/28/1990"]
    got = run(spark, [f"x {c}, {c}." for c in cases])
    for case, r in zip(cases, got, strict=True):
        new = r.text[2:].split(",")[0]
        assert r.n == 2 and r.text == f"x {new}, {new}." and new != case
        assert re.sub("[0-9]", "0", re.sub("[a-f]" if len(case) == 40 else "[a-z]", "0" if len(case) == 40 else "a", new)) == re.sub("[0-9]", "0", re.sub("[a-f]" if len(case) == 40 else "[a-z]", "0" if len(case) == 40 else "a", case)) or "." in case
    assert luhn(got[0].text[2:18]) and got[0].text[2:18] == got[1].text[2:21].replace(" ", "")
    assert all(int(x) < 256 for x in got[4].text[2:].split(",")[0].split("."))
    assert date.fromisoformat(got[8].text[2:12])
    assert run(spark, ["x 4845168114407329"], "another")[0].text != run(spark, ["x 4845168114407329"])[0].text


def test_signs_between_the_parts_of_a_number(spark):
    plain, table, shouted = run(spark, ["+1 (743) 555-3824", "+1 | (743) | 555-3824 |", "+1!! (743)!! 555-3824!!"])
    digits = lambda r: re.sub("[^0-9]", "", r.text)
    assert plain.n == table.n == shouted.n == 1 and digits(plain) == digits(table) == digits(shouted) != "17435553824"
    assert table.text.count("|") == 3 and shouted.text.count("!!") == 3


def test_invalid_values_stay(spark):
    texts = ["9807915762804490", "4845168114407328", "999.1.1.1", "1.2.3.4.5", "000-12-1234", "2023-02-30", "31.04.1999", "abc 12345", "3.4845168114407329", None, "", "no digit"]
    assert [(r.text, r.n) for r in run(spark, texts)] == [(t, 0) for t in texts]


def test_dates_stay_different(spark):
    days = [date(1999, 1, 1) + timedelta(i) for i in range(800)]
    for form in ("%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y"):
        texts = [d.strftime(form) for d in days]
        assert len({r.text for r in run(spark, texts)}) == len(days)


def test_whole_table_and_back(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    was = {r.doc_id: r.text for r in docs.collect()}
    rows = op8_pii(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(was)
    private = re.compile(r"\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b|\b4\d{15}\b|[a-z]+\.\d+@mail")
    changed = 0
    for r in rows:
        for value in private.findall(was[r.doc_id]):
            if not (value.startswith("4") and len(value) == 16 and not luhn(value)):
                assert value not in r.text
                changed += 1
        if not r.n_finds:
            assert r.text == was[r.doc_id]
    assert changed > 10
    back = pii.reveal(spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string"), PSEUDONYM_KEY).collect()
    assert all(r.pii.text == was[r.doc_id] for r in back)


def test_clashing_columns_and_empty(spark):
    df = spark.createDataFrame([(None, "a@b.com", 1, 2), (None, "a@b.com", 1, 2)], "doc_id long, text string, pii int, _matches int")
    rows = pii.pseudonyms(df, "k").collect()
    assert rows[0] == rows[1] and rows[0].pii == 1 and rows[0]["pii_"].n == 1
    assert pii.pseudonyms(df.where("false"), "k").count() == 0


def test_one_pseudonym_for_a_day(spark):
    """Whatever the form, and back again."""
    days = [date(1999, 1, 1) + timedelta(i * 7) for i in range(120)]
    forms = ["%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y", "%m/%d/%Y"]
    cases = [(d, f) for d in days for f in forms if d.day > 12 or f != "%m/%d/%Y"]
    got = run(spark, [d.strftime(f) for d, f in cases])
    new = {}
    for (d, f), r in zip(cases, got, strict=True):
        y = r.text
        read = date.fromisoformat(y) if "-" in y else date(int(y[6:]), *((int(y[:2]), int(y[3:5])) if f.startswith("%m") else (int(y[3:5]), int(y[:2]))))
        assert new.setdefault(d, read) == read and (read.day > 12) == (d.day > 12)
    assert len(set(new.values())) == len(days)
    back = pii.reveal(spark.createDataFrame([(i, r.text) for i, r in enumerate(got)], "doc_id long, text string"), "k").orderBy("doc_id").collect()
    assert [r.pii.text for r in back] == [d.strftime(f) for d, f in cases]


def test_long_texts_take_linear_time(spark):
    texts = ["a@" + "b." * 100_000 + "com", "x" * 1_000_000, "a." * 500_000 + "@b.com", "+1 " * 300_000, "1" * 1_000_000, "(" * 500_000, "a" * 70 + "@b.com", "0123456789abcdef" * 60_000, "1.1.1." * 150_000]
    began = time.time()
    got = run(spark, texts)
    assert time.time() - began < 60
    assert [r.text == t for r, t in zip(got, texts, strict=True)] == [r.n == 0 for r in got]
    assert run(spark, ["a" * 64 + "@b.co.uk, --of@x-y.com."])[0].n == 2


def test_the_key_is_in_no_plan(spark, capsys):
    df = pii.pseudonyms(spark.createDataFrame([(1, "a@b.com 123-45-6789")], "doc_id long, text string"), "very secret")
    df.explain("extended")
    shown = capsys.readouterr().out
    got = df.first().pii.text
    df.explain("formatted")  # as it ran
    shown += capsys.readouterr().out
    digest = hashlib.sha256(b"feistel key|very secret").hexdigest()
    assert "scalar-subquery" in shown and "very secret" not in shown and digest not in shown
    assert got != "a@b.com 123-45-6789" and pii.reveal(spark.createDataFrame([(1, got)], "doc_id long, text string"), "very secret").first().pii.text == "a@b.com 123-45-6789"


def test_long_names_are_linked_whatever_their_case(spark):
    names = ["John.Smithson-Longname.And.More", "john.smithson-longname.and.more", "JOHN.SMITHSON-LONGNAME.AND.MORE"]
    got = [r.text.split("@")[0] for r in run(spark, [f"{n}@b.com" for n in names])]
    assert len({x.lower() for x in got}) == 1 and got[0].lower() != names[1] and len(set(got)) == 3


class Plain:
    """The pseudonyms of a text, step by step."""

    def __init__(self, key):
        self.key = hashlib.sha256(b"feistel key|" + key.encode()).hexdigest()
        self.any = re.compile(pii.ANY)

    def feistel(self, x, a, b, tweak):
        for i in range(1, pii.ROUNDS + 1):
            half = x // a
            r = int(hashlib.sha256(f"{self.key}|{tweak}|{i}|{half}".encode()).hexdigest()[:15], 16)
            x = b * ((x % a + r % a) % a) + half
        return x

    def permuted(self, s, kind, hexadecimal=False):
        out = ""
        for at in range(0, len(s), pii.BLOCK):
            part = s[at : at + pii.BLOCK]
            pools = ["0123456789abcdef" if hexadecimal else next((p for p in ("0123456789", string.ascii_lowercase, string.ascii_uppercase) if c in p), c) for c in part]
            x = 0
            for c, pool in zip(part, pools, strict=True):
                x = x * len(pool) + pool.index(c)
            h = len(part) // 2
            y = self.feistel(x, math.prod(map(len, pools[:h])), math.prod(map(len, pools[h:])), f"{kind}|{len(s)}|{out.lower()}")
            made = ""
            for pool in reversed(pools):
                y, v = divmod(y, len(pool))
                made = pool[v] + made
            out += made
        return out

    def day(self, d):
        x = d.toordinal() - date(1700, 1, 1).toordinal()
        while True:
            x = self.feistel(x, 773, pii.DAYS // 773, "date")
            y = date(1700, 1, 1) + timedelta(x)
            if (y.day > 12) == (d.day > 12):
                return y

    def new(self, m):
        kind = next(k for k, p in pii.PATTERNS.items() if re.fullmatch(p, m))
        digits = re.sub("[^0-9]", "", m)
        if kind == "email":
            name, _, rest = m.partition("@")
            return self.permuted(name, "email") + "@" + rest
        if kind == "secret":
            made = self.permuted(m.lower(), "secret", True)
            return made if m == m.lower() else made.upper()
        if kind == "phone":
            made = iter(digits[:-10] + self.permuted(digits[-10:], "phone"))
            return re.sub("[0-9]", lambda _: next(made), m)
        if kind == "ip":
            x = self.feistel(int.from_bytes(bytes(map(int, m.split("."))), "big"), 1 << 16, 1 << 16, "ip")
            return ".".join(map(str, x.to_bytes(4, "big")))
        if kind == "card":
            issuer = re.match("4|5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|3[47]|35|30[0-5]|36|38|6011|65|64[4-9]", digits)
            if not issuer or not luhn(digits):
                return m
            fixed = 1 if digits[0] == "4" else 4
            body = digits[:fixed] + self.permuted(digits[fixed:-1], "card")
            made = iter(body + next(c for c in "0123456789" if luhn(body + c)))
            return re.sub("[0-9]", lambda _: next(made), m)
        if kind == "ssn":
            area, group, serial = map(int, m.split("-"))
            if not (0 < area < 900 and area != 666 and group and serial):
                return m
            x = self.feistel(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, "ssn")
            area = x // (9999 * 99) + 1
            return f"{area + (area >= 666):03}-{x // 9999 % 99 + 1:02}-{x % 9999 + 1:04}"
        parts = [int(x) for x in re.split("[-./]", m)]
        y, mo, d = parts if "-" in m else parts[::-1]
        swapped = "/" in m and parts[1] > 12
        try:
            was = date(y, d, mo) if swapped else date(y, mo, d)
        except ValueError:
            return m
        if not 1700 <= y < 2100:
            return m
        made = self.day(was)
        return made.strftime("%Y-%m-%d" if "-" in m else "%m/%d/%Y" if swapped else "%d/%m/%Y" if "/" in m else "%d.%m.%Y")

    def text(self, text):
        return None if text is None else self.any.sub(lambda m: self.new(m[0]), text)


def test_whole_rows_against_plain_python(spark):
    plain = Plain(PSEUDONYM_KEY)
    rows = op8_pii(spark, "/root/testdata/sf0.001").collect()
    was = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert sum(r.n_finds for r in rows) > 10
    for r in rows:
        assert r.text == plain.text(was[r.doc_id])
    rng, plain = random.Random(2), Plain("k")
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts = []
    for _ in range(250):
        day = date(1650, 1, 1) + timedelta(rng.randrange(180_000))
        number = rng.choice(["4", "51", "34", "6011", "9"]) + d(rng.randint(9, 14))
        number += next(c for c in "0123456789" if luhn(number + c))
        values = [day.strftime(rng.choice(["%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y", "%d/%m/%Y"])), number, f"{d(3)}-{d(2)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", ".".join(str(rng.randint(0, 280)) for _ in range(4)), f"A.b-{d(rng.randint(0, 14))}@x{d(1)}.org", "%032x" % rng.getrandbits(128), d(rng.randint(1, 30)), f"{d(4)}-{d(4)}-{d(4)}-{d(4)}"]
        rng.shuffle(values)
        texts.append(rng.choice([" ", ", ", " x ", ".", "é "]).join(values))
    assert [r.text for r in run(spark, texts)] == [plain.text(t) for t in texts]
