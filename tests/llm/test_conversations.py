"""Conversation repair against a shortest-path search over whole audits, and against plain Python over a table."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sonoquery.llm import conversations as c
from sonoquery.llm.queries import op12_conversations

STEP = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def least(rows):
    """Dijkstra over (cost, audit): every way is tried, the first end is the cheapest and least."""
    heap, seen = [(0, "", 0, "0")], set()
    while True:
        now = cost, audit, i, state = heapq.heappop(heap)
        if i == len(rows) and state in "0a":
            return cost, audit
        if now in seen:
            continue
        seen.add(now)
        for x in "ua":
            if (state, x) in STEP and audit.count("I") < 8:
                heapq.heappush(heap, (cost + 2, audit + "I", i, STEP[state, x]))
        if i < len(rows):
            letter, must_go, cut_off = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state))
            if not must_go:
                if (state, letter) in STEP:
                    heapq.heappush(heap, (cost + cut_off, audit + "K", i + 1, STEP[state, letter]))
                for x in "ua":
                    if (state, x) in STEP:
                        heapq.heappush(heap, (cost + 2 + cut_off, audit + "R", i + 1, STEP[state, x]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ssuuaat"), st.booleans(), st.booleans()), max_size=5))
def test_cheapest_least_audit(rows):
    rows = [(letter, go, cut_off and not go) for letter, go, cut_off in rows]
    assert c.cheapest(bytes(c.row_code(*r) for r in rows)) == least(rows)


def test_long_conversation_is_linear():
    rng = random.Random(3)
    cost, audit = c.cheapest(bytes(rng.randrange(12) for _ in range(200_000)))
    assert cost > 0 and sum(audit.count(x) for x in "DKR") == 200_000


def brute(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        rule = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        mine = groups[conv]
        text = "" if rule == 1 else re.sub("[.!?]", "", text) if rule == 2 else text
        mine += [(turn, "user" if rule == 4 else role, text)] * (0 if rule == 0 else 2 if rule == 3 else 1)
    out = {}
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, codes, faults, illegal = set(), [], [0, 0, 0], 0
        for i, (_, role, text) in enumerate(own):
            there = re.findall(r"[^\x20\x09-\x0D]", text)
            kind = 0 if not there else 1 if (role, text) in seen else 2 if there[-1] not in ".!?" else None
            seen.add((role, text))
            if kind is not None:
                faults[kind] += 1
            illegal += i > 0 and own[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
            codes.append(c.row_code(role[:1], kind in (0, 1), kind == 2))
        cost, audit = c.cheapest(bytes(codes))
        turns, i, said = [r[0] for r in own if r[0] is not None], 0, []
        expected = "user"
        for edit in audit:
            if edit != "I":
                _, role, text = own[i]
                i += 1
            if edit == "D":
                continue
            if edit == "K" and role[0] == "s":
                said.append(f"{role}:{text}")
                continue
            said.append(f"{role if edit == 'K' else expected}:{'' if edit == 'I' else text}")
            expected = "assistant" if expected == "user" else "user"
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in said))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *faults, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def run(spark, tmp_path, rows, more=""):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    if more:
        df = df.select("*", *(F.lit(x).alias(x) for x in more.split()))
    df.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = op12_conversations(spark, str(tmp_path))
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r.conv_id: tuple(r[n] for n in names) for r in got.collect()}


def test_table(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for conv in [*range(120), None]:
        for turn in range(rng.choice([1, 3, 6, 40])):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""])
            rows.append((conv, rng.choice([turn, turn, turn * 2, None]), role, rng.choice(["Well. ", "no end", "\t \n", "é?\n", None, "", "x" * 50_000 + "!"])))
    rows += rows[:40]
    got = run(spark, tmp_path, rows, "kind same audit conv there rule copy text_ none blank")
    assert got == brute(rows)


def test_all_dropped_and_empty(spark, tmp_path):
    conv = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert run(spark, tmp_path / "a", [(conv, 0, "user", "Hi.")]) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert run(spark, tmp_path / "b", []) == {}


def test_repaired_rows(spark):
    rows = spark.createDataFrame([("x", 1, "user", "Hi."), ("x", 2, "user", "Hi."), ("x", 3, "user", "Well."), ("y", 1, "system", "Be kind.")], "c string, t int, r string, b string")
    rows = c.undamaged(rows, "c", "t", "r", "b")
    found = c.audits(rows)
    assert {r.conv: (r.cost, r.audit) for r in found.collect()} == {"x": (5, "KDR"), "y": (3, "D")}
    assert [tuple(r) for r in c.repaired(rows, found).orderBy("conv", "position").collect()] == [("x", 0, "user", "Hi."), ("x", 1, "assistant", "Well.")]
