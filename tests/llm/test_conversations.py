"""Conversation repair against all cheapest edits, whole and in blocks."""

import hashlib
import random
import re
import zlib

import pytest

from lorespark.llm import conversations as C

SF = "/root/testdata/sf0.001"
NAMES = {"u": "user", "a": "assistant"}


def every_cheapest(roles, faults):
    """The least (cost, audit), by keeping all cheapest audits of each state row by row."""

    def cheapest(d):
        out = {}
        for s, v in d.items():
            low = min(c for c, _ in v)
            out[s] = {x for x in v if x[0] == low}
        return out

    def inserted(d):
        for _ in range(3):
            for s, v in list(d.items()):
                for to in set(C.STEPS[s].values()) - {1}:
                    d.setdefault(to, set()).update((c + 5, a + "I") for c, a in v)
        return cheapest(d)

    now = inserted({0: {(0, "")}})
    for r, f in zip(roles, faults):
        then = {}
        for s, v in now.items():
            then.setdefault(s, set()).update((c + 2, a + "D") for c, a in v)
            charge = 5 * (f == "t")
            for letter, to in C.STEPS[s].items():
                if f != "d" and letter == r:
                    then.setdefault(to, set()).update((c + charge, a + "K") for c, a in v)
                if f != "d" and letter in "ua":
                    then.setdefault(to, set()).update((c + charge + 1, a + "R") for c, a in v)
        now = inserted(cheapest(then))
    return min(x for s in (0, 3) for x in now.get(s, ()))


def test_search_finds_the_least_cost_and_audit():
    rng = random.Random(2)
    for _ in range(1500):
        n = rng.randint(0, 9)
        roles, faults = "".join(rng.choice("suaxua") for _ in range(n)), "".join(rng.choice("kkkdt") for _ in range(n))
        cost, audit, end = C.search(roles, faults, 0, {s: 5 * k for s, k in enumerate(C.OWED)})
        assert (cost, audit + "I" * C.OWED[end]) == every_cheapest(roles, faults), (roles, faults)
    assert C.search("u", "d", 0, {3: 0}) == (12, "DII", 3) or C.search("u", "d", 0, {3: 0})[0] == 12
    assert C.search("", "", 0, {1: 0}) is None


def expected(rows):
    said = lambda v: " " if v is None else str(v)
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, [])
        k, r, x = zlib.crc32(f"{said(c)}:{said(t)}".encode()) % 20, said(r), said(x)
        if k:
            x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
            by[c] += [(t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
    out = {}
    for c, rows_of in by.items():
        rows_of.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1].encode(), z[2].encode()))
        turns = [z[0] for z in rows_of if z[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults = set(), ""
        for _, r, x in rows_of:
            bare = x.strip(" \t\n\v\f\r")
            faults += "b" if not bare else "r" if (r, x) in seen else "k" if bare[-1] in ".!?" else "t"
            seen.add((r, x))
        initials = "".join(z[1][0] if z[1] and z[1][0] in "sua" else "x" for z in rows_of)
        cost, audit = every_cheapest(initials, re.sub("[br]", "d", faults))
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows_of, rows_of[1:]))
        lines, at, last = [], 0, ""
        for e in audit:
            if e == "D":
                at += 1
                continue
            letter = initials[at] if e == "K" else "a" if last == "u" else "u"
            lines.append((rows_of[at][1] if e == "K" else NAMES[letter]) + ":" + ("" if e == "I" else rows_of[at][2]))
            at, last = at + (e != "I"), letter
        out[c] = (gaps, faults.count("b"), faults.count("r"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def result(df):
    rows = df.collect()
    out = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("long_rows", [C.LONG_ROWS, 3])
def test_query_equals_brute_force(spark, long_rows):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(C.op13_conversation_repair(spark, SF, long_rows)) == expected(rows)


@pytest.mark.parametrize("long_rows", [C.LONG_ROWS, 2])
def test_odd_rows(spark, tmp_path, long_rows):
    """Nulls, ties, repeats, blank, empty and long texts, unknown roles, a clashing column."""
    rng = random.Random(5)
    said = [None, "", "  \n", "Hi.", "what?", "no end", "a ", "Hm!  ", ".!?", "long. " * 3000, " "]
    roles = ["user", "assistant", "system", None, "", "tool", "user", "assistant"]
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(said)) for c in [None, *range(40)] for _ in range(rng.choice([1, 2, 5, 20]))]
    rows += [(1000, 0, "user", "x.")] * 30 + [(1001, i, rng.choice(roles[:2]), f"{i % 7}.") for i in range(30)]
    rows += [(c, t, "user", "a.") for c in range(2000, 2100) for t in (1,)]
    spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, copies long").write.parquet(f"{tmp_path}/conversations.parquet")
    got = result(C.op13_conversation_repair(spark, str(tmp_path), long_rows))
    assert got == expected(rows)
    nothing = hashlib.sha256(b"").hexdigest()
    assert sum(v == (0, 0, 0, 0, 0, 0, "", nothing) for v in got.values()) > 0  # all of its rows dropped


def test_a_long_conversation_equals_itself_whole(spark):
    rng = random.Random(9)
    rows = [(1, i, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", "", f"{i}."])) for i in range(400)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole, none = C.repair(d)
    one, many = C.repair(d, 40)
    assert none.count() == 0 and one.count() == 0 and many.count() >= 10
    want, parts = whole.first(), sorted(many.collect(), key=lambda r: (r.part, r.no))
    for c in ("n_rows", "blank", "duplicate", "truncated", "illegal", "cost"):
        assert sum(r[c] for r in parts) == want[c], c
    assert "".join(r.edits for r in parts) == want.edits
    assert [x for r in parts for x in r.repaired] == want.repaired and {r.gaps for r in parts} == {want.gaps}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert C.op13_conversation_repair(spark, str(tmp_path)).count() == 0
