"""Periodic runs against a search by every period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

from pyspark.sql import functions as F

from lorespark.llm import runs

SF = "/root/testdata/sf0.001"


def by_every_period(w, least=24, times=3):
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q):
                part = w[i : i + length]
                if not any(part[d:] == part[:-d] for d in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def odd_text(rng):
    n = rng.randint(0, 140)
    w = [rng.choice("abcdefghij"[: rng.choice([1, 2, 3, 10])]) for _ in range(n)]
    if n > 5 and rng.random() < 0.7:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(2, 9)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    if n > 60 and rng.random() < 0.5:
        w[rng.randrange(n)] = "z"
    return w


def test_all_runs_of_groups_of_texts():
    rng, total = random.Random(1), 0
    for _ in range(150):
        texts = [odd_text(rng) for _ in range(rng.randint(1, 6))]
        least, times = rng.choice([1, 4, 24]), rng.choice([2, 3])
        want = [by_every_period(t, least, times) for t in texts]
        assert runs.find_runs(texts, least, times) == want
        total += sum(map(len, want))
    assert total > 1000


def test_a_fibonacci_word_has_all_its_cubes():
    a, b = "a", "ab"
    while len(b) < 1500:
        a, b = b, b + a
    assert runs.find_runs([list(b)], 1, 3) == [by_every_period(list(b), 1, 3)]


def test_long_text_keeps_to_its_time():
    import time

    rng = random.Random(4)
    w = [f"{rng.randrange(10**6)}" for _ in range(10_000)] * 3
    began = time.perf_counter()
    assert runs.find_runs([w]) == [[(0, 30_000, 10_000)]]
    assert runs.find_runs([["x"] * 30_000]) == [[(0, 30_000, 1)]]
    assert time.perf_counter() - began < 60


def test_best_run_is_exact_and_ties_go_to_the_first():
    assert runs.best_run([]) is None
    assert runs.best_run([(0, 30, 10), (5, 24, 8), (9, 27, 9)]) == (0, 30, 10)
    assert runs.best_run([(0, 3 * 10**17, 10**17), (1, 3 * 10**17 + 1, 10**17)]) == (1, 3 * 10**17 + 1, 10**17)


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = by_every_period(w)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else (None,) * 3
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
        digest("".join(f"{s},{length},{q}\n" for s, length, q in found)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


COLUMNS = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()


def by_id(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_query_equals_brute_force(spark):
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if len((r.text or "").split()) < 1500]
    got = runs.op12_periodic_runs(spark, SF).select(*COLUMNS)
    ids = {r.doc_id for r in docs}
    assert by_id(r for r in got.collect() if r.doc_id in ids) == by_id(expected(*r) for r in docs)


def test_odd_rows(spark, tmp_path):
    rng = random.Random(6)
    odd = [None, "", "  \n\t", "one", "a " * 23, "a " * 24, "  x y " * 30, "\x1c b " * 25, "A a " * 40]
    rows = [(i, t) for i, t in enumerate(odd)] + [(None, "a b " * 30), (None, None), (3, "one"), (3, "one")]
    rows += [(100 + i, " ".join(odd_text(rng))) for i in range(120)]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, periodic string").write.parquet(f"{tmp_path}/documents.parquet")
    got = runs.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == COLUMNS
    assert by_id(got.collect()) == by_id(expected(*r) for r in rows)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows)


def test_columns_and_empty_table(spark):
    d = spark.createDataFrame([(1, "a b " * 20, "old")], "doc_id long, text string, periodic string")
    row = runs.periodic_runs(d).first()
    assert [tuple(r) for r in row.periodic.runs] == [(0, 40, 2)] and row.periodic.collapsed == "a b" and row.text == "a b " * 20
    assert runs.periodic_runs(d.limit(0)).count() == 0
    assert runs.periodic_runs(d).select(F.col("periodic.best.period")).first()[0] == 2
