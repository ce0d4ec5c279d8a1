"""Names in prose against patterns of whole words, letter case and bounds included."""

import random
import time

from pyspark.sql import functions as F

from lorespark.operators import names


def pattern(needle):
    return "(?iU)\\b\\Q" + needle + "\\E\\b"


LETTERS = ["a", "B", "é", "É", "ß", "σ", "Σ", "ς", "я", "Я", "字", "1", "²", "_", "-", "'", " ", ".", "́", "İ", "ı", "Ⅷ", "ⅷ", "‍", "\n"]


def test_finds_equal_patterns(spark):
    rng = random.Random(31)
    word = lambda n: "".join(rng.choice(LETTERS) for _ in range(rng.randint(1, n)))
    needles = list({word(3) for _ in range(150)} | {"-", "a.b", "é", "x-", "-x", " "})
    texts = [(i, word(14)) for i in range(300)] + [(300, ""), (301, "a"), (302, "É é")]
    d = spark.createDataFrame(texts, "id int, text string")
    # a bare mark is a word character or not by what stands before it; bounds at marks are left out here
    wanted = spark.createDataFrame([(n, n) for n in needles if "́" not in n], "name string, needle string")
    asked = d.where(~F.contains("text", F.lit("́"))).crossJoin(wanted)
    want = {(r.id, r.needle) for r in asked.where(F.rlike("text", F.concat(F.lit("(?iU)\\b\\Q"), "needle", F.lit("\\E\\b")))).collect()}
    got = {(r.id, r.needle) for r in names.where_said(wanted, d.where(~F.contains("text", F.lit("́"))), "text", "id").collect()}
    assert got == want and len(want) > 300


def test_blocks_give_the_same(spark):
    rng = random.Random(32)
    wanted = spark.createDataFrame([(f"n{i}", rng.choice(["river", "Stone", "blue stone", "sea"]) + str(i % 9)) for i in range(60)], "name string, needle string")
    d = spark.createDataFrame([(i, " ".join(rng.choice(["river", "STONE", "blue", "sea"]) + str(rng.randrange(9)) for _ in range(6))) for i in range(80)], "id int, text string")
    whole = sorted(map(tuple, names.where_said(wanted, d, "text", "id").collect()))
    assert len(list(names.blocks(wanted, most=20))) > 5
    assert sorted(map(tuple, names.where_said(wanted, d, "text", "id", most=20).collect())) == whole and whole


def test_odd_rows(spark):
    wanted = spark.createDataFrame([("A", None), ("B", ""), ("C", "Hi"), ("D", "hI"), ("C", "Hi")], "name string, needle string")
    d = spark.createDataFrame([(1, None), (2, ""), (3, "oh HI."), (3, "oh HI."), (4, "high"), (5, "...")], "id int, text string")
    got = sorted((r.name, r.id) for r in names.where_said(wanted, d, "text", "id").collect())
    assert got == [("B", 3), ("B", 3), ("B", 4), ("C", 3), ("C", 3), ("D", 3), ("D", 3)]
    assert names.where_said(wanted.limit(0), d, "text", "id").count() == 0
    assert names.where_said(wanted, d.limit(0), "text", "id").count() == 0
    roster = spark.createDataFrame([("Ana Maria",), ("Bo Li",), ("Zed",)], "name string")
    assert {r.name for r in names.mentioned(roster, d.union(spark.createDataFrame([(9, "MARIA went")], "id int, text string"))).collect()} == {"Ana Maria"}


def test_the_plan_moves_no_text(spark):
    wanted = spark.createDataFrame([("a", "a")], "name string, needle string")
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    df = names.where_said(wanted, d, "text", "doc_id")
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert not [line for line in plan.splitlines() if "Exchange" in line and "text" in line]


def test_a_hundred_thousand_names():
    rng = random.Random(33)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))).capitalize()
    wanted = sorted({f"{word()} {word()}" for _ in range(100_000)})
    text = " ".join(rng.choice(wanted) if rng.random() < 0.1 else word() for _ in range(20_000))
    roster = names.Roster(wanted)
    began = time.perf_counter()
    got = roster.found(text)
    assert time.perf_counter() - began < 5
    low = f" {text.lower()} "
    assert got == [w for w in wanted if f" {w.lower()} " in low] and len(got) > 1000
