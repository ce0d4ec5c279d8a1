"""Interval joins against comparing all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from lorespark.operators.intervals import _cells, _path, overlap_totals, overlaps


def pairs(a, b):
    inf = float("inf")
    ends = lambda lo, hi: (-inf if lo is None else lo, inf if hi is None else hi)
    out = []
    for i, *x in a:
        for j, *y in b:
            (al, ah), (bl, bh) = ends(*x), ends(*y)
            if al <= ah and bl <= bh and al <= bh and bl <= ah:
                out.append((i, j))
    return sorted(out)


def joined(spark, a, b):
    left = spark.createDataFrame(a, "i int, al int, ah int")
    right = spark.createDataFrame(b, "j int, bl int, bh int")
    return overlaps(left, right, ("al", "ah"), ("bl", "bh"))


def test_cells_cover_an_interval_once(spark):
    spans = [(lo, hi) for lo in range(0, 34, 3) for hi in range(lo, 35)]
    d = spark.createDataFrame(spans, "lo long, hi long").select("lo", "hi", _cells(F.col("lo"), F.col("hi"), 6).alias("c"))
    for r in d.collect():
        held = sorted(x for c in r.c for x in range(c.at << c.level, (c.at + 1) << c.level))
        assert held == list(range(r.lo, r.hi + 1)) and len(r.c) <= 12
    path = spark.range(1).select(_path(F.lit(37), 6)).first()[0]
    assert [(c.level, c.at) for c in path] == [(i, 37 >> i) for i in range(7)]


@pytest.mark.parametrize("seed", range(2))
def test_random_spans(spark, seed):
    rng = random.Random(seed)
    at = lambda: rng.choice([None, *[rng.randint(-40, 60)] * 6])
    make = lambda n: [(k % (n - 3), lo, None if lo is None or rng.random() < 0.2 else lo + rng.choice([-2, 0, 1, 5, 30])) for k in range(n) for lo in (at(),)]
    a, b = make(60), make(50)
    assert sorted((r.i, r.j) for r in joined(spark, a, b).collect()) == pairs(a, b)


def test_odd_sides(spark):
    assert joined(spark, [], [(1, 0, 1)]).count() == 0 and joined(spark, [(1, 0, 1)], []).count() == 0
    assert joined(spark, [(1, None, None)], [(2, None, None)]).count() == 1
    assert joined(spark, [(1, -5, 10**9)], [(2, 10**9, None), (3, -6, -6)]).count() == 1
    with pytest.raises(ValueError):
        overlaps(spark.range(1), spark.range(1), ("id", "id"), ("id", "id"))


def test_the_plan_has_no_nested_loop(spark):
    df = joined(spark, [(1, 0, 1)], [(2, 1, 4)])
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("seed", range(2))
def test_totals_are_those_of_the_pairs(spark, seed):
    rng = random.Random(seed)
    at = lambda: rng.choice([None, *[rng.randint(-40, 60)] * 6])
    make = lambda n: [(k, lo, None if lo is None or rng.random() < 0.2 else lo + rng.choice([-2, 0, 1, 5, 30])) for k in range(n) for lo in (at(),)]
    a, b = make(60), make(50)
    left, right = spark.createDataFrame(a, "i int, al int, ah int"), spark.createDataFrame(b, "j int, bl int, bh int").withColumn("v", F.when(F.col("j") % 4 > 0, F.col("j").cast("long")))
    want = overlaps(left, right, ("al", "ah"), ("bl", "bh")).groupBy("i").agg(F.count("*"), F.sum("v"))
    got = overlap_totals(left, right, ("al", "ah"), ("bl", "bh"), ("v",)).select("i", "n", "v")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_totals_make_no_pairs(spark):
    """A hundred million pairs, of which each row of a only wants count and sum; the sums of all would not fit in a long."""
    n = 10_000
    a = spark.range(n).select("id", F.lit(0).alias("al"), F.lit(9).alias("ah"))
    b = spark.range(n).select(F.when(F.col("id") < 2, 2**62).otherwise(F.lit(-1)).alias("v"), F.when(F.col("id") < 2, F.col("id") - 2).otherwise(F.lit(5)).alias("bl"), F.lit(None).cast("int").alias("bh"))
    b = b.withColumn("bh", F.when(F.col("v") > 0, F.col("bl")))
    got = overlap_totals(a, b, ("al", "ah"), ("bl", "bh"), ("v",)).groupBy("n", "v").count().collect()
    assert [tuple(r) for r in got] == [(n - 2, -(n - 2), n)]
    assert overlap_totals(a, b.limit(0), ("al", "ah"), ("bl", "bh"), ("v",)).count() == 0
    assert overlap_totals(a.limit(1), b.where("v < 0").withColumn("v", F.lit(None).cast("long")), ("al", "ah"), ("bl", "bh"), ("v",)).first()["v"] is None
