"""Closure and reachability against plain searches, and the rows they need on the way."""

import random
from collections import Counter

import pytest

from lorespark.operators import reach
from lorespark.operators.store import Store


def every_pair(edges):
    ahead = {}
    for a, b in edges:
        if a is not None and b is not None:
            ahead.setdefault(a, set()).add(b)
    out = set()
    for a in ahead:
        left, seen = list(ahead[a]), set()
        while left:
            b = left.pop()
            if b not in seen:
                seen.add(b)
                left += ahead.get(b, ())
        out |= {(a, b) for b in seen}
    return out


def closed(spark, edges, kind="int", small=0):
    got = [tuple(r) for r in reach.closure(spark.createDataFrame(edges, f"a {kind}, b {kind}"), small=small).collect()]
    assert not got or max(Counter(got).values()) == 1
    return set(got)


@pytest.mark.parametrize("small", [0, reach.SMALL])
def test_random_graphs(spark, small):
    rng = random.Random(2)
    n, m = 60, 55
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(None, 1), (2, None), (500, 500)]
    edges += [(100 + i, 100 + (i + 1) % 7) for i in range(7)] + [(103, 200), (200, 201), (201, 202), (202, 201)]
    assert closed(spark, edges, small=small) == every_pair(edges)


def test_acyclic_graph_of_texts(spark):
    rng = random.Random(5)
    edges = [(f"n{a:03}", f"n{b:03}") for a, b in (sorted(rng.sample(range(50), 2)) for _ in range(80))]
    assert closed(spark, edges, "string") == every_pair(edges)


def test_small_cases(spark):
    edges = [(1, 1), (2, 3), (4, 5), (5, 4), (6, 7), (6, 7), (7, 8), (8, 8), (None, None), (5, None)]
    for small in (0, reach.SMALL):
        assert closed(spark, edges, small=small) == every_pair(edges)
        assert reach.closure(spark.createDataFrame([], "a int, b int"), small=small).count() == 0


def chained_rings(rings, size):
    edges = []
    for r in range(rings):
        edges += [(r * size + i, r * size + (i + 1) % size) for i in range(size)]
        if r:
            edges.append(((r - 1) * size + size // 2, r * size))
    return edges


def test_rows_on_the_way_stay_near_nodes_and_edges(spark, monkeypatch):
    """The largest table that is kept on the way to 202,500 pairs of 600 nodes, and to 500,000 of a plain chain."""
    kept = []
    save = Store.save

    def counted(self, df):
        out = save(self, df)
        kept.append(out.count())
        return out

    monkeypatch.setattr(Store, "save", counted)
    edges = chained_rings(8, 75)
    out = reach.closure(spark.createDataFrame(edges, "a int, b int"), small=0)
    assert max(kept) <= 600 + len(edges)
    assert out.count() == sum(75 * 75 * (8 - r) for r in range(8))
    kept.clear()
    chain = reach.closure(spark.createDataFrame([(i, i + 1) for i in range(1000)], "a int, b int"))
    assert max(kept) <= 2001 and len(kept) < 60
    assert chain.count() == 1000 * 1001 // 2


def test_search_from_seeds(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(40)]
    seeds = spark.createDataFrame([(3,), (4,)], "a int")
    got = {r.b for r in reach.reach_from(spark.createDataFrame(edges, "a int, b int"), seeds).collect()}
    assert got == {b for a, b in every_pair(edges) if a in (3, 4)}


def totals(spark, edges, small=0):
    return sorted(tuple(r) for r in reach.closure_totals(spark.createDataFrame(edges, "a int, b int"), small=small).collect())


def test_totals_are_those_of_the_pairs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(38)] + [(None, 1), (2, None), (500, 500), (600, 601), (601, 600)]
    for some in (edges, [(i, i + 1) for i in range(2500)] + [(7, 7), (9000, 9000)]):
        met = every_pair(some)
        n, total = Counter(a for a, _ in met), Counter()
        for a, b in met:
            total[a] += b
        assert totals(spark, some) == sorted((a, n[a], total[a]) for a in n)
