"""Statistics of a graph, join orders by them, stars read in one pass."""

import itertools
import random

import pytest

from lorespark.plans.compiler import sparql
from lorespark.plans.parser import Const, Pattern, Var, parse
from lorespark.plans.statistics import MOST, characteristic_sets, load_statistics, measure, ordered, predicates
from lorespark.sources.turtle import load_graph, save_graph
from lorespark.terms import TRIPLE, empty_graph

P = {"e": "http://e/"}
E = "http://e/"


def made(spark, rows):
    return spark.createDataFrame([(E + s, E + p, E + o if k == "iri" else o, k, None, None) for s, p, o, k in dict.fromkeys(rows)], TRIPLE)


def random_rows(seed, n=120):
    r = random.Random(seed)
    return sorted({(f"n{r.randrange(8)}", f"p{r.choice([0, 0, 0, 1, 2, 3])}", *r.choice([(f"n{r.randrange(8)}", "iri"), (str(r.randrange(3)), "lit")])) for _ in range(n)})


def random_query(r):
    def place(of):
        return r.choice(["?a", "?b", "?c", "?d", *of])

    first = "?a"
    parts = [f"{first} e:p{r.randrange(4)} {place(['e:n1', chr(34) + '1' + chr(34)])}" for _ in range(r.randrange(1, 4))]
    parts += [f"{place(['e:n2'])} {r.choice(['e:p0', 'e:p1', 'e:p2', '?q'])} {place(['e:n3'])}" for _ in range(r.randrange(0, 3))]
    r.shuffle(parts)
    return "SELECT * { " + " . ".join(parts) + " }"


def brute(rows, query):
    """All assignments, pattern after pattern, by plain loops."""
    code = {row: (E + row[0], E + row[1], E + row[2] if row[3] == "iri" else f'"{row[2]}"') for row in rows}
    found = [{}]
    for p in itertools.chain.from_iterable(part[1] if isinstance(part[1], list) else [part[1]] for part in query.where.parts):
        grown = []
        for env, triple in itertools.product(found, code.values()):
            new = dict(env)
            if all(t.code == v if isinstance(t, Const) else new.setdefault(t.name, v) == v for t, v in zip((p.s, p.p, p.o), triple, strict=True)):
                grown.append(new)
        found = grown
    return found


def test_random_patterns_equal_brute_force(spark):
    rows = random_rows(1)
    g = made(spark, rows).cache()
    known = measure(g)
    r = random.Random(2)
    tried = 0
    while tried < 25:
        text = random_query(r)
        want = brute(rows, parse(text, P))
        if len(want) > 5000:
            continue
        tried += 1
        got = sparql(g, text, P, known)
        plain = lambda v: v[1:-1] if v.startswith('"') else v
        assert sorted(map(tuple, got.collect())) == sorted(tuple(plain(e[n]) for n in got.columns) for e in want), text


def test_counts(spark):
    rows = random_rows(3)
    g = made(spark, rows)
    per = {}
    for s, p, o, k in rows:
        per.setdefault(p, {}).setdefault(s, []).append((o, k))
    got = {r.p.removeprefix(E): (r["rows"], r.subjects, r.objects, r.most) for r in predicates(g).collect()}
    assert got == {p: (sum(map(len, m.values())), len(m), len({x for v in m.values() for x in v}), max(map(len, m.values()))) for p, m in per.items()}
    sets = {}
    for s in {r[0] for r in rows}:
        has = tuple(sorted(E + p for p, m in per.items() if s in m))
        sets[has] = sets.get(has, 0) + 1
    assert {tuple(r.predicates): r.subjects for r in characteristic_sets(g).collect()} == sets


@pytest.fixture(scope="module")
def uneven(spark):
    """Of 3,000 nodes all have a kind, a name and a home, 10 a rare mark; one hub has many friends."""
    rows = [row for i in range(3000) for row in ((f"n{i}", "kind", "common", "lit"), (f"n{i}", "name", f"N{i}", "lit"), (f"n{i}", "home", f"h{i % 7}", "iri"))]
    rows += [(f"n{i}", "rare", f"r{i}", "iri") for i in range(10)] + [("n5", "friend", f"n{i}", "iri") for i in range(MOST + 1)]
    return made(spark, rows).cache()


def order(known, text):
    patterns = [p for part in parse(text, P).where.parts for p in (part[1] if isinstance(part[1], list) else [part[1]])]
    return [[p.p.code.removeprefix(E) for p in unit] for unit in ordered(known, patterns)]


def test_the_rare_pattern_comes_first_though_another_has_more_constants(spark, uneven):
    known = measure(uneven)
    text = 'SELECT ?x ?y { ?x e:kind "common" ; e:rare ?y }'
    assert order(known, text) == [["rare"], ["kind"]]
    assert sparql(uneven, text, P, known).count() == 10


def test_a_star_is_read_with_one_exchange(spark, uneven):
    known = measure(uneven)
    text = "SELECT ?x ?n ?h { ?x e:name ?n ; e:home ?h ; e:kind 'common' }"
    assert order(known, text) == [["name", "home", "kind"]]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [sparql(uneven, text, P, k)._jdf.queryExecution().executedPlan().toString().count("Exchange") for k in (known, None)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plans[0] == 1 < plans[1]
    assert sparql(uneven, text, P, known).count() == 3000


def test_a_hub_is_no_group(spark, uneven):
    known = measure(uneven)
    assert order(known, "SELECT * { ?x e:friend ?y ; e:rare ?r }") == [["rare"], ["friend"]]
    assert sparql(uneven, "SELECT * { ?x e:friend ?y ; e:rare ?r }", P, known).count() == MOST + 1


def test_kept_beside_the_graph(spark, uneven, tmp_path):
    path = str(tmp_path / "g")
    save_graph(uneven, path)
    assert load_graph(spark, path).count() == uneven.count()
    assert load_statistics(spark, path) == measure(uneven)


def test_an_empty_graph_and_unknown_predicates(spark, uneven):
    none = empty_graph(spark)
    assert sparql(none, "SELECT ?x { ?x e:a ?y ; e:b ?z }", P, measure(none)).count() == 0
    assert sparql(uneven, "SELECT ?x { ?x e:name ?y ; e:nothing ?z }", P, measure(uneven)).count() == 0
    assert ordered(measure(none), [Pattern(Var("x"), Const(E + "a"), Var("y"))])
