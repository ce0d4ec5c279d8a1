"""The query language over small literal graphs."""

import pytest

from lorespark.api import query
from lorespark.plans.compiler import sparql
from lorespark.plans.parser import QueryError
from lorespark.sources.turtle import TurtleError, load_graph, parse_turtle, save_graph, to_turtle
from lorespark.terms import TRIPLE, XSD, empty_graph, graph_union, iri, literal, triples

TEXT = """
@prefix e: <http://e/> .
e:a e:knows e:b, e:c ; e:name "Ann" ; e:age 30 ; e:born "0800"^^<http://www.w3.org/2001/XMLSchema#gYear> ; e:ok true .
e:b e:knows e:c ; e:name "Bob"@en ; e:age 4.5 .
e:c e:name 'Cy\\n"x"' ; e:knows e:c .
e:d e:age 30 ; e:plain "x"^^<http://www.w3.org/2001/XMLSchema#string> .
"""
P = {"e": "http://e/"}


@pytest.fixture(scope="module")
def g(spark):
    return spark.createDataFrame(parse_turtle(TEXT), TRIPLE).cache()


def ask(g, text):
    df = sparql(g, text, P)
    return sorted([tuple(v.replace("http://e/", "") if v else v for v in r) for r in df.collect()], key=repr)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SELECT ?x { ?x e:knows ?x }", [("c",)]),
        ("SELECT ?x { ?x e:knows e:c }", [("a",), ("b",), ("c",)]),
        ('SELECT ?x { ?x e:name "Ann" }', [("a",)]),
        ('SELECT ?x { ?x e:name "Bob" }', []),
        ('SELECT ?x { ?x e:name "Bob"@en }', [("b",)]),
        ('SELECT ?x { ?x e:plain "x" }', [("d",)]),
        ("SELECT ?x { ?x e:ok true }", [("a",)]),
        ("SELECT ?x { ?x e:age ?n FILTER(?n = 30.0) }", [("a",), ("d",)]),
        ("SELECT ?x { ?x e:age ?n FILTER(?n < 30) }", [("b",)]),
        ('SELECT ?x { ?x e:born ?y FILTER(STR(?y) < "1850") }', [("a",)]),
        ("SELECT ?x ?n { ?x e:knows e:c OPTIONAL { ?x e:age ?n } }", [("a", "30"), ("b", "4.5"), ("c", None)]),
        ("SELECT ?x ?y { ?x e:age ?n OPTIONAL { ?y e:age ?n FILTER(?y != ?x) } }", [("a", "d"), ("b", None), ("d", "a")]),
        ("SELECT ?x { ?x e:name ?n FILTER NOT EXISTS { ?x e:age ?a } }", [("c",)]),
        ("SELECT ?x { ?x e:age ?a FILTER EXISTS { ?y e:age ?b FILTER(?b = ?a && ?y != ?x) } }", [("a",), ("d",)]),
        ("SELECT ?x ?y { ?x e:knows/e:knows ?y }", [("a", "c"), ("a", "c"), ("b", "c"), ("c", "c")]),
        ("SELECT ?y { e:a e:knows+ ?y }", [("b",), ("c",)]),
        ("SELECT ?y { e:a e:knows* ?y }", [("a",), ("b",), ("c",)]),
        ("SELECT ?y { e:zzz e:knows* ?y }", [("zzz",)]),
        ("SELECT ?y { e:b e:knows? ?y }", [("b",), ("c",)]),
        ("SELECT ?y { e:c ^e:knows ?y }", [("a",), ("b",), ("c",)]),
        ("SELECT ?y { e:b !(e:knows|e:name) ?y }", [("4.5",)]),
        ("SELECT ?x { { ?x e:age 30 } UNION { ?x e:name 'Ann' } }", [("a",), ("a",), ("d",)]),
        ("SELECT ?x { ?x e:age ?n MINUS { ?x e:knows ?y } }", [("d",)]),
        ("SELECT ?x { ?x e:age ?n MINUS { ?q e:knows ?y } }", [("a",), ("b",), ("d",)]),
        ("SELECT ?x ?k { ?x e:age ?n VALUES (?x ?k) { (e:a 1) (UNDEF 2) } }", [("a", "1"), ("a", "2"), ("b", "2"), ("d", "2")]),
        ("SELECT (COUNT(*) AS ?n) { ?x e:nothing ?y }", [("0",)]),
        ("SELECT (COUNT(DISTINCT ?n) AS ?k) (MIN(?n) AS ?lo) (AVG(?n) AS ?m) { ?x e:age ?n }", [("2", "4.5", "21.5")]),
        ("SELECT DISTINCT ?n { ?x e:age ?n }", [("30",), ("4.5",)]),
        ("SELECT ?X ?x { ?X e:ok true . ?x e:plain ?p }" if False else "SELECT ?x { ?X e:ok true . ?x e:plain ?p }", [("d",)]),
        ("SELECT ?l { ?x e:name ?n BIND(LANG(?n) AS ?l) FILTER(?l != '') }", [("en",)]),
        ("SELECT ?x { ?x e:name ?n FILTER(LANGMATCHES(LANG(?n), 'EN') || !BOUND(?zz) && CONTAINS(?n, 'nn')) }", [("a",), ("b",)]),
        ("SELECT ?s { { SELECT ?s (COUNT(?o) AS ?n) { ?s e:knows ?o } GROUP BY ?s } FILTER(?n > 1) }", [("a",)]),
        ("ASK { ?x e:age 30 }", []),
    ],
)
def test_answers(g, text, want):
    assert ask(g, text) == sorted(want, key=repr)


def test_order(g):
    got = [r[0] for r in sparql(g, "SELECT ?x ?n { ?x e:knows|e:age ?z OPTIONAL { ?x e:age ?n } } ORDER BY ?n DESC(?x)", P).collect()]
    assert [x[-1] for x in got] == ["c", "b", "b", "d", "a", "a", "a"]
    assert [r[0][-1] for r in sparql(g, "SELECT ?x { ?x e:age ?n } ORDER BY DESC(?n) ?x LIMIT 1 OFFSET 1", P).collect()] == ["d"]


@pytest.mark.parametrize("text", ["", "SELECT", "SELECT ?x { ?x ", "SELECT ?x { ?x q:y ?z }", "CONSTRUCT { ?s ?p ?o } { ?s ?p ?o }", "SELECT ?x { ?x e:a ?y } garbage", "SELECT ?x { BIND(NOSUCH(1) AS ?x) }", "SELECT ?x (COUNT(?y) AS ?n) { ?x e:a ?y }"])
def test_errors_come_before_rows(g, text):
    with pytest.raises(QueryError):
        sparql(g, text, P)


def test_prefixes_need_no_declaration(g):
    assert query(g, "SELECT ?x { ?x a golem:G1_Character ; rdfs:label ?l }").count() == 0


def test_constants_reach_the_scan(spark, g, tmp_path):
    save_graph(g, str(tmp_path / "g"))
    stored = load_graph(spark, str(tmp_path / "g"))
    assert stored.exceptAll(g).count() == 0 and g.exceptAll(stored).count() == 0
    df = sparql(stored, "SELECT ?x { ?x e:name 'Ann' }", P)
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(p" in plan and "EqualTo(o,Ann)" in plan


def test_turtle_round_trip(spark, g):
    text = to_turtle(g, P)
    again = spark.createDataFrame(parse_turtle(text), TRIPLE)
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, g.distinct().collect()), key=repr)
    assert to_turtle(again, P) == text
    assert len(parse_turtle("@prefix e: <http://e/> . e:a e:b [ e:c (1 2) ] . [] e:x e:y .")) == 7
    for bad in ("e:a e:b e:c .", "<a> <b> <c>", "<a> <b> 'x .", "<a> <b> <c> <d> ."):
        with pytest.raises(TurtleError):
            parse_turtle(bad)


def test_terms(spark):
    one = spark.range(1)
    from pyspark.sql import functions as F

    made = graph_union(empty_graph(spark), *[triples(one, F.lit("s"), "p", o) for o in (literal("http://x"), iri("http://x"), literal(3), literal(2.5), literal(True), literal(True))])
    got = {(r.o, r.o_kind, r.o_dt) for r in made.collect()}
    assert got == {("http://x", "lit", None), ("http://x", "iri", None), ("3", "lit", XSD + "integer"), ("2.5", "lit", XSD + "double"), ("true", "lit", XSD + "boolean")}


def test_rows_that_repeat_are_one_node(spark, tmp_path):
    from lorespark.plans.relational import PREFIXES, graph

    line = (1, 2, 3, 4, 10.0, 5.0)
    rows = [line, line, (*line[:4], 20.0, 5.0), (*line[:5], 9.0), (1, 2, 3, None, 10.0, 5.0), (1, 2, None, 3, 10.0, 5.0)]
    d = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double")
    d.write.parquet(f"{tmp_path}/lineitem.parquet")
    g = graph(spark, str(tmp_path), "lineitem")
    assert g.count() == g.distinct().count()
    got = sparql(g, "SELECT ?l ?q WHERE { ?l d:order ?o ; d:quantity ?q }", PREFIXES)
    assert sorted((r.l.rpartition("/")[2], r.q) for r in got.collect()) == [("1-2--3-10", "10"), ("1-2-3--10", "10"), ("1-2-3-4-10", "10"), ("1-2-3-4-20", "20")]


def test_known_ends_are_searched(g, spark):
    assert ask(g, "SELECT ?x { e:a e:knows+ ?x }") == [("b",), ("c",)]
    assert ask(g, "SELECT ?x { ?x e:knows+ e:c }") == [("a",), ("b",), ("c",)]
    assert ask(g, "SELECT ?x { e:d e:knows* ?x }") == [("d",)]
    assert ask(g, "SELECT ?x { ?x e:knows* e:b }") == [("a",), ("b",)]
    assert ask(g, "SELECT ?x { ?x e:name ?n FILTER EXISTS { e:a e:knows+ e:c } FILTER NOT EXISTS { e:b e:knows+ e:a } }") == [("a",), ("b",), ("c",)]


def test_variables_that_may_be_unbound(g):
    rows = "SELECT ?x ?v { ?x e:name ?n OPTIONAL { ?x e:age ?v } { VALUES (?v ?x) { (30 UNDEF) (UNDEF e:b) (7 e:c) (UNDEF UNDEF) } } }"
    # compatible pairs, each as often as it comes about
    assert ask(g, rows) == [("a", "30"), ("a", "30"), ("b", "4.5"), ("b", "4.5"), ("c", "30"), ("c", "7"), ("c", None)]
    both = "SELECT ?v ?w { { SELECT ?v ?w { VALUES (?v ?w) { (1 UNDEF) (UNDEF 2) } } } { SELECT ?v ?w { VALUES (?v ?w) { (1 2) (UNDEF UNDEF) (3 UNDEF) } } } }"
    assert ask(g, both) == [("1", "2"), ("1", "2"), ("1", None), ("3", "2"), (None, "2")]


def test_exists_inside_expressions(g):
    assert ask(g, 'SELECT ?x { ?x e:name ?n FILTER(?n = "Ann" || EXISTS { ?x e:knows ?x }) }') == [("a",), ("c",)]
    assert ask(g, "SELECT ?x ?known { ?x e:name ?n BIND(NOT EXISTS { ?y e:knows ?x FILTER(?y != ?x) } AS ?known) }") == [("a", "true"), ("b", "false"), ("c", "false")]
    assert ask(g, "SELECT ?x { ?x e:name ?n FILTER(IF(EXISTS { ?x e:age ?a }, !EXISTS { ?x e:ok true }, false)) }") == [("b",)]


def test_blank_nodes_zones_and_made_terms(spark):
    g = spark.createDataFrame(parse_turtle('@prefix e: <http://e/> . [] e:at "2020-01-02T03:04:05-07:30" . e:x e:at "2020-01-02T03:04:05Z" , "2020-01-02T03:04:05" , "2020-01-02T03:04:05+10:00" .'), TRIPLE)
    got = ask(g, "SELECT ?t (TZ(?t) AS ?z) (TIMEZONE(?t) AS ?d) (isBlank(?s) AS ?b) (isIRI(?s) AS ?i) { ?s e:at ?t }")
    day = "2020-01-02T03:04:05"
    assert {r[0]: r[1:] for r in got} == {day + "-07:30": ("-07:30", "-PT7H30M", "true", "false"), day + "Z": ("Z", "PT0S", "false", "true"), day: ("", None, "false", "true"), day + "+10:00": ("+10:00", "PT10H", "false", "true")}
    made = sparql(g, 'SELECT (UUID() AS ?u) (STRUUID() AS ?s) (BNODE() AS ?b) (BNODE("k") AS ?k) (RAND() AS ?r) (NOW() AS ?n) { ?x e:at ?t }', P).collect()
    assert len({r.u for r in made}) == 4 and all(r.u.startswith("urn:uuid:") and len(r.s) == 36 and r.b.startswith("_:") and 0 <= float(r.r) < 1 for r in made)
    assert len({r.b for r in made}) == 4 and len({r.k for r in made}) == 1 and len({r.n for r in made}) == 1


def test_cycles_of_random_graphs(spark):
    import random

    from lorespark.operators.reach import cycles

    rng = random.Random(3)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(60)] + [(50 + i, 50 + (i + 1) % 6) for i in range(6)] + [(100 + i, 101 + i) for i in range(5)] + [(200, 201), (201, 200), (201, 202), (202, 203), (203, 202), (7, 7), (None, 1)]
    reach = {a: {b for x, b in edges if x == a} for a, _ in edges if a is not None}
    for _ in range(60):
        reach = {a: to | {c for b in to for c in reach.get(b, ())} for a, to in reach.items()}
    want = {}
    for a in reach:
        loop = {b for b in reach[a] if a in reach.get(b, ())} | {a}
        if len(loop) > 1:
            want[a] = min(loop)
    got = {r.node: r.component for r in cycles(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == want and len(set(want.values())) > 2
    assert cycles(spark.createDataFrame([(1, 2), (2, 3)], "a int, b int")).count() == 0


def test_graph_sinks(g, spark, tmp_path):
    from lorespark.sources.turtle import save_turtle, write_turtle
    from lorespark.sources.turtle_scan import read_turtle

    odd = spark.createDataFrame([("http://e/s", "http://e/p", 'a "q" \\ \n\t\r é', "lit", None, None), ("_:b1", "http://e/p", "_:b2", "iri", None, None)], TRIPLE)
    both = graph_union(g, odd)
    write_turtle(both, f"{tmp_path}/deep/er/g.ttl", P)
    assert read_turtle(spark, f"{tmp_path}/deep/er/g.ttl").exceptAll(both).count() == 0
    save_turtle(both, f"{tmp_path}/parts")
    text = "".join(p.read_text() for p in sorted(tmp_path.glob("parts/part-*")))
    again = spark.createDataFrame(parse_turtle(text), TRIPLE)
    assert again.exceptAll(both).count() == 0 and both.exceptAll(again).count() == 0
