"""Numbers taken along beside codes give the rows that taking the codes apart gives."""

import pytest

from lorespark.operators.store import Store
from lorespark.plans import compiler
from lorespark.plans.compiler import sparql
from lorespark.plans.statistics import measure
from lorespark.terms import TRIPLE, XSD

E = "https://e.example/"
P = {"e": E}

QUERIES = {
    "compare": "SELECT ?x ?v { ?x e:v ?v FILTER(?v > 2.5) }",
    "two bindings of one variable": "SELECT ?x ?y ?v { ?x e:v ?v . ?y e:w ?v FILTER(?v + 1 > 3) }",
    "subject of another": "SELECT ?x ?v ?z { ?x e:v ?v OPTIONAL { ?v e:v ?z } FILTER(!BOUND(?z) || ?z < 100) }",
    "optional binds": "SELECT ?x ?w { ?x e:v ?v OPTIONAL { ?x e:w ?w } FILTER(?v < 5) } ORDER BY ?w ?x",
    "optional shares what may be unbound": "SELECT ?x ?w { ?x e:v ?v OPTIONAL { ?x e:w ?w } OPTIONAL { ?y e:v ?w } FILTER(BOUND(?w) && ?w >= 1) }",
    "filter inside": "SELECT ?x ?w { ?x e:v ?v OPTIONAL { ?x e:w ?w FILTER(?w > ?v) } }",
    "union, one side without": "SELECT ?x ?v { { ?x e:v ?v } UNION { VALUES (?x ?v) { (e:z 7) (e:z 'seven') (e:z UNDEF) } } FILTER(?v > 2) }",
    "union of both": "SELECT ?x ?v { { ?x e:v ?v } UNION { ?x e:w ?v } FILTER(?v > 2) }",
    "path": "SELECT ?x ?v { ?x e:next/e:v ?v FILTER(?v >= 2) }",
    "values first": "SELECT ?x ?v { VALUES ?v { 2 3.0 'a' } ?x e:v ?v FILTER(?v > 1) }",
    "exists": "SELECT ?x { ?x e:v ?v FILTER EXISTS { ?x e:w ?w FILTER(?w > ?v) } }",
    "exists in an expression": "SELECT ?x { ?x e:v ?v FILTER(?v > 3 || EXISTS { ?x e:w ?v }) }",
    "minus": "SELECT ?x ?v { ?x e:v ?v MINUS { ?y e:w ?v FILTER(?v > 1) } FILTER(?v < 9) }",
    "sums": "SELECT ?x (SUM(?v) AS ?s) (AVG(?v) AS ?a) (MIN(?v) AS ?l) (MAX(?v) AS ?h) { ?x e:v ?v } GROUP BY ?x HAVING(SUM(?v) > 1) ORDER BY DESC(?s) ?x",
    "no numbers to add": "SELECT (SUM(?v) AS ?s) { ?x e:none ?v }",
    "distinct sums": "SELECT (SUM(DISTINCT ?v) AS ?s) (COUNT(DISTINCT *) AS ?n) { ?x e:v|e:w ?v }",
    "bind": "SELECT ?x ?d { ?x e:v ?v BIND(?v * 2 AS ?d) FILTER(?d > 4) } ORDER BY DESC(?d) ?x",
    "bind of text": "SELECT ?x ?d { ?x e:v ?v BIND(STR(?v) AS ?d) FILTER(?d > '2') }",
    "subselect": "SELECT ?x ?m { ?x e:v ?v { SELECT (MAX(?w) AS ?m) { ?y e:w ?w } } FILTER(?v <= ?m) }",
    "subselect, distinct": "SELECT ?x ?v { { SELECT DISTINCT ?x ?v { ?x e:v ?v } } FILTER(?v > 2) }",
    "star": "SELECT * { ?x e:v ?v ; e:w ?w FILTER(?v < ?w) }",
}


@pytest.fixture(scope="module")
def g(spark):
    whole, real, day = XSD + "integer", XSD + "double", XSD + "date"
    forms = [("1", whole), ("2", whole), ("02", whole), ("2.0", XSD + "decimal"), ("3", real), ("4e0", real), ("NaN", real), ("x", whole), ("5", None), ("2020-01-01", day), ("9" * 18, whole), ('a"^^b', None)]
    rows = []
    for i in range(60):
        o, dt = forms[i * 7 % len(forms)]
        rows.append((f"{E}s{i % 23}", E + ("v" if i % 5 % 2 else "w"), o, "lit", dt, None))
        rows.append((f"{E}s{i % 23}", E + "next", f"{E}s{(i * 5 + 1) % 23}", "iri", None, None))
    rows += [(f"{E}s1", E + "v", f"{E}s2", "iri", None, None), (f"{E}s2", E + "v", "drei", "lit", None, "de"), (f"{E}s3", E + "w", "3", "lit", XSD + "string", None)]
    return Store(spark, "numbers").save(spark.createDataFrame(sorted(set(rows), key=repr), TRIPLE))


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows_without_them(g, name, monkeypatch):
    with_ = sparql(g, QUERIES[name], P)
    monkeypatch.setattr(compiler, "asked", lambda q: set())
    without = sparql(g, QUERIES[name], P)
    assert with_.columns == without.columns and not any(c.startswith(".") for c in with_.columns)
    got, expected = with_.collect(), without.collect()
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
    assert expected or name == "no numbers to add"


def test_codes_are_not_taken_apart(g):
    known = measure(g)
    for name in ("compare", "sums", "bind", "star"):
        for k in (None, known):
            plan = sparql(g, QUERIES[name], P, k)._jdf.queryExecution().optimizedPlan().toString()
            assert "split_part" not in plan and "SplitPart" not in plan and "element_at(split" not in plan
