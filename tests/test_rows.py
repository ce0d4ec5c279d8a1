"""Patterns joined as rows of tables give what the triples of those tables give, with less to shuffle."""

import datetime

import pytest

from lorespark.operators.store import Store
from lorespark.plans.compiler import sparql
from lorespark.plans.relational import PREFIXES, graph_of, mapped
from lorespark.queries import QUERIES
from lorespark.terms import RDFS

P = PREFIXES | {"rdfs": RDFS}
DAY = datetime.datetime(1997, 3, 1)
TABLES = {
    "region": ("r_regionkey int, r_name string", [(0, "A"), (1, "B"), (2, None)]),
    "nation": ("n_nationkey int, n_name string, n_regionkey int", [(i, f"N{i % 3}", i % 4 if i % 5 else None) for i in range(25)]),
    "customer": ("c_custkey bigint, c_mktsegment string, c_nationkey int", [(i, ["BUILDING", "N1", None][i % 3], i % 27 if i % 4 else None) for i in range(40)]),
    "supplier": ("s_suppkey bigint, s_name string, s_nationkey int", [(i, f"S{i}", i % 5) for i in range(8)]),
    "part": ("p_partkey bigint, p_name string, p_brand string, p_size int", [(i, f"N{i}", f"B{i % 3}", i % 6 if i else None) for i in range(9)]),
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderpriority string, o_orderdate timestamp", [(i, i * 7 % 45 if i % 6 else None, f"{i % 5}-X", DAY) for i in range(30)] + [(None, 3, "1-X", None)]),
    "lineitem": (
        "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double",
        [(i % 33 if i % 9 else None, i % 3, i % 10, i % 4, float(i % 6) + 0.25 if i % 7 else None) for i in range(80)] * 2,
    ),
    "documents": ("doc_id bigint, lang string, source string", [(i, ["en", "fr", None][i % 3], "web") for i in range(12)]),
    "labels": ("doc_id bigint, quality int, toxic int", [(i, i % 2, i % 3) for i in range(0, 16, 2)]),
}

ASKED = {
    "lines of one order": "SELECT ?l ?o ?q { ?l d:order ?o ; d:quantity ?q ; d:part ?p }",
    "chain": "SELECT ?l ?c ?k { ?l d:order ?o . ?o d:customer ?c . ?c d:nation ?k }",
    "path": "SELECT ?l ?c { ?l d:order/d:customer ?c ; d:quantity ?q FILTER(?q > 2) }",
    "path back": "SELECT ?c ?l { ?c ^d:customer/^d:order ?l }",
    "path through two tables": "SELECT ?x ?r { ?x d:nation/d:region/rdfs:label ?r }",
    "path with a closure": "SELECT ?a ?r { ?a d:next+/d:region ?r }",
    "labels of any table": "SELECT ?x ?n { ?x rdfs:label ?n }",
    "label of one kind": "SELECT ?x ?n { ?x a d:Part ; rdfs:label ?n }",
    "kinds": "SELECT ?x ?k { ?x a ?k ; d:nation ?n }",
    "a kind that is none": "SELECT ?x { ?x a d:Nothing ; d:nation ?n }",
    "constants": 'SELECT ?c { ?c d:segment "BUILDING" ; d:nation <https://example.org/data/nation/3> }',
    "constant subject": "SELECT ?p ?o { <https://example.org/data/nation/3> ?p ?o . <https://example.org/data/nation/3> d:region ?r }",
    "constant number": "SELECT ?l { ?l d:quantity 4 ; d:order ?o }",
    "one object twice": "SELECT ?p ?a ?b { ?p d:brand ?a ; d:brand ?b }",
    "itself": "SELECT ?n { ?n d:next ?n }",
    "two of a table": "SELECT ?a ?c { ?a d:next ?b . ?b d:next ?c ; rdfs:label ?l . ?a rdfs:label ?l }",
    "numbers of two tables": "SELECT ?l ?p { ?l d:quantity ?q . ?p d:size ?q FILTER(?q >= 3) }",
    "texts of two tables": "SELECT ?c ?p { ?c d:segment ?s . ?p rdfs:label ?s }",
    "node and text": "SELECT ?c { ?c d:segment ?s . ?s d:region ?r }",
    "nodes of other tables": "SELECT ?o { ?o d:customer ?c . ?c d:region ?r }",
    "no variable shared": "SELECT ?r ?s { ?r a d:Region . ?s a d:Supplier }",
    "documents and labels": "SELECT ?d ?q { ?d d:lang ?l ; d:quality ?q ; d:source ?s ; d:toxic ?t }",
    "exists": "SELECT ?c { ?c d:segment ?s FILTER EXISTS { ?o d:customer ?c . ?l d:order ?o ; d:quantity ?q FILTER(?q = 4) } }",
    "not exists": "SELECT ?o { ?o d:customer ?c FILTER NOT EXISTS { ?l d:order ?o ; d:quantity ?q FILTER(?q = 4) } }",
    "optional": "SELECT ?o ?l ?b { ?o d:priority '1-X' OPTIONAL { ?l d:order ?o ; d:quantity ?q FILTER(?q > 1) OPTIONAL { ?l d:part ?p . ?p d:brand ?b ; d:size ?s FILTER(?s < 4) } } }",
    "sums": "SELECT ?n (COUNT(?l) AS ?k) (SUM(?q) AS ?t) (MAX(?q) AS ?m) (COUNT(DISTINCT *) AS ?d) { ?l d:order/d:customer/d:nation ?n ; d:quantity ?q } GROUP BY ?n",
    "all": "SELECT * { ?o d:customer/d:nation ?n ; d:year ?y }",
    "any predicate": "SELECT ?p (COUNT(*) AS ?k) { ?l d:order ?o ; ?p ?x } GROUP BY ?p",
}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Small tables with repeated lines, missing values and keys that name nothing."""
    path = str(tmp_path_factory.mktemp("odd"))
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.fixture(scope="module")
def g(spark, odd):
    return Store(spark, "odd").save(graph_of(mapped(spark, odd)))


@pytest.mark.parametrize("name", ASKED)
def test_rows_give_what_triples_give(spark, odd, g, name):
    rows = mapped(spark, odd)
    got, want = sparql(g, ASKED[name], P, rows=rows), sparql(g, ASKED[name], P)
    assert sorted(got.columns) == sorted(want.columns)
    same = lambda df: sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)
    assert same(got) == same(want)
    assert same(want) or name in ("a kind that is none", "node and text", "nodes of other tables", "itself")


def plan(spark, odd, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return QUERIES[name](spark, odd)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lines_are_read_once_and_meet_orders_by_key(spark, odd):
    found = plan(spark, odd, "exists_big")
    assert found.count("FileScan parquet [l_orderkey") == 1
    assert "l_orderkey" in next(x for x in found.splitlines() if "Join" in x and "Inner" in x)


def test_a_path_s_steps_are_rows_too(spark, odd):
    found = plan(spark, odd, "group_having")
    assert found.count("FileScan parquet [l_orderkey") == 1
    joins = [x for x in found.splitlines() if "Join" in x]
    assert len(joins) == 3 and all("key#" in x for x in joins)  # none compares IRIs
    assert sum("Exchange hashpartitioning" in x and "l_orderkey" in x for x in found.splitlines()) == 1  # distinct and joined where they are dealt
