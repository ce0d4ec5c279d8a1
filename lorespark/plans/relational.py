"""Base tables as a graph: one branch a mapped column.

The branches are disjoint and most tables' keys are unique, so those branches are sets as
they stand. Nothing makes a line's key unique, so its node is named by every column that the
view shows of it, and equal rows are one node: the distinct rows are shuffled once, and the
branches of a query share that exchange. A pattern with a constant predicate folds all other
branches away, and its filter and columns reach that branch's scan. The compiler may be given the rows
beside the triples: what a row tells of its node is then read together, and rows meet by keys
(see ``compiler``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import gyear
from ..terms import LABEL, TYPE, XSD, iri, literal, triples

DATA = "https://example.org/data/"
TERM = "https://example.org/term/"
PREFIXES = {"d": TERM, "data": DATA}


At = Callable[[str], Column]


def node(table: str, *keys: Column) -> Column:
    """A node's IRI; a missing key keeps its place."""
    parts = [k.cast("string") for k in keys]
    return F.concat(F.lit(f"{DATA}{table}/"), parts[0] if len(parts) == 1 else F.concat_ws("-", *[F.coalesce(x, F.lit("")) for x in parts]))


def link(table: str, column: str, at: At) -> dict:
    """The node of another table that a column names by its key."""
    return {**iri(node(table, at(column))), "node": (table, column)}


def whole(column: Column) -> dict[str, Column]:
    return literal(column.cast("bigint").cast("string"), XSD + "integer")


#: Table: its key columns, and predicate -> object of its mapped columns, where ``c`` gives a column by its name.
MAPPING: dict[str, tuple[list[str], dict]] = {
    "region": (["r_regionkey"], {LABEL: lambda c: literal(c("r_name"))}),
    "nation": (
        ["n_nationkey"],
        {LABEL: lambda c: literal(c("n_name")), TERM + "region": lambda c: link("region", "n_regionkey", c), TERM + "next": lambda c: iri(F.concat(F.lit(f"{DATA}nation/"), ((c("n_nationkey") * 7 + 3) % 25).cast("string")))},
    ),
    "customer": (["c_custkey"], {TERM + "segment": lambda c: literal(c("c_mktsegment")), TERM + "nation": lambda c: link("nation", "c_nationkey", c)}),
    "supplier": (["s_suppkey"], {LABEL: lambda c: literal(c("s_name")), TERM + "nation": lambda c: link("nation", "s_nationkey", c)}),
    "part": (["p_partkey"], {LABEL: lambda c: literal(c("p_name")), TERM + "brand": lambda c: literal(c("p_brand")), TERM + "size": lambda c: whole(c("p_size"))}),
    "orders": (
        ["o_orderkey"],
        {TERM + "customer": lambda c: link("customer", "o_custkey", c), TERM + "priority": lambda c: literal(c("o_orderpriority")), TERM + "year": lambda c: literal(gyear(F.year(c("o_orderdate"))), XSD + "gYear")},
    ),
    "lineitem": (
        ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"],
        {TERM + "order": lambda c: link("orders", "l_orderkey", c), TERM + "part": lambda c: link("part", "l_partkey", c), TERM + "quantity": lambda c: whole(c("l_quantity"))},
    ),
    "documents": (["doc_id"], {TERM + "lang": lambda c: literal(c("lang")), TERM + "source": lambda c: literal(c("source"))}),
    "labels": (["doc_id"], {TERM + "quality": lambda c: whole(c("quality")), TERM + "toxic": lambda c: literal(F.when(c("toxic") == 1, "true"), XSD + "boolean")}),
}

#: Tables whose rows may repeat: the columns of a node, which all of its objects follow from.
REPEATED = {"lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cast(l_quantity as bigint) as l_quantity"]}


@dataclass(frozen=True)
class Rows:
    """A table whose rows each describe a node of their own, by one object a predicate at most."""

    name: str  # of the nodes' table
    df: DataFrame
    keys: list[str]
    objects: dict[str, Callable[[At], dict]]
    kind: str | None  # the class of its nodes

    def node(self, at: At) -> Column:
        return node(self.name, *map(at, self.keys))


def mapped(spark: SparkSession, sf_dir: str, *tables: str) -> list[Rows]:
    """The rows of some tables, or of all mapped ones. A label row describes its document's node."""
    out = []
    for name in tables or MAPPING:
        keys, objects = MAPPING[name]
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name in REPEATED:
            # dealt by what their first column refers to: no map task keeps the distinct rows of a whole split, and a join on it needs no further shuffle
            df = df.selectExpr(*REPEATED[name]).repartition(keys[0]).distinct()
        kind = None if name == "labels" else TERM + name.capitalize()
        typed = {TYPE: lambda c, kind=kind: iri(kind)} if kind else {}
        out.append(Rows("documents" if name == "labels" else name, df, keys, typed | objects, kind))
    return out


def graph_of(tables: list[Rows]) -> DataFrame:
    """The triples of rows."""
    return reduce(DataFrame.unionByName, [triples(r.df, r.node(F.col), p, obj(F.col)) for r in tables for p, obj in r.objects.items()])


def graph(spark: SparkSession, sf_dir: str, *tables: str) -> DataFrame:
    """The graph of some tables, or of all mapped ones."""
    return graph_of(mapped(spark, sf_dir, *tables))
