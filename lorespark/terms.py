"""Terms, prefixes and the triple schema.

A triple is (s, p, o, o_kind, o_dt, o_lang): o is an IRI or a literal's lexical form, o_kind
says which. In query columns a term is one string, its code: an IRI as it stands, a literal
as its lexical form in double quotes, followed by ``^^datatype`` or ``@language``. An IRI
never begins with a quote, so codes of equal terms, and only those, are equal strings and
joins need one column a variable. xsd:string and plain literals are the same term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRIPLE = "s string, p string, o string, o_kind string, o_dt string, o_lang string"
KEYS = ["s", "p", "o", "o_kind", "o_dt", "o_lang"]

# The ten namespaces that every query and Turtle file may use by prefix.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
OWL = "http://www.w3.org/2002/07/owl#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
TYPE = RDF + "type"
LABEL = RDFS + "label"


def iri(value: Column | str) -> dict[str, Column]:
    """Object columns of an IRI."""
    none = F.lit(None).cast("string")
    return {"o": F.lit(value) if isinstance(value, str) else value, "o_kind": F.lit("iri"), "o_dt": none, "o_lang": none}


def literal(value: Column | str | int | float | bool, datatype: str | None = None, lang: str | None = None) -> dict[str, Column]:
    """Object columns of a literal. A scalar gets its own datatype unless one is named; a str is never an IRI."""
    if datatype is None and lang is None and not isinstance(value, (Column, str)):
        datatype = XSD + {bool: "boolean", int: "integer", float: "double"}[type(value)]
    text = value if isinstance(value, Column) else F.lit(str(value).lower() if isinstance(value, bool) else str(value))
    return {"o": text.cast("string"), "o_kind": F.lit("lit"), "o_dt": F.lit(datatype).cast("string"), "o_lang": F.lit(lang).cast("string")}


def triples(df: DataFrame, s: Column, p: str, obj: dict[str, Column]) -> DataFrame:
    """One triple a row of df; rows with a null subject or object give none."""
    out = df.select(s.alias("s"), F.lit(p).alias("p"), *[obj[k].alias(k) for k in KEYS[2:]])
    return out.where("s is not null and o is not null")


def triple_rows(df: DataFrame, items: list[tuple[Column, str, dict[str, Column]]]) -> DataFrame:
    """The triples (subject, predicate, object) of each row of df, in one pass over it."""
    if len(items) == 1:
        return triples(df, *items[0])
    rows = [F.struct(s.alias("s"), F.lit(p).alias("p"), *[obj[k].cast("string").alias(k) for k in KEYS[2:]]) for s, p, obj in items]
    return df.select(F.explode(F.array(*rows)).alias("t")).select("t.*").where("s is not null and o is not null")


def empty_graph(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], TRIPLE)


def graph_union(*graphs: DataFrame, dealt: bool = False) -> DataFrame:
    """A graph is a set: equal triples are one.

    With dealt, for graphs made of large tables, the triples are dealt by subject before equal ones are sought, so
    that neither a task that reads many rows from a small file nor one of joined partitions holds a large share of them.
    """
    out = graphs[0]
    for g in graphs[1:]:
        out = out.unionByName(g)
    if dealt:
        spark = out.sparkSession
        out = out.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), "s")
    return out.dropDuplicates(KEYS)


def object_code(o: Column, kind: Column, dt: Column, lang: Column) -> Column:
    suffix = F.when(lang.isNotNull(), F.concat(F.lit("@"), lang)).when(dt.isNotNull() & (dt != XSD + "string"), F.concat(F.lit("^^"), dt)).otherwise("")
    return F.when(kind == "iri", o).otherwise(F.concat(F.lit('"'), o, F.lit('"'), suffix))


def literal_code(lexical: str, datatype: str | None = None, lang: str | None = None) -> str:
    tail = f"@{lang}" if lang else f"^^{datatype}" if datatype and datatype != XSD + "string" else ""
    return f'"{lexical}"{tail}'


def split_code(code: str) -> tuple[str, str, str | None, str | None]:
    """(kind, lexical form, datatype, language) of a code."""
    if not code.startswith('"'):
        return "iri", code, None, None
    lexical, _, tail = code[1:].rpartition('"')
    return "lit", lexical, tail[2:] if tail.startswith("^^") else None, tail[1:] if tail.startswith("@") else None


def is_literal(code: Column) -> Column:
    return F.startswith(code, F.lit('"'))


def lexical(code: Column) -> Column:
    """The lexical form, or the IRI."""
    return F.when(is_literal(code), F.regexp_extract(code, r'(?s)^"(.*)"', 1)).otherwise(code)


def tail(code: Column) -> Column:
    return F.regexp_extract(code, r'(?s)^".*"(.*)$', 1)


def datatype_of(code: Column) -> Column:
    t = tail(code)
    return F.when(F.startswith(t, F.lit("^^")), F.substring(t, 3, 1 << 30)).when(F.startswith(t, F.lit("@")), RDF + "langString").when(is_literal(code), XSD + "string")


def language_of(code: Column) -> Column:
    t = tail(code)
    return F.when(is_literal(code), F.when(F.startswith(t, F.lit("@")), F.substring(t, 2, 1 << 30)).otherwise(""))
