"""Facts that rules and status reports read off a graph, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions.text import year_of
from ..terms import TYPE


def of(graph: DataFrame, p: str, s: str = "s", o: str = "o") -> DataFrame:
    return graph.where(F.col("p") == p).select(F.col("s").alias(s), F.col("o").alias(o))


def terms(graph: DataFrame) -> DataFrame:
    """(term) of every IRI that stands anywhere in a graph, such as an ontology."""
    places = F.explode(F.array("s", "p", F.when(F.col("o_kind") == "iri", F.col("o"))))
    return graph.select(places.alias("term")).where("term is not null and not startswith(term, '_:')").distinct()


def undeclared(graph: DataFrame, ontology: DataFrame) -> DataFrame:
    """(term) of the classes and predicates in use that the ontology neither defines nor mentions."""
    used = graph.select("p", F.when((F.col("p") == TYPE) & (F.col("o_kind") == "iri"), F.col("o")).alias("c"))
    used = used.select(F.explode(F.array("p", "c")).alias("term")).where("term is not null").distinct()
    return used.join(terms(ontology), "term", "left_anti")


def parity(every: DataFrame, fed: DataFrame, deferred: DataFrame) -> DataFrame:
    """(name, fault) of names that are both fed and deferred, and of those that are neither. Frames of one column, name."""
    # one count of flags, so that a name in many rows is a few rows of partial results and no group
    flag = lambda df, *said: df.select("name", *[F.lit(x in said).alias(x) for x in ("every", "fed", "deferred")])
    names = flag(every, "every").union(flag(fed, "fed")).union(flag(deferred, "deferred"))
    names = names.groupBy("name").agg(*[F.max(x).alias(x) for x in ("every", "fed", "deferred")])
    fault = F.when(F.col("fed") & F.col("deferred"), "both").when(F.col("every") & ~F.col("fed") & ~F.col("deferred"), "neither")
    return names.select("name", fault.alias("fault")).where("fault is not null")


def intervals(graph: DataFrame) -> DataFrame:
    """(uri, begin, end) of every event; a bound that is not given is null."""
    events = graph.where((F.col("p") == TYPE) & (F.col("o") == V.CLASS["event"])).select(F.col("s").alias("uri")).distinct()
    bounds = (
        of(graph, V.DURATION, "uri", "span")
        .join(of(graph, V.TEMPORAL_LOCATION, "span", "node"), "span")
        .join(of(graph, V.HAS_DIMENSION, "node", "dim"), "node")
        .join(of(graph, V.HAS_VALUE, "dim", "year"), "dim")
        .select("uri", F.endswith("node", F.lit("/begin")).alias("is_begin"), F.endswith("node", F.lit("/end")).alias("is_end"), year_of(F.col("year")).alias("year"))
        .groupBy("uri")
        .agg(F.max(F.when(F.col("is_begin"), F.col("year"))).alias("begin"), F.max(F.when(F.col("is_end"), F.col("year"))).alias("end"))
    )
    return events.join(bounds, "uri", "left")


def bounds_of(spans: DataFrame) -> DataFrame:
    """The one row of least begin and greatest end; null where none is known."""
    return spans.agg(F.min("begin").alias("begin"), F.max("end").alias("end"))


def relations(graph: DataFrame) -> DataFrame:
    """(a, rel, b) of the five temporal relations, in one pass."""
    names = F.create_map(*[F.lit(x) for k, p in V.RELATIONS.items() for x in (p, k)])
    return graph.where(F.col("p").isin(list(V.RELATIONS.values()))).select(F.col("s").alias("a"), names[F.col("p")].alias("rel"), F.col("o").alias("b")).distinct()


def strict_order(rel: DataFrame) -> DataFrame:
    """(x, y, triple): x comes before y. Where both a precedes and a follows say so, the follows is cited."""
    swap = F.col("rel") == "follows"
    said = F.struct(F.col("a").alias("s"), F.when(swap, V.RELATIONS["follows"]).otherwise(V.RELATIONS["precedes"]).alias("p"), F.col("b").alias("o"))
    both = rel.where(F.col("rel").isin("follows", "precedes"))
    both = both.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("x"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("y"), said.alias("t"), swap.cast("int").alias("n"))
    return both.groupBy("x", "y").agg(F.max_by("t", "n").alias("triple"))


def unordered(pairs: DataFrame) -> DataFrame:
    """A symmetric relation with one (least, greatest) row a pair."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def provenance(graph: DataFrame) -> DataFrame:
    """(uri, path) of every assertion about uri."""
    said = of(graph, V.ASSIGNED_TO, "node", "uri")
    return said.join(of(graph, V.USED_OBJECT, "node", "path"), "node").select("uri", "path")


def best_path(paths: DataFrame) -> DataFrame:
    """(uri, source): a path with a line before one without, then the least."""
    has_line = F.when(F.col("path").rlike(":[0-9]+$"), 0).otherwise(1)
    return paths.groupBy("uri").agg(F.min(F.struct(has_line.alias("rank"), "path"))["path"].alias("source"))


def orphan_units(graph: DataFrame) -> DataFrame:
    """(uri, label) of units in no sequence, by IRI."""
    units = graph.where((F.col("p") == TYPE) & (F.col("o") == V.CLASS["narrative-unit"])).select(F.col("s").alias("uri")).distinct()
    labels = of(graph, "http://www.w3.org/2000/01/rdf-schema#label", "uri", "label").groupBy("uri").agg(F.min("label").alias("label"))
    return units.join(of(graph, V.PROPER_PART, "seq", "uri"), "uri", "left_anti").join(labels, "uri", "left").orderBy("uri")


def present(graph: DataFrame, uris: DataFrame, uri_base: str, column: str = "uri") -> DataFrame:
    """The uris that are a subject of the graph, or the timeline."""
    timeline = graph.sparkSession.createDataFrame([(f"{uri_base}timeline",)], f"{column} string")
    # the graph is the side that streams, so that its subjects are neither sorted nor held
    there = graph.select(F.col("s").alias(column)).join(uris.select(column), column, "left_semi").distinct()
    return uris.join(there.union(timeline), column, "left_semi")


def anchors(graph: DataFrame) -> DataFrame:
    """(anchor, promotes, constrains, begin, end), one row an anchor, by IRI: of several, the least."""
    node = of(graph, V.HAS_TIME_SPAN, "anchor", "ts")
    node = node.join(of(graph, V.BEGIN, "ts", "b"), "ts", "left").join(of(graph, V.END, "ts", "e"), "ts", "left")
    rows = of(graph, V.PROMOTES, "anchor", "promotes").join(of(graph, V.CONSTRAINS, "anchor", "constrains"), "anchor", "left").join(node, "anchor", "left")
    rows = rows.select("anchor", "promotes", "constrains", year_of(F.col("b")).alias("begin"), year_of(F.col("e")).alias("end"))
    order = Window.partitionBy("anchor").orderBy("promotes", F.col("constrains").asc_nulls_last(), "begin", "end")
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n").orderBy("anchor")


def reliability_rank(name: Column) -> Column:
    rank = F.lit(None).cast("int")
    for i, r in enumerate(V.RELIABILITY):
        rank = F.when(name == r, i).otherwise(rank)
    return rank


def ratings(graph: DataFrame) -> DataFrame:
    """(source, rank) of rated sources."""
    rated = of(graph, V.BW + "reliability", "source", "iri")
    return rated.select("source", reliability_rank(F.element_at(F.split("iri", "/"), -1)).alias("rank")).groupBy("source").agg(F.max("rank").alias("rank"))


def supports(graph: DataFrame, promoted: DataFrame) -> DataFrame:
    """(anchor, source) of the sources that back an anchor's finding."""
    backed = of(graph, V.SUPPORTED_BY, "promotes", "source")
    return promoted.select("anchor", "promotes").join(backed, "promotes").select("anchor", "source").distinct()


def best_support(backed: DataFrame, rated: DataFrame, key: str) -> DataFrame:
    """(key, sources, best): how many sources back a key, and the best rank among them, null where none is rated."""
    return backed.join(rated, "source", "left").groupBy(key).agg(F.count("*").alias("sources"), F.max("rank").alias("best"))


def verdicts(promoted: DataFrame, backed: DataFrame, rated: DataFrame, minimum: str) -> DataFrame:
    """(anchor, sources, verdict): under_reliable, unrated or null. Without a source there is no verdict."""
    best = best_support(backed, rated, "anchor")
    least = V.RELIABILITY.index(minimum)
    said = F.when(F.col("sources").isNull(), None).when(F.col("best").isNull(), "unrated").when(F.col("best") < least, "under_reliable")
    return promoted.select("anchor").join(best, "anchor", "left").select("anchor", F.coalesce("sources", F.lit(0)).alias("sources"), said.alias("verdict"))


FACETS = [(label, p, label == "translation") for label, p in V.FACETS]


def missing_facets(graph: DataFrame, backed: DataFrame, language: str, facets: list[tuple[str, str, bool]] = FACETS, spoken_in: str = V.BW + "originalLanguage") -> DataFrame:
    """(anchor, source, facet, n): mandatory facets that a backing source lacks.

    A facet is (label, predicate, whether only a source of a foreign language needs it); a source
    whose language is not known needs none of the latter.
    """
    spark = graph.sparkSession
    asked = F.broadcast(spark.createDataFrame([(i, *f) for i, f in enumerate(facets)], "n int, facet string, p string, foreign boolean"))  # a fixed list
    has = graph.join(asked.select("n", "p"), "p").select(F.col("s").alias("source"), "n")
    spoken = of(graph, spoken_in, "source", "language").groupBy("source").agg(F.min("language").alias("language"))
    grid = backed.select("anchor", "source").join(spoken, "source", "left").join(asked.select("n", "facet", "foreign"), F.lit(True))
    grid = grid.where(~F.col("foreign") | (F.col("language").isNotNull() & (F.col("language") != language)))
    return grid.join(has, ["source", "n"], "left_anti").select("anchor", "source", "facet", "n")


def problem_set(problems: dict[str, Column]) -> Column:
    """The names of those that hold, in order."""
    return F.array_sort(F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, holds in problems.items()])))
