"""Validation rules over a graph and its project's prose.

A rule takes a context and gives a result: a frame of findings and a list of what it could
not judge. Built-in rules and custom ones register by name; each is run and materialised in
isolation, so that a fault in one is a record and the others still run.
"""

from __future__ import annotations

import importlib.util
import re
import sys
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path
from types import ModuleType

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import text as T
from . import facts
from .ingest import Build
from .names import mentioned, where_said
from .reach import cycles
from .store import Store

FINDING = "validator string, severity string, message string, source string, triples array<struct<s:string,p:string,o:string>>"


@dataclass(frozen=True)
class Abstention:
    reason: str
    kind: str = "missing_input"  # or pending_capability
    code: str | None = None


class NotEvaluated(Exception):
    """Raised by a rule that lacks its input."""

    def __init__(self, reason: str):
        super().__init__(reason)
        self.abstention = Abstention(reason)


@dataclass
class Result:
    findings: DataFrame | None = None
    abstentions: list[Abstention] = field(default_factory=list)


class Context:
    """What rules read: a build, the graph to judge and the project's prose."""

    def __init__(self, build: Build, files: DataFrame, graph: DataFrame | None = None):
        self.build, self.files, self.config = build, files, build.config
        self.spark = files.sparkSession
        self.graph = build.graph if graph is None else graph

    @cached_property
    def prose(self) -> DataFrame:
        """(relpath, text) of manuscript files that are valid UTF-8."""
        rows = self.files.where("role = 'manuscript'").select("relpath", F.expr("try_validate_utf8(cast(content as string))").alias("text"))
        return rows.where("text is not null")

    @cached_property
    def lines(self) -> DataFrame:
        return T.lines(self.prose, "text", "relpath")

    @cached_property
    def constitution(self) -> str | None:
        rows = self.files.where("role = 'constitution'").select("content").take(1)
        try:
            return bytes(rows[0][0]).decode() if rows else None
        except UnicodeDecodeError:
            return None

    @cached_property
    def store(self) -> Store:
        return Store(self.spark, "rules")

    def kept(self, df: DataFrame) -> DataFrame:
        """df as a table, for what several findings of a rule read."""
        return self.store.save(df)

    @cached_property
    def best_paths(self) -> DataFrame:
        """(uri, source): the best provenance path of every node, made once for all rules."""
        return self.kept(facts.best_path(facts.provenance(self.graph)))

    def names(self, concept: str) -> DataFrame:
        """(name, relpath) of a concept's records."""
        return self.build.records.where(F.col("concept") == concept).select("name", "relpath")

    def sourced(self, df: DataFrame, column: str) -> DataFrame:
        """df with ``source``: the best provenance path of a column, in one join."""
        return df.join(self.best_paths.withColumnRenamed("uri", column), column, "left")


def finding(df: DataFrame, validator: str, severity: str | Column, message: Column, source: Column, triple: list[Column] | Column | None = None) -> DataFrame:
    kind = "array<struct<s:string,p:string,o:string>>"
    t = F.array().cast(kind) if triple is None else triple.cast(kind) if isinstance(triple, Column) else F.array(F.struct(*[c.alias(n) for c, n in zip(triple, "spo", strict=True)])).cast(kind)
    return df.select(F.lit(validator).alias("validator"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), message.alias("message"), source.alias("source"), t.alias("triples"))


def union(frames: Iterable[DataFrame]) -> DataFrame:
    out = None
    for df in frames:
        out = df if out is None else out.unionByName(df)
    return out


RULES: dict[str, Callable[[Context], Result | DataFrame]] = {}


def rule(name: str) -> Callable:
    def register(f: Callable) -> Callable:
        RULES[name] = f
        return f

    return register


@rule("character_presence")
def character_presence(c: Context) -> DataFrame:
    roster = c.names("character")
    if not roster.take(1) and not c.prose.take(1):
        raise NotEvaluated("there is no manuscript prose and no bible character roster to cross-check")
    absent = roster.join(mentioned(roster.select("name").distinct(), c.prose), "name", "left_anti")
    return finding(absent, "character_presence", "error", F.format_string("character '%s' is defined in the bible but never mentioned in the manuscript", "name"), F.col("relpath"))


@rule("character_unknown_mentions")
def character_unknown_mentions(c: Context) -> Result:
    # Fixed value: this reason.
    why = "open-set proper-noun discovery requires semantic judgment (move 3); the deterministic heuristic was measured insufficient on real prose"
    return Result(None, [Abstention(why, "pending_capability", "undeclared_characters")])


# Antonym groups of place descriptors.
LEXICON = (
    ("coastal", "inland"),
    ("costera", "costero", "interior"),
    ("urban", "rural"),
    ("urbana", "urbano", "rural"),
    ("mountainous", "flat"),
    ("montañosa", "montañoso", "llana", "llano"),
    ("tropical", "arctic"),
    ("desert", "forest"),
    ("desierto", "bosque"),
)


def descriptor_clashes(places: DataFrame, lines: DataFrame, groups: tuple = LEXICON) -> DataFrame:
    """(name, group, term_a, file_a, line_a, term_b, file_b, line_b): the first pair of a group's terms whose first places lie in different files.

    places: (name, relpath) of files that mention a name; lines: (relpath, number, raw).
    """
    terms = sorted({t for g in groups for t in g})
    pattern = "(?iU)\\b(" + "|".join(terms) + ")\\b"
    said = lines.select("relpath", "number", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("raw", F.lit(pattern), F.lit(1)), F.lower))).alias("term"))
    first = said.groupBy("relpath", "term").agg(F.min("number").alias("number"))
    first = first.join(places.distinct(), "relpath").groupBy("name", "term").agg(F.min(F.struct("relpath", "number")).alias("at"))
    order = F.create_map(*[F.lit(x) for i, g in enumerate(groups) for j, t in enumerate(g) for x in (f"{i}|{t}", j)])
    member = F.create_map(*[F.lit(x) for t in terms for x in (t, ",".join(str(i) for i, g in enumerate(groups) if t in g))])
    ranked = first.select("name", "term", "at", F.explode(F.split(member[F.col("term")], ",")).alias("g"))
    ranked = ranked.withColumn("n", order[F.concat_ws("|", "g", "term")])
    a, b = ranked.alias("a"), ranked.alias("b")
    pairs = a.join(b, (F.col("a.name") == F.col("b.name")) & (F.col("a.g") == F.col("b.g")) & (F.col("a.n") < F.col("b.n")) & (F.col("a.at.relpath") != F.col("b.at.relpath")))
    row = F.struct(F.col("a.n").alias("n"), F.col("b.n").alias("m"), F.col("a.term").alias("ta"), F.col("a.at").alias("aa"), F.col("b.term").alias("tb"), F.col("b.at").alias("ab"))
    best = pairs.groupBy(F.col("a.name").alias("name"), F.col("a.g").cast("int").alias("group")).agg(F.min(row).alias("r"))
    return best.select("name", "group", F.col("r.ta").alias("term_a"), F.col("r.aa.relpath").alias("file_a"), F.col("r.aa.number").alias("line_a"), F.col("r.tb").alias("term_b"), F.col("r.ab.relpath").alias("file_b"), F.col("r.ab.number").alias("line_b"))


@rule("setting_continuity")
def setting_continuity(c: Context) -> DataFrame:
    if not c.prose.take(1):
        raise NotEvaluated("the manuscript is empty")
    names = c.names("setting").select("name").distinct()
    places = where_said(names.withColumn("needle", F.col("name")), c.prose, "text", "relpath").select("name", "relpath")
    clash = descriptor_clashes(places, c.lines)
    message = F.format_string("setting '%s' is described as '%s' (%s:%d) and '%s' (%s:%d) — contradicting descriptors across files", "name", "term_a", "file_a", "line_a", "term_b", "file_b", "line_b")
    return finding(clash, "setting_continuity", "warning", message, F.concat_ws(":", "file_a", F.col("line_a").cast("string")))


# The declaration's form and the first-person pronouns.
DECLARATION = re.compile(r"^\s*(?:\*\*|\*|_)*\s*(?:voz narrativa|narrative voice)(?:\*\*|\*|_)*\s*:\s*(?P<body>.+)$", re.I)
FIRST_PERSON = "(?iU)(?<![\\wáéíóúñ])(yo|nosotros|nosotras|i|we)(?![\\wáéíóúñ])"


def first_markers(lines: DataFrame, pattern: str) -> DataFrame:
    """(relpath, number, marker): the first line a file, outside of dialogue, that matches."""
    hit = lines.where(~T.is_dialogue(F.col("raw")) & F.col("raw").rlike(pattern))
    first = hit.groupBy("relpath").agg(F.min_by(F.struct("number", "raw"), "number").alias("r"))
    return first.select("relpath", "r.number", F.regexp_extract("r.raw", pattern, 1).alias("marker"))


def voice(text: str | None) -> tuple[str, bool]:
    """(person, limited) of a constitution's declaration."""
    if text is None:
        raise NotEvaluated("there is no constitution to read the narrative voice from")
    bare = (re.sub(r"^(?:#{1,6}\s+|\s*[-*+>]\s+|\s*[—–―]\s*)+", "", line) for line in text.splitlines())
    found = next((m for line in bare if (m := DECLARATION.match(line))), None)
    if found is None:
        raise NotEvaluated("the constitution does not declare a narrative voice")
    if re.match(T.PLACEHOLDER, found["body"]):
        raise NotEvaluated("the narrative-voice declaration is still unanswered ([PENDING])")
    has = lambda words: re.search(rf"\b({words})\b", found["body"], re.I) is not None
    if has("tercera|third"):
        return "third", has("limitada|limitado|limited")
    if has("primera|first"):
        return "first", False
    raise NotEvaluated("the narrative-voice declaration names no grammatical person (neither first nor third)")


@rule("focalization")
def focalization(c: Context) -> Result:
    person, limited = voice(c.constitution)
    if person == "first":
        return Result()
    # These two reasons.
    notes = [Abstention("full first-person recall requires semantic judgment (move 3); the deterministic check only covers the explicit subject pronoun", "pending_capability", "first_person_recall")]
    if limited:
        notes.insert(0, Abstention("head-hopping / interiority attribution requires semantic judgment (move 3); the deterministic heuristic was measured nearly dormant on real prose", "pending_capability", "head_hopping"))
    message = F.format_string("first-person marker '%s' outside dialogue, but the constitution declares a third-person narrative voice", "marker")
    hits = first_markers(c.lines, FIRST_PERSON)
    return Result(finding(hits, "focalization", "warning", message, F.concat_ws(":", "relpath", F.col("number").cast("string"))), notes)


def contradictions(rel: DataFrame, spans: DataFrame) -> DataFrame:
    """(a, rel, b, message) where years contradict a relation; touching bounds are allowed."""
    x, y = spans.select(F.col("uri").alias("a"), F.struct("begin", "end").alias("x")), spans.select(F.col("uri").alias("b"), F.struct("begin", "end").alias("y"))
    pairs = rel.where("rel <> 'overlaps'").unionByName(facts.unordered(rel.where("rel = 'overlaps'")).select("a", F.lit("overlaps").alias("rel"), "b"))
    both = pairs.join(x, "a", "left").join(y, "b", "left")
    a, b = T.label_of(F.col("a")), T.label_of(F.col("b"))
    c = lambda name: F.col(name)
    holds = lambda outer, inner: F.coalesce(c(f"{outer}.begin") > c(f"{inner}.begin"), F.lit(False)) | F.coalesce(c(f"{outer}.end") < c(f"{inner}.end"), F.lit(False))
    apart = T.disjoint(c("x.begin"), c("x.end"), c("y.begin"), c("y.end"))
    message = (
        F.when((c("rel") == "follows") & (c("x.begin") < c("y.end")), F.format_string("'%s' (begins %d) is asserted to follow '%s' (ends %d), but starts before it ends", a, "x.begin", b, "y.end"))
        .when((c("rel") == "precedes") & (c("x.end") > c("y.begin")), F.format_string("'%s' (ends %d) is asserted to precede '%s' (begins %d), but ends after it begins", a, "x.end", b, "y.begin"))
        .when((c("rel") == "overlaps") & apart & (c("x.end") < c("y.begin")), F.format_string("'%s' (ends %d) and '%s' (begins %d) are asserted to overlap, but their year ranges are disjoint", a, "x.end", b, "y.begin"))
        .when((c("rel") == "overlaps") & apart, F.format_string("'%s' (begins %d) and '%s' (ends %d) are asserted to overlap, but their year ranges are disjoint", a, "x.begin", b, "y.end"))
        .when((c("rel") == "includes") & holds("x", "y"), F.format_string("'%s' is asserted to contain '%s', but its year range does not enclose it", a, b))
        .when((c("rel") == "included_in") & holds("y", "x"), F.format_string("'%s' is asserted to contain '%s', but its year range does not enclose it", b, a))
    )
    return both.select("a", "rel", "b", message.alias("message")).where("message is not null")


def with_order(rel: DataFrame, before: DataFrame) -> DataFrame:
    """The relations whose two events are also strictly ordered, either way."""
    ordered = facts.unordered(before.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("a").alias("lo"), F.col("b").alias("hi"))
    return rel.join(ordered, (F.least("a", "b") == F.col("lo")) & (F.greatest("a", "b") == F.col("hi")), "left_semi")


def ordered_overlaps(rel: DataFrame, before: DataFrame) -> DataFrame:
    """(a, b), the least first, of events that overlap and are strictly ordered."""
    return with_order(facts.unordered(rel.where("rel = 'overlaps'")), before)


def ordered_containments(rel: DataFrame, before: DataFrame) -> DataFrame:
    """(a, rel, b) of events of which one contains the other and that are strictly ordered."""
    return with_order(rel.where(F.col("rel").isin("includes", "included_in")), before)


@rule("temporal")
def temporal(c: Context) -> DataFrame:
    rel, spans = facts.relations(c.graph), facts.intervals(c.graph)
    before = facts.strict_order(rel)
    name = "temporal"
    loops = cycles(before.select(F.col("x").alias("a"), F.col("y").alias("b")))
    x = loops.select(F.col("node").alias("x"), F.col("component").alias("cx"))
    y = loops.select(F.col("node").alias("y"), F.col("component").alias("cy"))
    cited = before.join(x, "x").join(y, "y").where("cx = cy").groupBy("cx").agg(F.sort_array(F.collect_set("triple")).alias("triples"))
    members = loops.groupBy("component").agg(F.array_join(F.sort_array(F.collect_set(T.label_of(F.col("node")))), ", ").alias("names"))
    rows = c.sourced(members.join(cited, F.col("component") == F.col("cx")), "component")
    message = F.format_string("temporal cycle: events {%s} are each asserted to come before another in the group (follows/precedes form a loop)", "names")
    out = [finding(rows, name, "error", message, F.col("source"), F.col("triples"))]
    predicate = F.create_map(*[F.lit(v) for k, p in V.RELATIONS.items() for v in (k, p)])
    cite = [F.col("a"), predicate[F.col("rel")], F.col("b")]
    a, b = T.label_of(F.col("a")), T.label_of(F.col("b"))
    over = ordered_overlaps(rel, before).select("a", F.lit("overlaps").alias("rel"), "b", F.format_string("'%s' and '%s' are asserted to overlap, yet one is also strictly ordered before the other", a, b).alias("message"))
    inside = ordered_containments(rel, before)
    inside = inside.select("a", "rel", "b", F.format_string("'%s' and '%s' are in a relation of containment (%s), though one of them lies strictly before the other", a, b, "rel").alias("message"))
    pairs = over.unionByName(inside).unionByName(contradictions(rel, spans))
    out.append(finding(c.sourced(pairs, "a"), name, "error", F.col("message"), F.col("source"), cite))
    return union(out)


@rule("factual_anchor")
def factual_anchor(c: Context) -> Result | DataFrame:
    if not c.config.research:
        return Result()
    graph, base = c.graph, c.config.uri_base
    anchors = c.kept(facts.anchors(graph))
    known = c.build.anchors.select(F.col("uri").alias("anchor"), F.concat_ws(" -> ", "promotes_id", "constrains_name").alias("handle"), F.col("relpath").alias("source_file"))
    named = anchors.join(known, "anchor", "left").withColumn("handle", F.coalesce("handle", T.label_of(F.col("anchor"))))
    backed = facts.supports(graph, anchors)
    have_finding = facts.present(graph, anchors.select("promotes").distinct(), base, "promotes").withColumn("has_finding", F.lit(True))
    have_target = facts.present(graph, anchors.select("constrains").where("constrains is not null").distinct(), base, "constrains").withColumn("has_target", F.lit(True))
    verdict = facts.verdicts(anchors, backed, facts.ratings(graph), c.config.min_reliability)
    full = named.join(have_finding, "promotes", "left").join(have_target, "constrains", "left").join(verdict, "anchor", "left").fillna(False, ["has_finding", "has_target"])
    promotes = [F.col("anchor"), F.lit(V.PROMOTES), F.col("promotes")]
    note = lambda df, message, triple, severity="warning": finding(df, "factual_anchor", severity, message, F.col("source_file"), triple)
    minimum = F.lit(c.config.min_reliability)
    lacking = facts.missing_facets(graph, backed, c.config.language).join(named, "anchor")
    spans = facts.intervals(graph)
    timeline = facts.bounds_of(spans).select(F.lit(f"{base}timeline").alias("constrains"), F.col("begin").alias("tb"), F.col("end").alias("te"))
    dated = spans.select(F.col("uri").alias("constrains"), F.col("begin").alias("tb"), F.col("end").alias("te")).unionByName(timeline)
    spanned = named.where("begin is not null or end is not null").join(dated, "constrains").where(T.disjoint(F.col("begin"), F.col("end"), F.col("tb"), F.col("te")))
    cited = F.when(F.col("constrains").isNotNull(), F.struct(F.col("anchor").alias("s"), F.lit(V.CONSTRAINS).alias("p"), F.col("constrains").alias("o"))).otherwise(F.struct(F.col("anchor").alias("s"), F.lit(V.PROMOTES).alias("p"), F.col("promotes").alias("o")))
    return union(
        [
            note(full.where("has_finding and sources = 0"), F.format_string("anchor '%s' promotes a finding with no supporting source", "handle"), promotes),
            note(lacking, F.format_string("source '%s' backing anchor '%s' is missing its %s", T.label_of(F.col("source")), "handle", "facet"), [F.col("promotes"), F.lit(V.SUPPORTED_BY), F.col("source")]),
            note(full.where("verdict = 'under_reliable'"), F.format_string("anchor '%s' is backed only by sources below the minimum reliability '%s'", "handle", minimum), promotes),
            note(full.where("verdict = 'unrated'"), F.format_string("anchor '%s' is backed by sources but none carries a reliability rating (minimum required: '%s')", "handle", minimum), promotes),
            note(full.where("not has_finding"), F.format_string("anchor '%s' promotes a finding not present in the graph", "handle"), promotes),
            note(full.where("not has_target"), F.format_string("anchor '%s' constrains a narrative entity that is not present in the graph", "handle"), F.array(cited)),
            note(
                spanned,
                F.format_string("anchor '%s' (%s) constrains '%s' (%s), but their year ranges are disjoint (anachronism)", "handle", T.year_range(F.col("begin"), F.col("end")), T.label_of(F.col("constrains")), T.year_range(F.col("tb"), F.col("te"))),
                [F.col("anchor"), F.lit(V.CONSTRAINS), F.col("constrains")],
                "error",
            ),
        ]
    )


@rule("narrative_structure")
def narrative_structure(c: Context) -> DataFrame:
    name = "narrative_structure"
    orphans = c.sourced(facts.orphan_units(c.graph), "uri")
    said = F.coalesce("label", T.label_of(F.col("uri")))
    out = [finding(orphans, name, "warning", F.format_string("narrative unit '%s' belongs to no narrative sequence (orphan beat)", said), F.col("source"))]
    cards = c.config.paths["outline"].rstrip("/") + "/units/"
    lost = c.build.unresolved.where(F.startswith("relpath", F.lit(cards)))
    units = c.build.records.where("concept = 'narrative-unit'").select("relpath", F.concat(F.lit(f"{c.config.uri_base}narrative-unit/"), "slug").alias("uri"))
    rows = c.sourced(lost.join(units, "relpath"), "uri")
    message = F.format_string("narrative unit '%s' references role '%s' which resolves to no character role", "entity", "name")
    out.append(finding(rows, name, "warning", message, F.coalesce("source", "relpath")))
    return union(out)


@dataclass
class Report:
    """findings in total order, what was not judged, errors, and the rules that ran."""

    findings: DataFrame
    not_evaluated: list[tuple[str, str, str, str | None]]  # validator, reason, kind, code
    errors: list[tuple[str, str, str]]  # validator, message, phase
    ran: list[str]

    def ordered(self, scope: str | None = None, severity: str = "info") -> DataFrame:
        """The findings to show: of a file or folder, of a severity or more."""
        out = self.findings.where(rank(F.col("severity")) >= V.SEVERITY[severity])
        if scope:
            path = T.locator(F.col("source"))[0]
            out = out.where((path == scope) | F.startswith(path, F.lit(scope.rstrip("/") + "/")))
        return total_order(out)

    @cached_property
    def _counts(self) -> dict[str, int]:
        return {r.severity: r.n for r in severity_counts(self.findings).collect()}

    def counts(self) -> dict[str, int]:
        return {s: self._counts[s] for s in ("error", "warning", "info")}

    def failed(self) -> bool:
        """The gate: any error, whatever is shown."""
        return self.counts()["error"] > 0

    def green(self) -> bool:
        return not self.failed() and not any(kind == "missing_input" for _, _, kind, _ in self.not_evaluated)

    def payload(self, scope: str | None = None, severity: str = "info") -> dict:
        rows = self.ordered(scope, severity).collect()
        by: dict[str, list] = {}
        for r in rows:
            by.setdefault(r.validator, []).append({"severity": r.severity, "message": r.message, "source": r.source, "triples": [list(t) for t in r.triples]})
        return {"status": "failed" if self.failed() else "ok", "green": self.green(), "counts": self.counts(), "validators": by, "ran": self.ran, "not_evaluated": [dict(zip(("validator", "reason", "kind", "code"), n, strict=True)) for n in self.not_evaluated], "errors": [list(e) for e in self.errors]}


def severity_counts(findings: DataFrame) -> DataFrame:
    """(severity, n) of each severity, none left out."""
    every = findings.sparkSession.createDataFrame([(s, 0) for s in V.SEVERITY], "severity string, one int")
    return findings.select("severity", F.lit(1).alias("one")).union(every).groupBy("severity").agg(F.sum("one").cast("long").alias("n"))


def rank(severity: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in V.SEVERITY.items() for x in kv])[severity]


def total_order(findings: DataFrame) -> DataFrame:
    """Validator, severity from the gravest, source (none first), message, triples."""
    return findings.orderBy("validator", rank(F.col("severity")).desc(), F.coalesce("source", F.lit("")), "message", F.col("triples").cast("string"))


#: What a judge may read: the lines of the manuscript (relpath, number, raw, normalized) or the triples.
ROWS: dict[str, Callable[[Context], DataFrame]] = {"lines": lambda c: c.lines, "triples": lambda c: c.graph}


def judged(module: ModuleType) -> Callable[[Context], DataFrame]:
    """A rule whose class ``Judge`` reads rows on the executors, as a table function.

    The module names its ``ROWS``. ``Judge.eval(row)`` gets each row, ``Judge.terminate()`` the end; both may yield
    (severity, message, source). With a ``KEY`` one judge sees all rows of a value, by ``ORDER`` if there is one; they stream
    through it, so it holds what it chooses to keep. Without one the rows stay where they lie, and a judge sees some of them.
    """
    rows, key, order = ROWS[module.ROWS], getattr(module, "KEY", None), getattr(module, "ORDER", None)
    if order and not key:
        raise ValueError("ORDER needs a KEY")
    register_pickle_by_value(module)  # executors cannot import it

    def validate(c: Context) -> DataFrame:
        dealt = rows(c).asTable()
        if key:
            dealt = dealt.partitionBy(key).orderBy(order) if order else dealt.partitionBy(key)
        found = F.udtf(module.Judge, returnType="severity string, message string, source string")(dealt)
        named = F.when(F.col("severity").isin(list(V.SEVERITY)), F.col("severity")).otherwise(F.raise_error(F.concat(F.lit("no severity: "), F.coalesce("severity", F.lit("null")))))
        return finding(found.withColumn("severity", named), module.NAME, F.col("severity"), F.col("message"), F.col("source"))

    return validate


def discover(folder: str | Path | None) -> tuple[dict[str, Callable], list[tuple[str, str, str]]]:
    """Custom rules: each ``*.py`` of a folder defines ``NAME`` and ``validate(context)``, or ``NAME`` and a ``Judge`` of rows (see ``judged``).

    A broken or colliding one is an error record.
    """
    found: dict[str, Callable] = {}
    errors = []
    for path in sorted(Path(folder).glob("*.py")) if folder else []:
        try:
            spec = importlib.util.spec_from_file_location(f"custom_rule_{path.stem}", path)
            module = importlib.util.module_from_spec(spec)
            sys.modules[spec.name] = module
            spec.loader.exec_module(module)
            name, f = module.NAME, judged(module) if hasattr(module, "Judge") else module.validate
        except Exception as e:  # whatever a user's module raises is its record
            errors.append((path.stem, f"{type(e).__name__}: {e}", "load"))
            continue
        if name in RULES or name in found:
            errors.append((name, f"a rule named {name!r} exists already", "load"))
        else:
            found[name] = f
    return found, errors


def select(custom: dict[str, Callable], enabled: tuple[str, ...] = (), disabled: tuple[str, ...] = (), allowed: tuple[str, ...] = ()) -> dict[str, Callable]:
    """The active rules. Names that no rule has are an error; custom rules run where the manifest lists them."""
    known = RULES | custom
    lost = [n for n in (*enabled, *disabled, *allowed) if n not in known]
    if lost:
        raise ValueError(f"unknown validator {lost[0]!r}")
    active = {n: f for n, f in RULES.items() if (not enabled or n in enabled) and n not in disabled}
    return active | {n: custom[n] for n in allowed if n not in disabled and n in custom}


def run_rules(context: Context, active: dict[str, Callable] | None = None, errors: list | None = None) -> Report:
    """Runs each rule on its own; its findings are materialised here, so that its faults stay its own."""
    store = context.store
    frames, notes, faults, ran = [], [], list(errors or []), []
    for name, f in sorted((RULES if active is None else active).items()):
        try:
            result = f(context)
            result = result if isinstance(result, Result) else Result(result)
            if result.findings is not None:
                frames.append(store.save(result.findings.select("validator", "severity", "message", "source", "triples")))
            notes += [(name, a.reason, a.kind, a.code) for a in result.abstentions]
        except NotEvaluated as e:
            notes.append((name, e.abstention.reason, e.abstention.kind, e.abstention.code))
            continue
        except Exception as e:  # isolation: any fault of a rule is a record
            faults.append((name, f"{type(e).__name__}: {e}".splitlines()[0], "run"))
            continue
        ran.append(name)
    found = union(frames) if frames else context.spark.createDataFrame([], FINDING)
    notes += [("ingestion", f"{r.relpath}: {r.reason}", "missing_input", None) for r in context.build.skipped.orderBy("relpath", "reason").collect()]
    return Report(found.dropDuplicates(), sorted(set(notes), key=lambda n: (n[0], n[1])), faults, ran)
