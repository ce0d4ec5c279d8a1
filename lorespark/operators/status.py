"""Status: what a project's graph still lacks, and what to do next."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from . import facts
from .ingest import Build
from .rules import Report


def open_questions(graph: DataFrame, findings: DataFrame, mark: str = V.OPEN, said: str = V.CLAIM) -> DataFrame:
    """(id, text, file) of open findings, by file and id. findings: uri, id, relpath as authored; mark is true of open ones, said is their text."""
    open_ = graph.where((F.col("p") == mark) & (F.col("o") == "true") & (F.col("o_kind") == "lit")).select(F.col("s").alias("uri")).distinct()
    rows = open_.join(facts.of(graph, said, "uri", "text"), "uri", "left").join(findings, "uri")
    return rows.select("id", "text", F.col("relpath").alias("file")).orderBy("file", "id")


def low_reliability(graph: DataFrame, findings: DataFrame, minimum: str) -> DataFrame:
    """(id, best_reliability, file) of findings with a source whose best is under the minimum; unrated is lowest."""
    best = facts.best_support(facts.of(graph, V.SUPPORTED_BY, "uri", "source"), facts.ratings(graph), "uri")
    best = best.select("uri", F.coalesce("best", F.lit(-1)).alias("best"))
    names = F.create_map(*[F.lit(x) for i, r in enumerate(V.RELIABILITY) for x in (i, r)])
    rows = best.where(F.col("best") < V.RELIABILITY.index(minimum)).join(findings, "uri")
    return rows.select("id", F.try_element_at(names, F.col("best")).alias("best_reliability"), F.col("relpath").alias("file")).orderBy("file", "id")


def anchor_gaps(graph: DataFrame, identities: DataFrame, minimum: str, uri_base: str) -> DataFrame:
    """(promotes, constrains, file, problems) of anchors that lack support or a target; problems sorted."""
    anchors = facts.anchors(graph).join(identities.withColumnRenamed("uri", "anchor"), "anchor")
    found = facts.present(graph, anchors.select("promotes").distinct(), uri_base, "promotes").withColumn("f", F.lit(True))
    aimed = facts.present(graph, anchors.select("constrains").where("constrains is not null").distinct(), uri_base, "constrains").withColumn("t", F.lit(True))
    said = facts.verdicts(anchors, facts.supports(graph, anchors), facts.ratings(graph), minimum)
    rows = anchors.join(found, "promotes", "left").join(aimed, "constrains", "left").join(said, "anchor", "left").fillna(False, ["f", "t"])
    verdict = F.col("verdict")
    problems = facts.problem_set({"missing_finding": ~F.col("f"), "unsourced": F.col("f") & (F.col("sources") == 0), "unrated": verdict == "unrated", "under_reliable": verdict == "under_reliable", "missing_target": ~F.col("t")})
    rows = rows.select(F.col("promotes_id").alias("promotes"), F.col("constrains_name").alias("constrains"), F.col("relpath").alias("file"), problems.alias("problems"))
    return rows.where(F.size("problems") > 0).orderBy("file", "promotes", F.coalesce("constrains", F.lit("")))


@dataclass
class State:
    """The facts that the action table reads. Items are small lists of an author's open work."""

    entities: int = 0
    available: bool = True
    focus: bool = False
    open_questions: list = field(default_factory=list)  # id, text, file
    unresolved_anchors: list = field(default_factory=list)  # promotes, constrains, file, problems
    low_reliability: list = field(default_factory=list)  # id, best_reliability, file
    counts: dict = field(default_factory=lambda: {"error": 0, "warning": 0, "info": 0})
    not_evaluated: list = field(default_factory=list)  # validator, reason, kind, code


def aggregate(build: Build, report: Report) -> State:
    c = build.config
    rows = lambda df: [tuple(r) for r in df.collect()]
    return State(
        build.records.where("concept not in ('source', 'finding', 'anchor')").count(),
        True,
        c.focus is not None,
        rows(open_questions(build.graph, build.findings)),
        rows(anchor_gaps(build.graph, build.anchors, c.min_reliability, c.uri_base)),
        rows(low_reliability(build.graph, build.findings, c.min_reliability)),
        report.counts(),
        report.not_evaluated,
    )


@dataclass(frozen=True)
class Action:
    name: str
    prompt: str
    reason: str


def _count(n: int, noun: str) -> str:
    return f"{n} {noun}" + "s" * (n != 1)


def _research(s: State) -> Action:
    parts = ["Work through the research queue."]
    if s.open_questions:
        parts.append("Open questions: " + "; ".join(f"{i}: {t}" if t is not None else i for i, t, _ in s.open_questions) + ".")
    if s.unresolved_anchors:
        parts.append("Anchors needing support: " + "; ".join(" -> ".join(filter(None, (p, c))) for p, c, *_ in s.unresolved_anchors) + ".")
    parts.append("Record each finding with its sources under bible/research/.")
    return Action("research_queue", " ".join(parts), f"{_count(len(s.open_questions), 'open research question')} and {_count(len(s.unresolved_anchors), 'unresolved anchor')}")


# Fixed value: the sentences around the list.
def _verify(s: State) -> Action:
    said = "; ".join(f"{i} (best support: {r})" if r else f"{i} (unrated)" for i, r, _ in s.low_reliability)
    return Action("verify_findings", f"Verify the findings whose support is below the project threshold: {said}. Strengthen each with more reliable sources or revise its claim.", f"{_count(len(s.low_reliability), 'finding')} with low-reliability support")


# What would let a dormant rule judge.
REMEDIES = {
    "focalization": "declare the narrative voice in the constitution",
    "setting_continuity": "add manuscript prose to validate",
    "character_presence": "add a bible character roster and manuscript prose",
}


def _dormant(s: State) -> list:
    return [n for n in s.not_evaluated if n[2] == "missing_input"]


def _activate(s: State) -> Action:
    said = "; ".join(f"{n[0]} — {REMEDIES.get(n[0], 'investigate why it could not evaluate')}" for n in _dormant(s))
    return Action("activate_dormant_validators", f"Activate the dormant validators: {said}.", f"{_count(len(_dormant(s)), 'validator')} could not evaluate")


def _pending(validator: str, code: str) -> Callable[[State], bool]:
    return lambda s: any((n[0], n[2], n[3]) == (validator, "pending_capability", code) for n in s.not_evaluated)


def _fixed(name: str, prompt: str, reason: str) -> Callable[[State], Action]:
    return lambda s: Action(name, prompt, reason)


# The reasons of bootstrap_graph, judge_undeclared_characters and define_focus.
#: (applies, build) in order of priority. The first one, where it applies, stands alone.
TABLE: list[tuple[Callable[[State], bool], Callable[[State], Action]]] = [
    (lambda s: not s.available or s.entities == 0, _fixed("bootstrap_graph", "Write the story bible (characters, settings, timeline), then build the graph.", "the knowledge graph has no entities to reason over yet")),
    (lambda s: bool(s.open_questions or s.unresolved_anchors), _research),
    (lambda s: bool(s.low_reliability), _verify),
    (lambda s: s.counts.get("error", 0) > 0, lambda s: Action("review_continuity", "Look into every error that validation reports and mend it in the file that it names.", _count(s.counts["error"], "validation error"))),
    (lambda s: bool(_dormant(s)), _activate),
    (_pending("character_unknown_mentions", "undeclared_characters"), _fixed("judge_undeclared_characters", "Read the manuscript for names of persons that no sheet in bible/characters/ declares.", "character_unknown_mentions abstained — open-set proper-noun discovery is a capability gap")),
    (_pending("focalization", "head_hopping"), _fixed("judge_head_hopping", "Judge by chapter whether the prose tells the inner life of a character other than the focal one.", "the focalization rule leaves it to a reader whether heads are hopped")),
    (_pending("focalization", "first_person_recall"), _fixed("judge_first_person_recall", "Judge by passage whether the prose slides into the first person, verb forms without a pronoun included.", "the focalization rule leaves it to a reader whether the first person slips in")),
    (lambda s: not s.focus, _fixed("define_focus", "Define the current working focus.", "no authored focus is defined")),
]


def next_actions(state: State) -> list[Action]:
    """Recommendations in order; an empty list is a healthy project's answer."""
    found = [build(state) for applies, build in TABLE if applies(state)]
    return found[:1] if found and found[0].name == "bootstrap_graph" else found
