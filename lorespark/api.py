"""The engine's commands as functions: build, query, validate, status."""

from __future__ import annotations

import json
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .operators.ingest import Build, build
from .operators.rules import Context, Report, discover, run_rules, select
from .operators.status import Action, State, aggregate, next_actions
from .plans.compiler import sparql
from .plans.statistics import Statistics
from .sources.project import Config, ConfigError, missing_folder, read_files
from .vocabularies import packaged
from .vocabulary import PREFIXES


def build_graph(spark: SparkSession, root: str, config: Config, vocabularies: dict[str, DataFrame] | None = None) -> Build:
    """The graph of a project folder, with the packaged vocabularies that are active unless others are given."""
    if lost := missing_folder(root, config):
        raise ConfigError(f"there is no {lost} folder at {config.paths[lost]}")
    return build(read_files(spark, root, config), config, packaged(spark, config.vocabularies) if vocabularies is None else vocabularies)


def query(graph: DataFrame, text: str, known: Statistics | None = None) -> DataFrame:
    """A SPARQL query with the ten prefixes declared; statistics of the graph, where there are any, order its joins."""
    return sparql(graph, text, PREFIXES, known)


def validate(built: Build, files: DataFrame, custom_folder: str | None = None) -> Report:
    """Runs the active rules."""
    c = built.config
    custom, errors = discover(custom_folder)
    return run_rules(Context(built, files), select(custom, c.enabled, c.disabled, c.custom), errors)


class PartialCorpus(ValueError):
    """Files were skipped, so a status would speak of a part only."""


def status(built: Build, files: DataFrame, custom_folder: str | None = None) -> tuple[State, list]:
    """The state and the next actions. A build with skipped files is an error."""
    skipped = built.skipped.take(1)
    if skipped:
        raise PartialCorpus(f"partial corpus: {skipped[0].relpath}: {skipped[0].reason}")
    state = aggregate(built, validate(built, files, custom_folder))
    return state, next_actions(state)


def project_status(spark: SparkSession, root: str, config: Config, custom_folder: str | None = None) -> tuple[State, list]:
    """The same of a folder. Where there is nothing to build yet, that is the state, not an error."""
    if missing_folder(root, config):
        state = State(available=False, focus=config.focus is not None)
        return state, next_actions(state)
    return status(build_graph(spark, root, config), read_files(spark, root, config), custom_folder)


def success(**fields: object) -> str:
    """A one-line JSON document of a result."""
    return json.dumps({"status": "ok", **fields}, ensure_ascii=False, separators=(",", ":"), default=str) + "\n"


def failure(code: str, message: str, details: object = None) -> str:
    """A one-line JSON document of an error."""
    return json.dumps({"status": "error", "code": code, "message": message} | ({"details": details} if details is not None else {}), ensure_ascii=False, separators=(",", ":"), default=str) + "\n"


def table(df: DataFrame, limit: int = 1000) -> str:
    """Query rows as text in aligned columns; an unbound cell is empty. For reading: a last line tells of rows beyond limit."""
    found = df.limit(limit + 1).collect()
    rows = [df.columns, *[["" if v is None else str(v) for v in r] for r in found[:limit]]]
    wide = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    more = f"... and more than these {limit} rows\n" if len(found) > limit else ""
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, wide, strict=True)).rstrip() for r in rows) + "\n" + more


def render(report: Report, scope: str | None = None, severity: str = "info") -> str:
    """Findings grouped by rule, then what was not judged, as text. The filters touch findings only."""
    shown = report.payload(scope, severity)
    out = []
    for name, found in shown["validators"].items():
        out += [f"{name}:", *[f"  {f['severity']}: {f['message']}" + (f" ({f['source']})" if f["source"] else "") for f in found]]
    out += [f"not evaluated: {n['validator']}: {n['reason']}" for n in shown["not_evaluated"]]
    out += [f"error: {name}: {message}" for name, message, _ in shown["errors"]]
    out.append(", ".join(f"{n} {s}" for s, n in shown["counts"].items()))
    return "\n".join(out) + "\n"


def status_document(state: State, actions: list[Action], cache: str | Path | None = None) -> str:
    """The status as one line of JSON; the same bytes go to the cache file, if one is named."""
    text = success(state=asdict(state), next_actions=[asdict(a) for a in actions])
    if cache:
        Path(cache).parent.mkdir(parents=True, exist_ok=True)
        Path(cache).write_text(text, "utf-8")
    return text
