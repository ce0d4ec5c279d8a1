"""The commands: ``python -m lorespark graph build | graph query | validate | status``.

Each works on the project around the current folder, or on --root. With --json one line of
JSON goes to stdout, of a result or of an error; otherwise text does, and errors go to stderr.

Exit codes: 0 done; 1 validation found an error; 2 a fault of usage, configuration or
research files; 3 a slug collision or an invalid query; 4 files were skipped.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import SparkSession

from . import api
from .operators.ingest import IngestError
from .plans.parser import QueryError
from .plans.statistics import load_statistics
from .sources.project import Config, ConfigError, find_root, load_manifest, read_files
from .sources.turtle import TurtleError, load_graph, save_graph, write_turtle
from .sources.turtle_scan import read_turtle
from .vocabulary import PREFIXES, SEVERITY


class Failure(Exception):
    """An error with its exit code and its name in the JSON document."""

    def __init__(self, exit_code: int, code: str, message: str, details: object = None):
        super().__init__(message)
        self.exit_code, self.code, self.details = exit_code, code, details


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lorespark")
    parser.add_argument("--root", help="a folder of the project")
    commands = parser.add_subparsers(dest="command", required=True)
    graph = commands.add_parser("graph").add_subparsers(dest="graph_command", required=True)
    build = graph.add_parser("build", help="derive the graph and write it as Turtle")
    build.add_argument("--force", action="store_true", help="build anew, as every build does")
    query = graph.add_parser("query", help="run a SELECT over the written graph")
    query.add_argument("sparql")
    validate = commands.add_parser("validate", help="run the rules")
    validate.add_argument("--scope", help="show findings of this file or folder only")
    validate.add_argument("--severity", choices=list(SEVERITY), default="info", help="show findings of this severity or more")
    status = commands.add_parser("status", help="open work and what to do next")
    for command in (build, query, validate, status):
        command.add_argument("--json", action="store_true")
    return parser


def _project(start: str | None) -> tuple[Path, Config]:
    root = find_root(start or ".")
    if root is None:
        raise Failure(2, "project_not_found", "no manifest.toml here or in a folder above")
    return root, load_manifest(root / "manifest.toml")


#: The graph of the last build as Parquet, with its statistics, and the stamp of the Turtle file it equals.
STORED = Path(".lorespark", "graph")


def _stamp(path: Path) -> str:
    found = path.stat()
    return f"{found.st_mtime_ns} {found.st_size}"


def _build(spark: SparkSession, root: Path, config: Config, args: argparse.Namespace) -> tuple[int, str]:
    built = api.build_graph(spark, str(root), config)
    path, kept = root / config.paths["graph"], root / STORED
    (kept / "stamp").unlink(missing_ok=True)
    write_turtle(built.graph, str(path), PREFIXES)
    save_graph(built.graph, str(kept / "triples"))
    (kept / "stamp").write_text(_stamp(path))
    report = built.report() | {"manifest_warnings": list(config.warnings)}
    code = report.pop("exit_code")
    if args.json:
        return code, api.success(**report)
    notes = [f"skipped {path}: {reason}" for path, reason in report["skipped"]]
    return code, "\n".join([*notes, ", ".join(f"{report[k]} {k}" for k in ("files", "entities", "sources", "findings", "anchors", "triples"))]) + "\n"


def _query(spark: SparkSession, root: Path, config: Config, args: argparse.Namespace) -> tuple[int, str]:
    path = root / config.paths["graph"]
    if not path.is_file():
        raise Failure(2, "graph_not_built", f"there is no graph at {config.paths['graph']}; build it first")
    kept = root / STORED
    if (kept / "stamp").is_file() and (kept / "stamp").read_text() == _stamp(path):
        found = api.query(load_graph(spark, str(kept / "triples")), args.sparql, load_statistics(spark, str(kept / "triples")))
    else:  # a file from elsewhere, or one that was edited
        found = api.query(read_turtle(spark, str(path)), args.sparql)
    if not args.json:
        return 0, api.table(found)
    rows = [{k: v for k, v in r.asDict().items() if v is not None} for r in found.collect()]  # a person's or a tool's answer
    return 0, api.success(results=rows, count=len(rows))


def _scope(root: Path, scope: str | None) -> str | None:
    if scope is None:
        return None
    path = (Path(scope) if Path(scope).is_absolute() else Path.cwd() / scope).resolve()
    path = path if path.exists() else (root / scope).resolve()
    if not path.exists() or not path.is_relative_to(root.resolve()):
        raise Failure(2, "invalid_scope", f"{scope!r} is no path of the project")
    return str(path.relative_to(root.resolve()))


def _rules_folder(root: Path) -> str | None:
    folder = root / "validators"
    return str(folder) if folder.is_dir() else None


def _validate(spark: SparkSession, root: Path, config: Config, args: argparse.Namespace) -> tuple[int, str]:
    scope = _scope(root, args.scope)
    built = api.build_graph(spark, str(root), config)
    report = api.validate(built, read_files(spark, str(root), config), _rules_folder(root))
    text = api.success(**{"verdict" if k == "status" else k: v for k, v in report.payload(scope, args.severity).items()}) if args.json else api.render(report, scope, args.severity)
    return int(report.failed()), text


def _status(spark: SparkSession, root: Path, config: Config, args: argparse.Namespace) -> tuple[int, str]:
    try:
        state, actions = api.project_status(spark, str(root), config, _rules_folder(root))
    except api.PartialCorpus as e:
        raise Failure(4, "skipped_sources", str(e)) from e
    text = api.status_document(state, actions, root / ".lorespark" / "status.json")
    if args.json:
        return 0, text
    facts = asdict(state)
    lines = [f"{facts['entities']} entities, {len(state.open_questions)} open questions, {len(state.unresolved_anchors)} unresolved anchors, {len(state.low_reliability)} weak findings"]
    return 0, "\n".join([*lines, *[f"{i}. {a.prompt} ({a.reason})" for i, a in enumerate(actions, 1)]]) + "\n"


COMMANDS = {"build": _build, "query": _query, "validate": _validate, "status": _status}


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs one command and gives its exit code."""
    try:
        args = _parser().parse_args(argv)
    except SystemExit as e:  # usage, or --help
        return int(e.code or 0)
    try:
        root, config = _project(args.root)
        spark = spark or SparkSession.builder.appName("lorespark").getOrCreate()
        name = args.graph_command if args.command == "graph" else args.command
        code, text = COMMANDS[name](spark, root, config, args)
        sys.stdout.write(text)
        return code
    except Failure as e:
        failure = e
    except QueryError as e:
        failure = Failure(3, "invalid_query", str(e))
    except IngestError as e:
        failure = Failure(3 if e.code == "slug_collision" else 2, e.code, str(e))
    except (ConfigError, TurtleError, ValueError) as e:
        failure = Failure(2, "invalid_configuration", str(e))
    if args.json:
        sys.stdout.write(api.failure(failure.code, str(failure), failure.details))
    else:
        sys.stderr.write(f"error: {failure}\n")
    return failure.exit_code
