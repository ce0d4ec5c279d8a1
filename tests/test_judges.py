"""Custom rules that judge rows on the executors."""

import pytest

from lorespark.operators.ingest import build
from lorespark.operators.rules import RULES, Context, discover, run_rules, select
from lorespark.sources.project import Config, files_from

LONG = """
NAME = "long_lines"
ROWS = "lines"
LIMIT = 20


class Judge:
    def eval(self, row):
        if len(row["raw"]) > LIMIT:
            yield "warning", f"line {row['number']} is long", f"{row['relpath']}:{row['number']}"
"""
REPEATED = """
NAME = "repeated_lines"
ROWS, KEY, ORDER = "lines", "relpath", "number"


class Judge:
    def __init__(self):
        self.last, self.n, self.path = None, 0, None

    def eval(self, row):
        self.n, self.path = self.n + 1, row["relpath"]
        if row["raw"] == self.last:
            yield "error", "a line is said twice in a row", f"{row['relpath']}:{row['number']}"
        self.last = row["raw"]

    def terminate(self):
        yield "info", f"{self.n} lines", self.path
"""
NODES = """
NAME = "busy_nodes"
ROWS, KEY = "triples", "s"


class Judge:
    def __init__(self):
        self.s, self.n = None, 0

    def eval(self, row):
        self.s, self.n = row["s"], self.n + 1

    def terminate(self):
        if self.n > 1:
            yield "info", "busy", self.s
"""
FAILS = "NAME, ROWS = 'fails', 'lines'\nclass Judge:\n    def eval(self, row):\n        raise RuntimeError('late')\n        yield\n"
UNGRADED = "NAME, ROWS = 'ungraded', 'lines'\nclass Judge:\n    def eval(self, row):\n        yield 'awful', 'm', None\n"
BROKEN = {"nowhere": "NAME, ROWS = 'nowhere', 'chapters'\nclass Judge:\n    pass\n", "unkeyed": "NAME, ROWS, ORDER = 'unkeyed', 'lines', 'number'\nclass Judge:\n    pass\n"}


@pytest.fixture(scope="module")
def report(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("rules")
    for name, text in {"a": LONG, "b": REPEATED, "c": NODES, "d": FAILS, "e": UNGRADED, **BROKEN}.items():
        (folder / f"{name}.py").write_text(text)
    config = Config()
    texts = {"manuscript/one.md": "so\nso\nbut\n", "manuscript/two.md": "a line that goes on for a while\nso\n", "bible/characters/ann.md": "---\nname: Ann\nfeatures: [tall]\n---\n"}
    files = files_from(spark, texts, config)
    built = build(files, config)
    custom, errors = discover(folder)
    assert {e[0] for e in errors} == set(BROKEN)
    active = select(custom, disabled=tuple(RULES), allowed=("long_lines", "repeated_lines", "busy_nodes", "fails", "ungraded"))
    return built, run_rules(Context(built, files), active, errors)


def test_findings(report):
    built, found = report
    got = {(r.validator, r.severity, r.message, r.source) for r in found.findings.collect()}
    busy = {("busy_nodes", "info", "busy", s) for s in {r.s for r in built.graph.groupBy("s").count().where("count > 1").collect()}}
    assert busy and got == busy | {
        ("long_lines", "warning", "line 1 is long", "manuscript/two.md:1"),
        ("repeated_lines", "error", "a line is said twice in a row", "manuscript/one.md:2"),
        ("repeated_lines", "info", "3 lines", "manuscript/one.md"),
        ("repeated_lines", "info", "2 lines", "manuscript/two.md"),
    }


def test_a_fault_on_an_executor_is_a_record_and_the_others_run(report):
    _, found = report
    assert set(found.ran) == {"long_lines", "repeated_lines", "busy_nodes"}
    assert {e[0] for e in found.errors if e[2] == "run"} == {"fails", "ungraded"}


def test_build_counters_are_those_of_the_rows(spark, report):
    built, _ = report
    said = built.report()
    assert said["triples"] == built.graph.count() and said["entities"] == built.records.count() == 1 and said["files"] == 1


def test_counters_of_a_build_without_files(spark):
    config = Config()
    said = build(files_from(spark, {}, config), config).report()
    assert (said["files"], said["entities"], said["sources"], said["triples"]) == (0, 0, 0, 0)
