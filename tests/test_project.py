"""Ingestion, rules and status over small corpora of our own."""

import datetime

import pytest

from lorespark import vocabulary as V
from lorespark.api import failure, query, render, status, status_document, success, table, validate
from lorespark.functions.text import make_slug
from lorespark.operators.ingest import IngestError, build
from lorespark.operators.rules import RULES, Context, NotEvaluated, Report, discover, run_rules, select, voice
from lorespark.operators.status import State, next_actions
from lorespark.sources.frontmatter import HeadError, load_yaml, parse_frontmatter
from lorespark.sources.project import Config, ConfigError, files_from, find_root, load_manifest, read_files
from lorespark.sources.turtle import parse_turtle
from lorespark.terms import TRIPLE

C = Config(vocabularies=("greimas", "propp"))


def head(text, body=""):
    return f"---\n{text}\n---\n{body}"


MINI = {
    "bible/characters/ana.md": head("name: Ana María\nborn: 1800\nfeatures:\n  - brave\n  - Brave\nnarrative_roles: [Héroe]"),
    "bible/characters/tom.md": head("name: Tom"),
    "bible/settings/port.md": head("name: Port"),
    "bible/locations/pier.md": head("name: Pier\nsetting: port"),
    "bible/timeline.md": head("events:\n  - name: Storm\n    date: 1820\n    participants: [ana maria, Nobody]\n  - name: Calm\n    begin: 1825\n    follows: [Storm]"),
    "bible/relationships.md": head("relationships:\n  - name: Friends\n    participants: [Tom, ana-maria]"),
    "outline/units/u1.md": head("name: First\nsequence: Main\norder: 2\nroles: [héroe, villain]\nfunctions: [Departure]"),
    "outline/units/u2.md": head("name: Second\nsequence: main\norder: 1"),
    "outline/units/u3.md": head("name: Third\nsequence: Main"),
    "outline/units/u4.md": head("name: Alone\nfunctions: [departure, Return]"),
    "bible/research/sources.md": head(
        "sources:\n" + "".join(f"  - name: {n}\n    reference: r\n    author: a\n    original_language: {l}\n    type: primaria\n    reliability: {r}\n    reliability_justification: j\n    access_date: 2024-01-02\n    original_quote: q\n{t}" for n, l, r, t in (("Book", "en", "alta", ""), ("Rumour", "es", "baja", "    translation: t\n")))
    ),
    "bible/research/sea.md": head(
        "findings:\n  - id: f1\n    claim: c1\n    sources: [Book]\n    bears_on: Storm\n  - id: f2\n    claim: c2\n    sources: [Rumour]\n  - id: f3\n    open: true\n"
        "anchors:\n  - promotes: f1\n    constrains: Storm\n    begin: 1900\n  - promotes: f2\n    constrains: timeline\n    date: 1820\n  - promotes: f3\n    constrains: Nowhere"
    ),
    "bible/research/_index.md": head("open_questions:\n  - id: q1\n    claim: why"),
    "bible/constitution.md": "# Voice\n- **Narrative voice**: third person limited\n",
    "manuscript/one.md": "Ana walked to the coastal Port.\n— I said so.\nThen I left.\nWe too.",
    "manuscript/deep/two.md": "The inland port slept.",
}
GREIMAS = '@prefix crm: <http://www.cidoc-crm.org/cidoc-crm/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . <http://v/hero> a crm:E55_Type ; rdfs:label "hero"@en, "héroe"@es .'


@pytest.fixture(scope="module")
def project(spark):
    files = files_from(spark, MINI, C).cache()
    return build(files, C, {"greimas": spark.createDataFrame(parse_turtle(GREIMAS), TRIPLE)}), files


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_channels_and_counters(project):
    b, _ = project
    r = b.report()
    assert (r["entities"], r["sources"], r["findings"], r["anchors"], r["exit_code"]) == (11, 2, 4, 3, 0)
    assert r["unresolved_references"] == [("bible/timeline.md", "participants", "Storm", "Nobody"), ("outline/units/u1.md", "roles", "First", "villain")]
    assert r["warnings"] == [("bible/research/sea.md", "constrains", "Nowhere")]
    assert r["untyped_terms"] == [] and r["unknown_keys"] == []


def test_graph_answers(project):
    g = project[0].graph.cache()
    ask = lambda text: rows(query(g, text))
    base = C.uri_base
    assert ask("SELECT (COUNT(?x) AS ?n) { ?x a golem:G1_Character }") == [("2",)]
    assert ask(f"SELECT ?y {{ <{base}character/ana-maria/feature/bio/birth> crm:P43_has_dimension/crm:P90_has_value ?y }}") == [("1800",)]
    assert ask("SELECT ?l { ?x a golem:G17_Character_Feature ; rdfs:label ?l }") == [("brave",)]
    assert ask("SELECT ?t { ?r a golem:G11_Narrative_Role ; crm:P2_has_type ?t }") == [("http://v/hero",)]
    assert ask("SELECT ?n ?l { ?u bw:sequenceOrdinal ?n ; rdfs:label ?l }") == [("1", "Second"), ("2", "First"), ("3", "Third")]
    assert ask("SELECT ?l { ?f a golem:G10_Narrative_Function ; rdfs:label ?l }") == [("Departure",), ("Return",)]
    assert ask("SELECT ?e { ?e tr:follows ?x }") == [(f"{base}event/calm",)]
    assert ask(f'SELECT ?p {{ ?a crm:P141_assigned <{base}character/ana-maria/feature/brave> ; crm:P16_used_specific_object ?p }}') == [("bible/characters/ana.md:4",)]
    assert ask("SELECT ?q { ?f bw:open true OPTIONAL { ?f bw:claim ?q } }") == [("why",), (None,)]
    assert project[0].graph.count() == project[0].graph.distinct().count()


def test_build_is_repeatable(spark, project):
    again = build(files_from(spark, MINI, C).repartition(3), C, {"greimas": spark.createDataFrame(parse_turtle(GREIMAS), TRIPLE)})
    assert rows(again.graph) == rows(project[0].graph)


def test_rules(project):
    b, files = project
    report = validate(b, files)
    said = [(r.validator, r.severity, r.source, r.message) for r in report.ordered().collect()]
    assert report.errors == []
    assert [(v, s, src) for v, s, src, _ in said] == [
        ("character_presence", "error", "bible/characters/tom.md"),
        ("factual_anchor", "error", "bible/research/sea.md"),
        ("factual_anchor", "warning", "bible/research/sea.md"),
        ("factual_anchor", "warning", "bible/research/sea.md"),
        ("factual_anchor", "warning", "bible/research/sea.md"),
        ("focalization", "warning", "manuscript/one.md:3"),
        ("narrative_structure", "warning", "outline/units/u1.md:5"),
        ("narrative_structure", "warning", "outline/units/u4.md:3"),
        ("setting_continuity", "warning", "manuscript/one.md:1"),
    ]
    assert "anachronism" in said[1][3] and "(1900-?)" in said[1][3] and "(1820-1820)" in said[1][3]
    assert report.failed() and not report.green()
    assert {(n[0], n[3]) for n in report.not_evaluated} == {("character_unknown_mentions", "undeclared_characters"), ("focalization", "head_hopping"), ("focalization", "first_person_recall")}
    assert report.ordered(scope="manuscript").count() == 2 and report.ordered(severity="error").count() == 2
    assert report.payload()["counts"] == {"error": 2, "warning": 7, "info": 0}
    text = render(report, severity="error")
    assert text.startswith("character_presence:\n  error: ") and text.endswith("2 error, 7 warning, 0 info\n") and "orphan beat" not in text


def test_status(project, tmp_path):
    state, actions = status(*project)
    assert (tmp_path / "s.json").exists() is False
    assert status_document(state, actions, tmp_path / "s.json") == (tmp_path / "s.json").read_text("utf-8")
    assert table(query(project[0].graph, "SELECT ?l ?q { ?s a golem:G9_Narrative_Unit ; rdfs:label ?l OPTIONAL { ?s bw:open ?q } } ORDER BY ?l LIMIT 1")) == "l      q\nAlone\n"
    assert [q[0] for q in state.open_questions] == ["q1", "f3"]
    assert state.low_reliability == [("f2", "baja", "bible/research/sea.md")]
    assert [(p, c, list(x)) for p, c, _, x in state.unresolved_anchors] == [("f2", "timeline", ["under_reliable"]), ("f3", "Nowhere", ["missing_target", "unsourced"])]
    assert [a.name for a in actions] == ["research_queue", "verify_findings", "review_continuity", "judge_undeclared_characters", "judge_head_hopping", "judge_first_person_recall", "define_focus"]
    assert [a.name for a in next_actions(State())] == ["bootstrap_graph"]
    assert next_actions(State(entities=1, focus=True)) == []


TIME = """events:
  - {name: A, precedes: [B]}
  - {name: B, precedes: [C]}
  - {name: C, precedes: [A]}
  - {name: Self, follows: [Self]}
  - {name: D, precedes: [E], overlaps: [E], includes: [E]}
  - {name: E}
  - {name: F1, begin: 1800, end: 1810, precedes: [F2]}
  - {name: F2, begin: 1810, end: 1820, follows: [F3]}
  - {name: F3, begin: 1815, end: 1830, overlaps: [F1], included_in: [F2]}"""


def test_temporal(spark):
    files = files_from(spark, {"bible/timeline.md": head(TIME)}, C)
    report = run_rules(Context(build(files, C), files), {"temporal": RULES["temporal"]})
    assert report.errors == []
    said = sorted(r.message.split(":")[0] if "cycle" in r.message else r.message for r in report.findings.collect())
    assert len(said) == 7 and said[-1] == "temporal cycle"
    assert sum("asserted to overlap" in m for m in said) == 2
    assert sum("containment" in m for m in said) == 2
    assert "'f2' (begins 1810) is asserted to follow 'f3' (ends 1830), but starts before it ends" in said
    cycle = next(r for r in report.findings.collect() if "cycle" in r.message)
    assert "{a, b, c}" in cycle.message and len(cycle.triples) == 3 and cycle.source == "bible/timeline.md"


def test_rejects_and_collisions(spark):
    broken = {
        "bible/characters/a.md": b"---\nname: \xff\n---",
        "bible/characters/b.md": head("name: [unclosed"),
        "bible/characters/c.md": head("born: 3"),
        "bible/characters/d.md": head("name: D\nborn: true"),
        "bible/characters/e.md": head("name: E\nfeatures: x"),
        "bible/characters/f.md": "no head at all",
        "bible/characters/ok.md": head("name: Ok\nodd: 1"),
        "bible/characters/deep/x.md": head("name: Deep"),
        "bible/locations/l.md": head("name: L\nsetting: [a]"),
        "bible/timeline.md": head("events:\n  - x\n  - {name: '!!'}\n  - {name: Fine, participants: ['!!']}"),
        "bible/relationships.md": head("relationships: no"),
    }
    b = build(files_from(spark, broken, C), C)
    skipped = [p for p, _ in rows(b.skipped)]
    assert skipped == sorted([f"bible/characters/{x}.md" for x in "abcdef"] + ["bible/locations/l.md", "bible/relationships.md", "bible/timeline.md", "bible/timeline.md"])
    assert rows(b.unknown_keys) == [("bible/characters/ok.md", "odd")]
    assert b.report()["exit_code"] == 4
    with pytest.raises(ValueError, match="partial corpus"):
        status(b, files_from(spark, broken, C))
    two = {"bible/characters/a.md": head("name: José"), "bible/characters/b.md": head("name: jose")}
    with pytest.raises(IngestError) as e:
        build(files_from(spark, two, C), C)
    assert e.value.code == "slug_collision"
    build(files_from(spark, {"bible/timeline.md": head("events:\n  - {name: X}\n  - {name: x}")}, C), C)


@pytest.mark.parametrize(
    ("path", "text"),
    [
        ("sources", "sources:\n  - name: A"),
        ("sources", "sources: 3"),
        ("t", "findings:\n  - claim: x"),
        ("t", "findings:\n  - id: a\n    claim: x\n    sources: [Lost]"),
        ("t", "findings:\n  - {id: a, open: true}\n  - {id: a, open: true}"),
        ("t", "anchors:\n  - {promotes: x, constrains: null}"),
        ("t", "findings: [{id: a, open: true}]\nanchors:\n  - {promotes: a, constrains: null, date: 3, begin: 2}"),
        ("t", "findings: [{id: a, open: true}]\nanchors:\n  - {promotes: a}"),
    ],
)
def test_research_faults_are_fatal(spark, path, text):
    with pytest.raises(IngestError):
        build(files_from(spark, {f"bible/research/{path}.md": head(text)}, C), C)


def test_rule_isolation_and_selection(spark, project, tmp_path):
    (tmp_path / "good.py").write_text("NAME = 'mine'\ndef validate(c):\n    from lorespark.operators.rules import finding\n    from pyspark.sql import functions as F\n    return finding(c.names('setting'), 'mine', 'info', F.col('name'), F.col('relpath'))\n")
    (tmp_path / "bad.py").write_text("1/0")
    (tmp_path / "clash.py").write_text("NAME = 'temporal'\nvalidate = None")
    (tmp_path / "fails.py").write_text("NAME = 'fails'\ndef validate(c):\n    from pyspark.sql import functions as F\n    from lorespark.operators.rules import finding\n    return finding(c.names('setting').where(F.raise_error(F.lit('late')).isNull()), 'fails', 'info', F.col('name'), F.col('relpath'))\n")
    custom, errors = discover(tmp_path)
    assert set(custom) == {"mine", "fails"} and len(errors) == 2
    active = select(custom, disabled=tuple(RULES), allowed=("mine", "fails"))
    report = run_rules(Context(*project), active, errors)
    assert report.ran == ["mine"] and [e[0] for e in report.errors if e[2] == "run"] == ["fails"]
    assert [r.message for r in report.findings.collect()] == ["Port"]
    with pytest.raises(ValueError, match="unknown validator"):
        select({}, enabled=("nope",))
    empty = Report(spark.createDataFrame([], "validator string, severity string, message string, source string, triples array<struct<s:string,p:string,o:string>>"), [], [], [])
    assert empty.green() and empty.counts() == {"error": 0, "warning": 0, "info": 0}


@pytest.mark.parametrize(
    ("text", "want"),
    [(None, None), ("nothing", None), ("Voz narrativa: [PENDING: x]", None), ("Narrative voice: omniscient", None), ("> _Narrative voice_: First person", ("first", False)), ("Voz narrativa: tercera persona limitada", ("third", True))],
)
def test_voice(text, want):
    if want is None:
        with pytest.raises(NotEvaluated):
            voice(text)
    else:
        assert voice(text) == want


@pytest.mark.parametrize(("name", "want"), [("Ana María", "ana-maria"), ("  Ünder--the  Sea! ", "under-the-sea"), ("Œuvre Straße", "oeuvre-strasse"), ("!!", None), ("Ñandú 3", "nandu-3")])
def test_slugs(spark, name, want):
    from pyspark.sql import functions as F

    from lorespark.functions.text import slug

    assert make_slug(name) == want
    assert spark.createDataFrame([(name,)], "n string").select(slug(F.col("n"))).first()[0] == want


YAML = """a: 1
b: [x, 'y z', {k: v}]
c:
  - name: n  # note
    deep: {q: 2.5}
  - plain
  -
    z: |
      two
       lines
d: >-
  folded
  text
e: 2024-02-03
f: "quoted: #not"
g:
h: no
i: -44
'j k': http://x/y#z
"""


def test_yaml_subset_equals_the_library():
    yaml = pytest.importorskip("yaml")
    assert load_yaml(YAML) == yaml.safe_load(YAML)
    assert load_yaml(YAML)["e"] == datetime.date(2024, 2, 3)
    for bad in ("a: [1", "a: 'x", "a: b: c", "a:\n\t- x", "a: 1\n  b: 2\n c: 3", "- a\nb: 1"):
        with pytest.raises(HeadError):
            load_yaml(bad)


def test_heads():
    meta, body, lines = parse_frontmatter("---\nname: x\nlist:\n  - name: inner\n---\nbody\n")
    assert (meta, body, lines) == ({"name": "x", "list": [{"name": "inner"}]}, "body\n", {"name": 2, "list": 3})
    assert parse_frontmatter("---\nname: x\n") == ({}, "---\nname: x\n", {})
    assert parse_frontmatter("---\n- a\n---\nb")[0] == {}


def test_folder_and_manifest(spark, tmp_path):
    for path, text in MINI.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "manifest.toml").write_text('[engine]\nuri_base = "https://b.example/x/"\n[book]\nlanguage = "en"\n[research]\nenabled = false\n')
    assert find_root(tmp_path / "bible" / "characters") == tmp_path
    config = load_manifest(tmp_path / "manifest.toml")
    files = read_files(spark, str(tmp_path), config)
    assert {r.relpath for r in files.collect()} == set(MINI)
    assert build(files, config).report()["sources"] == 0
    (tmp_path / "manifest.toml").write_text('[engine]\nuri_base = "b"')
    with pytest.raises(ConfigError):
        load_manifest(tmp_path / "manifest.toml")
    assert success(n=1) == '{"status":"ok","n":1}\n' and '"code":"x"' in failure("x", "m")
    assert V.PREFIXES["crm"].startswith("http")


def test_manifest_model(tmp_path):
    path = tmp_path / "manifest.toml"
    path.write_text('[engine]\nuri_base = "https://b.example/x/"\nmanifest_version = "3"\ncli_version_min = "0.9"\n[unknown]\nx = 1\n[paths]\nbible = "lore"\n')
    config = load_manifest(path)
    assert len(config.warnings) == 1 and config.paths["bible"] == "lore" and config.paths["graph"] == "bible/graph.ttl"
    for bad in ('cli_version_min = "99.1"', 'cli_version_min = "x"', 'manifest_version = "one"', '[book]\nlanguage = 3', "[research]\nenabled = 1", '[vocabularies]\nactive = "propp"', "[vocabularies]\nactive = [1]", "[paths]\nbible = 1", "[book"):
        path.write_text(f'[engine]\nuri_base = "https://b.example/x/"\n{bad}\n')
        with pytest.raises(ConfigError):
            load_manifest(path)


def test_commands(spark, tmp_path, capsys):
    import json

    from lorespark.cli import main

    def run(*args):
        code = main(["--root", str(tmp_path), *args], spark)
        out = capsys.readouterr().out
        return code, json.loads(out) if "--json" in args and out else out

    assert run("status", "--json") == (2, {"status": "error", "code": "project_not_found", "message": "no manifest.toml here or in a folder above"})
    assert run("nonsense")[0] == 2
    (tmp_path / "manifest.toml").write_text('[engine]\nuri_base = "https://b.example/x/"\n[vocabularies]\nactive = ["greimas", "lost"]\n')
    code, said = run("status", "--json")
    assert code == 0 and not said["state"]["available"] and [a["name"] for a in said["next_actions"]] == ["bootstrap_graph"]
    assert run("graph", "build", "--json")[0] == 2 and run("graph", "query", "SELECT ?s { ?s ?p ?o }", "--json")[1]["code"] == "graph_not_built"
    for path, text in {"bible/characters/ann.md": head("name: Ann\nnarrative_roles: [Helper, Foe]"), "bible/constitution.md": "Narrative voice: third\n", "manuscript/one.md": "Ann went.\n"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    code, said = run("graph", "build", "--json")
    assert code == 0 and said["entities"] == 1 and [tuple(x) for x in said["untyped_terms"]] == [("greimas", "Foe")]
    code, said = run("graph", "query", "SELECT ?t { ?r crm:P2_has_type ?t }", "--json")
    assert code == 0 and said["count"] == 1 and said["results"][0]["t"].endswith("greimas/helper")
    assert run("graph", "query", "SELECT ?t { nonsense", "--json")[0] == 3
    assert run("graph", "query", "SELECT ?t { ?t a <http://none/> }")[0] == 0
    code, said = run("validate", "--json")
    assert code == 0 and said["counts"]["error"] == 0
    assert run("validate", "--scope", "nowhere", "--json")[1]["code"] == "invalid_scope"
    (tmp_path / "bible/characters/bob.md").write_text(head("name: Bob"))
    assert run("validate", "--scope", "manuscript")[0] == 1  # the gate heeds no filter
    code, said = run("status", "--json")
    assert code == 0 and (tmp_path / ".lorespark" / "status.json").read_text() and said["state"]["counts"]["error"] == 1
    (tmp_path / "bible/characters/bad.md").write_text(head("name: 3"))
    assert run("graph", "build")[0] == 4 and run("status", "--json")[1]["code"] == "skipped_sources"
    (tmp_path / "bible/characters/bad.md").write_text(head("name: ANN"))
    assert run("graph", "build", "--json")[0] == 3


def test_packaged_vocabularies(spark):
    from lorespark.operators.facts import terms
    from lorespark.operators.ingest import vocabulary_index
    from lorespark.vocabularies import packaged

    found = packaged(spark, ["propp", "greimas", "none"])
    assert {n: vocabulary_index(g).select("term").distinct().count() for n, g in found.items()} == {"propp": 31, "greimas": 6}
    assert terms(found["greimas"]).count() == 6 + 3


def test_sequences_are_named_by_their_first_card(spark):
    unit = lambda name, sequence, order: head(f"name: {name}\nsequence: {sequence}\norder: {order}")
    config = Config()
    files = files_from(spark, {"outline/units/a.md": unit("A", "The Fall", 2), "outline/units/b.md": unit("B", "the fall", 1)}, config)
    built = build(files, config)
    assert [tuple(r)[1:] for r in built.sequences.collect()] == [("the-fall", "The Fall", "outline/units/b.md")] and built.files == 2
