"""Turtle documents read in byte ranges and written in parts, against the plain reader."""

import random
from collections import Counter

import pytest

from lorespark.sources.turtle import TurtleError, parse_turtle, save_turtle, to_turtle, write_turtle
from lorespark.sources.turtle_scan import chained, read_range, read_turtle, summarize
from lorespark.terms import TRIPLE

PREFIXES = {"e": "http://e/", "xsd": "http://www.w3.org/2001/XMLSchema#"}


def canonical(rows):
    """Rows with blank nodes named by what stands around them."""
    rows = [tuple(r) for r in rows]
    blank = lambda x, kind="iri": kind == "iri" and x.startswith("_:")
    names = {x: "" for r in rows for x, k in ((r[0], "iri"), (r[2], r[3])) if blank(x, k)}
    for _ in range(6):
        say = lambda x: names.get(x, x)
        around = {b: [] for b in names}
        for s, p, o, kind, dt, lang in rows:
            if s in names:
                around[s].append(("out", p, say(o) if kind == "iri" else o, kind, dt, lang))
            if kind == "iri" and o in names:
                around[o].append(("in", p, say(s)))
        names = {b: str(hash(tuple(sorted(v, key=repr)))) for b, v in around.items()}
    return Counter({(names.get(s, s), p, names.get(o, o) if kind == "iri" else o, kind, dt, lang) for s, p, o, kind, dt, lang in rows})


def odd_document(rng, n):
    """Statements with all that may hide a statement's end."""
    out = ["@prefix e: <http://e/> .", "PREFIX x: <http://x.org/a.b/>"]
    strings = ['"a . b"', "'c # d .'", '"""long . \n# no comment .\n " "" \\""" \' .\n\n"""', "'''it''s \n. \"\"\" \n'''", '"q\\" ."@en', '"1"^^x:t', "1.5", "-3", "1.0e3", "true", '"""."""', '""', "''"]
    for i in range(n):
        kind = rng.randrange(9)
        value = lambda: rng.choice(strings)
        if kind == 0:
            out.append(rng.choice([f"@prefix\n x:\n <http://x.org/{i}/> .", f"prefix x: # odd .\n<http://x.org/{i}/>", f"@base <http://base/{i}/> .", f"BASE <http://base/{i}/>"]))
        elif kind == 1:
            out.append(f"# a comment . with \"\"\" and ''' in it {i}")
        elif kind == 2:
            out.append(f"e:s{i} e:p [ e:q {value()} ; e:n \"{i}\" ;\n e:r [ e:t {value()} , {i} ] ] , ( {value()} {i}\n {value()} ) .")
        elif kind == 3:
            out.append(f"[ e:id {i} ; e:v {value()} ] .\n[] e:id \"x{i}\" .")
        elif kind == 4:
            out.append(f"<rel{i}> e:p.q <#frag.{i}> ; a x:C\n.")
        elif kind == 5:
            out.append(f"_:n{i % 7} e:sees _:n{(i + 1) % 7} , {value()} .")
        else:
            out.append(f"x:s{i}\n  e:p {value()} ;\n  e:p2 {value()} , {value()} ;; .  e:t{i} a e:T .")
    return rng.choice(["\n", "\n\n", " \n"]).join(out) + rng.choice(["", "\n", "\n# end"])


def read_in_pieces(text, cuts):
    """The two passes in plain Python over ranges of lines."""
    lines = text.split("\n")
    edges = sorted({0, *(c for c in cuts if 0 < c < len(lines))})
    ranges = [lines[a:b] for a, b in zip(edges, [*edges[1:], len(lines)])]
    plan, groups = chained([("f", i, summarize(r)) for i, r in enumerate(ranges)], {})
    rows, pieces = [], {}
    for i, r in enumerate(ranges):
        for row in read_range(iter(r), plan[("f", i)]):
            if row[-1] is None:
                rows.append(row[:6])
            else:
                pieces.setdefault(row[7], []).append((row[6], row[8]))
    from lorespark.sources.turtle import Reader, tokens

    for whose, found in pieces.items():
        names, base = groups[whose]
        rows += Reader(names, base, f"anon-g{whose}-").read(tokens("\n".join(p for _, p in sorted(found))))
    return rows


def test_any_cut_gives_the_same_graph():
    rng = random.Random(7)
    for _ in range(120):
        text = odd_document(rng, rng.randint(0, 25))
        want = canonical(parse_turtle(text))
        n = text.count("\n") + 1
        for cuts in (range(n), rng.sample(range(n + 1), min(n, 5)), []):
            assert canonical(read_in_pieces(text, cuts)) == want, text


@pytest.fixture
def small_ranges(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    for k in keys:
        spark.conf.set(k, "700")
    yield
    for k, v in zip(keys, before, strict=True):
        spark.conf.set(k, v)


def test_a_file_in_many_ranges(spark, tmp_path, small_ranges):
    text = odd_document(random.Random(3), 300) + "\ne:é e:p 'ü\\u00e9 \r x' ."
    (tmp_path / "g.ttl").write_bytes(text.encode())
    assert spark.read.option("lineSep", "\n").text(f"{tmp_path}/g.ttl").rdd.getNumPartitions() > 10
    assert canonical(read_turtle(spark, f"{tmp_path}/g.ttl").collect()) == canonical(set(parse_turtle(text)))


def test_one_statement_over_many_ranges(spark, tmp_path, small_ranges):
    text = "@prefix e: <http://e/> .\n" + "e:s e:p '''" + "line .\n" * 900 + "''' ;\n" + "\n".join(f"  e:o {i} ;" for i in range(500)) + "\n e:end true ."
    (tmp_path / "g.ttl").write_text(text)
    got = read_turtle(spark, f"{tmp_path}/g.ttl")
    assert got.count() == 502 and canonical(got.collect()) == canonical(set(parse_turtle(text)))


def test_a_folder_and_given_prefixes(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.ttl").write_text("@prefix e: <http://one/> .\ne:a e:b _:x .")
    (tmp_path / "d/b.ttl").write_text("e:a e:b _:x .")
    (tmp_path / "d/c.ttl").write_text("# nothing\n")
    got = {tuple(r)[:3] for r in read_turtle(spark, f"{tmp_path}/d", PREFIXES).collect()}
    assert got == {("http://one/a", "http://one/b", "_:x"), ("http://e/a", "http://e/b", "_:x")}
    (tmp_path / "empty.ttl").write_text("")
    assert read_turtle(spark, f"{tmp_path}/empty.ttl").count() == 0


@pytest.mark.parametrize("bad", ["x:a x:b x:c .", "<a:a> <a:b> <a:c>", "<a:a> <a:b> 'x .", '<a:a> <a:b> """x .\n', "<a:a> <a:b> <a:c> <a:d> .", "<a:a> <a:b> <a:c> .\n<a:a> ! <a:b> .", "<a:a> <a:b> <a:c> . <a:a> a"])
def test_malformed_documents(spark, tmp_path, bad):
    (tmp_path / "bad.ttl").write_text(bad)
    with pytest.raises(TurtleError):
        parse_turtle(bad)
    with pytest.raises(TurtleError):
        read_turtle(spark, f"{tmp_path}/bad.ttl").count()


def test_round_trip_of_a_file_and_its_order(spark, tmp_path, small_ranges):
    rng = random.Random(1)
    rows = [(f"http://e/s{rng.randrange(40)}", f"http://e/{rng.choice(['p', 'q-r', '9x', 'a/b'])}", *rng.choice([(f"v{i} \n\"\\\t\r", "lit", None, None), (f"{i}", "lit", "http://www.w3.org/2001/XMLSchema#integer", None), ("é", "lit", None, "en"), (f"_:b{i}", "iri", None, None), ("http://e/o", "iri", None, None)])) for i in range(600)]
    rows += [("http://e/hot", "http://e/p", f"{i}", "lit", None, None) for i in range(900)]
    rows += [("http://e/hot", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://e/T", "iri", None, None), ("_:b1", "http://e/p", "_:b2", "iri", None, None)]
    g = spark.createDataFrame(rows, TRIPLE)
    write_turtle(g, f"{tmp_path}/deep/er/g.ttl", PREFIXES)
    text = (tmp_path / "deep/er/g.ttl").read_text()
    assert text == to_turtle(g.repartition(7), PREFIXES) and text.startswith("@prefix e: <http://e/> .\n")
    assert Counter(set(parse_turtle(text))) == Counter(set(rows))
    assert sorted(p.name for p in (tmp_path / "deep/er").iterdir() if not p.name.endswith(".crc")) == ["g.ttl"]
    assert {tuple(r) for r in read_turtle(spark, f"{tmp_path}/deep/er/g.ttl").collect()} == set(rows)
    write_turtle(g.limit(0), f"{tmp_path}/deep/er/g.ttl", PREFIXES)  # in the place of the other
    assert read_turtle(spark, f"{tmp_path}/deep/er/g.ttl").count() == 0
    save_turtle(g, f"{tmp_path}/parts")
    assert {tuple(r) for r in read_turtle(spark, f"{tmp_path}/parts").collect()} == set(rows)


def test_nothing_is_collected_to_write(spark, tmp_path):
    """The writer's plan has no single-partition step; a document is never one row."""
    from lorespark.sources.turtle import turtle_lines

    g = spark.range(1000).selectExpr("concat('http://e/s', id % 10) s", "'http://e/p' p", "string(id) o", "'lit' o_kind", "string(null) o_dt", "string(null) o_lang")
    df = turtle_lines(g, PREFIXES)
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "SinglePartition" not in plan and "Window" not in plan and "NestedLoop" not in plan
