"""Heads against the YAML library: equal values, errors where it has errors."""

import random

import pytest

from lorespark.sources.frontmatter import HeadError, load_yaml, parse_frontmatter

yaml = pytest.importorskip("yaml")

CASES = [
    "a: &x [1, 2]\nb: *x\nc: [*x, 3]",
    "base: &b {k: 1, m: 2}\nc:\n  <<: *b\n  m: 3\nd:\n  m: 4\n  <<: *b",
    "a: &a\n  k: v\nb: &b\n  k: w\n  z: 1\nc:\n  <<: [*a, *b]\n  q: 2",
    "a: &s text\nb: *s\nc: {k: *s, *s : 1}",
    "- &k name: x\n- *k : y",
    "a: &l\n- 1\n- 2\nb: *l",
    "a: !!str 12\nb: !!int '7'\nc: !!float 3\nd: !!null ''\ne: !!bool yes\nf: !!seq [1]\ng: !!map {a: 1}\nh: !!set {a, b}\ni: !!str\nj: !!timestamp 2020-01-01",
    "a: &x !!str 5\nb: !!str &y 6\nc: [*x, *y]",
    "a: [1,\n  2,\n  {b: c,\n   d: e}\n]\nf: 1",
    "a: 'one\n  two\n\n  three'\nb: \"x\n  y\\\n  z\"\nc: 1",
    "a: one\n  two\n\n  three\nb: 2",
    "a:\n  one\n  two\nb: 2",
    "a: 0x1F\nb: 017\nc: 1_000\nd: 1:30\ne: .inf\nf: -.INF\ng: 1e3\nh: 1.5e+3\ni: 0b11\nj: yEs\nk: Off\nl: 09\nm: 1:30.5",
    "a: 2001-12-14t21:59:43.10-05:00\nb: 2001-12-14 21:59:43\nc: 2001-12-15T02:59:43.1Z\nd: 2001-12-15",
    'a: "\\u00e9\\x41\\t\\e\\N"\nb: "\\/"',
    "a: |+\n  x\n\nb: >-\n  x\n  y\n\n  z\n   deep\n  w\nc: |2\n    two\n  one\nd: |-\n  \ttab\n",
    "1: a\ntrue: b\n~: c\n2020-01-01: d",
    "c#: x\na:b: y\nhttp://x/y: z\nq: a#b #c",
    "a: {b, c: , d: [e: f, g]}\nh: {'x':1, \"y\":2}\ni: [a, ]",
    "- - 1\n  - 2\n-\n  - 3\n- \n- x: 1\n  y: 2",
    "a: -b",
    "",
    "# only a comment",
]
BAD = ["a: *none", "a: &x 1\nb: &x 2", "a: !own 1", "a: !!int x", "a: [1", "a: 'x", "<<: 3", "a: {<<: [1]}", "a: b: c", "a:\n\t- x", "a: 1\n  b: 2\n c: 3", "- a\nb: 1", "a: @x", "a: [,]", 'a: "\\q"', "a: 'x' y", "a: - b", "? [a]\n: b\n- c", "a: %x", "a: !!seq {b: 1}", "a: &x &y 1", "a: [b}"]


@pytest.mark.parametrize("text", CASES)
def test_equal(text):
    assert repr(load_yaml(text)) == repr(yaml.safe_load(text)) or load_yaml(text) == yaml.safe_load(text)


@pytest.mark.parametrize("text", BAD)
def test_errors(text):
    with pytest.raises((yaml.YAMLError, ValueError)):
        yaml.safe_load(text)
    with pytest.raises(HeadError):
        load_yaml(text)


def _random(rng: random.Random, depth: int, names: list[str], indent: int) -> str:
    """Text of a node that goes behind a key; block children are on lines of their own."""
    pad = " " * indent
    mark = ""
    if rng.random() < 0.2:
        names.append(f"n{len(names)}")
        mark = f"&{names[-1]} "
    kind = rng.random()
    if depth and kind < 0.5:
        own = f"&m{rng.randrange(10**9)}" if mark and names.pop() else ""  # inside of itself a node has no name yet
        if kind < 0.3:
            rows = [f"{pad}{rng.choice(['k', 'name', 'x y', 'q-r'])}{i}: {_random(rng, depth - 1, names, indent + 2)}" for i in range(rng.randint(1, 3))]
        else:
            rows = [f"{pad}- {_random(rng, 0, names, indent + 2)}" for _ in range(rng.randint(1, 3))]
        return own + "\n" + "\n".join(rows)
    if not mark and names and kind < 0.65:
        return f"*{rng.choice(names)}"
    plain = ["x", "12", "-3.5", "yes", "null", "a b c", "2020-02-03", "it's", "x:y", "0x1f", "~", ".5", "1_0", "é", "a #c", "off"]
    quoted = ["'it''s'", '"a\\nb"', "''", '"#x: y"', "'12'"]
    flow = ["[]", "{}", "[1, a, 'b']", "{a: 1, b: [x, y]}", "[[1], {k: v}]"]
    tags = ["!!str 12", "!!str yes", "!!int '3'", "!!float 2"]
    block = [f"|\n{pad}one\n{pad} two\n{pad}three", f">\n{pad}one\n{pad}two\n\n{pad}three", f">-\n{pad}one\n{pad}two", f"|-\n{pad}a: b\n{pad}# no comment"]
    return mark + rng.choice(rng.choice([plain, plain, quoted, flow, tags, block]))


@pytest.mark.parametrize("seed", range(20))
def test_random_heads(seed):
    rng = random.Random(seed)
    for _ in range(150):
        names: list[str] = []
        text = "\n".join(f"key{i}: {_random(rng, 2, names, 2)}" for i in range(rng.randint(1, 6)))
        try:
            expected = yaml.safe_load(text)
        except (yaml.YAMLError, ValueError):
            with pytest.raises(HeadError):
                load_yaml(text)
            continue
        assert repr(load_yaml(text)) == repr(expected), text


def test_head_with_anchors():
    meta, body, lines = parse_frontmatter("---\nname: &n Ann\nroles: &r [Helper, *n]\nalso: *r\n---\nbody")
    assert meta == {"name": "Ann", "roles": ["Helper", "Ann"], "also": ["Helper", "Ann"]} and body == "body" and lines == {"name": 2, "roles": 3, "also": 4}
