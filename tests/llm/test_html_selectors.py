"""Selectors against a naive matcher, deep pages in bounded time, text of drawings."""

import random
import time

import pytest

from lorespark.llm import html_text


def tree(rng, depth, made):
    """Nested elements with classes and ids; made gets (path, text mark) of every element."""
    out = []

    def grow(path, left):
        for _ in range(rng.randint(1, 2) if left else 0):
            name, cls, key = rng.choice(["div", "span", "b"]), rng.choice(["", "x", "y", "x y"]), rng.choice(["", "i", "j"])
            here = [*path, (name, cls.split(), key)]
            mark = f"m{len(made)}m"
            made.append((here, mark))
            out.append(f'<{name} class="{cls}" id="{key}">{mark} ')
            grow(here, left - 1)
            out.append(f"</{name}> ")

    grow([], depth)
    return "".join(out)


def fits(step, element):
    name, cls, key = element
    kind, value = step
    return value in ("*", name) if kind == "" else value in cls if kind == "." else value == key


def naive(steps, path):
    """steps: (test, child or not) from the outermost; every way to place them is tried."""
    if not fits(steps[-1][0], path[-1]):
        return False
    if len(steps) == 1:
        return True
    if steps[-1][1]:
        return len(path) > 1 and naive(steps[:-1], path[:-1])
    return any(naive(steps[:-1], path[:i]) for i in range(1, len(path)))


def test_selectors_equal_a_naive_matcher():
    rng = random.Random(21)
    tests = [("", "div"), ("", "span"), ("", "b"), ("", "*"), (".", "x"), (".", "y"), ("#", "i"), ("#", "j")]
    hidden = 0
    for _ in range(300):
        made = []
        body = tree(rng, 5, made)
        rules, css = [], []
        for _ in range(rng.randint(1, 3)):
            steps = [(rng.choice(tests), rng.random() < 0.4) for _ in range(rng.randint(1, 4))]
            rules.append(steps)
            said = ""
            for i, ((kind, value), child) in enumerate(steps):
                said += ("" if not i else " > " if child else " ") + kind + value
            css.append(said + "{display:none}")
        text = html_text.render(f"<style>{' '.join(css)}</style><body>{body}")
        gone = {tuple(map(repr, p)) for p, _ in made if any(naive([(r[0][0], False), *r[1:]], [("html", [], ""), *p]) for r in rules)}
        for path, mark in made:
            # elements of equal looks side by side are told apart by their marks, not by their paths: same path, same fate
            unseen = any(tuple(map(repr, path[: i + 1])) in gone for i in range(len(path)))
            assert (mark in text) != unseen, (css, body)
            hidden += unseen
    assert hidden > 300


@pytest.mark.parametrize("selector", [".q div div div div div b", ".q " + "div " * 9 + "b", ".q > div " * 5 + "b", "* * * * * * * * * b"])
def test_deep_pages_in_bounded_time(selector):
    deep = 2000
    page = f"<style>{selector}{{display:none}} .z div{{display:none}}</style>" + "<div>" * deep + "<b>seen</b>" + "</div>" * deep
    began = time.perf_counter()
    text = html_text.render(page)
    assert time.perf_counter() - began < 3
    assert ("seen" in text) == (not selector.startswith("*"))


def test_text_of_drawings():
    say = html_text.render
    assert say("<p>a<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><rect/><g><text>one <tspan>two</tspan></text></g> stray</svg>b").split() == ["a", "one", "two", "b"]
    assert say("<svg><path d='x'/><text>x</text><foreignObject><p>page</p></foreignObject></svg>after").split() == ["x", "page", "after"]
    assert say("<svg style='display:none'><text>no</text></svg>yes") == "yes"
    assert say("<svg><defs/><text visibility='x'>seen</text></svg>") == "seen"
