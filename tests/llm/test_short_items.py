"""Short benchmark items: the same budget as long ones, between word bounds."""

import random

from lorespark.llm import decontamination as D


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j - 1] + (x != y), before[j] + 1, row[-1] + 1))
    return row[-1]


def bounds(text):
    word = lambda i: 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")
    return [i for i in range(len(text) + 1) if not (word(i - 1) and word(i))]


def test_one_edit_at_31_and_at_32_characters():
    short, long = "what is the capital of france x", "what is the capital of france xy"
    assert (len(short), len(long)) == (31, 32)
    matcher = D.Matcher([(1, short), (2, long)], 0.08, 32)
    for item in (short, long):
        got = {m[0]: m[1] for m in matcher.find("so: " + item.replace("capital", "capitol") + " and on")}
        assert got[1 if item == short else 2] == 1


def test_every_short_passage_between_word_bounds():
    rng = random.Random(13)
    letters = lambda n: "".join(rng.choice("abc d") for _ in range(n))
    items = [(i, t) for i in range(30) if len(t := D.normal(letters(rng.randint(10, 31)))) >= 5]
    matcher, hits = D.Matcher(items, 0.08, 32), 0
    for _ in range(600):
        t = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(t))
            t[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "ab"])
        text = D.normal(letters(rng.randint(0, 12)) + rng.choice(["", " "]) + "".join(t) + rng.choice(["", " "]) + letters(rng.randint(0, 12)))
        found = matcher.find(text)
        at = bounds(text)
        for i, pattern in items:
            budget = int(len(pattern) * 0.08)
            near = [distance(pattern, text[a:b]) for a in at for b in at if a < b and abs(b - a - len(pattern)) <= budget]
            best = min(near, default=99)
            assert (best <= budget) == any(f[0] == i for f in found), (pattern, text)
            if best <= budget:
                assert min(f[1] for f in found if f[0] == i) == best
                hits += 1
        for i, d, a, b in found:
            assert a in at and b in at and distance(dict(items)[i], text[a:b]) == d
    assert hits > 100
