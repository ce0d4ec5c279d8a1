"""Secret scans: password guess-cost dynamic programming over credential-context values.

Three fixed patterns give the base spans. The method looks at further values that stand in
a credential context (a keyword, a separator, a value of any visible characters) and asks
what the cheapest way to guess such a value costs: a minimum-cost segmentation into
dictionary words, dates, repeats, keyboard walks, sequences and brute-force spans, in
log10 guesses. A value that costs at least ``min_log10_guesses`` is a ``guess`` span.

The dictionary is ranked: frequent password words first, then the whole words of a public
tokenizer's vocabulary in the order of its merges, which follows their frequency; some 32,000
words, read from the file in each worker. A run (of one character, of a repeated string, of
neighbouring keys, of a sequence) may end at any of its first and last ``ENDS`` places, so
values of any length are segmented, in time linear in it.

Defined cases: a null text is empty and has no span; offsets are code points, ends are
exclusive; spans of one kind never overlap; a repeated row gives its result twice; other
columns stay, but for one named ``secret_spans``, which is replaced; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import enable_workers, text_of

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # maximal runs, so the length test can stand in the pattern
HEX = re.compile(r"[0-9a-f]{24,}")
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|api[_-]?key|access[_-]?key|private[_-]?key|auth)
        ["']?\s{0,4}(?::=|=>|[:=])\s{0,4}(["']?)([^\s"'<>]{6,})""",
    re.A | re.I | re.X,
)
HINT = re.compile(r"pass|pwd|secret|token|credential|key|auth", re.A | re.I)
HINTS = ("pass", "pwd", "secret", "token", "credential", "key", "auth")

# Frequent password words, most frequent first; their place is their rank.
COMMON_WORDS = (
    "password qwerty abc letmein monkey dragon iloveyou master sunshine princess welcome shadow football "
    "baseball admin login hello freedom whatever trustno starwars summer winter spring autumn secret hunter "
    "killer superman batman michael jordan jennifer charlie thomas daniel george andrew jessica ashley love "
    "test guest root user default changeme access flower cheese computer internet orange banana purple silver "
    "golden diamond ginger pepper cookie butter hammer soccer hockey tigger buster maggie robert william "
    "matrix phoenix thunder ranger cowboy eagle falcon mustang ferrari porsche london berlin paris madrid "
    "january february march april june july august september october november december monday friday sunday"
).split()
# Keyboard rows.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")

PLACE = {c: (r, i) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
LEET = str.maketrans("@4301!5$7", "aaeoiisst")
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
ENDS = 16
# Of each period, the shorter ones that divide it: their repeats cost less.
DIVISORS = {p: [d for d in range(1, p) if p % d == 0] for p in range(2, 17)}


@lru_cache(maxsize=4)
def dictionary(path: str | None = None) -> dict[str, int]:
    """Word to rank: the common words, then the whole words of three letters or more of a tokenizer file, in its order."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    end = "</w>"
    words = (t[: -len(end)] for t in sorted(ids, key=ids.get) if t.endswith(end))
    ranked = dict.fromkeys([*COMMON_WORDS, *(w for w in words if len(w) >= 3 and w.isascii() and w.isalpha())])
    return {w: i + 1 for i, w in enumerate(ranked)}


@lru_cache(maxsize=1)
def _longest(path: str | None = None) -> int:
    return max(map(len, dictionary(path)))


def _near(a: str, b: str) -> bool:
    p, q = PLACE.get(a), PLACE.get(b)
    return bool(p and q and a != b and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1)


def _alphabet(value: str) -> int:
    sizes = ((r"[a-z]", 26), (r"[A-Z]", 26), (r"[0-9]", 10), (r"[^a-zA-Z0-9]", 33))
    return sum(n for pattern, n in sizes if re.search(pattern, value)) or 1


def _stops(first: int, last: int, step: int = 1) -> Iterator[int]:
    """The ends first, first + step, ... last of a run; of a long one the first and last ENDS of them."""
    ends = range(first, last + 1, step)
    return iter(ends) if len(ends) <= 2 * ENDS else chain(ends[:ENDS], ends[-ENDS:])


def guess_cost(value: str, rank: dict[str, int] | None = None) -> float:
    """log10 of the guesses that the cheapest segmentation of value needs.

    best[i] is the least cost of value[i:]; a span i..j adds its own log10 guesses and, for
    the choice of one more segment, log10(2). Places are taken from the last to the first, so
    that where a run ends follows from the place after it.
    """
    n, brute, choice = len(value), math.log10(_alphabet(value)), math.log10(2)
    longest = _longest() if rank is None else max(map(len, rank), default=0)
    rank = dictionary() if rank is None else rank
    low = value.lower()
    low = low if len(low) == n else value  # a letter whose lower case is two
    plain = low.translate(LEET)
    best = [0.0] * (n + 1)
    same = walk = steps = n  # ends of the runs that start at i: one character, neighbouring keys, steps of one sign
    ahead = [0] * 17  # by period: how many characters from i on equal those a period later
    step = 0
    for i in range(n - 1, -1, -1):
        least = best[i + 1] + brute - choice  # a brute-force character is no choice of a segment
        for j in range(i + 3, min(n, i + longest) + 1):
            if r := rank.get(low[i:j]) or rank.get(plain[i:j]):
                extra = (0 if value[i:j] == low[i:j] else 1) + (0 if low[i:j] == plain[i:j] else 1)
                least = min(least, best[j] + math.log10(r + 1) + extra * math.log10(2) + 1)
        if m := DATE.match(value, i):
            least = min(least, best[m.end()] + math.log10(365 * 120 if m.end() - i > 4 else 120))
        if i + 1 < n:
            same = same if value[i] == value[i + 1] else i + 1
            walk = walk if _near(low[i], low[i + 1]) else i + 1
            before, step = step, ord(value[i + 1]) - ord(value[i])
            steps = steps if i + 2 < n and step == before else i + 2
        for j in _stops(i + 3, same):
            least = min(least, best[j] + brute + math.log10(j - i))
        ahead[1] = same - i - 1
        for period in range(2, min(16, n - i - 1) + 1):
            ahead[period] = ahead[period] + 1 if value[i] == value[i + period] else 0
            times = ahead[period] // period
            if times and not any(ahead[d] + d >= ahead[period] + period for d in DIVISORS[period]):
                for j in _stops(i + 2 * period, i + (times + 1) * period, period):
                    least = min(least, best[j] + period * brute + math.log10((j - i) // period))
        for j in _stops(i + 4, walk):
            least = min(least, best[j] + math.log10(47) + (j - i - 1) * math.log10(4))
        if abs(step) == 1:
            for j in _stops(i + 3, steps):
                least = min(least, best[j] + brute + math.log10(2 * (j - i)))
        best[i] = least + choice
    return best[0]


def find_secrets(text: str | None, min_log10_guesses: float = 10.0, rank: dict[str, int] | None = None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end), by start, then kind. Base kinds first, then the method's."""
    text = text or ""
    found: list[tuple[int, int, int]] = []
    low = text.lower() if text.isascii() else text.casefold()
    if any(h in low for h in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
        covered = [(s, e) for s, _, e in found]
        for m in CONTEXT.finditer(text):
            s, e = m.span(2)
            at = bisect_right(covered, (s, len(text))) - 1
            if not (at >= 0 and e <= covered[at][1]) and guess_cost(m[2], rank) >= min_log10_guesses:
                found.append((s, 3, e))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


def redact(text: str | None, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str | None:
    """text with each maximal run of spans replaced by mark; null stays null."""
    if not spans:
        return text
    out, at = [], 0
    runs: list[list[int]] = []
    for _, s, e in sorted(spans, key=lambda x: x[1]):
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    for s, e in runs:
        out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind:string,start:int,`end`:int>>"


def secret_spans(text: Column, min_log10_guesses: float = 10.0) -> Column:
    """Column of all spans of a text column."""

    @F.pandas_udf(SPANS)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in find_secrets(t, min_log10_guesses)] for t in batch], dtype=object)

    return spans(text_of(text))


def redacted(text: Column, min_log10_guesses: float = 10.0) -> Column:
    """Column of texts with their secrets replaced; null stays null."""

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([redact(t, find_secrets(t, min_log10_guesses)) for t in batch], dtype=object)

    return clean(text)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, text: str = "text", min_log10_guesses: float = 10.0) -> DataFrame:
    """docs with ``secret_spans``, which replaces a column of that name."""
    enable_workers(docs.sparkSession)
    return docs.withColumn("secret_spans", secret_spans(F.col(text), min_log10_guesses))


def op6_secret_scans(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents, with counts and digests of its spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs)
    spans = F.col("secret_spans")
    written = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    base = F.transform(
        F.filter(spans, lambda s: s["kind"] != "guess"),
        lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
    )
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        count("guess").alias("n_guess"),
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(written, ",").alias("spans"),
    )


def brute_base(text: str | None) -> tuple[list[tuple[str, int, int]], str]:
    """The base spans straight from their definition, for tests."""
    text, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A | re.I):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    spans = [(KINDS[k], s, e) for s, k, e in sorted(out)]
    return spans, hashlib.sha256(digest(spans).encode()).hexdigest()


def brute_cost(value: str, rank: dict[str, int]) -> float:
    """The same cost from every span of value by its definition, for tests of short values."""
    low, brute = value.lower(), math.log10(_alphabet(value))
    plain = low.translate(LEET)

    def span(i: int, j: int) -> float:
        s, size, costs = value[i:j], j - i, []
        gaps = {ord(y) - ord(x) for x, y in zip(s, s[1:], strict=False)}
        if r := size >= 3 and (rank.get(low[i:j]) or rank.get(plain[i:j])):
            costs.append(math.log10(r + 1) + 1 + math.log10(2) * ((s != low[i:j]) + (low[i:j] != plain[i:j])))
        if (m := DATE.match(value, i)) and m.end() == j:
            costs.append(math.log10(365 * 120 if size > 4 else 120))
        if size >= 3 and gaps == {0}:
            costs.append(brute + math.log10(size))
        if size >= 3 and gaps in ({1}, {-1}):
            costs.append(brute + math.log10(2 * size))
        if size >= 4 and all(_near(x, y) for x, y in zip(low[i:j], low[i + 1 : j], strict=False)):
            costs.append(math.log10(47) + (size - 1) * math.log10(4))
        costs += [p * brute + math.log10(size // p) for p in range(2, 17) if size % p == 0 and size > p and s[:p] * (size // p) == s]
        return min(costs, default=math.inf) + math.log10(2)

    best = [0.0] * (len(value) + 1)
    for i in reversed(range(len(value))):
        best[i] = min([best[i + 1] + brute, *(best[j] + span(i, j) for j in range(i + 1, len(value) + 1))])
    return best[0]
