"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may differ from a passage by k = n * error_rate edits. It is
split into k + 1 pieces; k edits leave one piece whole, so every passage within k edits
holds an exact copy of a piece at its place, give or take k. One Aho-Corasick automaton of
all pieces finds these hits in a single pass over a text, and Myers' bit-parallel distance
verifies each place: the least edits between the item and any passage there.

Both sides are compared in lower case with white-space runs as one space; starts and ends of
matches count characters of that form. Of an item of fewer than ``min_chars`` such characters, which
could stand inside of other words, only passages between word bounds count, with the same budget.
Every place of a text that holds an item is a match; places whose windows overlap are one,
the nearest passage of them.

The items are sent to every executor only in blocks of at most ``MAX_BLOCK_CHARS``
characters, whose size is measured first; a larger benchmark takes one pass a block.

Defined cases: null texts match nothing; null items and null ids of items are left out of
the matches; equal items of different ids all match; a repeated row gives its matches again;
an empty table on either side gives no match; texts of any length are searched whole; other
columns stay, but for one named ``benchmark_matches``, which is replaced.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import enable_workers, text_of

MAX_BLOCK_CHARS = 4_000_000
MATCHES = "array<struct<item_id:long,distance:int,start:int,`end`:int>>"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _in_word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_" or unicodedata.category(text[at])[0] == "M")


def myers(pattern: str, text: str, budget: int) -> tuple[int, int] | None:
    """(distance, end) of the passage of text nearest to pattern, the first such; None if over budget.

    One step a character of text: the column of the edit matrix is kept as two bit vectors,
    of steps up and steps down.
    """
    m = len(pattern)
    mask, high = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    up, down, score, best = mask, 0, m, None
    for end, c in enumerate(text, 1):
        eq = where.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right_up = down | (mask & ~(diagonal | up))
        right_down = up & diagonal
        if right_up & high:
            score += 1
        elif right_down & high:
            score -= 1
        right_up = (right_up << 1) & mask
        right_down = (right_down << 1) & mask
        up = right_down | (mask & ~(diagonal | right_up))
        down = right_up & diagonal
        if score <= budget and (best is None or score < best[0]):
            best = (score, end)
    return best


def nearest_whole(pattern: str, text: str, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the nearest passage that begins from low to high, cuts no word and is within the budget; the first of equals."""
    best = None
    for start in range(max(low, 0), min(high, len(text) - 1) + 1):
        if _in_word(text, start - 1) and _in_word(text, start):
            continue
        row = list(range(len(pattern) + 1))
        for end in range(start, min(len(text), start + len(pattern) + budget)):
            before, row = row, [end - start + 1]
            for i, c in enumerate(pattern, 1):
                row.append(min(before[i - 1] + (c != text[end]), before[i] + 1, row[-1] + 1))
            if row[-1] <= budget and not (_in_word(text, end) and _in_word(text, end + 1)):
                best = min(best or (budget + 1,), (row[-1], start, end + 1))
    return best


class Matcher:
    """Finds the items that a text holds within their error budgets; of those under min_chars the passages that cut no word."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float, min_chars: int = 0):
        import ahocorasick

        self.items = [(i, t, int(len(t) * error_rate)) for i, t in items]
        self.min_chars = min_chars
        pieces: dict[str, list[tuple[int, int]]] = {}
        for at, (_, text, budget) in enumerate(self.items):
            edges = [round(len(text) * p / (budget + 1)) for p in range(budget + 2)]
            for a, b in zip(edges, edges[1:], strict=False):
                pieces.setdefault(text[a:b], []).append((at, b))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, places)
        self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) in the normal text of every place that holds an item."""
        text = normal(text)
        if not self.items or not text:
            return []
        places: dict[int, set[int]] = {}
        for last, hits in self.automaton.iter(text):
            for at, offset in hits:
                places.setdefault(at, set()).add(last + 1 - offset)
        out = []
        for at, starts in places.items():
            item, pattern, budget = self.items[at]
            if len(pattern) < self.min_chars:
                last = None
                for start in sorted(starts):
                    found = nearest_whole(pattern, text, start - budget, start + budget, budget)
                    if found and (last is None or found[1] >= last[2]):
                        last = found
                        out.append((item, *found))
                    elif found and found[0] < last[0]:  # of overlapping ones the nearest
                        last = found
                        out[-1] = (item, *found)
                continue
            windows: list[list[int]] = []
            for start in sorted(starts):
                a, b = max(0, start - budget), min(len(text), start + len(pattern) + budget)
                if windows and a <= windows[-1][0] + 2 * budget:  # one window takes near places together
                    windows[-1][1] = b
                else:
                    windows.append([a, b])
            last = None
            for a, b in windows:
                exact = text.find(pattern, a, b)
                found = (0, exact - a + len(pattern)) if exact >= 0 else myers(pattern, text[a:b], budget)
                if not found:
                    continue
                distance, end = found[0], a + found[1]
                back = text[max(0, end - len(pattern) - budget) : end][::-1]
                length = len(pattern) if distance == 0 else myers(pattern[::-1], back, distance)[1]
                match = (item, distance, end - length, end)
                if last is None or match[2] >= last[3]:
                    out.append(match)
                    last = match
                elif distance < last[1]:  # of overlapping ones the nearest
                    out[-1] = last = match
        return sorted(out)


_MATCHERS: dict[int, Matcher] = {}


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, str]]]:
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.lower(text_of(text)).alias("t")).where("i is not null")
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-total // MAX_BLOCK_CHARS) or 1
    for block in range(n):
        rows = (items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == block)).collect()
        yield sorted({(r.i, t) for r in rows if (t := normal(r.t))})


def _finder(sent, error_rate: float, min_chars: int):
    @F.pandas_udf(MATCHES)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        key = hash((tuple(sent.value), error_rate, min_chars))
        if key not in _MATCHERS:
            _MATCHERS.clear()
            _MATCHERS[key] = Matcher(sent.value, error_rate, min_chars)
        matcher = _MATCHERS[key]
        for batch in batches:
            yield pd.Series([[dict(zip(("item_id", "distance", "start", "end"), x, strict=True)) for x in matcher.find(t)] for t in batch], dtype=object)

    return found.asNondeterministic()  # so that a filter on the matches does not run it once more


def item_matches(spark, benchmark: DataFrame, error_rate: float = 0.08, min_chars: int = 32, item_id: str = "item_id", text: str = "text"):
    """A function from a text column to the column of its matches."""
    enable_workers(spark)
    columns = [_finder(spark.sparkContext.broadcast(items), error_rate, min_chars) for items in _blocks(benchmark, item_id, text)]

    def of(column: Column) -> Column:
        return reduce(F.concat, [f(text_of(column)) for f in columns])

    return of


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", error_rate: float = 0.08, min_chars: int = 32) -> DataFrame:
    """docs with ``benchmark_matches``, which replaces a column of that name."""
    of = item_matches(docs.sparkSession, benchmark, error_rate, min_chars)
    return docs.withColumn("benchmark_matches", of(F.col(text)))


def op1_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds, over whole documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("benchmark_matches").alias("m")).select(
        "doc_id", "m.item_id", "m.distance", F.col("m.start").alias("match_start"), F.col("m.end").alias("match_end")
    )
