"""Names in prose: one automaton over a roster, one pass over each text.

A roster is measured, cut into blocks of at most ``BLOCK_CHARS`` characters and sent to the
executors block by block; a task runs each text once through a block's automaton. No text is
shuffled and none meets a needle in a join; only the needles found are joined to their names.

A needle is found where it stands in any case between word bounds. Case is folded letter by
letter, so that places stay the same; a word character is a letter, mark, decimal digit, connector
or joiner of Unicode. A bound is where a word character and none meet, so a needle that
begins with a dash needs a word before it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import needles
from .store import ready_workers

BLOCK_CHARS = 4_000_000


@lru_cache(1 << 16)
def _folded(c: str) -> str:
    upper = c.upper()
    upper = upper if len(upper) == 1 else c
    return upper.lower()[0]


@lru_cache(1 << 16)
def _in_word(c: str) -> bool:
    kind = unicodedata.category(c)
    return kind[0] in "LM" or kind in ("Nd", "Nl", "Pc") or c in "‌‍" or "Ⓐ" <= c <= "ⓩ"


def folded(text: str) -> str:
    return text.lower() if text.isascii() else "".join(map(_folded, text))


class Roster:
    """Needles as an automaton."""

    def __init__(self, wanted: list[str]):
        import ahocorasick

        self.automaton, self.always = ahocorasick.Automaton(), [w for w in wanted if not w]
        by: dict[str, list[str]] = {}
        for w in wanted:
            if w:
                by.setdefault(folded(w), []).append(w)
        for text, spelled in by.items():
            self.automaton.add_word(text, (len(text), tuple(spelled)))
        if by:
            self.automaton.make_automaton()

    def found(self, text: str) -> list[str]:
        """The needles that stand in the text, each once, as they are spelled in the roster."""
        out: set[tuple[str, ...]] = set()
        text = folded(text)
        bound = lambda i: (i > 0 and _in_word(text[i - 1])) != (i < len(text) and _in_word(text[i]))
        if len(self.automaton):
            for last, (length, spelled) in self.automaton.iter(text):
                if spelled not in out and bound(last + 1) and bound(last + 1 - length):
                    out.add(spelled)
        empty = self.always if self.always and any(map(_in_word, text)) else []
        return sorted([w for spelled in out for w in spelled] + empty)


_ROSTERS: dict[tuple, Roster] = {}


def _finder(spark: SparkSession, wanted: list[str]):
    sent = spark.sparkContext.broadcast(wanted)

    @F.arrow_udf("array<string>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        key = (len(sent.value), hash(tuple(sent.value)))
        if key not in _ROSTERS:
            _ROSTERS.clear()
            _ROSTERS[key] = Roster(sent.value)
        roster = _ROSTERS[key]
        for batch in batches:
            yield pa.array([None if t is None else roster.found(t) for t in batch.to_pylist()], pa.list_(pa.string()))

    return found.asNondeterministic()  # so that nothing runs it twice


def blocks(wanted: DataFrame, needle: str = "needle", most: int = BLOCK_CHARS) -> Iterator[list[str]]:
    """The distinct needles in blocks of about ``most`` characters."""
    distinct = wanted.select(F.col(needle).alias("n")).where("n is not null").distinct()
    total = distinct.agg(F.sum(F.length("n") + 1)).first()[0] or 0
    parts = -(-total // most) or 1
    for part in range(parts):
        rows = distinct if parts == 1 else distinct.where(F.pmod(F.xxhash64("n"), F.lit(parts)) == part)
        yield sorted(r.n for r in rows.collect())


def where_said(wanted: DataFrame, prose: DataFrame, text: str | Column = "text", *keep: str, most: int = BLOCK_CHARS) -> DataFrame:
    """(name, needle, keep...): each needle with each text that holds it. wanted: name, needle.

    A null text holds none, a null needle is in none; equal needles of several names are found for each name, a repeated row of
    prose gives its finds again.
    """
    spark = prose.sparkSession
    ready_workers(spark)
    column = F.col(text) if isinstance(text, str) else text
    hits = [prose.select(F.explode(_finder(spark, block)(column)).alias("hit"), *keep) for block in blocks(wanted, most=most) if block]
    if not hits:
        hits = [prose.select(F.lit("").alias("hit"), *keep).limit(0)]
    found = reduce(DataFrame.union, hits)
    return found.join(wanted.select("name", "needle").distinct(), F.col("hit") == F.col("needle")).select("name", "needle", *keep)


def mentioned(names: DataFrame, prose: DataFrame, text: str = "text", name: str = "name", most: int = BLOCK_CHARS) -> DataFrame:
    """Distinct names that stand in the prose, whole or by a part, as words in any case."""
    wanted = needles(names, name)
    found = where_said(wanted, prose, text, most=most)
    return found.select("name").distinct()
