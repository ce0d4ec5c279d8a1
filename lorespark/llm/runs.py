"""Periodic runs of words by Crochemore's partition refinement.

Two positions are in one class of level p where the p words from them are equal. A level is
refined into the next by the classes of the positions behind it: of the parts a class fell
into, all but the largest split the classes before them, so a position is handled a number of
times that grows with the logarithm of the text. Neighbours in a class of level p that are p
apart start a primitive square of period p; squares that start side by side are one run.

A link between neighbours lives from the level that made it to the level that breaks it, and it
is a square exactly if its own distance is among those levels. So squares are read off when
links break, and no level visits a class that did not change. Many texts are refined at once,
each with classes of its own, in whole-array steps; a text leaves at the longest period that
its length allows.

A run is a longest stretch of words with smallest period q, of at least ``least`` words and
``times`` periods. Words are ``[^\\x20\\x09-\\x0D]+``, compared as they stand.

Spark deals the rows; a task holds one Arrow batch, refined in groups of texts of ``GROUP_WORDS``
words. Nothing is shuffled. Time for n words is n log n, with a step of fixed cost for
each level that still changes, at most a ``times``-th of the longest text.

Defined cases: a null text has no words and no run, and its collapsed text is the empty one; so
has an empty text; a text of any length is refined whole, alone if it is longer than a group;
each row gives its own row, equal texts and equal ids too; of runs of equal exponent the one
that starts first, then that of the shorter period, is the best; other columns stay, but for
one named ``periodic``, which is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import enable_workers, text_of

RUN = "struct<start: long, length: long, period: long>"
PERIODIC = f"struct<runs: array<{RUN}>, best: {RUN}, collapsed: string>"
GROUP_WORDS = 800_000
LEAST, TIMES = 24, 3


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def squares(classes: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every primitive square whose period is within the limit of its start.

    classes: a dense class number a position, those of level 1; the last position is alone in its class.
    """
    n = len(classes)
    cls = classes.astype(np.int64)
    sizes = np.bincount(cls)
    # the members of class c are members[begin[c] : begin[c] + size[c]], in any order; place is where a position stands there
    size, begin = np.zeros(n, np.int64), np.zeros(n, np.int64)
    size[: len(sizes)] = sizes
    begin[: len(sizes)] = np.cumsum(sizes) - sizes
    known = len(sizes)
    members = np.argsort(cls, kind="stable")
    place = np.empty(n, np.int64)
    place[members] = np.arange(n)
    # neighbours in a class by position, and the level from which the link to the next one holds
    after, before, since = np.full(n, -1), np.full(n, -1), np.ones(n, np.int64)
    same = np.flatnonzero(cls[members[1:]] == cls[members[:-1]])
    after[members[same]], before[members[same + 1]] = members[same + 1], members[same]
    moving = np.zeros(n, bool)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def broken(at: np.ndarray, level: int) -> None:
        """Links that end with this level: squares among them are kept."""
        apart = after[at] - at
        hit = (after[at] >= 0) & (since[at] <= apart) & (apart <= np.minimum(limit[at], level))
        if hit.any():
            found.append((at[hit], apart[hit]))

    splitters, level = np.arange(n), 1
    while True:
        x = np.sort(splitters[(limit[splitters] > level) & (splitters > 0)]) - 1
        x = x[size[cls[x]] > 1]
        if not len(x):
            break
        x = x[np.argsort(cls[x], kind="stable")]  # by class and position
        c = cls[x]
        grouped = np.argsort(c * n + cls[x + 1], kind="stable")  # by class, class behind and position
        g, gc, gs = x[grouped], c[grouped], cls[x[grouped] + 1]
        head = np.flatnonzero(np.r_[True, (gc[1:] != gc[:-1]) | (gs[1:] != gs[:-1])])
        part = np.diff(np.r_[head, len(g)])
        of = gc[head]
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        parts = np.diff(np.r_[first, len(of)])
        owner, moved = of[first], np.add.reduceat(part, first)
        rest = size[owner] - moved
        split = (rest > 0) | (parts > 1)
        if not split.all():
            stay = np.repeat(split, moved)
            x, c, g = x[stay], c[stay], g[stay]
            part, owner, moved, rest = part[np.repeat(split, parts)], owner[split], moved[split], rest[split]
            parts = parts[split]
            if not len(x):
                break
            head = np.cumsum(part) - part
            first = np.cumsum(parts) - parts
        whose = np.repeat(np.arange(len(owner)), parts)
        largest = np.lexsort((-part, whose))[first]
        most = part[largest]

        # the lists of the classes lose those that move
        moving[x] = True
        back, on = before[x], after[x]
        a, b = back[~moving[back]], on[~moving[on]]  # -1 is the last position, which is alone and never moves
        left = a >= 0
        broken(a[left], level)
        after[a[left]], since[a[left]] = b[left], level + 1
        before[b[b >= 0]] = a[b >= 0]
        # each part is a list of its own
        follow, lead = np.r_[g[1:], -1], np.r_[-1, g[:-1]]
        lead[head], follow[np.r_[head[1:], len(g)] - 1] = -1, -1
        other = after[g] != follow
        broken(g[other], level)
        since[g[other]] = level + 1
        after[g], before[g] = follow, lead

        # those that move go to the end of their class's stretch of members, part by part
        low = begin[owner] + rest
        end = _ranges(low, moved)
        there = members[end]
        staying = there[~moving[there]]
        vacant = place[x]
        vacant = vacant[vacant < np.repeat(low, moved)]
        members[vacant], place[staying] = staying, vacant
        members[end], place[g] = g, end
        moving[x] = False

        # a class keeps its number for what stays, or for its largest part where all move
        fresh = np.ones(len(part), bool)
        fresh[largest[rest == 0]] = False
        number = of_part = np.repeat(owner, parts)
        number = np.where(fresh, known + np.cumsum(fresh) - 1, of_part)
        known += int(fresh.sum())
        size[owner] = rest
        size[number], begin[number] = part, end[head]
        cls[g] = np.repeat(number, part)

        # all but the largest of what a class fell into split on
        splits = np.ones(len(part), bool)
        splits[largest[rest < most]] = False
        remains = (rest > 0) & (rest < most)
        splitters = g[np.repeat(splits, part)]
        if remains.any():
            splitters = np.r_[splitters, members[_ranges(begin[owner[remains]], rest[remains])]]
        level += 1

    broken(np.flatnonzero(after >= 0), n)
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([s for s, _ in found]), np.concatenate([p for _, p in found])


def find_runs(texts: list[list], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text, a list of words, by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    asked = [i for i, t in enumerate(texts) if len(t) >= max(least, times)]
    if not asked:
        return out
    lengths = np.array([len(texts[i]) for i in asked])
    ids: dict = {}
    words = np.fromiter((ids.setdefault(w, len(ids)) for i in asked for w in [*texts[i], None]), np.int64)
    ends = np.cumsum(lengths + 1)
    text = np.repeat(np.arange(len(asked)), lengths + 1)
    # a text's words are its own, and each text ends with a position that is like no other
    _, classes = np.unique(text * len(ids) + words, return_inverse=True)
    start, period = squares(classes, np.repeat(lengths // times, lengths + 1))
    order = np.lexsort((start, period))
    start, period = start[order], period[order]
    if not len(start):
        return out
    head = np.flatnonzero(np.r_[True, (period[1:] != period[:-1]) | (start[1:] != start[:-1] + 1)])
    last = np.r_[head[1:], len(start)] - 1
    start, period, length = start[head], period[head], start[last] - start[head] + 2 * period[head]
    good = length >= np.maximum(least, times * period)
    start, period, length = start[good], period[good], length[good]
    order = np.lexsort((period, start))
    where = np.searchsorted(ends, start, side="right")
    for k in order:
        t = where[k]
        out[asked[t]].append((int(start[k] - (ends[t] - lengths[t] - 1)), int(length[k]), int(period[k])))
    return out


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length by period, compared exactly; runs come by start and period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds behind its first period."""
    if not runs:
        return words
    inside = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        inside[start + period] += 1
        inside[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(inside[:-1]) == 0)]


def _run_array(runs: list[tuple[int, int, int] | None]) -> pa.Array:
    whole = np.array([r or (0, 0, 0) for r in runs], np.int64).reshape(-1, 3)
    missing = pa.array([r is None for r in runs], pa.bool_())
    return pa.StructArray.from_arrays([pa.array(whole[:, i]) for i in range(3)], ["start", "length", "period"], mask=missing)


def periodic(text: Column, least: int = LEAST, times: int = TIMES) -> Column:
    """Column of runs, best run (null where there is none) and collapsed text: kept words joined by one space."""

    @F.arrow_udf(PERIODIC)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            runs: list[list[tuple[int, int, int]]] = []
            collapsed: list[str] = []
            group: list[list[bytes]] = []
            held = 0

            def close() -> None:
                found = find_runs(group, least, times)
                runs.extend(found)
                collapsed.extend(b" ".join(kept_words(w, r)).decode("utf-8", "surrogatepass") for w, r in zip(group, found, strict=True))
                group.clear()

            for value in batch:
                words = value.as_py().encode("utf-8", "surrogatepass").split()
                if held + len(words) > GROUP_WORDS:
                    close()
                    held = 0
                group.append(words)
                held += len(words)
            close()
            flat = _run_array([r for rs in runs for r in rs])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), flat)
            yield pa.StructArray.from_arrays([lists, _run_array(list(map(best_run, runs))), pa.array(collapsed, pa.string())], ["runs", "best", "collapsed"])

    return run(text_of(text))


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs with ``periodic``: runs, best run and collapsed text; it replaces a column of that name."""
    enable_workers(docs.sparkSession)
    return docs.withColumn("periodic", periodic(F.col(text), least, times))


def with_period(text: Column, doc_id: Column) -> Column:
    """The text, but for one id in ten (by its checksum), whose words from some word on repeat with some period.

    A null id leaves the text as it is.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text_of(text), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    n = F.size(words)
    a = F.pmod(g, n).cast("int")
    p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
    unit = F.slice(words, a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(text)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Every document, one in ten with a planted period: number of runs, best run, digests of runs and collapsed text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = periodic_runs(docs.select("doc_id", with_period(F.col("text"), F.col("doc_id")).alias("text")))
    lines = F.transform("periodic.runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = F.col("periodic.best")
    return found.select(
        "doc_id",
        F.size("periodic.runs").cast("long").alias("n_runs"),
        *[best[k].alias(k) for k in ("start", "length", "period")],
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("periodic.collapsed"), 256).alias("collapsed_sha256"),
    )
