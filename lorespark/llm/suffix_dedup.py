"""Suffix-array dedup: difference-cover blockwise construction, dealt out by content.

A byte goes where a string of ``LENGTH`` bytes that covers it also starts earlier. All
suffixes that share their first LENGTH bytes must meet in one suffix bucket, and no task can
hold the whole text. So a bucket is named by content: each start belongs to the anchor, the
least hashed ``GRAM``-gram of its LENGTH bytes. Equal strings have equal anchors at equal
offsets, whatever surrounds them.

1. Documents that repeat an earlier one byte by byte are settled by their digest.
2. Each text's anchors are packed by hash range, and anchors that only one text has are
   dropped: no string with such an anchor repeats.
3. The starts of a remaining anchor, with the bytes they cover, are a fragment. Equal
   fragments collapse before the shuffle: all but the earliest are settled.
4. Fragments are dealt by ranges of (anchor, hash), so a crowded anchor spreads over tasks.
   A task sorts one block of buckets at a time. Fragments stand in the block with their
   anchors at equal residues modulo ``PERIOD``. Ranks of the sample suffixes at the
   residues of a difference cover are computed first, by doubling, up to more than LENGTH
   bytes. A suffix is then sorted by its bytes up to its next sample position and by that
   sample's rank, so ties of any length are resolved by one number, and memory is bounded
   by the block. Neighbours in that order are compared byte for byte.
5. Buckets that blocks or tasks share hand on the earliest start of each of their strings;
   these meet by digest.

The settled starts become byte ranges of their documents, and the texts are cut once.

Defined cases: a null text is empty; texts under LENGTH bytes lose nothing; of rows that
repeat an id, the order is that of their texts' digests, and fully equal rows count as one
document whose result each gives; null ids come last; texts of any length are read in pieces
that overlap; extra columns are not read, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, text_of

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1  # grams in a string
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)  # every difference modulo 31 occurs in the cover
BATCH_BYTES, PACK_ANCHORS, BLOCK_BYTES = 1 << 21, 700_000, 2 << 20
BUCKET_BYTES, TASK_BYTES = 16 << 20, 128 << 20  # of text, a bucket of anchors and a task
_U = np.uint64
_LOW = _U(0xFFFFFF)
_TABLE = np.random.Generator(np.random.PCG64(8)).integers(0, 2**64, 256, dtype=_U)
_STEP = np.array([min((c - r) % PERIOD for c in COVER) for r in range(PERIOD)])  # to the next sample


def grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place."""
    h, m = _TABLE[data], 1
    while m < GRAM:
        h = h[:-m] * _U(0x9E3779B97F4A7C15 + 2 * m) + h[m:]
        h ^= h >> _U(29)
        m *= 2
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(32)
    return h


def runs(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of texts in batches: (first text, text index, anchor hash, first start, end start, anchor place) of each run of starts with one anchor."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BATCH_BYTES):
            size += len(texts[end])
            end += 1
        part = texts[at:end]
        yield (at, *_runs(part)) if size <= 8 * BATCH_BYTES else (at, *_long_runs(part[0]))
        at = end


def _long_runs(text: bytes) -> tuple[np.ndarray, ...]:
    """A very long text in pieces that overlap, so that each start has its whole window in one."""
    out, step = [], 4 * BATCH_BYTES
    for at in range(0, max(1, len(text) - LENGTH + 1), step):
        _, a, lo, hi, place = _runs([text[at : at + step + LENGTH - 1]])
        out.append((np.zeros(len(a), np.int64), a, lo + at, hi + at, place + at))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    sizes = np.array([len(t) for t in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    counts = np.maximum(sizes - LENGTH + 1, 0)
    total = int(counts.sum())
    empty = np.zeros(0, np.int64)
    if not total:
        return empty, empty, empty, empty, empty
    h = grams(data)
    # the least hash of a window, of equal ones the last: the place stands in the low bits
    key = (h & ~_LOW) | (_LOW - (np.arange(len(h), dtype=_U) & _LOW))
    width = 1
    while width * 2 <= SPAN:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < SPAN:
        key = np.minimum(key[: len(key) - (SPAN - width)], key[SPAN - width :])
    doc = np.repeat(np.arange(len(texts)), counts)
    first = np.cumsum(counts) - counts
    start = np.arange(total) - first[doc] + offsets[doc]
    place = (_LOW - (key[start] & _LOW)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    d = doc[new]
    lo = start[new]
    hi = np.concatenate([start[new[1:] - 1], start[-1:]]) + 1
    return d, h[place[new]].view(np.int64), lo - offsets[d], hi - offsets[d], place[new] - offsets[d]


PACKED = "bucket int, known boolean, a binary, k binary, t binary"


def _pack(n_buckets: int):
    """Anchors of each text, packed by hash range. An anchor that repeats here is known already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            a, k, t = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((k, t, a))
            a, k, t = a[order], k[order], t[order]
            new = np.concatenate([[True], (a[1:] != a[:-1])])
            group = np.cumsum(new) - 1
            size = np.bincount(group)
            same_text = np.concatenate([[False], (t[1:] == t[:-1]) & ~new[1:]])
            same_row = np.concatenate([[False], (k[1:] == k[:-1]) & same_text[1:]])
            # an anchor repeats here if two texts have it, or one text twice
            distinct = np.bincount(group, ~same_text)
            twice = np.bincount(group, same_row) > 0
            known = ((distinct > 1) | twice)[group] & (size > 1)[group]
            ask = np.flatnonzero(new)
            rows: list[tuple] = []
            # one entry an anchor asks; if it is known, a second text is made up for it
            qa, qk, qt = a[ask], k[ask], t[ask]
            more = known[ask]
            qa, qk, qt = np.concatenate([qa, qa[more]]), np.concatenate([qk, qk[more]]), np.concatenate([qt, ~qt[more]])
            b = (qa.view(_U) >> _U(40)).astype(np.int64) * n_buckets >> 24
            order = np.argsort(b, kind="stable")
            edges = np.flatnonzero(np.concatenate([[True], np.diff(b[order]) != 0, [True]]))
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                x = order[i:j]
                rows.append((int(b[x[0]]), False, qa[x].tobytes(), qk[x].tobytes(), qt[x].tobytes()))
            told = np.flatnonzero(known & ~same_row)
            for i in range(0, len(told), 20_000):
                x = told[i : i + 20_000]
                rows.append((int(k[x[0]] % n_buckets), True, a[x].tobytes(), k[x].tobytes(), b""))
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()), strict=True)],
                names=["bucket", "known", "a", "k", "t"],
            )

        for batch in batches:
            keys = np.asarray(batch.column(0))
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            for at, doc, a, *_ in runs(texts):
                if len(a):
                    part = texts[at : at + int(doc[-1]) + 1]
                    digest = np.array([int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) for x in part], np.int64)
                    held.append((a, keys[at + doc], digest[doc]))
                    n += len(a)
            if n >= PACK_ANCHORS:
                yield flush()
                n = 0
        if held:
            yield flush()

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, anchor) of anchors with more than one text, from packed rows sorted by bucket."""

    def settle(held: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
        a, k, t = (np.frombuffer(b"".join(c), np.int64) for c in zip(*held, strict=True))
        order = np.argsort(a, kind="stable")
        sa, st = a[order], t[order]
        new = np.flatnonzero(np.concatenate([[True], sa[1:] != sa[:-1]]))
        differ = np.minimum.reduceat(st, new) != np.maximum.reduceat(st, new)
        keep = order[np.repeat(differ, np.diff(np.append(new, len(sa))))]
        return pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(a[keep])], names=["key", "a"])

    bucket, held = None, []
    for batch in batches:
        for b, known, a, k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if known:
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(k, np.int64)), pa.array(np.frombuffer(a, np.int64))], names=["key", "a"])
                continue
            if b != bucket and held:
                yield settle(held)
                held = []
            bucket = b
            held.append((a, k, t))
    if held:
        yield settle(held)


FRAGMENT = "a long, h long, key long, lo int, n int, off int, s binary"


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments of texts at their repeated anchors; of equal ones here the earliest, the others settled (no bytes)."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], names=["a", "h", "key", "lo", "n", "off", "s"])

    for batch in batches:
        keys = batch.column(0).to_pylist()
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
        wanted = batch.column(2).to_pylist()
        first: dict[bytes, tuple] = {}
        size, rows = 0, []
        for at, doc, a, lo, hi, place in runs(texts):
            if not len(doc):
                continue
            edges = np.searchsorted(doc, np.arange(int(doc[-1]) + 2))
            for d in range(int(doc[-1]) + 1):
                i, j = edges[d], edges[d + 1]
                if i == j:
                    continue
                key, text = keys[at + d], texts[at + d]
                hit = np.flatnonzero(np.isin(a[i:j], np.array(wanted[at + d], np.int64))) + i
                for a_, lo_, hi_, place_ in zip(a[hit].tolist(), lo[hit].tolist(), hi[hit].tolist(), place[hit].tolist(), strict=True):
                    s = text[lo_ : hi_ + LENGTH - 1]
                    f = hashlib.blake2b(s, digest_size=16, salt=(place_ - lo_).to_bytes(2, "little")).digest()
                    row = (a_, int.from_bytes(f[:8], "little", signed=True), key, lo_, hi_ - lo_, place_ - lo_, s)
                    other = first.get(f)
                    if other is None:
                        first[f] = row
                        size += len(s)
                    else:
                        if (key, lo_) < (other[2], other[3]):
                            first[f], row = row, other
                        rows.append((row[1], row[2], row[2], row[3], row[4], 0, None))
            if size > 8 * BLOCK_BYTES:
                yield out([*first.values(), *rows])
                first, rows, size = {}, [], 0
        yield out([*first.values(), *rows])


def cover_ranks(words: np.ndarray, size: int) -> np.ndarray:
    """Rank of each sample suffix of the block by its first 125 bytes; other places 0.

    words[i] is the 8 bytes from place i, big-endian. Ranks by 32 bytes come from a sort;
    each doubling joins a rank with the one 31, then 62 places on, which are samples too.
    """
    places = np.flatnonzero(np.isin(np.arange(size) % PERIOD, COVER))
    rank = np.zeros(size + 4 * PERIOD, np.int64)

    def number(keys: list[np.ndarray]) -> None:
        order = np.lexsort(keys[::-1])
        differ = np.zeros(len(order), bool)
        for k in keys:
            sorted_ = k[order]
            differ[1:] |= sorted_[1:] != sorted_[:-1]
        ranks = np.empty(len(order), np.int64)
        ranks[order] = np.cumsum(differ) + 1
        rank[places] = ranks

    number([words[places + d] for d in (0, 8, 16, 24)])
    for shift in (PERIOD, 2 * PERIOD):
        number([rank[places], rank[places + shift]])
    return rank


def sort_block(fragments: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Sorts the suffixes at the starts of fragments (offset of anchor, bytes), each of one bucket group.

    Returns (fragment, start in it, class) in sorted order, and the fragments' places; equal
    classes: the same LENGTH bytes at the same offset from the anchor.
    """
    places, at = [], 0
    parts: list[bytes] = []
    for off, s in fragments:
        pad = -(at + off) % PERIOD
        parts += [b"\0" * pad, s]
        places.append(at + pad)
        at += pad + len(s)
    size = at
    data = np.frombuffer(b"".join(parts) + b"\0" * (LENGTH + 4 * PERIOD), np.uint8)
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view(">u8").reshape(-1).astype(_U)
    rank = cover_ranks(words, size)
    counts = np.array([len(s) - LENGTH + 1 for _, s in fragments])
    frag = np.repeat(np.arange(len(fragments)), counts)
    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    place = np.array(places)[frag] + start
    residue = place % PERIOD
    step = _STEP[residue]
    offset = start - np.array([off for off, _ in fragments])[frag]  # from the anchor, at most 0
    # the bytes before the next sample: at most 12, the widest gap of the cover
    head = words[place]
    tail = words[place + 8]
    bits = np.minimum(step, 8) * 8
    head = np.where(bits == 0, _U(0), head >> (_U(64) - np.maximum(bits, 1).astype(_U)))
    bits = np.clip(step - 8, 0, 8) * 8
    tail = np.where(bits == 0, _U(0), tail >> (_U(64) - np.maximum(bits, 1).astype(_U)))
    order = np.lexsort((rank[place + step], tail, head, offset))
    p, o = place[order], offset[order]
    differ = np.ones(len(order), bool)
    same = o[1:] == o[:-1]
    for d in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        same &= words[p[1:] + d] == words[p[:-1] + d]
    differ[1:] = ~same
    return frag[order], start[order], np.cumsum(differ) - 1, places


SETTLED = "key long, lo int, hi int, d binary"


def _sort_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settles starts from fragments sorted by (a, h). Rows with d: earliest starts of strings that other blocks may hold."""
    settled: list[np.ndarray] = []
    shared: list[tuple[int, int, bytes]] = []

    def out() -> pa.RecordBatch:
        rows = np.concatenate(settled) if settled else np.zeros((0, 3), np.int64)
        n = len(rows)
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([rows[:, 0], np.array([x[0] for x in shared], np.int64)]), pa.int64()),
                pa.array(np.concatenate([rows[:, 1], np.array([x[1] for x in shared], np.int64)]), pa.int32()),
                pa.array(np.concatenate([rows[:, 2], np.array([x[1] + 1 for x in shared], np.int64)]), pa.int32()),
                pa.array([None] * n + [x[2] for x in shared], pa.binary()),
            ],
            names=["key", "lo", "hi", "d"],
        )
        settled.clear()
        shared.clear()
        return batch

    def settle(rows: list[tuple], open_: set[int]) -> None:
        """rows: (a, key, lo, n, off, bytes); open_: anchors that other blocks may hold too."""
        first: dict[tuple, tuple] = {}
        gone = []
        for r in rows:
            f = (r[0], r[4], r[5])
            other = first.get(f)
            if other is None:
                first[f] = r
            else:
                if (r[1], r[2]) < (other[1], other[2]):
                    first[f], r = r, other
                gone.append((r[1], r[2], r[2] + r[3]))
        if gone:
            settled.append(np.array(gone, np.int64))
        count: dict[int, int] = {}
        for f in first:
            count[f[0]] = count.get(f[0], 0) + 1
        live = [r for r in first.values() if count[r[0]] > 1 or r[0] in open_]
        if not live:
            return
        frag, start, cls, _ = sort_block([(r[4], r[5]) for r in live])
        key = np.array([r[1] for r in live], np.int64)[frag]
        begin = np.array([r[2] for r in live], np.int64)[frag] + start
        when = np.empty(len(key), np.int64)
        when[np.lexsort((begin, key))] = np.arange(len(key))
        new = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
        low = np.minimum.reduceat(when, new)
        later = np.flatnonzero(when != low[cls])
        if len(later):
            o = later[np.argsort(when[later], kind="stable")]
            k, b = key[o], begin[o]
            cut = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (b[1:] != b[:-1] + 1), [True]]))
            settled.append(np.stack([k[cut[:-1]], b[cut[:-1]], b[cut[1:] - 1] + 1], 1))
        if open_:
            for i in np.flatnonzero(when == low[cls]).tolist():
                r = live[frag[i]]
                if r[0] in open_:
                    s = int(start[i])
                    shared.append((int(key[i]), int(begin[i]), hashlib.blake2b(r[5][s : s + LENGTH], digest_size=16).digest()))

    block: list[tuple] = []
    size, current, opened, begun = 0, None, set(), False
    for batch in batches:
        for a, _, key, lo, n, off, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if s is None:
                settled.append(np.array([(key, lo, lo + n)], np.int64))
                continue
            if a != current:
                if size >= BLOCK_BYTES:
                    settle(block, opened)
                    block, size, opened = [], 0, set()
                if not begun:  # the task before may hold the first anchor too
                    opened, begun = {a}, True
                current = a
            elif size >= 2 * BLOCK_BYTES:  # a crowded anchor takes several blocks
                opened.add(a)
                settle(block, opened)
                block, size, opened = [], 0, {a}
            block.append((a, key, lo, n, off, s))
            size += len(s)
        if len(settled) > 2000 or len(shared) > 20_000:
            yield out()
    if block:
        opened.add(current)  # the task after may hold the last anchor too
        settle(block, opened)
    yield out()


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def cut(data: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, list[list[int]]]:
    """data without the byte ranges, and the maximal removed runs."""
    spans: list[list[int]] = []
    for a, b in sorted(ranges):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]]), spans


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, text, whole, los, his in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            ranges = [(0, len(data))] if whole and len(data) >= LENGTH else [(a, b + LENGTH - 1) for a, b in zip(los or (), his or (), strict=True)]
            kept, spans = cut(data, ranges)
            rows.append((i, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _numbered(work: Work, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, key) of all rows, and (key, text) of distinct ones. key is doc_id unless ids repeat or are null."""
    facts = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if not facts.take(1):
        docs = docs.withColumn("key", F.col("doc_id"))
        return docs, docs.select("key", "text")
    # the rare case: distinct rows get numbers that rise in order of id and digest, equal rows share a number
    marks = docs.select("doc_id", F.sha2("text", 256).alias("sha")).distinct().orderBy(F.col("doc_id").asc_nulls_last(), "sha")
    numbered = work.save(marks.select(F.col("doc_id").alias("n_id"), F.col("sha").alias("n_sha"), F.monotonically_increasing_id().alias("key")), "numbered")
    here = docs.withColumn("sha", F.sha2("text", 256))
    docs = here.join(numbered, (F.col("sha") == F.col("n_sha")) & F.col("doc_id").eqNullSafe(F.col("n_id"))).select("doc_id", "text", "key")
    return docs, docs.select("key", "text").dropDuplicates(["key"])


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[Work, DataFrame, DataFrame]:
    """(work, docs with doc_id, text, key, facts): facts has for keys with removals ``whole`` or the start ranges (los, his)."""
    spark = docs.sparkSession
    work = Work(spark, "suffixes")
    docs, once = _numbered(work, docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")))
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    marks = work.save(once.select("key", F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("size")), "marks")
    # buckets and tasks follow the bytes, so neither a bucket nor a task grows with the input
    size = marks.agg(F.sum("size")).first()[0] or 0
    buckets, parts = max(8 * parts, -(-size // BUCKET_BYTES)), max(parts, -(-size // TASK_BYTES))
    first = work.save(marks.groupBy("sha").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1"), "first")
    copies = work.save(marks.join(first, "sha").where("key <> first").select("key").distinct(), "copies")
    work.drop("marks", "first")

    packed = once.mapInArrow(_pack(buckets), PACKED)
    packed = packed.repartition(parts, "bucket").sortWithinPartitions("bucket")
    known = packed.mapInArrow(_repeated, "key long, a long").join(copies, "key", "left_anti")
    known = work.save(known.groupBy("key").agg(F.collect_set("a").alias("wanted")), "known")

    held = once.join(known, "key").select("key", "text", "wanted")
    fragments = held.mapInArrow(_fragments, FRAGMENT).repartitionByRange(parts, "a", "h").sortWithinPartitions("a", "h")
    settled = work.save(fragments.mapInArrow(_sort_blocks, SETTLED), "settled")
    work.drop("known")

    shared = settled.where("d is not null").select("d", F.struct("key", "lo").alias("at"))
    earliest = work.save(shared.groupBy("d").agg(F.min("at").alias("low"), F.count("*").alias("n")).where("n > 1"), "earliest")
    late = shared.join(earliest, "d").where("at > low").select("at.key", "at.lo", (F.col("at.lo") + 1).alias("hi"))
    ranges = settled.where("d is null").select("key", "lo", "hi").union(late)
    facts = ranges.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("r")).select("key", F.lit(False).alias("whole"), F.col("r.lo").alias("los"), F.col("r.hi").alias("his"))
    none = F.array().cast("array<int>")
    facts = work.save(facts.union(copies.select("key", F.lit(True), none, none)), "facts")
    work.drop("settled", "copies", "earliest")
    return work, docs, facts


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    _, docs, facts = repeats(docs, doc_id, text)
    joined = docs.join(facts, "key", "left").select("doc_id", "text", "whole", "los", "his")
    return joined.mapInArrow(_cut_texts, RESULT)


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's bytes, removed bytes and runs, and the digest of what is left."""
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def brute_force(rows: list[tuple[int, str | None]]) -> list[tuple]:
    """The result from a dictionary of all strings, for tests; ids are distinct."""
    seen: set[bytes] = set()
    out = []
    for i, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        covered = bytearray(len(data))
        for s in range(len(data) - LENGTH + 1):
            piece = data[s : s + LENGTH]
            if piece in seen:
                covered[s : s + LENGTH] = b"\1" * LENGTH
            seen.add(piece)
        kept = bytes(b for b, c in zip(data, covered, strict=True) if not c)
        spans = sum(1 for s in range(len(data)) if covered[s] and not (s and covered[s - 1]))
        out.append((i, len(data), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return out
