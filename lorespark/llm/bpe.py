"""BPE encoding and decoding with content-defined chunk reuse.

A text's UTF-8 bytes are cut, between characters, where a rolling hash of the last ``WINDOW``
bytes has its low bits zero, so equal passages give equal chunks in whatever document they
stand. A chunk is encoded once and kept. Its encoding covers the whole words between its
first and last white space; its two ends are open, for a cut may part a word, a composed
character or a special token. Each join of two chunks is then repaired: the tokenizer
re-encodes the open ends together with one whole word of either chunk, its guards. The join
is closed where the ids of both guards come out exactly as the chunks have them: the
tokenizer's state is empty at white space, so what lies outside of the guards agrees too.
Until they agree the guards grow, at last to the whole text. A chunk without a whole word
lies open in its join. Joins are kept like chunks, so a shared passage costs one encoding.

Inside a chunk, each word is encoded once too: the tokenizer alone, chunk by chunk, would need
a half more time. Texts are taken in runs of ``BATCH_CHARS``, whose new words and joins go to
the tokenizer in one call each. The stores are bounded: beyond ``CACHE_WORDS`` words only those
that came again stay, chunks and joins are kept in two generations of ``CACHE_CHUNKS``; what is
dropped is only encoded again. They live in the Python worker, so a lost executor loses nothing
but them; ``Encoder.counts`` tells how often they served.

Defined cases: null text is empty: no ids, empty decoded text; each row of a repeated id
gives its own row; an empty table gives an empty result; texts of any length are encoded
whole; other columns stay, but for one named ``bpe``, which is replaced.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import enable_workers, text_of

WINDOW = 16
MASK = 0x3FF  # 1024 bytes a chunk on average
CACHE_WORDS, CACHE_CHUNKS, LONG_WORD, BATCH_CHARS = 120_000, 3_000, 200, 1_000_000
GUARDS = 2  # whole words of either chunk that a join may grow over
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")  # the tokenizer's \s; not \x1c-\x1f
_SEPARATORS = re.compile("[\x1c-\x1f]")
_PACK = struct.pack
_GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 2**63, 256, dtype=np.uint64)


def split_words(text: str) -> list[str]:
    """White-space-free runs, as the tokenizer sees white space."""
    if _SEPARATORS.search(text):
        return [w for w in SPACE.split(text) if w]
    return text.split()


def cuts(data: bytes) -> list[int]:
    """Chunk ends: where the gear hash of the last WINDOW bytes has its low bits zero."""
    n = len(data)
    if n <= WINDOW:
        return [n] if n else []
    gear = _GEAR[np.frombuffer(data, np.uint8)]
    h = gear.copy()
    # h[i] = sum of gear[i-k] << k for k < WINDOW, by doubling
    width = 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint64(width)
        width *= 2
    low = (h >> np.uint64(WINDOW - 1)) & np.uint64(MASK)
    at = np.flatnonzero(low[WINDOW:] == 0) + WINDOW + 1
    out = []
    for end in at.tolist():
        while end < n and data[end] & 0xC0 == 0x80:  # inside a character
            end += 1
        if not out or end > out[-1]:
            out.append(end)
    if not out or out[-1] != n:
        out.append(n)
    return out


class _Store:
    """A bounded mapping of two generations."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def get(self, key):
        value = self.new.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self[key] = value
        return value

    def __setitem__(self, key, value):
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value


class Chunk:
    """An encoded chunk: its open ends, its first and last whole words, and what they and all between encode to."""

    __slots__ = ("head", "head_ids", "ids", "left", "right", "said", "tail", "tail_ids", "words")

    def __init__(self, left: str, words: list[str], right: str):
        self.left, self.words, self.right = left, words, right
        self.head, self.tail = tuple(words[:GUARDS]), tuple(words[-GUARDS:])
        self.ids, self.said = b"", ""
        self.head_ids = self.tail_ids = ()

    def settle(self, known: dict[str, tuple[bytes, str]]) -> None:
        found = [known[w] for w in self.words]
        self.ids, self.said = b"".join([x[0] for x in found]), " ".join([x[1] for x in found if x[0]])
        self.head_ids, self.tail_ids = tuple(x[0] for x in found[:GUARDS]), tuple(x[0] for x in found[-GUARDS:])
        self.words = []


class Encoder:
    """Encodes and decodes whole texts exactly as the tokenizer file's own library does."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task slots are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.names = {i: name for name, i in vocabulary.items()}
        self.words: dict[str, tuple[bytes, str]] = {}
        self.often: set[str] = set()  # words that were there when they came again
        self.chunks, self.joins = _Store(CACHE_CHUNKS), _Store(CACHE_CHUNKS)
        self.counts: Counter[str] = Counter()

    def _encode_words(self, words: list[str]) -> None:
        """Encodes new words, many to a text: white space parts them exactly, and offsets tell whose token is whose."""
        names, known = self.names, self.words
        parts = [words[i : i + 256] for i in range(0, len(words), 256)]
        for part, e in zip(parts, self.tokenizer.encode_batch([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = e.ids
            ends = list(accumulate(len(w) + 1 for w in part))
            edges = np.searchsorted([a for a, _ in e.offsets], ends).tolist() if ids else [0] * len(part)
            lo = 0
            for word, hi in zip(part, edges, strict=True):
                own = ids[lo:hi]
                lo = hi
                # the file names no decoder, so decoding joins the tokens by a space
                known[word] = (_PACK(f"<{len(own)}I", *own), " ".join([names[i] for i in own]))

    def _open(self, text: str) -> Chunk | None:
        """The chunk with its whole words, still to be encoded; None where it has none."""
        first = SPACE.search(text)
        if first is None:
            return None
        words = split_words(text[first.end() :])
        right = words.pop() if words and not SPACE.match(text[-1]) else ""  # open unless white space follows
        return Chunk(text[: first.start()], words, right) if words else None

    def _whole(self, text: str) -> tuple[bytes, str]:
        """The tokenizer's own encoding of a text."""
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return _PACK(f"<{len(ids)}I", *ids), " ".join([self.names[i] for i in ids])

    def _close(self, wanted: dict[tuple, tuple]) -> dict[tuple, tuple[bytes, str] | None]:
        """Repairs joins (left guards, open text, right guards), given with the ids of their guards; None where these do not agree."""
        out: dict[tuple, tuple[bytes, str] | None] = {}
        keys = list(wanted)
        found = self.tokenizer.encode_batch([" ".join([*left, mid, *right]) for left, mid, right in keys], add_special_tokens=False) if keys else []
        self.counts["joins_encoded"] += len(keys)
        for key, e in zip(keys, found, strict=True):
            before, after = wanted[key]
            ids = e.ids
            data, lo = _PACK(f"<{len(ids)}I", *ids), len(before)
            hi = len(data) - len(after)
            if lo <= hi and data[:lo] == before and data[hi:] == after:
                out[key] = (data[lo:hi], " ".join([self.names[i] for i in ids[lo // 4 : hi // 4]]))
            else:
                out[key] = None
        return out

    def _agree(self, left: Chunk | None, mid: str, right: Chunk | None, guards: int) -> tuple[tuple, tuple]:
        """A join's key with so many guards on either side, and the ids these have in their chunks."""
        key = (left.tail[-guards:] if left else (), mid, right.head[:guards] if right else ())
        return key, (b"".join(left.tail_ids[-guards:]) if left else b"", b"".join(right.head_ids[:guards]) if right else b"")

    def encode_many(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each text."""
        known, kept, fresh = self.words, self.chunks, {}
        plans: list[list] = []
        wanted: set[str] = set()
        for text in texts:
            data, at, mid, last, plan = (text or "").encode(), 0, [], None, []
            for end in cuts(data):
                piece, at = data[at:end], end
                self.counts["chunks"] += 1
                chunk = fresh.get(piece) or kept.get(piece)
                if chunk is None:
                    said = piece.decode()
                    chunk = self._open(said)
                    if chunk is None:
                        mid.append(said)
                        continue
                    self.counts["chunks_encoded"] += 1
                    fresh[piece] = chunk
                    wanted.update(chunk.words)
                plan.append((last, "".join([*mid, chunk.left]), chunk))
                mid, last = [chunk.right], chunk
            plan.append((last, "".join(mid), None))
            plans.append(plan)
        again = {w for w in wanted if w in known}
        self.often |= again
        new = list(wanted - again)
        if new:
            self._encode_words(new)
        for piece, chunk in fresh.items():
            chunk.settle(known)
            if len(piece) <= 8 * (MASK + 1):
                kept[piece] = chunk
        closed: dict[tuple, tuple[bytes, str] | None] = {}
        ask: dict[tuple, tuple] = {}
        for plan in plans:
            for i, (left, mid, right) in enumerate(plan):
                if mid and not SPACE.fullmatch(mid):
                    key, ids = self._agree(left, mid, right, 1)
                    plan[i] = (left, key, right)
                    self.counts["joins"] += 1
                    if key not in closed and key not in ask:
                        if done := self.joins.get(key):
                            closed[key] = done
                        else:
                            ask[key] = ids
                else:
                    plan[i] = (left, None, right)
        for key, done in self._close(ask).items():
            closed[key] = done
            if done and len(key[1]) <= LONG_WORD:
                self.joins[key] = done
        out = []
        for text, plan in zip(texts, plans, strict=True):
            parts: list[tuple[bytes, str]] = []
            for left, join, right in plan:
                if join:
                    done, guards = closed[join], 1
                    while done is None and guards < GUARDS:  # until both sides agree
                        guards *= 2
                        key, ids = self._agree(left, join[1], right, guards)
                        done = self._close({key: ids})[key]
                        self.counts["grown"] += 1
                    if done is None:
                        parts = [self._whole(text)]
                        break
                    parts.append(done)
                if right:
                    parts.append((right.ids, right.said))
            out.append((b"".join([x[0] for x in parts]), " ".join([x[1] for x in parts if x[0]])))
        if len(known) > CACHE_WORDS:  # the words that came again stay
            if len(self.often) > CACHE_WORDS // 2:
                self.often = again
            self.words = {w: known[w] for w in self.often if w in known and len(w) <= LONG_WORD}
        else:
            for w in new:
                if len(w) > LONG_WORD:
                    del known[w]
        return out

    def encode(self, text: str | None) -> tuple[bytes, str]:
        return self.encode_many([text])[0]


def batches_of(texts: list[str], size: int = BATCH_CHARS) -> Iterator[list[str]]:
    """Texts in runs of about size characters."""
    part: list[str] = []
    n = 0
    for text in texts:
        part.append(text)
        n += len(text or "")
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder, whose stores outlive a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(text: Column, path: str, with_ids: bool = False) -> Column:
    """Column of n_tokens and digests of ids and decoded text; with_ids: ids and text too."""
    extra = ", ids array<int>, decoded string" if with_ids else ""

    @F.pandas_udf(f"n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for batch in batches:
            rows = []
            for ids, said in (x for part in batches_of(batch.tolist()) for x in enc.encode_many(part)):
                row = [len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(said.encode("utf-8")).hexdigest()]
                rows.append([*row, np.frombuffer(ids, "<u4").astype("int32"), said] if with_ids else row)
            names = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"][: 2 * with_ids]]
            yield pd.DataFrame(rows, columns=names)
        enc.chunks.old, enc.joins.old = {}, {}  # an idle worker keeps one generation

    return run(text_of(text))


def encode(docs: DataFrame, path: str, text: str = "text", with_ids: bool = True) -> DataFrame:
    """docs with a struct column ``bpe``, which replaces a column of that name."""
    enable_workers(docs.sparkSession)
    return docs.withColumn("bpe", encoded(F.col(text), path, with_ids))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe_encoding(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents: token count, digests of ids and of decoded text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, default_path(), with_ids=False).select("doc_id", "bpe.*")
