"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton of the pieces enumerates every vocabulary match in a run; dynamic
programming over end positions carries the best score and its piece count, and nothing
else. Tie rule of the unigram tokenizer: starts are taken in order and a path replaces
another only with a strictly greater score, so among equal scores the longest last piece
stays. A character that no single-character piece covers is an unknown piece at the least
score less 10, and so is a match of the unknown piece's own text, at its score. Neighbouring
unknown pieces are one stretch: it counts as one if its text is a piece, else as its bytes'
pieces if the vocabulary has all of them (byte fallback), else as one.

The text is split before white-space runs' marks as the tokenizer's word splitter does, so
a word's count does not depend on its neighbours; a bounded store keeps counts of words.

The vocabulary is the pieces and scores of a public model file, used as they stand; none is
trained. Defined cases: a null or empty text has 0 tokens; each row gives its own row; an
empty table gives an empty result; texts of any length are counted whole; other columns stay,
but for one named ``n_pieces``, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import enable_workers, text_of

MARK = "▁"
CACHE_WORDS, LONG_WORD = 400_000, 64
UNKNOWN_PENALTY = 10.0


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a model file, in id order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())]


def tokenizer(pieces: list[tuple[str, float]], unknown: int = 0):
    """The same unigram tokenizer in a public library, to test against."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    out = Tokenizer(models.Unigram(pieces, unknown, True))
    out.pre_tokenizer = pre_tokenizers.Metaspace(replacement=MARK, prepend_scheme="always", split=True)
    return out


class Counter:
    """Piece counts of texts."""

    def __init__(self, pieces: list[tuple[str, float]], unknown: int = 0):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece and not self.automaton.exists(piece):
                self.automaton.add_word(piece, (len(piece), score, piece == pieces[unknown][0]))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.known = {p for p, _ in pieces}
        self.bytes = {b for b in range(256) if f"<0x{b:02X}>" in self.known}
        self.kept: dict[str, int] = {}

    def stretch(self, text: str) -> int:
        """Pieces of neighbouring unknown pieces."""
        raw = text.encode("utf-8", "surrogatepass")
        return 1 if text in self.known or not self.bytes.issuperset(raw) else len(raw)

    def word(self, word: str) -> int:
        """Pieces of one word, its mark included."""
        n = len(word)
        ends: list[list[tuple[int, float, bool]]] = [[] for _ in range(n + 1)]
        for last, (length, score, unknown) in self.automaton.iter(word):
            ends[last + 1].append((last + 1 - length, score, unknown))
        # the best path to each end: its score, its pieces before the unknown stretch that it ends with, where that begins (-1: none)
        best, pieces, begun = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        for end in range(1, n + 1):
            top, at, odd, single = None, 0, False, False
            for start, score, unknown in sorted(ends[end]):
                single = single or start == end - 1
                if top is None or best[start] + score > top:
                    top, at, odd = best[start] + score, start, unknown
            if not single and (top is None or best[end - 1] + self.unknown > top):
                top, at, odd = best[end - 1] + self.unknown, end - 1, True
            best[end] = top
            if odd:
                begun[end], pieces[end] = (begun[at], pieces[at]) if begun[at] >= 0 else (at, pieces[at])
            else:
                pieces[end] = pieces[at] + 1 + (self.stretch(word[begun[at] : at]) if begun[at] >= 0 else 0)
        return pieces[n] + (self.stretch(word[begun[n] :]) if begun[n] >= 0 else 0)

    def count(self, text: str | None) -> int:
        """Pieces of a whole text."""
        if not text:
            return 0
        total, kept = 0, self.kept
        marked = text.replace(" ", MARK)
        if marked[0] != MARK:
            marked = MARK + marked
        for part in marked.split(MARK)[1:]:
            n = kept.get(part)
            if n is None:
                n = self.word(MARK + part)
                if len(part) <= LONG_WORD:
                    if len(kept) >= CACHE_WORDS:
                        kept.clear()
                    kept[part] = n
            total += n
        return total


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The worker's counter, whose store outlives a task."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(vocabulary(path))
    return _COUNTERS[path]


def token_count(text: Column, path: str) -> Column:
    """Column of piece counts."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(path)
        for batch in batches:
            yield pd.Series([c.count(t) for t in batch], dtype="int64")

    return run(text_of(text))


def count_tokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with ``n_pieces``, which replaces a column of that name."""
    enable_workers(docs.sparkSession)
    return docs.withColumn("n_pieces", token_count(F.col(text), path))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents: its piece count, characters and characters a piece."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n = F.length(text_of("text")).cast("long")
    return count_tokens(docs, default_path()).select(
        "doc_id", F.col("n_pieces"), n.alias("n_characters"), F.when(F.col("n_pieces") > 0, n / F.col("n_pieces")).alias("characters_per_piece")
    )
