"""Token counts of texts that look like the vocabulary's own marks, against the library."""

import random

import pytest

from lorespark.llm import token_counts

TAGS = ["<unk>", "<s>", "</s>", "<0x41>", "<0x09>", "<", "unk", ">", "▁", " ", "\t", "\n", "é", "字", "😀", "a", "the ", "x<unk>y", "<unk><unk>", "\u0001", "<pad>"]


@pytest.mark.parametrize("fallback", [True, False])
def test_tag_like_texts_equal_the_library(fallback):
    pieces = token_counts.vocabulary(token_counts.default_path())
    if not fallback:
        pieces = [(p, s) for p, s in pieces if not (p.startswith("<0x") and p.endswith(">"))]
    library, own = token_counts.tokenizer(pieces), token_counts.Counter(pieces)
    rng = random.Random(11)
    for _ in range(4000):
        text = "".join(rng.choice(TAGS) for _ in range(rng.randint(0, 9)))
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)
    assert own.count("\t<unk>") == (7 if fallback else 2)


def test_a_small_vocabulary_with_ties():
    pieces = [("<unk>", -3.0), ("▁", -1.0), ("a", -2.0), ("aa", -4.0), ("b", -1.5), ("ab", -3.5), ("▁a", -3.0), ("<0x63>", -9.0)]
    library, own = token_counts.tokenizer(pieces), token_counts.Counter(pieces)
    rng = random.Random(12)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "b", "c", "d", " ", "<unk>", "<"]) for _ in range(rng.randint(0, 12)))
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)
