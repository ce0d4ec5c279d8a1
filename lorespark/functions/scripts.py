"""Letters of scripts beyond Latin, Greek and Cyrillic in plain ones, by a rule on their Unicode names.

A letter's name holds its sound: HEBREW LETTER SHIN is sh, HIRAGANA LETTER KA is ka. Of a syllabary
the whole name counts; of an alphabet the consonants it begins with, or its first vowel. Vowel signs give
their name, decimal digits their value, compatibility forms what they stand for. Hangul syllables are
put together from their three parts. Any other letter, such as an ideograph, gives its code point
in hexadecimal, as a word of its own; so no name of letters is without a slug.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST = 0x530  # below are Latin, Greek and Cyrillic
RANGES = [(0x530, 0x2000), (0x3040, 0x3130), (0xFB00, 0xFFF0)]
HANGUL, SYLLABLES, TAILS = 0xAC00, 11172, 28
NOTES = {"CAPITAL", "SMALL", "FINAL", "SARA"}  # words of a name that are no part of the sound


def sound(c: str) -> str | None:
    """What the rule makes of one character; None where it says nothing."""
    kind, name = unicodedata.category(c), unicodedata.name(c, "")
    if kind == "Nd":
        return str(unicodedata.decimal(c))
    plain = unicodedata.normalize("NFKD", c)
    if plain != c and not HANGUL <= ord(c) < HANGUL + SYLLABLES:
        parts = [x if x.isascii() else sound(x) for x in plain if unicodedata.category(x)[0] != "M"]
        return None if None in parts else re.sub("[^a-z0-9]", "", "".join(parts).lower()) or None
    found = re.search(r"(?: (LETTER|CHARACTER|SYLLABLE|VOWEL SIGN)) (.+)$", name)
    if not found or kind[0] not in "LM":
        return None
    words = [w for w in found[2].split() if w not in NOTES]
    word = re.sub(r"[^a-z]", "", words[0].lower()) if words else ""
    whole = found[1] in ("SYLLABLE", "VOWEL SIGN") or name.split()[0] in ("HIRAGANA", "KATAKANA", "CHEROKEE", "BOPOMOFO")
    return word if whole else (re.match(r"[^aeiou]+|[aeiou]", word) or [""])[0]


def _syllable(i: int) -> str:
    return unicodedata.name(chr(HANGUL + i)).rpartition(" ")[2].lower()


_BLOCK = 21 * TAILS  # syllables of one first letter
_SILENT = 11 * _BLOCK  # the first letter that is not spoken
LEADS = [_syllable(i)[:-1] for i in range(0, SYLLABLES, _BLOCK)]
VOWELS = [_syllable(_SILENT + i) for i in range(0, _BLOCK, TAILS)]
ENDS = [_syllable(_SILENT + i)[1:] for i in range(TAILS)]
#: Sounds by code point, an empty entry where the rule says nothing.
TABLES = [(low, high, [sound(chr(i)) or "" for i in range(low, high)]) for low, high in RANGES]


def spell(c: str) -> str:
    """One character from ``FIRST`` on in plain letters."""
    code = ord(c)
    if HANGUL <= code < HANGUL + SYLLABLES:
        first, rest = divmod(code - HANGUL, _BLOCK)
        return LEADS[first] + VOWELS[rest // TAILS] + ENDS[rest % TAILS]
    for low, high, sounds in TABLES:
        if low <= code < high and sounds[code - low]:
            return sounds[code - low]
    return f" {code:x} " if unicodedata.category(c)[0] == "L" else c


def _listed(words: list[str]) -> Column:
    return F.split(F.lit(",".join(words)), ",")  # folded to one constant


def spelled(text: Column) -> Column:
    """The same of a text, as an expression; other characters stay as they are."""

    def one(c: Column) -> Column:
        code = F.ascii(c)
        part = code - HANGUL
        whole = lambda x: F.floor(x).cast("int")
        out = F.when(code < FIRST, c)
        hangul = F.concat(F.get(_listed(LEADS), whole(part / _BLOCK)), F.get(_listed(VOWELS), whole(part % _BLOCK / TAILS)), F.get(_listed(ENDS), part % TAILS))
        out = out.when(code.between(HANGUL, HANGUL + SYLLABLES - 1), hangul)
        for low, high, sounds in TABLES:
            said = F.get(_listed(sounds), code - low)
            out = out.when(code.between(low, high - 1) & (said != ""), said)
        return out.when(c.rlike(r"\p{L}"), F.concat(F.lit(" "), F.lower(F.hex(code)), F.lit(" "))).otherwise(c)

    far = text.rlike(rf"[[\p{{L}}\p{{M}}\p{{Nd}}]&&[^\x00-\u{FIRST - 1:04x}]]")
    return F.when(far, F.array_join(F.transform(F.split(text, ""), one), "")).otherwise(text)
