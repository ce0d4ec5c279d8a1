"""Scalar functions as column expressions; a Python twin where ingestion needs one."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scripts import FIRST, spell
from .scripts import spelled as spelled_scripts

# Letters that are more than a base letter with marks.
SPECIAL = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "ł": "l", "þ": "th", "ı": "i", "ħ": "h", "ŋ": "ng", "ĸ": "k", "ŀ": "l", "ŧ": "t", "ŉ": "n"}


# Greek and Cyrillic letters in Latin ones, in the order of their alphabets.
GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a b g d e z e th i k l m n x o p r s s t u ph kh ps o".split(), strict=True))
CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщыэюяіїєґўј", "a b v g d e io zh z i i k l m n o p r s t u f kh ts ch sh shch y e iu ia i i ie g u j".split(), strict=True)) | {"ъ": "", "ь": ""}


def _accents() -> dict[str, str]:
    """Lower-case letters with marks, Latin, Greek and Cyrillic, to their base letter, by decomposition."""
    out = {}
    for code in (*range(0xC0, 0x250), *range(0x370, 0x460), *range(0x1E00, 0x2000)):
        c = chr(code).lower()
        base = unicodedata.normalize("NFKD", c)[0]
        if len(c) == 1 and c not in SPECIAL and c not in CYRILLIC and base != c and ((base.isascii() and base.isalpha()) or base in GREEK or base in CYRILLIC):
            out[c] = base
    return out


ACCENTS = _accents()
SCRIPTS = SPECIAL | GREEK | CYRILLIC


def slug(name: Column | str) -> Column:
    """Lower case, ASCII, runs of other characters as one hyphen, no hyphen at the ends; null where nothing is left."""
    c = F.lower(F.col(name) if isinstance(name, str) else name)
    single = {x: y for x, y in SCRIPTS.items() if len(y) == 1}
    single |= {x: single.get(y, y) for x, y in ACCENTS.items()}
    c = F.translate(c, "".join(single), "".join(single.values()))
    # letters of several are rare: they are spelled out where there are any; the text so far is made once, as the item of an array
    several = {x: y for x, y in SCRIPTS.items() if len(y) != 1}

    def spelled(x: Column) -> Column:
        out = x
        for letter, plain in several.items():
            out = F.replace(out, F.lit(letter), F.lit(plain))
        out = F.when(x.rlike("[" + "".join(several) + "]"), out).otherwise(x)
        return F.when(F.octet_length(x) == F.length(x), x).otherwise(spelled_scripts(out))

    c = F.get(F.transform(F.array(c), spelled), F.lit(0))
    c = F.regexp_replace(c, r"\p{M}+", "")
    return F.nullif(F.trim(F.regexp_replace(c, r"[^a-z0-9]+", "-"), F.lit("-")), F.lit(""))


def make_slug(name: str) -> str | None:
    """The same in Python."""
    out = (SPECIAL.get(c) or ACCENTS.get(c, c) for c in name.lower())
    out = "".join(SCRIPTS.get(c, c) for c in out)
    out = "".join(c if ord(c) < FIRST else spell(c) for c in out)
    out = "".join(c for c in out if not unicodedata.category(c).startswith("M"))
    return re.sub(r"[^a-z0-9]+", "-", out).strip("-") or None


def gyear(year: Column) -> Column:
    """Sign and at least four digits."""
    digits = F.abs(year).cast("string")
    padded = F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)
    return F.concat(F.when(year < 0, F.lit("-")).otherwise(F.lit("")), padded)


def year_of(text: Column) -> Column:
    """The year of a lexical form; null where it is none. A plus sign or a point is none."""
    return F.when(text.rlike(r"^\s*-?[0-9]+\s*$"), F.trim(text).try_cast("int"))


def label_of(uri: Column) -> Column:
    """The last path segment."""
    return F.regexp_extract(uri, r"([^/]*)/*$", 1)


def disjoint(a_begin: Column, a_end: Column, b_begin: Column, b_end: Column) -> Column:
    """Whether two year ranges share no year; a null bound is open, touching ranges are not disjoint."""
    return F.coalesce(a_end < b_begin, F.lit(False)) | F.coalesce(b_end < a_begin, F.lit(False))


def year_range(begin: Column, end: Column) -> Column:
    return F.concat_ws("-", F.coalesce(begin.cast("string"), F.lit("?")), F.coalesce(end.cast("string"), F.lit("?")))


def locator(source: Column) -> tuple[Column, Column]:
    """(path, line) of ``path[:line]``; the line is null where there is none."""
    has = source.rlike(r"^(?s:.+):[0-9]+$")
    return (
        F.when(has, F.regexp_extract(source, r"^(?s:(.+)):[0-9]+$", 1)).otherwise(source),
        F.when(has, F.regexp_extract(source, r":([0-9]+)$", 1).try_cast("int")),
    )


# Line ends: those of Python's splitlines.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
BLOCK_PREFIX = "(?U)^(?:#{1,6}\\s+|\\s*[-*+>]\\s+|\\s*[—–―]\\s*)+"
PLACEHOLDER = r"(?i)^\s*\[pending\b[^\]]*\]\s*$"  # of a declaration's body that nobody has written yet
DIALOGUE = "^[—–\\-\"«“'‘]"


def lines(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep..., number, raw, normalized): a row a line, numbered from 1; an end at the end of the text opens no line."""
    parts = F.split(F.col(text), LINE_END)
    parts = F.when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    out = df.select(*keep, F.posexplode(parts).alias("pos", "raw"))
    return out.select(*keep, (F.col("pos") + 1).alias("number"), "raw", strip_prefix(F.col("raw")).alias("normalized"))


def strip_prefix(raw: Column) -> Column:
    """A line without its heading, bullet, quote and leading-dash marks."""
    return F.regexp_replace(raw, BLOCK_PREFIX, "")


def is_dialogue(raw: Column) -> Column:
    return F.ltrim(raw).rlike(DIALOGUE)


def needles(names: DataFrame, name: str = "name") -> DataFrame:
    """(name, needle): each name and its parts of at least three characters."""
    parts = F.concat(F.array(F.col(name)), F.filter(F.split(F.trim(F.col(name)), r"(?U)\s+"), lambda t: F.length(t) >= 3))
    return names.select(F.col(name).alias("name"), F.explode(F.array_distinct(parts)).alias("needle"))
