"""Slugs of names in any script: the expression and its Python twin."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from lorespark.functions.scripts import HANGUL, SYLLABLES, sound, spell
from lorespark.functions.text import make_slug, slug

NAMES = {
    "שלום": "shlvm", "أحمد": "ahmd", "ქართული": "khartuli", "Հայերեն": "hayeren", "नमस्ते": "nmste", "かなカナ": "kanakana", "한글 서울": "hangeul-seoul",
    "中文": "4e2d-6587", "東京 Tower": "6771-4eac-tower", "ﬁne １２": "fine-12", "𐌰": "10330", "Ёлка": "iolka", "Ελλάδα 3": "ellada-3", "！、": None, "": None,
}


def test_names(spark):
    rows = spark.createDataFrame([(n,) for n in [*NAMES, None]], "name string")
    got = {r.name: r.slug for r in rows.select("name", slug("name").alias("slug")).collect()}
    assert got == {**NAMES, None: None}
    assert {n: make_slug(n) for n in NAMES} == NAMES


def test_every_syllable_is_put_together_as_it_is_named():
    for i in range(SYLLABLES):
        c = chr(HANGUL + i)
        assert spell(c) == unicodedata.name(c).rpartition(" ")[2].lower()


def test_the_twins_agree(spark):
    r = random.Random(5)
    spans = [(0x20, 0x7F), (0xC0, 0x17F), (0x391, 0x3CA), (0x410, 0x450), (0x561, 0x587), (0x5D0, 0x5EB), (0x620, 0x64B), (0x905, 0x94E), (0xE01, 0xE3B), (0x10D0, 0x10F1), (0x1200, 0x1240), (0x13A0, 0x13F0),
             (0x3041, 0x3097), (0x30A1, 0x30FB), (0x4E00, 0x9FA0), (0xAC00, 0xD7A4), (0xFF10, 0xFF5B), (0x20000, 0x20100), (0x2010, 0x2040)]
    texts = ["".join(chr(r.randrange(*r.choice(spans))) for _ in range(r.randrange(1, 12))) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, name string").select("i", slug("name").alias("slug"))
    assert {x.i: x.slug for x in rows.collect()} == {i: make_slug(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize(("c", "want"), [("ש", "sh"), ("ა", "a"), ("シ", "si"), ("٣", "3"), ("े", "e"), ("ﾊ", "ha"), ("中", None), ("。", None)])
def test_the_rule(c, want):
    assert sound(c) == want


def test_whole_texts_keep_what_they_had(spark):
    text = "Der Bär — “straße”, naïve 3\u00b2 " * 2000
    got = spark.createDataFrame([(text,)], "t string").select(slug("t")).first()[0]
    assert got == make_slug(text) and got.startswith("der-bar-strasse-naive-3")
    assert spark.range(0).select(slug(F.lit("x"))).count() == 0
