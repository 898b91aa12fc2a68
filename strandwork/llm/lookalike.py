"""One form for texts that look the same, by a skeleton of look-alike characters.

A text is decomposed, every character is replaced by its prototype, the result is
decomposed again and composed for output.  Equal looks give equal skeletons.

Made equal: width, styled letters and digits of mathematics, composed and combining
accents, ligatures, Roman-numeral signs, invisible characters, kinds of space, line
ends, look-alike letters of another script.  The letters are a list of common ones, or
the file of public confusables that ``STRANDWORK_CONFUSABLES`` names.  Kept apart: letter case, accents, digits, punctuation, the number of
spaces.  A zero-width joiner between two pictographs stays, since it changes what
is drawn.

Defined results: a null text has a null form and is in no group; an empty text is
a text; rows of one text (repeats) are in one class and form no pair with each
other; empty tables give no rows; only the id and text columns are read.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..plans.cut import Cutter

# Letters of other scripts drawn like a Latin letter of the same case.
_CYRILLIC = "аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ӏl ѵv АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ЅS ІI ЈJ ӀI ԚQ ԜW ԌG ѴV ҮY"
_GREEK = "αa γy ιi νv οo ρp σo υu ϲc ϳj ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ"
_OTHER = "օo ոn սu հh ցg զq ՕO ՍU ՏS ⲟo ⲣp ⲥc ⲞO ⲢP ⲤC ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU ᎪA ᎬE ᎢT ᎡR ᎷM ᎻH ᏃZ ᏟC ᏢP ᏦK ᏞL ᏚS ᏙV ᎫJ ɡg ɑa"
#: Characters of category Cf that are drawn.
_DRAWN = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
_UNSEEN = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
_JOINER = "\u200d"
_JOINED = re.compile(_JOINER)
_LONG_S = 0x17F


def _prototype(cp: int) -> str | None:
    ch = chr(cp)
    kind = unicodedata.category(ch)
    if cp in _UNSEEN or kind == "Cf" and cp not in _DRAWN:
        return ""
    if kind == "Zs":
        return None if cp in (0x20, 0x1680) else " "
    tag, _, parts = unicodedata.decomposition(ch).partition(" ")
    if tag in ("<wide>", "<narrow>", "<noBreak>", "<font>"):
        return unicodedata.normalize("NFKD", ch)
    if tag == "<compat>" and cp != _LONG_S and all(chr(int(x, 16)).isalpha() for x in parts.split()):
        return unicodedata.normalize("NFKD", ch)
    return None


#: A file in the format of the public table of confusables (source ; prototype ; …), read in place of the lists above.
CONFUSABLES = os.environ.get("STRANDWORK_CONFUSABLES", "")


def confusables(path: str) -> dict[int, str]:
    """The pairs of a file of confusables that stand for one Latin letter of the same case in another script; digits, signs and letters of Latin itself differ to the eye."""
    found = {}
    with open(path, encoding="utf-8-sig") as f:
        for line in f:
            parts = [[int(x, 16) for x in p.split()] for p in line.split("#")[0].split(";")[:2] if p.strip()]
            if len(parts) == 2 and len(parts[0]) == len(parts[1]) == 1:
                a, b = chr(parts[0][0]), chr(parts[1][0])
                if b.isascii() and b.isalpha() and a.isalpha() and not a.isascii() and a.islower() == b.islower() and not unicodedata.name(a, "LATIN").startswith("LATIN"):
                    found[ord(a)] = b
    return found


@functools.lru_cache(1)
def prototypes() -> dict[int, str]:
    """The look-alike table, one entry per character that is replaced: the Unicode database by rule, and letters by the lists above or a file."""
    found = {cp: p for cp in (*range(0x80, 0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE0200)) if (p := _prototype(cp)) is not None}
    return found | (confusables(CONFUSABLES) if CONFUSABLES else {ord(x[0]): x[1] for line in (_CYRILLIC, _GREEK, _OTHER) for x in line.split()})


def _pictograph(ch: str) -> bool:
    return unicodedata.category(ch) in ("So", "Sk", "Mn", "Me") and ord(ch) > 0x2000


def _joiners(text: str) -> str:
    """``text`` without joiners that stand beside anything but pictographs."""
    return _JOINED.sub(lambda m: _JOINER if 0 < m.start() and m.end() < len(text) and _pictograph(text[m.start() - 1]) and unicodedata.category(text[m.end()]) == "So" else "", text)


def skeleton(text: str) -> str:
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.isascii():
        return text
    table = prototypes()
    if _JOINER in text:
        parts = [unicodedata.normalize("NFD", unicodedata.normalize("NFD", x).translate(table)) for x in _joiners(text).split(_JOINER)]
        return unicodedata.normalize("NFC", _JOINER.join(parts))
    text = unicodedata.normalize("NFD", text).translate(table)
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text))


@F.pandas_udf(StringType())
def one_form(texts: pd.Series) -> pd.Series:
    return texts.map(skeleton, na_action="ignore")


def forms(docs: DataFrame) -> DataFrame:
    """(doc_id, form, changed) of every document."""
    return docs.select("doc_id", "text", one_form("text").alias("form")).select("doc_id", "form", F.coalesce(F.col("form") != F.col("text"), F.lit(False)).alias("changed"))


def _classes(docs: DataFrame) -> DataFrame:
    """(doc_id, look, body): hashes of 256 bits of skeleton and text, of documents whose skeleton has several texts; written once, as skeletons are the costly part."""
    cutter = Cutter(docs.sparkSession, "looks")
    d = cutter.cut(docs.where(F.col("text").isNotNull()).select("doc_id", F.unhex(F.sha2(one_form("text"), 256)).alias("look"), F.unhex(F.sha2("text", 256)).alias("body")))
    many = d.groupBy("look").agg(F.min("body").alias("lo"), F.max("body").alias("hi")).where(F.col("lo") != F.col("hi")).select("look")
    return cutter.cut(d.join(many, "look", "left_semi"))


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_texts): each document of a look with several texts, its class named by the smallest id."""
    c = _classes(docs)
    named = c.groupBy("look", "body").agg(F.min("doc_id").alias("least")).groupBy("look").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("n_texts"))
    return c.join(named, "look").select("doc_id", "class_id", "n_texts")


def pairs(docs: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), a before b: documents that look the same and differ in their characters.

    Pairs are made of distinct texts first and then expanded to their documents,
    so copies of one text never meet each other, and every row on the way leads to output.
    """
    c = _classes(docs)
    texts = c.select("look", "body").distinct()
    two = texts.select("look", F.col("body").alias("one")).join(texts.select("look", F.col("body").alias("two")), "look").where(F.col("one") < F.col("two")).select("one", "two")
    a = c.select(F.col("body").alias("one"), F.col("doc_id").alias("x"))
    b = c.select(F.col("body").alias("two"), F.col("doc_id").alias("y"))
    both = two.join(a, "one").join(b, "two")
    return both.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).where(F.col("doc_id_a") < F.col("doc_id_b")).distinct()
