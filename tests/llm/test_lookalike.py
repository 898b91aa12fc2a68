"""Skeletons and pairs of texts that look the same."""

import itertools
import random

import pytest

from strandwork.llm import lookalike as k


@pytest.mark.parametrize(
    "a, b",
    [
        ("\uff37\uff49\uff44\uff45 \uff11\uff12", "Wide 12"), ("cafe\u0301", "caf\u00e9"), ("\ufb01ne \ufb02ow", "fine flow"), ("a\u200bb\u00adc\ufeff\u2060\u200e", "abc"),
        ("a\u00a0b\u2009c\u202fd\u3000e", "a b c d e"), ("p\u0430ssw\u043erd", "password"), ("\u039f\u03bfps", "Oops"), ("\u2167", "VIII"), ("\uff8a\uff9f", "\u30d1"), ("a\r\nb", "a\nb"),
        ("\u0439", "\u0438\u0306"), ("\u212b", "\u00c5"), ("x\u200dy", "xy"), ("\u0133", "ij"), ("\u0435\u0301", "\u00e9"), ("\U0001d400\u212f\U0001d7ce", "Ae0"),
    ],
)
def test_same(a, b):
    assert k.skeleton(a) == k.skeleton(b)


def test_a_file_of_confusables(tmp_path):
    f = tmp_path / "confusables.txt"
    f.write_text("\ufeff# head\n10411 ; 006C ; MA # other case rules\n0455 ;\t0073 ;\tMA\n0417 ; 0033 ; MA\n0031 ; 006C ; MA\n006D ; 0072 006E ; MA\n0399 ; 006C ; MA\n", "utf-8")
    assert k.confusables(str(f)) == {0x455: "s"}


@pytest.mark.parametrize(
    "a, b",
    [("a", "A"), ("e", "\u00e9"), ("\u0131", "i"), ("1", "l"), ("0", "O"), ("a b", "a  b"), ("a.", "a!"), ("x\u00b2", "x2"), ("\U0001f469\u200d\U0001f4bb", "\U0001f469\U0001f4bb"), ("\ta", " a"), ("a\nb", "a b"), ("\u017f", "s"), ("\u00df", "ss"), ("-", "\u2014"), ("m", "rn")],
)
def test_apart(a, b):
    assert k.skeleton(a) != k.skeleton(b)


def test_ascii_is_itself():
    text = "".join(map(chr, range(128))).replace("\r", "")
    assert k.skeleton(text) == text and k.skeleton("") == ""
    once = k.skeleton("\uff37\u0301\u0430\ufb01")
    assert k.skeleton(once) == once


def test_pairs_match_all_pairs(spark):
    rng = random.Random(2)
    base = ["plain text", "Stra\u00dfe", "caf\u00e9 au lait", "x y", "", "\u043f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440"]
    forms = [lambda s: s, lambda s: s.replace(" ", "\u00a0"), lambda s: s.replace("a", "\u0430"), lambda s: "\u200b" + s, lambda s: s]
    texts = [rng.choice(forms)(rng.choice(base)) for _ in range(150)] + ["hot"] * 40 + ["h\u043et"] + [None, None, "\uff48" * 5000, "h" * 5000]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, look string, body int")
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2) if a is not None and b is not None and a != b and k.skeleton(a) == k.skeleton(b)}
    got = [tuple(r) for r in k.pairs(docs).collect()]
    assert sorted(got) == sorted(want)
    assert {r["doc_id"] for r in k.groups(docs).collect()} == {x for p in want for x in p}
    assert k.pairs(docs.limit(0)).count() == 0
    forms_of = {r["doc_id"]: r["form"] for r in k.forms(docs).collect()}
    assert all(forms_of[i] == (None if t is None else k.skeleton(t)) for i, t in enumerate(texts))
