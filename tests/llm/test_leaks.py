"""Evaluation passages in documents against a scan of all positions."""

import random

from strandwork.llm import leaks as x

ITEMS, DOCS = "item_id long, text string, task string, n long", "doc_id long, text string, item_id long, shingle long"


def _brute(docs, items):
    out = set()
    for d, t in docs:
        w = x.words(t)
        grams = {tuple(w[i : i + x.RUN]) for i in range(len(w) - x.RUN + 1)}
        for i, u in items:
            v = x.words(u)
            if any(tuple(v[k : k + x.RUN]) in grams for k in range(len(v) - x.RUN + 1)):
                out.add((d, i))
    return out


def test_matches_scan_and_the_bitmap_does_not_matter(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(25)] + ["the", "of", "a_b", "Ünal"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.randrange(5, 60)) + " answer with one name only") for i in range(30)] + [(100, None), (101, ""), (102, "same " * 30)]
    docs = []
    for i in range(160):
        _, t = rng.choice(items[:30])
        w = t.split()
        a = rng.randrange(len(w))
        piece = " ".join(w[a : a + rng.choice([8, 11, 12, 13, 40])])
        piece = rng.choice([piece, piece.upper(), piece.replace(" ", ", "), piece.replace("a", "\u0430")])
        docs.append((i, say(rng.randrange(0, 20)) + " " + piece + " " + say(rng.randrange(0, 20))))
    docs += [(500, None), (501, ""), (502, "same " * 12), (503, "same " * 11), (504, say(20_000))]
    d = spark.createDataFrame([(*r, 0, 0) for r in docs + docs[:3]], DOCS)
    q = spark.createDataFrame([(*r, "t", 1) for r in items], ITEMS)
    want = _brute(docs, items)
    assert len(want) > 20
    assert sorted(map(tuple, x.leaks(d, q).collect())) == sorted(want)
    assert sorted(map(tuple, x.leaks(d, q, most_bits=6).collect())) == sorted(want)
    assert x.leaks(d.limit(0), q).count() == 0 and x.leaks(d, q.limit(0)).count() == 0
    assert sum(r["n_docs"] for r in x.report(x.leaks(d, q)).collect()) == len(want)
