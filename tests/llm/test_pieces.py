"""Pieces cover their text, stay under the limit, share the overlap and follow a sequential cut."""

import hashlib
import random

import pytest

from strandwork.llm import pieces as p


def _texts():
    rng = random.Random(6)
    word = lambda: rng.choice(["alpha", "βήτα", "слово", "長い", "x", "emoji😀", "`code`"])
    sentence = lambda: " ".join(word() for _ in range(rng.randrange(3, 25))) + rng.choice([".", "!", "。", ""])
    out = ["a" * 5000, "あ" * 3000, "😀" * 1100, "a b" * 3000, "\r\n" * 3000, "x\r\n\r\n" * 2000, ("y" * 4095 + "\n") * 3, ("z" * 4096) + "!", "\n" * 5000]
    for sep in ("\n\n", "\r\n\r\n", "\n", " ", ""):
        out.append(sep.join(sentence() for _ in range(120)))
    return out


@pytest.mark.parametrize("text", _texts())
@pytest.mark.parametrize("limit, overlap", [(4096, 200), (256, 40), (700, 0)])
def test_cover(text, limit, overlap):
    raw = text.encode()
    if len(raw) <= limit:
        return
    starts, ends = p.cuts(raw, limit, overlap)
    assert starts[0] == 0 and ends[-1] == len(raw)
    for k, (a, b) in enumerate(zip(starts, ends)):
        assert 0 < b - a <= limit
        raw[a:b].decode()
        assert raw[b - 1 : b + 1] != b"\r\n"
        if k:
            shared = ends[k - 1] - a
            assert overlap - 5 <= shared <= overlap and ends[k - 1] < b
            assert raw[:a].decode() + raw[a:].decode() == text


def test_prefers_natural_boundaries():
    text = ("word " * 100 + "\n\n") * 30
    _, ends = p.cuts(text.encode())
    assert all(text.encode()[:e].endswith(b"\n\n") for e in ends)
    text = "word " * 3000
    _, ends = p.cuts(text.encode())
    assert all(text.encode()[:e].endswith(b" ") for e in ends)


def _walk(raw, limit, overlap):
    """One cut after the other, by scanning back from the farthest byte."""
    legal = [k for k in range(len(raw) + 1) if k in (0, len(raw)) or (raw[k] & 0xC0 != 0x80 and raw[k - 1 : k + 1] != b"\r\n")]
    ok = set(legal)
    ranks = [{m.end() for m in r.finditer(raw)} for r in p._RANKS]
    cut, ends = 0, []
    while cut < len(raw):
        start = next(k for k in range(max(cut - overlap, 0), len(raw) + 1) if k in ok)
        room = min(start + limit, len(raw))
        if room < len(raw):
            half = next((k for r in ranks for k in range(room, max(start + limit // 2, cut + 1) - 1, -1) if k in r), None)
            any_ = next((k for k in range(room, cut, -1) if any(k in r for r in ranks)), None)
            room = half or any_ or next(k for k in range(room, -1, -1) if k in ok)
        cut = room
        ends.append(cut)
    return ends


@pytest.mark.parametrize("text", _texts())
def test_doubling_equals_walking(text):
    raw = text.encode()
    if len(raw) > 4096:
        assert p.cuts(raw)[1] == _walk(raw, 4096, 200)
    assert p.cuts(raw, 600, 50)[1] == _walk(raw, 600, 50)


def test_a_boundary_in_the_first_half_beats_a_cut_word():
    raw = b"word " * 40 + b"x" * 9000
    assert p.cuts(raw)[1][0] == 200


def test_bad_limits():
    with pytest.raises(ValueError):
        p.cuts(b"x" * 500, 100, 90)


def test_frame(spark):
    rows = [(1, "a" * 4096, 9999, 7), (2, "a" * 4097, 1, 7), (3, "é" * 2049, None, 7), (4, None, 5000, 7), (5, "", 5000, 7), (2, "a" * 4097, 1, 7), (6, "b c" * 400_000, 0, 7)]
    items = spark.createDataFrame(rows, "item_id long, body string, size_bytes long, piece_no int")
    out = p.pieces(items)
    assert sorted(r["item_id"] for r in p.split_items(out).collect()) == [2, 2, 3, 6]
    for r in out.collect():
        assert len(r["piece"].encode()) == r["end_byte"] - r["start_byte"] <= 4096
    assert p.pieces(items.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["word and word, " * 3000, "x" * 40_000, "é" * 9_000 + "\n\n" + "a b. " * 5_000, "\r\n" * 20_000])
def test_windows_do_not_matter(monkeypatch, text):
    whole = p.cuts(text.encode())
    monkeypatch.setattr(p, "WINDOW", 5_000)
    assert p.cuts(text.encode()) == whole


def test_coverage_and_small_batches(spark, monkeypatch):
    texts = ["word and word. " * 1000, "é" * 5000, "short", "x\r\n" * 3000]
    monkeypatch.setattr(p, "OUT", 1)
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, body string")
    got = {r["item_id"]: r for r in p.coverage(p.pieces(items)).collect()}
    assert set(got) == {0, 1, 3}
    for i, r in got.items():
        assert (r["n_bytes"], r["gaps"], r["misfits"], r["whole"]) == (len(texts[i].encode()), 0, 0, hashlib.sha256(texts[i].encode()).hexdigest()) and r["longest"] <= p.LIMIT
