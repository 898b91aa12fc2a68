"""Kinds of source files: composition of single texts, and copies against all pairs."""

import fnmatch
import heapq
import inspect
import random
import re
import textwrap

import pytest

from strandwork.llm import handwritten as h

# code that people wrote, from the standard library
CODE = inspect.getsource(textwrap)
ACCESSORS = "package m\n\n" + "".join(f'func (x *Foo{i % 3}) GetName{i}() string {{\n\tif x != nil {{\n\t\treturn x.Name{i}\n\t}}\n\treturn ""\n}}\n\n' for i in range(20))
LOCK = '{\n  "name": "x",\n  "lockfileVersion": 2,\n  "packages": {\n' + ",\n".join(f'    "node_modules/p{i}": {{\n      "version": "1.{i}.0",\n      "resolved": "https://r.example/p{i}.tgz",\n      "integrity": "sha512-Ab{i}cdE9xYzQ1w2e3r4t5y6u7i8o9p0aSdFg=="\n    }}' for i in range(10)) + "\n  }\n}\n"
CONFIG = '{\n "name": "x",\n "version": "1.0.0",\n "scripts": {\n  "build": "tsc",\n  "test": "jest"\n },\n "dependencies": {\n' + ",\n".join(f'  "dep{i}": "^1.{i}.0"' for i in range(12)) + "\n }\n}\n"
BUNDLE = "!function(n){j.a=j||a(n,3)}(this);function f(k){return k.c(k)}var u=f?n:f,u=n[7];u.d(1)"
OTHERS = [
    ("generated", "# Code generated by tool. DO NOT EDIT.\n" + CODE), ("generated", "// @generated by x from y\nint a;\n"), ("generated", ACCESSORS), ("generated", "\n".join(f"def get_{i}(self):\n    return self._fields[{i}]\n" for i in range(9))),
    ("minified", BUNDLE * 20), ("minified", BUNDLE * 2), ("minified", "/*! banner v1.2 */" + BUNDLE * 9), ("minified", ".a{margin:1px;color:#fff}.b-2{left:0;top:1px}" * 40),
    ("data", "T = {\n" + "\n".join(f"    {i}: (0.{i}1, 0.{i}7)," for i in range(40)) + "\n}\n"), ("data", "\n".join(f"INSERT INTO t VALUES ({i}, 'x', {i * 9});" for i in range(30))), ("data", 'icon = "' + "QUJD" * 300 + '"\n'),
    ("data", "class D { static double[] T = {\n" + "\n".join(f"    {i}, 0.{i}38, 0.{i}57," for i in range(30)) + "\n}; }\n"), ("data", LOCK),
    ("data", '{"lockfileVersion": 2, "packages": {\n' + ",\n".join(f'  "p{i}": {{"version": "1.{i}.0", "integrity": "x{i}"}}' for i in range(20)) + "\n}}\n"),
]
BY_HAND = [
    CODE, inspect.getsource(heapq), inspect.getsource(fnmatch), "", "x = 1\n", "\n\n", "# only\n# words\n", "# Part of atlas. All rights kept by its authors.\n" + CODE, 'BANNER = "# Code generated by x. DO NOT EDIT."\n' + CODE, CONFIG,
    "// Don't change the order of these imports.\n" + CODE, "// Code generated output is checked in tests by this helper.\n" + CODE, "# mylib v1.2.3\n# Copyright (c) its authors\n# MIT License\n" + CODE,
    "# Writes the stub files; each one starts with a do-not-edit line and is rebuilt on every run.\n" + CODE,
    "STEPS = [\n" + "\n".join("    1, 33, 79, 38, 203, 139, 126, 152," for _ in range(7)) + "\n]\n\n" + CODE, "NAMES = [" + ", ".join(f'"name_{i}"' for i in range(60)) + "]\n\n" + CODE[:400],
]


@pytest.mark.parametrize("kind, text", OTHERS)
def test_composition(kind, text):
    assert h.composition(text) == kind
    assert h.composition(text.replace("\n", "\r\n")) == kind


@pytest.mark.parametrize("text", BY_HAND)
def test_by_hand(text):
    assert h.composition(text) is None


def test_long_texts():
    assert h.composition((CODE + "\n") * 200) is None and h.composition(ACCESSORS * 200) == "generated"


FILE = "file_id long, path string, repo string, language string, line_count int, content string, class string, lines int, kind string"
OWN = lambda i, r, x: (i, "vendor/x.py", r, None, None, x, "c", 1, "k")


def corpus():
    """Own files, and copies of libraries with edits of a few, many or nearly all lines, without any header."""
    rng = random.Random(1)
    unique = lambda n, salt: [f"call_{salt}_{i}(argument_{rng.randrange(10**6)}, {i})" for i in range(n)]
    common = [f"a very common line of code number {i}" for i in range(4)]
    texts = [(f"r{i % 5}", unique(20, f"own{i}") + common) for i in range(25)]
    for lib in range(3):
        body = unique(30, f"lib{lib}")
        for _ in range(12):
            lines = list(body)
            for _ in range(rng.choice([0, 0, 3, 8, 20])):
                lines[rng.randrange(30)] = f"edited_{rng.randrange(10**9)}(line)"
            texts.append((f"r{rng.randrange(5)}", lines))
    small = unique(5, "small")
    return [*texts, ("r1", texts[0][1]), ("r1", texts[1][1]), ("r1", texts[1][1]), ("r0", ["short"] * 9), ("r2", small), ("r3", [*small[:4], "another line here"]), ("", texts[3][1]), (None, texts[3][1])]


def held_elsewhere(texts):
    sets = [{z for y in x if len(z := re.sub(r"[ \t]+", " ", y).strip()) >= h.LINE} for _, x in texts]
    want = set()
    for i, (r, _) in enumerate(texts):
        for j, (q, _) in enumerate(texts):
            n = len(sets[i] & sets[j])
            if r and q and r != q and n >= h.SHARED and n >= h.SHARE * len(sets[i]):
                want.add(i)
    return want


@pytest.mark.parametrize("part", [2_000, 2])
def test_copies_match_all_pairs(spark, monkeypatch, part):
    monkeypatch.setattr(h, "PART", part)
    texts = corpus()
    # files without repository hold the same set as one of a repository
    want = held_elsewhere(texts)
    want |= {i for i, (r, x) in enumerate(texts) if not r and any(x == y and j in want for j, (_, y) in enumerate(texts))}
    rows = [OWN(i, r, "\n".join(x)) for i, (r, x) in enumerate(texts)] + [OWN(900, None, None), OWN(901, None, "")]
    files = spark.createDataFrame(rows + rows[:2], FILE)
    assert {r["file_id"] for r in h.copies(files).collect()} == want
    kinds = {r["file_id"]: (r["kind"], r["step"]) for r in h.kinds(files).collect()}
    assert 900 not in kinds and kinds[901] == ("hand-written", "") and all(kinds[i] == ("third-party", "containment") for i in want)
    assert h.kinds(files).count() == len(rows) + 1 and h.kinds(files.limit(0)).count() == 0


def test_recall_of_containment_on_copies_without_headers(spark):
    """Copies with up to a quarter of their lines edited and their header stripped are found by containment alone."""
    rng = random.Random(7)
    rows, copies = [], set()
    for lib, module in enumerate((textwrap, heapq, fnmatch)):
        lines = inspect.getsource(module).split("\n")
        for c in range(20):
            own = list(lines[5:])
            for _ in range(rng.randrange(len(own) // 4)):
                own[rng.randrange(len(own))] = f"    changed_{lib}_{c}_{rng.randrange(10**6)}()"
            copies.add(len(rows))
            rows.append(OWN(len(rows), f"r{c % 7}", "\r\n".join(own)))
    for i in range(60):
        rows.append(OWN(len(rows), f"r{i % 7}", "\n".join(f"own_{i}_{j} = step_{rng.randrange(999)}(x)" for j in range(30))))
    found = {r["file_id"] for r in h.copies(spark.createDataFrame(rows, FILE)).collect()}
    assert found <= copies and len(found) >= 0.9 * len(copies)


def test_a_block_that_many_files_share_is_no_copy(spark):
    """Lines of a third of all files stay out of the prefix of files that do not hold enough of them."""
    licence = [f"shared terms of many files, line {i}" for i in range(9)]
    rows = [OWN(i, f"r{i % 4}", "\n".join(licence + [f"own_{i}_{j} = call_{j}({i})" for j in range(20)])) for i in range(120)]
    assert h.copies(spark.createDataFrame(rows, FILE)).count() == 0
