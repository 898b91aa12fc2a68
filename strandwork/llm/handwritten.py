"""Telling hand-written source from generated, minified, third-party and data files.

First containment.  Each file is the set of its lines; files with one set are one
class, so exact copies collapse before any shuffle of lines.  An inverted index maps
the hash of a line that several repositories hold to how many classes hold it and to
one holder in the smallest and in the largest of these repositories, so its size does
not depend on how common a line is.  A class can be contained in a file of another
repository only if enough of its lines are in the index; that bound drops nearly all
hand-written files.  A holder of ``SHARE`` of the lines holds at least one of the
rarest ``held - needed + 1`` (the necessary prefix): the holders that the index names
for these are compared first, line set by line set.  Only what none of them contains
meets every holder of its prefix; lines of many holders are split into parts there.

Then composition, for what containment leaves.  A file is brought to tokens (names,
numbers, literals), without comments.  Tools and tables repeat themselves: within
blocks of ``BLOCK`` lines few runs of three line shapes are distinct.  Data are nearly
all literals, one long literal, or lines with digests; minified code is dense.  The
only words that count are two marks that tools have agreed on (``_MARKS``).

Both are taken from one pass over the texts, so no text is shuffled.

Defined results: a null content is not judged; an empty one is hand-written; names of
files, stated languages, hashes and line counts are never trusted; mixed line ends are
one; repeated scans count each, and files of one repository, or without one, never
make each other third-party; which of two repositories wrote a shared file cannot be
told, so both are reported; files with fewer than ``SHARED`` countable lines are too
short for evidence by lines; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import Cutter

#: A line counts from this length on; a copy shares this part of its lines, and evidence is this many lines at least.
LINE, SHARE, SHARED = 10, 0.6, 4
#: Classes of a line that one task meets at once; more are split.
PART = 2_000
#: Repetition: lines of a block, lines from which it is judged, and the part of distinct runs of three shapes below which it repeats itself.
BLOCK, JUDGED, DISTINCT = 60, 10, 0.45
#: Data: literals among all tokens; the part of one literal; the part of lines with a digest; the part of one shape.
LITERALS, BLOB, DIGESTS, ROWS = 0.75, 0.6, 0.15, 0.7
#: Minified: white space in the code, characters a line, least size.
SPACE, DENSE, LEAST = 0.08, 80, 100

_NEWLINE = re.compile(r"\r\n|\r|\n")
_BLANKS = re.compile(r"[ \t]+")
_LEX = re.compile(
    r"(?P<s>\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)"
    r"|(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z)|(?<![^\s;])\#(?!include|define|if|endif|\[|!\[)[^\n]*|^[ \t]*(?:--|;;)[^\n]*|<!--.*?(?:-->|\Z))",
    re.S | re.M,
)
_NUMBER = re.compile(r"\b0[xX][0-9a-fA-F]+\w*|\b\d[\w.]*")
_NAME = re.compile(r"[^\W\d][\w$]*")
_LIST = re.compile(r"(?:[0\"] ?, ?)+[0\"]?")
_DIGEST = re.compile(r"[\"'](?=[\w+/=:-]*\d)(?=[\w+/=:-]*[A-Za-z])[\w+/=:-]{24,}[\"']")
# What tools write at the head of their output by public convention.
_MARKS = re.compile(r"^\W*(?:Code generated .*DO NOT EDIT\.?\W*$|@generated\b)")
_HEAD = re.compile(r"\s*(?://|/\*|\*|#(?!include|define|if|endif|\[|!\[)|--|;;|<!--)")


def marked(text: str) -> bool:
    """Whether a comment line before the first code is an agreed mark of a tool."""
    for line in text.split("\n"):
        if line.strip() and not _HEAD.match(line):
            return False
        if _MARKS.match(line):
            return True
    return False


def composition(content: str) -> str | None:
    """'generated', 'minified' or 'data' by the composition of the text, else None."""
    text = content.replace("\r\n", "\n").replace("\r", "\n")
    if marked(text):
        return "generated"
    longest = 0

    def token(m: re.Match[str]) -> str:
        nonlocal longest
        if m.lastgroup == "c":
            return " "
        longest = max(longest, m.end() - m.start())
        return '"'

    code = _LEX.sub(token, text)
    lines = [y for x in code.split("\n") if (y := x.strip())]
    if not lines:
        return None
    size = sum(map(len, lines))
    if longest >= BLOB * (size + longest) and longest >= LEAST:
        return "data"
    if size >= LEAST and size >= DENSE * len(lines) and sum(map(code.count, " \t\n")) < SPACE * len(code):
        dense = True
    else:
        dense = False
    plain = _NUMBER.sub("0", _NAME.sub("a", "\n".join(lines)))
    names, literals = plain.count("a"), plain.count("0") + plain.count('"')
    if dense and literals < LITERALS * (names + literals):
        return "minified"
    shapes = _LIST.sub("L", _BLANKS.sub(" ", plain)).split("\n")
    mean = size / len(lines)
    if literals >= LITERALS * (names + literals) and (mean >= 4 * DENSE or literals > names and longest >= BLOB * size):
        return "data"
    if len(shapes) < JUDGED:
        return None
    if len(_DIGEST.findall(text)) >= DIGESTS * len(lines):
        return "data"
    runs = distinct = 0
    for at in range(0, len(shapes) - 2, BLOCK):
        block = shapes[at : at + BLOCK + 2]
        three = list(zip(block, block[1:], block[2:], strict=False))
        runs += len(three)
        distinct += len(set(three))
    if distinct > DISTINCT * runs:
        return None
    return "data" if literals >= LITERALS * (names + literals) or Counter(shapes).most_common(1)[0][1] >= ROWS * len(shapes) else "generated"


def line_set(content: str) -> list[int]:
    """The sorted distinct hashes of the lines that count, blanks as one space."""
    kept = {y for x in _NEWLINE.split(content) if len(y := _BLANKS.sub(" ", x).strip(" ")) >= LINE}
    return sorted(xxhash.xxh64_intdigest(x.encode(errors="surrogatepass")) - (1 << 63) for x in kept)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("content").to_pylist()
        sets = [line_set(x) for x in texts]
        names = [xxhash.xxh128_digest(pa.array(s, pa.int64()).to_numpy().tobytes()) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [b.column("file_id"), b.column("repo"), pa.array([composition(x) for x in texts], pa.string()), pa.array(names, pa.binary()), pa.array(sets, pa.list_(pa.int64()))],
            names=["file_id", "repo", "rule", "class", "lines"],
        )


def facts(files: DataFrame) -> DataFrame:
    """(file_id, repo, rule, class, lines) of files with content: what their text alone says, and their line set with its name of 128 bits."""
    f = files.where(F.col("content").isNotNull()).select(F.col("file_id").cast("long").alias("file_id"), F.coalesce("repo", F.lit("")).cast("string").alias("repo"), "content")
    return f.mapInArrow(_facts, "file_id long, repo string, rule string, class binary, lines array<long>")


def copied_classes(sets: DataFrame) -> DataFrame:
    """(class) of the line sets ``sets(repo, class, lines)`` that a file of another repository holds to ``SHARE`` or more."""
    cutter = Cutter(sets.sparkSession, "copies")
    classes = cutter.cut(sets.where((F.size("lines") >= SHARED) & (F.col("repo") != "")).groupBy("class").agg(F.min("repo").alias("lo"), F.max("repo").alias("hi"), F.first("lines").alias("lines")))
    # a class of several repos is held by any other; two of them are enough to tell
    held = classes.select("class", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("repo"), "lines").select("class", "repo", F.explode("lines").alias("line"))
    holder = F.struct("repo", "class")
    index = held.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.min(holder).alias("a"), F.max(holder).alias("b")).where(F.col("a.repo") != F.col("b.repo"))
    alone = classes.where(F.col("lo") == F.col("hi"))
    need = F.greatest(F.lit(SHARED), F.ceil(F.col("size") * SHARE - 1e-9).cast("int"))
    others = F.transform(F.filter(F.array("a", "b"), lambda x: x["repo"] != F.col("repo")), lambda x: x["class"])
    seen = (
        alone.select("class", F.col("lo").alias("repo"), F.size("lines").alias("size"), F.explode("lines").alias("line"))
        .join(index, "line")
        .select("class", "repo", "size", "n", "line", others.alias("others"))
        .groupBy("class", "repo", "size")
        .agg(F.array_sort(F.collect_list(F.struct("n", "line", "others"))).alias("held"))  # a file's own lines
        .where(F.size("held") >= need)
    )
    prefix = F.slice("held", F.lit(1), F.size("held") - need + 1)
    seen = cutter.cut(seen.select("class", "repo", prefix.alias("rarest")))
    named = seen.select("class", F.explode(F.array_distinct(F.flatten(F.transform("rarest", lambda v: v["others"])))).alias("other"))
    edited = cutter.cut(_contained(classes, named))
    found = classes.where(F.col("lo") != F.col("hi")).select("class").unionByName(edited)
    left = cutter.cut(seen.join(edited, "class", "left_anti").select("class", "repo", F.explode("rarest").alias("v")).select("class", "repo", F.col("v.n").alias("n"), F.col("v.line").alias("line")))
    if left.limit(1).count():
        # a line of many holders is split: each of its parts meets the line's own part of the holders
        wanted = left.groupBy("line").agg(F.ceil(F.max("n") / PART).alias("parts"))
        every = held.join(wanted, "line").select("line", F.col("class").alias("other"), F.col("repo").alias("their_repo"), F.pmod(F.xxhash64("class"), F.col("parts")).alias("part"))
        mine = left.select("class", "repo", "line", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / PART) - 1)).alias("part"))
        more = mine.join(every, ["line", "part"]).where(F.col("repo") != F.col("their_repo")).select("class", "other").distinct()
        found = found.unionByName(_contained(classes, more))
    return cutter.only(found.distinct())


def _contained(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(class) of those ``pairs(class, other)`` whose lines the other holds to ``SHARE`` or more."""
    sides = classes.select(F.col("class").alias("other"), F.col("lines").alias("theirs"))
    shared = F.size(F.array_intersect("lines", "theirs"))
    both = pairs.join(classes.select("class", "lines"), "class").join(sides, "other")
    return both.where((shared >= SHARED) & (shared >= F.size("lines") * SHARE - 1e-9)).select("class").distinct()


def copies(files: DataFrame) -> DataFrame:
    """(file_id) of files whose lines a file of another repository holds to ``SHARE`` or more."""
    cutter = Cutter(files.sparkSession, "lines")
    known = cutter.cut(facts(files).select("file_id", "repo", "class", "lines"))
    return cutter.only(known.join(copied_classes(known), "class", "left_semi").select("file_id"))


def kinds(files: DataFrame) -> DataFrame:
    """(file_id, kind, step) of every file with content.

    ``kind`` is 'third-party' where containment decided (``step`` 'containment'), else
    'generated', 'minified' or 'data' ('composition'), else 'hand-written' ('').
    """
    cutter = Cutter(files.sparkSession, "kinds")
    known = cutter.cut(facts(files))
    copied = copied_classes(known).select("class", F.lit("third-party").alias("copied"))
    step = F.when(F.col("copied").isNotNull(), "containment").when(F.col("rule").isNotNull(), "composition").otherwise("")
    return cutter.only(known.select("file_id", "class", "rule").join(copied, "class", "left").select("file_id", F.coalesce("copied", "rule", F.lit("hand-written")).alias("kind"), step.alias("step")))
