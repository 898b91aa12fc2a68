"""Splitting oversized texts at natural boundaries, by pointer doubling over cuts.

Every legal cut of a text is a byte offset with a rank: end of a paragraph, of a
line, of a sentence, of a word, of any character.  The successor of a cut is the
end of the next piece: that piece starts ``overlap`` bytes before the cut and ends
at the farthest boundary of the best rank in the second half of its room, else at the
farthest natural boundary after the cut, else at the last character that fits.  One
binary search per rank gives the successors of all cuts of a window of ``WINDOW`` bytes at
once; squaring the successor table (s = s[s]) while merging what it reaches gives
all cuts of the window from the first one in logarithmic rounds, and the last of them
leads into the next window.  A text is one row, so its table needs no shuffle; tables
are as large as a window at most, and pieces leave a task in batches of ``OUT`` bytes.

Defined results: a text of at most ``limit`` bytes, a null or an empty one gives
no piece, whatever its stated size; pieces of an item cover it whole and in order;
neighbours share ``overlap`` bytes, or less by at most the bytes of one character
that would else be cut; a cut never falls inside a character or between CR and LF;
repeated rows give pieces each; empty tables give no rows; only the id and the
body are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 4096, 200
#: Bytes of a text whose successor table is held at once, and of pieces that leave a task together.
WINDOW, OUT = 1 << 20, 8 << 20
#: Boundaries from the best rank down; a match's end is the cut.
_RANKS = tuple(
    re.compile(x)
    for x in (
        rb"\r?\n[ \t]*\r?\n(?:[ \t]*\r?\n)*",
        rb"\r\n|\n|\r(?!\n)",
        rb"[.!?]+[\"')\]]*[ \t]+|\xe3\x80\x82|\xef\xbc[\x81\x9f]|[;:][ \t]+",
        rb"[ \t]+|\xe3\x80[\x80\x81]",
    )
)


def _near(ok: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """The nearest offsets where ``ok`` from ``at`` on in the direction of ``step``; a character has four bytes at most."""
    at = at.copy()
    while (bad := ~ok[at]).any():
        at[bad] += step
    return at


def _starts(raw: bytes) -> np.ndarray:
    """True at offsets where a character starts (and at the end), apart from an LF after CR."""
    b = np.frombuffer(raw, np.uint8)
    ok = np.append((b & 0xC0) != 0x80, True)
    ok[1:-1] &= ~((b[1:] == 10) & (b[:-1] == 13))
    return ok


def _last(marks: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The greatest of ``marks`` at or below each of ``hi``, or -1."""
    at = np.searchsorted(marks, hi, "right") - 1
    return np.where(at >= 0, marks[np.maximum(at, 0)], -1) if len(marks) else np.full(len(hi), -1)


def cuts(raw: bytes, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[int], list[int]]:
    """Starts and ends of the pieces of ``raw``, a UTF-8 text longer than ``limit``."""
    if limit < 2 * overlap + 16 or overlap < 0:
        raise ValueError("limit must be at least twice the overlap and 16 bytes more")
    n = len(raw)
    ok = _starts(raw)
    ranks = [np.array([m.end() for m in r.finditer(raw)], np.int64) for r in _RANKS]

    def start_of(cut: np.ndarray) -> np.ndarray:
        return _near(ok, np.maximum(cut - overlap, 0), 1)

    def end_from(start: np.ndarray, after: np.ndarray) -> np.ndarray:
        room = np.minimum(start + limit, n)
        least = np.maximum(start + limit // 2, after + 1)
        lasts = [_last(marks, room) for marks in ranks]
        natural = np.max(lasts, axis=0)
        end = np.where(natural > after, natural, _near(ok, room, -1))
        for far in reversed(lasts):
            end = np.where((far >= least) & (far < n), far, end)
        return np.where(room == n, n, end)

    ends = end_from(np.zeros(1, np.int64), np.zeros(1, np.int64))
    while (lo := int(ends[-1])) < n:
        hi = min(n, lo + WINDOW)
        inside = (marks[np.searchsorted(marks, lo, "right") : np.searchsorted(marks, hi, "right")] for marks in ranks)
        # the table holds the natural boundaries of the window; where one of them leads between them, it holds every legal offset
        pool = np.unique(np.concatenate([*inside, [lo, *([n] if hi == n else [])]]))
        target = end_from(start_of(pool), pool)
        if not np.isin(target[target <= hi], pool).all():
            pool = np.flatnonzero(ok[lo : hi + 1]) + lo
            target = end_from(start_of(pool), pool)
        # what leads out of the window stays where it is
        succ = np.where(target <= hi, np.searchsorted(pool, np.minimum(target, hi)), np.arange(len(pool)))
        reached = np.zeros(len(pool), bool)
        reached[0] = True
        while True:
            more = reached.copy()
            more[succ[reached]] = True
            if (more == reached).all():
                break
            reached, succ = more, succ[succ]
        at = np.flatnonzero(reached)
        ends = np.concatenate([ends, pool[at[1:]], target[at[-1:]] if hi < n else []]).astype(np.int64)
    return np.concatenate([[0], start_of(ends[:-1])]).tolist(), ends.tolist()


_SCHEMA = "item_id long, piece_no int, start_byte long, end_byte long, piece string"


def _pieces(batches: Iterator[pa.RecordBatch], limit: int, overlap: int) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
    for batch in batches:
        rows: list[tuple] = []
        size = 0
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("body"), strict=True):
            raw = text.as_py().encode()
            for k, (a, b) in enumerate(zip(*cuts(raw, limit, overlap), strict=True)):
                rows.append((item, k, a, b, raw[a:b].decode()))
                size += b - a
                if size >= OUT:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in _SCHEMA.split(", ")])
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in _SCHEMA.split(", ")])


def pieces(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(item_id, piece_no, start_byte, end_byte, piece) of the bodies longer than ``limit`` bytes of UTF-8."""
    big = items.where(F.octet_length("body") > limit).select("item_id", "body")
    return big.mapInArrow(lambda b: _pieces(b, limit, overlap), _SCHEMA)


def coverage(found: DataFrame) -> DataFrame:
    """(item_id, n_bytes, longest, gaps, misfits, whole): what proves the pieces of each item right: the bytes they cover, the longest one, breaks between neighbours, overlaps that are not ``OVERLAP`` less the bytes of a character, and a hash of the text they make up again.

    Items must differ in their id.  The pieces of an item are gathered, as its text was one row.
    """
    p = found.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "start_byte", "end_byte", "piece"))).alias("p"))
    before = F.transform("p", lambda x, k: F.when(k == 0, 0).otherwise(F.get("p", k - 1)["end_byte"]))
    fresh = F.zip_with("p", before, lambda x, e: F.decode(F.substring(F.encode(x["piece"], "UTF-8"), (e - x["start_byte"] + 1).cast("int"), F.lit(LIMIT)), "UTF-8"))
    shared = F.slice(F.zip_with("p", before, lambda x, e: e - x["start_byte"]), 2, F.size("p"))
    return p.select(
        "item_id",
        F.element_at("p", -1)["end_byte"].alias("n_bytes"),
        F.array_max(F.transform("p", lambda x: x["end_byte"] - x["start_byte"])).alias("longest"),
        F.size(F.filter(shared, lambda x: x < 0)).alias("gaps"),
        F.size(F.filter(shared, lambda x: (x > OVERLAP) | (x < OVERLAP - 4))).alias("misfits"),
        F.sha2(F.array_join(fresh, ""), 256).alias("whole"),
    )


def split_items(found: DataFrame) -> DataFrame:
    """(item_id) of each item that was split: its first piece stands for it."""
    return found.where(F.col("piece_no") == 0).select("item_id")
