"""Evaluation passages inside training documents, by a prefix-filtered set join.

A leak is a run of ``RUN`` consecutive words that a document shares with an item.
Each window of ``RUN`` words of an item is a set of shingles of ``SHINGLE`` words.
A document that holds the window holds all of its shingles, so its rarest one, by
counts over all documents, is the necessary prefix; documents and windows are joined
on hashes of these.  A match must leave room for the window on both sides (bounds on
length and position), and is then verified word by word over the window.

The documents are read once.  That pass knows the items' shingles as bits of a bitmap
of a fixed largest size: a text is brought to words, its shingles are hashed and
counted, and only stretches in which every shingle may be an item's, long enough for a
run, leave the task with their words.  What the bitmap lets through by chance is
dropped by the join, so its size changes the work but not the result.

Defined results: a null or short text (under ``RUN`` words) has no leak; a pair is
reported once however often it matches; repeated items or documents report each id,
and texts of one id are told apart; empty tables give no rows; only ids and texts are
read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import Cutter
from .lookalike import skeleton

RUN, SHINGLE = 12, 3
#: Shingles of a window.
WINDOW = RUN - SHINGLE + 1
#: The bitmap of item shingles has at most two to this many bits (32 MB).
MOST_BITS = 28
_WORD = re.compile("[\\w" + chr(0x300) + "-" + chr(0x36F) + "]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores of the text's one form, without letter case."""
    return _WORD.findall(skeleton(text).casefold()) if text else []


def shingles(texts: list[list[str]]) -> np.ndarray:
    """A hash for each place of the joined texts: of the words from there on; places whose shingle runs over a text's end mean nothing."""
    own: dict[str, int] = {w: xxhash.xxh64_intdigest(w) for w in {w for t in texts for w in t}}
    h = np.fromiter((own[w] for t in texts for w in t), np.uint64, sum(map(len, texts)))
    out = h.copy()
    for k in range(1, SHINGLE):
        out[: len(h) - k] = (out[: len(h) - k] * _ODD) ^ (h[k:] + np.uint64(k))
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kept = [(i, w) for i, t in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True) if len(w := words(t)) >= RUN]
        flat, at, hashes = shingles([w for _, w in kept]), 0, []
        for _, w in kept:
            hashes.append(flat[at : at + len(w) - SHINGLE + 1])
            at += len(w)
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in kept], pa.int64()), pa.array([w for _, w in kept], pa.list_(pa.string())), pa.array(hashes, pa.list_(pa.int64()))], names=["item_id", "words", "shingles"])


_STRETCH = "doc_id long, words array<string>, shingles array<long>, counts array<long>"


def _stretches(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Of each batch, a row with the counts of its hits (no ``doc_id``) and a row for each stretch of hits that has room for a window."""
    mask, one = np.int64((1 << bits) - 1), np.uint64(1)
    for b in batches:
        texts = [words(t) for t in b.column("text").to_pylist()]
        ids = b.column("doc_id").to_pylist()
        flat = shingles(texts)
        spot = (flat & mask).astype(np.uint64)
        hit = (bitmap[spot >> np.uint64(6)] >> (spot & np.uint64(63)) & one).astype(bool)
        ends = np.cumsum([len(t) for t in texts])
        for k in range(1, SHINGLE):  # no shingle runs over a text's end
            last = ends - k
            hit[last[last >= 0]] = False
        seen, n = np.unique(flat[hit], return_counts=True)
        docs, said, hashes, counts = [None], [None], [seen], [n]
        step = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
        for first, after in zip(step[::2], step[1::2], strict=True):
            if after - first >= WINDOW:
                d = int(np.searchsorted(ends, first, side="right"))
                base = int(ends[d]) - len(texts[d])
                docs.append(ids[d])
                said.append(texts[d][first - base : after - base + SHINGLE - 1])
                hashes.append(flat[first:after])
                counts.append(None)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(said, pa.list_(pa.string())), pa.array(hashes, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))], names=["doc_id", "words", "shingles", "counts"])


def _bitmap(items: DataFrame, most_bits: int) -> tuple[np.ndarray, int]:
    """The bits of the items' shingles, from bits that were joined in the tasks, and how many bits name a place."""
    n = items.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0)).alias("n")).first()["n"]
    bits = min(most_bits, max(12, (int(n) * 64).bit_length()))
    spot = items.select(F.explode("shingles").alias("s")).select(F.col("s").bitwiseAND(F.lit((1 << bits) - 1)).alias("at"))
    longs = spot.groupBy(F.shiftright("at", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("set")).toArrow()  # one row a long of the bitmap at most
    out = np.zeros(1 << (bits - 6), np.int64)
    out[longs["at"].to_numpy()] = longs["set"].to_numpy()
    return out.view(np.uint64), bits


def prefixes(items: DataFrame, counts: DataFrame) -> DataFrame:
    """(shingle, item_id, at, window): the rarest shingle of each window of each item, its place in the window, and the window's words; ties go to the smaller hash and the first place."""
    one = items.select(F.monotonically_increasing_id().alias("row"), "item_id", "words", "shingles")
    placed = one.select("row", F.posexplode("shingles").alias("place", "shingle")).join(counts, "shingle", "left")
    # an item's own places
    ranked = placed.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "shingle"))).alias("p"))
    ranked = ranked.select(F.col("row").alias("r"), F.transform("p", lambda x: F.struct(x["n"].alias("n"), x["shingle"].alias("shingle"), x["place"].alias("place"))).alias("p"))
    starts = F.sequence(F.lit(0), F.size("words") - RUN)
    rows = one.join(ranked, F.col("row") == F.col("r")).select("item_id", F.explode(F.transform(starts, lambda s: F.struct(s.alias("s"), F.array_min(F.slice("p", s + 1, F.lit(WINDOW))).alias("m"), F.slice("words", s + 1, F.lit(RUN)).alias("window")))).alias("w"))
    return rows.select(F.col("w.m.shingle").alias("shingle"), "item_id", (F.col("w.m.place") - F.col("w.s")).alias("at"), F.col("w.window").alias("window"))


def leaks(docs: DataFrame, items: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, item_id): the documents that hold ``RUN`` or more consecutive words of the item."""
    spark = docs.sparkSession
    cutter = Cutter(spark, "leaks")
    d = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    q = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    q = cutter.cut(q.mapInArrow(_item_rows, "item_id long, words array<string>, shingles array<long>"))
    shared = spark.sparkContext.broadcast(_bitmap(q, most_bits))
    found = cutter.cut(d.mapInArrow(lambda b: _stretches(b, *shared.value), _STRETCH))
    shared.unpersist()
    counts = found.where(F.col("doc_id").isNull()).select(F.explode(F.arrays_zip("shingles", "counts")).alias("c")).groupBy(F.col("c.shingles").alias("shingle")).agg(F.sum("c.counts").alias("n"))
    prefix = cutter.cut(prefixes(q, counts))
    # each place goes with the words that a window around it can reach
    first = lambda p: F.greatest(p - WINDOW + 1, F.lit(0))
    around = F.transform("shingles", lambda s, p: F.struct(s.alias("shingle"), (p - first(p)).alias("p"), F.slice("words", first(p) + 1, F.lit(2 * RUN - SHINGLE)).alias("words")))
    places = found.where(F.col("doc_id").isNotNull()).select("doc_id", F.explode(around).alias("x")).select("doc_id", "x.shingle", "x.p", "x.words")
    start = F.col("p") - F.col("at")
    room = (start >= 0) & (start + RUN <= F.size("words"))
    hits = places.join(prefix, "shingle").where(room).where(F.slice("words", start + 1, F.lit(RUN)) == F.col("window"))
    return cutter.only(hits.select("doc_id", "item_id").distinct())


def report(found: DataFrame) -> DataFrame:
    """(item_id, n_docs, first_doc): how far each leaked item spread."""
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))
