"""Mixing sources to target weights by repetition rates in tokens of a public tokenizer.

Tokens are summed per source (partial sums before the shuffle, so a source with a
third of all documents is one sum).  The rate of a source is how often each of its
documents must be used on average: share x total / tokens, at most the source's
cap.  Each document comes out floor(rate) times and once more when a hash of a seed
and the document falls below the fraction, so a rerun or a lost task changes nothing.

``total`` is by default the largest size at which no source exceeds its cap, so all
sources that have documents reach their shares; shares of listed sources without
documents go to the others in proportion.  With a larger ``total`` capped sources
fall short, and the report says by how much.

Defined results: source names are compared without case and outer white space; a
null or unlisted source, a null or tokenless text is not used; a null share or cap
counts as 0 or 1; a source listed twice adds its shares and takes the smaller cap;
repeated rows are documents of their own, and toss one coin where id and text are the
same (each its own where the id is null); empty tables give no rows; columns beside the
id, source and text are not read.
"""

from __future__ import annotations

import base64
import os

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.cut import Cutter, broadcast_if_small

#: A tiktoken rank file of a public tokenizer, and the pattern its words are split by.
TOKENIZER = os.environ.get("STRANDWORK_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOADED: dict[str, object] = {}


def _encoding(path: str):
    if path not in _LOADED:
        import tiktoken
        from pyspark import SparkFiles

        with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def token_count(text: Column, tokenizer: str = TOKENIZER) -> Column:
    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        enc = _encoding(tokenizer)
        return pd.Series([0 if t is None else len(enc.encode_ordinary(t)) for t in texts], dtype="int64")

    return count(text)


def _key(source: Column) -> Column:
    return F.lower(F.trim(source))


def counted(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens, body) of usable documents; ``body`` is a hash of the text, by which documents without an id toss coins of their own.

    The tokenizer's file is sent to the tasks, as their machines need not have it.
    """
    if os.path.exists(tokenizer):
        docs.sparkSession.sparkContext.addFile(tokenizer)
    d = docs.where(F.col("text").isNotNull() & (_key(F.col("source")) != "")).select("doc_id", _key(F.col("source")).alias("source"), "text")
    return d.select("doc_id", "source", token_count(F.col("text"), tokenizer).alias("tokens"), F.xxhash64("text").alias("body")).where(F.col("tokens") > 0)


def rates(counted_docs: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, docs, tokens, rate), one row per listed source."""
    t = targets.where(_key(F.col("source")) != "").groupBy(_key(F.col("source")).alias("source")).agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    n = counted_docs.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"))
    both = t.join(n, "source", "left").fillna(0, ["docs", "tokens"])
    whole = both.agg(F.sum(F.when((F.col("tokens") > 0), F.col("target_share"))).alias("present"))
    wanted = both.crossJoin(F.broadcast(whole)).withColumn("goal", F.when((F.col("tokens") > 0) & (F.col("target_share") > 0), F.col("target_share") / F.col("present")))  # one row beside each source
    size = wanted.agg((F.lit(float(total)) if total is not None else F.min(F.col("max_repeats") * F.col("tokens") / F.col("goal"))).alias("size"))
    rate = F.when(F.col("goal").isNotNull(), F.least(F.col("goal") * F.col("size") / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return wanted.crossJoin(F.broadcast(size)).select("source", "target_share", "max_repeats", "docs", "tokens", rate.alias("rate"))


def mix(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The mixture (doc_id, source, tokens, copy_no), and its report by source.

    Tokens are counted once, into a written table that both passes read.  ``copy_no``
    runs from 1 to at most the source's cap.
    """
    cutter = Cutter(docs.sparkSession, "mixture")
    c = cutter.cut(counted(docs, tokenizer).withColumn("row", F.monotonically_increasing_id()))
    r = cutter.cut(rates(c, targets, total))
    # rows without an id are told apart by their place in the written table
    place = F.when(F.col("doc_id").isNull(), F.col("row"))
    chance = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "body", place), F.lit(1 << 40)) / float(1 << 40)
    whole = F.floor("rate")
    copies = (whole + F.when(chance < F.col("rate") - whole, 1).otherwise(0)).cast("int")
    used = c.join(broadcast_if_small(r.select("source", "rate"), 256), "source").withColumn("copies", copies).where(F.col("copies") > 0)
    mixed = used.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))
    got = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    all_of = got.agg(F.sum("mixed_tokens").alias("all_tokens"))
    report = (
        r.join(got, "source", "left")
        .crossJoin(F.broadcast(all_of))
        .select(
            "source",
            "target_share",
            "max_repeats",
            "docs",
            "tokens",
            "rate",
            F.coalesce("mixed_tokens", F.lit(0).cast("long")).alias("mixed_tokens"),
            F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
            F.coalesce(F.col("mixed_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"),
        )
    )
    return mixed, report
