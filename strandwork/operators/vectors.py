"""Vector search: binary codes, Hamming and cosine distance, two-stage top k.

Codes are one bit a dimension packed to longs; Hamming distances are popcounts of
their exclusive or, in the JVM between two columns and in numpy between a set of
queries and all rows.  A set of queries meets all rows in Arrow batches, in blocks of
queries of a bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType


def bits(v: Column) -> Column:
    """One bit per dimension, set where the value is above 0, as longs of 32 bits, first dimension highest."""
    word = lambda i: F.aggregate(F.slice(v, i * 32 + 1, F.lit(32)), F.lit(0).cast("long"), lambda a, x: a * 2 + F.when(x > 0, 1).otherwise(0).cast("long"))
    n = F.ceil(F.size(v) / 32).cast("int")
    return F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), word)).otherwise(F.array().cast("array<long>"))


@F.pandas_udf(ArrayType(LongType()))
def _packed(v: pd.Series) -> pd.Series:
    def one(x: np.ndarray) -> np.ndarray:
        on = np.packbits(np.asarray(x, np.float64) > 0)
        wide = np.zeros((-(-len(on) // 4)) * 4, np.uint8)
        wide[: len(on)] = on
        return wide.view(">u4").astype(np.int64)

    return v.map(one, na_action="ignore")


def packed(v: str | Column) -> Column:
    """What ``bits`` gives, made in batches: faster where many vectors are coded."""
    return _packed(v)


def bit_string(v: Column) -> Column:
    """The bits as text, for display and tests."""
    return F.array_join(F.transform(v, lambda x: F.when(x > 0, "1").otherwise("0")), "")


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(F.coalesce(x, F.lit(0).cast("long")).bitwiseXOR(F.coalesce(y, F.lit(0).cast("long"))))), F.lit(0), lambda s, x: s + x)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In double; 0 where a norm is next to nothing; the shorter length counts."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norm < 1e-10, F.lit(0.0)).otherwise(_dot(a, b) / norm)


#: Queries that one pass holds in each task; more are taken in blocks.
BLOCK = 4096


def queries_of(vectors: DataFrame, every: int = 50) -> DataFrame:
    """The stated query set: rows whose id is divisible by ``every``."""
    return vectors.where(F.pmod(F.col("vec_id"), F.lit(every)) == 0)


def _matrix(rows: list, dims: int) -> np.ndarray:
    """Vectors as rows of double, missing values and dimensions as 0."""
    out = np.zeros((len(rows), dims))
    for k, v in enumerate(rows):
        out[k, : min(len(v), dims)] = [0.0 if x is None else x for x in v[:dims]]
    return out


def _values(m: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Distance of each query (row) to each vector (column): what is smaller is nearer."""
    if metric == "hamming":
        a, b = (q > 0).astype(np.float64), (m > 0).astype(np.float64)
        return a.sum(1)[:, None] + b.sum(1)[None, :] - 2 * (a @ b.T)
    norm = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((m * m).sum(1))[None, :]
    return -np.round(np.where(norm < 1e-10, 0.0, (q @ m.T) / np.where(norm < 1e-10, 1.0, norm)), 6)


def _codes(b: pa.RecordBatch, words: int) -> np.ndarray:
    """The codes of a batch as rows of unsigned words."""
    out = np.zeros((b.num_rows, words), np.uint64)
    for k, v in enumerate(b.column("bits").to_pylist()):
        out[k, : min(len(v), words)] = v[:words]
    return out


def _distances(codes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Bits in which each query (row) and each code (column) differ."""
    out = np.zeros((len(q), len(codes)), np.int64)
    for w in range(q.shape[1]):
        out += np.bitwise_count(q[:, w][:, None] ^ codes[:, w][None, :])
    return out


def _nearest(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray | None, codes: np.ndarray | None, k: int, metric: str, bound: int | None = None) -> Iterator[pa.RecordBatch]:
    """The k nearest of a task's rows to each query; those of earlier batches are kept beside each batch.

    With codes and a metric of full vectors, only rows whose code is within ``bound`` bits are compared in full.
    """
    best_v, best_d = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
    for b in batches:
        own = b.column("vec_id").to_numpy(zero_copy_only=False)
        if codes is not None and metric == "hamming":
            d = _distances(_codes(b, codes.shape[1]), codes).astype(np.float64)
        else:
            d = _values(_matrix(b.column("embedding").to_pylist(), q.shape[1]), q, metric)
            if codes is not None:
                d[_distances(_codes(b, codes.shape[1]), codes) > bound] = np.inf
        d[ids[:, None] == own[None, :]] = np.inf
        v = np.concatenate([best_v, np.broadcast_to(own, d.shape)], 1)
        d = np.concatenate([best_d, d], 1)
        near = np.lexsort((v, d), 1)[:, :k]
        best_v, best_d = np.take_along_axis(v, near, 1), np.take_along_axis(d, near, 1)
    ok = np.isfinite(best_d)
    rows = np.broadcast_to(ids[:, None], best_v.shape)
    yield pa.RecordBatch.from_arrays([pa.array(rows[ok].astype(np.int64)), pa.array(best_v[ok].astype(np.int64)), pa.array(best_d[ok].astype(np.float64))], names=["query_id", "vec_id", "d"])


def _topk(vectors: DataFrame, queries: DataFrame, k: int, metric: str, bits: float | None = None) -> DataFrame:
    """(query_id, vec_id, d, rank): the k nearest of all rows to each query, itself left out, ties by id.

    A pass over the rows holds a block of queries; a task gives at most k rows a query, and
    only those are shuffled and ranked.  Codes (``bits``) are read where the frame has them
    and made of the vectors where not; with ``bits`` a part of the dimensions, rows whose code
    differs in more of them than that are no candidates.
    """
    spark = vectors.sparkSession
    coded = metric == "hamming" or bits is not None
    full = metric != "hamming"
    cols = [*(["embedding"] if full else []), *(["bits"] if coded else [])]

    def usable(df: DataFrame) -> DataFrame:
        df = df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        code = (F.col("bits") if "bits" in df.columns else packed("embedding")).alias("bits") if coded else None
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), *(["embedding"] if full else []), *([code] if coded else []), F.size("embedding").alias("dims"))

    v, q = usable(vectors).select("vec_id", *cols), usable(queries)
    blocks = max(1, -(-q.count() // BLOCK))
    out = None
    for n in range(blocks):
        rows = q.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == n).collect() if blocks > 1 else q.collect()
        if not rows:
            continue
        dims = max(r["dims"] for r in rows)
        m = _matrix([r["embedding"] for r in rows], dims) if full else None
        words = max(len(r["bits"]) for r in rows) if coded else 0
        c = np.array([r["bits"] + [0] * (words - len(r["bits"])) for r in rows], np.uint64).reshape(len(rows), words) if coded else None
        held = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in rows], np.int64), m, c, k, metric, int(bits * dims) if bits is not None else None))
        near = v.mapInArrow(lambda b, h=held: _nearest(b, *h.value), "query_id long, vec_id long, d double")
        out = near if out is None else out.unionByName(near)
    if out is None:
        out = v.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("d")).limit(0)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("d", "vec_id")))
    return ranked.where(F.col("rank") <= k)


def hamming_topk(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, vec_id, distance, rank): the k nearest codes of each query among all rows, itself left out."""
    return _topk(vectors, queries, k, "hamming").select("query_id", "vec_id", F.col("d").cast("int").alias("distance"), "rank")


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, vec_id, score, rank): the k most similar vectors of each query among all rows, itself left out."""
    return _topk(vectors, queries, k, "cosine").select("query_id", "vec_id", (-F.col("d")).alias("score"), "rank")


#: Part of the dimensions in which the codes of candidates may differ: with it codes of 64 bits reach a recall of 0.9.
NEAR = 0.485


def two_stage(vectors: DataFrame, queries: DataFrame, k: int = 10, near: float = NEAR) -> DataFrame:
    """(query_id, vec_id, score, rank): rows whose code is near the query's are candidates, and these are ranked by cosine.

    Nearness is a bound on the bits that differ (``near`` of the dimensions), so candidates are
    chosen where their row is read: no list of them is counted, shuffled or joined, and a query
    loses none to the number of rows.
    """
    return _topk(vectors, queries, k, "cosine", near).select("query_id", "vec_id", (-F.col("d")).alias("score"), "rank")


def stats(vectors: DataFrame) -> DataFrame:
    """(n, dims, kb_float, kb_bits): memory of vectors and of their codes."""
    g = vectors.agg(F.count("embedding").alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dims"))
    return g.select("n", "dims", (F.col("n") * F.col("dims") * 4 / 1024).alias("kb_float"), (F.col("n") * F.ceil(F.col("dims") / 8) / 1024).alias("kb_bits"))


def function_text(name: Column, signature: Column, path: Column) -> Column:
    """What is embedded of a function: name [signature] in path."""
    return F.concat(name, F.when(signature.isNotNull(), F.concat(F.lit(" "), signature)).otherwise(F.lit("")), F.lit(" in "), path)


def hashed_embedding(text: Column, dims: int = 64) -> Column:
    """A vector without a model: words hashed to dimensions with a sign. For use without a provider."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    spots = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(dims)).alias("d"), F.when(F.pmod(F.hash(w), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.aggregate(F.filter(spots, lambda x: x["d"] == d), F.lit(0.0), lambda a, x: a + x["s"]).cast("float"))
