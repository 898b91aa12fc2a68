"""Registered queries of the operators for training text, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.load import spread, table
from . import docs, handwritten, leaks, lookalike, mixture, pieces


def _files(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "source_files").select("file_id", "repo", "content"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "indexed_content").select("item_id", "body"))


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "code_entities").select("row_id", "id", "kind", "name", "signature", "body", "language"))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", "source"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.kinds(_files(spark, d)).where(F.col("kind") != "hand-written").select("file_id")


def p1_kinds(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.kinds(_files(spark, d))


def p1_copies(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.copies(_files(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_items(pieces.pieces(_items(spark, d)))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.pieces(_items(spark, d))


def p4_coverage(spark: SparkSession, d: str) -> DataFrame:
    return pieces.coverage(p4_pieces(spark, d)).withColumn("longest", F.col("longest") <= pieces.LIMIT)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return docs.documented(_entities(spark, d)).select("row_id")


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docs.pairs(_entities(spark, d), table(spark, d, "code_edges"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(_docs(spark, d), table(spark, d, "eval_items"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return leaks.report(p7_found(spark, d))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(_docs(spark, d), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(_docs(spark, d), table(spark, d, "mix_targets"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.pairs(_docs(spark, d))


def p9_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.forms(_docs(spark, d))


def p9_groups(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.groups(_docs(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_kinds, p1_copies, p4_found, p4_pieces, p4_coverage, p5_found, p5_pairs, p7_found, p7_report, p8_mix, p8_shares, p9_found, p9_forms, p9_groups)}
_LINES = """
WITH l AS (
  SELECT DISTINCT file_id, repo, trim(regexp_replace(unnest(regexp_split_to_array(content, '\r\n|\r|\n')), '[ \t]+', ' ', 'g'), ' ') AS line
  FROM source_files WHERE coalesce(repo, '') <> ''),
k AS (SELECT * FROM l WHERE length(line) >= 10),
n AS (SELECT file_id, count(*) AS n FROM k GROUP BY 1),
p AS (SELECT a.file_id, b.file_id AS other, count(*) AS shared FROM k a JOIN k b ON a.line = b.line AND a.repo <> b.repo GROUP BY 1, 2)
"""
ORACLE = {
    "p1_copies": _LINES + "SELECT DISTINCT file_id FROM p JOIN n USING (file_id) WHERE shared >= 4 AND shared >= 0.6 * n - 1e-9",
    "p4_found": "SELECT item_id FROM indexed_content WHERE octet_length(encode(body)) > 4096",
    "p4_coverage": "SELECT item_id, octet_length(encode(body)) AS n_bytes, true AS longest, 0 AS gaps, 0 AS misfits, sha256(body) AS whole FROM indexed_content WHERE octet_length(encode(body)) > 4096",
}
