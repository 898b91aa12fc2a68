"""The logical frames of the code graph, bound to the stored tables.

``entities`` holds the latest live version of each id, ``edges`` the relations with
both ends, and the rest are views of these two.  All are lazy; columns that an
operator does not use are pruned down to the scan.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cut import broadcast_if_small
from .load import table

ENTITY = ("id", "node_table", "kind", "name", "qualified_name", "file_path", "repo", "start_line", "end_line", "signature", "body", "body_hash", "language", "cuda_qualifier")


def latest(df: DataFrame, key: str, order: list[str], cols: list[str]) -> DataFrame:
    """The row with the greatest ``order`` of each key: partial maxima before the shuffle, so repeats of one key never meet in one task as rows."""
    best = df.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r"))
    return best.select(key, *(F.col(f"r.{c}").alias(c) for c in cols if c != key))


class Graph:
    """Frames of one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def entities(self, *cols: str, tables: tuple[str, ...] = ()) -> DataFrame:
        """Latest live versions with ``cols`` (all by default), of ``tables`` where given: an id names its table, so the scan is filtered before versions meet."""
        want = list(dict.fromkeys(("id", *(cols or ENTITY))))
        raw = self.table("code_entities").withColumn("is_deleted", F.coalesce("is_deleted", F.lit(False)))
        raw = raw.where(F.col("node_table").isin(*tables)) if tables else raw
        live = latest(raw, "id", ["indexed_at", "row_id"], [*(c for c in want if c != "id"), "is_deleted"])
        return live.where(~F.col("is_deleted")).select(*want)

    def listed(self, ids: list[str], *cols: str) -> DataFrame:
        """The functions among a few ids, which are filters of the scan."""
        want = list(dict.fromkeys(("id", *cols)))
        raw = self.table("code_entities").where(F.col("id").isin(*ids) & (F.col("node_table") == "function")).withColumn("is_deleted", F.coalesce("is_deleted", F.lit(False)))
        live = latest(raw, "id", ["indexed_at", "row_id"], [*(c for c in want if c != "id"), "is_deleted"])
        return live.where(~F.col("is_deleted")).select(*want)

    def ever(self, where: Column, *cols: str, tables: tuple[str, ...] = ()) -> DataFrame:
        """``entities`` that meet ``where``: only ids with a version that meets it are brought to their latest version, so few rows are aggregated for a rare condition."""
        want = list(dict.fromkeys(("id", *(cols or ENTITY))))
        raw = self.table("code_entities").withColumn("is_deleted", F.coalesce("is_deleted", F.lit(False)))
        raw = raw.where(F.col("node_table").isin(*tables)) if tables else raw
        ids = raw.where(where).select(F.col("id").alias("known")).distinct()
        some = raw.join(broadcast_if_small(ids, 160, rows=20_000), F.col("id") == F.col("known"), "left_semi")
        live = latest(some, "id", ["indexed_at", "row_id"], [*(c for c in want if c != "id"), "is_deleted"])
        return live.where(~F.col("is_deleted")).select(*want).where(where)

    def functions(self, *cols: str) -> DataFrame:
        return self._of("function", cols)

    def classes(self, *cols: str) -> DataFrame:
        return self._of("class", cols)

    def _of(self, node_table: str, cols: tuple[str, ...]) -> DataFrame:
        return self.entities(*(cols or ENTITY), tables=(node_table,))

    @cached_property
    def edges(self) -> DataFrame:
        e = self.table("code_edges").where((F.col("from_entity") != "") & (F.col("to_entity") != ""))
        return e.select(F.lower("kind").alias("rel"), F.col("from_entity").alias("src"), F.col("to_entity").alias("dst"), F.col("from_table").alias("src_table"), F.col("to_table").alias("dst_table"), "repo", "line", "raw_callee", "method", "url_pattern", "context")

    def rel(self, *names: str) -> DataFrame:
        return self.edges.where(F.col("rel").isin(*names))

    @cached_property
    def calls(self) -> DataFrame:
        return self.rel("calls").select("src", "dst", "line")


def named(df: DataFrame, prefix: str) -> DataFrame:
    """``df`` with every column renamed to ``prefix`` and its name."""
    return df.select(*(F.col(c).alias(f"{prefix}{c}") for c in df.columns))


def size_of(start: str | Column = "start_line", end: str | Column = "end_line") -> Column:
    """Lines of a symbol, at least 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (start, end))
    return F.greatest(b - a, F.lit(0))
