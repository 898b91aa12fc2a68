"""References to records that do not exist, by bitmaps over integer key codes.

Every key, referenced or held, gets an integer code: a dictionary table with one
row per distinct key, numbered within its partition, written once.  Codes are
grouped into key ranges of 64; a range's bits are one long, so a bitmap is a
sparse set of longs and its AND and NOT are plain expressions of the JVM.  There
are three parent bitmaps (the key exists, it is alive, it had arrived by a month)
and one reference bitmap per key range and month.  Bits that survive reference
AND NOT parent are decoded to codes and met with the references, where 'late' is
confirmed on the exact times.

Each aggregation is partial before its shuffle.  A key that a third of all
references name is one row of the dictionary and one bit; only the two joins of
references on keys meet it, and adaptive execution splits their skewed side.

Defined results: see ``references`` and ``orphans``.  Repeated references count
each; empty tables give no rows (or 'missing' for every reference when only the
records are empty); columns not named here are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.cut import Cutter

BITS = 64


def references(edges: DataFrame) -> DataFrame:
    """(edge_id, key, to_table, at): the key is ``to_entity``, or where null or empty ``to_table:raw_target``; rows with neither are left out."""
    spare = F.when((F.col("to_table") != "") & (F.col("raw_target") != ""), F.concat_ws(":", "to_table", "raw_target"))
    key = F.when(F.coalesce("to_entity", F.lit("")) != "", F.col("to_entity")).otherwise(spare)
    return edges.select("edge_id", key.alias("key"), "to_table", F.col("indexed_at").alias("at")).where(F.col("key").isNotNull())


def records(entities: DataFrame) -> DataFrame:
    """(key, at, gone): one row per version; a null ``is_deleted`` is alive; rows without a key are left out."""
    return entities.where(F.col("id") != "").select(F.col("id").alias("key"), F.col("indexed_at").alias("at"), F.coalesce("is_deleted", F.lit(False)).alias("gone"))


def _month(at: str) -> Column:
    return F.year(at) * 12 + F.month(at)




def orphans(refs: DataFrame, recs: DataFrame) -> DataFrame:
    """(edge_id, to_table, at, status) of the references ``references`` gives that have no usable record of ``records``.

    'missing': no record has the key.  'deleted': the version with the latest time is
    deleted (null times come first; of versions at one time a deleted one wins).
    'late': alive, but the reference's time is before the earliest of the key.  A null
    time of a reference is never late; a key whose times are all null never either.
    """
    cutter = Cutter(refs.sparkSession, "orphans")
    latest = F.struct(F.col("at").isNotNull().alias("known"), "at", "gone")
    both = recs.select("key", F.col("at").alias("born"), latest.alias("version")).unionByName(
        refs.select("key", F.lit(None).cast(recs.schema["at"].dataType).alias("born"), F.lit(None).cast("struct<known:boolean,at:%s,gone:boolean>" % recs.schema["at"].dataType.simpleString()).alias("version"))
    )
    keys = cutter.cut(
        both.groupBy("key")
        .agg(F.min("born").alias("born"), F.max("version").alias("last"))
        .select("key", "born", F.col("last").isNotNull().alias("held"), F.coalesce("last.gone", F.lit(False)).alias("gone"), F.monotonically_increasing_id().alias("code"))
    )
    coded = cutter.cut(refs.join(keys.select("key", "code"), "key").select("edge_id", "to_table", "at", "code"))
    span, bit = F.shiftright("code", 6).alias("span"), F.expr("shiftleft(1L, cast(code & 63 as int))")
    used = coded.groupBy(span, F.coalesce(_month("at"), F.lit(0)).alias("month")).agg(F.bit_or(bit).alias("refs"))
    parents = keys.where("held").groupBy(span).agg(
        F.bit_or(bit).alias("exists"),
        F.bit_or(F.when(F.col("gone"), F.lit(0).cast("long")).otherwise(bit)).alias("alive"),
        # at most 64 keys, so at most 64 entries, of a range
        F.collect_list(F.when(F.col("born").isNotNull(), F.struct(_month("born").alias("month"), bit.alias("bit")))).alias("births"),
    )
    arrived = F.aggregate(F.filter("births", lambda b: b["month"] < F.col("month")), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b["bit"]))
    dated = F.aggregate("births", F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b["bit"]))
    zero = F.lit(0).cast("long")
    left = (
        used.join(parents, "span", "left")
        .select(
            "span",
            "month",
            "refs",
            F.coalesce("exists", zero).alias("exists"),
            F.coalesce("alive", zero).alias("alive"),
            F.coalesce(arrived, zero).alias("arrived"),
            F.coalesce(dated, zero).alias("dated"),
        )
        .select(
            "span",
            "month",
            F.expr("refs & ~`exists`").alias("missing"),
            F.expr("refs & `exists` & ~alive").alias("deleted"),
            F.expr("refs & alive & dated & ~arrived").alias("late"),
        )
    )
    bits = F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("i")
    status = F.expr("case when missing & shiftleft(1L, i) <> 0 then 'missing' when deleted & shiftleft(1L, i) <> 0 then 'deleted' when late & shiftleft(1L, i) <> 0 then 'late' end")
    codes = (
        left.where(F.expr("(missing | deleted | late) <> 0"))
        .select("span", "month", "missing", "deleted", "late", bits)
        .select(F.expr("shiftleft(span, 6) | i").alias("code"), "month", status.alias("status"))
        .where(F.col("status").isNotNull())
    )
    born = keys.select(F.col("code").alias("k_code"), "born")
    late = codes.where(F.col("status") == "late").join(born, F.col("code") == F.col("k_code")).select("code", "month", "status", "born")
    lost = codes.where(F.col("status") != "late").select("code", "month", "status", F.lit(None).cast(born.schema["born"].dataType).alias("born"))
    found = lost.unionByName(late)
    same = (F.col("c") == F.col("code")) & (F.col("m") == F.col("month"))
    return (
        coded.select("edge_id", "to_table", "at", F.col("code").alias("c"), F.coalesce(_month("at"), F.lit(0)).alias("m"))
        .join(found, same)
        .where((F.col("status") != "late") | (F.col("at") < F.col("born")))
        .select("edge_id", "to_table", "at", "status")
    )


def report(found: DataFrame) -> DataFrame:
    """(to_table, month, status, n): counts of orphans per table and month ('' where unknown)."""
    month = F.coalesce(F.date_format("at", "yyyy-MM"), F.lit(""))
    return found.groupBy(F.coalesce("to_table", F.lit("")).alias("to_table"), month.alias("month"), "status").agg(F.count(F.lit(1)).alias("n"))
