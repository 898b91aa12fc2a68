"""Roll-ups of the event log: summaries, hours, recent sessions, token gain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import hour_key
from .graph import first_per
from .sessions import MILLIS

#: Tokens a call saves when its tool has no estimate.
PER_CALL = 2500
# Estimated tokens that one call of a tool saves.
ESTIMATES = {
    "impact_analysis": 50_000, "code_health": 20_000, "type_hierarchy": 15_000, "refactor": 12_000, "ask": 10_000, "search": 8_000,
    "find_callers": 6_000, "find_callees": 6_000, "context_bundle": 5_000, "semantic_search": 4_000, "knowledge": 3_500, "find_function": 3_000,
    "file_entities": 3_000, "suggest_structure": 3_000, "http_analysis": 3_000, "edit_preflight": 3_000, "contributors": 2_500, "conversations": 2_500,
    "community_detection": 2_500, "skills": 2_000, "memory": 2_000, "manage_adr": 2_000, "lint": 2_000, "capture_insight": 1_500, "search_indexed": 3_000,
    "fetch_and_index": 1_500, "index_content": 1_500, "graph_stats": 500, "supported_languages": 500, "api_changelog": 500, "project": 500,
    "index_status": 500, "index_codebase": 500, "retrieve_archived": 500, "raw_query": 1_000, "sandbox_run": 1_000, "sync_git_history": 1_000,
    "export_obsidian": 1_000, "embed_functions": 1_000,
}


def usable(events: DataFrame) -> DataFrame:
    """Events with ``at``, their time in seconds; those without a time are left out."""
    at = F.when(F.col("ts") > MILLIS, F.floor(F.col("ts") / 1000)).otherwise(F.col("ts")).cast("long")
    return events.where(F.col("ts") != 0).withColumn("at", at)


def summary(events: DataFrame) -> DataFrame:
    """(section, key, n): totals, by repo, by kind and by UTC hour, from one pass over the events."""
    e = usable(events).select(F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("kind", F.lit("")).alias("kind"), hour_key(F.col("at")).alias("hour"))
    g = e.groupBy("repo", "kind", "hour").agg(F.count(F.lit(1)).alias("n"))
    cells = F.array(*(F.struct(F.lit(s).alias("section"), c.alias("key")) for s, c in (("total", F.lit("")), ("repo", F.col("repo")), ("kind", F.col("kind")), ("hour", F.col("hour")))))
    return g.select(F.explode(cells).alias("c"), "n").groupBy("c.section", "c.key").agg(F.sum("n").alias("n"))


def hourly(events: DataFrame) -> DataFrame:
    """(hour, n): tumbling hours."""
    return usable(events).groupBy(hour_key(F.col("at")).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def rates(events: DataFrame) -> DataFrame:
    """(calls, first_at, last_at, span_days, per_day): calls a day over the covered span, whole numbers."""
    g = usable(events).agg(F.count(F.lit(1)).alias("calls"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    span = F.expr("(last_at - first_at) div 86400")
    return g.withColumn("span_days", span).withColumn("per_day", F.expr("calls div greatest(span_days, 1)"))


def recent_sessions(events: DataFrame, k: int | None = 20, tail: int = 20) -> DataFrame:
    """(session, started_at, ended_at, n, n_repos, first_repo, tail_n, tail_first): sessions by their id ('legacy' without one), the latest first.

    ``tail_first`` is the id of the earliest of the last ``tail`` events.  Tails are cut
    per slice of events before a session's events meet.
    """
    e = usable(events).select("event_id", "at", F.coalesce("repo", F.lit("")).alias("repo"), F.when(F.coalesce("session_id", F.lit("")) == "", "legacy").otherwise(F.col("session_id")).alias("session"))
    g = e.groupBy("session").agg(F.min("at").alias("started_at"), F.max("at").alias("ended_at"), F.count(F.lit(1)).alias("n"), F.countDistinct("repo").alias("n_repos"), F.min(F.struct("at", "event_id", "repo")).alias("f"))
    g = g.select("session", "started_at", "ended_at", "n", "n_repos", F.col("f.repo").alias("first_repo"))
    g = g.orderBy(F.desc("ended_at"), "session").limit(k) if k is not None else g
    last = first_per(e.join(g.select("session"), "session", "left_semi").select("session", "at", "event_id"), ["session"], [F.desc("at"), F.desc("event_id")], tail)
    t = last.groupBy("session").agg(F.count(F.lit(1)).alias("tail_n"), F.min(F.struct("at", "event_id")).alias("t")).select("session", "tail_n", F.col("t.event_id").alias("tail_first"))
    return g.join(t, "session")


def session_kinds(events: DataFrame) -> DataFrame:
    """(session, kind, n) and, as kind 'repo:' and a name, the events of each repo of a session: what ``recent_sessions`` counts, row by row."""
    e = usable(events).select(F.when(F.coalesce("session_id", F.lit("")) == "", "legacy").otherwise(F.col("session_id")).alias("session"), F.array(F.coalesce("kind", F.lit("")), F.concat(F.lit("repo:"), F.coalesce("repo", F.lit("")))).alias("k"))
    return e.select("session", F.explode("k").alias("kind")).groupBy("session", "kind").agg(F.count(F.lit(1)).alias("n"))


def session_tails(events: DataFrame, tail: int = 20) -> DataFrame:
    """(session, event_id, at): the last ``tail`` events of every session."""
    e = usable(events).select(F.when(F.coalesce("session_id", F.lit("")) == "", "legacy").otherwise(F.col("session_id")).alias("session"), "event_id", "at")
    return first_per(e, ["session"], [F.desc("at"), F.desc("event_id")], tail)


def gain(calls: DataFrame, unattributed: int = 0) -> DataFrame:
    """(tool, calls, tokens): estimated tokens saved per tool of ``calls(tool)``; calls without a tool count at the general rate."""
    table = F.create_map(*(F.lit(x) for kv in ESTIMATES.items() for x in kv))
    g = calls.groupBy(F.coalesce("tool", F.lit("")).alias("tool")).agg(F.count(F.lit(1)).alias("calls"))
    if unattributed:
        g = g.unionByName(calls.sparkSession.range(1).select(F.lit("").alias("tool"), F.lit(unattributed).cast("long").alias("calls"))).groupBy("tool").agg(F.sum("calls").alias("calls"))
    return g.withColumn("tokens", F.col("calls") * F.coalesce(F.try_element_at(table, F.col("tool")), F.lit(PER_CALL)))


def busiest_hours(events: DataFrame, k: int = 24) -> DataFrame:
    """The last k active hours."""
    return hourly(events).orderBy(F.desc("hour")).limit(k)


def next_of(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Each row with the value of the next one of its key."""
    return rows.withColumn("next", F.lead(value).over(Window.partitionBy(key).orderBy(order)))
