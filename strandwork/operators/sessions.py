"""Splitting events into sessions parted by inactivity, by pointer doubling.

Events are first contracted to cells: a stream's events of one stretch of
``gap`` seconds, aggregated before the shuffle.  Events of a cell are less than
``gap`` apart, and an event's predecessor within the gap lies in its own cell or
the one before, so linking a cell to its predecessor is one equality join.  The
links are then doubled until each cell points to the first cell of its session.
No stream is sorted or gathered in one task, however many events it has.

Defined results: a null or zero time is left out; times above ``MILLIS`` are
milliseconds and cut down to seconds; events equal in all but their own id and
arrival count once; a null or empty session id falls to the repo's stream
('legacy/' and the repo, '' for a null repo); a null kind counts as ''; equal
times are one point; an empty table gives no sessions; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import Cutter

#: Epoch times above this are milliseconds.
MILLIS = 100_000_000_000


def streams(events: DataFrame, once: bool = True) -> DataFrame:
    """(stream, at, repo, kind, detail): usable events with their stream and time in seconds, repeats ``once``."""
    at = F.when(F.col("ts") > MILLIS, F.floor(F.col("ts") / 1000)).otherwise(F.col("ts")).cast("long")
    stream = F.when(F.coalesce("session_id", F.lit("")) != "", F.col("session_id")).otherwise(F.concat(F.lit("legacy/"), F.coalesce("repo", F.lit(""))))
    e = events.where(F.col("ts") != 0).select("ts", "repo", "kind", "session_id", "detail")
    return (e.distinct() if once else e).select(stream.alias("stream"), at.alias("at"), "repo", "kind", "detail")


def _roots(cutter: Cutter, cells: DataFrame) -> DataFrame:
    """(stream, cell, root) of cells (stream, cell, lo, hi, linked)."""
    state = cutter.cut(cells.select("stream", "cell", (F.col("cell") - F.when(F.col("linked"), 1).otherwise(0)).alias("root"), (~F.col("linked")).alias("done")))
    while state.where(~F.col("done")).limit(1).count():
        t = state.select(F.col("stream").alias("t_stream"), F.col("cell").alias("t_cell"), F.col("root").alias("t_root"), F.col("done").alias("t_done"))
        moved = (
            state.where(~F.col("done"))
            .join(t, (F.col("stream") == F.col("t_stream")) & (F.col("root") == F.col("t_cell")))
            .select("stream", "cell", F.col("t_root").alias("root"), F.col("t_done").alias("done"))
        )
        after = cutter.cut(state.where("done").unionByName(moved))
        cutter.drop(state)
        state = after
    return state.select("stream", "cell", "root")


def sessions(events: DataFrame, gap: int = 1800, kinds: bool = True) -> DataFrame:
    """(stream, started_at, ended_at[, duration_s, n_events, n_repos_events, kinds]) with one row per session.

    ``kinds`` maps each kind to its count.  A cell's counts are made before the
    shuffle on (stream, cell); sessions add up cells.
    """
    cutter = Cutter(events.sparkSession, "sessions")
    # repeats move neither the first nor the last time of a cell
    e = streams(events, once=kinds).withColumn("cell", F.floor(F.col("at") / gap).cast("long"))
    keys = ["stream", "cell"]
    if kinds:
        by_kind = e.groupBy(*keys, F.coalesce("kind", F.lit("")).alias("kind")).agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count(F.lit(1)).alias("n"))
        cells = by_kind.groupBy(*keys).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"), F.collect_list(F.struct("kind", "n")).alias("by_kind"))
    else:
        cells = e.groupBy(*keys).agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    cells = cutter.cut(cells)
    before = cells.select("stream", (F.col("cell") + 1).alias("cell"), F.col("hi").alias("before"))
    linked = cells.join(before, keys, "left").withColumn("linked", F.coalesce(F.col("lo") - F.col("before") <= gap, F.lit(False)))
    at_root = cells.join(_roots(cutter, linked), keys)
    times = [F.min("lo").alias("started_at"), F.max("hi").alias("ended_at")]
    if not kinds:
        return at_root.groupBy("stream", "root").agg(*times).select("stream", "started_at", "ended_at")
    whole = at_root.groupBy("stream", "root").agg(*times, F.sum("n").alias("n_events"))
    named = (
        at_root.select("stream", "root", F.explode("by_kind").alias("k"))
        .groupBy("stream", "root", "k.kind")
        .agg(F.sum("k.n").alias("n"))
        .groupBy("stream", "root")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"))
    )
    return whole.join(named, ["stream", "root"]).select("stream", "started_at", "ended_at", (F.col("ended_at") - F.col("started_at")).alias("duration_s"), "n_events", "kinds")
