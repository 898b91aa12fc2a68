"""Commits, file changes and line ranges: churn, coupling, expertise, hotspots, overlaps, as-of joins.

``changes`` is (commit, path), one row per file of a commit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.bind import size_of
from .graph import first_per


def distinct_changes(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("commit").isNotNull() & F.col("path").isNotNull()).select("commit", "path").distinct()


def file_churn(changes: DataFrame) -> DataFrame:
    return distinct_changes(changes).groupBy("path").agg(F.count(F.lit(1)).alias("commits"))


#: Files of a commit up to which its pairs are made from one array.
SMALL_COMMIT = 500


def coupling(changes: DataFrame, most_files: int | None = None) -> DataFrame:
    """(a, b, n), a before b: files changed in one commit, by in how many.

    The pairs of a commit are the result. Those of small commits are made from one array
    each; larger commits join their rows, so none is gathered in one task. ``most_files``
    leaves out mass changes where the caller wants that.
    """
    c = distinct_changes(changes)
    n = c.groupBy("commit").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    n = n.where(F.col("n") <= most_files) if most_files is not None else n
    sized = c.join(n, "commit")
    files = sized.where(F.col("n") <= SMALL_COMMIT).groupBy("commit").agg(F.array_sort(F.collect_list("path")).alias("files"))
    pairs = files.select(F.posexplode("files").alias("i", "a"), "files").select("a", F.explode(F.expr("slice(files, i + 2, size(files))")).alias("b"))
    big = sized.where(F.col("n") > SMALL_COMMIT)
    mass = big.select("commit", F.col("path").alias("a")).join(big.select("commit", F.col("path").alias("b")), "commit").where(F.col("a") < F.col("b")).select("a", "b")
    return pairs.unionByName(mass).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def contributors(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """(author, path, n): in how many commits an author changed a file."""
    return distinct_changes(changes).join(commits.select("commit", "author"), "commit").groupBy("author", "path").agg(F.count(F.lit(1)).alias("n"))


def top_contributors(commits: DataFrame, changes: DataFrame, k: int = 10) -> DataFrame:
    return first_per(contributors(commits, changes), ["path"], [F.desc("n"), F.col("author")], k)


def reviewers(commits: DataFrame, changes: DataFrame, changed: list[str], k: int = 5) -> DataFrame:
    """The k authors with the most commits to files that contain a changed path or are contained in one."""
    near = F.lit(False)
    for p in changed:
        near = near | F.col("path").contains(p) | F.lit(p).contains(F.col("path"))
    return contributors(commits, changes.where(near)).groupBy("author").agg(F.sum("n").alias("score")).orderBy(F.desc("score"), "author").limit(k)


def hotspots(functions: DataFrame, changes: DataFrame, k: int | None = 30, min_score: int = 0) -> DataFrame:
    """Functions by size x commits that touched their file; ``functions`` is (id, name, path, start_line, end_line)."""
    f = functions.select("id", "name", "path", size_of().alias("size"))
    risk = f.join(file_churn(changes).withColumnRenamed("commits", "churn"), "path", "left").withColumn("churn", F.coalesce("churn", F.lit(0).cast("long")))
    out = risk.withColumn("risk", F.col("size") * F.col("churn")).where(F.col("risk") >= min_score).select("id", "name", "path", "size", "churn", "risk")
    return out.orderBy(F.desc_nulls_last("risk"), "id").limit(k) if k is not None else out


def evolution(commits: DataFrame, changes: DataFrame, part: str) -> DataFrame:
    """Commits of files whose path contains ``part``."""
    return distinct_changes(changes).where(F.col("path").contains(part)).join(commits.select("commit", "author", "ts"), "commit").select("path", "commit", "author", "ts")


def match_files(files: DataFrame, changes: DataFrame) -> DataFrame:
    """(commit, file_id): each changed path with the first stored file, by id, whose path ends in it at a segment.

    A stored path offers each of its ends, so the sides meet on equal texts, and a name that very many files have is one row an end.
    """
    c = changes.where(F.col("path").isNotNull()).select("commit", "path").distinct()
    parts = F.split("path", "/")
    ends = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/")))
    f = files.where(F.col("path").isNotNull()).select("file_id", ends.alias("path")).groupBy("path").agg(F.min("file_id").alias("file_id"))
    return c.join(f, "path").select("commit", "file_id")


def overlaps(hunks: DataFrame, symbols: DataFrame, width: int = 64) -> DataFrame:
    """(hunk, id): hunks and symbols of a file whose line ranges overlap.

    ``hunks`` is (hunk, path, first, last), ``symbols`` (id, path, start_line, end_line).
    Ranges are cut into bins of ``width`` lines; the sides meet on file and bin, and a pair
    counts in the bin where its overlap starts, so none comes twice.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor(b / width)))
    h = hunks.where(F.col("first") <= F.col("last")).select("hunk", "path", "first", "last", bins(F.col("first"), F.col("last")).alias("bin"))
    s = symbols.where(F.col("start_line") <= F.col("end_line")).select("id", "path", "start_line", "end_line", bins(F.col("start_line"), F.col("end_line")).alias("bin"))
    both = h.join(s, ["path", "bin"]).where((F.col("first") <= F.col("end_line")) & (F.col("last") >= F.col("start_line")))
    return both.where(F.floor(F.greatest("first", "start_line") / width) == F.col("bin")).select("hunk", "id")


def callers_of_changed(changed: DataFrame, functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(repo, path, id, caller, tested): who calls the functions of changed files (repo, path), and whether the caller is a test by its path."""
    f = functions.select("id", "repo", "file_path")
    own = f.join(changed.select("repo", F.col("path").alias("file_path")).distinct(), ["repo", "file_path"], "left_semi").select(F.col("id").alias("dst"), "repo", F.col("file_path").alias("path"))
    far = f.select(F.col("id").alias("src"), F.col("file_path").rlike(r"(^|[/_.])(tests?|spec)([/_.]|$)").alias("tested"))
    return calls.select("src", "dst").distinct().join(own, "dst").join(far, "src").select("repo", "path", F.col("dst").alias("id"), F.col("src").alias("caller"), "tested")


def symbol_at(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """(point, id): for a name at a line, the symbol of that name whose range holds the line (the first by id), else the first of the name.

    ``points`` is (point, name, path, line).
    """
    both = points.join(symbols.select("id", "name", F.col("path").alias("s_path"), "start_line", "end_line"), "name")
    inside = (F.col("path") == F.col("s_path")) & F.col("line").between(F.col("start_line"), F.col("end_line"))
    return both.groupBy("point").agg(F.min(F.struct(F.when(inside, 0).otherwise(1).alias("far"), "id")).alias("best")).select("point", "best.id", (F.col("best.far") == 0).alias("inside"))


def last_before(rows: DataFrame, key: str, order: str, is_left: str, is_right: str) -> DataFrame:
    """As-of join: each row flagged ``is_left`` of a key with the ``order`` of the last one flagged ``is_right`` before it.

    A key's rows are cut into slices of ``SLICE`` of a whole-numbered ``order``.  Windows run
    within slices; what a slice takes from those before it is the last right row of any of
    them, found over one row a slice, so a key of very many rows is no single task's sort.
    """
    r = rows.select(key, order, is_left, is_right, F.floor(F.col(order) / SLICE).alias("slice"))
    inside = Window.partitionBy(key, "slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    near = r.withColumn("near", F.last(F.when(F.col(is_right), F.col(order)), ignorenulls=True).over(inside)).where(F.col(is_left))
    last = r.groupBy(key, "slice").agg(F.max(F.when(F.col(is_right), F.col(order))).alias("last"))
    far = last.withColumn("far", F.last("last", ignorenulls=True).over(Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))).select(key, "slice", "far")
    return near.join(far, [key, "slice"]).select(key, order, F.coalesce("near", "far").alias("before"))


#: The stretch of ``order`` that one slice of a key spans.
SLICE = 100_000
