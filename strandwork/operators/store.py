"""Writing and changing stored frames: upserts, deletes, incremental checks, notes and exports.

Nothing is changed in place.  A change is a new frame that is written beside the old
one and swapped in, so a failed job leaves the old state whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import sanitize_id, slugify
from ..plans.bind import latest


def upsert(old: DataFrame, new: DataFrame, key: str, order: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per key, the last by ``order``; ``new`` wins ties, and columns of ``keep`` stay where the new row has none.

    A row of ``new`` that is older than the stored one changes nothing.
    """
    cols = old.columns
    both = old.withColumn("side", F.lit(0)).unionByName(new.withColumn("side", F.lit(1)), allowMissingColumns=True)
    last = latest(both, key, [order, "side"], [c for c in cols if c != key])
    if not keep:
        return last.select(*cols)
    held = old.groupBy(key).agg(*(F.max_by(c, order).alias(f"held_{c}") for c in keep))
    return last.join(held, key, "left").select(*(F.coalesce(c, f"held_{c}").alias(c) if c in keep else F.col(c) for c in cols))


def append_edges(edges: DataFrame, path: str) -> None:
    """Edges appended by relation, without dedup: a repeated edge is a repeated row."""
    edges.write.mode("append").partitionBy("rel").parquet(path)


def without_file(entities: DataFrame, edges: DataFrame, file_path: str, repo: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities outside a file, and edges with neither end in it."""
    gone = (F.col("file_path") == file_path) & (F.col("repo") == repo if repo is not None else F.lit(True))
    dead = entities.where(gone).select("id").distinct()
    kept = entities.where(~F.coalesce(gone, F.lit(False)))
    return kept, _without_ends(edges, dead)


def without_repo(entities: DataFrame, edges: DataFrame, repo: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Entities and edges without a repo's; tables of ``keep`` stay."""
    gone = F.coalesce(F.col("repo") == repo, F.lit(False)) & ~F.col("node_table").isin(*keep) if keep else F.coalesce(F.col("repo") == repo, F.lit(False))
    return entities.where(~gone), _without_ends(edges, entities.where(gone).select("id").distinct())


def _without_ends(edges: DataFrame, dead: DataFrame) -> DataFrame:
    return edges.join(dead.select(F.col("id").alias("src")), "src", "left_anti").join(dead.select(F.col("id").alias("dst")), "dst", "left_anti").select(*edges.columns)


def latest_hash(scans: DataFrame) -> DataFrame:
    """(repo, path, hash) of the latest scan of each path by ``indexed_at`` and then ``file_id``, so far as the scans have them; a null time is the earliest."""
    order = [c for c in ("indexed_at", "file_id") if c in scans.columns] or ["hash"]
    return scans.groupBy("repo", "path").agg(F.max_by(F.struct("hash"), F.struct(*order)).alias("r")).select("repo", "path", "r.hash")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repo, path, change) between two scans (repo, path, hash[, indexed_at, file_id]): added, changed, deleted; equal files give no row, a null hash is changed.

    Of several scans of a path the latest holds; scans without ``indexed_at`` have one row a path.
    """
    o, n = (latest_hash(x).select("repo", "path", F.col("hash").alias(f"{s}_hash"), F.lit(True).alias(f"{s}_there")) for x, s in ((old, "o"), (new, "n")))
    both = o.join(n, ["repo", "path"], "full")
    change = F.when(F.col("o_there").isNull(), "added").when(F.col("n_there").isNull(), "deleted").when(~F.coalesce(F.col("o_hash") == F.col("n_hash"), F.lit(False)), "changed")
    return both.select("repo", "path", change.alias("change")).where(F.col("change").isNotNull())


def store_indexed(items: DataFrame) -> DataFrame:
    """Stored texts with one row per source, the last stored."""
    return latest(items, "source", ["indexed_at", "item_id"], [c for c in items.columns if c != "source"])


def save_knowledge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries after saving ``new``: keyed by the title's slug, the new text, the earliest creation."""
    both = old.withColumn("side", F.lit(0)).unionByName(new.withColumn("side", F.lit(1)), allowMissingColumns=True).withColumn("id", slugify(F.col("title")))
    cols = [c for c in old.columns if c not in ("id", "created_at")]
    g = both.groupBy("id").agg(F.max_by(F.struct(*cols), F.struct("side", "updated_at")).alias("r"), F.min("created_at").alias("created_at"))
    return g.select("id", *(F.col(f"r.{c}").alias(c) for c in cols), "created_at").select(*old.columns)


def pin(entries: DataFrame, name: str, tier: int = 2, column: str = "name") -> DataFrame:
    """Entries whose name contains ``name`` raised to ``tier`` at least (a smaller number is higher)."""
    hit = F.lower(column).contains(name.lower())
    return entries.withColumn("tier", F.when(hit, F.least(F.coalesce("tier", F.lit(2)), F.lit(tier))).otherwise(F.col("tier")))


def add_tag(entries: DataFrame, ids: list[str], tag: str) -> DataFrame:
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    return entries.withColumn("tags", F.when(F.col("id").isin(*ids), F.array_union(tags, F.array(F.lit(tag)))).otherwise(F.col("tags")))


#: Relations that people may draw between entries.
RELATIONS = ("supports", "contradicts", "related_to", "solves_for", "decided_about")


def relate(spark: SparkSession, src: str, relation: str, dst: str, context: str = "") -> DataFrame:
    """A new edge; other relations than ``RELATIONS`` are an error."""
    if relation not in RELATIONS:
        raise ValueError(f"unknown relation {relation!r}")
    return spark.range(1).select(F.lit(relation).alias("rel"), F.lit(src).alias("src"), F.lit(dst).alias("dst"), F.lit(context).alias("context"))


def with_ids(entities: DataFrame) -> DataFrame:
    """Parsed entities with their record ids."""
    return entities.withColumn("id", F.concat(F.col("node_table"), F.lit(":"), sanitize_id(F.col("qualified_name"))))


def notes(functions: DataFrame, calls: DataFrame, k: int = 50) -> DataFrame:
    """(file, text): an index and one note for each of the k most connected functions, with links to its callees among them."""
    e = calls.select("src", "dst").distinct()
    degree = e.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    top = degree.join(functions.select("id", "name", "file_path"), "id").orderBy(F.desc("n"), "id").limit(k)
    out = e.join(top.select(F.col("id").alias("src")), "src", "left_semi").join(top.select(F.col("id").alias("dst"), F.col("name").alias("callee")), "dst").groupBy(F.col("src").alias("id")).agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("- [["), "callee", F.lit("]]")))), "\n").alias("links"))
    note = F.concat(F.lit("# "), "name", F.lit("\n\n"), "file_path", F.lit("\n\n## Calls\n"), F.coalesce("links", F.lit("none")), F.lit("\n"))
    files = top.join(out, "id", "left").select(F.concat("name", F.lit(".md")).alias("file"), note.alias("text"))
    index = top.agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("- [["), "name", F.lit("]]")))), "\n").alias("x")).select(F.lit("index.md").alias("file"), F.concat(F.lit("# Index\n\n"), "x", F.lit("\n")).alias("text"))
    return files.unionByName(index)


def segment_notes(segments: DataFrame) -> DataFrame:
    """(file, text): a note per segment of a conversation and an index per kind."""
    slug = slugify(F.col("name"))
    each = segments.select(F.concat("kind", F.lit("/"), slug, F.lit(".md")).alias("file"), F.concat(F.lit("---\ntype: "), "kind", F.lit("\n---\n# "), "name", F.lit("\n\n"), "body", F.lit("\n")).alias("text"))
    each = each.groupBy("file").agg(F.min("text").alias("text"))
    index = segments.select("kind", slug.alias("slug")).distinct().groupBy("kind").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- [["), "slug", F.lit("]]")))), "\n").alias("x"))
    return each.unionByName(index.select(F.concat("kind", F.lit("/index.md")).alias("file"), F.concat(F.lit("---\ntype: moc\n---\n"), "x", F.lit("\n")).alias("text")))


def context_summary(entries: DataFrame, sessions: int | Column = 0, decisions: int = 15, others: int = 5) -> DataFrame:
    """(section, id, title): the newest decisions, problems and solutions that a context file lists."""
    parts = [entries.where(F.col("kind") == kind).select(F.lit(kind).alias("section"), "id", "title", "created_at").orderBy(F.desc_nulls_last("created_at"), "id").limit(n).drop("created_at") for kind, n in (("decision", decisions), ("problem", others), ("solution", others))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def summary_counts(entries: DataFrame, solves: DataFrame, sessions: DataFrame) -> DataFrame:
    """(fact, n): entries of each kind, problems that nothing solves, and sessions, which a context file states beside its lists."""
    kinds = entries.where(F.col("kind").isNotNull()).groupBy(F.col("kind").alias("fact")).agg(F.count(F.lit(1)).alias("n"))
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("fact"), "n")
    return kinds.unionByName(one("open problems", open_problems(entries, solves))).unionByName(one("sessions", sessions))


def open_problems(entries: DataFrame, solves: DataFrame) -> DataFrame:
    """Problems that nothing solves; ``solves`` has their ids as dst."""
    return entries.where(F.col("kind") == "problem").join(solves.select(F.col("dst").alias("id")), "id", "left_anti").select("id", "title")


def write_notes(files: DataFrame, folder: str) -> None:
    """Notes as text files, one folder per note."""
    files.select("text", "file").write.mode("overwrite").partitionBy("file").text(folder)


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, change, line): lines added to and removed from each key's text between two snapshots (key, text); unchanged keys give one row 'unchanged'."""
    lines = lambda df, s: df.select("key", F.explode(F.split("text", "\n")).alias("line")).groupBy("key", "line").agg(F.count(F.lit(1)).alias(s))
    both = lines(old, "o").join(lines(new, "n"), ["key", "line"], "full").select("key", "line", (F.coalesce("n", F.lit(0).cast("long")) - F.coalesce("o", F.lit(0).cast("long"))).alias("d"))
    moved = both.where(F.col("d") != 0)
    same = both.groupBy("key").agg(F.max(F.abs("d")).alias("m")).where(F.col("m") == 0).select("key", F.lit("unchanged").alias("change"), F.lit(None).cast("string").alias("line"))
    return moved.select("key", F.when(F.col("d") > 0, "added").otherwise("removed").alias("change"), "line").unionByName(same)


def swap(df: DataFrame, path: str) -> None:
    """Write ``df`` as the new content of ``path``: beside it first, then renamed, so readers never see half of it."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fresh, old = f"{path}.new-{uuid.uuid4().hex[:8]}", f"{path}.old-{uuid.uuid4().hex[:8]}"
    df.write.parquet(fresh)
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(conf)
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    fs.rename(at(fresh), at(path))
    if fs.exists(at(old)):
        fs.delete(at(old), True)


def with_codes(vectors: DataFrame, column: str = "embedding", code: str = "bits") -> DataFrame:
    """Vectors with the binary code filled in where it is missing."""
    from .vectors import bits

    have = F.col(code) if code in vectors.columns else F.lit(None).cast("array<long>")
    return vectors.withColumn(code, F.coalesce(have, bits(F.col(column))))


def purge(items: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored texts without those of ``sources(source)``, and how many went."""
    s = sources.select("source").distinct()
    return items.join(s, "source", "left_anti").select(*items.columns), items.join(s, "source", "left_semi").agg(F.count(F.lit(1)).alias("purged"))


def without_deleted(entities: DataFrame, edges: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and edges without files that ``changes`` calls deleted."""
    gone = changed.where(F.col("change") == "deleted").select("repo", F.col("path").alias("file_path"))
    dead = entities.join(gone, ["repo", "file_path"], "left_semi").select("id").distinct()
    return entities.join(gone, ["repo", "file_path"], "left_anti").select(*entities.columns), _without_ends(edges, dead)
