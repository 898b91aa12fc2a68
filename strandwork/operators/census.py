"""Counts, rankings and lint predicates over symbols and calls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.bind import size_of

# Names that are never reported as unused, and patterns of names and signatures that are never dead code.
UNUSED_NAMES = ("main", "new", "init", "setup", "default", "from", "into", "drop", "clone", "fmt", "serialize", "deserialize")
UNUSED_PREFIXES = ("test_", "Test", "Execute", "override")
ALIVE_NAME = "^main$|^test|_test$|handler|^(new|default|from|into|drop|fmt|serialize|deserialize)$|^Execute|^On[A-Z]|^Handle[A-Z]|Async$"
ALIVE_SIGNATURE = "override|virtual|abstract|@Override"


def _n() -> Column:
    return F.count(F.lit(1))


def stats(entities: DataFrame) -> DataFrame:
    return entities.groupBy("node_table").agg(_n().alias("n"))


def relation_stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("rel").agg(_n().alias("n"))


def degrees(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) of every function, over distinct calls."""
    e = calls.select("src", "dst").distinct()
    i = e.groupBy(F.col("dst").alias("id")).agg(_n().alias("in_degree"))
    o = e.groupBy(F.col("src").alias("id")).agg(_n().alias("out_degree"))
    zero = F.lit(0).cast("long")
    return functions.select("id").join(i, "id", "left").join(o, "id", "left").select("id", F.coalesce("in_degree", zero).alias("in_degree"), F.coalesce("out_degree", zero).alias("out_degree"))


def fan(functions: DataFrame, calls: DataFrame, end: str = "dst", k: int = 10, among: Callable[[list[str]], DataFrame] | None = None) -> DataFrame:
    """The k functions with the most calls in (end 'dst') or out ('src').

    ``among`` gives the functions of some ids: the ``SPARE`` x k most called ids are looked up
    first, and all functions are joined only if fewer than k of them are functions.
    """
    n = calls.groupBy(F.col(end).alias("id")).agg(_n().alias("n"))
    if among is not None:
        top = n.orderBy(F.desc("n"), "id").limit(SPARE * k).collect()
        found = among([r["id"] for r in top]).select("id", "name", "file_path").collect() if top else []
        if len(found) >= k or len(top) < SPARE * k:
            count = {r["id"]: r["n"] for r in top}
            rows = sorted(((r["id"], count[r["id"]], r["name"], r["file_path"]) for r in found), key=lambda r: (-r[1], r[0]))[:k]
            return calls.sparkSession.createDataFrame(rows, "id string, n long, name string, file_path string")
    return n.join(functions.select("id", "name", "file_path"), "id").orderBy(F.desc("n"), "id").limit(k)


#: Ids that ``fan`` looks up for each one that is asked for.
SPARE = 4


def dense_files(functions: DataFrame, k: int = 30) -> DataFrame:
    return functions.groupBy("repo", "file_path").agg(_n().alias("n_functions")).orderBy(F.desc("n_functions"), "repo", "file_path").limit(k)


def clusters(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(repo, file_path, calls_out, calls_in, total): the sum of degrees of a file's functions."""
    d = degrees(functions, calls).join(functions.select("id", "repo", "file_path"), "id")
    out = d.groupBy("repo", "file_path").agg(F.sum("out_degree").alias("calls_out"), F.sum("in_degree").alias("calls_in"))
    return out.withColumn("total", F.col("calls_out") + F.col("calls_in"))


def bridges(functions: DataFrame, calls: DataFrame, k: int = 20) -> DataFrame:
    """Functions by callers x callees, where both are there."""
    d = degrees(functions, calls).withColumn("score", F.col("in_degree") * F.col("out_degree")).where(F.col("score") > 0)
    return d.orderBy(F.desc("score"), "id").limit(k)


def central(functions: DataFrame, calls: DataFrame) -> DataFrame:
    return degrees(functions, calls).join(functions.select("id", "name"), "id").select("id", "name", "in_degree")


def duplicates(functions: DataFrame, k: int | None = 20) -> DataFrame:
    """(body_hash, n, n_names, first_id): bodies that several functions share; ``duplicate_members`` lists who."""
    g = functions.where(F.col("body_hash").isNotNull()).groupBy("body_hash").agg(_n().alias("n"), F.countDistinct("name").alias("n_names"), F.min("id").alias("first_id")).where(F.col("n") > 1)
    return g.orderBy(F.desc("n"), "body_hash").limit(k) if k is not None else g


def duplicate_members(functions: DataFrame) -> DataFrame:
    """(body_hash, id, name, file_path): the functions whose body others share, a row each, so a body of very many is no list."""
    f = functions.where(F.col("body_hash").isNotNull())
    return f.join(duplicates(f, None).select("body_hash"), "body_hash", "left_semi").select("body_hash", "id", "name", "file_path")


def unused_symbols(functions: DataFrame, calls: DataFrame, min_lines: int = 1) -> DataFrame:
    """Functions whose name nothing calls, without entry points; keyed by name within a repo."""
    f = functions.where(F.col("name").isNotNull())
    called = calls.select("dst").distinct().join(f.select(F.col("id").alias("dst"), "repo", "name"), "dst").select("repo", "name").distinct()
    ok = ~F.col("name").isin(*UNUSED_NAMES)
    for p in UNUSED_PREFIXES:
        ok &= ~F.col("name").startswith(p)
    lines = F.col("end_line") - F.col("start_line")
    return f.where(ok & (lines > 0) & (lines >= min_lines)).join(called, ["repo", "name"], "left_anti").select("id", "name", "file_path", lines.alias("size"))


def dead_code(functions: DataFrame, calls: DataFrame, min_lines: int = 3) -> DataFrame:
    """Functions that nothing calls by id, without names and signatures that are called from outside."""
    size = size_of()
    ok = ~F.coalesce("name", F.lit("")).rlike(ALIVE_NAME) & ~F.coalesce("signature", F.lit("")).rlike(ALIVE_SIGNATURE)
    f = functions.where(ok & (F.col("end_line") > F.col("start_line")) & (size >= min_lines))
    return f.join(calls.select(F.col("dst").alias("id")), "id", "left_anti").select("id", "name", "file_path", size.alias("size"))


def smells(functions: DataFrame, calls: DataFrame, lines: int = 40, fan_limit: int = 8, file_limit: int = 12) -> DataFrame:
    """(smell, subject, measure): long functions, much-called and much-calling ones, dense files, shared bodies."""
    long = functions.where(size_of() > lines).select(F.lit("god_function").alias("smell"), F.col("id").alias("subject"), size_of().cast("long").alias("measure"))
    d = degrees(functions, calls)
    i = d.where(F.col("in_degree") > fan_limit).select(F.lit("fan_in").alias("smell"), F.col("id").alias("subject"), F.col("in_degree").alias("measure"))
    o = d.where(F.col("out_degree") > fan_limit).select(F.lit("fan_out").alias("smell"), F.col("id").alias("subject"), F.col("out_degree").alias("measure"))
    dense = functions.groupBy("repo", "file_path").agg(_n().alias("measure")).where(F.col("measure") > file_limit).select(F.lit("dense_file").alias("smell"), F.concat_ws(":", "repo", "file_path").alias("subject"), "measure")
    dup = duplicates(functions, None).select(F.lit("duplicate_body").alias("smell"), F.col("body_hash").alias("subject"), F.col("n").alias("measure"))
    return long.unionByName(i).unionByName(o).unionByName(dense).unionByName(dup)


def language(col: str = "language") -> Column:
    """A language name without case, outer space and the common abbreviations."""
    low = F.lower(F.trim(col))
    short = {"py": "python", "rs": "rust", "ts": "typescript", "js": "javascript", "rb": "ruby", "cu": "cuda", "golang": "go", "cs": "csharp"}
    named = F.create_map(*(F.lit(x) for kv in short.items() for x in kv))
    return F.coalesce(F.try_element_at(named, low), low, F.lit("unknown"))


def naming(functions: DataFrame) -> DataFrame:
    """(language, snake, camel, pascal, n, snake_pct): naming styles; _ is snake, else the case of the first letter decides."""
    f = functions.where(F.col("name") != "")
    first = F.substring("name", 1, 1)
    style = F.when(F.col("name").contains("_"), "snake").when(F.lower(first) == first, "camel").otherwise("pascal")
    one = lambda s: F.sum(F.when(style == s, 1).otherwise(0)).alias(s)
    g = f.groupBy(language().alias("language")).agg(one("snake"), one("camel"), one("pascal"), _n().alias("n"))
    return g.withColumn("snake_pct", F.floor(F.col("snake") * 100 / F.col("n")).cast("int"))


def naming_strict(functions: DataFrame) -> DataFrame:
    """(convention, n): snake needs _ and no capital, camel an inner capital after a small letter, pascal a capital first; plain words count for none."""
    name = F.col("name")
    style = F.when(name.contains("_") & (F.lower("name") == name), "snake").when(name.rlike("^[a-z].*[A-Z]"), "camel").when(name.rlike("^[A-Z]"), "pascal").otherwise("none")
    return functions.where(name != "").groupBy(style.alias("convention")).agg(_n().alias("n"))


def import_styles(entities: DataFrame) -> DataFrame:
    """(style, n): import statements by form, the first of from, require, use, import."""
    b = F.trim("body")
    style = F.when(b.contains("from "), "from").when(b.contains("require("), "require").when(b.startswith("use "), "use").when(b.contains("import"), "import").otherwise("other")
    return entities.where((F.col("node_table") == "import_decl") & F.col("body").isNotNull()).groupBy(style.alias("style")).agg(_n().alias("n"))


def languages(files: DataFrame, functions: DataFrame) -> DataFrame:
    """(language, files, functions, avg_size, max_size)."""
    a = files.groupBy(language().alias("language")).agg(_n().alias("files"))
    b = functions.groupBy(language().alias("language")).agg(_n().alias("functions"), F.round(F.avg(size_of()), 4).alias("avg_size"), F.max(size_of()).alias("max_size"))
    return a.join(b, "language", "full").select("language", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("files", "functions")), "avg_size", "max_size")


def directories(files: DataFrame) -> DataFrame:
    return files.groupBy("repo", F.split_part("path", F.lit("/"), F.lit(1)).alias("directory")).agg(_n().alias("files"))


def profile(files: DataFrame, functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(repo, files, functions, calls, architecture, main_language) of every repo; the first rule whose folder is there names the architecture."""
    has = lambda rx: F.max(F.when(F.col("path").rlike(rx), 1).otherwise(0))
    flags = files.groupBy("repo").agg(
        _n().alias("files"), has("(^|/)crates/").alias("crates"), has("(^|/)services/").alias("services"), has("(^|/)components/").alias("components"), has("^lib/").alias("lib"), has("(^|/)models?/").alias("models"), has("(^|/)handlers?/").alias("handlers")
    )
    rule = F.lit("Standard")
    for cond, label in reversed(((F.col("crates") > 0, "Workspace"), (F.col("services") > 0, "Services"), (F.col("components") > 0, "Components"), (F.col("lib") > 0, "Library"), ((F.col("models") > 0) & (F.col("handlers") > 0), "MVC"), (F.col("handlers") > 0, "Handlers"))):
        rule = F.when(cond, label).otherwise(rule)
    by_lang = files.where(F.col("repo").isNotNull()).groupBy("repo", language().alias("language")).agg(_n().alias("n")).groupBy("repo").agg(F.max(F.struct("n", "language")).alias("m"))
    f = functions.groupBy("repo").agg(_n().alias("functions"))
    c = calls.join(functions.select(F.col("id").alias("src"), "repo"), "src").groupBy("repo").agg(_n().alias("calls"))
    zero = F.lit(0).cast("long")
    out = flags.join(f, "repo", "left").join(c, "repo", "left").join(by_lang, "repo", "left")
    return out.select("repo", "files", F.coalesce("functions", zero).alias("functions"), F.coalesce("calls", zero).alias("calls"), rule.alias("architecture"), F.col("m.language").alias("main_language"))


def edit_preflight(functions: DataFrame, file_lines: int = 500) -> DataFrame:
    """(repo, file_path, n, snake_ratio, advice, long_file): what a new function's name in a file should look like."""
    g = functions.where(F.col("name") != "").groupBy("repo", "file_path").agg(_n().alias("n"), F.sum(F.col("name").contains("_").cast("int")).alias("snake"), F.max("end_line").alias("last"))
    ratio = F.col("snake") / F.col("n")
    advice = F.when(ratio > 0.7, "snake_case").when(ratio < 0.3, "camelCase").otherwise("mixed")
    return g.select("repo", "file_path", "n", F.round(ratio, 6).alias("snake_ratio"), advice.alias("advice"), F.coalesce(F.col("last") > file_lines, F.lit(False)).alias("long_file"))


def insights(functions: DataFrame, calls: DataFrame, files: DataFrame) -> DataFrame:
    """(insight, subject, n): after indexing, the longest functions, dead ones of ten lines or more, the densest files, the languages."""
    longest = functions.where(size_of() > 50).select(F.lit("longest").alias("insight"), F.col("id").alias("subject"), size_of().cast("long").alias("n"))
    dead = dead_code(functions, calls, 10).select(F.lit("dead").alias("insight"), F.col("id").alias("subject"), F.col("size").cast("long").alias("n"))
    dense = dense_files(functions, 3).select(F.lit("dense").alias("insight"), F.concat_ws(":", "repo", "file_path").alias("subject"), F.col("n_functions").alias("n"))
    lang = files.groupBy(language().alias("subject")).agg(_n().alias("n")).select(F.lit("language").alias("insight"), "subject", "n")
    return longest.unionByName(dead).unionByName(dense).unionByName(lang)
