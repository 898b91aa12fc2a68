"""Knowledge entries: scoped search, lint, arcs, patterns, word bags, duplicates, proposals, tag suggestions.

An entry is (id, title, content, kind, repo, confidence, tags, created_at, updated_at).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import file_scope
from ..plans.cut import Cutter, broadcast_if_small
from . import blocks
from .graph import first_per

#: The repo of shared entries.
GLOBAL = "_global"
# Words that say nothing, and forms of tags that describe state instead of a topic.
STOP = ("the", "and", "for", "with", "that", "this", "from", "have", "has", "was", "were", "but", "not", "all", "any", "are", "can", "out", "our", "new", "one", "two", "into", "over", "just", "when", "then", "what", "your", "you", "use", "used", "uses", "via", "also")
META_TAG = "^(v[0-9]|status:|shipped:|session|phase-|bug:)"


def search(entries: DataFrame, query: str, repo: str | None = None, scope: str = "project", kind: str | None = None, limit: int | None = 50) -> DataFrame:
    """Entries that contain the query in title or text or have it as a tag.

    Scope project looks in ``repo``, global in the shared ones, both in either with one
    entry per title, the project's first; an unknown scope is project.  Newest first.
    """
    q = query.lower()
    hit = F.lower("title").contains(q) | F.lower("content").contains(q) | F.coalesce(F.array_contains("tags", query), F.lit(False))
    own, shared = F.col("repo") == repo if repo is not None else F.lit(True), F.col("repo") == GLOBAL
    place = {"global": shared, "both": own | shared}.get(scope, own)
    rows = entries.where(hit & place)
    rows = rows.where(F.col("kind") == kind) if kind else rows
    if scope == "both":
        rows = first_per(rows.select("id", "title", "kind", "repo", "updated_at"), ["title"], [F.when(F.col("repo") == GLOBAL, 1).otherwise(0), F.desc_nulls_last("updated_at"), F.col("id")], 1)
    rows = rows.select("id", "title", "kind", "repo", "updated_at")
    return rows.orderBy(F.desc_nulls_last("updated_at"), "id").limit(limit) if limit is not None else rows


def memories(entries: DataFrame, query: str, kinds: tuple[str, ...] = ("decision", "problem", "solution", "note"), per_kind: int = 25, limit: int = 50) -> DataFrame:
    """The newest hits of each kind by title or text, then the newest of all."""
    q = query.lower()
    hit = entries.where(F.col("kind").isin(*kinds) & (F.lower("title").contains(q) | F.lower("content").contains(q))).select("id", "kind", "title", "created_at")
    near = first_per(hit, ["kind"], [F.desc_nulls_last("created_at"), F.col("id")], per_kind)
    return near.orderBy(F.desc_nulls_last("created_at"), "id").limit(limit)


def timeline(entries: DataFrame, text: str) -> DataFrame:
    """Entries whose text contains ``text``, with case."""
    return entries.where(F.col("content").contains(text)).select("kind", "id", "title", "created_at")


def decisions(entries: DataFrame, limit: int = 50) -> DataFrame:
    """The newest decisions."""
    return entries.where(F.col("kind") == "decision").select("id", "title", "created_at").orderBy(F.desc_nulls_last("created_at"), "id").limit(limit)


def decision(entries: DataFrame, part: str) -> DataFrame:
    """The first decision, by id, whose title contains ``part`` without case, with its text."""
    return entries.where((F.col("kind") == "decision") & F.lower("title").contains(part.lower())).select("id", "title", "content", "created_at").orderBy("id").limit(1)


def lint(entries: DataFrame, links: DataFrame) -> DataFrame:
    """(section, key, n): counts by kind, entries without a link of either direction in ``links(src, dst)``, contradictions, low confidence."""
    ends = links.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    kinds = entries.groupBy(F.coalesce("kind", F.lit("")).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("kind").alias("section"), "key", "n")
    one = lambda s, df: df.select(F.lit(s).alias("section"), F.col("id").cast("string").alias("key"), F.lit(1).cast("long").alias("n"))
    orphans = one("orphan", entries.join(ends, "id", "left_anti"))
    return kinds.unionByName(orphans).unionByName(one("contradiction", entries.where(F.col("kind") == "contradiction"))).unionByName(one("low_confidence", entries.where(F.col("confidence") == "low")))


def topical(entries: DataFrame, *cols: str) -> DataFrame:
    """Entries exploded to their topical tags."""
    return entries.select(*cols, F.explode(F.array_distinct("tags")).alias("tag")).where(F.col("tag").isNotNull() & (F.col("tag") != "") & ~F.lower("tag").rlike(META_TAG))


def arcs(entries: DataFrame, least: int = 2) -> DataFrame:
    """(tag, title, n, first_at, last_at, kinds): topics with several entries over time."""
    g = topical(entries, "kind", "created_at").groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    return g.where(F.col("n") >= least).withColumn("title", humanise(F.col("tag")))


def humanise(tag: Column) -> Column:
    """A tag as a title: separators to spaces, the first letter in upper case and nothing else changed."""
    t = F.translate(tag, "-_", "  ")
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30))


def patterns(entries: DataFrame, newest: int | None = None, least: int = 2) -> DataFrame:
    """(tag, n_repos, total, example): topics that occur in several repos, with the title of the newest entry."""
    e = entries.where(F.col("repo").isNotNull())
    e = first_per(e.select("id", "title", "repo", "tags", "created_at"), ["repo"], [F.desc_nulls_last("created_at"), F.col("id")], newest) if newest is not None else e
    per = topical(e, "repo", "title", "created_at", "id").groupBy("tag", "repo").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("created_at", "id", "title")).alias("m"))
    g = per.groupBy("tag").agg(F.count(F.lit(1)).alias("n_repos"), F.sum("n").alias("total"), F.max("m").alias("m"))
    return g.where(F.col("n_repos") >= least).select("tag", "n_repos", "total", F.col("m.title").alias("example"))


def words(text: Column) -> Column:
    """Distinct meaningful words: ASCII letters and digits, lower case, three or more, no stop words, in order."""
    runs = F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+")
    return F.array_distinct(F.filter(runs, lambda w: (F.length(w) >= 3) & ~w.isin(*STOP)))


def bags(entries: DataFrame, *cols: str, prefix: int | None = None) -> DataFrame:
    """Entries with ``bag``, the words of title and text (the first ``prefix`` characters of the text where asked)."""
    text = F.coalesce("content", F.lit(""))
    text = F.substring(text, 1, prefix) if prefix is not None else text
    return entries.select("id", *cols, F.sort_array(words(F.concat_ws(" ", F.coalesce("title", F.lit("")), text))).alias("bag"))


def numbered(bagged: DataFrame, *cols: str) -> DataFrame:
    """cls, a hash of 128 bits of the bag, and words, a hash of 64 bits for each word; a filter on words here would make the bags twice."""
    return bagged.select(*cols, F.unhex(F.md5(F.array_join("bag", " "))).alias("cls"), F.transform("bag", lambda w: F.xxhash64(w)).alias("words"))


def similar(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score) of ``classes(g, cls, words, key)``, which are written, of one g with a Jaccard similarity of at least ``threshold``, both directions.

    All classes whose sizes allow it meet in blocks, where signatures of ``blocks.PARITY`` bits
    drop nearly all pairs; each of the others is verified in whole.
    """
    cutter = Cutter(classes.sparkSession, "similar")
    # pairs are made of numbers, not of names
    c = classes.select("g", "cls", "words", "key")
    signed = blocks.parities(c, *blocks.balance(c), "key", "g")
    cand = cutter.cut(blocks.parity_pairs(blocks.cells(cutter, signed, threshold, 4, blocks.SIGNED), threshold))
    some = cand.select("a").union(cand.select("b")).distinct()
    some = cutter.cut(c.join(broadcast_if_small(some, 16), F.col("key") == F.col("a"), "left_semi"))
    both = cand.join(some.select(F.col("key").alias("a"), F.col("cls").alias("x"), F.col("words").alias("xw")), "a").join(some.select(F.col("key").alias("b"), F.col("cls").alias("y"), F.col("words").alias("yw")), "b")
    inter = F.size(F.array_intersect("xw", "yw"))
    score = inter / (F.size("xw") + F.size("yw") - inter)
    hits = cutter.only(both.select("x", "y", score.alias("score")).where(F.col("score") >= threshold))
    return hits.select(F.col("x").alias("a"), F.col("y").alias("b"), "score").unionByName(hits.select(F.col("y").alias("a"), F.col("x").alias("b"), "score"))


def duplicate_of(entries: DataFrame, threshold: float = 0.7, prefix: int | None = None) -> DataFrame:
    """(id, duplicate_of, n_links): the earliest entry as similar as that before each, and to how many other texts its own is linked.

    Entries of one bag are one class; only classes are joined.
    """
    cutter = Cutter(entries.sparkSession, "earlier")
    return _earlier(cutter.cut(numbered(bags(entries, prefix=prefix), "id", F.lit("").alias("g"))), threshold)


def _earlier(rows: DataFrame, threshold: float) -> DataFrame:
    """``duplicate_of`` among entries (id, g, cls, words), which are written, of one g; those without words are left out."""
    cutter = Cutter(rows.sparkSession, "earlier")
    cls = cutter.cut(rows.groupBy("g", "cls").agg(F.first("words").alias("words"), F.min("id").alias("least")).where(F.size("words") > 0).withColumn("key", F.monotonically_increasing_id()))
    links = similar(cls.select(F.col("g"), F.concat(F.encode("g", "UTF-8"), F.col("cls")).alias("cls"), "words", "key"), threshold)
    name = F.concat(F.encode("g", "UTF-8"), F.col("cls"))
    links = links.join(cls.select(name.alias("b"), F.col("least").alias("b_least")), "b")
    per = links.groupBy(F.col("a").alias("name")).agg(F.min("b_least").alias("other"), F.count(F.lit(1)).alias("n_links"))
    first = cls.select("g", "cls", "least", name.alias("name")).join(per, "name", "left").select("g", "cls", F.least("least", "other").alias("first"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    out = rows.select("id", "g", "cls").join(first, ["g", "cls"])
    return cutter.only(out.select("id", F.when(F.col("first") < F.col("id"), F.col("first")).alias("duplicate_of"), "n_links"))


def relation_of(related: float, threshold: float) -> Callable[[str, str], tuple[str, float] | None]:
    """The link from an entry of one kind to one of another, with the least score that gives it."""
    said = {("solution", "problem"): "solves_for", ("decision", "problem"): "decided_about", ("decision", "claim"): "decided_about"}

    def relation(x: str, y: str) -> tuple[str, float] | None:
        if x == y or (y, x) in said:
            return None
        return (said[x, y], threshold) if (x, y) in said else ("related_to", max(related, threshold))

    return relation


def _meeting(entries: DataFrame, threshold: float, duplicate: float, prefix: int | None, within: str) -> DataFrame:
    """The entries that repeat none before them in the cells where those of one ``within`` meet."""
    cutter = Cutter(entries.sparkSession, "proposals")
    rows = numbered(bags(entries, "kind", within, prefix=prefix), "id", "kind", F.coalesce(F.col(within), F.lit("")).alias("g"))
    # the first entry of a bag stands for the others, which repeat it
    first = cutter.cut(rows.groupBy("g", "cls").agg(F.min("id").alias("key"), F.min_by("kind", "id").alias("kind"), F.first("words").alias("words")).where(F.size("words") > 0))
    rows = cutter.cut(blocks.marked(first, blocks.common(first), "key", "kind", "g"))
    cutter.drop(first)
    later = cutter.cut(blocks.exact_pairs(blocks.cells(cutter, rows, duplicate, 0), lambda x, y: ("", duplicate), later=True).select(F.col("id").alias("key")))
    return blocks.cells(cutter, rows.join(broadcast_if_small(later, 64), "key", "left_anti"), threshold, 0)


def proposals(entries: DataFrame, threshold: float = 0.3, related: float = 0.4, duplicate: float = 0.7, prefix: int | None = None, within: str = "repo") -> DataFrame:
    """(from_id, to_id, relation, score): links that two entries' kinds and shared words suggest, between entries of one ``within``.

    Solutions solve problems, decisions are about problems and claims; other kinds are
    related from ``related`` on; equal kinds and entries that duplicate an earlier one of
    their ``within`` get no link.  Links are made where blocks of entries meet and never shuffled.
    """
    found = blocks.exact_pairs(_meeting(entries, threshold, duplicate, prefix, within), relation_of(related, threshold))
    return found.select("from_id", "to_id", "relation", F.round("score", 6).alias("score"))


def linked(entries: DataFrame, threshold: float = 0.3, related: float = 0.4, duplicate: float = 0.7, prefix: int | None = None, within: str = "repo") -> DataFrame:
    """(id, relation, source): the ends of the links that ``proposals`` gives, once each, without the links themselves."""
    return blocks.exact_pairs(_meeting(entries, threshold, duplicate, prefix, within), relation_of(related, threshold), ends=True)


def suggest_tags(entries: DataFrame, k: int = 3, least: float = 0.12, prefix: int | None = None) -> DataFrame:
    """(id, tag, score, rank): up to k tags for entries without topical ones, by shared words with the tag's bag or by the tag's own words.

    Shared words are counted by joining on words; tags whose own words occur join on those.
    """
    cutter = Cutter(entries.sparkSession, "suggest")
    tags = topical(bags(entries, "tags", prefix=prefix), "id", "bag")
    bag = cutter.cut(tags.select("tag", F.explode("bag").alias("w")).distinct())
    tag_size = bag.groupBy("tag").agg(F.count(F.lit(1)).alias("tag_n"))
    bare = F.size(F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: ~F.lower(t).rlike(META_TAG) & (t != ""))) == 0
    plain = bags(entries.where(bare), prefix=prefix).where(F.size("bag") > 0)
    w = cutter.cut(plain.select("id", F.size("bag").alias("n"), F.explode("bag").alias("w")))
    inter = w.join(bag, "w").groupBy("id", "n", "tag").agg(F.count(F.lit(1)).alias("i"))
    jac = inter.join(F.broadcast(tag_size) if tag_size.limit(100_001).count() <= 100_000 else tag_size, "tag").select("id", "tag", (F.col("i") / (F.col("n") + F.col("tag_n") - F.col("i"))).alias("s"))
    parts = tag_size.select("tag", F.explode(F.filter(F.split(F.lower("tag"), "[-_]"), lambda p: F.length(p) >= 3)).alias("w"))
    bonus = w.join(parts, "w").groupBy("id", "tag").agg(F.count(F.lit(1)).alias("h")).select("id", "tag", (0.15 + 0.2 * F.least("h", F.lit(2))).alias("s"))
    best = jac.unionByName(bonus).groupBy("id", "tag").agg(F.round(F.max("s"), 6).alias("score")).where(F.col("score") >= least)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "tag")))
    return ranked.where(F.col("rank") <= k)


def narration(arc: DataFrame) -> DataFrame:
    """(id, scene, line): the entries of one topic told in order of time."""
    # scenes are numbered within months first, and months by how many scenes came before, so a topic of very many entries is sorted in parts
    month = F.coalesce(F.date_format("created_at", "yyyy-MM"), F.lit(""))
    own = arc.select("id", "title", "content", "kind", "created_at", "tag", month.alias("month"))
    own = own.withColumn("place", F.row_number().over(Window.partitionBy("tag", "month").orderBy("created_at", "id")))
    before = own.groupBy("tag", "month").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("tag").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("tag", "month", "before")
    rows = own.join(before, ["tag", "month"]).select("id", "title", "content", "kind", "created_at", (F.col("place") + F.col("before")).cast("int").alias("scene"))
    phrase = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in {"problem": "a problem appears", "solution": "a solution lands", "decision": "a decision is made", "claim": "a claim is made"}.items() for x in kv)), F.col("kind")), F.lit("a note is taken"))
    opening = F.when(F.col("scene") == 1, F.concat(F.lit("On "), F.date_format("created_at", "yyyy-MM-dd"), F.lit(" the story begins. "), F.upper(F.substring(phrase, 1, 1)), F.substring(phrase, 2, 1 << 30))).otherwise(F.concat(F.lit("Then, on "), F.date_format("created_at", "yyyy-MM-dd"), F.lit(", "), phrase))
    return rows.select("id", "scene", F.concat(opening, F.lit(": “"), "title", F.lit("”. "), first_sentence(F.col("content"))).alias("line"))


def first_sentence(text: Column) -> Column:
    """The first sentence of the first line that is no heading, list, quote or fence, without marks."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: (s != "") & ~s.rlike("^(#|[-*+] |>|```|\\|)"))
    plain = F.regexp_replace(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), "[*_`]|\\[\\[|\\]\\]", "")
    return F.regexp_extract(plain, "^(.*?[.!?])(\\s|$)|^(.*)$", 0)


def for_file(entries: DataFrame, path: str, kinds: tuple[str, ...] = ("decision", "problem"), limit: int = 5) -> DataFrame:
    """The entries of each kind whose scope contains the file's, by tier and then the newest; ``entries`` has scope, tier and created_at."""
    scope = file_scope(F.lit(path))
    hit = entries.where(F.col("kind").isin(*kinds) & F.contains(F.lower("scope"), F.lower(scope)))
    return first_per(hit.select("id", "kind", "title", "scope", "tier", "created_at"), ["kind"], [F.asc_nulls_last("tier"), F.desc_nulls_last("created_at"), F.col("id")], limit)


def arc_detail(entries: DataFrame, tag: str, duplicate: float = 0.7) -> DataFrame:
    """(id, title, kind, created_at, duplicate_of): the entries of a topic with the earliest one each repeats; ``narration`` and ``proposals`` give the rest."""
    arc = entries.where(F.array_contains("tags", tag))
    dup = duplicate_of(arc, duplicate).select("id", "duplicate_of")
    return arc.select("id", "title", "kind", "created_at").join(dup, "id", "left")
