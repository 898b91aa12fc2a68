"""Plain questions to operators, raw SQL over named views, and short forms of command output."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.bind import Graph, size_of
from . import search

_WORDS = {
    "functions": "function", "function": "function", "methods": "function", "method": "function", "fonksiyon": "function", "fonksiyonlar": "function", "classes": "class", "class": "class", "structs": "class", "sınıf": "class", "sınıflar": "class",
    "files": "file", "file": "file", "dosya": "file", "dosyalar": "file", "imports": "import_decl", "modules": "module", "configs": "config", "packages": "package", "endpoints": "api",
}
_EMPTY = frozenset("the a an is are was of in on for to me show list find all which what who where how many much does do that this with and or please any from by it have has there get give tell about ve bir bu ne nerede kaç tüm hangi göster listele bul".split())


@dataclass
class Intent:
    """What a question asks: count, list, search, callers, callees, in_file, largest or imports, with its terms."""

    kind: str
    table: str = "function"
    terms: list[str] = field(default_factory=list)


def parse(question: str) -> Intent:
    """The intent of an English or Turkish question; calls come before counts, the largest, imports, files, lists and search."""
    q = question.lower().strip().rstrip("?!. ")
    words = re.findall(r"[\w./:]+", q)
    table = next((_WORDS[w] for w in words if w in _WORDS), "function")
    terms = [w for w in words if w not in _EMPTY and w not in _WORDS]
    if m := re.search(r"\b(?:who|what|which functions?)\s+calls?\s+`?(\w+)|\bcallers?\s+of\s+`?(\w+)|`?(\w+)`?\s*(?:'[a-zıi]+\s+)?kim çağırıyor", q):
        return Intent("callers", terms=[next(g for g in m.groups() if g)])
    if m := re.search(r"\b(?:what|which functions?)\s+does\s+`?(\w+)`?\s+call|\bcallees?\s+of\s+`?(\w+)|\bcalled by\s+`?(\w+)|`?(\w+)`?\s+neyi çağırıyor", q):
        return Intent("callees", terms=[next(g for g in m.groups() if g)])
    if re.search(r"\bhow many\b|\bcount\b|\bnumber of\b|\bkaç\b", q):
        return Intent("count", table)
    if re.search(r"\b(?:largest|biggest|longest|en büyük|en uzun)\b", q):
        return Intent("largest", table)
    if re.search(r"\bimports?\b", q):
        return Intent("imports", "import_decl", terms)
    if m := re.search(r"\b(?:in|inside|içinde)\s+(?:file\s+)?([\w/\-]+\.\w+)|([\w/\-]+\.\w+)\s+içinde", q):
        return Intent("in_file", table, [m[1] or m[2]])
    if re.search(r"\b(?:list|all|every|tüm|listele)\b", q) and not terms:
        return Intent("list", table)
    return Intent("search", table, terms or words)


def answer(graph: Graph, question: str) -> DataFrame:
    """The rows that answer a question."""
    from .graph import callees, callers

    i = parse(question)
    name = lambda: graph.spark.range(1).select(F.lit(i.terms[0]).alias("name"))
    if i.kind == "callers":
        return callers(graph.functions(*search.SYMBOL), graph.calls, name())
    if i.kind == "callees":
        return callees(graph.functions(*search.SYMBOL), graph.calls, name())
    if i.kind == "count":
        return graph.entities("node_table").where(F.col("node_table") == i.table).agg(F.count(F.lit(1)).alias("n"))
    if i.kind == "largest":
        return search.largest(graph.functions("name", "file_path", "start_line", "end_line"))
    if i.kind == "imports":
        return search.imports_of(graph.entities("node_table", "name", "file_path", "body"))
    if i.kind == "in_file":
        return graph.entities("node_table", "name", "file_path", "start_line", "end_line").where(F.col("file_path").endswith(i.terms[0]) & (F.col("node_table") == i.table)).select("id", "name", size_of().alias("size"))
    if i.kind == "list":
        return search.list_all(graph.entities("node_table", "name", "file_path"), i.table)
    return search.ask_terms(graph.functions(*search.SYMBOL), i.terms)


def register_views(graph: Graph) -> None:
    """The logical frames as views, one per node table and one per relation, for SQL."""
    e = graph.entities()
    e.createOrReplaceTempView("entities")
    graph.edges.createOrReplaceTempView("edges")
    for t in ("function", "class", "file", "module", "config", "import_decl", "package", "skill", "api"):
        e.where(F.col("node_table") == t).createOrReplaceTempView(f"node_{t}")
    for r in ("calls", "contains", "imports", "inherits", "implements", "links_to", "calls_endpoint", "depends_on_package"):
        graph.rel(r).createOrReplaceTempView(f"rel_{r}")


def raw_query(spark: SparkSession, text: str) -> list[DataFrame]:
    """One frame per statement of ``text``, from a trusted caller; the first bad statement raises."""
    return [spark.sql(s) for s in (x.strip() for x in re.split(r";\s*(?:\n|$)", text)) if s]


def head_tail(lines: DataFrame, head: int = 30, tail: int = 15, passes: int | None = None) -> DataFrame:
    """Lines (doc, n, line) of each output cut to its ends with a count between; up to ``passes``, or head + tail + 1, lines stay."""
    size = lines.groupBy("doc").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("first"))
    x = lines.join(size, "doc")
    at = F.col("n") - F.col("first")
    whole = F.col("size") <= max(head + tail + 1, passes or 0)
    kept = x.where(whole | (at < head) | (at >= F.col("size") - tail)).select("doc", "n", "line")
    gap = size.where(~whole).select("doc", (F.col("first") + head).alias("n"), F.concat(F.lit("... "), (F.col("size") - head - tail).cast("string"), F.lit(" lines ...")).alias("line"))
    return kept.unionByName(gap)


def short_listing(lines: DataFrame) -> DataFrame:
    """The listing of a folder: over 60 lines, the first 20 and the last 10."""
    return head_tail(lines, 20, 10, 60)


def short_file(lines: DataFrame) -> DataFrame:
    """The text of a file: over 200 lines, the first 40 and the last 20."""
    return head_tail(lines, 40, 20, 200)


def short_containers(lines: DataFrame) -> DataFrame:
    """A table of containers or images: over 40 lines, the first 20 and the last 10."""
    return head_tail(lines, 20, 10, 40)


def _counted(lines: DataFrame, kept: Column, said: list[tuple[Column, str]]) -> DataFrame:
    """The ``kept`` lines, and after them one line for each kind of dropped ones with their number."""
    last = lines.groupBy("doc").agg(F.max("n").alias("last"))
    out = lines.where(kept).select("doc", "n", "line")
    for k, (dropped, what) in enumerate(said, 1):
        n = lines.where(dropped).groupBy("doc").agg(F.count(F.lit(1)).alias("c")).join(last, "doc")
        out = out.unionByName(n.select("doc", (F.col("last") + k).cast(lines.schema["n"].dataType).alias("n"), F.concat(F.lit("... "), F.col("c").cast("string"), F.lit(f" {what} ...")).alias("line")))
    return out


def short_install(lines: DataFrame) -> DataFrame:
    """The output of a package manager (doc, n, line): warnings of deprecation and lines on funding counted, notices and traces dropped."""
    t = F.ltrim("line")
    starts = lambda *p: reduce(lambda a, b: a | b, (t.startswith(x) for x in p))
    old = starts("npm warn deprecated ", "warning ", "WARN deprecated ")
    fund = ~old & (t.contains("looking for funding") | t.startswith("npm fund"))
    noise = starts("npm notice", "npm http ", "npm sill ", "npm verb ")
    return _counted(lines, ~old & ~fund & ~noise, [(old, "deprecation warnings"), (fund, "funding lines")])


def short_image_build(lines: DataFrame) -> DataFrame:
    """The output of an image build (doc, n, line): steps, errors and what is done or cached stay, all else is counted."""
    t = F.ltrim("line")
    starts = lambda *p: reduce(lambda a, b: a | b, (t.startswith(x) for x in p))
    kept = starts("Step ", "#", "Successfully built", "Successfully tagged", "ERROR ", "error:", "Sending build context") | (~t.startswith("---") & (t.contains("DONE") | t.contains("CACHED") | t.startswith("exporting ")))
    return _counted(lines, kept, [(~kept, "layer lines")])


def short_grep(lines: DataFrame, passes: int = 80) -> DataFrame:
    """Search output (doc, n, line) with one line per file, its first hit and how many more; short outputs stay, those with other lines keep their ends."""
    x = lines.where(F.trim("line") != "")
    path = F.regexp_extract("line", "^([^:]+):", 1)
    size = x.groupBy("doc").agg(F.count(F.lit(1)).alias("size"), F.min((path != "").cast("int")).alias("ok"))
    y = x.join(size, "doc")
    long = y.where((F.col("size") > passes) & (F.col("ok") == 1)).groupBy("doc", path.alias("path")).agg(F.min(F.struct("n", "line")).alias("f"), F.count(F.lit(1)).alias("c"))
    files = long.select("doc", "f.n", F.when(F.col("c") > 1, F.concat("f.line", F.lit(" (+"), (F.col("c") - 1).cast("string"), F.lit(" more)"))).otherwise(F.col("f.line")).alias("line"))
    rest = head_tail(y.where((F.col("size") > passes) & (F.col("ok") == 0)).select("doc", "n", "line"))
    return y.where(F.col("size") <= passes).select("doc", "n", "line").unionByName(files).unionByName(rest)


def short_build(lines: DataFrame) -> DataFrame:
    """Build and test output (doc, n, line) without progress lines, and with each diagnostic once: its first place and how often."""
    noise = F.col("line").rlike(r"^\s*(Compiling|Downloading|Downloaded|Checking|Fresh|Updating|Blocking|Locking|Resolving|Building|Collecting|npm (timing|http|sill)|#\d+ (sha256|extracting|\d+\.\d+)|.*\[\s*\d+%\]|.*\bPASSED\b|test .* \.\.\. ok|\s*$)")
    x = lines.where(~noise).withColumn("said", F.regexp_replace(F.regexp_replace("line", r"^.*?\): ", ""), r"^[^\s:]+:\d+(:\d+)?:\s*", ""))
    g = x.groupBy("doc", "said").agg(F.min(F.struct("n", "line")).alias("f"), F.count(F.lit(1)).alias("c"))
    return g.select("doc", "f.n", F.when(F.col("c") > 1, F.concat("f.line", F.lit(" (x"), F.col("c").cast("string"), F.lit(")"))).otherwise(F.col("f.line")).alias("line"))


def short_status(lines: DataFrame, most: int = 8) -> DataFrame:
    """Version-control status (doc, n, line) with untracked files counted where they are more than ``most``."""
    new = F.col("line").startswith("?? ")
    size = lines.where(new).groupBy("doc").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("first"))
    x = lines.join(size, "doc", "left")
    many = F.coalesce(F.col("size") > most, F.lit(False))
    kept = x.where(~(new & many)).select("doc", "n", "line")
    return kept.unionByName(size.where(F.col("size") > most).select("doc", F.col("first").alias("n"), F.concat(F.lit("?? "), F.col("size").cast("string"), F.lit(" untracked files")).alias("line")))


def word_at(text: str, line: int, utf16: int) -> str:
    """The identifier at a line and a UTF-16 column, or ''."""
    rows = text.split("\n")
    if not 0 <= line < len(rows):
        return ""
    raw = rows[line].encode("utf-16-le")
    at = len(raw[: utf16 * 2].decode("utf-16-le", errors="ignore"))
    return next((m[0] for m in re.finditer(r"\w+", rows[line]) if m.start() <= at <= m.end()), "")
