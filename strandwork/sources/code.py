"""Files to entities and edges, and readers of the other inputs.

Parsing is one pass over (path, content, repo) in Arrow batches; entities and edges
come out of the same pass as tagged rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .parsers import LARGEST, parse, skip_pattern
from .parsers import hunks as _hunks

_ENTITY = ("node_table", "kind", "name", "qualified_name", "file_path", "repo", "language", "signature", "body", "cuda_qualifier", "method", "url_pattern")
_EDGE = ("rel", "src", "dst", "raw_callee", "context")
_NUMBERS = ("start_line", "end_line", "line")
SCHEMA = ", ".join([*(f"{c} string" for c in ("row", *_ENTITY, *_EDGE)), *(f"{c} int" for c in _NUMBERS)])


def read_tree(spark: SparkSession, folder: str, repo: str, glob: str = "*") -> DataFrame:
    """(path, content, repo) of the text files below a folder that are to be parsed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    path = F.regexp_replace("path", "^file:/*" + folder.strip("/") + "/*", "")
    ok = (F.col("length") <= LARGEST) & ~path.rlike(skip_pattern()) & ~path.rlike("(^|/)\\.[^/]+(/|$)")
    return files.where(ok).select(path.alias("path"), F.decode("content", F.lit("UTF-8")).alias("content"), F.lit(repo).alias("repo"))


def skipped(path: Column, content: Column) -> Column:
    """Whether a file is left out of parsing."""
    return path.rlike(skip_pattern()) | (F.octet_length(content) > LARGEST)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("row", *_ENTITY, *_EDGE, *_NUMBERS)
    types = [pa.int32() if n in _NUMBERS else pa.string() for n in names]
    for b in batches:
        out: list[dict] = []
        for path, content, repo in zip(*(b.column(c).to_pylist() for c in ("path", "content", "repo")), strict=True):
            entities, edges = parse(path, content, repo or "")
            out += [{"row": "entity", **e} for e in entities] + [{"row": "edge", **e} for e in edges]
        yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in out], t) for n, t in zip(names, types, strict=True)], names=list(names))


def parsed(files: DataFrame) -> DataFrame:
    """Tagged rows (``row`` 'entity' or 'edge') of ``files(path, content, repo)`` that are not skipped."""
    f = files.where(F.col("path").isNotNull() & F.col("content").isNotNull() & ~skipped(F.col("path"), F.col("content")))
    return f.select("path", "content", F.col("repo").cast("string").alias("repo")).mapInArrow(_rows, SCHEMA)


def entities(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("row") == "entity").select(*_ENTITY, "start_line", "end_line", F.when(F.col("node_table") == "function", F.sha2("body", 256)).alias("body_hash"))


def edges(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("row") == "edge").select(*_EDGE, "line", "repo", "method", "url_pattern")


def files_of(files: DataFrame) -> DataFrame:
    """(repo, path, hash, lines) of files by their content."""
    return files.select("repo", "path", F.sha2("content", 256).alias("hash"), F.size(F.split("content", "\r\n|\r|\n")).alias("lines"))


def git_log(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Commits and file changes of logs ``text(repo, log)`` in the format '%x1e%H%x1f%an%x1f%at%x1f%s' with --name-status."""
    one = text.select("repo", F.explode(F.split("log", "\x1e")).alias("c")).where(F.trim("c") != "")
    head = F.split(F.split_part("c", F.lit("\n"), F.lit(1)), "\x1f")
    rows = one.select("repo", F.get(head, F.lit(0)).alias("commit"), F.get(head, F.lit(1)).alias("author"), F.get(head, F.lit(2)).try_cast("long").alias("ts"), F.get(head, F.lit(3)).alias("message"), "c")
    lines = rows.select("repo", "commit", F.explode(F.slice(F.split("c", "\n"), 2, 1 << 30)).alias("l")).where(F.col("l").rlike("^[AMDRC]"))
    kind = F.create_map(*(F.lit(x) for kv in {"A": "Added", "D": "Deleted", "R": "Renamed", "C": "Added", "M": "Modified"}.items() for x in kv))
    changes = lines.select("repo", "commit", F.element_at(F.split("l", "\t"), -1).alias("path"), kind[F.substring("l", 1, 1)].alias("change_type"))
    return rows.drop("c"), changes


def diff_hunks(diffs: DataFrame) -> DataFrame:
    """(diff_id, path, first, last) of ``diffs(diff_id, diff)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, p, a, a + n - 1) for i, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if d for p, a, n in _hunks(d)]
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=["diff_id", "path", "first", "last"])

    return diffs.select(F.col("diff_id").cast("string").alias("diff_id"), "diff").mapInArrow(run, "diff_id string, path string, first int, last int")


def conversations(lines: DataFrame) -> DataFrame:
    """(conv_id, line, role, text, ts, has_tool_error, tool_error_text) of JSON lines ``lines(file, line, value)``.

    Kinds 'queue-operation' and 'system' and other roles are left out; the session is
    the line's, else the file's name.
    """

    def turn(value: str) -> tuple | None:
        try:
            x = json.loads(value)
        except ValueError:
            return None
        m = x.get("message") if isinstance(x, dict) else None
        if not isinstance(m, dict) or x.get("type") in ("queue-operation", "system") or m.get("role") not in ("user", "assistant"):
            return None
        content = m.get("content")
        blocks = content if isinstance(content, list) else [{"type": "text", "text": content or ""}]
        text = "\n".join(str(c.get("text") or "") for c in blocks if isinstance(c, dict) and c.get("type") == "text")
        errors = [c for c in blocks if isinstance(c, dict) and c.get("type") == "tool_result" and c.get("is_error")]
        shown = str(errors[0].get("content") or "").encode()[:200].decode(errors="ignore") if errors else None
        return x.get("sessionId"), m["role"], text, x.get("timestamp"), bool(errors), shown

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for file, line, value in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                t = turn(value) if value else None
                if t:
                    rows.append((t[0] or file.rsplit("/", 1)[-1].rsplit(".", 1)[0], line, *t[1:]))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "line", "role", "text", "ts", "has_tool_error", "tool_error_text"])

    return lines.select("file", F.col("line").cast("long").alias("line"), "value").mapInArrow(run, "conv_id string, line long, role string, text string, ts string, has_tool_error boolean, tool_error_text string")


def insight_log(spark: SparkSession, *paths: str) -> DataFrame:
    """Events of JSON-lines logs; lines that are no events are dropped."""
    return spark.read.schema("ts long, repo string, kind string, session_id string, detail string").option("mode", "DROPMALFORMED").json(list(paths))


_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def html_title(html: Column) -> Column:
    out = F.trim(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))
    for a, b in (_ENTITIES[-1], *_ENTITIES[:-1]):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(out != "", out)


def html_text(html: Column) -> Column:
    """The text of the article, else main, else the body, without tags, scripts and styles."""
    part = lambda tag: F.regexp_extract(html, f"(?is)<{tag}[\\s>].*?</{tag}>", 0)
    body = F.coalesce(*(F.when(part(t) != "", part(t)) for t in ("article", "main", "body")), html)
    plain = F.regexp_replace(F.regexp_replace(body, "(?is)<(script|style)[\\s>].*?</\\1>", " "), "(?s)<[^>]+>", " ")
    for a, b in _ENTITIES:
        plain = F.replace(plain, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(plain, "\\s+", " "))


def looks_like_html(text: Column) -> Column:
    return F.lower(F.substring(F.ltrim(text), 1, 500)).rlike("^<!doctype html|<html[\\s>]|<body[\\s>]|<article[\\s>]")
