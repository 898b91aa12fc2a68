"""Column helpers for ids, scopes, paths and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A record key is cut to this length.
KEY_LENGTH = 200


def sanitize_id(name: Column) -> Column:
    """A record key: anything but ASCII letters, digits and _ becomes _, runs of _ collapse, the ends are trimmed."""
    key = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9_]", "_"), "_+", "_")
    return F.rtrim(F.substring(F.trim(key, F.lit("_")), 1, KEY_LENGTH), F.lit("_"))


def slugify(title: Column) -> Column:
    """A knowledge id: lower case, separators to single _, everything else dropped."""
    kept = F.regexp_replace(F.lower(title), "[^a-z0-9 \\-_/.]", "")
    return F.trim(F.regexp_replace(kept, "[ \\-_/.]+", "_"), F.lit("_"))


def conversation_slug(name: Column) -> Column:
    """Lower case, non-alphanumerics to _, one pass over double _, trimmed, 60 characters."""
    low = F.regexp_replace(F.lower(name), "[^\\p{L}\\p{N}]", "_")
    return F.substring(F.trim(F.replace(low, F.lit("__"), F.lit("_")), F.lit("_")), 1, 60)


def file_scope(path: Column) -> Column:
    """The scope of a file for decisions: the part of its path below crates, src or lib, else its folder, else root."""
    parts = F.split(path, "/")
    n = F.size(parts)
    inner = F.filter(F.slice(parts, F.lit(2), F.greatest(n - 3, F.lit(0))), lambda x: x != "src")
    deep = (n >= 3) & F.get(parts, F.lit(0)).isin("crates", "src", "lib")
    return F.when(deep, F.array_join(inner, "::")).when(n >= 2, F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), "::")).otherwise(F.lit("root"))


def conversation_scope(path: Column) -> Column:
    """The scope of a conversation's path: what follows its first src without file names, after the segment before it."""
    parts = F.split(path, "/")
    at = F.array_position(parts, "src").cast("int")
    after = F.filter(F.slice(parts, at + 1, F.size(parts)), lambda x: ~x.contains("."))
    before = F.when(at > 1, F.array(F.get(parts, at - 2))).otherwise(F.array().cast("array<string>"))
    scope = F.array_join(F.concat(before, after), "::")
    return F.when((at > 0) & (scope != ""), scope).otherwise(F.lit("root"))


def short_path(path: Column, keep: int = 3) -> Column:
    """A path with more than ``keep`` segments as …/ and its last ones."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > keep, F.concat(F.lit("…/"), F.array_join(F.slice(parts, -keep, keep), "/"))).otherwise(path)


def folder(path: Column, depth: int = 2) -> Column:
    """The first ``depth`` segments of a path."""
    return F.array_join(F.slice(F.split(path, "/"), 1, depth), "/")


def hour_key(seconds: Column) -> Column:
    """yyyy-MM-ddTHH in UTC of epoch seconds; the session's zone must be UTC."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH")


def module_of_import(body: Column) -> Column:
    """The module path an import names, with / between segments: from X import, from 'x', use a::b, else ''."""
    text = F.trim(body)
    py = F.regexp_extract(text, r"^from\s+([\w.]+)\s+import\b", 1)
    js = F.regexp_extract(text, r"""\bfrom\s+['"]([^'"]+)['"]""", 1)
    rs = F.regexp_extract(text, r"^(?:pub\s+)?use\s+([^;\s]+)", 1)
    return (
        F.when(py != "", F.replace(py, F.lit("."), F.lit("/")))
        .when(js != "", F.regexp_replace(js, r"^(?:\.{1,2}/)+", ""))
        .when(rs != "", F.replace(rs, F.lit("::"), F.lit("/")))
        .otherwise(F.lit(""))
    )


def url_path(url: Column) -> Column:
    """The path of a URL: after the host, or with a leading /."""
    host = F.regexp_extract(url, r"^https?://[^/]*(/.*)?$", 1)
    return F.when(url.rlike("^https?://"), F.when(host == "", F.lit("/")).otherwise(host)).when(url.startswith("/"), url).otherwise(F.concat(F.lit("/"), url))
