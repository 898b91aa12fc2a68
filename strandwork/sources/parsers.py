"""Parsers of single files: source code, configuration, documents, build files.

``parse(path, content, repo)`` gives entities and edges as dictionaries.  Python is
parsed by its own grammar; other languages by patterns of their definitions, with ends
found by matching brackets.  Files that do not parse give their File entity alone.
"""

from __future__ import annotations

import ast
import json
import re
import tomllib
from collections.abc import Iterator

from .grammars import SHAPES, block_end

#: Extensions to languages.
EXTENSIONS = {
    "py": "python", "pyi": "python", "rs": "rust", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "java": "java", "go": "go", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "cu": "cuda", "cuh": "cuda", "cs": "csharp", "rb": "ruby", "dart": "dart",
    "kt": "kotlin", "kts": "kotlin", "swift": "swift", "scala": "scala", "php": "php", "sql": "sql", "ddl": "sql", "md": "markdown", "markdown": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml",
    "tf": "terraform", "tfvars": "terraform", "hcl": "terraform", "gradle": "gradle", "proto": "protobuf", "env": "env",
    **{ext: language for language, shape in SHAPES.items() for ext in shape.extensions},
}
FILENAMES = {"dockerfile": "dockerfile", "makefile": "make", "gnumakefile": "make", "cmakelists.txt": "cmake", "package.json": "package", "cargo.toml": "package", "build.gradle": "gradle", ".env": "env"}
TABLES = {
    "File": "file", "Function": "function", "Method": "function", "Class": "class", "Struct": "class", "Trait": "class", "Enum": "class", "Interface": "class", "TypeAlias": "class", "Import": "import_decl",
    "Module": "module", "ConfigKey": "config", "ConfigSection": "config", "DocSection": "doc", "DocLink": "doc", "DocCodeBlock": "doc", "SkillNode": "skill", "SkillMOC": "skill", "DockerStage": "infra",
    "DockerInstruction": "infra", "DbTable": "db_entity", "DbIndex": "db_entity", "DbView": "db_entity", "TerraformResource": "infra", "TerraformVariable": "infra", "TerraformProvider": "infra", "TerraformModule": "infra",
    "ApiEndpoint": "api", "ApiSchema": "api", "ApiField": "api", "Package": "package", "Dependency": "package", "Script": "package", "HttpClientCall": "http_call", "ProtoMessage": "api", "ProtoService": "api", "ProtoRpc": "api",
    "GradlePlugin": "package", "GradleTask": "package", "EnvVar": "config",
}
_BRACES = {"rust", "typescript", "javascript", "java", "go", "c", "cpp", "cuda", "csharp", "dart", "kotlin", "swift", "scala", "php"}
_KEYWORDS = frozenset("if for while switch catch return else do new sizeof match loop function def fn func class struct impl await throw typeof super this self print assert with try except lambda in not and or yield case when unless until using lock foreach".split())
_CLASS = re.compile(r"^[ \t]*(?:(?:pub(?:\([^)]*\))?|public|private|protected|internal|static|final|abstract|sealed|export|default|data|open|partial)\s+)*(?P<kind>class|struct|trait|interface|enum|object|protocol|mixin|module)\s+(?P<name>\w+)(?P<rest>[^{;=\n]*(?:\n[ \t]*(?::|,|extends\b|implements\b|with\b)[^{;=\n]*)*)", re.M)
_GO_TYPE = re.compile(r"^type\s+(?P<name>\w+)\s+(?P<kind>struct|interface)\b(?P<rest>)", re.M)
_IMPL = re.compile(r"^[ \t]*impl(?:<[^>]*>)?\s+(?:(?P<trait>[\w:]+)(?:<[^>]*>)?\s+for\s+)?(?P<name>\w+)", re.M)
_FUNCTION = {
    "rust": re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:default\s+|const\s+|async\s+|unsafe\s+|extern\s+\"[^\"]*\"\s+)*fn\s+(?P<name>\w+)", re.M),
    "go": re.compile(r"^func\s+(?:\((?:\w+\s+)?\*?(?P<owner>\w+)[^)]*\)\s*)?(?P<name>\w+)\s*\(", re.M),
    "ruby": re.compile(r"^[ \t]*def\s+(?:self\.)?(?P<name>\w+[?!]?)", re.M),
    "kotlin": re.compile(r"^[ \t]*(?:\w+\s+)*fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(?P<name>\w+)\s*\(", re.M),
    "swift": re.compile(r"^[ \t]*(?:\w+\s+)*func\s+(?P<name>\w+)", re.M),
    "scala": re.compile(r"^[ \t]*(?:\w+\s+)*def\s+(?P<name>\w+)", re.M),
    "php": re.compile(r"^[ \t]*(?:\w+\s+)*function\s+(?P<name>\w+)\s*\(", re.M),
}
_JS = re.compile(
    r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>\w+)\s*[(<]|^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<arrow>\w+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::\s*[^=\n]+)?=>"
    r"|^[ \t]+(?:(?:public|private|protected|static|async|get|set|readonly|override)\s+)*(?P<method>\w+)\s*\([^)\n]*\)\s*(?::\s*[^{\n]+)?\{",
    re.M,
)
_C = re.compile(r"^[ \t]*(?:(?:__global__|__device__|__host__|static|inline|extern|const|unsigned|public|private|protected|internal|final|abstract|virtual|override|async|synchronized|native)\s+)*(?:[\w:<>,\[\]?]+[\s*&]+)+(?P<name>\w+)\s*\([^;{}]*\)\s*(?:const\s*|throws\s+[\w, ]+|override\s*|async\s*)*\{", re.M)
_IMPORT = re.compile(r"^[ \t]*(?:(?:import|from)\s+[^\n]+|(?:pub\s+)?use\s+[\w:{}, *]+;|#include\s*[<\"][^>\"]+[>\"]|require(?:_relative)?\s+['\"][^'\"]+['\"]|(?:const|let|var)\s+[^=\n]+=\s*require\([^)]*\)|using\s+[\w.]+;)", re.M)
_CALL = re.compile(r"(?P<recv>(?:[\w$]+(?:\.|::|->))*)(?P<name>[A-Za-z_]\w*)\s*\(")
_LAUNCH = re.compile(r"(\w+)\s*<<<")
_QUALIFIER = re.compile(r"\b(__global__|__device__|__host__)\b")
# Parts of the names of HTTP clients, and methods that send a request.
_CLIENTS = ("reqwest", "client", "http_client", "httpclient", "_httpclient", "_client", "axios", "fetch", "requests", "http", "net", "ureq", "hyper", "surf", "restclient", "flurlclient", "webclient")
_METHODS = frozenset(("get", "post", "put", "delete", "patch", "head", "options"))
_ASYNC = frozenset(("getasync", "postasync", "putasync", "deleteasync", "patchasync", "sendasync", "getstringasync", "getbytearrayasync", "getstreamasync", "executeasync", "executegettaskasync", "executeposttaskasync"))
_HTTP = re.compile(r"(?<![\w$])(?P<recv>[\w$]+)\s*(?:\.|::)\s*(?P<m>\w+)\s*(?:<[^>]*>)?\(\s*[frb]?(?P<q>['\"`])(?P<url>[^'\"`]*)(?P=q)|\bfetch\s*\(\s*(?P<q2>['\"`])(?P<url2>[^'\"`]*)(?P=q2)")
_STRINGS = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|//[^\n]*|/\*.*?\*/", re.S)
_SKIP_DIRS = ("node_modules", "target", "dist", "build", ".git", "vendor", "__pycache__", ".venv", "venv", "out", "coverage", ".next")
_SKIP_NAMES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "cargo.lock", "poetry.lock", "composer.lock", "gemfile.lock", "go.sum")
_SKIP_ENDS = (".min.js", ".min.css", ".map", ".pb.go", "_pb2.py", ".g.dart", ".freezed.dart", ".generated.ts", ".d.ts", ".designer.cs")
#: Files over this many bytes are not parsed.
LARGEST = 2 << 20


def skip_pattern() -> str:
    """A pattern of paths that are not parsed: build and vendor folders, generated names, lock files."""
    dirs = "|".join(re.escape(d) for d in _SKIP_DIRS)
    names = "|".join(re.escape(n) for n in _SKIP_NAMES)
    ends = "|".join(re.escape(e) for e in _SKIP_ENDS)
    return rf"(?i)(?:^|/)(?:{dirs})/|(?:^|/)(?:{names})$|(?:{ends})$"


def language_of(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1].lower()
    if name in FILENAMES:
        return FILENAMES[name]
    if name.startswith("dockerfile"):
        return "dockerfile"
    if name.endswith(".cu.inc"):
        return "cuda"
    return EXTENSIONS.get(name.rsplit(".", 1)[-1]) if "." in name else None


def url_path(url: str) -> str:
    m = re.match(r"https?://[^/]*(/.*)?$", url)
    return (m[1] or "/") if m else url if url.startswith("/") else "/" + url


class _File:
    """Collects what a parser finds in one file."""

    def __init__(self, path: str, content: str, repo: str, language: str) -> None:
        self.path, self.content, self.repo, self.language = path, content, repo, language
        self.entities: list[dict] = []
        self.edges: list[dict] = []
        self.top = f"{repo}:{path}"
        self.lines = content.split("\n")

    def line_at(self, offset: int) -> int:
        return self.content.count("\n", 0, offset) + 1

    def entity(self, kind: str, name: str, qualified: str | None = None, start: int = 1, end: int | None = None, parent: str | None = None, link: bool = True, **extra: object) -> str:
        q = qualified or f"{parent or self.top}:{name}"
        self.entities.append({"node_table": TABLES[kind], "kind": kind, "name": name, "qualified_name": q, "file_path": self.path, "repo": self.repo, "start_line": start, "end_line": end or start, "language": self.language, **extra})
        if link and q != self.top:
            self.edge("contains", parent or self.top, q, start)
        return q

    def edge(self, rel: str, src: str, dst: str, line: int = 0, **extra: object) -> None:
        self.edges.append({"rel": rel, "src": src, "dst": dst, "line": line, "repo": self.repo, **extra})


def _python(f: _File) -> None:
    tree = ast.parse(f.content)

    def walk(body: list[ast.stmt], parent: str, nested: bool) -> None:
        for node in body:
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                q = f"{parent}::{node.name}" if nested else f"{f.top}:{node.name}"
                signature = f.lines[node.lineno - 1].strip()
                f.entity("Method" if nested else "Function", node.name, q, node.lineno, node.end_lineno, parent, signature=signature, body="\n".join(f.lines[node.lineno - 1 : node.end_lineno]))
                for x in ast.walk(node):
                    if isinstance(x, ast.Call):
                        callee = x.func.attr if isinstance(x.func, ast.Attribute) else x.func.id if isinstance(x.func, ast.Name) else None
                        if callee:
                            f.edge("calls", q, f"{f.top}:{callee}", x.lineno, raw_callee=callee)
                walk(node.body, q, True)
            elif isinstance(node, ast.ClassDef):
                q = f"{parent}::{node.name}" if nested else f"{f.top}:{node.name}"
                f.entity("Class", node.name, q, node.lineno, node.end_lineno, parent)
                for b in node.bases:
                    f.edge("inherits", q, f"{f.top}:{ast.unparse(b)}", node.lineno)
                walk(node.body, q, True)
            elif isinstance(node, ast.Import | ast.ImportFrom):
                text = ast.unparse(node)
                q = f.entity("Import", text[:80], f"{f.top}:import:{node.lineno}", node.lineno, node.end_lineno, link=False, body=text)
                f.edge("imports", f.top, q, node.lineno)
            elif isinstance(node, ast.If | ast.Try | ast.With | ast.For | ast.While):
                walk([x for x in ast.iter_child_nodes(node) if isinstance(x, ast.stmt)], parent, nested)

    walk(tree.body, f.top, False)


def _close(text: str, start: int, ruby: bool) -> int:
    """The offset after the block that opens at or after ``start``."""
    if ruby:
        indent = re.match(r"[ \t]*", text[text.rfind("\n", 0, start) + 1 :])[0]  # type: ignore[index]
        m = re.compile(rf"^{indent}end\b", re.M).search(text, start)
        return m.end() if m else len(text)
    depth = 0
    for m in re.compile(r"[{};]").finditer(text, start):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if depth <= 0:
                return m.end()
        elif depth == 0:
            return m.end()
    return len(text)


def _blank(text: str) -> str:
    """Text with strings and comments blanked out, of the same length and lines."""
    return _STRINGS.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _names(listed: str) -> list[str]:
    """The last part of each name of a list of types, without arguments, access words and virtual."""
    bare = listed
    while (cut := re.sub(r"<[^<>]*>|\([^()]*\)", "", bare)) != bare:
        bare = cut
    found = (re.findall(r"[\w.:]+", re.sub(r"\b(?:public|private|protected|virtual|internal)\b", "", x)) for x in bare.split(","))
    return [re.split(r"[.:]+", x[0].strip(":."))[-1] for x in found if x]


def heritage(language: str, kind: str, rest: str) -> Iterator[tuple[str, str]]:
    """(relation, name) of what follows a type's name: extends, with and implements by their words, a list after a colon or a Ruby arrow.

    After a colon all inherit, but names of interfaces (I and a capital) of C#, what follows
    the first name of Kotlin and Swift, and what a Rust trait or a protocol asks for.
    """
    words = dict(re.findall(r"\b(extends|with|implements)\s+(.+?)(?=\b(?:extends|with|implements|permits|where)\b|$)", rest, re.S))
    for name in _names(words.get("extends", "")) + _names(words.get("with", "")):
        yield "inherits", name
    for name in _names(words.get("implements", "")):
        yield "implements", name
    if words:
        return
    if language == "ruby":
        if m := re.search(r"<\s*([\w:]+)", rest):
            yield "inherits", m[1].split("::")[-1]
        return
    bare = rest
    while (cut := re.sub(r"<[^<>]*>|\([^()]*\)", "", bare)) != bare:
        bare = cut
    m = re.search(r"(?<!:):(?!:)(.+)", re.sub(r"\bwhere\b.*", "", bare, flags=re.S), re.S)
    if not m or language not in ("cpp", "cuda", "c", "csharp", "kotlin", "swift", "rust") or language in ("cpp", "cuda", "c") and kind == "enum":
        return
    for k, name in enumerate(_names(m[1].replace("+", ","))):
        interface = language == "csharp" and re.match(r"I[A-Z]", name) or language in ("kotlin", "swift") and k > 0
        yield "implements" if interface and kind not in ("interface", "protocol") else "inherits", name


def _shaped(f: _File) -> None:
    """Definitions of a language of ``SHAPES``; calls are names before a parenthesis that the file defines."""
    shape, text = SHAPES[f.language], f.content
    owners: list[tuple[int, int, str]] = []
    for m in shape.type.finditer(text) if shape.type else ():
        kind = {"struct": "Struct", "interface": "Interface", "protocol": "Interface", "trait": "Trait", "enum": "Enum"}.get(m.groupdict().get("kind") or "", "Class")
        end = block_end(shape, text, m.start(), m.end())
        owners.append((m.start(), end, f.entity(kind, m["name"], None, f.line_at(m.start()), f.line_at(end))))
    spans: list[tuple[int, int, str, str]] = []
    for m in shape.function.finditer(text) if shape.function else ():
        if m["name"] in _KEYWORDS or any(n == m["name"] and a <= m.start() < b for a, b, _, n in spans):
            continue
        end = block_end(shape, text, m.start(), m.end())
        inside = [o for o in owners if o[0] < m.start() < o[1]]
        owner = inside[-1][2] if inside else None
        body = text[m.start() : end].strip("\n")
        q = f"{owner}::{m['name']}" if owner else f"{f.top}:{m['name']}"
        f.entity("Method" if owner else "Function", m["name"], q, f.line_at(m.start()), f.line_at(max(m.start(), end - 1)), owner, signature=body.split("\n")[0].strip(), body=body)
        spans.append((m.end(), end, q, m["name"]))
    known = {n for *_, n in spans}
    call = re.compile(r"\(\s*([^\s()\"']+)" if shape.block == "paren" else r"([A-Za-z_][\w!?]*)\s*\(")
    for a, b, q, _ in spans:
        for c in call.finditer(text, a, b):
            if c[1] in known:
                f.edge("calls", q, f"{f.top}:{c[1]}", f.line_at(c.start(1)), raw_callee=c[1])
    for m in shape.imports.finditer(text) if shape.imports else ():
        line = f.line_at(m.start())
        f.edge("imports", f.top, f.entity("Import", m[0].strip()[:80], f"{f.top}:import:{line}", line, link=False, body=m[0].strip()), line)


def _pattern_code(f: _File) -> None:
    text = _blank(f.content) if f.language in _BRACES else f.content
    ruby = f.language == "ruby"
    owners: list[tuple[int, int, str]] = []
    for rx in (_CLASS, *([_GO_TYPE] if f.language == "go" else [])):
        for m in rx.finditer(text):
            kind = {"struct": "Struct", "trait": "Trait", "interface": "Interface", "protocol": "Interface", "enum": "Enum", "module": "Module"}.get(m["kind"], "Class")
            end = _close(text, m.end(), ruby)
            q = f.entity(kind, m["name"], None, f.line_at(m.start()), f.line_at(end))
            owners.append((m.start(), end, q))
            for rel, base in heritage(f.language, m["kind"], m["rest"] or ""):
                f.edge(rel, q, f"{f.top}:{base}", f.line_at(m.start()))
    if f.language == "rust":
        for m in _IMPL.finditer(text):
            owner = f"{f.top}:{m['name']}"
            owners.append((m.start(), _close(text, m.end(), False), owner))
            if m["trait"]:
                f.edge("implements", owner, f"{f.top}:{m['trait'].split('::')[-1]}", f.line_at(m.start()))
    rx = _FUNCTION.get(f.language) or (_JS if f.language in ("typescript", "javascript") else _C)
    spans: list[tuple[int, int, str]] = []
    for m in rx.finditer(text):
        name = next(g for g in (m.groupdict().get(k) for k in ("name", "arrow", "method")) if g)
        if name in _KEYWORDS:
            continue
        inside = [o for o in owners if o[0] < m.start() < o[1]]
        owner = f"{f.top}:{m['owner']}" if m.groupdict().get("owner") else inside[-1][2] if inside else None
        brace = text.find("{", m.start(), m.end())
        end = _close(text, brace if brace >= 0 else m.end(), ruby)
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        q = f"{owner}::{name}" if owner else f"{f.top}:{name}"
        signature = re.split(r"\s*(?:\{|=>\s*$|\n)", f.content[start : start + 400])[0].strip()
        qualifier = _QUALIFIER.search(text[m.start() : m.end()])
        f.entity("Method" if owner else "Function", name, q, f.line_at(start), f.line_at(end), owner, signature=signature, body=f.content[start:end], cuda_qualifier=qualifier[1] if qualifier and f.language == "cuda" else None)
        spans.append((m.end(), end, q))
    for a, b, q in spans:
        for c in _CALL.finditer(text, a, b):
            if c["name"] not in _KEYWORDS:
                f.edge("calls", q, f"{f.top}:{c['name']}", f.line_at(c.start("name")), raw_callee=c["name"])
        for c in _LAUNCH.finditer(text, a, b) if f.language == "cuda" else ():
            f.edge("calls", q, f"{f.top}:{c[1]}", f.line_at(c.start()), raw_callee=c[1])
    for m in _IMPORT.finditer(f.content):
        line = f.line_at(m.start())
        q = f.entity("Import", m[0].strip()[:80], f"{f.top}:import:{line}", line, link=False, body=m[0].strip())
        f.edge("imports", f.top, q, line)


def _http(f: _File) -> None:
    for m in _HTTP.finditer(f.content):
        if m["url2"] is not None:
            method, url = "GET", m["url2"]
        elif any(c in m["recv"].lower() for c in _CLIENTS) and (verb := m["m"].lower()) in _METHODS | _ASYNC:
            # what sends any request does not say which
            said = "post" if verb == "executeposttaskasync" else verb
            method, url = next((x.upper() for x in sorted(_METHODS) if said.startswith(x)), "UNKNOWN"), m["url"]
        else:
            continue
        path = url_path(url)
        if path != "/":
            line = f.line_at(m.start())
            q = f.entity("HttpClientCall", f"{method} {path}", f"{f.top}:http:{line}:{path}", line, method=method, url_pattern=path)
            f.edge("calls_endpoint", q, f"{f.repo}:api:{path}", line, method=method, url_pattern=path)


def _flatten(f: _File, value: object, prefix: str, parent: str, depth: int = 0) -> None:
    if not isinstance(value, dict) or depth > 5:
        return
    for k, v in value.items():
        path = f"{prefix}.{k}" if prefix else str(k)
        body = None if isinstance(v, dict) else f"[{len(v)} items]" if isinstance(v, list) else str(v)
        q = f.entity("ConfigSection" if isinstance(v, dict) else "ConfigKey", path, f"{f.top}:{path}", 1, parent=parent, body=body)
        _flatten(f, v, path, q, depth + 1)


def _flow(text: str) -> object:
    """A flow map or list of YAML as a dict or list of texts and such; anything else as it stands."""
    text = text.strip()
    if len(text) < 2 or (text[0], text[-1]) not in (("{", "}"), ("[", "]")):
        return text.strip("\"'")
    parts, depth, quote, start = [], 0, "", 1
    for i in range(1, len(text) - 1):
        ch = text[i]
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "\"'":
            quote = ch
        elif ch in "{[":
            depth += 1
        elif ch in "}]":
            depth -= 1
        elif ch == "," and depth == 0:
            parts.append(text[start:i])
            start = i + 1
    parts = [p.strip() for p in [*parts, text[start:-1]] if p.strip()]
    if text[0] == "[":
        return [_flow(p) for p in parts]
    pairs = (re.match(r"(\"[^\"]*\"|'[^']*'|[^:]+):(?:\s+(.*))?$", p, re.S) for p in parts)
    return {m[1].strip().strip("\"'"): _flow(m[2] or "") for m in pairs if m}


def _yaml(f: _File) -> None:
    """Keys of block and flow mappings; lists count their items, block texts are bodies, marks of anchors and tags fall away."""
    stack: list[tuple[int, str, str]] = []
    lists: dict[str, int] = {}  # the place of a section's entity whose value is a list
    skip: int | None = None
    for n, line in enumerate(f.lines, 1):
        bare = line.lstrip()
        depth = len(line) - len(bare)
        if skip is not None:
            if not bare or depth > skip:
                continue
            skip = None
        if not bare or bare[0] == "#" or bare.startswith(("---", "...", "%")):
            continue
        if bare.startswith("- ") or bare == "-":
            # items of a list stand at the indent of its key or deeper
            while stack and stack[-1][0] > depth:
                stack.pop()
            if stack and (at := lists.get(stack[-1][2])) is not None:
                e = f.entities[at]
                if e["start_line"] < n and depth == e.setdefault("_item", depth):
                    e["_n"] = e.get("_n", 0) + 1
            if re.match(r"-\s+[^\s].*:\s*[|>][+-]?\d*$", bare):
                skip = depth
            continue
        m = re.match(r"( *)([^\s:#\"'{\[&*!|>-][^:#]*?|-\S[^:#]*?|\"[^\"]+\"|'[^']+'|<<)\s*:(?:\s+(.*))?$", line)
        if not m:
            continue
        key = m[2].strip("\"'")
        value = re.sub(r"^(?:[&!]\S*\s*)+", "", re.sub(r"(?:^|\s)#.*$", "", m[3] or "").strip()) if not (m[3] or "").lstrip().startswith(("'", '"')) else (m[3] or "").strip()
        while stack and stack[-1][0] >= depth:
            stack.pop()
        # keys of a list's items belong to no path
        if stack and lists.get(stack[-1][2]) is not None and f.entities[lists[stack[-1][2]]].get("_n"):
            continue
        path = ".".join([*(x[1] for x in stack), key])
        parent = stack[-1][2] if stack else None
        if re.fullmatch(r"[|>][+-]?\d*", value):
            skip, text = depth, []
            for later in f.lines[n:]:
                if later.strip() and len(later) - len(later.lstrip()) <= depth:
                    break
                text.append(later.strip())
            f.entity("ConfigKey", path, f"{f.top}:{path}", n, parent=parent, body="\n".join(text).strip())
            continue
        flow = _flow(value) if value[:1] in ("{", "[") else value.strip("\"'")
        if isinstance(flow, dict):
            q = f.entity("ConfigSection", path, f"{f.top}:{path}", n, parent=parent)
            _flatten(f, flow, path, q, len(stack) + 1)
            continue
        if isinstance(flow, list):
            flow = f"[{len(flow)} items]"
        q = f.entity("ConfigKey" if value else "ConfigSection", path, f"{f.top}:{path}", n, parent=parent, body=flow or None)
        if not value:
            lists[q] = len(f.entities) - 1
        if len(stack) < 5:
            stack.append((depth, key, q))
    for e in f.entities:
        items = e.pop("_n", 0)
        e.pop("_item", None)
        if items:
            e.update(kind="ConfigKey", body=f"[{items} items]")


def _package(f: _File) -> None:
    data = tomllib.loads(f.content) if f.path.lower().endswith(".toml") else json.loads(f.content)
    own = data.get("package", data) if isinstance(data, dict) else {}
    name = str(own.get("name") or "unnamed")
    q = f.entity("Package", name, f"{f.repo}:package:{name}", body=str(own.get("version") or ""))
    for section in ("dependencies", "devDependencies", "peerDependencies", "dev-dependencies", "build-dependencies"):
        for dep, version in (data.get(section) or {}).items():
            d = f.entity("Dependency", dep, f"{f.top}:{section}:{dep}", parent=q, body=version if isinstance(version, str) else json.dumps(version, sort_keys=True))
            f.edge("depends_on_package", q, d)
    for script, command in (data.get("scripts") or {}).items():
        s = f.entity("Script", script, f"{f.top}:script:{script}", parent=q, body=str(command))
        f.edge("runs_script", q, s)


def _markdown(f: _File) -> None:
    front = re.match(r"---\n(.*?)\n---\n", f.content, re.S)
    stem = f.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    skill = None
    if front:
        meta = dict(x.split(":", 1) for x in front[1].split("\n") if ":" in x and not x.startswith(" "))
        kind = "SkillMOC" if meta.get("type", "").strip() == "moc" else "SkillNode"
        skill = f.entity(kind, meta.get("name", stem).strip(), f"{f.repo}:skill:{stem}", 1, len(f.lines), body=f.content[front.end() :], signature=meta.get("created", "").strip() or None)
    fence, parents, opened, text = None, [(0, f.top)], 0, []  # type: ignore[var-annotated]
    for n, line in enumerate(f.lines, 1):
        mark = re.match(r"\s*(```+|~~~+)\s*(\S*)", line)
        if mark:
            if fence is None:
                fence, opened, text = (mark[1][:3], mark[2]), n, []
            elif mark[1].startswith(fence[0]):
                f.entity("DocCodeBlock", fence[1] or "code", f"{f.top}:code:{opened}", opened, n, parents[-1][1], body="\n".join(text))
                fence = None
            continue
        if fence is not None:
            text.append(line)
            continue
        head = re.match(r"(#{1,6})\s+(.+?)\s*#*$", line)
        if head:
            level = len(head[1])
            while parents[-1][0] >= level:
                parents.pop()
            parents.append((level, f.entity("DocSection", head[2], f"{f.top}:{head[2]}:{n}", n, parent=parents[-1][1])))
        for link in re.finditer(r"(?<!!)\[([^\]\[]+)\]\(([^)\s]+)[^)]*\)", line):
            f.entity("DocLink", link[1], f"{f.top}:link:{n}:{link[2]}", n, parent=parents[-1][1], body=link[2])
        for w in re.finditer(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]", line) if skill else ():
            f.edge("links_to", skill, f"{f.repo}:skill:{w[1].strip()}", n, context=line.strip())


def _line_rules(f: _File, rules: list[tuple[re.Pattern[str], str]]) -> None:
    for rx, kind in rules:
        for m in rx.finditer(f.content):
            line = f.line_at(m.start())
            name = ".".join(g.strip("\"'`") for g in m.groups() if g)
            f.entity(kind, name, f"{f.top}:{kind}:{name}:{line}" if kind in ("DockerInstruction",) else f"{f.top}:{name}", line, body=m[0].strip())


_RULES = {
    "sql": [(re.compile(r"^\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?([\w.\"`]+)", re.I | re.M), "DbTable"), (re.compile(r"^\s*create\s+(?:unique\s+)?index\s+(?:concurrently\s+)?(?:if\s+not\s+exists\s+)?([\w.\"`]+)", re.I | re.M), "DbIndex"), (re.compile(r"^\s*create\s+(?:or\s+replace\s+)?(?:materialized\s+)?view\s+(?:if\s+not\s+exists\s+)?([\w.\"`]+)", re.I | re.M), "DbView")],
    "terraform": [(re.compile(r"^resource\s+\"([^\"]+)\"\s+\"([^\"]+)\"", re.M), "TerraformResource"), (re.compile(r"^variable\s+\"([^\"]+)\"", re.M), "TerraformVariable"), (re.compile(r"^provider\s+\"([^\"]+)\"", re.M), "TerraformProvider"), (re.compile(r"^module\s+\"([^\"]+)\"", re.M), "TerraformModule")],
    "protobuf": [(re.compile(r"^\s*message\s+(\w+)", re.M), "ProtoMessage"), (re.compile(r"^\s*service\s+(\w+)", re.M), "ProtoService"), (re.compile(r"^\s*rpc\s+(\w+)", re.M), "ProtoRpc")],
    "gradle": [(re.compile(r"^\s*id\s*\(?\s*['\"]([^'\"]+)['\"]", re.M), "GradlePlugin"), (re.compile(r"^\s*(?:implementation|api|testImplementation|compileOnly|runtimeOnly|kapt|annotationProcessor)\s*\(?\s*['\"]([^'\"]+)['\"]", re.M), "Dependency"), (re.compile(r"^\s*(?:tasks\.register\(['\"]|task\s+)(\w+)", re.M), "GradleTask")],
    "env": [(re.compile(r"^\s*(?:export\s+)?([A-Za-z_]\w*)\s*=", re.M), "EnvVar")],
    "dockerfile": [(re.compile(r"^\s*FROM\s+(\S+)(?:\s+AS\s+(\S+))?", re.I | re.M), "DockerStage"), (re.compile(r"^\s*(RUN|COPY|ADD|CMD|ENTRYPOINT|ENV|EXPOSE|WORKDIR|ARG|USER|VOLUME|LABEL)\b", re.M), "DockerInstruction")],
}


def _openapi(f: _File, data: dict) -> None:
    for path, methods in (data.get("paths") or {}).items():
        for method in methods if isinstance(methods, dict) else ():
            if method.lower() in _METHODS:
                f.entity("ApiEndpoint", f"{method.upper()} {path}", f"{f.repo}:api:{path}:{method.upper()}", method=method.upper(), url_pattern=path)
    schemas = (data.get("components") or {}).get("schemas") or data.get("definitions") or {}
    for name, schema in schemas.items():
        q = f.entity("ApiSchema", name, f"{f.top}:schema:{name}")
        for field in (schema.get("properties") or {}) if isinstance(schema, dict) else ():
            f.entity("ApiField", field, f"{q}:{field}", parent=q)


def parse(path: str, content: str, repo: str) -> tuple[list[dict], list[dict]]:
    """Entities and edges of one file; a file always gives its File entity."""
    content = content.replace("\r\n", "\n").replace("\r", "\n")
    language = language_of(path) or "text"
    f = _File(path, content, repo, language)
    f.entity("File", path.rsplit("/", 1)[-1], f.top, 1, len(f.lines))
    try:
        if language == "python":
            _python(f)
        elif language in _BRACES or language == "ruby":
            _pattern_code(f)
        elif language == "package":
            _package(f)
        elif language == "json":
            data = json.loads(content)
            if isinstance(data, dict) and ("openapi" in data or "swagger" in data):
                _openapi(f, data)
            else:
                _flatten(f, data, "", f.top)
        elif language == "toml":
            _flatten(f, tomllib.loads(content), "", f.top)
        elif language == "yaml":
            _yaml(f)
        elif language == "markdown":
            _markdown(f)
        elif language in SHAPES:
            _shaped(f)
        elif language in _RULES:
            _line_rules(f, _RULES[language])
        if language in _BRACES or language == "python":
            _http(f)
    except (SyntaxError, ValueError, RecursionError, AttributeError, TypeError):
        return f.entities[:1], []
    return f.entities, f.edges


def hunks(diff: str) -> Iterator[tuple[str, int, int]]:
    """(file, first line, lines) of the hunks of a unified diff; deleted files are left out, a missing count is 1."""
    current = None
    for line in diff.split("\n"):
        if line.startswith("+++ "):
            target = line[4:].split("\t")[0].strip()
            current = None if target == "/dev/null" else target.removeprefix("b/")
        elif current and (m := re.match(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", line)):
            yield current, int(m[1]), int(m[2]) if m[2] is not None else 1
