"""Patterns of definitions for languages that are parsed without a grammar of their own.

A ``Shape`` says how a block of the language ends ('brace' at the matching bracket,
'end' at the word on the definition's indent, 'paren' at the matching parenthesis,
'next' before the next definition at the same indent, 'line' with its line), and how
its functions, types and imports start.  A pattern names what it finds ``name``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Shape:
    extensions: tuple[str, ...]
    block: str
    function: re.Pattern[str] | None
    type: re.Pattern[str] | None = None
    imports: re.Pattern[str] | None = None
    end: str = "end"


def _p(pattern: str, flags: int = 0) -> re.Pattern[str]:
    return re.compile(pattern, re.M | flags)


_BRACE_FUNCTION = r"^[ \t]*(?:[\w:<>,\[\]?*&]+[ \t]+)+(?P<name>\w+)\s*\([^;{}]*\)\s*(?:\w+\s*)*\{"
_LISP = r"^[ \t]*\((?:defun|defmacro|defmethod|defgeneric)\s+(?P<name>[^\s()]+)"
_SCHEME = r"^[ \t]*\(define(?:-syntax)?\s+\(?(?P<name>[^\s()]+)"

SHAPES: dict[str, Shape] = {
    "lua": Shape(("lua",), "end", _p(r"^[ \t]*(?:local\s+)?function\s+(?:[\w.]+[.:])?(?P<name>\w+)\s*\("), None, _p(r"^[^\n]*\brequire\s*\(?\s*['\"][^'\"]+['\"]\)?")),
    "zig": Shape(("zig",), "brace", _p(r"^[ \t]*(?:pub\s+)?(?:export\s+|inline\s+|extern\s+)*fn\s+(?P<name>\w+)"), _p(r"^[ \t]*(?:pub\s+)?const\s+(?P<name>\w+)\s*=\s*(?:packed\s+|extern\s+)?(?P<kind>struct|enum|union)\b"), _p(r"^[^\n]*@import\(\"[^\"]+\"\)")),
    "elixir": Shape(("ex", "exs"), "end", _p(r"^[ \t]*(?:def|defp|defmacro)\s+(?P<name>\w+[?!]?)"), _p(r"^[ \t]*defmodule\s+(?P<name>[\w.]+)"), _p(r"^[ \t]*(?:import|alias|use|require)\s+[\w.]+")),
    "haskell": Shape(("hs",), "next", _p(r"^(?P<name>[a-z_]\w*'*)\s*::"), _p(r"^(?:data|newtype|class|type)\s+(?:\([^)]*\)\s*=>\s*|[\w ]+=>\s*)?(?P<name>[A-Z]\w*)"), _p(r"^import\s+[^\n]+")),
    "elm": Shape(("elm",), "next", _p(r"^(?P<name>[a-z]\w*)\s*:"), _p(r"^type\s+(?:alias\s+)?(?P<name>[A-Z]\w*)"), _p(r"^import\s+[^\n]+")),
    "ocaml": Shape(("ml", "mli"), "next", _p(r"^[ \t]*(?:let|and)\s+(?:rec\s+)?(?P<name>[a-z_]\w*)"), _p(r"^[ \t]*(?:type|module|class)\s+(?P<name>\w+)"), _p(r"^[ \t]*open\s+[\w.]+")),
    "julia": Shape(("jl",), "end", _p(r"^[ \t]*(?:function|macro)\s+(?:\w+\.)?(?P<name>\w+!?)"), _p(r"^[ \t]*(?:mutable\s+)?struct\s+(?P<name>\w+)"), _p(r"^[ \t]*(?:using|import)\s+[^\n]+")),
    "shell": Shape(("sh", "bash", "zsh"), "brace", _p(r"^[ \t]*(?:function\s+)?(?P<name>[\w-]+)\s*\(\)\s*\{?"), None, _p(r"^[ \t]*(?:source|\.)\s+\S+")),
    "r": Shape(("r",), "brace", _p(r"^[ \t]*(?P<name>[\w.]+)\s*(?:<-|=)\s*function\s*\("), None, _p(r"^[ \t]*(?:library|require)\([^)]*\)")),
    "css": Shape(("css", "scss", "less"), "brace", None, None, _p(r"^[ \t]*@(?:import|use)\s+[^;\n]+;")),
    "erlang": Shape(("erl", "hrl"), "next", _p(r"^(?P<name>[a-z]\w*)\([^\n]*->"), _p(r"^-record\((?P<name>\w+)"), _p(r"^-(?:import|include|include_lib)\([^\n]*\)\.")),
    "objc": Shape(("m", "mm"), "brace", _p(r"^[ \t]*[-+]\s*\([^)]*\)\s*(?P<name>\w+)"), _p(r"^@(?P<kind>interface|protocol|implementation)\s+(?P<name>\w+)"), _p(r"^[ \t]*[#@]import\s+[^\n]+")),
    "nix": Shape(("nix",), "line", _p(r"^[ \t]*(?P<name>[\w-]+)\s*=\s*(?:\w+|\{[^}\n]*\})\s*:"), None, _p(r"^[^\n]*\bimport\s+[./<][^\s;]+")),
    "cmake": Shape(("cmake",), "end", _p(r"^[ \t]*(?:function|macro)\s*\(\s*(?P<name>\w+)", re.I), None, _p(r"^[ \t]*(?:include|find_package)\s*\([^)]*\)", re.I), r"end(?:function|macro)"),
    "make": Shape(("mk",), "next", _p(r"^(?P<name>[\w./%-]+)\s*:(?!=)"), None, _p(r"^-?include\s+[^\n]+")),
    "verilog": Shape(("v", "sv"), "end", _p(r"^[ \t]*(?:function|task)\s+(?:automatic\s+)?(?:[\w\[\]:]+\s+)?(?P<name>\w+)"), _p(r"^[ \t]*module\s+(?P<name>\w+)"), _p(r"^[ \t]*`include\s+\"[^\"]+\""), r"end(?:function|task|module)"),
    "fortran": Shape(("f90", "f95", "f03", "for"), "end", _p(r"^[ \t]*(?!end\b)(?:[\w() ]+\s+)?(?:subroutine|function)\s+(?P<name>\w+)", re.I), _p(r"^[ \t]*(?:module|type)(?:\s*::)?\s+(?P<name>(?!procedure)\w+)", re.I), _p(r"^[ \t]*use\s+\w+", re.I)),
    "glsl": Shape(("glsl", "vert", "frag", "comp"), "brace", _p(_BRACE_FUNCTION), _p(r"^[ \t]*(?P<kind>struct)\s+(?P<name>\w+)"), _p(r"^[ \t]*#include\s+[^\n]+")),
    "graphql": Shape(("graphql", "gql"), "brace", _p(r"^[ \t]*(?:query|mutation|subscription|fragment)\s+(?P<name>\w+)"), _p(r"^[ \t]*(?:type|input|interface|enum|union|scalar)\s+(?P<name>\w+)")),
    "d": Shape(("d",), "brace", _p(_BRACE_FUNCTION), _p(r"^[ \t]*(?P<kind>class|struct|interface|enum)\s+(?P<name>\w+)"), _p(r"^[ \t]*import\s+[\w.:, ]+;")),
    "solidity": Shape(("sol",), "brace", _p(r"^[ \t]*(?:function|modifier)\s+(?P<name>\w+)"), _p(r"^[ \t]*(?:abstract\s+)?(?P<kind>contract|library|interface|struct|enum)\s+(?P<name>\w+)"), _p(r"^[ \t]*import\s+[^;\n]+;")),
    "gdscript": Shape(("gd",), "next", _p(r"^[ \t]*(?:static\s+)?func\s+(?P<name>\w+)"), _p(r"^[ \t]*class(?:_name)?\s+(?P<name>\w+)"), _p(r"^[^\n]*\bpreload\([^)]*\)")),
    "groovy": Shape(("groovy",), "brace", _p(r"^[ \t]*(?:(?:def|static|public|private|void|[A-Z]\w*)\s+)+(?P<name>\w+)\s*\([^;{}]*\)\s*\{"), _p(r"^[ \t]*(?:abstract\s+)?(?P<kind>class|interface|trait|enum)\s+(?P<name>\w+)"), _p(r"^[ \t]*import\s+[^\n]+")),
    "pascal": Shape(("pas", "pp"), "end", _p(r"^[ \t]*(?:procedure|function|constructor|destructor)\s+(?:\w+\.)?(?P<name>\w+)", re.I), _p(r"^[ \t]*(?P<name>\w+)\s*=\s*(?:class|record|interface)\b", re.I), _p(r"^[ \t]*uses\s+[^;]+;", re.I), r"end;"),
    "ada": Shape(("adb", "ads"), "end", _p(r"^[ \t]*(?:procedure|function)\s+(?P<name>\w+)", re.I), _p(r"^[ \t]*(?:package(?:\s+body)?|type)\s+(?P<name>\w+)", re.I), _p(r"^[ \t]*(?:with|use)\s+[\w., ]+;", re.I)),
    "commonlisp": Shape(("lisp", "cl"), "paren", _p(_LISP), _p(r"^[ \t]*\((?:defclass|defstruct)\s+\(?(?P<name>[^\s()]+)"), _p(r"^[ \t]*\((?:require|use-package|ql:quickload)[^)\n]*\)")),
    "scheme": Shape(("scm", "ss"), "paren", _p(_SCHEME), None, _p(r"^[ \t]*\(import[^\n]*\)")),
    "racket": Shape(("rkt",), "paren", _p(_SCHEME), _p(r"^[ \t]*\(struct\s+(?P<name>[^\s()]+)"), _p(r"^[ \t]*\(require[^\n]*\)")),
    "html": Shape(("html", "htm"), "line", None, None, _p(r"<(?:script[^>]+src|link[^>]+href)\s*=\s*['\"][^'\"]+['\"]", re.I)),
    "xml": Shape(("xml", "xsd", "svg"), "line", None, _p(r"<xs:(?:element|complexType|simpleType)\s+name=\"(?P<name>[^\"]+)\"")),
}


def block_end(shape: Shape, text: str, start: int, after: int) -> int:
    """The offset after the block of a definition that starts at ``start`` and whose head ends at ``after``."""
    line_end = text.find("\n", after)
    line_end = len(text) if line_end < 0 else line_end
    if shape.block == "line":
        return line_end
    if shape.block in ("brace", "paren"):
        up, down = "{}" if shape.block == "brace" else "()"
        depth = 0
        for m in re.compile(rf"[{re.escape(up + down)}]").finditer(text, start):
            depth += 1 if m[0] == up else -1
            if depth <= 0:
                return m.end()
        return len(text)
    indent = re.match(r"[ \t]*", text[text.rfind("\n", 0, start) + 1 :])[0]  # type: ignore[index]
    if shape.block == "end":
        # where blocks say what they end, the word of the head decides
        word = re.search(r"\b(subroutine|function|module|type|macro|task)\b", text[start:after], re.I)
        m = re.compile(rf"^{indent}end\s*{word[1]}\b[^\n]*", re.M | re.I).search(text, line_end) if word else None
        if m:
            return m.end()
        m = re.compile(rf"^{indent}{shape.end}\b[^\n]*" if not shape.end.endswith(";") else rf"^{indent}{shape.end}", re.M | re.I).search(text, line_end)
        return m.end() if m else line_end
    m = re.compile(rf"^{indent}[^\s#%\-|=(]", re.M).search(text, line_end + 1)
    name = re.match(r"[ \t]*(\S+)", text[start:])
    while m and name and text.startswith(name[1], m.start()):  # equations of one function
        m = re.compile(rf"^{indent}[^\s#%\-|=(]", re.M).search(text, m.end())
    return m.start() if m else len(text)
