"""Comment removal for source code.

C-like languages, HTML, CSS and SQL are one regular expression each, whose parts are all
possessive: linear, and safe for the stack on texts of any length.  A comment leaves up to two
of its line feeds behind, which is as many as count once blank lines are collapsed.  Python,
Ruby, shell and YAML need the line built so far or quoting by line, and run over Arrow
batches.  Null gives null.  Every language collapses blank lines last.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import lines as L
from .batches import mapped

#: A quoted literal with backslash escapes; an unterminated one runs to the end.
_LITERALS = "|".join(rf"{q}[^{q}\\]*+(?:\\[\s\S][^{q}\\]*+)*+(?:{q}|\\?\z)" for q in "\"'`")
_BLOCK = r"/\*N(?:(\n)N(?:(\n)(?:[^*]|\*(?!/))*+)?+)?+(?:\*/|\z)".replace("N", r"(?:[^*\n]|\*(?!/))*+")


def _open_block(begin: str, first: str, rest: str, left: int) -> str:
    """A block comment ended by first+rest; unterminated, it leaves its last ``left`` characters."""
    more = rf"(?=[\s\S]{{{left}}})"
    n = rf"(?:[^{first}\n]{more}|{first}(?!{rest}){more})*+"
    tail = rf"(?:[^{first}]{more}|{first}(?!{rest}){more})*+"
    return rf"{begin}{n}(?:(\n){more}{n}(?:(\n){more}{tail})?+)?+(?:{first}{rest})?+"


def _cstyle_pattern(docs: str) -> str:
    return rf"({_LITERALS}{docs})|//[^\n]*+|{_BLOCK}"


CSTYLE = _cstyle_pattern("")
DOCS = {"rust": r"|//[/!][^\n]*+", "swift": r"|///[^\n]*+"}
HTML = _open_block("<!--", "-", "->", 2)
CSS = _open_block(r"/\*", r"\*", "/", 1).replace(r"[^\*", "[^*")
SQL = rf"('[^']*+'?+)|--[^\n]*+|{CSS}"


def cstyle(text: Column, language: str = "generic", strip_docs: bool = False) -> Column:
    """// and /* */ comments outside "", '' and `` literals; Rust's and Swift's doc comments stay unless asked for."""
    docs = "" if strip_docs else DOCS.get(language, "")
    return L.collapse_blank_lines(F.regexp_replace(text, _cstyle_pattern(docs), "$1$2$3"))


def html(text: Column) -> Column:
    return L.collapse_blank_lines(F.regexp_replace(text, HTML, "$1$2"))


def css(text: Column) -> Column:
    """/* */ only: // may stand in an address."""
    return L.collapse_blank_lines(F.regexp_replace(text, CSS, "$1$2"))


def sql(text: Column) -> Column:
    return L.collapse_blank_lines(F.regexp_replace(text, SQL, "$1$2$3"))


# ---------------------------------------------------------------- by line or with a state: plain functions

_WHITE = L.WHITE


def split_lines(text: str) -> list[str]:
    parts = text.split("\n")
    if parts[-1] == "":
        parts.pop()
    return [p[:-1] if p.endswith("\r") else p for p in parts]


def collapse(text: str) -> str:
    """lines.collapse_blank_lines for one string."""
    out: list[str] = []
    for line in split_lines(text):
        if line.strip(_WHITE):
            out.append(line)
        elif out and out[-1]:
            out.append("")
    if out and not out[-1]:
        out.pop()
    return "\n".join(out)


_PY = re.compile(r"\"\"\"|'''|[\"'#]")
_PY_REST = {q: re.compile(rf"[^{q}\\]*+(?:\\[\s\S][^{q}\\]*+)*+(?:{q}|\\?\Z)") for q in "\"'"}


def strip_python(text: str) -> str:
    """Comments go; a triple-quoted string goes where its line has nothing before it."""
    out: list[str] = []
    at, n, blank = 0, len(text), True

    def put(part: str) -> None:
        nonlocal blank
        out.append(part)
        tail = part.rpartition("\n")
        blank = (blank or bool(tail[1])) and not tail[2].strip(_WHITE)

    while found := _PY.search(text, at):
        begin, mark = found.start(), found.group()
        put(text[at:begin])
        if mark == "#":
            at = text.find("\n", begin)
            at = n if at < 0 else at
        elif len(mark) == 3:
            end = text.find(mark, begin + 3)
            body = text[begin + 3 : end] if end >= 0 else text[begin + 3 : max(begin + 3, n - 2)]
            put("\n" * body.count("\n") if blank else mark + body + mark)
            at = n if end < 0 else end + 3
        else:
            at = _PY_REST[mark].match(text, begin + 1).end()
            put(text[begin:at])
    out.append(text[at:])
    return collapse("".join(out))


_QUOTED = r'"(?:[^"\\]|\\[\s\S]|\\\Z)*+"?+'
_INLINE = {
    "ruby": re.compile(rf"(?:[^\"'#]|{_QUOTED}|{_QUOTED.replace(chr(34), chr(39))})*+"),
    "shell": re.compile(rf"(?:[^\"'#]|{_QUOTED}|'[^']*+'?+)*+"),
    "yaml": re.compile(rf"(?:[^\"'#]|(?<![ \t])#|{_QUOTED}|'(?:[^']|'')*+'?+)*+"),
}


def _inline(line: str, language: str) -> str:
    if "#" not in line:
        return line
    end = _INLINE[language].match(line).end()
    return line if end == len(line) else line[:end].rstrip(_WHITE)


def strip_ruby(text: str) -> str:
    out, inside = [], False
    for line in split_lines(text):
        if line.startswith(("=begin", "=end")):
            inside = line.startswith("=begin")
            out.append("")
        elif not inside and line.startswith("#!"):
            out.append(line)
        elif inside or line.lstrip(_WHITE).startswith("#"):
            out.append("")
        else:
            out.append(_inline(line, "ruby"))
    return collapse("\n".join(out).rstrip(_WHITE))


def strip_shell(text: str) -> str:
    out, first = [], True
    for line in split_lines(text):
        head = line.lstrip(_WHITE)
        if first and line.startswith("#!"):
            out.append(line)
        else:
            out.append("" if head.startswith("#") else _inline(line, "shell"))
        first = first and not head
    return collapse("\n".join(out).rstrip(_WHITE))


def strip_yaml(text: str) -> str:
    return collapse("\n".join("" if x.lstrip(_WHITE).startswith("#") else _inline(x, "yaml") for x in split_lines(text)).rstrip(_WHITE))


def _sub(pattern: str) -> Callable[[str], str]:
    found = re.compile(pattern.replace(r"\z", r"\Z"))
    return lambda text: collapse(found.sub(lambda m: "".join(g or "" for g in m.groups()), text))


_STRIP = {"html": _sub(HTML), "css": _sub(CSS), "sql": _sub(SQL), "python": strip_python, "ruby": strip_ruby, "shell": strip_shell, "yaml": strip_yaml}
_C_LIKE = _sub(CSTYLE)
_WITH_DOCS = {k: _sub(_cstyle_pattern(v)) for k, v in DOCS.items()}


def strip_text(text: str, language: str | None, strip_docs: bool = False) -> str:
    """``strip`` for one string."""
    own = _STRIP.get(language) or (None if strip_docs else _WITH_DOCS.get(language)) or _C_LIKE
    return own(text)


def texts_udf(fn: Callable[[str], str]) -> Callable[[Column], Column]:
    """A string function over Arrow batches; null gives null."""

    @F.arrow_udf(StringType())
    def run(texts: pa.Array) -> pa.Array:
        return mapped(fn, pa.string(), texts)

    return run


python, ruby, shell, yaml = map(texts_udf, (strip_python, strip_ruby, strip_shell, strip_yaml))

_OWN: dict[str, Callable[[Column], Column]] = {"python": python, "ruby": ruby, "shell": shell, "yaml": yaml, "html": html, "css": css, "sql": sql}


def strip(text: Column, language: str, strip_docs: bool = False) -> Column:
    """Source code of a language without its comments; unknown languages are C-like."""
    own = _OWN.get(language)
    return own(text) if own else cstyle(text, language, strip_docs)
