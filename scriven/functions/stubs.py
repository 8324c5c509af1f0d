"""Function bodies replaced by a stub, per language, over Arrow batches.

Literals and comments are blanked out first (same length), so that braces, keywords and ends
are found in code alone.  In languages with braces each function header (a pattern, then the
parameter list, then what may stand before a body) is followed by its body's matching brace;
in Python the body is what is indented deeper; in Ruby it ends at the ``end`` of its depth.
Only outermost functions are stubbed, as their bodies go whole; a declaration without a body,
an expression of one character, and code without functions stay as they are.  Null gives
null.  Everything is linear in the text.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .lexers import split_lines, texts_udf

BRACES, PYTHON, RUBY = "{ /* ... */ }", "    ...", "  # ..."
#: Languages whose code is only stripped of comments.
NOT_STUBBED = ("html", "css", "sql", "shell", "yaml")

_HASH_LITERALS = re.compile(r"\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\[\s\S])*+\"?|'(?:[^'\\\n]|\\[\s\S])*+'?|#[^\n]*+")
_SLASH = r"//[^\n]*+|/\*[\s\S]*?(?:\*/|\Z)|\"(?:[^\"\\]|\\[\s\S])*+\"?"
_C_LITERALS = re.compile(_SLASH + r"|`(?:[^`\\]|\\[\s\S])*+`?|'(?:[^'\\\n]|\\[\s\S])*+'")
_RUST_LITERALS = re.compile(_SLASH + r"|'(?:[^'\\\n]|\\[^\n]{1,8})'")
_KEPT = re.compile(r"[^\n]")
_SPACES = re.compile(r"\s*")


def mask(text: str, language: str) -> str:
    """The text with literals and comments blanked out, of the same length and lines."""
    pattern = _HASH_LITERALS if language in ("python", "ruby") else _RUST_LITERALS if language == "rust" else _C_LITERALS
    return pattern.sub(lambda m: _KEPT.sub(" ", m.group()), text)


_CONTROL = frozenset("if for while switch catch synchronized try return throw new do else using lock foreach fixed when sizeof typeof await yield function with super this assert guard match elif until unless delete case in of".split())
_GENERICS = r"(?:<[^(){};]*>\s*)?"
_NAMED = rf"(?<![\w.$])(?P<name>[A-Za-z_$#~][\w$]*)\s*{_GENERICS}\("
_TYPE = r"(?:\s*:[^{};=]*)?"

#: Header up to the parameter list's opening parenthesis.
_HEADS = {
    "rust": rf"\bfn\s+\w+\s*{_GENERICS}\(",
    "go": r"(?m)^func\s*(?:\([^()]*\)\s*)?\w+\s*(?:\[[^\]]*\]\s*)?\(",
    "php": r"\bfunction\s+&?\w+\s*\(",
    "kotlin": rf"\bfun\s+{_GENERICS}[\w.<>?]+\s*\(",
    "swift": rf"\b(?:func\s+[^\s(<]+\s*|init[?!]?\s*){_GENERICS}\(",
    "js": rf"\bfunction\b\s*\*?\s*[\w$]*\s*{_GENERICS}\(|{_NAMED}|=>",
    "java": _NAMED,
    "c": r"(?<![\w.])(?P<name>(?:[A-Za-z_~]\w*\s*::\s*)*(?:operator\s*[^\s(\w]+|[A-Za-z_~]\w*))\s*\(",
    "generic": rf"\b(?:fn|func|fun|function)\b\s*[\w$]*\s*{_GENERICS}\(|{_NAMED}",
}
#: What may stand between the parameter list and the body's opening brace.
_TAILS = {
    "rust": r"\s*(?:->[^;{}]*)?(?:\bwhere\b[^;{}]*)?\{",
    "go": r"[ \t]*(?:interface\{\}|struct\{\}|[^{};\n])*+\{",
    "php": rf"{_TYPE}\s*\{{",
    "kotlin": rf"{_TYPE}\s*\{{",
    "swift": r"[^{};=]*\{",
    "js": rf"{_TYPE}\s*\{{",
    "java": r"\s*(?:throws\s+[\w\s.,<>]+|where\b[^{};]*|:\s*(?:base|this)\s*\([^(){};]*\))?\s*\{",
    "c": r"(?:\s*(?:const|noexcept|override|final|volatile|mutable|&&?|->[^;{}]*|:(?!:)[^;{}]*))*+\s*\{",
    "generic": r"[^{};=]*\{",
}
_FAMILY = {"javascript": "js", "typescript": "js", "tsx": "js", "csharp": "java", "java": "java"}
_TOKENS = re.compile(r"[(){}\[\]]")
_CLOSE = {")": "(", "}": "{", "]": "["}
_BEFORE = re.compile(r"(?:([A-Za-z_$][\w$]*)|(\S))\s*\Z")


@lru_cache(maxsize=32)
def _grammar(language: str) -> tuple[str, re.Pattern, re.Pattern]:
    family = _FAMILY.get(language, language if language in _HEADS else "generic")
    return family, re.compile(_HEADS[family]), re.compile(_TAILS[family])


def _pairs(code: str) -> dict[int, int]:
    """Where each opening bracket is closed."""
    out: dict[int, int] = {}
    stack: list[int] = []
    for m in _TOKENS.finditer(code):
        c = m.group()
        if c in "({[":
            stack.append(m.start())
        elif stack:
            while stack and code[stack[-1]] != _CLOSE[c]:
                stack.pop()
            if stack:
                out[stack.pop()] = m.start()
    return out


def _is_declared(code: str, start: int, family: str) -> bool:
    """Whether what stands before a name lets it be a declaration's: a type or modifier, or a statement's beginning."""
    before = _BEFORE.search(code[max(0, start - 80) : start])
    if before is None:
        return True
    word, sign = before.groups()
    if word:
        return word not in _CONTROL or word in ("async", "get", "set", "static")
    return sign in (";}{>]*&)@," if family == "js" else ";}{>]*&)?")


def _arrow_end(code: str, at: int, pairs: dict[int, int]) -> int:
    """End of an arrow function's expression that begins at ``at``."""
    n = len(code)
    while at < n:
        c = code[at]
        if c in "({[":
            at = pairs.get(at, n)
        elif c in ",;)}]\n":
            return at
        at += 1
    return n


def bodies(text: str, language: str) -> list[tuple[int, int]]:
    """(begin, end) of the outermost function bodies of a language with braces, braces included."""
    family, head, tail = _grammar(language)
    code = mask(text, language)
    pairs, out, at = _pairs(code), [], 0
    while m := head.search(code, at):
        at = m.end()
        if m.group() == "=>":
            begin = _SPACES.match(code, at).end()
            end = pairs[begin] + 1 if begin < len(code) and code[begin] == "{" and begin in pairs else _arrow_end(code, begin, pairs)
            line = code[code.rfind("\n", 0, m.start()) + 1 : m.start()].lstrip()
            if line.startswith(("type ", "interface ", "declare ", "export type ")):
                continue
        else:
            name = m.groupdict().get("name")
            if name is not None and (name in _CONTROL or not _is_declared(code, m.start(), family)):
                continue
            close = pairs.get(m.end() - 1)
            if close is None:
                continue
            t = tail.match(code, close + 1)
            if t is None or t.end() - 1 not in pairs:
                continue
            begin, end = t.end() - 1, pairs[t.end() - 1] + 1
        if end - begin > 1:
            out.append((begin, end))
        at = max(at, end)
    return out


def stub_braces(text: str, language: str) -> str:
    out, at = [], 0
    for begin, end in bodies(text, language):
        out += [text[at:begin], BRACES]
        at = end
    return "".join([*out, text[at:]])


def _width(line: str) -> int:
    return len(line) - len(line.lstrip())


_DEF = re.compile(r"\s*(?:async\s+)?def\s")


def stub_python(text: str) -> str:
    """Headers stay as written, bodies become one line of three dots."""
    rows, code = split_lines(text), split_lines(mask(text, "python"))
    out, i = [], 0
    while i < len(rows):
        if not _DEF.match(code[i]):
            out.append(rows[i])
            i += 1
            continue
        own, depth, j, end = _width(rows[i]), 0, i, -1
        while j < len(rows) and end < 0:
            for k, c in enumerate(code[j]):
                if c in "([{":
                    depth += 1
                elif c in ")]}":
                    depth -= 1
                elif c == ":" and depth <= 0:
                    end = k
                    break
            j += 1
        if end < 0:
            out.append(rows[i])
            i += 1
            continue
        stop = body = j
        while body < len(rows):  # a line that only a string fills is blank in code but not in the text
            if rows[body].strip():
                if _width(rows[body]) <= own and code[body].strip():
                    break
                if _width(rows[body]) <= own and not rows[body].lstrip().startswith("#"):
                    stop = body + 1  # inside of a string
                elif _width(rows[body]) > own:
                    stop = body + 1
                else:
                    break
            body += 1
        out += rows[i : j - 1] + [rows[j - 1][: end + 1], " " * own + PYTHON]
        i = stop
    return "\n".join(out)


_OPEN = re.compile(r"^\s*(?:def|class|module|if|unless|while|until|case|begin|for)\b|\bdo\b\s*(?:\|[^|]*\|)?\s*$|=\s*(?:if|unless|case|begin)\b")
_ENDLESS = re.compile(r"^\s*def\s+[\w.?!]+\s*(?:\([^)]*\))?\s*=(?!=)")
_ONE_LINE = re.compile(r";\s*end\s*$")


def stub_ruby(text: str) -> str:
    rows, code = split_lines(text), split_lines(mask(text, "ruby"))
    out, i = [], 0
    while i < len(rows):
        out.append(rows[i])
        line = code[i]
        i += 1
        if not re.match(r"\s*def\s", line) or _ENDLESS.match(line) or _ONE_LINE.search(line):
            continue
        depth, j = 1, i
        while j < len(rows):
            if re.match(r"\s*end\b", code[j]):
                depth -= 1
                if not depth:
                    break
            elif _OPEN.search(code[j]) and not _ENDLESS.match(code[j]) and not re.search(r"\bend\s*$", code[j]):
                depth += 1
            j += 1
        if j < len(rows) and any(r.strip() for r in rows[i:j]):
            out.append(" " * _width(rows[i - 1]) + RUBY)
            i = j
    return "\n".join(out)


def stub(text: str, language: str) -> str:
    if language == "python":
        return stub_python(text)
    return stub_ruby(text) if language == "ruby" else stub_braces(text, language)


def stub_bodies(text: Column, language: str) -> Column:
    """The text with the bodies of one language's functions replaced."""
    return texts_udf(lambda t: stub(t, language))(text)


@F.arrow_udf(StringType())
def stub_each(texts: pa.Array, languages: pa.Array) -> pa.Array:
    """Each text by its own language; null for a null text."""
    return pa.array([None if t is None else stub(t, x or "generic") for t, x in zip(texts.to_pylist(), languages.to_pylist())], pa.string())
