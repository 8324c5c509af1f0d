"""What a document is: code of some language, JSON, logs, a diff or text.

Rules are tried in a fixed order and the first that fits decides.  A null text has no type;
an empty one is text.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import lines as L

CODE, JSON, LOGS, DIFF, TEXT = "code", "json", "logs", "diff", "text"

#: Extension to (type, language).
EXTENSIONS: dict[str, tuple[str, str | None]] = {
    ext: (CODE, language)
    for language, group in {
        "rust": "rs", "python": "py", "javascript": "js jsx mjs cjs", "typescript": "ts", "tsx": "tsx", "go": "go",
        "ruby": "rb rake gemspec", "java": "java", "c": "c cpp cc cxx h hpp hxx", "csharp": "cs", "php": "php phtml php5",
        "swift": "swift", "kotlin": "kt kts", "html": "html htm", "css": "css", "sql": "sql", "shell": "sh bash zsh fish", "yaml": "yaml yml",
    }.items()
    for ext in group.split()
} | {"json": (JSON, None), "jsonc": (JSON, None), "log": (LOGS, None), "diff": (DIFF, None), "patch": (DIFF, None)}

#: Names that force a type.
ALIASES: dict[str, tuple[str, str | None]] = {
    alias: (CODE, language)
    for language, group in {
        "rust": "rust rs", "python": "python py", "javascript": "javascript js", "typescript": "typescript ts", "tsx": "tsx", "go": "go",
        "ruby": "ruby rb", "java": "java", "c": "c cpp c++", "csharp": "csharp cs c#", "php": "php", "swift": "swift", "kotlin": "kotlin kt",
        "html": "html htm", "css": "css", "sql": "sql", "shell": "shell sh bash", "yaml": "yaml yml", "generic": "code generic",
    }.items()
    for alias in group.split()
} | {"json": (JSON, None), "logs": (LOGS, None), "log": (LOGS, None), "diff": (DIFF, None), "patch": (DIFF, None), "text": (TEXT, None), "txt": (TEXT, None)}

SIGNALS = ("ERROR", "WARN", "INFO", "DEBUG", "TRACE", "[error]", "[warn]", "[info]", "[debug]", "level=", "msg=", "timestamp=")
GENERIC = ("fn ", "impl ", "struct ", "enum ", "trait ", "def ", "class ", "import ", "#include")
#: In order: (language, all of these groups must have a member that occurs).
WORDS: tuple[tuple[str, tuple[tuple[str, ...], ...]], ...] = (
    ("c", (("#include", "#define", "#pragma"),)),
    ("rust", (("fn ",), ("let ", "impl ", "use "))),
    ("typescript", (("interface ", ": string", ": number"),)),
    ("kotlin", (("fun ",), ("val ", "var ", "data class"))),
    ("swift", (("import Foundation", "import UIKit", "import SwiftUI"),)),
    ("java", (("public class ", "import java.", "@Override", "System.out.println"),)),
    ("ruby", (("def ",), ("end",), ("require ", "attr_"))),
    ("python", (("def ",), ("self", "import "))),
    ("go", (("func ",), ("package ",))),
    ("javascript", (("const ", "function ", "export "),)),
)
VERBS = ("SELECT ", "INSERT ", "UPDATE ", "DELETE ", "CREATE ", "DROP ", "ALTER ")
DOCTYPES = ("<!DOCTYPE", "<!doctype", "<html", "<HTML")
MAX_DEPTH = 128
#: Changes with the words above: what is kept by text alone is kept under it.
RULES = hashlib.sha256(repr((SIGNALS, GENERIC, WORDS, VERBS, DOCTYPES, MAX_DEPTH)).encode()).hexdigest()[:16]


class UnknownType(ValueError):
    """A type that no alias names."""


def parse_type(name: str) -> tuple[str, str | None]:
    """(type, language) that an alias means."""
    try:
        return ALIASES[name]
    except KeyError:
        raise UnknownType(f"unknown content type: {name}") from None


def _refuse(name: str):
    raise ValueError(name)


def _integer(digits: str) -> int | float:
    return int(digits) if len(digits) < 20 else float(digits)


def _too_deep(value: object) -> bool:
    layer, depth = [value], 0
    while layer:
        depth += 1
        layer = [y for x in layer if isinstance(x, (dict, list)) for y in (x.values() if isinstance(x, dict) else x)]
        if depth > MAX_DEPTH:
            return True
    return False


def load_json(text: str) -> object:
    """Strict JSON: no NaN, no lone surrogates; ValueError otherwise."""
    try:
        value = json.loads(text, parse_constant=_refuse, parse_int=_integer)
    except RecursionError:
        raise ValueError("too deep") from None
    if _too_deep(value):
        raise ValueError("too deep")
    return value


def left(text: Column) -> Column:
    return F.ltrim(text, F.lit(L.WHITE))


# Types are found in the text's UTF-8, one pass of bytes.find a word: some ten times faster than
# as many F.contains, and no pattern runs over lines unless a signal occurs somewhere.
_BLANKS = re.compile(b"(?:" + b"|".join(re.escape(c.encode()) for c in L.WHITE) + b")*+")
_bytes = lambda words: tuple(w.encode() for w in words)
_SIGNALS, _GENERIC, _DOCTYPES = _bytes(SIGNALS), _bytes(GENERIC), _bytes(DOCTYPES)
_WORDS = tuple((name, tuple(map(_bytes, groups))) for name, groups in WORDS)


def _any(text: bytes, words: tuple[bytes, ...]) -> bool:
    return any(w in text for w in words)


def is_diff(text: bytes) -> bool:
    return text.startswith((b"diff --git", b"--- ")) or (b"\n+++ " in text and b"\n--- " in text)


def is_json(text: bytes, head: int) -> bool:
    """Only texts that begin like an object or array are parsed."""
    if text[head : head + 1] not in (b"{", b"["):
        return False
    try:
        load_json(text.decode())
    except ValueError:
        return False
    return True


def is_logs(text: bytes) -> bool:
    """Three lines or more, and a signal in over 30 % of them."""
    if not _any(text, _SIGNALS):
        return False
    lines = text.split(b"\n")
    if not lines[-1]:
        lines.pop()
    return len(lines) >= 3 and sum(_any(x, _SIGNALS) for x in lines) * 10 > len(lines) * 3


def language(text: bytes, head: int) -> str | None:
    """Language of source code by its words, None if nothing fits."""
    if text.startswith(_DOCTYPES, head):
        return "html"
    if text.startswith(b"#!/"):
        return "shell"
    if text[head : head + 32].decode(errors="replace")[:8].upper().startswith(VERBS):
        return "sql"
    for name, groups in _WORDS:
        if all(_any(text, g) for g in groups):
            return name
    return "generic" if sum(w in text for w in _GENERIC) >= 2 else None


def type_of(text: bytes) -> tuple[str, str | None]:
    """(type, language) of a text in UTF-8."""
    if is_diff(text):
        return DIFF, None
    head = _BLANKS.match(text).end()
    if is_json(text, head):
        return JSON, None
    if is_logs(text):
        return LOGS, None
    lang = language(text, head)
    return (TEXT, None) if lang is None else (CODE, lang)


@F.arrow_udf(StructType([StructField("content_type", StringType()), StructField("language", StringType())]))
def _types(texts: pa.Array) -> pa.Array:
    kinds, languages, null = [], [], []
    for x in texts.cast(pa.binary()):  # one text at a time
        t = x.as_py()
        kind, lang = (None, None) if t is None else type_of(t)
        kinds.append(kind)
        languages.append(lang)
        null.append(t is None)
    return pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(languages, pa.string())], ["content_type", "language"], mask=pa.array(null, pa.bool_()))


# Not declared deterministic: the optimizer then computes a type once, where it would run over
# the text for every expression that names it.
_types = _types.asNondeterministic()


def by_content(text: Column) -> Column:
    """STRUCT<content_type, language> of a text."""
    return _types(text)


def extension(path: Column) -> Column:
    """What follows the last full stop of the file's name; empty if there is none or it begins the name."""
    return F.regexp_extract(path, r"(?s)[^/.][^/]*\.([^./]*)\z", 1)


def declared(path: Column | None = None, forced: str | None = None) -> Column:
    """STRUCT<content_type, language> that a forced type or else the path's extension gives; null where the content decides."""
    one = lambda kind, lang: F.struct(F.lit(kind).cast("string").alias("content_type"), F.lit(lang).cast("string").alias("language"))
    if forced is not None:
        return one(*parse_type(forced))
    if path is None:
        return F.when(F.lit(False), one(None, None))
    return F.try_element_at(F.create_map(*[x for ext, found in EXTENSIONS.items() for x in (F.lit(ext), one(*found))]), extension(path))


def by_path(path: Column, text: Column) -> Column:
    """STRUCT<content_type, language> by the extension, else by content."""
    known = declared(path)
    return F.coalesce(known, by_content(F.when(known.isNull(), text)))


def resolve(text: Column, path: Column | None = None, forced: str | None = None) -> Column:
    """A forced type comes before the path's, and that before the content's."""
    if forced is not None:
        return declared(forced=forced)
    return by_content(text) if path is None else by_path(path, text)


def display(kind: Column, lang: Column) -> Column:
    """``code(rust)`` for code, the type for the rest."""
    return F.when((kind == CODE) & lang.isNotNull(), F.format_string("code(%s)", lang)).otherwise(kind)


def label(kind: Column, lang: Column) -> Column:
    """The language of code, the type of the rest: what reports group by."""
    return F.coalesce(lang, kind)
