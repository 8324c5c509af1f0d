"""Text and line helpers as column expressions; none of them shuffles.

Lines end at a line feed; one carriage return before it is dropped, and no empty line follows
a final line feed.  An empty text has no lines.  A null text gives null everywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of Unicode's White_Space property.
WHITE = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
#: The same as a regular expression's class, for Java and RE2 alike.
WHITE_CLASS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def is_blank(text: Column) -> Column:
    return trim(text) == ""


def lines(text: Column) -> Column:
    """The lines of a text."""

    def cut(parts: Column) -> Column:
        return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)

    plain = bind(F.split(text, "\n", -1), cut)
    return F.when(F.contains(text, F.lit("\r")), F.transform(plain, lambda x: F.regexp_replace(x, r"\r\z", ""))).otherwise(plain)


def join(parts: Column, separator: str = "\n") -> Column:
    return F.array_join(parts, separator)


def indent(line: Column) -> Column:
    """White space that a line begins with."""
    return F.substring(line, F.lit(1), F.length(line) - F.length(F.ltrim(line, F.lit(WHITE))))


def collapse_blank_lines(text: Column) -> Column:
    """Runs of blank lines become one empty line; none is left at either end, and no final line feed.

    Linear in the text: three expressions over its lines.
    """

    def kept(all_lines: Column) -> Column:
        return F.filter(
            F.transform(all_lines, lambda x: F.when(is_blank(x), F.lit("")).otherwise(x)),
            lambda x, i: (x != "") | ((i > 0) & ~is_blank(F.get(all_lines, i - 1))),
        )

    def last(out: Column) -> Column:
        return F.when((F.size(out) > 0) & (F.element_at(out, F.greatest(F.size(out), F.lit(1))) == ""), F.slice(out, F.lit(1), F.size(out) - 1)).otherwise(out)

    cleaned = bind(lines(text), lambda x: bind(kept(x), lambda out: F.when(F.size(out) > 0, last(out)).otherwise(out)))
    return F.when(text.isNotNull(), join(cleaned))
