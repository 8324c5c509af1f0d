"""JSON, logs, diffs, plain text, patterns and budgets: one document's text to a shorter one.

All but JSON are expressions over the lines of the row, linear or n log n in its length, and
need no shuffle.  Null gives null, an empty text an empty one.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import lines as L
from .detect import load_json
from .lexers import split_lines
from .tokens import CHARS

# ---------------------------------------------------------------- JSON


def clean_json(value: object) -> object:
    """Without object members that are null, "", [] or {} once cleaned; array elements and the root stay."""
    if isinstance(value, dict):
        cleaned = {k: clean_json(v) for k, v in value.items()}
        return {k: v for k, v in cleaned.items() if not (v is None or v == "" or v == [] or v == {})}
    return [clean_json(v) for v in value] if isinstance(value, list) else value


def compact_json(text: str) -> str | None:
    """Cleaned JSON with sorted keys and no blanks; None if it isn't JSON."""
    try:
        return json.dumps(clean_json(load_json(text)), separators=(",", ":"), ensure_ascii=False, sort_keys=True)
    except ValueError:
        return None


@F.arrow_udf(StringType())
def json_clean(texts: pa.Array) -> pa.Array:
    """compact_json of each; invalid texts give null."""
    return pa.array([None if t is None else compact_json(t) for t in texts.to_pylist()], pa.string())


# ---------------------------------------------------------------- logs

_EDGE, _END = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
TEMPLATES = (
    (r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?", "<ts>"),
    (r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<uuid>"),
    (rf"{_EDGE}[0-9a-fA-F]{{8,}}{_END}", "<hex>"),
    (rf"{_EDGE}[0-9]{{4,}}{_END}", "<n>"),
)


def log_template(line: Column) -> Column:
    """A log line with timestamps, UUIDs, hex runs and long numbers replaced, in that order."""
    for pattern, mark in TEMPLATES:
        line = F.regexp_replace(line, pattern, mark)
    return line


def _first_of_each(keys: Column, wanted: Column | None = None) -> Column:
    """For the distinct keys: ARRAY<STRUCT<pos, key, n>> in order of their first place, by one sort."""
    tagged = F.transform(keys, lambda k, i: F.struct(k.alias("key"), i.alias("pos")))

    def begins(run: Column) -> Column:
        at = F.transform(run, lambda x, j: F.when((j == 0) | (F.get(run, j - 1)["key"] != x["key"]), F.struct(x["pos"].alias("pos"), x["key"].alias("key"), j.alias("j"))))
        return F.filter(at, lambda x: x.isNotNull())

    def counted(run: Column) -> Column:
        return L.bind(begins(run), lambda b: F.transform(b, lambda x, m: F.struct(x["pos"].alias("pos"), x["key"].alias("key"), (F.coalesce(F.get(b, m + 1)["j"], F.size(run)) - x["j"]).alias("n"))))

    return F.sort_array(L.bind(F.sort_array(tagged), counted))


def log_collapse(text: Column) -> Column:
    """Each template of a log once, in order of first occurrence, with how often it occurs if that is more than once."""
    keys = F.transform(F.filter(L.lines(text), lambda x: ~L.is_blank(x)), log_template)
    rows = F.transform(_first_of_each(keys), lambda x: F.when(x["n"] > 1, F.concat(F.lit("[×"), x["n"].cast("string"), F.lit("] "), x["key"])).otherwise(x["key"]))
    return F.when(text.isNotNull(), L.join(rows))


# ---------------------------------------------------------------- diffs and text


def diff_compact(text: Column) -> Column:
    """File headers and changed lines; the place of a hunk shrinks to ---."""
    kept = F.filter(L.lines(text), lambda x: x.rlike(r"^(?:diff --git|[+-]|@@)"))
    return F.when(text.isNotNull(), L.join(F.transform(kept, lambda x: F.when(F.startswith(x, F.lit("@@")), F.lit("---")).otherwise(x))))


def text_dedup(text: Column) -> Column:
    """Without lines that stood before, compared in lower case and trimmed; a blank line stays after one that isn't."""

    def picked(all_lines: Column) -> Column:
        keys = F.transform(all_lines, lambda x: F.lower(L.trim(x)))

        def chosen(k: Column) -> Column:
            at = F.transform(k, lambda x, i: F.when((x == "") & ((i == 0) | (F.get(k, i - 1) != "")), i))
            blank = F.filter(at, lambda i: i.isNotNull())
            first = F.transform(F.filter(_first_of_each(k), lambda x: x["key"] != ""), lambda x: x["pos"])
            return F.transform(F.sort_array(F.concat(first, blank)), lambda i: F.when(F.get(k, i) == "", F.lit("")).otherwise(F.get(all_lines, i)))

        return L.bind(keys, chosen)

    return F.when(text.isNotNull(), L.join(L.bind(L.lines(text), picked)))


def dedup_lines(text: str) -> str:
    """text_dedup for one string."""
    out, seen, before = [], set(), None
    for line in split_lines(text):
        key = line.strip(L.WHITE).lower()
        if not key:
            if before is None or before:
                out.append("")
        elif key not in seen:
            seen.add(key)
            out.append(line)
        before = key
    return "\n".join(out)


# ---------------------------------------------------------------- patterns and budget


def valid_patterns(patterns: list[str]) -> list[str]:
    """The patterns that compile; the others are ignored."""
    out = []
    for p in patterns:
        try:
            re.compile(p)
        except re.error:
            continue
        out.append(p)
    return out


def strip_patterns(text: Column, patterns: list[str]) -> Column:
    """Each pattern's matches removed from each line, one pattern after another; lines that are blank then go."""
    use = valid_patterns(patterns)
    if not use:
        return text

    def stripped(line: Column) -> Column:
        out = line
        for p in use:
            out = F.regexp_replace(out, p, "")
        return L.bind(L.trim(out), lambda x: F.when(x != "", F.concat(L.indent(line), x)))

    return F.when(text.isNotNull(), F.rtrim(L.join(F.filter(F.transform(L.lines(text), stripped), lambda x: x.isNotNull())), F.lit(L.WHITE)))


def notice(budget: int) -> str:
    return f"// cut to fit a budget of {budget} tokens\n"


def notice_of(budget: Column) -> Column:
    """notice() of a column."""
    return F.concat(F.lit("// cut to fit a budget of "), budget.cast("string"), F.lit(" tokens\n"))


def head_within(text: str, budget: int, count) -> str:
    """The text if count(text) fits, else its longest prefix of whole lines that does, and a notice.

    A longer prefix is taken to have no fewer tokens, so the prefix is found by halving.
    """
    if count(text) <= budget:
        return text
    ends, at = [0], 0
    for line in split_lines(text):  # where each line ends in the prefix, each with one line feed
        at += len(line) + 1
        ends.append(at)
    whole = "".join(line + "\n" for line in split_lines(text))
    lo, hi = 0, len(ends) - 1
    reach = 1
    while reach < hi and count(whole[: ends[reach]]) <= budget:
        lo, reach = reach, reach * 2
    hi = min(hi, reach)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if count(whole[: ends[mid]]) <= budget else (lo, mid - 1)
    return whole[: ends[lo]] + notice(budget)


def within_budget(text: Column, budget: int | Column) -> Column:
    """The text if its approximate tokens fit, else its longest prefix of whole lines that does, and a notice.

    The count adds up over lines, so one fold over line lengths finds the prefix.
    """
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    limit = budget.cast("long") * CHARS

    def prefix(all_lines: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("kept"), F.lit(True).alias("open"))

        def step(acc: Column, line: Column) -> Column:
            used = acc["used"] + F.length(line) + 1
            fits = acc["open"] & (used <= limit)
            return F.struct(used.alias("used"), (acc["kept"] + fits.cast("int")).alias("kept"), fits.alias("open"))

        n = F.aggregate(all_lines, start, step)["kept"]
        return F.concat(L.join(F.transform(F.slice(all_lines, F.lit(1), n), lambda x: F.concat(x, F.lit("\n"))), ""), notice_of(budget))

    return F.when(F.length(text) <= limit, text).otherwise(F.when(text.isNotNull(), L.bind(L.lines(text), prefix)))
