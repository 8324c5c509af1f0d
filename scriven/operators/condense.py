"""The main operator: each document condensed by its type, in one pass without a shuffle.

Order: the type's own rewrite, then near-duplicate blocks (``smart``), then patterns, then the
budget.  Rewrites that are expressions sit in the branches of one CASE and run only for rows
of their type; those that need Python share one Arrow UDF, which sees null for other rows.

Cases.  A null text has null results and no error.  JSON that can't be parsed has null results
and an error.  An empty text stays empty.  Other columns pass through; columns that have the
names of results are replaced.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import detect as D
from ..functions import formats, lexers, neardup, stubs
from ..functions.batches import mapped
from ..functions.tokens import Counter, approximate, saved_pct
from ..plans.options import Options

_IN_PYTHON = ("python", "ruby", "shell", "yaml")
NOT_JSON = "invalid JSON"


def _python_step(options: Options):
    """Rewrites of the rows that go to Python; with ``smart``, their distinct blocks.

    It is marked as not deterministic: its result is then computed once, in a projection of its
    own, however often later expressions (such as an exact count of tokens) name it.
    """

    def one(text: str, kind: str, lang: str | None, stubbed: bool, smart: bool) -> str | None:
        if kind == D.JSON:
            return formats.compact_json(text)
        if kind == D.TEXT:
            new = formats.dedup_lines(text)
        elif stubbed and lang not in stubs.NOT_STUBBED:
            new = stubs.stub(text, lang or "generic")
        else:
            new = lexers.strip_text(text, lang, options.strip_docs)
        return neardup.distinct_blocks(new) if smart else new

    @F.arrow_udf(StringType())
    def run(texts: pa.Array, kinds: pa.Array, languages: pa.Array, stubbed: pa.Array, smart: pa.Array) -> pa.Array:
        return mapped(one, pa.string(), texts, kinds, languages, stubbed, smart)

    return run.asNondeterministic()


def rewrite(text: Column, kind: Column, language: Column, options: Options = Options(), stubbed: Column | None = None, smart: Column | None = None) -> Column:
    """A document's text by its type, near-duplicate blocks dropped if ``smart``.

    JSON, logs and diffs have no blank line left, hence one block.  Looking for blocks needs
    Python, so with ``smart`` text and code are rewritten there at once: a row is sent once.
    ``stubbed`` and ``smart`` are the row's own options, besides those of the run.
    """
    flag = lambda own, always: F.lit(always) if always or own is None else F.coalesce(own, F.lit(False))
    wants_stubs, wants_smart = flag(stubbed, options.stubs), flag(smart, options.smart)
    in_python = (kind == D.JSON) | ((kind == D.CODE) & language.isin(*_IN_PYTHON))
    if options.stubs or stubbed is not None:
        in_python = in_python | (wants_stubs & (kind == D.CODE) & ~language.isin(*stubs.NOT_STUBBED))
    if options.smart or smart is not None:
        in_python = in_python | (wants_smart & kind.isin(D.TEXT, D.CODE))
    out = F.when(kind == D.LOGS, formats.log_collapse(text)).when(kind == D.DIFF, formats.diff_compact(text)).when(in_python, _python_step(options)(F.when(in_python, text), kind, language, wants_stubs, wants_smart))
    if not options.smart:
        out = out.when(kind == D.TEXT, formats.text_dedup(text))
        for own in ("html", "css", "sql", "rust", "swift"):
            out = out.when(language == own, lexers.strip(text, own, options.strip_docs))
        out = out.when(kind == D.CODE, lexers.cstyle(text))
    return out


def _apart(text: Column) -> Column:
    """The same, computed in a projection of its own: the optimizer leaves what isn't deterministic where it is.

    A Python UDF whose argument holds lambda functions isn't planned right; its argument must be a column.
    """
    return F.when(F.rand(0) < F.rand(1) + 1, text)


def condense(docs: DataFrame, options: Options = Options(), text: str = "text", path: str | None = None, forced: str | None = None, count: Counter = approximate, kind: Column | None = None,
             stubbed: Column | None = None, smart: Column | None = None, budget: Column | None = None) -> DataFrame:
    """docs with content_type, language, condensed, tokens_before, tokens_after and error.

    ``kind`` is a STRUCT<content_type, language> that decides the type where it isn't null.
    ``stubbed``, ``smart`` and ``budget`` are a row's own options; a null budget is the run's.
    The budget is kept in the tokens of ``count``.
    """
    found = D.resolve(F.col(text), F.col(path) if path else None, forced)
    out = docs.withColumn("__kind", found if kind is None else F.when(kind.isNotNull(), kind).otherwise(found))
    out = out.withColumns({"content_type": F.when(F.col(text).isNotNull(), F.col("__kind.content_type")), "language": F.when(F.col(text).isNotNull(), F.col("__kind.language"))}).drop("__kind")
    out = out.withColumn("__new", rewrite(F.col(text), F.col("content_type"), F.col("language"), options, stubbed, smart))
    if options.patterns:
        out = out.withColumn("__new", formats.strip_patterns(F.col("__new"), list(options.patterns)))
    if count is not approximate:
        out = out.withColumn("__new", _apart(F.col("__new")))
    if options.budget is not None or budget is not None:
        most = F.lit(options.budget).cast("int") if budget is None else F.coalesce(budget, F.lit(options.budget)).cast("int")
        within = getattr(count, "within", formats.within_budget)
        out = out.withColumn("__new", F.when(most.isNull(), F.col("__new")).otherwise(within(F.col("__new"), most)))
        if count is not approximate:
            out = out.withColumn("__new", _apart(F.col("__new")))
    return out.withColumns(
        {
            "condensed": F.col("__new"),
            "tokens_before": count(F.col(text)),
            "tokens_after": count(F.col("__new")),
            "error": F.when(F.col(text).isNotNull() & F.col("__new").isNull(), F.lit(NOT_JSON)),
        }
    ).drop("__new")


def usable(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents that a folder scan keeps: not null and not blank."""
    return docs.where(F.col(text).isNotNull() & (D.left(F.col(text)) != ""))


def with_savings(condensed: DataFrame) -> DataFrame:
    return condensed.withColumn("saved_pct", saved_pct(F.col("tokens_before"), F.col("tokens_after")))
