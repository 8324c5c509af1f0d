"""Documents put together: chunk headers, ordered bundles and the budget of a whole bundle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions.formats import notice
from ..functions.tokens import CHARS


def chunk(path: Column, text: Column) -> Column:
    return F.concat(F.lit("// === "), path, F.lit(" ===\n"), text, F.lit("\n\n"))


#: The least length of a chunk of a document, its path and text empty.
LEAST = len("// ===  ===\n\n\n")


def bundle(docs: DataFrame, by: list[str], path: str = "path", text: str = "condensed", before: str = "tokens_before", after: str = "tokens_after") -> DataFrame:
    """One row for each group: its documents, number, token totals (headers aside) and the chunks in order of path (ties: text).

    A group is one row in memory; ``chunks_in_order`` is for what is larger.  Rows with a null
    path or text count nowhere.
    """
    rows = docs.where(F.col(path).isNotNull() & F.col(text).isNotNull())
    whole = F.sort_array(F.collect_list(F.struct(F.col(path).alias("p"), chunk(F.col(path), F.col(text)).alias("c"))))
    return rows.groupBy(*by).agg(
        F.array_join(F.transform(whole, lambda x: x["c"]), "").alias("bundle"),
        F.count("*").alias("documents"),
        F.sum(before).alias("tokens_before"),
        F.sum(after).alias("tokens_after"),
    )


def chunks_in_order(docs: DataFrame, path: str = "path", text: str = "condensed") -> DataFrame:
    """(path, chunk), range-partitioned and sorted by path: written, the files concatenate to the bundle."""
    return docs.where(F.col(path).isNotNull() & F.col(text).isNotNull()).select(F.col(path).alias("path"), chunk(F.col(path), F.col(text)).alias("chunk")).orderBy("path", "chunk")


def corpus_budget(docs: DataFrame, budget: int, path: str = "path", text: str = "condensed") -> DataFrame:
    """(path, chunk) of the longest prefix of whole lines of the bundle that fits the budget.

    If not all fits, a row with a null path and the notice follows.  No more documents than
    the budget has room for can be in the prefix, so a top-n by path comes before the running
    sum: what one task holds is bounded by the budget and not by the corpus.
    """
    limit = budget * CHARS
    ordered = chunks_in_order(docs, path, text)
    most = limit // LEAST + 2
    head = ordered.limit(most).withColumn("size", F.length("chunk").cast("long"))
    run = Window.orderBy("path", "chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = head.withColumn("end", F.sum("size").over(run)).withColumn("begin", F.col("end") - F.col("size"))
    room = F.lit(limit) - F.col("begin")

    def cut(lines: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("kept"))
        n = F.aggregate(lines, start, lambda a, x: F.struct((a["used"] + F.length(x) + 1).alias("used"), (a["kept"] + (a["used"] + F.length(x) + 1 <= room).cast("int")).alias("kept")))["kept"]
        return F.array_join(F.transform(F.slice(lines, F.lit(1), n), lambda x: F.concat(x, F.lit("\n"))), "")

    kept = head.where(F.col("begin") < limit).select("path", F.when(F.col("end") <= limit, F.col("chunk")).otherwise(L.bind(L.lines(F.col("chunk")), cut)).alias("chunk"))
    over = head.agg(F.max("end").alias("end")).where(F.col("end") > limit).select(F.lit(None).cast("string").alias("path"), F.lit(notice(budget)).alias("chunk"))
    return kept.where("chunk <> ''").unionByName(over)
