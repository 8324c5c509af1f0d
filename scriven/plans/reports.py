"""Token and cost reports over (label, tokens_before, tokens_after) facts.

Facts are reduced to one row for each label before anything else; the price table has a few
rows and is joined as a broadcast.  Null counts count as zero; a null label is a group.
"""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tokens import saved_pct

PRICES = Path(__file__).with_name("prices.csv")
#: Which price row a language's saved cost is reckoned with.
REPORT_ROW = 1
CALLS_A_DAY, DAYS = 100, 30


def price_rows(path: str | Path = PRICES) -> list[tuple[int, str, str, float]]:
    with open(path, newline="") as f:
        return [(int(r["ordinal"]), r["model"], r["provider"], float(r["usd_per_mtok"])) for r in csv.DictReader(f)]


def prices(spark: SparkSession, path: str | Path = PRICES) -> DataFrame:
    return spark.createDataFrame(price_rows(path), "ordinal int, model string, provider string, usd_per_mtok double")


def price_values(path: str | Path = PRICES) -> str:
    """The price table as SQL VALUES."""
    return ", ".join(f"({o}, '{m}', '{p}', CAST({v} AS DOUBLE))" for o, m, p, v in price_rows(path))


def _sum(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).alias(name)


def totals(facts: DataFrame) -> DataFrame:
    return facts.agg(F.count("*").alias("documents"), _sum("tokens_before"), _sum("tokens_after")).withColumn("saved_pct", saved_pct(F.col("tokens_before"), F.col("tokens_after")))


def by_label(facts: DataFrame, label: str = "language") -> DataFrame:
    """A row for each label and, with ``is_total``, one for all."""
    rolled = facts.rollup(label).agg(F.grouping(label).cast("int").alias("is_total"), F.count("*").alias("documents"), _sum("tokens_before"), _sum("tokens_after"))
    return rolled.withColumn("saved", F.greatest(F.col("tokens_before") - F.col("tokens_after"), F.lit(0))).withColumn("saved_pct", saved_pct(F.col("tokens_before"), F.col("tokens_after")))


def ranked(facts: DataFrame, label: str = "language") -> DataFrame:
    """Labels by what they save (ties by label), with the cost saved at one price."""
    per = facts.groupBy(label).agg(F.count("*").alias("documents"), _sum("tokens_before"), _sum("tokens_after"))
    per = per.withColumn("saved", F.greatest(F.col("tokens_before") - F.col("tokens_after"), F.lit(0)))
    price = price_rows()[REPORT_ROW][3]
    return per.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("saved"), F.col(label)))).withColumn("saved_usd", F.col("saved") / F.lit(1e6) * F.lit(price))


def cost_by_model(facts: DataFrame, price_table: DataFrame, model: str = "") -> DataFrame:
    """Cost of all tokens before and after at each price, in the table's order; ``model`` keeps names that contain it, in any case."""
    sums = facts.agg(_sum("tokens_before"), _sum("tokens_after"))
    chosen = price_table.where(F.contains(F.lower("model"), F.lit(model.lower()))) if model else price_table
    priced = F.broadcast(chosen).crossJoin(sums)
    cost = lambda c: F.col(c) / F.lit(1e6) * F.col("usd_per_mtok")
    out = priced.withColumns({"cost_before": cost("tokens_before"), "cost_after": cost("tokens_after")})
    return out.withColumn("cost_saved", F.greatest(F.col("cost_before") - F.col("cost_after"), F.lit(0.0)))


def best_model(costs: DataFrame) -> DataFrame:
    """The model that saves most (ties: the first of the table) and what a month of daily calls would save."""
    best = costs.agg(F.max_by(F.struct("model", "provider", "cost_saved"), F.struct("cost_saved", -F.col("ordinal"))).alias("b"))
    return best.where("b.cost_saved > 0").select("b.model", "b.provider", "b.cost_saved", (F.col("b.cost_saved") * CALLS_A_DAY * DAYS).alias("monthly_usd"))


def number(n: Column) -> Column:
    """12345 as 12,345."""
    return F.format_number(n, 0)


def short_number(n: Column) -> Column:
    """Millions with one digit, smaller numbers in groups of three."""
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / F.lit(1e6))).otherwise(F.replace(F.format_number(n, 0), F.lit(","), F.lit(" ")))


def usd(x: Column) -> Column:
    """Two decimals from a dollar on, four from a cent, else six."""
    return F.when(x >= 1.0, F.format_string("$%.2f", x)).when(x >= 0.01, F.format_string("$%.4f", x)).otherwise(F.format_string("$%.6f", x))


def summary_line(before: Column, after: Column) -> Column:
    return F.format_string("%s → %s tokens (%.0f%% saved)", number(before), number(after), saved_pct(before, after))


def estimate(facts: DataFrame, price_table: DataFrame, model: str = "") -> DataFrame:
    """One row (text, meta): the costs as a table and as JSON; an error text if no model is meant."""
    costs = cost_by_model(facts, price_table, model).withColumn(
        "line", F.format_string("%s (%s): %s → %s, saves %s", "model", "provider", usd(F.col("cost_before")), usd(F.col("cost_after")), usd(F.col("cost_saved")))
    )
    rows = F.sort_array(F.collect_list(F.struct("ordinal", "line", "model", "provider", "usd_per_mtok", "cost_before", "cost_after", "cost_saved")))
    return costs.agg(rows.alias("r")).select(
        F.when(F.size("r") == 0, F.lit(f"no model matches: {model}")).otherwise(F.array_join(F.transform("r", lambda x: x["line"]), "\n")).alias("text"),
        F.to_json(F.transform("r", lambda x: x.dropFields("line", "ordinal"))).alias("meta"),
        F.when(F.size("r") == 0, F.lit(-32602)).alias("error_code"),
    )
