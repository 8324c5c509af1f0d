"""MinHash signatures of documents and pairs of documents that are alike (see functions.neardup)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import neardup as N


def signatures(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, signature ARRAY<BIGINT>) of each document with words.

    Signatures of rows are made in Arrow batches, some 250 KB of text at a time; one row of 64
    numbers for each document is all that moves.  Rows that share an id count as one text: its
    slots are the minima of theirs.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), N.signature_of(F.col(text)).alias("s")).where(F.col("s").isNotNull())
    least = rows.groupBy("id").agg(*[F.min(F.col("s")[k]).alias(f"s{k}") for k in range(N.SLOTS)])
    return least.select(F.col("id").alias(id_col), F.array(*[F.col(f"s{k}") for k in range(N.SLOTS)]).alias("signature"))


def agreement(a: Column, b: Column) -> Column:
    """Share of slots that are equal."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z)) / F.lit(N.SLOTS)


def pairs(sigs: DataFrame, id_col: str = "doc_id", threshold: float = N.THRESHOLD) -> DataFrame:
    """(id_a, id_b, similarity): documents with an equal band and enough equal slots, id_a < id_b.

    Documents with equal signatures are grouped first, so thousands of copies don't meet
    pairwise in the band join; their pairs are listed at the end.
    """
    groups = sigs.groupBy("signature").agg(F.sort_array(F.collect_set(F.col(id_col))).alias("ids"))
    groups = groups.withColumn("head", F.col("ids")[0])
    banded = groups.select("head", "signature", F.explode(F.array(*[F.concat(F.lit(f"{b}:"), F.array_join(F.slice("signature", b * N.ROWS + 1, N.ROWS), ",")) for b in range(N.SLOTS // N.ROWS)])).alias("band"))
    keys = banded.select("head", F.xxhash64("band").alias("k"), "band")
    met = keys.alias("x").join(keys.alias("y"), (F.col("x.k") == F.col("y.k")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.head") < F.col("y.head"))).select(F.col("x.head").alias("a"), F.col("y.head").alias("b")).distinct()
    g = groups.select("head", "signature", "ids")
    scored = met.join(g.toDF("a", "sig_a", "ids_a"), "a").join(g.toDF("b", "sig_b", "ids_b"), "b").withColumn("similarity", agreement(F.col("sig_a"), F.col("sig_b"))).where(F.col("similarity") >= threshold)
    across = scored.select(F.explode("ids_a").alias("a"), "ids_b", "similarity").select("a", F.explode("ids_b").alias("b"), "similarity")
    within = groups.where(F.size("ids") > 1).select(F.explode("ids").alias("a"), "ids").select("a", F.explode("ids").alias("b")).where("a < b").select("a", "b", F.lit(1.0).alias("similarity"))
    both = across.unionByName(within)
    return both.select(F.least("a", "b").alias(f"{id_col}_a"), F.greatest("a", "b").alias(f"{id_col}_b"), "similarity")
