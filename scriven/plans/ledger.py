"""The ledger of savings: append-only facts in Parquet, totals by aggregation.

Every run has a folder of its own, so writers don't lock one another and a failed write leaves
nothing behind.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detect as D
from . import reports

SCHEMA = "ts timestamp, language string, tokens_before long, tokens_after long"


def facts(condensed: DataFrame) -> DataFrame:
    """Ledger rows of condensed documents; those in error have none."""
    return condensed.where("error is null and tokens_after is not null").select(
        F.current_timestamp().alias("ts"), D.label(F.col("content_type"), F.col("language")).alias("language"), F.col("tokens_before").cast("long"), F.col("tokens_after").cast("long")
    )


class Ledger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def record(self, condensed: DataFrame, run: str | None = None) -> None:
        """Append the facts of a run; one that is named again replaces its facts."""
        facts(condensed).write.mode("overwrite").parquet(f"{self.path}/run={run or uuid.uuid4().hex}")

    def rows(self) -> DataFrame:
        fs, p = self._fs()
        return self.spark.read.schema(SCHEMA).parquet(self.path) if fs.exists(p) else self.spark.createDataFrame([], SCHEMA)

    def to_json(self) -> DataFrame:
        """One row ``json``: runs, totals and the same by language."""
        rolled = reports.by_label(self.rows())
        one = F.struct("documents", "tokens_before", "tokens_after", "saved")
        total = F.max(F.when(F.col("is_total") == 1, one)).alias("total")
        each = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("is_total") == 0, F.struct(F.coalesce("language", F.lit("unknown")).alias("k"), one.alias("v")))))).alias("by_language")
        return rolled.agg(total, each).select(F.to_json(F.struct("total", "by_language")).alias("json"))

    def reset(self) -> None:
        fs, p = self._fs()
        fs.delete(p, True)
