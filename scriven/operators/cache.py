"""Results kept by content: a Parquet table keyed by a hash of text, type, options and counter.

Rows are appended in one folder a day, so eviction drops whole folders.  The key covers every
option and the type that is forced or that the path gives, so a result is never reused under
others; where the content decides, the text stands for its type, with the rules' digest.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detect as D
from ..plans.options import Options
from .condense import condense

SCHEMA = "cache_key string, condensed string, content_type string, language string, tokens_before long, tokens_after long, error string, day date"
RESULTS = ["condensed", "content_type", "language", "tokens_before", "tokens_after", "error"]
KEEP_DAYS = 30


def key(text: Column, kind: Column, language: Column, options: Options) -> Column:
    """``kind`` and ``language`` as declared; a null kind is the content's."""
    return F.sha2(F.concat_ws("\x1f", F.lit(options.key()), F.coalesce(kind, F.lit(D.RULES)), F.coalesce(language, F.lit("")), text), 256)


class ResultCache:
    """A cache in a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def rows(self) -> DataFrame:
        fs, p = self._fs()
        if not fs.exists(p):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def through(self, docs: DataFrame, options: Options = Options(), text: str = "text", path: str | None = None, forced: str | None = None, today: dt.date | None = None) -> DataFrame:
        """condense(docs) in which known texts are looked up and new ones, each once, are computed and kept.

        The new rows are written before the result is read, and the result joins the one table.
        Keys alone are compared with those known; only the texts of new ones move.
        """
        kind = D.declared(F.col(path) if path else None, forced)
        keyed = docs.withColumn("cache_key", key(F.col(text), kind["content_type"], kind["language"], options))
        some = keyed.where(F.col(text).isNotNull())
        new = some.select("cache_key").join(self.rows().select("cache_key"), "cache_key", "left_anti").distinct()
        fresh = some.join(new, "cache_key", "left_semi").dropDuplicates(["cache_key"])
        made = condense(fresh, options, text, path, forced).select("cache_key", *RESULTS).withColumn("day", F.lit(today or dt.date.today()))
        made.write.mode("append").partitionBy("day").parquet(self.path)
        table = self.rows().dropDuplicates(["cache_key"]).select("cache_key", *RESULTS)
        return keyed.drop(*RESULTS).join(table, "cache_key", "left").drop("cache_key")

    def size(self) -> tuple[int, int]:
        """(entries, bytes on disk)."""
        fs, p = self._fs()
        return (self.rows().count(), fs.getContentSummary(p).getLength()) if fs.exists(p) else (0, 0)

    def clear(self) -> None:
        fs, p = self._fs()
        fs.delete(p, True)

    def evict(self, days: int = KEEP_DAYS, today: dt.date | None = None) -> int:
        """Drop the folders of days longer ago; how many went."""
        fs, p = self._fs()
        last, gone = (today or dt.date.today()) - dt.timedelta(days=days), 0
        for entry in fs.listStatus(p) if fs.exists(p) else []:
            name = entry.getPath().getName()
            if name.startswith("day=") and dt.date.fromisoformat(name[4:]) < last:
                fs.delete(entry.getPath(), True)
                gone += 1
        return gone
