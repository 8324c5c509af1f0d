"""Structured Streaming: condensing a growing folder into the ledger, savings by time, templates without repeats.

State is bounded by watermarks; sinks get a checkpoint folder from the caller, which must be
one that all executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.formats import log_template
from ..operators.condense import condense
from ..plans.ledger import Ledger
from ..plans.options import Options
from ..sources.payloads import answers, requests


def read_documents(spark: SparkSession, folder: str, schema: str = "doc_id long, text string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def into_ledger(docs: DataFrame, ledger: Ledger, checkpoint: str, options: Options = Options(), name: str = "stream") -> StreamingQuery:
    """Condense each micro-batch and append its facts.

    A batch that is run again after a failure replaces its own facts, so they count once;
    ``name`` tells apart streams that share a ledger.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        ledger.record(condense(batch, options), f"{name}-{batch_id}")

    return docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def savings_by_window(facts: DataFrame, ts: str = "ts", width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """(start, end, language, documents, tokens_before, tokens_after) by event time; later rows than ``late`` are dropped."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    summed = facts.withWatermark(ts, late).groupBy(window.alias("w"), "language").agg(F.count("*").alias("documents"), F.sum("tokens_before").alias("tokens_before"), F.sum("tokens_after").alias("tokens_after"))
    return summed.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "language", "documents", "tokens_before", "tokens_after")


def savings_by_session(facts: DataFrame, ts: str = "ts", gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    summed = facts.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), "language").agg(F.count("*").alias("documents"), F.sum("tokens_before").alias("tokens_before"), F.sum("tokens_after").alias("tokens_after"))
    return summed.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "language", "documents", "tokens_before", "tokens_after")


def new_templates(logs: DataFrame, ts: str = "ts", line: str = "line", late: str = "1 hour") -> DataFrame:
    """Log lines whose template wasn't seen within the watermark."""
    return logs.withColumn("template", log_template(F.col(line))).withWatermark(ts, late).dropDuplicatesWithinWatermark(["template"])


def serve(lines: DataFrame, options: Options = Options()) -> DataFrame:
    """Responses to a stream of request lines."""
    return answers(requests(lines), options)
