"""Spark plumbing shared by the corpus operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of two or three longs that are broadcast (some 32 MB); beyond it joins shuffle.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isDefined():
            path = known.get()
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="scriven-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def _remove() -> None:
    for spark, path in _written:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone by now; the files lie in the checkpoint folder
            return


atexit.register(_remove)


def materialize(df: DataFrame, hint: str = "t") -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{hint}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Mark a written table for broadcast only if it is small; else the join shuffles."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def arrow(fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from one that handles a batch."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = fn(batch)
            if out is None:
                continue
            yield from [out] if isinstance(out, pa.RecordBatch) else out

    return run


def groups(it: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Runs of equal keys of a partition that is sorted by them; a run may span batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in it:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(n, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), n]
        for a, z in zip(edges, edges[1:]):
            key = tuple(c[a] for c in cols)
            if last is not None and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Connected components of (a BIGINT, b BIGINT) as (node, root), root the least node.

    Alternating large-star and small-star contraction: every round is two aggregations and
    two joins on the edge list, which shrinks to one star a component, and there are
    logarithmically many rounds.  Each round is written to the shared folder.  Nodes without
    an edge to another node are not returned; nulls are dropped.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        linked = both.join(least, "u")
        if large:
            out = linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def order(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))

    e = materialize(order(edges.where("a is not null and b is not null and a <> b")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        e = materialize(star(order(star(e, True)), False), "edges")
        row = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now = (row[0], row[1])
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    roots = e.groupBy("a").agg(F.min("b").alias("b"))
    return roots.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
