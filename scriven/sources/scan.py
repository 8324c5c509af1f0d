"""Documents from files: (path, text), path relative to the folder.

Folders are listed by Spark on any file system.  Skipped are names in ``SKIP`` and those that
begin with a full stop, as folders below the root; extensions outside of ``EXTENSIONS``; what
the folder's ignore file names; and blank files and files that aren't UTF-8.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import detect as D
from ..functions import lines as L
from ..operators.condense import usable

SKIP = ("target", "node_modules", "dist", "build", ".next", "__pycache__", ".venv", "venv", ".cache", ".git")
EXTENSIONS = tuple(sorted({*D.EXTENSIONS, "toml", "md", "txt"} - {"php5"}))
IGNORE_FILE = ".condenseignore"


def parse_ignore(text: str) -> list[str]:
    """Patterns of an ignore file: blank lines and # comments dropped, one / at the end too."""
    rows = (x.strip() for x in text.splitlines())
    return [x.rstrip("/") for x in rows if x and not x.startswith("#")]


def ignore_regex(patterns: Iterable[str]) -> str | None:
    """One expression for relative paths that are ignored, null-safe for no patterns.

    * stands for any characters, in a pattern with / for that sign too.  A pattern with / is
    the whole path of a file or of a folder above it; one without is any part of the path.
    """
    out = []
    for p in patterns:
        body = ("[^/]*" if "/" not in p else ".*").join(map(re.escape, p.split("*")))
        out.append(rf"(?:^{body}(?:/|$))" if "/" in p else rf"(?:(?:^|/){body}(?:/|$))")
    return "(?s)" + "|".join(out) if out else None


def skipped(relative: Column) -> Column:
    """Whether a folder on the way to a file is one to skip."""
    names = "|".join(map(re.escape, SKIP))
    return relative.rlike(rf"(?s)(?:^|/)(?:\.[^/]*|{names})/")


def _eligible(files: DataFrame, patterns: Iterable[str]) -> DataFrame:
    kept = files.where(~skipped(F.col("path")) & D.extension(F.col("path")).isin(*EXTENSIONS))
    expr = ignore_regex(patterns)
    return kept if expr is None else kept.where(~F.col("path").rlike(expr))


def _decoded(files: DataFrame) -> DataFrame:
    return usable(files.select("path", F.when(F.try_validate_utf8(F.col("content").cast("string")).isNotNull(), F.col("content").cast("string")).alias("text")))


def read_ignore(spark: SparkSession, root: str) -> list[str]:
    """The patterns of the root's ignore file; none if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{IGNORE_FILE}")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    stream = fs.open(p)
    try:
        return parse_ignore(bytes(stream.readAllBytes()).decode("utf-8", "replace"))
    finally:
        stream.close()


def scan_folder(spark: SparkSession, root: str, ignore: Iterable[str] | None = None) -> DataFrame:
    """All eligible documents under a folder.  Spark itself hides files whose names begin with _ or a full stop; ``scan_local`` doesn't."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    base = fs.resolvePath(where).toUri().getPath().rstrip("/") + "/"
    glob = "*.{" + ",".join(EXTENSIONS) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    plain = F.regexp_replace(F.col("path"), r"^[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/]*)?", "")
    relative = files.select(F.substring(plain, F.lit(len(base) + 1), F.length(plain)).alias("path"), "content")
    return _decoded(_eligible(relative, read_ignore(spark, root) if ignore is None else ignore))


def scan_file(spark: SparkSession, path: str) -> DataFrame:
    """One file, whatever its extension; an error if it can't be read or isn't UTF-8."""
    return spark.read.format("binaryFile").load(path).select(F.lit(path).alias("path"), F.validate_utf8(F.col("content").cast("string")).alias("text"))


def scan_many(spark: SparkSession, inputs: Iterable[str]) -> DataFrame:
    """Files and folders together, each path as given (a folder's files below it)."""
    out = None
    for item in inputs:
        p = spark._jvm.org.apache.hadoop.fs.Path(item)
        status = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)
        one = scan_folder(spark, item).withColumn("path", F.concat(F.lit(item.rstrip("/") + "/"), F.col("path"))) if status.isDirectory() else scan_file(spark, item)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no input")
    return out


def from_text(spark: SparkSession, text: str) -> DataFrame:
    """What was read from standard input: no path; nothing if it is blank."""
    return usable(spark.createDataFrame([(None, text)], "path string, text string"))


# ---------------------------------------------------------------- a source of its own for local trees


class _Part(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class _Reader(DataSourceReader):
    """Prunes while it walks, doesn't follow links, and leaves the files to the tasks by size."""

    PART = 64 << 20

    def __init__(self, root: str, patterns: list[str]):
        self.root, self.ignore = root, re.compile(ignore_regex(patterns)) if patterns else None

    def partitions(self) -> list[InputPartition]:
        out, held, size = [], [], 0
        for folder, dirs, files in os.walk(self.root):
            inside = os.path.relpath(folder, self.root)
            inside = "" if inside == "." else inside + "/"
            dirs[:] = sorted(d for d in dirs if not d.startswith(".") and d not in SKIP and not (self.ignore and self.ignore.search(inside + d)))
            for name in sorted(files):
                path = inside + name
                full = os.path.join(folder, name)
                stem, _, ext = name.rpartition(".")
                if not stem or ext not in EXTENSIONS or os.path.islink(full) or (self.ignore and self.ignore.search(path)):
                    continue
                held.append(path)
                size += os.path.getsize(full)
                if size >= self.PART:
                    out.append(_Part(held))
                    held, size = [], 0
        return out + [_Part(held)] if held or not out else out

    def read(self, partition: _Part) -> Iterator[tuple]:
        for path in partition.files:
            try:
                with open(os.path.join(self.root, path), encoding="utf-8", newline="") as f:
                    text = f.read()
            except (OSError, UnicodeDecodeError):
                continue
            if text.strip(L.WHITE):
                yield path, text


class LocalTree(DataSource):
    """spark.read.format("document_tree").load(folder), for a tree that all executors see."""

    @classmethod
    def name(cls) -> str:
        return "document_tree"

    def schema(self) -> str:
        return "path string, text string"

    def reader(self, schema) -> DataSourceReader:
        root = self.options["path"]
        patterns = self.options.get("ignore")
        if patterns is None:
            try:
                with open(os.path.join(root, IGNORE_FILE), encoding="utf-8", errors="replace") as f:
                    patterns = f.read()
            except OSError:
                patterns = ""
        return _Reader(root, parse_ignore(patterns))


def scan_local(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(LocalTree)
    return spark.read.format("document_tree").load(root)
