"""The report over built-in samples: what each kind of document saves, as it is and with bodies stubbed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detect as D
from ..functions.tokens import Counter, approximate, saved_pct
from ..operators.condense import condense
from .options import Options

#: (label, forced type, text, whether it is also stubbed)
SAMPLES: tuple[tuple[str, str, str, bool], ...] = (
    ("Rust", "rust", "// Adds up.\nuse std::fmt;\n\n\n\nfn total(xs: &[u64]) -> u64 {\n    // start from nothing\n    let mut sum = 0;\n    for x in xs {\n        sum += x; // one more\n    }\n    sum\n}\n", True),
    ("Python", "python", '"""A module."""\nimport math\n\ndef area(r):\n    """Area of a circle."""\n    # the usual formula\n    return math.pi * r ** 2  # pi r squared\n', True),
    ("TypeScript", "typescript", "/* Shop. */\ninterface Item { name: string; price: number }\n\nfunction sum(items: Item[]): number {\n  // fold\n  return items.reduce((a, b) => a + b.price, 0);\n}\n", True),
    ("Ruby", "ruby", "# A greeter\nrequire 'set'\n\nclass Greeter\n  def greet(name)\n    # polite\n    puts \"Hello #{name}\"\n  end\nend\n", True),
    ("Java", "java", "/** Counter. */\npublic class Counter {\n    private int n; // state\n    public int next() {\n        /* one more */\n        return ++n;\n    }\n}\n", True),
    ("C / C++", "c", "/* Squares. */\n#include <stdio.h>\n\nint square(int x) {\n    // multiply\n    return x * x;\n}\n", True),
    ("Swift", "swift", "// Point\nimport Foundation\nstruct Point {\n    var x: Int // across\n    func left() -> Point { return Point(x: x - 1) }\n}\n", False),
    ("Kotlin", "kotlin", "// Pair\nfun twice(x: Int): Int {\n    val y = x * 2 // double\n    return y\n}\n", False),
    ("JSON", "json", '{\n  "id": 7,\n  "name": "lamp",\n  "tags": [],\n  "note": null,\n  "size": { "w": 3, "unit": "" }\n}\n', False),
    ("Diff", "diff", "diff --git a/x b/x\nindex 1..2 100644\n--- a/x\n+++ b/x\n@@ -1,4 +1,4 @@\n same\n-old\n+new\n same\n same\n", False),
    ("Logs", "logs", "".join(f"2024-05-01T10:00:{s:02d}Z INFO request {s + 10000} served\n" for s in range(12)) + "2024-05-01T10:01:00Z ERROR disk full\n", False),
    ("Text", "text", "The same line.\nAnother line.\nThe same line.\nThe same line.\nLast line.\n", False),
)


def samples(spark: SparkSession) -> DataFrame:
    """(ordinal, label, mode, content_type, language, text): each sample as it is, some again to be stubbed."""
    rows = [(i, label, mode, *D.parse_type(kind), text) for i, (label, kind, text, stubbed) in enumerate(SAMPLES) for mode in (("standard", "stubbed") if stubbed else ("standard",))]
    return spark.createDataFrame(rows, "ordinal int, label string, mode string, asked string, lang string, text string")


def report(spark: SparkSession, count: Counter = approximate) -> DataFrame:
    """(mode, label, is_total, tokens_before, tokens_after, saved_pct): a row for each sample and one for all of a mode."""
    asked = samples(spark).withColumn("kind", F.struct(F.col("asked").alias("content_type"), F.col("lang").alias("language")))
    done = condense(asked, Options(), count=count, kind=F.col("kind"), stubbed=F.col("mode") == "stubbed")
    sums = done.rollup("mode", "label").agg(F.grouping("label").cast("int").alias("is_total"), F.sum("tokens_before").alias("tokens_before"), F.sum("tokens_after").alias("tokens_after")).where("mode is not null")
    return sums.withColumn("saved_pct", saved_pct(F.col("tokens_before"), F.col("tokens_after")))
