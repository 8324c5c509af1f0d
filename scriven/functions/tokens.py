"""Token counts and savings.

The default count, a token for each four characters begun, is a plain expression and adds up
over prefixes of a text.  ``bpe_counter`` counts exactly with a public vocabulary file.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from .batches import mapped

Counter = Callable[[Column], Column]
CHARS = 4


def approximate(text: Column) -> Column:
    return F.ceil(F.length(text) / F.lit(CHARS)).cast("long")


PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class bpe_counter:  # noqa: N801  a function that also keeps budgets
    """A counter by the vocabulary file (lines of a token in base 64 and its rank), which executors read themselves.

    ``within(text, budget)`` is the longest prefix of whole lines that has so many of its tokens.
    """

    def __init__(self, path: str):
        self.path = path

    def __call__(self, text: Column) -> Column:
        path = self.path

        @F.arrow_udf(LongType())
        def count(texts: pa.Array) -> pa.Array:
            enc = _encoding(path)
            return mapped(lambda t: len(enc.encode_ordinary(t)), pa.int64(), texts)

        return count(text)

    def within(self, text: Column, budget: Column) -> Column:
        from .formats import head_within

        path = self.path

        @F.arrow_udf(StringType())
        def head(texts: pa.Array, budgets: pa.Array) -> pa.Array:
            enc = _encoding(path)
            count = lambda t: len(enc.encode_ordinary(t))
            return mapped(lambda t, n: t if n is None else head_within(t, n, count), pa.string(), texts, budgets)

        return head.asNondeterministic()(text, budget)


def saved_pct(before: Column, after: Column) -> Column:
    """Percentage saved: 0 if there was nothing or the text grew."""
    return F.when(before <= 0, F.lit(0.0)).otherwise(F.greatest(before - after, F.lit(0)) / before * 100.0)
