"""Language identification with bit-sliced Bloom filters of character n-grams.

One table of bit masks serves all languages: bit l of a slot belongs to the Bloom filter of
language l, and the AND of the probed slots gives, for an n-gram, every language whose
n-grams include it.  Of a document's n-grams the hits of each language are counted,
corrected for the filter's false positives, ``(hits - n f) / (1 - f)`` with f the filter's
fill to the power of the probes, and the language with the most corrected hits wins
(ties: the first in alphabetical order).  A document is rejected ("und") if its best
language has fewer corrected hits than ``MIN_COVERAGE`` of its n-grams.

The filters are fitted on a bounded sample of labelled documents: about ``FIT_DOCS`` in all,
at most ``FIT_PER_LANGUAGE`` and no fewer than some ``FIT_LEAST`` of each language that has so
many, chosen by a hash of doc_id.  An n-gram enters the
filter of a language if it makes up at least ``RATE`` of that language's n-grams and occurs
twice; the rule is relative, so it doesn't depend on the sample's size.  All languages that are
labelled are distinguished, 64 of them in each table of masks.

Cases.  Null or empty texts, and texts without letters, have no n-grams and are rejected.
Rows with a null doc_id or null lang are classified like others; rows without a lang don't
take part in fitting.  Repeated rows are classified one by one.  Other columns pass through
``accept`` unchanged whatever their names.  Without any labelled document every document is
rejected.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as tc
from .common import materialize, small, table

#: Lengths of n-grams, all of which are used.
SIZES = (4, 3)
FIT_DOCS = 4000
FIT_PER_LANGUAGE = 1000
FIT_LEAST = 20
RATE = 4e-6
MIN_COVERAGE = 0.15
PROBES = 4
#: Slots for each n-gram of the language that has most.
SLOTS = 16
U64 = np.uint64


@dataclass
class Filters:
    languages: list[str]
    masks: list[np.ndarray]
    false_positive: np.ndarray

    def lookup(self, h: np.ndarray, group: int = 0) -> np.ndarray:
        """Bit mask of those of 64 languages that contain each n-gram hash."""
        masks = self.masks[group]
        size = U64(len(masks) - 1)
        step = (h >> U64(32)) | U64(1)
        out = masks[h & size]
        for k in range(1, PROBES):
            out &= masks[(h + U64(k) * step) & size]
        return out


def build(grams: dict[str, np.ndarray]) -> Filters:
    """Filters of each language's distinct n-gram hashes."""
    names = sorted(grams)
    most = max((len(g) for g in grams.values()), default=1)
    size = 1 << max(10, int(most * SLOTS - 1).bit_length())
    tables, fill = [], np.zeros(len(names))
    for first in range(0, max(1, len(names)), 64):
        group = names[first : first + 64]
        kind = next(t for t, b in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(group) <= b)
        masks = np.zeros(size, kind)
        for bit, name in enumerate(group):
            h = grams[name]
            step = (h >> U64(32)) | U64(1)
            slots = np.unique(np.concatenate([(h + U64(k) * step) & U64(size - 1) for k in range(PROBES)] + [np.zeros(0, U64)]))
            masks[slots] |= kind(1 << bit)
            fill[first + bit] = len(slots) / size
        tables.append(masks)
    return Filters(names, tables, fill**PROBES)


def learn(texts: dict[str, list[str | None]], sizes: tuple[int, ...] = SIZES, rate: float = RATE) -> dict[str, np.ndarray]:
    """The n-gram hashes of each language that are frequent in its texts."""
    out = {}
    for name, group in texts.items():
        parts = []
        for a, z in tc.chunked(group):
            seq = tc.Characters(group[a:z], tc.letters(), True)
            for n in sizes:
                parts += [np.unique(h, return_counts=True) for _, h in seq.grams(n)]
        if not parts:
            continue
        h, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        count = np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(h))
        out[name] = h[count >= max(2, rate * count.sum())]
    return out


def sample(docs: DataFrame, label: str, total: int, each: int, least: int = FIT_LEAST) -> DataFrame:
    """Labelled documents for fitting, by a hash of doc_id: of each label about total / labels, ``each`` at most and ``least`` at least."""
    known = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id"), F.col(label).cast("string").alias("label"), F.col("text").cast("string").alias("text"))
    counts = materialize(known.groupBy("label").agg(F.count("*").alias("n")), "labels")
    labels = counts.count()
    quota = max(least, min(each, total // max(1, labels)))
    u = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = known.join(small(counts, labels), "label").where(u < F.lit(float(quota)) / F.col("n"))
    return chosen.orderBy(u, "doc_id", "text").limit(max(total, 2 * least * labels)).drop("doc_id", "n")


def fit(docs: DataFrame, total: int = FIT_DOCS, each: int = FIT_PER_LANGUAGE) -> Filters:
    texts: dict[str, list[str | None]] = {}
    for label, text in sample(docs, "lang", total, each).toArrow().to_pandas().itertuples(index=False):
        texts.setdefault(label, []).append(text)
    return build(learn(texts))


def score(filters: Filters, texts: list[str | None], sizes: tuple[int, ...] = SIZES) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams of each text, corrected hits of each text and language)."""
    n = np.zeros(len(texts))
    hits = np.zeros((len(texts), len(filters.languages)))
    seq = tc.Characters(texts, tc.letters(), True)
    for size in sizes:
        for at, h in seq.grams(size):
            cut = np.searchsorted(at, seq.first)
            n += np.diff(cut)
            for k in range(len(filters.languages)):
                if k % 64 == 0:
                    found = filters.lookup(h, k // 64)
                total = np.concatenate(([0], np.cumsum((found >> (k % 64)) & 1, dtype=np.int64)))
                hits[:, k] += np.diff(total[cut])
    f = filters.false_positive
    return n, (hits - n[:, None] * f) / (1 - f)


def decide(filters: Filters, texts: list[str | None], least: float = MIN_COVERAGE) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(language or "und", n-grams, corrected hits of the best, accepted)."""
    n, hits = score(filters, texts)
    if not filters.languages:
        return ["und"] * len(texts), n, np.zeros(len(n)), np.zeros(len(n), bool)
    best = hits.argmax(axis=1)
    top = np.maximum(hits[np.arange(len(n)), best], 0)
    ok = (n > 0) & (top >= least * n)
    return [filters.languages[b] if k else "und" for b, k in zip(best, ok)], n, top, ok


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, language, ngrams, hits, accepted) of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tc.batches(it):
            lang, n, top, ok = decide(sent.value, texts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang), pa.array(n.astype(np.int64)), pa.array(np.round(top, 3)), pa.array(ok)], ["doc_id", "language", "ngrams", "hits", "accepted"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, language string, ngrams long, hits double, accepted boolean")


def accept(docs: DataFrame, filters: Filters) -> DataFrame:
    """The documents in a known language, all columns."""
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tc.batches(it):
            yield part.filter(pa.array(decide(sent.value, texts)[3]))

    return docs.mapInArrow(run, docs.schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
