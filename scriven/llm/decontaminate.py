"""Benchmark decontamination with suffix arrays of the training documents.

Semantics.  Documents and benchmark items are word sequences (see textcore).  For every
document and item the longest run of words that stands verbatim in both is found; the
document is contaminated by the item if the run has at least ``min(MIN_WORDS, words of the
item)`` words.  The report has one row for each such pair: doc_id, item_id, match_words,
doc_word and item_word (where the run begins, counted in words from 0; of several longest
runs the one first in the document, then first in the item).  ``decontaminate`` removes the
contaminated documents.

Method.  Each task cuts its documents into shards of about ``SHARD`` words (whole documents)
and builds the suffix array of a shard by prefix doubling, each round one sort of packed
(rank, next rank, position) words over what is still tied; a sentinel of its own ends every
document.  All suffixes of all items are binary-searched together in the array.  The
neighbours of the place found give the longest match, and the range of suffixes that share
the required prefix gives every location.

Cases.  Null and empty texts match nothing; items without words are ignored.  Rows with a
null doc_id are searched and removed like others and are reported with a null doc_id.
Several rows with one doc_id are reported as one document (longest match); each is kept or
removed for its own text.  Other columns pass through unchanged whatever their names.  Empty
documents or an empty benchmark give no matches, and nothing is removed.  The benchmark is
shipped to the tasks in slices of ``SLICE`` words, one pass over the documents for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as tc
from .common import table

MIN_WORDS = 8
SHARD = 1 << 19
SLICE = 1 << 21
U64 = np.uint64


def suffix_array(words: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, array): words with a sentinel after each document (0), and the sorted starts of all suffixes of words.

    Suffixes compare word by word as unsigned hashes and end at their document's sentinel,
    which is less than any word.
    """
    docs = len(bound) - 1
    size = len(words) + docs
    seq = np.zeros(size, U64)
    place = np.arange(len(words)) + np.repeat(np.arange(docs), np.diff(bound))
    seq[place] = words
    if not len(words):
        return seq, np.zeros(0, np.int64)
    order = _order(words >> U64(len(words).bit_length()), len(words))
    w = words[order]
    if (w[1:] < w[:-1]).any():  # two words that differ only in the bits that made room for the position
        order = np.argsort(words, kind="stable")
        w = words[order]
    rank = np.zeros(size, np.int64)
    rank[bound[1:] + np.arange(docs)] = np.arange(docs)
    new = np.concatenate(([True], w[1:] != w[:-1]))
    rank[place[order]] = docs + np.flatnonzero(new)[np.cumsum(new) - 1]
    out = np.empty(size, np.int64)
    out[:docs] = bound[1:] + np.arange(docs)
    out[docs:] = place[order]
    begin = np.flatnonzero(np.concatenate((new, [True])))
    count = np.diff(begin)
    tied = place[order[np.repeat(count > 1, count)]]
    step = 1
    while len(tied):
        bits = size.bit_length()
        key = (rank[tied].astype(U64) << U64(bits)) | rank[tied + step].astype(U64)
        order = _order(key, size, tied) if 3 * bits <= 64 else np.lexsort((rank[tied + step], rank[tied]))
        t = tied[order]
        old, key = rank[t], key[order] if 2 * bits <= 64 else None
        nxt = rank[t + step]
        head = np.concatenate(([True], old[1:] != old[:-1]))
        new = head | np.concatenate(([True], nxt[1:] != nxt[:-1]))
        at = np.arange(len(t))
        block = np.maximum.accumulate(np.where(head, at, 0))
        mine = np.maximum.accumulate(np.where(new, at, 0))
        out[old + at - block] = t
        rank[t] = old + mine - block
        begin = np.flatnonzero(np.concatenate((new, [True])))
        count = np.diff(begin)
        tied = t[np.repeat(count > 1, count)]
        step *= 2
    return seq, out[docs:]


def _order(key: np.ndarray, size: int, place: np.ndarray | None = None) -> np.ndarray:
    """argsort of keys that leave room for a position below: one plain sort of packed words."""
    bits = size.bit_length()
    n = len(key)
    packed = (key << U64(bits)) | np.arange(n, dtype=U64)
    packed.sort()
    return (packed & U64((1 << bits) - 1)).astype(np.int64)


class Suffixes:
    """All word suffixes of the benchmark items of a slice."""

    def __init__(self, ids: list, texts: list[str | None], min_words: int):
        w = tc.Words(texts)
        size = np.diff(w.bound)
        self.ids, self.words = ids, w.hash
        self.item = np.repeat(np.arange(len(ids)), size)
        self.start = np.arange(len(w.hash))
        self.end = np.repeat(w.bound[1:], size)
        self.first = np.repeat(w.bound[:-1], size)
        self.need = np.repeat(np.minimum(size, min_words), size)
        ok = self.end - self.start >= self.need
        for name in ("item", "start", "end", "first", "need"):
            setattr(self, name, getattr(self, name)[ok])


def _common(test: np.ndarray, seq: np.ndarray, start: np.ndarray, end: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Words that test[start:end] and the training suffix at pos have in common, for many pairs."""
    lcp = np.zeros(len(start), np.int64)
    live = np.arange(len(start))
    while len(live):
        d = lcp[live]
        live, d = live[start[live] + d < end[live]], d[start[live] + d < end[live]]
        same = test[start[live] + d] == seq[pos[live] + d]
        live = live[same]
        lcp[live] += 1
    return lcp


def _bounds(test: np.ndarray, seq: np.ndarray, array: np.ndarray, start: np.ndarray, end: np.ndarray, upper: bool) -> np.ndarray:
    """For each test[start:end] the first place in the array whose suffix is not less (upper: is greater and doesn't begin with it)."""
    lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(array), np.int64)
    while True:
        live = np.flatnonzero(lo < hi)
        if not len(live):
            return lo
        mid = (lo[live] + hi[live]) // 2
        pos = array[mid]
        s, e = start[live], end[live]
        lcp = _common(test, seq, s, e, pos)
        whole = s + lcp == e
        less = np.zeros(len(live), bool)
        part = np.flatnonzero(~whole)
        less[part] = seq[pos[part] + lcp[part]] < test[s[part] + lcp[part]]
        right = less | (whole & upper)
        lo[live] = np.where(right, mid + 1, lo[live])
        hi[live] = np.where(right, hi[live], mid)


def search(test: Suffixes, words: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, words, word in document, word in item): the longest match of each pair that has one."""
    none = (np.zeros(0, np.int64),) * 5
    if not len(words) or not len(test.start):
        return none
    words = np.maximum(words, U64(1))  # 0 is the sentinel
    probe = np.maximum(test.words, U64(1))
    seq, array = suffix_array(words, bound)
    at = _bounds(probe, seq, array, test.start, test.end, False)
    longest = np.zeros(len(at), np.int64)
    for near in (at - 1, at):
        ok = (near >= 0) & (near < len(array))
        longest[ok] = np.maximum(longest[ok], _common(probe, seq, test.start[ok], test.end[ok], array[near[ok]]))
    hit = np.flatnonzero(longest >= test.need)
    if not len(hit):
        return none
    s, need = test.start[hit], test.need[hit]
    lo, hi = _bounds(probe, seq, array, s, s + need, False), _bounds(probe, seq, array, s, s + need, True)
    many = hi - lo
    which = np.repeat(hit, many)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    pos = array[np.repeat(lo, many) + offset]
    begin, end = test.start[which], test.end[which]
    # a run that goes on to the left is part of a longer one
    inner = (begin > test.first[which]) & (pos > 0)
    inner[inner] = probe[begin[inner] - 1] == seq[pos[inner] - 1]
    which, pos, begin, end = which[~inner], pos[~inner], begin[~inner], end[~inner]
    size = _common(probe, seq, begin, end, pos)
    ends = bound[1:] + np.arange(len(bound) - 1)
    doc = np.searchsorted(ends, pos, side="right")
    item, where, inside = test.item[which], pos - bound[doc] - doc, begin - test.first[which]
    order = np.lexsort((inside, where, -size, item, doc))
    doc, item, size, where, inside = doc[order], item[order], size[order], where[order], inside[order]
    best = np.ones(len(doc), bool)
    best[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    return doc[best], item[best], size[best], where[best], inside[best]


def _shards(it: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Batches with the words of their texts, about limit words together."""
    held, hashes, counts, size = [], [], [], 0
    for part, texts in tc.batches(it):
        w = tc.Words(texts)
        held.append(part)
        hashes.append(w.hash)
        counts.append(np.diff(w.bound))
        size += len(w.hash)
        if size >= limit:
            yield held, np.concatenate(hashes), np.concatenate(([0], np.cumsum(np.concatenate(counts))))
            held, hashes, counts, size = [], [], [], 0
    if held:
        yield held, np.concatenate(hashes), np.concatenate(([0], np.cumsum(np.concatenate(counts))))


def _slices(benchmark: DataFrame, min_words: int):
    """Broadcast suffix sets of the items, each of at most SLICE words or one item."""
    spark = benchmark.sparkSession
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += row[1].count(" ") + 1
        if size >= SLICE:
            yield spark.sparkContext.broadcast(Suffixes(ids, texts, min_words))
            ids, texts, size = [], [], 0
    if ids:
        yield spark.sparkContext.broadcast(Suffixes(ids, texts, min_words))


def matches(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, shard: int = SHARD) -> DataFrame:
    """(doc_id, item_id, match_words, doc_word, item_word): see the module's text."""
    schema = "doc_id long, item_id long, match_words int, doc_word int, item_word int"
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def one(sent):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for held, words, bound in _shards(it, shard):
                doc, item, size, where, inside = search(sent.value, words, bound)
                if len(doc):
                    ids = pa.chunked_array([b.column(0) for b in held]).take(pa.array(doc)).combine_chunks()
                    items = pa.array([sent.value.ids[i] for i in item.tolist()], pa.int64())
                    yield pa.RecordBatch.from_arrays([ids, items] + [pa.array(x.astype(np.int32)) for x in (size, where, inside)], ["doc_id", "item_id", "match_words", "doc_word", "item_word"])

        return slim.mapInArrow(run, schema)

    found = None
    for sent in _slices(benchmark, min_words):
        found = one(sent) if found is None else found.unionByName(one(sent))
    if found is None:
        return docs.sparkSession.createDataFrame([], schema)
    best = F.max(F.struct("match_words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"))).alias("x")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.match_words", (-F.col("x.d")).alias("doc_word"), (-F.col("x.i")).alias("item_word"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, shard: int = SHARD) -> DataFrame:
    """The documents that no item contaminates, with all their columns, without a shuffle."""
    out = docs
    for sent in _slices(benchmark, min_words):

        def run(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for held, words, bound in _shards(it, shard):
                doc = search(sent.value, words, bound)[0]
                keep = np.ones(len(bound) - 1, bool)
                keep[doc] = False
                at = 0
                for b in held:
                    yield b.filter(pa.array(keep[at : at + b.num_rows]))
                    at += b.num_rows

        out = out.mapInArrow(run, docs.schema)
    return out


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TOK = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, {_TOK} AS w FROM documents),
b AS (SELECT row_number() OVER () AS row_b, item_id, {_TOK} AS w FROM benchmark),
d1 AS (SELECT row_id, doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM d),
b1 AS (SELECT row_b, item_id, least({MIN_WORDS}, len(w)) AS need, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM b),
b3 AS (SELECT row_b, item_id, need, p, word, lead(word) OVER w AS w2, lead(word, 2) OVER w AS w3 FROM b1 WINDOW w AS (PARTITION BY row_b ORDER BY p)),
d3 AS (SELECT row_id, doc_id, p, word, lead(word) OVER w AS w2, lead(word, 2) OVER w AS w3 FROM d1 WINDOW w AS (PARTITION BY row_id ORDER BY p)),
hit AS (
  SELECT row_id, doc_id, row_b, item_id, need, d3.p, b3.p AS q FROM d3 JOIN b3 ON d3.word = b3.word AND d3.w2 = b3.w2 AND d3.w3 = b3.w3
  WHERE b3.need >= 3),
run AS (SELECT *, p - row_number() OVER (PARTITION BY row_id, row_b, p - q ORDER BY p) AS island FROM hit),
long AS (SELECT row_id, doc_id, row_b, item_id, p - q AS diagonal, island, count(*) + 2 AS n, min(p) AS dw, min(q) AS iw, min(need) AS need FROM run GROUP BY ALL),
best AS (
  SELECT doc_id, item_id, n, dw, iw, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n DESC, dw, iw) AS k FROM long WHERE n >= need)
SELECT doc_id, item_id, n AS match_words, dw AS doc_word, iw AS item_word FROM best WHERE k = 1
"""
