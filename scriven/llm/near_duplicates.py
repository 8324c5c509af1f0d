"""N-gram Jaccard join by MinHash banding, and removal of near duplicates.

Semantics.  A document is the set of its word n-grams (see textcore; a text of 1 to n-1
words has one n-gram, all of it).  Documents with equal sets form a class, named by its least
doc_id.  Two classes are linked if their Jaccard similarity is at least ``threshold``.

* ``jaccard_links`` has a row for each document that has a copy or a link: doc_id, class_id,
  n_copies (documents of its class) and n_links (documents of all classes linked to its own).
* ``jaccard_join`` has a row for each link: doc_id_a, doc_id_b (the names of the two classes,
  the less first) and jaccard.
* ``duplicates`` and ``deduplicate`` keep one document of each group that links connect.

Copies aren't expanded into pairs, so what they add is linear.

Cases.  Null and empty texts, and texts without letters or digits, have no n-grams and match
nothing.  Rows with a null doc_id match nothing; deduplication keeps them.  Rows that repeat
a doc_id are one document with the n-gram sets of each row; they stay or go together.  Other
columns are ignored by the join and untouched by deduplication, whatever their names.  An
empty table gives an empty result.

Plan.  Signatures are computed in one pass without a shuffle.  Equal sets are grouped, then
band hashes are counted (with partial sums) and joined back where several classes share one: a
*bucket*, of which no list is ever made.  Each class has a home, its fullest bucket; homes are
cut into blocks of about ``BLOCK`` classes, and a class is sent to each pair of blocks in which
some bucket brings it together with another.  There all sets are compared exactly by
blocked matrix products.  So near copies meet in a few tasks however many bands they share,
what is sent grows with the pairs that share a band and not with what they are connected to,
and no bucket, candidate or partner is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as tc
from .common import components, groups, materialize, small, table

N = 3
THRESHOLD = 0.5
RECALL = 0.999
#: Rows of a band, and classes in a block.
ROWS = 3
BLOCK = 512
U64 = np.uint64


def bands_for(threshold: float, recall: float, rows: int = ROWS) -> tuple[int, int]:
    """(bands, rows): the fewest bands of so many rows that a pair at the threshold shares with the given probability."""
    if not 0 < threshold <= 1 or not 0 < recall < 1:
        raise ValueError("threshold and recall must lie between 0 and 1")
    if threshold == 1:
        return 1, rows
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))), rows


def _family(count: int) -> tuple[np.ndarray, np.ndarray]:
    g = np.random.default_rng(20240229)
    return (g.integers(0, 2**32, count, dtype=np.uint32) | np.uint32(1), g.integers(0, 2**32, count, dtype=np.uint32))


def band_hashes(grams: np.ndarray, bound: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash a band for every non-empty set, shape (sets, bands)."""
    at = bound[:-1]
    a, b = _family(bands * rows)
    half = (grams >> U64(32)).astype(np.uint32)
    out = np.zeros((len(at), bands), U64)
    for k in range(bands):
        for r in range(rows):
            low = np.minimum.reduceat(half * a[k * rows + r] + b[k * rows + r], at)
            out[:, k] = out[:, k] * U64(0x9E3779B97F4A7C55) + low + U64(1)
        out[:, k] = tc.mix(out[:, k] ^ U64(k + 1))
    return out


def set_keys(values: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """64-bit fingerprint of each non-empty set of distinct values."""
    at = bound[:-1]
    v = tc.mix(values + U64(0x632BE59BD9B4E019))
    return tc.mix(np.add.reduceat(v, at) ^ (np.add.reduceat(v * v, at) * U64(0x9E3779B97F4A7C55)) ^ np.diff(bound).astype(U64))


def _signatures(n: int, bands: int, rows: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tc.batches(it):
            v, bound = tc.sorted_sets(*tc.doc_ngrams(tc.Words(texts), n))
            have = np.flatnonzero(np.diff(bound))
            if not len(have):
                continue
            tight = np.concatenate((bound[:-1][have], bound[-1:]))
            flat = pa.array(band_hashes(v, tight, bands, rows).view(np.int64).reshape(-1))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(part.schema.get_field_index("doc_id")).take(pa.array(have)),
                    pa.array(set_keys(v, tight).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(have) + 1, dtype=np.int32) * bands), flat),
                ],
                ["doc_id", "key", "bands"],
            )

    return run


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, key of the n-gram set, band hashes) of each document that has n-grams."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return slim.mapInArrow(_signatures(n, bands, rows), "doc_id long, key long, bands array<long>")


def classes(signed: DataFrame) -> DataFrame:
    """(key, class_id, band hashes) of each distinct n-gram set."""
    return signed.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.first("bands").alias("bands"))


def candidates(cls: DataFrame, block: int) -> DataFrame:
    """(key, class_id, own, lo, hi): each class with its block, for each pair of blocks that it is compared in."""
    banded = cls.select("key", F.explode("bands").alias("band"))
    full = small(materialize(banded.groupBy("band").agg(F.count("*").alias("m")).where("m > 1"), "buckets"))
    hits = materialize(banded.join(full, "band"), "hits")
    home = hits.groupBy("key").agg(F.max(F.struct("m", "band")).alias("top")).select("key", F.col("top.band").alias("home"))
    homes = home.groupBy("home").agg(F.ceil(F.count("*") / F.lit(block)).alias("blocks"))
    own = F.xxhash64("home", F.pmod(F.xxhash64("key"), F.col("blocks"))).alias("own")
    placed = materialize(home.join(homes, "home").select("key", own), "blocks")
    here = hits.select("band", "key").join(small(placed), "key")
    there = here.groupBy("band", F.col("own").alias("other")).agg(F.count("*").alias("many"))
    met = here.join(there, "band").where("own <> other or many > 1")
    pairs = met.select("key", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).distinct()
    return pairs.join(cls.select("key", "class_id"), "key")


#: Of a class in a pair of blocks.
_CAND = ("key", "class_id", "n_copies", "own", "lo", "hi")


def _with_sets(group: pa.Table, n: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """(rows with the n-gram set of their class, each once, the sets one after the other, sizes); other rows of a repeated doc_id go."""
    texts, key = group["text"].to_pylist(), group["key"].to_numpy()
    rows, sets, seen = [], [], set()
    for a, z in tc.chunked(texts):
        v, bound = tc.sorted_sets(*tc.doc_ngrams(tc.Words(texts[a:z]), n))
        have = np.flatnonzero(np.diff(bound))
        if not len(have):
            continue
        tight = np.concatenate((bound[:-1][have], bound[-1:]))
        good = have[set_keys(v, tight).view(np.int64) == key[a:z][have]]
        for i in good.tolist():
            if key[a + i] not in seen:
                seen.add(key[a + i])
                rows.append(a + i)
                sets.append(v[bound[i] : bound[i + 1]].copy())
    return group.select(list(_CAND)).take(pa.array(rows, pa.int64())), np.concatenate([np.zeros(0, U64), *sets]), np.array([len(x) for x in sets], np.int64)


def _verify(n: int, threshold: float, emit: str):
    """Compare the classes of each (lo, hi) exactly; emit pairs, what each class gains in links, or edges that span each group."""

    def rows_of(group: pa.Table, v: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs at or over the threshold: positions in the group, and their similarity."""
        own = group["own"].to_numpy()
        lo, hi = group["lo"][0].as_py(), group["hi"][0].as_py()
        owner = np.repeat(np.arange(len(bound)), bound)
        # only n-grams that two classes share count; columns of the incidence matrix
        order = np.argsort(v, kind="stable")
        sv, so = v[order], owner[order]
        first = np.concatenate(([True], sv[1:] != sv[:-1]))
        col = np.cumsum(first) - 1
        shared = np.bincount(col) > 1
        new = np.cumsum(shared) - 1
        keep = shared[col]
        so, col = so[keep], new[col[keep]]
        g, width = len(bound), max(64, min(4096, (1 << 22) // max(1, len(bound))))
        both = np.zeros((g, g), np.float32)
        cols = int(shared.sum())
        cut = np.searchsorted(col, np.arange(0, cols + width, width))
        for k in range(len(cut) - 1):
            o, c = so[cut[k] : cut[k + 1]], col[cut[k] : cut[k + 1]] - k * width
            if not len(o):
                continue
            x = np.zeros((g, width), np.float32)
            x[o, c] = 1
            both += x @ x.T
        i, j = np.triu_indices(g, 1)
        if lo != hi:
            cross = own[i] != own[j]
            i, j = i[cross], j[cross]
        inter = both[i, j].astype(np.int64)
        size = bound.astype(np.int64)
        jac = inter / np.maximum(size[i] + size[j] - inter, 1)
        good = jac >= threshold
        return i[good], j[good], jac[good]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(it, "lo", "hi"):
            group, v, size = _with_sets(group, n)
            if group.num_rows < 2:
                continue
            i, j, jac = rows_of(group, v, size)
            del v
            if not len(i):
                continue
            key = group["key"].to_numpy()
            if emit == "edges":
                i, j = _forest(group.num_rows, i, j)
                yield pa.RecordBatch.from_arrays([pa.array(key[i]), pa.array(key[j])], ["a", "b"])
            elif emit == "links":
                n_docs = group["n_copies"].to_numpy()
                gained = np.bincount(i, n_docs[j], len(key)) + np.bincount(j, n_docs[i], len(key))
                some = np.flatnonzero(gained)
                yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(gained[some].astype(np.int64))], ["key", "n"])
            else:
                own = group["class_id"].to_numpy()
                for a in range(0, len(i), 1 << 16):
                    x, y = own[i[a : a + (1 << 16)]], own[j[a : a + (1 << 16)]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(np.round(jac[a : a + (1 << 16)], 6))], ["doc_id_a", "doc_id_b", "jaccard"])

        tc.give_back()

    return run


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, least member) for all but the least member of each connected part."""
    label = np.arange(n)
    while len(i):
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (before == label).all():
            break
    own = np.flatnonzero(label != np.arange(n))
    return own, label[own]


def _compared(docs: DataFrame, cls: DataFrame, copies: DataFrame | None, n: int, threshold: float, emit: str, block: int) -> DataFrame:
    cand = candidates(cls, block)
    cand = materialize(cand.withColumn("n_copies", F.lit(1).cast("long")) if copies is None else cand.join(copies, "key"), "candidates")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    with_text = text.join(small(cand), text["doc_id"] == cand["class_id"]).select(*_CAND, "text")
    return with_text.repartition("lo", "hi").sortWithinPartitions("lo", "hi", "key").mapInArrow(_verify(n, threshold, emit), {"edges": "a long, b long", "links": "key long, n long", "pairs": "doc_id_a long, doc_id_b long, jaccard double"}[emit])


def _begin(docs: DataFrame, n: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) of all documents, and the classes."""
    signed = materialize(signatures(docs, n, *bands_for(threshold, recall)), "signatures")
    return signed.select("doc_id", "key").distinct(), materialize(classes(signed), "classes")


def jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(doc_id_a, doc_id_b, jaccard) of all linked classes; see the module's text."""
    _, cls = _begin(docs, n, threshold, recall)
    return _compared(docs, cls, None, n, threshold, "pairs", block)


def jaccard_links(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, n_copies, n_links) of documents with copies or links; see the module's text."""
    members, cls = _begin(docs, n, threshold, recall)
    copies = materialize(members.groupBy("key").agg(F.count("*").alias("n_copies")), "copies")
    links = _compared(docs, cls, copies, n, threshold, "links", block).groupBy("key").agg(F.sum("n").alias("n_links"))
    found = cls.select("key", "class_id").join(copies, "key").join(links, "key", "left").where("n_copies > 1 or n_links > 0")
    found = materialize(found.select("key", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "linked")
    return members.join(small(found), "key").select("doc_id", "class_id", "n_copies", "n_links")


def duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(doc_id, keeper): each document that goes, with the document of its group (linked by matches) that stays, the least doc_id."""
    members, cls = _begin(docs, n, threshold, recall)
    linked = materialize(components(_compared(docs, cls, None, n, threshold, "edges", block)), "groups")
    own = cls.select("key", "class_id").join(linked, cls["key"] == linked["node"], "left").select("key", "class_id", F.coalesce("root", "key").alias("root"))
    keeper = own.groupBy("root").agg(F.min("class_id").alias("keeper"))
    keepers = materialize(own.join(keeper, "root").select("key", "keeper"), "keepers")
    return members.join(keepers, "key").where("doc_id <> keeper").groupBy("doc_id").agg(F.min("keeper").alias("keeper"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The documents without those in duplicates(); all columns, rows with a null doc_id too."""
    gone = small(materialize(duplicates(docs, **options).select(F.col("doc_id").alias("__gone")), "gone"))
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_links(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH tok AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= {N} THEN list_transform(range(1, len(w) - {N} + 2), lambda i: array_to_string(w[i:i + {N - 1}], ' ')) ELSE [array_to_string(w, ' ')] END)) AS g
  FROM tok WHERE len(w) > 0),
cls AS (
  SELECT row_number() OVER (ORDER BY min(doc_id)) AS k, list_sort(list_distinct(list(doc_id))) AS ids, g FROM sets GROUP BY g),
grams AS (SELECT k, unnest(g) AS gram FROM cls),
shared AS (
  SELECT a.k AS ka, b.k AS kb, count(*) AS c FROM grams a JOIN grams b ON a.gram = b.gram AND a.k < b.k GROUP BY 1, 2),
links AS (
  SELECT ka, kb FROM shared JOIN cls x ON x.k = ka JOIN cls y ON y.k = kb WHERE c / (len(x.g) + len(y.g) - c) >= {THRESHOLD}),
linked AS (SELECT ka AS k, kb AS other FROM links UNION ALL SELECT kb, ka FROM links),
n AS (SELECT l.k, sum(len(o.ids)) AS n_links FROM linked l JOIN cls o ON o.k = l.other GROUP BY l.k)
SELECT unnest(ids) AS doc_id, ids[1] AS class_id, len(ids) AS n_copies, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM cls LEFT JOIN n USING (k) WHERE len(ids) > 1 OR n_links > 0
"""
