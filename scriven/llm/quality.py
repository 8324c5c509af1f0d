"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its features: each token (maximal run of
non-blanks, case kept), each pair of adjacent tokens, and each character n-gram of
``SIZES`` within a token and the blanks around it, hashed to ``BUCKETS`` rows.  Two softmax outputs on
the shared mean give the probabilities of low quality and of toxicity.  Training is plain
minibatch stochastic gradient descent in numpy.

Scoring is linear up to the softmax, so the output weights are folded into the vectors once
and a document's logits are means of one number a feature and output.

Fitting uses a bounded sample, at most ``FIT_DOCS`` labelled documents chosen by a hash of
doc_id, whole texts.  Everything else is computed for all documents.

Decision.  A document is rejected if its probability of low quality exceeds
``REJECT_QUALITY`` or that of toxicity exceeds ``REJECT_TOXIC``; on held-out labels (sf0.1)
nearly all clean documents stay.

Cases.  Null and empty texts have no features: their probabilities are those of the biases
alone with zero mean, reported as null, and they are rejected.  Rows with a null doc_id are
scored; labels with a null doc_id or a null label are ignored; of repeated labels of a
document the least quality and greatest toxicity count.  Repeated rows are scored one by one.  Other columns pass
through ``accept`` unchanged whatever their names.  Without labels every document with text
is accepted with probability 0.5.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as tc
from .common import small, table

SIZES = (3, 5)
BUCKETS = 1 << 16
DIM = 8
FIT_DOCS = 5000
EPOCHS = 24
BATCH = 64
RATE = 0.5
REJECT_QUALITY = 0.7
REJECT_TOXIC = 0.5
U64 = np.uint64


@dataclass
class Model:
    """Per bucket the folded contribution to both logits (positive: low quality, toxic), and the biases."""

    table: np.ndarray
    bias: np.ndarray


def _features(texts: list[str | None], shift: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all features of each kind, a block at a time, and where each text's begin."""
    words = tc.Words(texts, kind="solid")
    yield (words.hash >> U64(shift)).astype(np.int32), words.bound
    pairs = tc.ngram_hashes(words.hash, 2)
    last = np.zeros(len(words.hash), bool)
    last[words.bound[1:][words.bound[1:] > 0] - 1] = True
    same = ~last[: len(pairs)]
    yield (pairs[same] >> U64(shift)).astype(np.int32), np.concatenate(([0], np.cumsum(same)))[np.minimum(words.bound, len(same))]
    seq = tc.Characters(texts, tc.solid(), False)
    for n in SIZES:
        for at, h in seq.grams(n):
            yield (h >> U64(shift)).astype(np.int32), np.searchsorted(at, seq.first)


def bags(texts: list[str | None], buckets: int = BUCKETS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its buckets and their shares of its features."""
    shift, out = 64 - (buckets.bit_length() - 1), []
    for a, z in tc.chunked(texts):
        parts = [(b, np.repeat(np.arange(z - a), np.diff(cut))) for b, cut in _features(texts[a:z], shift)]
        key = np.concatenate([o * buckets + b for b, o in parts])
        key, count = np.unique(key, return_counts=True)
        cut = np.searchsorted(key, np.arange(z - a + 1) * buckets)
        for i in range(z - a):
            c = count[cut[i] : cut[i + 1]]
            out.append(((key[cut[i] : cut[i + 1]] - i * buckets).astype(np.int32), (c / max(1, c.sum())).astype(np.float32)))
    return out


def train(data: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    """SGD on mean embeddings; labels has a column for each output, 0, 1 or -1 (unknown)."""
    g = np.random.default_rng(seed)
    vectors = g.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    out = np.zeros((dim, labels.shape[1], 2), np.float32)
    out += g.normal(0, 0.1, out.shape).astype(np.float32)
    bias = np.zeros((labels.shape[1], 2), np.float32)
    usable = np.array([i for i, (b, _) in enumerate(data) if len(b)], np.int64)
    steps, done = max(1, epochs * ((len(usable) + BATCH - 1) // BATCH)), 0
    for _ in range(epochs):
        g.shuffle(usable)
        for a in range(0, len(usable), BATCH):
            pick = usable[a : a + BATCH]
            ids = np.concatenate([data[i][0] for i in pick])
            share = np.concatenate([data[i][1] for i in pick])
            size = np.array([len(data[i][0]) for i in pick])
            mean = np.add.reduceat(vectors[ids] * share[:, None], np.cumsum(size) - size)
            z = np.einsum("nd,dhk->nhk", mean, out) + bias
            p = np.exp(z - z.max(axis=2, keepdims=True))
            p /= p.sum(axis=2, keepdims=True)
            y = labels[pick]
            p[np.arange(len(pick))[:, None], np.arange(y.shape[1])[None, :], np.maximum(y, 0)] -= 1
            p *= (y >= 0)[:, :, None]
            now = rate * (1 - done / steps)
            done += 1
            grad = np.einsum("nhk,dhk->nd", p, out)
            out -= now * np.einsum("nd,nhk->dhk", mean, p) / len(pick)
            bias -= now * p.sum(axis=0) / len(pick)
            rows = np.repeat(np.arange(len(pick)), size)
            step = now * BUCKET_GAIN / len(pick) * share
            for d in range(dim):
                vectors[:, d] -= np.bincount(ids, step * grad[rows, d], buckets)
    fold = out[:, :, 1] - out[:, :, 0]
    fold[:, (labels < 0).all(axis=0)] = 0  # an output without labels says 0.5
    return Model((vectors @ fold).astype(np.float32), (bias[:, 1] - bias[:, 0]).astype(np.float64))


#: Feature shares are small, so vectors learn faster than the output by this factor.
BUCKET_GAIN = 20000.0


def predict(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities of low quality and toxicity, number of features) of each text."""
    shift = 64 - (len(model.table).bit_length() - 1)
    total, size = np.zeros((len(texts), model.table.shape[1])), np.zeros(len(texts))
    columns = [np.ascontiguousarray(model.table[:, k]) for k in range(total.shape[1])]
    for bucket, cut in _features(texts, shift):
        size += np.diff(cut)
        for k, column in enumerate(columns):
            total[:, k] += np.diff(np.concatenate(([0], np.cumsum(column[bucket], dtype=np.float64)))[cut])
    z = total / np.maximum(size, 1)[:, None] + model.bias
    return 1 / (1 + np.exp(-z)), size


def decide(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probabilities, features, accepted) of each text."""
    p, size = predict(model, texts)
    return p, size, (size > 0) & (p[:, 0] <= REJECT_QUALITY) & (p[:, 1] <= REJECT_TOXIC)


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_DOCS) -> Model:
    lab = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    u = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 40))
    chosen = lab.orderBy(u, "doc_id").limit(limit)
    text = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = text.join(small(chosen, limit), "doc_id").orderBy(u, "doc_id", "text").limit(limit).toArrow()
    y = np.stack([1 - rows["quality"].fill_null(2).to_numpy(), rows["toxic"].fill_null(-1).to_numpy()], axis=1) if rows.num_rows else np.zeros((0, 2), int)
    y[(y < -1) | (y > 1)] = -1
    return train(bags(rows["text"].to_pylist()), y.astype(np.int64))


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, p_low_quality, p_toxic, accepted) of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tc.batches(it):
            p, size, ok = decide(sent.value, texts)
            none = size == 0
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.round(p[:, 0], 6), mask=none), pa.array(np.round(p[:, 1], 6), mask=none), pa.array(ok)], ["doc_id", "p_low_quality", "p_toxic", "accepted"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, p_low_quality double, p_toxic double, accepted boolean")


def accept(docs: DataFrame, model: Model) -> DataFrame:
    """The accepted documents, all columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tc.batches(it):
            yield part.filter(pa.array(decide(sent.value, texts)[2]))

    return docs.mapInArrow(run, docs.schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")))
