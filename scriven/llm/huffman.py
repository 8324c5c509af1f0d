"""Token ids as canonical, length-limited Huffman codes.

Each document's ids become one bit stream.  Code lengths come from counts over all documents
by the package-merge method, at most ``LONGEST`` bits (more only if the ids in use need
more), and codes are canonical: sorted by (length, id), so the lengths alone restore the
code.  The stream is cut into blocks of ``BLOCK`` ids; ``checkpoints`` holds the bit offset
of each block, so blocks are decoded independently, here all at once, one id of every block
in each step, by a table of all ``2**LONGEST`` prefixes.

Rows: doc_id, n_ids, n_bits, checkpoints, payload (bytes, last one padded with zero bits),
round_trip (decoding gave the ids back).  ``write`` stores them next to the code book.

Cases.  Null ids give null in all columns but doc_id; empty ids give an empty payload without
checkpoints.  Rows with a null doc_id and repeated rows are coded like others.  Negative ids
are an error.  Ties in counts are broken by id, so the code doesn't depend on partitions.
Other columns are not read.  An empty table gives an empty result and an empty code book; a
single id in use gets a code of one bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import materialize, table

LONGEST = 16
BLOCK = 256


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most so many bits for positive counts (package-merge)."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    longest = max(longest, (n - 1).bit_length())
    order = np.lexsort((np.arange(n), counts))
    leaf = counts[order].astype(np.float64)
    weight, kinds = leaf, [np.ones(n, bool)]
    for _ in range(longest - 1):
        pairs = len(weight) // 2
        packed = weight[: 2 * pairs : 2] + weight[1 : 2 * pairs : 2]
        both = np.concatenate((leaf, packed))
        by = np.argsort(both, kind="stable")
        weight = both[by]
        kinds.append(by < n)
    length, take = np.zeros(n, np.int64), 2 * (n - 1)
    for kind in reversed(kinds):  # the first `take` items of a level: its leaves, and packages of the level below
        leaves = int(kind[:take].sum())
        length[:leaves] += 1
        take = 2 * (take - leaves)
    out = np.empty(n, np.int64)
    out[order] = length
    return out


@dataclass
class Code:
    """Canonical code: ids in use, their lengths and codes, and decoding tables of all prefixes."""

    ids: np.ndarray
    length: np.ndarray

    def __post_init__(self) -> None:
        order = np.lexsort((self.ids, self.length))
        self.ids, self.length = self.ids[order].astype(np.int64), self.length[order].astype(np.int64)
        self.longest = int(self.length[-1]) if len(self.ids) else 1
        if self.longest > 24:
            raise ValueError("codes of more than 24 bits aren't supported")
        span = np.left_shift(np.int64(1), self.longest - self.length)
        begin = np.cumsum(span) - span
        self.code = begin >> (self.longest - self.length)
        size = int(self.ids.max()) + 1 if len(self.ids) else 0
        #: By id its code and, in the last 5 bits, its length, 0 without one; by prefix its id and the length.
        self.by_id = np.zeros(size, np.int64)
        self.by_id[self.ids] = self.code << 5 | self.length
        self.prefix = np.full(1 << self.longest, self.ids[0] << 5 | self.length[0] if len(self.ids) else 1, np.int64)
        self.prefix[: int(span.sum())] = np.repeat(self.ids << 5 | self.length, span)

    def __getstate__(self) -> tuple:
        return self.ids, self.length

    def __setstate__(self, state: tuple) -> None:
        self.ids, self.length = state
        self.__post_init__()

    def encode(self, ids: np.ndarray, bound: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, first byte of each list, bits of each list, bit offsets of blocks in their list, first block of each list)."""
        code = self.by_id[ids]
        if len(code) and code.min() == 0:
            raise ValueError("an id has no code")
        size = code & 31
        code >>= 5
        total = np.concatenate(([0], np.cumsum(size)))
        bits = np.diff(total[bound])
        first = np.concatenate(([0], np.cumsum((bits + 7) // 8)))
        count = np.diff(bound)
        inside = total[:-1] - np.repeat(total[bound[:-1]], count)
        where = inside + np.repeat(first[:-1] * 8, count)
        # codes are put into words of 32 bits: their sums are their unions, as they don't overlap
        spot, need = where >> 5, (int(first[-1]) >> 2) + 2
        word = code << (64 - size - (where & 31))
        new = np.ones(len(spot), bool)
        new[1:] = spot[1:] != spot[:-1]
        new = np.flatnonzero(new)
        data = np.zeros(need, np.uint64)
        if len(new):
            total = np.add.reduceat(word.view(np.uint64), new)  # of those that begin in a word
            data[spot[new]] = total >> np.uint64(32)
            data[spot[new] + 1] |= total & np.uint64(0xFFFFFFFF)
        data = data.astype(">u4").view(np.uint8)
        step = np.arange(len(ids)) - np.repeat(bound[:-1], count)
        head = step % block == 0
        blocks = np.concatenate(([0], np.cumsum((count + block - 1) // block)))
        return data[: int(first[-1])], first, bits, inside[head], blocks

    def decode(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Ids of blocks that begin at these bits of the data and have so many ids, one block after the other."""
        data = np.concatenate((data, np.zeros(4, np.uint8))).astype(np.uint32)
        words = data[:-3] << 24  # the 32 bits from each byte on
        for k in (1, 2, 3):
            words |= data[k : len(data) - 3 + k] << (24 - 8 * k)
        bit, out = start.astype(np.int64).copy(), np.zeros(int(size.sum()), np.int64)
        to = np.cumsum(size) - size
        order = np.argsort(-size, kind="stable")
        bit, to, left = bit[order], to[order], size[order]
        shift, mask = 32 - self.longest, (1 << self.longest) - 1
        for step in range(int(size.max()) if len(size) else 0):
            live = int(np.searchsorted(-left, -step, side="left"))
            now = bit[:live]
            found = self.prefix[(words[now >> 3].astype(np.int64) >> (shift - (now & 7))) & mask]
            out[to[:live] + step] = found >> 5
            now += found & 31
        return out


def counts(tokens: DataFrame) -> DataFrame:
    """(id, n) over all rows of (doc_id, token_ids)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in it:
            ids = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            if ids.min() < 0:
                raise ValueError("negative id")
            n = np.bincount(ids, minlength=len(total))
            n[: len(total)] += total
            total = n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    return tokens.select(F.col("token_ids").cast("array<int>")).mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def fit(tokens: DataFrame, longest: int = LONGEST) -> Code:
    """The code of all ids in use; their number is bounded by the vocabulary."""
    t = counts(tokens).orderBy("id").toArrow()
    return Code(t["id"].to_numpy(), code_lengths(t["n"].to_numpy(), longest))


def encode(tokens: DataFrame, code: Code, block: int = BLOCK) -> DataFrame:
    sent = tokens.sparkSession.sparkContext.broadcast(code)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for a in range(0, whole.num_rows, 512):
                part = whole.slice(a, 512)
                lists = part.column(1)
                size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                bound = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                data, first, bits, marks, blocks = sent.value.encode(ids, bound, block)
                per = np.diff(blocks)
                step = np.arange(len(marks)) - np.repeat(blocks[:-1], per)
                back = sent.value.decode(data, marks + np.repeat(first[:-1] * 8, per), np.minimum(block, np.repeat(size, per) - step * block).astype(np.int64))
                wrong = np.concatenate(([0], np.cumsum(back != ids)))[bound]
                null = lists.is_null().to_numpy(zero_copy_only=False)
                raw = data.tobytes()
                payload = [None if n else raw[x:y] for n, x, y in zip(null.tolist(), first.tolist(), first[1:].tolist())]
                offsets = pa.array(blocks.astype(np.int32), mask=np.concatenate((null, [False])))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(size.astype(np.int32), mask=null), pa.array(bits, mask=null), pa.ListArray.from_arrays(offsets, pa.array(marks)), pa.array(payload, pa.binary()), pa.array(np.diff(wrong) == 0, mask=null)],
                    ["doc_id", "n_ids", "n_bits", "checkpoints", "payload", "round_trip"],
                )

    slim = tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("token_ids").cast("array<int>").alias("token_ids"))
    return slim.mapInArrow(run, "doc_id long, n_ids int, n_bits long, checkpoints array<long>, payload binary, round_trip boolean")


def decode(coded: DataFrame, code: Code, block: int = BLOCK) -> DataFrame:
    """(doc_id, token_ids) from rows of encode."""
    sent = coded.sparkSession.sparkContext.broadcast(code)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in it:
            doc, n, marks, payload = (part.column(i) for i in range(4))
            null = n.is_null().to_numpy(zero_copy_only=False)
            size = n.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            chunks = [p or b"" for p in payload.to_pylist()]
            first = np.concatenate(([0], np.cumsum([len(p) for p in chunks])))[:-1]
            per = (size + block - 1) // block
            step = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
            start = marks.flatten().to_numpy(zero_copy_only=False) + np.repeat(first * 8, per)
            ids = sent.value.decode(np.frombuffer(b"".join(chunks), np.uint8), start, np.minimum(block, np.repeat(size, per) - step * block))
            bound = np.concatenate(([0], np.cumsum(size)))
            yield pa.RecordBatch.from_arrays([doc, bpe.list_array(ids.astype(np.int32), bound, null)], ["doc_id", "token_ids"])

    return coded.select("doc_id", "n_ids", "checkpoints", "payload").mapInArrow(run, "doc_id long, token_ids array<int>")


def code_book(spark: SparkSession, code: Code) -> DataFrame:
    """(id, bits, code) of each id in use; the lengths restore the codes."""
    return spark.createDataFrame(list(zip(code.ids.tolist(), code.length.tolist(), code.code.tolist())), "id long, bits int, code long")


def write(tokens: DataFrame, path: str, longest: int = LONGEST, block: int = BLOCK) -> None:
    """Store coded documents under path/documents and their code book under path/code_book."""
    code = fit(tokens, longest)
    encode(tokens, code, block).write.parquet(f"{path}/documents")
    code_book(tokens.sparkSession, code).coalesce(1).write.parquet(f"{path}/code_book")


def read(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(doc_id, token_ids) from what write stored."""
    rows = spark.read.parquet(f"{path}/code_book").select("id", "bits").toArrow()
    return decode(spark.read.parquet(f"{path}/documents"), Code(rows["id"].to_numpy(), rows["bits"].to_numpy()), block)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = materialize(bpe.token_lists(table(spark, sf_dir, "documents"), bpe.load()), "tokens")
    return encode(tokens, fit(tokens))
