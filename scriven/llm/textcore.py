"""Vectorised word hashing shared by the corpus operators.

A *word* is a maximal run of letters and numbers (Unicode categories L* and N*) of the
lower-cased text; ``[^\\p{L}\\p{N}]+`` separates words.  A *token* is a maximal run of
characters that are not white space, with its case kept.

Texts are joined into one array of code points and every word is hashed in a handful of
numpy passes (a polynomial over the code points, finished with a 64-bit mixer), so the cost
is a few nanoseconds a character and no Python code runs for single words.  A null text is
treated as an empty text and has no words.
"""

from __future__ import annotations

import ctypes
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Code points handled in one numpy pass; bounds memory at roughly 60 bytes each.
PIECE = 1 << 18
_P = 0x9E3779B97F4A7C55
_PINV = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix), elementwise."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = sys.maxunicode + 1
    word = np.zeros(n, bool)
    solid = np.ones(n, bool)
    for c in range(n):
        ch = chr(c)
        if unicodedata.category(ch)[0] in "LN":
            word[c] = True
        if ch.isspace():
            solid[c] = False
    value = mix(np.arange(1, n + 1, dtype=U64) * U64(0xD6E8FEB86659FD93))
    with np.errstate(over="ignore"):
        up, down = np.full(2 * PIECE + 1, _P, U64), np.full(2 * PIECE + 1, _PINV, U64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
    return word, solid, value, up, down


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _runs(code: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of code points of a class."""
    inside = member[code]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(code) and inside[0]:
        edge = np.concatenate(([0], edge))
    if len(code) and inside[-1]:
        edge = np.concatenate((edge, [len(code)]))
    return edge[::2], edge[1::2]


def prefix_hash(code: np.ndarray) -> np.ndarray:
    """H with H[j]-H[i] = the polynomial of code[i:j], scaled by P**i; at most 2*PIECE points."""
    _, _, value, up, _ = _tables()
    out = np.zeros(len(code) + 1, U64)
    np.cumsum(value[code] * up[: len(code)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free hash of code[start:end] for many spans."""
    down = _tables()[4]
    return mix((prefix[end] - prefix[start]) * down[start])


def hash_runs(text: str, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends (in code points) of all runs of one class in a text of any length."""
    code, hs, ss, es = points(text), [], [], []
    at = 0
    while at < len(code):
        end = min(at + PIECE, len(code))
        if end < len(code):  # cut where no run is cut; a run longer than a piece is widened to
            stop = end
            while stop < len(code) and stop < at + 2 * PIECE - 1 and member[code[stop]]:
                stop += 1
            end = stop
        part = code[at:end]
        s, e = _runs(part, member)
        hs.append(span_hash(prefix_hash(part), s, e))
        ss.append(s + at)
        es.append(e + at)
        at = end
    if not hs:
        z = np.zeros(0, np.int64)
        return np.zeros(0, U64), z, z
    return np.concatenate(hs), np.concatenate(ss), np.concatenate(es)


class Words:
    """Hashes of all words of several texts: ``hash``, and ``bound`` with the words of text i at bound[i]:bound[i+1]."""

    __slots__ = ("hash", "bound", "start", "end", "joined")

    def __init__(self, texts: list[str | None], kind: str = "word", spans: bool = False):
        word, solid, *_ = _tables()
        clean = [t or "" for t in texts]
        if kind == "word":
            clean = [t.lower() for t in clean]
        self.joined = "\n".join(clean) + "\n" if clean else ""
        h, s, e = hash_runs(self.joined, word if kind == "word" else solid)
        size = np.fromiter(map(len, clean), np.int64, len(clean)) + 1
        edge = np.concatenate(([0], np.cumsum(size)))
        self.hash = h
        self.bound = np.searchsorted(s, edge).astype(np.int64)
        if spans:
            self.start, self.end = s, e
        else:
            self.joined = ""

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bound) - 1), np.diff(self.bound))


@lru_cache(maxsize=64)
def _odd(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0xA24BAED4963EE407)) | U64(1)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of words[i:i+n] for every i with n words left."""
    if len(words) < n:
        return np.zeros(0, U64)
    m, k = _odd(n), len(words) - n + 1
    out = np.zeros(k, U64)
    for j in range(n):
        out += words[j : j + k] * m[j]
    return mix(out)


def whole_hash(words: np.ndarray) -> np.uint64:
    """Hash of a whole short word list, apart from every n-gram hash."""
    m = _odd(len(words) + 1)
    return mix((words * m[1:]).sum(dtype=U64, keepdims=True) + U64(len(words)))[0]


def chunked(texts: list[str | None], limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about limit characters each (one text at least)."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) + 1 if t else 1
        if size and size + n > limit:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def doc_ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """N-gram hashes of all texts and their bounds; a text of 1 to n-1 words has one n-gram, the whole text."""
    b, count = words.bound, np.diff(words.bound)
    grams = ngram_hashes(words.hash, n)
    per = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    bound = np.concatenate(([0], np.cumsum(per)))
    out = np.empty(bound[-1], U64)
    long = count >= n
    if long.any():
        size, total = per[long], int(per[long].sum())
        shift = np.concatenate(([0], np.cumsum(size)[:-1]))
        step = np.arange(total) - np.repeat(shift, size)
        out[np.repeat(bound[:-1][long], size) + step] = grams[np.repeat(b[:-1][long], size) + step]
    for i in np.flatnonzero((count > 0) & ~long):
        out[bound[i]] = whole_hash(words.hash[b[i] : b[i + 1]])
    return out, bound


def sorted_sets(values: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values, ascending."""
    v, keep = values.copy(), np.ones(len(values), bool)
    for i, j in zip(bound[:-1].tolist(), bound[1:].tolist()):
        v[i:j].sort()
    keep[1:] = v[1:] != v[:-1]
    keep[bound[:-1][bound[:-1] < len(v)]] = True
    return v[keep], np.concatenate(([0], np.cumsum(keep)))[bound]


#: What an operator keeps in a worker from task to task; another operator's task drops it.
held: dict = {}


def give_back() -> None:
    """Return freed memory to the system: workers are reused, and an executor has several."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def batches(it: Iterable, column: str = "text", keep: bool = False, limit: int = PIECE) -> Iterator[tuple[object, list[str | None]]]:
    """Arrow record batches cut into pieces of about so many bytes of text, with their texts; ``keep`` leaves ``held`` alone."""
    if not keep and held:
        held.clear()
    yield from _pieces(it, column, limit)
    give_back()


def _pieces(it: Iterable, column: str, limit: int) -> Iterator[tuple[object, list[str | None]]]:
    for batch in it:
        texts = batch.column(batch.schema.get_field_index(column))
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        a = 0
        while a < len(texts):
            done = size[a - 1] if a else 0
            z = max(a + 1, int(np.searchsorted(size, done + limit, side="right")))
            yield batch.slice(a, z - a), texts.slice(a, z - a).to_pylist()
            a = z


class Characters:
    """Texts as one sequence of code points in which each run outside a class is one blank (0).

    ``code`` begins and ends with a blank; ``first[i]`` is where text i begins in it (after a
    blank) and ``first[-1]`` its length.  ``grams`` yields the n-grams that lie in one run,
    with the blank before or after it.
    """

    def __init__(self, texts: list[str | None], member: np.ndarray, lower: bool):
        clean = [(t or "").lower() if lower else (t or "") for t in texts]
        raw = points("\n" + "\n".join(clean) + "\n")
        size = np.fromiter(map(len, clean), np.int64, len(clean)) + 1
        edge = 1 + np.concatenate(([0], np.cumsum(size)))
        inside = member[raw]
        keep = inside.copy()
        keep[1:] |= inside[:-1]
        keep[0] = True
        self.code = np.where(inside, raw, 0)[keep].astype(np.uint32)
        self.first = np.concatenate(([0], np.cumsum(keep)))[edge]

    def grams(self, n: int, block: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(where the n-gram's second character lies, hash), in order, a block at a time."""
        value, m = _tables()[2], _odd(n)
        for a in range(0, max(len(self.code) - n + 1, 0), block):
            part = self.code[a : a + block + n - 1]
            k = len(part) - n + 1
            blank = part == 0
            ok = ~blank[1 : 1 + k]
            for j in range(2, n - 1):
                ok &= ~blank[j : j + k]
            v = value[part]
            h = v[:k] * m[0]
            for j in range(1, n):
                h += v[j : j + k] * m[j]
            at = np.flatnonzero(ok)
            yield at + (a + 1), mix(h[at])

    def per_text(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Sum of values for each text, by where they lie."""
        total = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)))
        return np.diff(total[np.searchsorted(at, self.first)], axis=0)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Code points of category L*."""
    out = np.zeros(sys.maxunicode + 1, bool)
    for c in range(len(out)):
        if unicodedata.category(chr(c))[0] == "L":
            out[c] = True
    return out


def solid() -> np.ndarray:
    """Code points that aren't white space."""
    return _tables()[1]
