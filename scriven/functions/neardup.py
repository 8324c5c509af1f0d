"""MinHash over word shingles: signatures in Arrow batches, near-duplicate blocks in a text.

A word is what white space separates; a shingle is three words in a row, or one word of a text
with fewer than three.  A shingle's base hash is 28 bits of its MD5, and slot k of a signature
is the least ``(a_k * h + b_k) mod p`` of the text's shingles, p = 2**31 - 1, so nothing
overflows.  Two texts are alike if they share a band of ``ROWS`` slots and at least
``THRESHOLD`` of all slots.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from . import lines as L
from .lexers import collapse, texts_udf

SLOTS, ROWS, SIZE, THRESHOLD = 64, 4, 3, 0.72
PRIME = (1 << 31) - 1
_g = np.random.default_rng(20230817)
A = _g.integers(1, PRIME, SLOTS).astype(np.int64)
B = _g.integers(0, PRIME, SLOTS).astype(np.int64)
_SPACE = re.compile("[" + L.WHITE + "]+")
BOUNDARY = r"\n[\r\n]+"


# MD5 of many short strings at once: its constants, shifts, order of words, and the padding by length.
_K = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_S = [np.uint32(s) for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_G = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]
_IV = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
SHORT = 55  #: bytes that fit one block
_HELD = np.zeros((SHORT + 1, 64), np.uint8)
_PAD = np.zeros((SHORT + 1, 64), np.uint8)
for _n in range(SHORT + 1):
    _HELD[_n, :_n] = 255
    _PAD[_n, _n] = 128
    _PAD[_n, 56:58] = (_n * 8 & 255, _n * 8 >> 8)
_HELD, _PAD = _HELD.view(np.uint64), _PAD.view(np.uint64)
STEP, CHARS = 1 << 13, 1 << 18


def _md5_short(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first 28 bits of the MD5 of raw[start : start + size], each at most SHORT; raw goes on for 64 bytes."""
    rows = np.lib.stride_tricks.sliding_window_view(raw, 64)[start].view(np.uint64)
    m = np.ascontiguousarray(((rows & _HELD[size]) | _PAD[size]).view("<u4").T)
    a, b, c, d = (np.full(len(start), x, np.uint32) for x in _IV)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += _K[i]
        f += m[_G[i]]
        np.right_shift(f, np.uint32(32) - _S[i], out=t)
        f <<= _S[i]
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    a += _IV[0]
    return a.byteswap() >> np.uint32(4)


def _words(text: str) -> list[str]:
    """What WHITE separates; str.split() also cuts at four control characters."""
    return [w for w in _SPACE.split(text) if w] if _CONTROLS.search(text) else text.split()


def _signatures(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the texts that have words, a row each, and which texts they are."""
    words = [_words(t) for t in texts]
    count = np.fromiter(map(len, words), np.int64, len(words))
    which = np.flatnonzero(count)
    if not len(which):
        return np.zeros((0, SLOTS), np.int64), which
    count = count[which]
    raw = " ".join(" ".join(w) for w in words if w).encode()
    whole = np.frombuffer(raw + bytes(64), np.uint8)
    end = np.append(np.flatnonzero(whole[: len(raw)] == 32), len(raw))
    start = np.append(0, end[:-1] + 1)
    # a shingle runs from its first word to the end of its last, in a text of fewer than SIZE words it is a word
    first, many = np.cumsum(count) - count, count >= SIZE
    per = np.where(many, count - (SIZE - 1), count)
    begin = np.cumsum(per) - per
    at = np.arange(per.sum()) + np.repeat(first - begin, per)
    size = end[at + np.repeat(np.where(many, SIZE - 1, 0), per)] - start[at]
    start = start[at]
    h = np.empty(len(at), np.uint64)
    for x in range(0, len(at), STEP):
        s, n = start[x : x + STEP], size[x : x + STEP]
        h[x : x + STEP] = _md5_short(whole, s, np.minimum(n, SHORT))
        for j in np.flatnonzero(n > SHORT).tolist():
            h[x + j] = int(hashlib.md5(raw[s[j] : s[j] + n[j]]).hexdigest()[:7], 16)
    out = np.full((len(which), SLOTS), PRIME, np.int64)
    for x in range(0, len(h), STEP):
        part = h[x : x + STEP]
        i, j = np.searchsorted(begin, [x, x + len(part) - 1], side="right") - 1
        edges = np.maximum(begin[i : j + 1] - x, 0)
        v, w = np.empty_like(part), np.empty_like(part)
        for k in range(SLOTS):  # 2**31 is 1 modulo PRIME
            np.multiply(part, _A[k], out=v)
            v += _B[k]
            np.right_shift(v, _31, out=w)
            v &= _P
            v += w
            low = v.astype(np.uint32)
            np.minimum(low, low - _P32, out=low)  # less than 2 * PRIME; what would be negative is large
            out[i : j + 1, k] = np.minimum(out[i : j + 1, k], np.minimum.reduceat(low, edges))
    return out, which


_A, _B, _31, _P, _P32 = A.astype(np.uint64), B.astype(np.uint64), np.uint64(31), np.uint64(PRIME), np.uint32(PRIME)
_CONTROLS = re.compile("[\x1c-\x1f]")


@F.arrow_udf(ArrayType(LongType()))
def _signature_udf(texts: pa.Array) -> pa.Array:
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    parts, a = [], 0
    while a < len(texts):  # some CHARS bytes at a time
        z = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + CHARS, side="right")))
        rows, which = _signatures([t or "" for t in texts.slice(a, z - a).to_pylist()])
        has = np.zeros(z - a, np.int64)
        has[which] = SLOTS
        offsets = pa.array(np.append(0, np.cumsum(has)).astype(np.int32))
        parts.append(pa.ListArray.from_arrays(offsets, pa.array(rows.ravel(), pa.int64()), mask=pa.array(has == 0)))
        a = z
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))


_signature_udf = _signature_udf.asNondeterministic()  # computed once, however often it is named


def signature_of(text: Column) -> Column:
    """ARRAY<BIGINT> of SLOTS; null if the text has no words."""
    return _signature_udf(text)


def blocks(text: Column) -> Column:
    """Parts of a text between blank lines (runs of line ends)."""
    return F.filter(F.split(text, BOUNDARY), lambda b: b != "")


def signature(text: str) -> np.ndarray | None:
    words = [w for w in _SPACE.split(text) if w]
    if not words:
        return None
    grams = {" ".join(words[i : i + SIZE]) for i in range(len(words) - SIZE + 1)} if len(words) >= SIZE else set(words)
    h = np.array([int(hashlib.md5(g.encode()).hexdigest()[:7], 16) for g in grams], np.int64)
    out = np.full(SLOTS, PRIME, np.int64)
    for a in range(0, len(h), 4096):
        out = np.minimum(out, ((h[a : a + 4096, None] * A + B) % PRIME).min(axis=0))
    return out


def distinct_blocks(text: str) -> str:
    """Blocks in order, without those equal or alike to one kept before; blank lines collapsed."""
    kept, exact, sigs = [], set(), []
    bands: list[dict[bytes, list[int]]] = [{} for _ in range(SLOTS // ROWS)]
    parts = re.split(BOUNDARY, text)
    if parts and not parts[-1]:
        parts.pop()
    alone = len(dict.fromkeys(k for b in parts if (k := b.strip(L.WHITE)))) < 2  # nothing to compare it with
    for block in parts:
        key = block.strip(L.WHITE)
        if not key:
            kept.append(block)
            continue
        if key in exact:
            continue
        exact.add(key)
        if alone:
            kept.append(block)
            continue
        sig = signature(key)
        own = [sig[b * ROWS : (b + 1) * ROWS].tobytes() for b in range(len(bands))]
        near = {i for b, k in enumerate(own) for i in bands[b].get(k, ())}
        if any((sigs[i] == sig).mean() >= THRESHOLD for i in near):
            continue
        for b, k in enumerate(own):
            bands[b].setdefault(k, []).append(len(sigs))
        sigs.append(sig)
        kept.append(block)
    return collapse("\n\n".join(kept))


drop_near_blocks = texts_udf(distinct_blocks)
